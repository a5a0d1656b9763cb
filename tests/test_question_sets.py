from pyspark.sql import functions as F

from folioscope.operators import evaluate, grounding, layout, nested
from folioscope.sources import question_sets

from tests.conftest import rows

FIELDS = "id string, question string, expect array<string>, out_of_scope boolean, answer string, evidence string, pool string, style string"


def test_questions_are_read_as_they_were_written(spark, tmp_path):
    data = [("a", "Why?", ["x/y", "z"], False, "So.", "p3: so", "dev", None), ("b", "Who?", None, True, None, None, "dev", "terse"), ("c", None, [], None, "", None, "dev", None)]
    question_sets.write_questions(spark.createDataFrame(data, FIELDS), f"{tmp_path}/q")
    got = {r.id: r for r in question_sets.read_questions(spark, f"{tmp_path}/q").collect()}
    assert got["a"].expect == ["x/y", "z"] and not got["a"].out_of_scope and got["a"].evidence == "p3: so"
    assert got["b"].expect is None and got["b"].out_of_scope and got["c"].expect == [] and got["c"].question is None
    (tmp_path / "one.json").write_text('{"id": "d", "expect": "x/y"}\n{"id": "e", "expect": "not-covered"}\n')
    got = {r.id: (r.expect, r.out_of_scope) for r in question_sets.read_questions(spark, f"{tmp_path}/one.json").collect()}
    assert got == {"d": (["x/y"], False), "e": (None, True)}


def test_results_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, "pass"), (2, None)], "row_id long, grade string")
    question_sets.write_results(df, f"{tmp_path}/r")
    assert rows(spark.read.schema(df.schema).json(f"{tmp_path}/r")) == rows(df)


def test_research_checks(spark):
    answers = spark.createDataFrame(
        [(1, "not-covered", 1), (2, "not-covered", 2), (3, "not-covered", None), (4, "answered", 4), (4, "answered", 4), (5, "error", 5), (None, "answered", 4)],
        "row_id long, status string, trace_id long",
    )
    research = spark.createDataFrame([(1, "not-covered", "kept-first"), (2, "answered", "failed"), (4, "not-covered", "used-second"), (5, "not-covered", "failed")], "trace_id long, first string, outcome string")
    assert rows(evaluate.research_checks(answers, research)) == [("1/3", "1/3")]
    assert rows(evaluate.research_checks(answers.limit(0), research)) == [("n/a", "n/a")]


def test_research_is_read_from_any_shape(spark):
    records = [
        (1, 1, '{"research": {"first": "answered", "outcome": "used-second"}}'),
        (2, 2, '[trace] {"run": {"research": {"outcome": "failed", "first": {"status": "not-covered"}}}}'),
        (3, 3, '{"research": null}'),
        (4, 4, '{"first": "answered", "outcome": "x"}'),
    ]
    log = spark.createDataFrame(records, "line_id long, trace_id long, record string")
    assert rows(nested.research_table(nested.record_nodes(log))) == [(1, "answered", "used-second"), (2, "not-covered", "failed")]


def test_labels_previews_and_text_blocks(spark):
    df = spark.createDataFrame([([3], "- one - two"), ([3, 4, 5], "  - x"), ([], None)], "pages array<int>, quote string")
    got = [tuple(r) for r in df.select(grounding.page_label(F.col("pages")), grounding.quote_preview(F.col("quote"))).collect()]
    assert got == [("p. 3", "one - two"), ("pp. 3–4–5", "x"), (None, None)]
    reply = spark.createDataFrame([("q", 0, "thinking", "hm"), ("q", 1, "text", "yes"), ("q", 2, None, "?")], "query_id string, block_ord int, type string, text string")
    assert [r.text for r in grounding.text_blocks(reply).collect()] == ["yes"]


def test_missing_and_unknown_are_reported(spark):
    questions = spark.createDataFrame([("a", ["s1", "gone"]), ("b", None), ("c", ["contents/handbook/s1.md", None])], "id string, expect array<string>")
    chunks = spark.createDataFrame([("contents/handbook/s1.md",)], "section_path string")
    assert rows(evaluate.missing_expectations(questions, chunks)) == [("a", "gone")]
    answers = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (2, "x")], "row_id long, id string")
    assert rows(evaluate.unknown_answers(answers, questions)) == [(2, "x"), (3, None)]


def test_evidence_is_found_by_its_rarest_word(spark):
    questions = spark.createDataFrame(
        [("a", ["s"], False, "p1: the quick  fox ran"), ("b", ["s"], None, "p2: fox"), ("c", ["s"], False, "p3: nowhere to be seen"), ("d", ["s"], True, "p1: the quick fox ran"), ("e", ["t"], False, "p1: uick fox ra")],
        "id string, expect array<string>, out_of_scope boolean, evidence string",
    )
    chunks = spark.createDataFrame([("1", "s.md"), ("2", "s.md"), ("3", "t.md"), (None, "s")], "chunk_id string, section_path string")
    index = spark.createDataFrame([("1", "T", "See: the quick\nfox ran off."), ("2", None, "a firefox"), ("3", "x", "the quick fox ran"), ("4", "", "the quick fox ran")], "chunk_id string, title string, body string")
    assert rows(evaluate.evidence_chunks(questions, index, chunks)) == [("a", "1"), ("b", "1"), ("b", "2"), ("e", "3")]
    assert rows(evaluate.evidence_chunks(questions, index.limit(0), chunks)) == []


def test_printed_sections_are_parsed_back(spark):
    sections = spark.createDataFrame([("s", "Time off", "contents/handbook/time.md", 3), ("n", None, None, 1)], "section_id string, title string, path string, start_page int")
    long = " ".join(f"word{i}" for i in range(40)) + "."
    data = [
        ("s", 0, "heading", 2, None, "Leave", 3), ("s", 1, "paragraph", None, 0, long, 3), ("s", 2, "paragraph", None, 1, "An item.", 3),
        ("s", 3, "heading", 3, None, "More", 4), ("s", 4, "paragraph", None, None, "The end.", 4), ("s", 5, "paragraph", None, 0, None, 4),
    ]
    blocks = spark.createDataFrame(data, "section_id string, block_ord int, kind string, level int, list_level int, text string, page int")
    got = sorted(layout.section_blocks(layout.section_lines(sections, blocks)).collect(), key=lambda r: r.block_ord)
    assert [(r.section_title, r.section_path) for r in got] == [("Time off", "contents/handbook/time.md")] * 5
    assert [(r.kind, r.level, r.list_level, r.text, r.page) for r in got] == [
        ("heading", 2, 0, "Leave", 3), ("paragraph", None, 0, long, 3), ("paragraph", None, 1, "An item.", 3), ("heading", 3, 0, "More", 4), ("paragraph", None, 0, "The end.", 4),
    ]
