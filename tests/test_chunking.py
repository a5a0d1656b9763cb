from folioscope.functions import text as T
from folioscope.operators import chunking
from pyspark.sql import functions as F

from tests.conftest import rows

BLOCK = "section_id string, block_ord int, kind string, level int, list_level int, text string, page int, continued boolean"
SECTION = "section_id string, title string, path string"
PATH = "contents/handbook/people/time-off.md"


def chunks(spark, blocks, limit=1000, sections=None):
    b = spark.createDataFrame(blocks, BLOCK)
    s = spark.createDataFrame(sections or [("s", "Time off", PATH)], SECTION)
    out = chunking.chunk_sections(b, s, limit)
    return sorted(out.collect(), key=lambda r: (r.section_id, r.chunk_in_section))


def p(i, text, page=1, level=0, section="s"):
    return (section, i, "paragraph", None, level, text, page, None)


def h(i, level, text, section="s"):
    return (section, i, "heading", level, 0, text, 1, None)


def test_two_paragraphs_are_one_chunk(spark):
    (c,) = chunks(spark, [p(0, "One."), p(1, "Two.")])
    assert c.chunk_id == PATH + "#0" and c.title == "Time off" and c.headings == []
    assert [(x.page, x.text) for x in c.pages] == [(1, "One.\nTwo.")]


def test_heading_trails(spark):
    blocks = [h(0, 2, "A"), p(1, "a"), h(2, 3, "B"), p(3, "b"), h(4, 1, "C"), p(5, "c"), h(6, 3, "D"), p(7, "d"), h(8, 2, "E"), p(9, "e")]
    got = [c.headings for c in chunks(spark, blocks)]
    assert got == [["A"], ["A", "B"], ["C"], ["C", "D"], ["C", "E"]]
    assert chunks(spark, blocks)[3].title == "Time off › C › D"


def test_packing_respects_the_limit(spark):
    got = chunks(spark, [p(i, f"{i}" * 31) for i in range(5)], limit=100)
    assert [len(T_body(c)) for c in got] == [95, 63]


def T_body(chunk):
    return "\n".join(x.text for x in chunk.pages)


def test_pages_are_grouped_and_headings_alone_give_no_chunk(spark):
    (c,) = chunks(spark, [p(0, "a", 980), p(1, "b", 980), p(2, "c", 981)])
    assert [(x.page, x.text) for x in c.pages] == [(980, "a\nb"), (981, "c")]
    assert chunks(spark, [h(0, 2, "Only")]) == []


def test_long_paragraphs_lose_no_text(spark):
    text = " ".join(f"Sentence {i} of the text." for i in range(200))
    got = chunks(spark, [p(0, text)], limit=200)
    assert all(len(T_body(c)) <= 200 for c in got)
    assert " ".join(T_body(c).replace("\n", " ") for c in got) == text
    assert [c.chunk_id for c in got] == [f"{PATH}#{i}" for i in range(len(got))]


def test_repeated_null_and_orphan_rows(spark):
    blocks = [p(0, "a"), p(0, "a"), p(1, None), (None, 2, "paragraph", None, 0, "x", 1, None), p(0, "o", section="gone")]
    (c,) = chunks(spark, blocks, sections=[("s", None, PATH), ("s", None, PATH)])
    assert T_body(c) == "a" and c.title == ""
    assert chunks(spark, []) == []


def test_carried_values_cross_spans(spark):
    df = spark.createDataFrame([("k", i, "v" if i == 3 else None) for i in range(40)], "k string, i int, v string")
    got = chunking.carried_last(df, "k", "i", {"last": F.col("v")}, span=4)
    assert [r["last"] and r["last"]["at"] for r in got.orderBy("i").collect()] == [None] * 3 + [3] * 37


def test_length_statistics_use_positions(spark):
    data = [(f"c{n}", [(1, "x" * n)]) for n in (5, 1, 4, 2, 3)]
    df = spark.createDataFrame(data, "chunk_id string, pages array<struct<page:int,text:string>>")
    assert tuple(chunking.length_statistics(df).first()) == (5, 1, 3, 5, 5, 0)
    assert T.body_text is not None and rows(chunking.length_statistics(df.limit(0)))[0][0] == 0
