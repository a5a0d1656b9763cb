import math
import random

import numpy as np

from folioscope.operators import keyword, semantic

from tests.conftest import rows

INDEX = "chunk_id string, title string, body string"


def index(spark):
    return spark.createDataFrame(
        [
            ("a", "Travel", "book a flight for travel"),
            ("b", "Travel", "travel budget and hotels"),
            ("c", "Alerts", "set cost-alerts for travel spending"),
            ("d", "Laptops", "order a laptop, travel light"),
            ("e", "Perks", None),
            ("a", "Travel", "book a flight for travel"),
        ],
        INDEX,
    )


def questions(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "id string, question string")


def test_document_frequency_counts_passages_once(spark):
    got = dict(rows(keyword.document_frequency(keyword.postings(index(spark)))))
    assert got["travel"] == 4 and got["cost-alerts"] == 1 and got["alerts"] == 1 and "for" not in got


def test_rare_words_and_best_match(spark):
    q = questions(spark, "How do I set cost-alerts for travel?", "travel", "tarvel", None)
    got = {(r.id, r.word) for r in keyword.rare_words(keyword.postings(index(spark)), q).collect()}
    assert got == {("q0", "set"), ("q0", "cost"), ("q0", "alerts"), ("q0", "cost-alerts")}
    assert [(r.id, r.chunk_id) for r in keyword.rare_word_match(index(spark), q).collect()] == [("q0", "c")]


def test_empty_index(spark):
    empty = index(spark).limit(0)
    assert rows(keyword.document_frequency(keyword.postings(empty))) == [] and rows(keyword.rare_word_match(empty, questions(spark, "x"))) == []


def test_keyword_match_takes_the_last_slot(spark):
    ranked = spark.createDataFrame([(1, i + 1, c) for i, c in enumerate("abcd")], "query int, rank int, chunk_id string")
    match = lambda c: spark.createDataFrame([(1, c)] if c else [], "query int, chunk_id string")
    ids = lambda c, k: [r.chunk_id for r in semantic.with_keyword_match(ranked, match(c), k).orderBy("rank").collect()]
    assert ids("x", 3) == ["a", "b", "x"]
    assert ids("b", 3) == ["a", "b", "c"]
    assert ids("d", 3) == ["a", "b", "d"]
    assert ids(None, 3) == ["a", "b", "c"]
    assert ids("x", 1) == ["x"]
    assert ids("x", 0) == []
    assert ids("x", 9) == ["a", "b", "c", "d", "x"]


def test_semantic_topk_is_exact_and_skips_unusable(spark):
    data = [(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.6, 0.8]), (3, [0.0, 2.0]), (4, [0.0, 0.0]), (5, [math.nan, 1.0]), (6, None), (7, [1.0]), (3, [0.0, 2.0])]
    v = spark.createDataFrame(data, "chunk_ord int, embedding array<float>")
    usable = semantic.usable_vectors(v, 2)
    assert sorted(r.chunk_ord for r in usable.collect()) == [0, 1, 2, 3]


def test_round_robin_and_closest_sections(spark):
    hits = spark.createDataFrame(
        [(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "c"), (1, 2, 2, "a"), (1, 2, 3, "d")], "query int, search int, rank int, chunk_id string"
    )
    seen = spark.createDataFrame([(1, "c")], "query int, chunk_id string")
    got = [r.chunk_id for r in semantic.round_robin(hits, seen, 8).orderBy("position").collect()]
    assert got == ["a", "b", "d"]
    ranked = spark.createDataFrame([(1, i + 1, c) for i, c in enumerate("abcd")], "query int, rank int, chunk_id string")
    chunks = spark.createDataFrame(
        [("a", "s1", "T1", [(3, "x")]), ("b", "s1", "T2", [(4, "x")]), ("c", "s2", "T3", []), ("d", "s3", None, None)],
        "chunk_id string, section_path string, title string, pages array<struct<page:int,text:string>>",
    )
    got = [tuple(r)[1:] for r in semantic.closest_sections(ranked, chunks).orderBy("position").collect()]
    assert got == [(1, "s1", "T1", 3), (2, "s2", "T3", None), (3, "s3", None, None)]


def test_added_passages_join_the_first_ones(spark):
    chunks = spark.createDataFrame([(c, s, c, [(1,)]) for c, s in ("aA", "bB", "cA", "dD")], "chunk_id string, section_path string, title string, pages array<struct<page:int>>")
    first = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (50, 1, "b")], "query int, rank int, chunk_id string")
    added = spark.createDataFrame([(0, 1, "gone"), (0, 2, "d"), (0, 3, "c")], "query int, rank int, chunk_id string")
    second = sorted(tuple(r) for r in semantic.one_after_another(first, added, chunks).collect())
    assert second == [(0, 1, "a"), (0, 2, "b"), (0, 3, "d"), (0, 4, "c"), (50, 1, "b")]
    closest = semantic.closest_sections(semantic.one_after_another(added, first, chunks), chunks)
    assert sorted(tuple(r)[:3] for r in closest.collect()) == [(0, 1, "D"), (0, 2, "A"), (0, 3, "B"), (50, 1, "B")]
    cited = spark.createDataFrame([(7, 0, "c"), (7, 0, "a"), (8, 0, "a"), (9, 50, "d")], "row_id int, query int, chunk_id string")
    assert [r[0] for r in semantic.cites_added(cited, added).collect()] == [7]


def test_blocks_of_vectors_and_queries_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    data = [(i, [rng.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(64)]) for i in range(90)]
    v = spark.createDataFrame(data, "chunk_ord int, embedding array<float>")
    asked = v.where("chunk_ord % 4 = 0")
    whole = rows(semantic.semantic_topk(v, asked, 5))
    units = {i: [x / math.sqrt(sum(y * y for y in e)) for x in e] for i, e in data}
    similar = lambda a, b: round(sum(x * y for x, y in zip(units[a], units[b], strict=True)), 6)
    for q in range(0, 90, 4):
        best = sorted(((-similar(q, i), i) for i in units))[:5]
        assert [(r[1], r[2]) for r in sorted(whole) if r[0] == q] == [(n + 1, i) for n, (_, i) in enumerate(best)]
    monkeypatch.setattr(semantic, "LEAST_BLOCK", 16)
    monkeypatch.setattr(semantic, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(semantic, "QUERY_BLOCK", 7)
    assert rows(semantic.semantic_topk(v, asked, 5)) == whole
    assert rows(semantic.semantic_topk(v.limit(0), asked, 5)) == [] and rows(semantic.semantic_topk(v, v.limit(0), 5)) == []
    pairs = spark.createDataFrame([(0, 4), (8, 1000)], "query_ord int, chunk_ord int")
    got = {r.chunk_ord: r.similarity for r in semantic.pair_similarity(pairs, v).collect()}
    assert abs(got[4] - similar(0, 4)) < 2e-6 and got[1000] is None


def test_blocks_ship_little_and_stay_bounded():
    for vectors, queries in ((54_000, 4_320), (330_000, 26_400), (3_000_000, 240_000), (30, 3), (0, 0)):
        v, q = semantic.block_numbers(vectors, queries)
        assert v * semantic.VECTOR_BLOCK >= vectors and q * semantic.QUERY_BLOCK >= queries and v >= 1 and q >= 1
        if 0 < vectors <= 330_000:  # rows shipped; dealing 64 blocks against 7 took 12 times the vectors
            assert q * vectors + v * queries <= 4 * vectors


def test_rough_candidates_hold_the_best(monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 64))
    v[1500:] = v[:1500] + 1e-5 * rng.normal(size=(1500, 64))  # near copies, which single precision can't tell apart
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = v[::40]
    similar = np.round(q @ v.T, 6)
    want = [(i, j) for i, row in enumerate(similar) for j in np.lexsort((np.arange(3000), -row))[:10]]
    for at_once in (semantic.AT_ONCE, 10_000):
        monkeypatch.setattr(semantic, "AT_ONCE", at_once)
        of, near, _ = semantic.best_of_block(v, q, 10)
        assert list(zip(of, near, strict=True)) == want


def test_closest_sections_shuffle_no_page_texts(spark):
    ranked = spark.createDataFrame([(1, 1, "a")], "query int, rank int, chunk_id string")
    chunks = spark.createDataFrame([("a", "s1", "T1", [(3, "x")])] * 2, "chunk_id string, section_path string, title string, pages array<struct<page:int,text:string>>")
    closest = semantic.closest_sections(ranked, chunks)
    assert [tuple(r) for r in closest.collect()] == [(1, 1, "s1", "T1", 3)]
    plan = closest._jdf.queryExecution().optimizedPlan().toString()
    aggregates = [x for x in plan.splitlines() if "Aggregate [chunk_id" in x]
    assert aggregates and not any("pages" in x for x in aggregates)


def test_best_passages_in_blocks_equal_the_join(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    index = spark.createDataFrame([(f"c{i:02}", rng.choice(words), " ".join(rng.choices(words, k=12))) for i in range(60)] + [("c00", "again", "x")] * 0, INDEX)
    asked = spark.createDataFrame([(f"q{i:02}", " ".join(rng.choices([*words, "unknown"], k=5))) for i in range(20)] + [("none", "unknown"), ("null", None), (None, "w1")], "id string, question string")
    held = keyword.postings(index)
    want = rows(keyword.best_passages(keyword.bm25_scores(index, held, keyword.question_terms(asked)), 4).select("id", "rank", "chunk_id"))
    got = lambda: rows(keyword.bm25_best(index, asked, 4).select("id", "rank", "chunk_id"))
    assert got() == want
    monkeypatch.setattr(keyword, "PASSAGE_BLOCK", 16)
    monkeypatch.setattr(keyword, "QUESTION_BLOCK", 6)
    monkeypatch.setattr(keyword, "AT_ONCE", 5)
    assert got() == want
    assert rows(keyword.bm25_best(index.limit(0), asked, 4)) == [] and rows(keyword.bm25_best(index, asked.limit(0), 4)) == []
