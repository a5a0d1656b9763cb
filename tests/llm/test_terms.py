import random
import unicodedata
from collections import Counter

import regex

from folioscope.llm import terms

from tests.conftest import rows

INDEX = "chunk_id string, title string, body string"


def brute(bodies):
    occurrences, passages = Counter(), Counter()
    for body in bodies:
        plain = regex.sub(r"\p{Cf}", "", unicodedata.normalize("NFKC", body or "")).lower()
        found = regex.findall(r"[\p{L}\p{N}]+", plain)
        occurrences.update(found)
        passages.update(set(found))
    return {t: (occurrences[t], passages[t]) for t in occurrences}


def test_counts_equal_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(600)] + ["ＦＵＬＬ", "ﬁne", "naïve", "so­ft"]
    bodies = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 80))) for _ in range(300)]
    data = [(f"c{i}", None, b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(data + data[:50] + [("empty", None, ""), ("null", "t", None), (None, None, "lost words")], INDEX).repartition(7)
    got = {r.term: (r.occurrences, r.passages) for r in terms.term_frequencies(df).collect()}
    assert got == brute(bodies)


def test_hot_terms_and_small_tries(spark, monkeypatch):
    monkeypatch.setattr(terms, "ROUTE_SHARE", 0.05)
    monkeypatch.setattr(terms, "ROUTE_ENTRIES", 10)
    data = [(f"c{i}", None, "hot hot " + " ".join(f"hot{j}" for j in range(i, i + 5))) for i in range(200)]
    df = spark.createDataFrame(data, INDEX).repartition(5)
    got = {r.term: (r.occurrences, r.passages) for r in terms.term_frequencies(df).collect()}
    assert got == brute(b for _, _, b in data) and got["hot"] == (400, 200)


def test_burst_trie_keeps_order_and_counts():
    trie = terms.BurstTrie(burst=3)
    words = sorted({f"{a}{b}{c}" for a in "ab" for b in "xyz" for c in ("", "1", "22")} | {"a", ""})
    for word in words * 2:
        trie.add(word.encode(), 2, 1)
    assert [(t.decode(), o, p) for t, o, p in trie.entries()] == [(w, 4, 2) for w in words] and trie.size == len(words)


def test_marks(spark):
    data = [(f"c{i}", None, "the " + ("once " if i < 2 else "") + ("some " if i < 5 else "")) for i in range(20)] + [("n", None, None)] * 2
    marked = {r.term: r.mark for r in terms.marked_terms(spark.createDataFrame(data, INDEX)).collect()}
    assert marked == {"the": "common", "once": "rare", "some": "common"}  # 5 of 21 is more than a fifth


def test_empty_long_and_extra_columns(spark):
    assert rows(terms.marked_terms(spark.createDataFrame([], INDEX))) == []
    df = spark.createDataFrame([("a", 1, 2, "w " * 200_000)], "chunk_id string, term int, passages int, body string")
    assert rows(terms.marked_terms(df)) == [("w", 200_000, 1, "rare")]
