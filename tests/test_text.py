from pyspark.sql import functions as F

from folioscope.functions import text as T


def value(spark, column, **literals):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in literals.items())).select(column).first()[0]


def test_trim_covers_unicode_white_space(spark):
    assert value(spark, T.trim(F.col("x")), x="﻿  a b\n ") == "a b"
    assert value(spark, T.collapse(F.col("x")), x=" a\n\n b c ") == "a b c"
    assert value(spark, T.squash(F.col("x")), x=" a\n b c ") == "abc"


def test_tokens_keep_joined_words_whole(spark):
    got = value(spark, T.tokens(F.col("x")), x="Use search_insights, or a-b?")
    assert got == ["Use", "search", "insights", "or", "a", "b", "search_insights", "a-b"]


def test_terms_drop_stop_words_and_joined_stop_words(spark):
    assert value(spark, T.terms(F.col("x")), x="If/when you Travel to-do") == ["travel"]  # both joined words are stop words
    assert value(spark, T.terms(F.col("x")), x="") == []


def test_searchable_needs_two_meaningful_words(spark):
    assert value(spark, T.is_searchable(F.col("x")), x="the vesting schedule")
    assert not value(spark, T.is_searchable(F.col("x")), x="any other schedule")


def test_render_block(spark):
    cases = [
        ("plain", 0, None, "plain"),
        ("one", 1, None, "- one"),
        ("two", 2, None, "  - two"),
        ("1. first", 1, None, "1. first"),
        ("rest", 1, True, "  rest"),
        ("null level", None, None, "null level"),
    ]
    df = spark.createDataFrame(cases, "t string, l int, c boolean, want string")
    for r in df.select(T.render_block(F.col("t"), F.col("l"), F.col("c")).alias("got"), "want").collect():
        assert r.got == r.want


def test_split_long_cuts_at_sentence_space_or_hard(spark):
    sentences = " ".join(f"Sentence number {i:02d} ends." for i in range(10))
    pieces = value(spark, T.split_long(F.col("x"), 60), x=sentences)
    assert all(len(p) <= 60 and p.endswith(".") for p in pieces) and " ".join(pieces) == sentences
    words = " ".join(["word"] * 40)
    pieces = value(spark, T.split_long(F.col("x"), 33), x=words)
    assert all(len(p) <= 33 for p in pieces) and " ".join(pieces) == words
    assert value(spark, T.split_long(F.col("x"), 10), x="x" * 25) == ["x" * 10, "x" * 10, "x" * 5]
    assert value(spark, T.split_long(F.col("x"), 10), x="") == []
    assert value(spark, T.split_long(F.col("x"), 10), x=None) is None


def test_short_path_and_markers(spark):
    assert value(spark, T.short_path(F.col("x")), x="contents/handbook/people/time-off.md") == "people/time-off"
    assert value(spark, T.without_markers(F.col("x")), x="a[1] b.[22]") == "a b."
