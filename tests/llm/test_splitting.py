import random

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import splitting

SCHEMA = "item string, text string, piece_note int, start string"


def check(text, limit, overlap):
    pieces = splitting.split_points(text, limit, overlap)
    assert all(0 < end - start <= limit for start, end in pieces)
    covered = 0
    for i, (start, end) in enumerate(pieces):
        if i:
            assert 1 <= covered - start <= overlap
        else:
            assert start == 0
        assert end > covered
        covered = end
    assert covered == len(text)
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab cd.!\n  é́🙂"), max_size=700))
def test_no_text_is_lost(text):
    check(text, 60, 10)


def test_cuts_fall_at_sentences_and_topics():
    a = "The cat sat on the mat with the other cat. " * 6
    b = "Parquet files hold columns of typed values. " * 6
    pieces = check(a + b, 350, 60)
    assert pieces[0][1] == len(a)  # the valley between the topics, not the last sentence that fits
    words = "word " * 100
    assert all(words[end - 1] == " " for _, end in check(words, 80, 20)[:-1])
    assert [end for _, end in check("x" * 250, 100, 10)] == [100, 190, 250]


def test_long_texts_stay_fast():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "."]) for _ in range(40_000))
    check(text, 1000, 100)


def test_operator(spark):
    long = "One sentence here. " * 100
    data = [("a", long, 1, "x"), ("a", long, 1, "x"), ("b", "short", 1, "x"), ("c", None, 1, "x"), ("d", "", 1, "x"), (None, long, 1, "x"), ("e", "y" * 1001, 1, "x")]
    df = spark.createDataFrame(data, SCHEMA)
    got = splitting.split_long_texts(df, ["item"]).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.piece_ord):
        by.setdefault(r["item"], []).append(r)
    assert set(by) == {"a", "b", None, "e"} and len(by["b"]) == 1
    assert "".join(r.piece[r.overlap :] for r in by["a"]) == long and all(r.unbroken == 0 for r in by["a"])
    assert [r.unbroken for r in by["e"]] == [1, 1]
    assert splitting.split_long_texts(df.limit(0), ["item"]).count() == 0
