import random

from folioscope.llm import truncation

from tests.conftest import rows

SCHEMA = "row_id long, source string, answer string"
SUBJECTS = "the manager|a designer|the legal team|your mentor|the on-call engineer|a recruiter|the office host".split("|")
VERBS = "must approve|can update|will archive|has to check|may share|should review".split("|")
OBJECTS = "the travel booking|every invoice|the weekly report|a password reset|the release note|the price quote".split("|")
PLACES = "in the tracker|by Friday noon|on the planning board|before the end of the month|within two weeks|by mail".split("|")


def text(rng):
    sentence = lambda: " ".join(map(rng.choice, (SUBJECTS, VERBS, OBJECTS, PLACES))).capitalize() + "." + rng.choice(["", "[1]", "[2][3]"])
    return rng.choice(["Yes", "4 days"]) if rng.random() < 0.05 else " ".join(sentence() for _ in range(rng.randint(1, 6)))


def corpus(seed, n):
    rng = random.Random(seed)
    rows_, cut = [], set()
    for i in range(n):
        whole, source = text(rng), rng.choice(["whole", "limited", "broken", None])
        if source == "limited" and len(whole) > 150:
            if whole[149] not in ".]" and whole[150] not in "[.]":
                cut.add(i)
            whole = whole[:150] + rng.choice(["", "", "…", " [more]"])
        if source == "broken" and rng.random() < 0.15 and len(whole) > 60:
            at = rng.randint(40, len(whole) - 2)
            if whole[at - 1] not in ".] " and whole[at] not in ". [":
                whole, _ = whole[:at], cut.add(i)
        rows_.append((i, source, whole))
    return rows_, cut


def test_cut_texts_are_found(spark):
    data, cut = corpus(8, 4000)
    extra = [(-1, "whole", None), (-2, "whole", ""), (-3, "whole", " \n"), (None, "whole", "Lost")]
    df = spark.createDataFrame(data + data[:100] + extra, SCHEMA).selectExpr("*", "1 as id", "2 as writer", "'c' as contexts")
    judged = truncation.cut_texts(df.repartition(3), "row_id", "answer", "source").cache()
    got = {r.id for r in judged.where("is_cut").collect()}
    assert judged.count() == len(data)
    assert len(got & cut) / len(cut) > 0.95 and len(got & cut) / len(got) > 0.95
    report = {r.source: r.cut_share for r in truncation.cut_report(judged).collect()}
    assert report["whole"] < 0.01 and report["limited"] > 0.3 and None in report


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "One sentence."), (2, None, "x" * 60_000)], SCHEMA)
    assert truncation.cut_texts(df, "row_id", "answer", "source").count() == 2
    assert rows(truncation.cut_texts(df.limit(0), "row_id", "answer", "source")) == []


def test_marks_are_no_part_of_the_text():
    assert truncation.bare_end("It ends in the mid… [more]  ") == "It ends in the mid"
    assert truncation.bare_end("…") == "…" and truncation.bare_end("Fine. ") == "Fine."
