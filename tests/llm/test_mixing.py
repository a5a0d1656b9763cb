import random

from folioscope.llm import mixing

from tests.conftest import rows

TARGETS = "source string, target_share double, max_repeats int"
SIZED = "doc_id long, source string, text_key string, tokens long"


def documents(spark):
    rng = random.Random(7)
    data = [(i, "Big Source" if i % 3 else " big-source", f"k{i}", rng.randint(1, 400)) for i in range(3000)]
    data += [(3000 + i, "small", f"s{i}", 50) for i in range(60)]
    data += [(9000 + i, "small", f"s{i}", 50) for i in range(30)]  # copies under other ids
    data += [(4000, None, "n", 9), (None, "small", "x", 9), (4001, "other", "o", 9), (4002, "small", "zero", 0), (4003, "small", "null", None)]
    return spark.createDataFrame(data, SIZED)


def targets(spark):
    return spark.createDataFrame([("big_source", 0.7, 1), ("SMALL", 0.2, 3), ("nothing", 0.1, 4), (None, 0.5, 1)], TARGETS)


def test_shares_and_repeats(spark):
    drawn, plan = mixing.mixture(documents(spark), targets(spark), bucket_rows=500)
    got = {r.source: r for r in mixing.share_report(drawn, plan).collect()}
    assert set(got) == {"big_source", "small", "nothing"} and got["nothing"].tokens_used == 0
    assert abs(got["big_source"].actual_share - 7 / 9) < 0.005 and abs(got["small"].actual_share - 2 / 9) < 0.005
    assert got["small"].texts == 60 and got["small"].most_repeats == 3 and got["big_source"].most_repeats == 1
    ids = [r.doc_id for r in drawn.collect()]
    assert len(ids) == len(set(ids)) and all(i < 4000 for i in ids)
    assert rows(drawn) == rows(mixing.mixture(documents(spark), targets(spark), bucket_rows=500)[0])


def test_a_larger_total_is_capped_by_repeats(spark):
    drawn, plan = mixing.mixture(documents(spark), targets(spark), total_tokens=10**7)
    got = {r.source: r for r in mixing.share_report(drawn, plan).collect()}
    assert got["small"].tokens_used == 60 * 50 * 3 and got["big_source"].copies_used == 3000


def test_empty_tables(spark):
    for d, t in ((documents(spark).limit(0), targets(spark)), (documents(spark), targets(spark).limit(0))):
        drawn, plan = mixing.mixture(d, t)
        assert rows(drawn) == []
        assert all(r.tokens_used == 0 for r in mixing.share_report(drawn, plan).collect())


def test_a_text_counts_where_a_copy_has_a_target(spark):
    copies = [(-3, None, "s0", 50), (-2, "other", "s1", 50), (-1, None, "gone", 50), (5000, "small", "s0", 50)]
    some = documents(spark).where("doc_id < 9000").unionByName(spark.createDataFrame(copies, SIZED))
    drawn, plan = mixing.mixture(some, targets(spark))
    got = {r.source: r for r in plan.collect()}
    assert got["small"].texts == 60 and got["small"].available == 60 * 50
    assert all(r.doc_id >= 0 for r in drawn.collect())
