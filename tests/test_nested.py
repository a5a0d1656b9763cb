import json

from folioscope.operators import nested
from folioscope.streaming.traces import node_stream

from tests.conftest import rows

LOG = "line_id long, trace_id long, record string"
ADDED = [{"id": "a#1", "rank": 1}, {"id": "b#2", "rank": 2}]
SHAPES = {
    1: {"ms": {"search": 2, "answer": "5ms", "rewrite": None, "total": 7}, "usage": {"input": 3, "output": None},
        "research": {"queries": ["q0", "q1"], "added": ["a#1", "b#2"]}},
    2: {"v": 2, "trace": {"ms": {"steps": [{"name": "search", "took": 2}, {"name": "answer", "took": 5}], "total": 7},
        "usage": {"calls": [{"input": 3, "model": "m"}]},
        "research": {"rounds": [{"query": "q0", "added": ADDED[:1]}, {"query": "q1", "added": ADDED[1:]}]}}},
    3: {"event": {"payload": {"trace": {"ms": {"parts": {"search": {"unit": "ms", "value": 2}, "answer": {"value": 5}}, "total": 7},
        "usage": [{"call": 0, "tokens": {"input": 3}}],
        "research": {"queries": [{"text": "q0"}, {"text": "q1"}], "added": {"count": 2, "items": ["a#1", "b#2"]}}}}}},
    4: {"ms": {"search": 2, "answer": 5, "total": 7}, "usage": {"input": "3"},
        "research": json.dumps({"queries": ["q0", "q1"], "added": ["a#1", "b#2"]})},
}
CHILDREN = {
    ("ms", 0, "search"), ("ms", 0, "answer"), ("ms", 0, "total"), ("usage", 0, "input"), ("research.queries", 0, "q0"),
    ("research.queries", 1, "q1"), ("research.added", 0, "a#1"), ("research.added", 1, "b#2"),
}


def log(spark, *lines):
    return spark.createDataFrame([(i, t, r) for i, (t, r) in enumerate(lines)], LOG)


def test_every_shape_gives_the_same_children(spark):
    nodes = nested.record_nodes(log(spark, *((t, json.dumps(r)) for t, r in SHAPES.items())))
    got = {}
    for r in nested.trace_children(nodes.cache()).collect():
        got.setdefault(r.trace_id, []).append((r.child, r.ord, r.item))
    assert {t: set(x) for t, x in got.items()} == {t: CHILDREN for t in SHAPES}
    assert all(len(x) == len(CHILDREN) for x in got.values())
    assert {(r.trace_id, r.item): r.ms for r in nested.step_table(nodes).collect()}[1, "answer"] == 5.0


def test_lines_of_one_trace_count_once_and_damaged_ones_not_at_all(spark):
    whole = json.dumps(SHAPES[1])
    lines = [(1, whole), (1, "[ask] " + whole), (1, "﻿" + whole), (2, whole[:-3]), (3, "[]"), (4, "null"), (5, ""), (6, None), (None, whole), (7, "{}")]
    nodes = nested.record_nodes(log(spark, *lines).union(log(spark, *lines)))
    assert sorted((r.child, r.ord, r.item) for r in nested.trace_children(nodes).collect()) == sorted(CHILDREN)
    assert [r.trace_id for r in nested.trace_table(nodes).orderBy("trace_id").collect()] == [1, 7]


def test_null_and_odd_entries_keep_their_positions(spark):
    record = {"research": {"queries": ["a", None, "", {"text": "d"}, {}], "added": None}, "ms": {"total": ""}, "usage": {}}
    got = rows(nested.trace_children(nested.record_nodes(log(spark, (1, json.dumps(record))))))
    assert got == [(1, "research.queries", 0, "a"), (1, "research.queries", 3, "d")]


def test_intervals_nest(spark):
    nodes = nested.label({"a": [1, {"b": None}], "c": "x" * 100_000})
    by_pre = {n[0]: n for n in nodes}
    assert len({x for n in nodes for x in n[:2]}) == 2 * len(nodes)
    for pre, post, parent, depth, *_ in nodes:
        inside = [n for n in nodes if n[0] < pre and post < n[1]]
        assert len(inside) == depth and (parent == -1 or by_pre[parent] in inside)


def test_deep_records_and_clashing_columns(spark):
    deep = "[" * 5000 + "]" * 5000
    lines = log(spark, (1, '{"a":' + deep + "}"), (2, json.dumps(SHAPES[1]))).selectExpr("*", "1 as pre", "'x' as name", "'y' as value")
    nodes = nested.record_nodes(lines)
    assert set(r.trace_id for r in nodes.select("trace_id").distinct().collect()) >= {2}
    assert nested.trace_children(nested.record_nodes(log(spark))).count() == 0


def test_stream_gives_the_nodes_of_the_batch(spark, tmp_path):
    schema = LOG + ", logged_at timestamp, received_at timestamp"
    lines = log(spark, (1, json.dumps(SHAPES[1])), (2, json.dumps(SHAPES[2])))
    lines = lines.union(lines).selectExpr("*", "timestamp'2025-01-01' as logged_at", "cast(null as timestamp) as received_at")
    lines.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = (
        node_stream(stream).writeStream.format("memory").queryName("nodes").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert rows(spark.table("nodes")) == rows(nested.record_nodes(log(spark, (1, json.dumps(SHAPES[1])), (2, json.dumps(SHAPES[2])))))
