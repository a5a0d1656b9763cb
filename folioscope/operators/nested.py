"""Deeply nested JSON records as flat, linked node tables, by interval labels.

A depth-first walk gives every node of a record its pre-order and post-order number.  A node lies inside another one
exactly if its interval ``pre .. post`` lies inside the other's, at whatever depth and through whatever wrappers, so
that tables of one node type each can be linked by comparing intervals, without knowing the shape of the record.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A record can carry its log prefix, a byte order mark or white space before the JSON text.
LEAD = re.compile(r"[\s﻿]*(?:\[[A-Za-z_-]+\][\s﻿]*)?(?=\{)")
NODE = (
    "line_id long, trace_id long, pre int, post int, parent int, depth int, name string, position int, kind string, "
    "value string"
)
#: Steps of the pipeline that logs the records; fixed values.
STEPS = ["rewrite", "search", "answer", "research", "reanswer", "total"]


def parse_record(text: str | None) -> dict | None:
    """The JSON object of a logged line; None if the line isn't one whole record."""
    lead = LEAD.match(text or "")
    if lead is None:
        return None
    try:
        record = json.loads(text[lead.end() :])
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def _inner_json(value: str):
    """The object or array that a string holds as JSON text, or None."""
    if value[:1] in "{[" and value[-1:] in "}]" and len(value) > 1:
        try:
            return json.loads(value)
        except (ValueError, RecursionError):
            return None
    return None


def label(record: object, name: str = "record") -> list[tuple]:
    """(pre, post, parent, depth, name, position, kind, value) of every node, in pre-order; parent is a pre number.

    Pre- and post-order numbers come from one counter, so that an inner node's interval encloses those of all nodes
    below it.  Array elements carry the array's name and their position.  A string holding an object or array as JSON
    text is walked like the object or array itself.
    """
    nodes: list[list] = []
    stack: list[tuple] = [(name, None, record, -1, 0)]
    clock = 0
    while stack:
        entry = stack.pop()
        if len(entry) == 1:  # all below this node is done
            nodes[entry[0]][1] = clock
            clock += 1
            continue
        key, position, value, parent, depth = entry
        if isinstance(value, str) and (inner := _inner_json(value)) is not None:
            value = inner
        at, pre = len(nodes), clock
        clock += 1
        if isinstance(value, dict):
            nodes.append([pre, pre, parent, depth, key, position, "object", None])
            stack.append((at,))
            stack += [(str(k), None, v, pre, depth + 1) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            nodes.append([pre, pre, parent, depth, key, position, "array", None])
            stack.append((at,))
            stack += [(key, i, value[i], pre, depth + 1) for i in range(len(value) - 1, -1, -1)]
        else:
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else type(value).__name__
            kind = {"str": "string", "int": "number", "float": "number"}.get(kind, kind)
            shown = None if value is None else value if isinstance(value, str) else json.dumps(value)
            nodes.append([pre, clock, parent, depth, key, position, kind, shown])
            clock += 1
    return [tuple(n) for n in nodes]


def _under(nodes: list[tuple], names: frozenset[str]) -> list[tuple]:
    """The nodes of these names and all nodes below them; ``nodes`` are in pre-order."""
    kept, until = [], -1
    for node in nodes:
        if node[1] < until or node[4] in names:
            until = max(until, node[1])
            kept.append(node)
    return kept


def label_lines(batches: Iterator[pd.DataFrame], under: frozenset[str] | None = None) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in NODE.split(", ")]
    for batch in batches:
        rows = []
        for line, trace, text in batch.itertuples(index=False, name=None):
            record = parse_record(text)
            if record is not None:
                nodes = label(record)
                rows += [(line, trace, *node) for node in (nodes if under is None else _under(nodes, under))]
        frame = pd.DataFrame(rows, columns=columns)
        yield frame.astype({"position": "Int32", "line_id": "int64", "trace_id": "int64"}) if rows else frame


def record_nodes(log: DataFrame, under: list[str] | None = None) -> DataFrame:
    """One row per node of every readable record of ``log`` (line_id, trace_id, record), with its interval label.

    Lines without a line_id or trace_id, and lines that aren't one whole JSON object, give no rows; repeated rows count
    once.  ``value`` is a scalar's text, null for JSON null and inner nodes.  With ``under`` only the nodes of these
    names and those below them leave the task; their labels stay the same.
    """
    lines = (
        log.select(F.col("line_id").cast("long"), F.col("trace_id").cast("long"), "record")
        .where("line_id is not null and trace_id is not null and record is not null")
        .dropDuplicates(["line_id"])
    )
    names = None if under is None else frozenset(under)
    return lines.mapInPandas(lambda batches: label_lines(batches, names), NODE)


def inside(nodes: DataFrame, containers: DataFrame, name: str) -> DataFrame:
    """``nodes`` that lie in a node of ``containers`` of the same line, with that node's pre-order number as ``name``.

    Where containers nest, the innermost one is taken; it has the highest pre-order number of those around the node.
    """
    outer = containers.select("line_id", F.col("pre").alias("_from"), F.col("post").alias("_to"))
    pairs = nodes.join(outer, "line_id").where((F.col("_from") < F.col("pre")) & (F.col("post") < F.col("_to")))
    innermost = Window.partitionBy("line_id", "pre").orderBy(F.desc("_from"))
    return (
        pairs.withColumn("_nth", F.row_number().over(innermost))
        .where("_nth = 1")
        .withColumnRenamed("_from", name)
        .drop("_to", "_nth")
    )


def _named(nodes: DataFrame, name: str, *kinds: str) -> DataFrame:
    of = nodes.where(F.col("name") == name)
    return of.where(F.col("kind").isin(*kinds)) if kinds else of


def _ordinal() -> Column:
    """Position in document order among the rows of one line."""
    return (F.row_number().over(Window.partitionBy("line_id").orderBy("pre")) - 1).cast("int")


def _once(children: DataFrame, *more: str) -> DataFrame:
    """Lines of one trace tell the same: each child of the trace once."""
    return children.select("trace_id", "ord", "item", *more).groupBy("trace_id", "ord", "item").agg(
        *(F.max(c).alias(c) for c in more)
    ) if more else children.select("trace_id", "ord", "item").distinct()


def _filled(value: str = "value") -> Column:
    return F.length(F.trim(F.col(value))) > 0


def query_table(nodes: DataFrame) -> DataFrame:
    """``trace_id, ord, item``: the texts of the follow-up searches of each trace, in order.

    A query is a string under `queries`, or the `text` or `query` string of an object there, or the `query` of an entry
    of `rounds`; all of them inside a `research` node.  A query without text keeps its position and gives no row.
    """
    research = _named(nodes, "research", "object")
    lists = nodes.where("name in ('queries', 'rounds') and kind = 'array'")
    within = inside(lists, research, "research")
    entries = nodes.where("position is not null").join(
        within.select("line_id", F.col("pre").alias("parent"), F.col("name").alias("list")), ["line_id", "parent"]
    )
    texts = nodes.where("kind in ('string', 'number') and position is null and name in ('text', 'query')").select(
        "line_id", F.col("parent").alias("pre"), F.col("value").alias("inner")
    )
    found = (
        entries.where("kind = 'object' or list = 'queries'")
        .join(texts, ["line_id", "pre"], "left")
        .withColumn("ord", _ordinal())
        .withColumn("item", F.coalesce("inner", "value"))
    )
    return _once(found.where(_filled("item")))


def added_table(nodes: DataFrame) -> DataFrame:
    """``trace_id, ord, item``: the ids of the chunks that follow-up searches added, in order.

    An added chunk is a string in an array at or under `added`, or the `id` of an object there, inside a `research`
    node.  An entry without an id keeps its position and gives no row.
    """
    research = _named(nodes, "research", "object")
    added = inside(_named(nodes, "added", "object", "array"), research, "research")
    entries = inside(nodes.where("position is not null"), added, "added").where("kind in ('string', 'object', 'null')")
    # An entry is directly in the array `added` or in an array (of whatever name) directly in the object `added`.
    ids = nodes.where("name in ('id', 'chunk_id', 'chunk') and position is null and kind in ('string', 'number')").select(
        "line_id", F.col("parent").alias("pre"), F.col("value").alias("inner")
    )
    found = (
        entries.join(ids, ["line_id", "pre"], "left")
        .withColumn("ord", _ordinal())
        .withColumn("item", F.coalesce("inner", "value"))
    )
    return _once(found.where(_filled("item")))


def _milliseconds(value: str = "value") -> Column:
    """A duration as a number of milliseconds; texts may carry the unit."""
    number = F.regexp_extract(value, r"^\s*(-?\d+(?:\.\d+)?)\s*(?:ms)?\s*$", 1)
    return F.when(F.length(number) > 0, number.cast("double"))


def step_table(nodes: DataFrame) -> DataFrame:
    """``trace_id, ord (0), item, ms``: the time of each step of a trace that has a value.

    A step is a scalar named like it inside an `ms` node; or, there, an object named like it with a `value`; or an
    object with the step as its `name` and a `took`.
    """
    times = inside(
        nodes.where("kind in ('string', 'number')"), nodes.where("name = 'ms' and kind = 'object'"), "ms"
    ).select("line_id", "trace_id", "pre", "parent", "name", "value")
    plain = times.where(F.col("name").isin(STEPS)).select("trace_id", F.col("name").alias("item"), "value")
    parents = nodes.select("line_id", F.col("pre").alias("parent"), F.col("name").alias("owner"))
    parts = (
        times.where("name = 'value'")
        .join(parents, ["line_id", "parent"])
        .where(F.col("owner").isin(STEPS))
        .select("trace_id", F.col("owner").alias("item"), "value")
    )
    names = times.where((F.col("name") == "name") & F.col("value").isin(STEPS)).select(
        "line_id", "parent", F.col("value").alias("item")
    )
    steps = (
        times.where("name in ('took', 'ms', 'value')").join(names, ["line_id", "parent"]).select("trace_id", "item", "value")
    )
    found = plain.unionByName(parts).unionByName(steps).where(_filled())
    return _once(found.withColumns({"ord": F.lit(0), "took": _milliseconds()}), "took").withColumnRenamed("took", "ms")


def call_table(nodes: DataFrame) -> DataFrame:
    """``trace_id, ord, item, tokens``: `input` and `output` tokens of each model call of a trace.

    A call is an element of an array at or under `usage`; a `usage` without such an array is one sum, at position 0.
    A value that is missing or null gives no row; the call keeps its position.
    """
    usage = _named(nodes, "usage", "object", "array")
    calls = (
        inside(nodes.where("position is not null and kind = 'object'"), usage, "usage")
        .withColumn("ord", _ordinal())
        .select("line_id", "ord", F.col("pre").alias("_from"), F.col("post").alias("_to"))
    )
    counts = inside(
        nodes.where("name in ('input', 'output') and kind in ('string', 'number') and position is null").where(_filled()),
        usage,
        "usage",
    )
    found = counts.join(calls, "line_id", "left").where(
        F.col("_from").isNull() | ((F.col("_from") < F.col("pre")) & (F.col("post") < F.col("_to")))
    )
    rows = found.select(
        "trace_id", F.coalesce("ord", F.lit(0)).alias("ord"), F.col("name").alias("item"), F.col("value").cast("long").alias("n")
    )
    return _once(rows, "n").withColumnRenamed("n", "tokens")


def research_table(nodes: DataFrame) -> DataFrame:
    """``trace_id, first, outcome``: what the first reply of a trace was, and what became of the search for its gaps.

    Both are texts directly in a `research` object; `first` can be an object with the text as its `status`.
    """
    research = _named(nodes, "research", "object").select("line_id", F.col("pre").alias("parent"), F.lit(True).alias("known"))
    held = nodes.where("name in ('first', 'outcome')").join(research, ["line_id", "parent"])
    status = nodes.where("name = 'status' and kind = 'string'").select(
        "line_id", F.col("parent").alias("pre"), F.col("value").alias("inner")
    )
    found = held.join(status, ["line_id", "pre"], "left").withColumn("item", F.coalesce("inner", "value"))
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("item"))).alias(name)
    return found.groupBy("trace_id").agg(of("first"), of("outcome"))


#: Scalar fields of a trace; fixed values of the log format.
TRACE_FIELDS = [
    "question", "searchedFor", "status", "notCoveredReason", "errorCode", "citations", "droppedCitations",
    "uncitedChars", "model",
]


def trace_table(nodes: DataFrame) -> DataFrame:
    """One row per trace: its scalar fields, from whichever wrapper holds them (the node that has an `ms` or `usage`).

    Lines of one trace tell the same; a field that only some of them have is taken from those.
    """
    owners = nodes.where("name in ('ms', 'usage', 'question') and depth > 0 and parent >= 0").select(
        "line_id", "parent"
    ).distinct()
    fields = (
        nodes.where(F.col("name").isin(TRACE_FIELDS) & F.col("kind").isin("string", "number") & F.col("position").isNull())
        .join(owners, ["line_id", "parent"], "left_semi")
        .groupBy("trace_id")
        .pivot("name", TRACE_FIELDS)
        .agg(F.max("value"))
    )
    first, lines = F.min("line_id").alias("first_line"), F.count_distinct("line_id").alias("lines")
    return nodes.where("depth = 0").groupBy("trace_id").agg(first, lines).join(fields, "trace_id", "left")


def trace_children(nodes: DataFrame) -> DataFrame:
    """All children of all traces in one table: ``trace_id, child, ord, item``."""
    tables = {
        "research.queries": query_table,
        "research.added": added_table,
        "ms": step_table,
        "usage": call_table,
    }
    parts = [
        make(nodes).select("trace_id", F.lit(child).alias("child"), F.col("ord").cast("int").alias("ord"), "item")
        for child, make in tables.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
