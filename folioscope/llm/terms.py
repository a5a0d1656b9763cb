"""Problem 1: how often every distinct term occurs, and in how many passages.

Each task counts its passages in a burst trie: short prefixes lead to small containers of term suffixes, and a
container that grows past a limit bursts into one container per next byte.  The tries leave the tasks as sorted
(term, occurrences, passages) entries.  Byte prefixes that hold too many entries over all workers are split again, so
that each route holds a bounded share of the vocabulary; matching subtrees of all workers meet at their route and are
merged in term order, as a stream, so that no group is ever held in memory.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage, partitions

TERM = regex.compile(r"[\p{L}\p{N}]+")
FORMAT = regex.compile(r"\p{Cf}+")
#: Terms a container may hold before it bursts.
BURST = 128
#: Terms a task's trie may hold before it is emitted and begun anew; bounds a worker's memory.
FLUSH_TERMS = 400_000
#: A prefix with more than this share of all entries, and more than so many, is split by one more byte.
ROUTE_SHARE = 1 / 512
ROUTE_ENTRIES = 10_000
ENTRY = "term string, occurrences long, passages long"


def terms_of(text: str) -> list[str]:
    """Longest runs of letters and digits after NFKC, removal of format characters and lower-casing."""
    if not text.isascii():
        text = FORMAT.sub("", unicodedata.normalize("NFKC", text))
    return TERM.findall(text.lower())


class BurstTrie:
    """Occurrence and passage counters under adaptive byte prefixes.

    An inner node maps the next byte to a child; a leaf is a dict from the remaining suffix to its two counters.
    A leaf with more than ``burst`` suffixes becomes an inner node, so frequent prefixes get deeper paths.
    """

    class Inner:
        __slots__ = ("children", "end")

        def __init__(self) -> None:
            self.children: dict[int, BurstTrie.Inner | dict[bytes, list[int]]] = {}
            self.end: list[int] | None = None

    def __init__(self, burst: int = BURST) -> None:
        self.burst, self.size, self.root = burst, 0, BurstTrie.Inner()

    def add(self, term: bytes, occurrences: int, passages: int) -> None:
        node, at, last = self.root, 0, len(term)
        while at < last:
            child = node.children.get(term[at])
            if child is None:
                child = node.children[term[at]] = {}
            at += 1
            if isinstance(child, dict):
                suffix = term[at:]
                counters = child.get(suffix)
                if counters is not None:
                    counters[0] += occurrences
                    counters[1] += passages
                    return
                child[suffix] = [occurrences, passages]
                self.size += 1
                if len(child) > self.burst:
                    node.children[term[at - 1]] = self.split(child)
                return
            node = child
        if node.end is None:
            node.end = [0, 0]
            self.size += 1
        node.end[0] += occurrences
        node.end[1] += passages

    def split(self, leaf: dict[bytes, list[int]]) -> BurstTrie.Inner:
        inner = BurstTrie.Inner()
        for suffix, counters in leaf.items():
            if not suffix:
                inner.end = counters
            else:
                inner.children.setdefault(suffix[0], {})[suffix[1:]] = counters
        for byte, child in inner.children.items():
            if len(child) > self.burst:
                inner.children[byte] = self.split(child)
        return inner

    def entries(self) -> Iterator[tuple[bytes, int, int]]:
        """All terms in byte order."""
        stack: list[tuple[bytes, BurstTrie.Inner | dict[bytes, list[int]]]] = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            if isinstance(node, dict):
                for suffix in sorted(node):
                    yield prefix + suffix, *node[suffix]
                continue
            if node.end is not None:
                yield prefix, *node.end
            stack += [(prefix + bytes([byte]), node.children[byte]) for byte in sorted(node.children, reverse=True)]


def _emit(trie: BurstTrie) -> pd.DataFrame:
    terms, occurrences, passages = zip(*trie.entries(), strict=True)
    return pd.DataFrame({"term": [t.decode() for t in terms], "occurrences": occurrences, "passages": passages})


def _count_passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    encoded = lru_cache(100_000)(str.encode)
    trie = BurstTrie()
    for batch in batches:
        for body in batch["body"]:
            counts: dict[str, int] = {}
            for term in terms_of(body):
                counts[term] = counts.get(term, 0) + 1
            for term, n in counts.items():
                trie.add(encoded(term), n, 1)
            if trie.size > FLUSH_TERMS:
                yield _emit(trie)
                trie = BurstTrie()
    if trie.size:
        yield _emit(trie)


def _merge_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add up equal neighbours of a sorted stream; only the last term of a batch is carried on."""
    carry: pd.DataFrame | None = None
    for batch in batches:
        if carry is not None:
            batch = pd.concat([carry, batch], ignore_index=True)
        merged = batch.groupby("term", sort=False, as_index=False)[["occurrences", "passages"]].sum()
        carry = merged.iloc[-1:]
        if len(merged) > 1:
            yield merged.iloc[:-1]
    if carry is not None:
        yield carry


def _prefix(column: str, length: int):
    return F.substring(F.encode(F.col(column), "UTF-8"), 1, length)


def _hot_prefixes(entries: DataFrame) -> list[list[bytes]]:
    """Per length, the prefixes whose entries exceed their share and are split by one more byte.

    At most 1 / ROUTE_SHARE prefixes of a length can exceed it, and only their children are counted at the next
    length, so the driver never sees more than 256 / ROUTE_SHARE counters, whatever the vocabulary.  Splitting goes on
    until no prefix exceeds its share, or the terms end.
    """
    levels: list[list[bytes]] = []
    total, hot = 0, [b""]
    while hot:
        length = len(levels) + 1
        of = entries.where(F.octet_length("term") >= length)
        of = of.where(_prefix("term", length - 1).isin(levels[-1])) if levels else of
        counts = of.groupBy(_prefix("term", length).alias("prefix")).count().collect()
        total = total or sum(r["count"] for r in counts)
        hot = [bytes(r["prefix"]) for r in counts if r["count"] > max(total * ROUTE_SHARE, ROUTE_ENTRIES)]
        if hot:
            levels.append(hot)
    return levels


def term_frequencies(passages: DataFrame, id_column: str = "chunk_id", text_column: str = "body") -> DataFrame:
    """One row per distinct term: ``term, occurrences, passages`` over the distinct passages of ``passages``.

    Rows repeating an id are one passage (all rows of one id are equal); rows without an id are no passages.
    A null or empty text has no terms.  Any other column is ignored.  An empty table gives no rows.
    """
    spark = passages.sparkSession
    bodies = (
        passages.select(F.col(id_column).alias("id"), F.col(text_column).alias("body"))
        .where(F.col("id").isNotNull() & F.col("body").isNotNull())
        .dropDuplicates(["id"])
        .select("body")
    )
    entries = cut_lineage(bodies.mapInPandas(_count_passages, ENTRY))
    route = _prefix("term", 1)
    for length, hot in enumerate(_hot_prefixes(entries), start=1):
        route = F.when(_prefix("term", length).isin(hot), _prefix("term", length + 1)).otherwise(route)
    return (
        entries.withColumn("route", route)
        .repartition(partitions(spark), "route")
        .sortWithinPartitions("route", "term")
        .select("term", "occurrences", "passages")
        .mapInPandas(_merge_sorted, ENTRY)
    )


def marked_terms(
    passages: DataFrame,
    id_column: str = "chunk_id",
    text_column: str = "body",
    rare_at_most: int = 2,
    common_above: float = 0.2,
) -> DataFrame:
    """``term, occurrences, passages, mark``: mark is `rare` in at most ``rare_at_most`` passages, `common` in more
    than the share ``common_above`` of all passages (those without a text included), else null.

    A term that is both (in a collection of a few passages) is `common` only if it isn't rare.
    """
    total = passages.select(F.col(id_column).alias("id")).where("id is not null").agg(F.count_distinct("id").alias("n"))
    n = total.first()["n"]
    return term_frequencies(passages, id_column, text_column).withColumn(
        "mark",
        F.when(F.col("passages") <= rare_at_most, "rare").when(F.col("passages") > common_above * n, "common"),
    )
