"""Problem 2: texts that stop before their end, found by a backward character n-gram model.

For a context (the last characters read, backwards from a position) the model holds how often the text ended there, how
often a sentence or list item was complete there, how often only its final stop was still to come, and how often the
text went on inside a sentence, list item, word or marker.  The contexts that matter are those at the ends of the texts;
every position of every text is counted for them.  Longer contexts are mixed with shorter ones by how often they were
seen, and a text's own end is left out of the counts it is held against.

The odds that a text was cut compare going on with ending, times the hazard of a cut at its length: one rate per writer
(a source, the language a text is judged to have, and what is put after a text) for cuts anywhere (a transfer that broke off), and the excess of texts at a length over the lengths around it (a field
limit, in characters or bytes).  Both, and the habit of a source to leave out the last stop, are estimated from all
rows by repeated reweighting.  The threshold on the log-odds is thereby set per source and language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

ORDERS = (1, 3, 5, 8, 12, 18)
#: Weight of the shorter context, in observations.
BACKOFF = 2.0
#: Ends per visit of a context that cut texts alone can leave there; so many are not taken for true ends.
STRAY_ENDS = 1e-3
#: Texts up to this length are held against whole short texts by their shape, too.
SHORT = 32
#: Slots of the filter per final context, and the least and most bits of its slots' number: the driver and each task hold
#: 1 to 32 MB.  With more than 33 million contexts more of the corpus is counted than is needed; the counts stay exact.
FILTER_SLOTS = 8
FILTER_BITS, MOST_FILTER_BITS = 23, 28
#: Contexts a task counts before it emits them; bounds its memory.
FLUSH = 2_000_000
START = 2
#: Put after a cut by some writers; the context is what stands before.
MARKERS = regex.compile(
    r"(?:[\s\u200b]|…|\.\.\.|[\[(](?:more|cont\.?|continued|cut|truncated|abridged|snip|\.\.\.|…)[\])]|(?:read|see) more)+\Z",
    regex.IGNORECASE,
)
MIX = np.random.default_rng(11).integers(1, 2**63, ORDERS[-1], dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
# Frequent words by which a text's language is judged.
FREQUENT = {
    "en": "the and of to in is that for with are this you not be have it on as your can".split(),
    "de": "der die das und ist nicht mit den von zu ein eine für auf wird im sich auch werden sie".split(),
    "fr": "le la les des et est une dans pour que qui pas sur vous avec sont au ce du ne".split(),
    "es": "el los las que de una por para con es se del no su al lo como más están pero".split(),
}
WORD = regex.compile(r"\p{L}+")
LOWER, UPPER, DIGIT, SPACE, FINAL, OTHER = 1, 2, 3, 4, 5, 6
END, BREAK, STOP, GO = range(4)


@lru_cache(1)
def _classes() -> np.ndarray:
    """A class per character of the basic plane, and FINAL (pictures mostly) for all above."""
    table = np.full(0x10001, OTHER, np.uint8)
    for code in range(0x10000):
        kind = unicodedata.category(chr(code))
        if kind[0] == "Z" or code in (9, 10, 13):
            table[code] = SPACE
        elif kind == "Lu":
            table[code] = UPPER
        elif kind[0] in "LM":
            table[code] = LOWER
        elif kind[0] == "N":
            table[code] = DIGIT
    for character in ".!?…:\"”’»)]*🙂":
        table[min(ord(character), 0x10000)] = FINAL
    table[0x2600:0x27C0] = FINAL
    return table


def bare_end(text: str) -> str:
    """The text without white space and marks of a cut at its end."""
    return _parts(text)[0]


def _parts(text: str) -> tuple[str, str]:
    match = MARKERS.search(text)
    if match and match.start():
        return text[: match.start()], "".join(match.group().lower().split())
    return text.rstrip() or text, ""


def language(text: str, default: str = "en") -> str:
    """The language most of whose frequent words stand in the text; the default where two or none do."""
    words = WORD.findall(text.lower())
    counts = {name: sum(w in known for w in words) for name, known in _frequent().items()}
    best = max(counts.values())
    first = [name for name, n in counts.items() if n == best]
    return first[0] if best and len(first) == 1 else default


@lru_cache(1)
def _frequent() -> dict[str, frozenset[str]]:
    return {name: frozenset(words) for name, words in FREQUENT.items()}


def _hash(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def _encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array of characters, each after ORDERS[-1] start marks; first and last position of each."""
    lead = ORDERS[-1]
    mark = chr(START) * lead
    codes = np.frombuffer((mark + mark.join(texts) + mark).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(lengths + lead) - lengths
    return codes, first, first + lengths - 1


def _context_keys(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The keys of the contexts that end at the positions ``at``, one row per order."""
    keys = np.empty((len(ORDERS), len(at)), np.uint64)
    total = np.zeros(len(at), np.uint64)
    for back in range(ORDERS[-1]):
        total += codes[at - back].astype(np.uint64) * MIX[back]
        if back + 1 in ORDERS:
            keys[ORDERS.index(back + 1)] = _hash(total + np.uint64(back))
    return keys


def _shape_keys(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions among the first SHORT of each text, and the key of the character classes from the start to there."""
    classes = _classes()
    places, keys = [], []
    shape = np.zeros(len(first), np.uint64)
    before = np.zeros(len(first), np.uint8)
    for step in range(SHORT):
        at = first + step
        there = at <= last
        now = classes[np.minimum(codes[np.minimum(at, last)], 0x10000)]
        shape = np.where(now != before, shape * np.uint64(31) + now.astype(np.uint64), shape)
        before = now
        places.append(at[there])
        keys.append(_hash(shape[there] + np.uint64(1 << 40)))
    return np.concatenate(places), np.concatenate(keys)


def _outcomes(codes: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What followed each position: the end, a complete unit's break, the final stop, or more of the unit."""
    padded = np.concatenate([codes, np.full(2, START, codes.dtype)])
    here, following, second = padded[at], padded[at + 1], padded[at + 2]
    kind = _classes()[np.minimum(np.stack([here, following, second]), 0x10000)]
    word = np.isin(kind[2], (LOWER, UPPER, DIGIT))
    final = (kind[0] == FINAL) & (here != ord(":")) & (here != ord("*"))
    newline = following == 10
    breaks = newline | (final & (kind[1] == SPACE) & (kind[2] != LOWER)) | (final & (following == ord("[")))
    mark = np.isin(following, [ord(c) for c in ".!?…"]) & ~word
    cited = (following == ord("[")) & (kind[2] == DIGIT)
    outcome = np.where(breaks, BREAK, np.where(mark | cited, STOP, GO)).astype(np.int8)
    ends = np.zeros(len(codes), bool)
    ends[last] = True
    outcome[ends[at]] = END
    return outcome


def _final_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if not len(batch):
            continue
        texts, marks = zip(*map(_parts, batch["text"]), strict=True)
        codes, first, last = _encode(texts)
        keys = _context_keys(codes, last).view(np.int64).T
        places, shapes = _shape_keys(codes, first, last)
        shape_at = pd.Series(shapes.view(np.int64), index=places)
        short = last - first < SHORT
        contexts = [
            # A whole short text has its shape below its longest context, others their shorter contexts.
            np.array([shape_at[last[i]], *([0] * (len(ORDERS) - 2)), keys[i][-1]]) if short[i] else keys[i]
            for i in range(len(texts))
        ]
        yield pd.DataFrame(
            {
                "id": batch["id"],
                "source": batch["source"],
                "writer": [f"{s} {language(t)} {m[:12]}" for s, t, m in zip(batch["source"], texts, marks, strict=True)],
                "characters": [len(t) for t in texts],
                "bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
                "contexts": contexts,
            }
        )


def _counter(bits: np.ndarray):
    shift = np.uint64(64 - 6 - (len(bits) - 1).bit_length())

    def wanted(keys: np.ndarray) -> np.ndarray:
        slot = keys >> shift
        return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            # A few hundred texts at once, so that the arrays stay small however long the texts are.
            group: list[str] = []
            for i, text in enumerate(batch["text"]):
                group.append(bare_end(text))
                if i + 1 < len(batch) and sum(map(len, group[-64:])) < 200_000 and len(group) < 512:
                    continue
                codes, first, last = _encode(group)
                group = []
                at = np.flatnonzero(codes != START)
                keys, places = [k for k in _context_keys(codes, at)], [at] * len(ORDERS)
                shape_places, shapes = _shape_keys(codes, first, last)
                # A short text's end says nothing about the ends of long ones: it counts for whole short texts only.
                inner = ~np.isin(at, last[last - first < SHORT])
                keys = [*(k[inner] for k in keys[:-1]), keys[-1], shapes]
                places = [*(p[inner] for p in places[:-1]), places[-1], shape_places]
                keys, places = np.concatenate(keys), np.concatenate(places)
                keep = wanted(keys)
                keys, outcome = keys[keep], _outcomes(codes, last, places[keep])
                unique, inverse = np.unique(keys, return_inverse=True)
                table = np.zeros((len(unique), 4), np.int64)
                np.add.at(table, (inverse, outcome), 1)
                held.append(pd.DataFrame(table, index=unique.view(np.int64), columns=["ends", "breaks", "stops", "goes"]))
                size += len(unique)
                if size > FLUSH:
                    merged = pd.concat(held).groupby(level=0).sum()
                    held, size = [merged], len(merged)
                    if size > FLUSH // 2:
                        yield merged.rename_axis("key").reset_index()
                        held, size = [], 0
        if held:
            yield pd.concat(held).groupby(level=0).sum().rename_axis("key").reset_index()

    return count


def _filter_of(finals: DataFrame) -> np.ndarray:
    """The bits of all final contexts, in 64-bit words, of which at most 2 ** (MOST_FILTER_BITS - 6) reach the driver."""
    contexts = finals.select(F.explode("contexts").alias("key"))
    n = contexts.agg(F.approx_count_distinct("key")).first()[0]
    size = min(MOST_FILTER_BITS, max(FILTER_BITS, (FILTER_SLOTS * n).bit_length()))
    slot = F.shiftrightunsigned("key", 64 - size)
    rows = (
        contexts.groupBy(F.shiftright(slot, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - size}) & 63 as int))")).alias("bits"))
        .toPandas()
    )
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def _probabilities(finals: DataFrame, counts: DataFrame) -> DataFrame:
    """Per distinct tail: the chance of each outcome there, its own end left out, longer contexts over shorter ones."""
    tails = finals.select("contexts").distinct()
    each = tails.select("contexts", F.posexplode("contexts").alias("order", "key"))
    # The last character alone is shared by most tails, and so would be a hot key; there are as many of these contexts as
    # characters at most, so they are sent to all tasks.  Short texts have their shape there, and no key (0) in the next
    # places.  Of the other contexts AQE splits those that are hot.
    is_character, is_none = (F.col("order") == 0) & (F.get("contexts", F.lit(1)) != 0), F.col("key") == 0
    few = counts.join(each.where(is_character).select("key").distinct(), "key", "left_semi")
    empty = [F.lit(None).cast("long").alias(c) for c in ("ends", "breaks", "stops", "goes")]
    each = (
        each.where(is_character).join(F.broadcast(few), "key", "left")
        .unionByName(each.where(~is_character & ~is_none).join(counts, "key", "left"))
        .unionByName(each.where(is_none).select("*", *empty))
    )
    seen = each.groupBy("contexts").agg(
        F.sort_array(
            F.collect_list(
                F.struct("order", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("ends", "breaks", "stops", "goes")))
            )
        ).alias("seen")
    )
    start = F.struct(F.lit(0.05).alias("e"), F.lit(0.05).alias("b"), F.lit(0.1).alias("s"), F.lit(0.8).alias("g"))

    def step(p: Column, c: Column) -> Column:
        expected = STRAY_ENDS * (c["breaks"] + c["stops"] + c["goes"])
        stray = 1 + expected + 2 * F.sqrt(expected)
        ends = F.greatest(c["ends"] - stray, F.lit(0.0))
        total = ends + c["breaks"] + c["stops"] + c["goes"] + BACKOFF
        return F.struct(
            ((ends + BACKOFF * p["e"]) / total).alias("e"),
            ((c["breaks"] + BACKOFF * p["b"]) / total).alias("b"),
            ((c["stops"] + BACKOFF * p["s"]) / total).alias("s"),
            ((c["goes"] + BACKOFF * p["g"]) / total).alias("g"),
        )

    return seen.select("contexts", F.aggregate("seen", start, step).alias("p")).select("contexts", "p.*")


def _limit_hazard(finals: DataFrame, measure: str) -> DataFrame:
    """Per writer and length: the share of the texts reaching a length that end there beyond what is usual.

    Taken at the very length, and over the lengths next to it, since writers cut back to a word or a whole character.
    """
    histogram = finals.groupBy("writer", F.col(measure).alias("length")).count()
    by_length = Window.partitionBy("writer").orderBy("length")
    n = lambda low, high: F.coalesce(F.sum("count").over(by_length.rangeBetween(low, high)), F.lit(0))
    usual = (n(-48, -9) + n(9, 48)) / 80.0 + 0.1
    reaching = n(0, Window.unboundedFollowing)
    at = F.greatest(F.col("count") - 2 * usual - 3, F.lit(0.0)) / reaching
    near = F.greatest(n(-6, 6) - 26 * usual - 5, F.lit(0.0)) / (n(-6, Window.unboundedFollowing) * 13)
    return histogram.select("writer", F.col("length").alias(measure), F.greatest(at, near).alias(f"limit_{measure}"))


def cut_texts(
    values: DataFrame, id_column: str, text_column: str, source: str | Column, rounds: int = 4
) -> DataFrame:
    """``id, source, characters, log_odds, is_cut`` per distinct id with a text; log_odds above 0 mean cut.

    A text is cut if it stops inside a sentence, list item, word or citation marker, whether or not a mark was put
    after the cut.  Null, empty and blank texts have no end to judge and give no row, as have rows without an id; rows
    repeating an id count once.  A null source is a source of its own.
    """
    spark = values.sparkSession
    source = F.col(source) if isinstance(source, str) else source
    rows = cut_lineage(
        values.select(F.col(id_column).alias("id"), F.coalesce(source, F.lit("")).alias("source"), F.col(text_column).alias("text"))
        .where(F.col("id").isNotNull() & F.col("text").rlike(r"\S"))
        .dropDuplicates(["id"])
    )
    id_type = rows.schema["id"].dataType.simpleString()
    finals = cut_lineage(
        rows.mapInPandas(
            _final_rows, f"id {id_type}, source string, writer string, characters int, bytes int, contexts array<bigint>"
        )
    )
    bits = _filter_of(finals)
    counts = cut_lineage(
        rows.select("text")
        .mapInPandas(_counter(bits), "key long, ends long, breaks long, stops long, goes long")
        .groupBy("key")
        .agg(*(F.sum(c).alias(c) for c in ("ends", "breaks", "stops", "goes")))
    )
    judged = cut_lineage(
        finals.join(_probabilities(finals, counts), "contexts")
        .drop("contexts")
        .join(_limit_hazard(finals, "characters"), ["writer", "characters"])
        .join(_limit_hazard(finals, "bytes"), ["writer", "bytes"])
        .withColumn("limit", F.greatest("limit_characters", "limit_bytes"))
    )
    # Per writer: the rate of cuts per character and the share of dropped final stops, from all rows.
    rates = judged.select("writer").distinct().withColumns({"rate": F.lit(1 / 5000), "drops": F.lit(0.02)})
    hazard = F.col("rate") + F.col("limit")
    cut = hazard * (F.col("g") + F.col("s"))
    dropped = F.col("drops") * F.col("s")
    whole = F.col("e") + dropped + hazard * F.col("b")
    for _ in range(rounds):
        share = cut / (cut + whole)
        free = F.col("rate") / hazard
        rates = cut_lineage(
            judged.join(rates, "writer")
            .groupBy("writer")
            .agg(
                ((F.sum(share * free) + 0.05) / (F.sum("characters") + 1000)).alias("rate"),
                (
                    (F.sum((1 - share) * dropped / whole) + 0.02)
                    / (F.sum((1 - share) * F.greatest(dropped / whole, F.when(F.col("b") > 0.2, 1.0).otherwise(0.0))) + 1)
                ).alias("drops"),
            )
        )
    odds = F.log(cut / whole)
    return judged.join(rates, "writer").select(
        "id", F.nullif(F.col("source"), F.lit("")).alias("source"), "characters", odds.alias("log_odds"), (odds > 0).alias("is_cut")
    )


def cut_report(judged: DataFrame) -> DataFrame:
    """Per source: its texts, how many are cut, and their share."""
    return judged.groupBy("source").agg(
        F.count("*").alias("texts"),
        F.count_if("is_cut").alias("cut_texts"),
        F.round(F.count_if("is_cut") / F.count("*"), 6).alias("cut_share"),
    )
