"""Problem 7: draw a mixture in which every source has its target share of all tokens.

Systematic sampling.  Within a source every text has the same expected number of copies.  Texts are laid end to end in
the order of their sizes, each as long as its expected copies; one random offset is added, and a text is emitted once
per integer boundary that falls into its stretch.  Every size is so drawn in proportion, and the tokens drawn differ
from the target by little more than one of the longest texts.  In a source where that is more than NEAR_ENOUGH, further
offsets are tried.

The prefix sums are taken in two steps, so that a source with any share of all rows is spread over many tasks: counts
per (source, size step, salt), whose number doesn't grow with the rows, then ranks within each such bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

#: Rows of a bucket, about; more rows of one source and size step get more salts.
BUCKET_ROWS = 50_000
#: Size steps per doubling of the size.
STEPS_PER_DOUBLING = 8
#: A draw this near to its target, in proportion, is kept; random offsets that are tried where the first isn't.
NEAR_ENOUGH = 0.01
OFFSETS = 32


def plain_source(source: str | Column) -> Column:
    """One spelling of a source: trimmed, lower case, words joined by `_`; null if nothing is left."""
    column = F.col(source) if isinstance(source, str) else source
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(column, r"[\s\x{a0}]+", " "))), r"[\s\-_]+", "_")
    return F.when(F.length(plain) > 0, plain)


def distinct_texts(sized: DataFrame) -> DataFrame:
    """One row per distinct text: of the given documents that with the lowest doc_id stands for its copies."""
    return (
        sized.where("doc_id is not null and tokens > 0")
        .groupBy("text_key")
        .agg(F.min(F.struct("doc_id", "source", "tokens")).alias("first"))
        .select("first.*")
    )


def _wanted(targets: DataFrame) -> DataFrame:
    return (
        targets.select(
            plain_source("source").alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")
        )
        .where("source is not null and target_share > 0 and max_repeats > 0")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )


def source_plan(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: target_share, max_repeats, texts, tokens available, wanted tokens and expected copies.

    Without ``total_tokens`` the mixture is as large as it can be with every source that has texts at its share (shares
    of sources without texts are spread over the others in proportion).  With a larger total, a source gives what its
    ``max_repeats`` allow, and the shares reached differ from the targets.
    """
    wanted = _wanted(targets)
    there = texts.groupBy("source").agg(F.count("*").alias("texts"), F.sum("tokens").alias("available"))
    everything = Window.partitionBy(F.lit(0))  # one row per target source
    share = F.col("target_share") / F.sum(F.when(F.col("available") > 0, F.col("target_share"))).over(everything)
    feasible = F.when(F.col("available") > 0, F.col("max_repeats") * F.col("available") / F.col("share"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.floor(F.min("feasible").over(everything))
    return (
        wanted.join(there, "source", "left")
        .fillna(0, ["texts", "available"])
        .withColumn("share", F.when(F.col("available") > 0, share).otherwise(0.0))
        .withColumn("feasible", feasible)
        .withColumn("wanted", F.coalesce(F.col("share") * total, F.lit(0.0)))
        .withColumn(
            "expected",
            F.when(
                F.col("available") > 0,
                F.least(F.col("wanted") / F.col("available"), F.col("max_repeats").cast("double")),
            ).otherwise(0.0),
        )
        .drop("feasible")
    )


def _offset(i: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("source", F.lit(seed), F.lit(i)), F.lit(1_000_000)) / 1_000_000


def _copies(offset: Column) -> Column:
    """Integer boundaries within the text's stretch, which ends at ``end * expected`` plus the offset."""
    boundaries = F.floor(F.col("end") * F.col("expected") + offset) - F.floor(
        (F.col("end") - 1) * F.col("expected") + offset
    )
    return F.least(boundaries, F.col("max_repeats"))


def mixture(
    sized: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    seed: int = 20_240_601,
    bucket_rows: int = BUCKET_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The mixture, one row per text drawn (source, doc_id, tokens, copies), and the plan per source.

    ``sized`` has doc_id, source, text_key (equal for equal texts) and tokens.  No text is drawn more than its source's
    max_repeats times; copies of a text under other doc_ids count as that text, which belongs to the source of its lowest
    doc_id among those in sources with a target.  Texts without tokens, rows without a
    doc_id, and sources without a target are left out; sources without texts contribute nothing.  An empty table gives
    an empty mixture.
    """
    texts = cut_lineage(
        distinct_texts(
            sized.select("doc_id", plain_source("source").alias("source"), "text_key", "tokens").join(
                _wanted(targets).select("source"), "source", "left_semi"
            )
        )
    )
    plan = cut_lineage(source_plan(texts, targets, total_tokens))
    few = F.broadcast(plan.select("source", "expected", "max_repeats"))  # as many rows as target sources
    step = F.floor(F.log2(F.col("tokens").cast("double")) * STEPS_PER_DOUBLING).cast("int")
    drawn_from = texts.join(few, "source").withColumn("step", step)
    # Salts per size step, then the count of each bucket: both have at most (sources x size steps x salts) rows.
    salts = drawn_from.groupBy("source", "step").agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("salts"))
    salted = drawn_from.join(salts, ["source", "step"]).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")
    )
    counts = salted.groupBy("source", "step", "salt").count()
    before = Window.partitionBy("source").orderBy("step", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "source", "step", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("source", "step", "salt").orderBy("tokens", F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    laid = cut_lineage(
        salted.join(offsets, ["source", "step", "salt"])
        .withColumn("end", F.col("before") + F.row_number().over(within))
        .select("source", "doc_id", "tokens", "expected", "max_repeats", "end")
    )
    # A source draws one random offset.  Where a few long texts lead that draw away from the target, the offset of
    # OFFSETS random ones that comes closest is taken.
    drawn_tokens = laid.groupBy("source").agg(
        *(F.sum(F.col("tokens") * _copies(_offset(i, seed))).alias(f"drawn_{i}") for i in range(OFFSETS))
    )
    choices = F.array(
        *(
            F.struct(F.abs(F.col(f"drawn_{i}") - F.col("wanted")).alias("error"), _offset(i, seed).alias("offset"))
            for i in range(OFFSETS)
        )
    )
    near = F.abs(F.col("drawn_0") - F.col("wanted")) <= NEAR_ENOUGH * F.col("wanted")
    best = drawn_tokens.join(plan.select("source", "wanted"), "source").select(
        "source", F.when(near, _offset(0, seed)).otherwise(F.array_min(choices)["offset"]).alias("offset")
    )
    drawn = (
        laid.join(F.broadcast(best), "source")  # as many rows as target sources
        .withColumn("copies", _copies(F.col("offset")).cast("int"))
        .where("copies > 0")
        .select("source", "doc_id", "tokens", "copies")
    )
    return drawn, plan


def share_report(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target source: its target and actual share of the tokens drawn, and how often its texts were used."""
    used = drawn.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"),
        F.count("*").alias("texts_used"),
        F.sum("copies").alias("copies_used"),
        F.max("copies").alias("most_repeats"),
    )
    total = F.sum("tokens_used").over(Window.partitionBy(F.lit(0)))
    return (
        plan.join(used, "source", "left")
        .fillna(0, ["tokens_used", "texts_used", "copies_used", "most_repeats"])
        .select(
            "source",
            F.round("target_share", 6).alias("target_share"),
            F.round(F.coalesce(F.try_divide(F.col("tokens_used"), total), F.lit(0.0)), 6).alias("actual_share"),
            "max_repeats",
            "most_repeats",
            "texts",
            "texts_used",
            "copies_used",
            F.col("available").alias("tokens_available"),
            "tokens_used",
        )
    )
