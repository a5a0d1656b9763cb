"""Sections of blocks into retrievable chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.words import MAX_CHUNK_CHARS
from folioscope.session import cut_lineage, partitions

#: Blocks of one section that one window task sees; longer sections are spread over several tasks.
SPAN = 4096


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """One row per (section_id, block_ord); rows without either are no blocks."""
    return blocks.where("section_id is not null and block_ord is not null").dropDuplicates(["section_id", "block_ord"])


def carried_last(df: DataFrame, key: str, order: str, values: dict[str, Column], span: int = SPAN) -> DataFrame:
    """Add, per name of ``values``, its last value that isn't null up to and including each row, within ``key``.

    Two steps, so that a key of any size is spread over tasks: the last value of each span of ``order`` is carried over
    the spans (one row each), then within the span.
    """
    spanned = df.withColumn("_span", F.floor(F.col(order) / span))
    latest = {n: F.when(v.isNotNull(), F.struct(F.col(order).alias("at"), v.alias("v"))) for n, v in values.items()}
    before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        spanned.groupBy(key, "_span")
        .agg(*(F.max(v).alias(n) for n, v in latest.items()))
        .select(key, "_span", *(F.max(n).over(before).alias(f"_c_{n}") for n in values))
    )
    upto = Window.partitionBy(key, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        spanned.withColumns({f"_w_{n}": F.max(v).over(upto) for n, v in latest.items()})
        .join(carry, [key, "_span"])
        .withColumns({n: F.coalesce(F.col(f"_w_{n}"), F.col(f"_c_{n}")) for n in values})
        .drop("_span", *(f"_w_{n}" for n in values), *(f"_c_{n}" for n in values))
    )


def with_heading_trail(blocks: DataFrame) -> DataFrame:
    """Blocks with `headings`, the trail each sits under, and `run`, the position of its nearest heading (-1: none).

    A level-1 heading starts a new trail; a level-2 one goes under the latest level-1 heading; any other goes under the
    latest of both.  A level-2 heading before a later level-1 heading is out of reach.
    """
    heading = F.col("kind") == "heading"
    found = carried_last(
        distinct_blocks(blocks),
        "section_id",
        "block_ord",
        {
            "_h1": F.when(heading & (F.col("level") == 1), F.coalesce("text", F.lit(""))),
            "_h2": F.when(heading & (F.col("level") == 2), F.coalesce("text", F.lit(""))),
            "_h": F.when(heading, F.struct("level", F.coalesce("text", F.lit("")).alias("text"))),
        },
    )
    h1, at, level = F.col("_h1.v"), F.col("_h.at"), F.col("_h.v.level")
    h2 = F.when(F.col("_h1").isNull() | (F.col("_h2.at") > F.col("_h1.at")), F.col("_h2.v"))
    trail = (
        F.when(F.col("_h").isNull(), F.array().cast("array<string>"))
        .when(level == 1, F.array("_h.v.text"))
        .when(level == 2, F.array(h1, F.col("_h.v.text")))
        .otherwise(F.array(h1, h2, F.col("_h.v.text")))
    )
    return found.withColumns({"headings": F.array_compact(trail), "run": F.coalesce(at, F.lit(-1))}).drop("_h1", "_h2", "_h")


def paragraph_pieces(trailed: DataFrame, limit: int = MAX_CHUNK_CHARS) -> DataFrame:
    """Rendered paragraphs of blocks with their trail, in pieces within the limit.

    Columns: section_id, run, headings, block_ord, piece_ord, page, piece.
    """
    lines = trailed.where("kind = 'paragraph' and text is not null")
    lines = lines.withColumn("line", T.render_block(F.col("text"), F.col("list_level"), F.col("continued")))
    whole = F.length("line") <= limit
    pieces = F.when(whole, F.array("line")).otherwise(T.split_long(F.when(~whole, F.col("line")), limit))
    return lines.select(
        "section_id", "run", "headings", "block_ord", "page", F.posexplode(pieces).alias("piece_ord", "piece")
    ).where("length(piece) > 0")


PACKED = "section_id string, run int, block_ord int, piece_ord int, page int, chunk_in_run int, piece string"


def _packer(limit: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, number, length = None, 0, 0
        for batch in batches:
            numbers = []
            for section, at, piece in zip(batch["section_id"], batch["run"], batch["piece"], strict=True):
                if (section, at) != run:
                    run, number, length = (section, at), 0, 0
                elif length and length + 1 + len(piece) > limit:
                    number, length = number + 1, 0
                length += len(piece) + (1 if length else 0)
                numbers.append(number)
            yield batch.drop(columns="headings").assign(chunk_in_run=numbers)[[c.split()[0] for c in PACKED.split(", ")]]

    return pack


def chunk_sections(blocks: DataFrame, sections: DataFrame, limit: int = MAX_CHUNK_CHARS) -> DataFrame:
    """Chunks of all sections: chunk_id, section_id, chunk_in_section, section_title, section_path, headings, title, pages.

    Paragraphs are packed in order while the body stays within ``limit``; a heading always starts a new chunk, and a
    chunk without text is none.  The runs between headings are packed as sorted streams that hold one number each, so a
    run of any length needs no memory.  Sections repeated under one section_id are one; blocks without a section and
    sections without a path give no chunks; a null title counts as empty.
    """
    spark = blocks.sparkSession
    trailed = cut_lineage(with_heading_trail(blocks))
    pieces = paragraph_pieces(trailed, limit)
    packed = (
        pieces.select("section_id", "run", "headings", "block_ord", "piece_ord", F.col("page").cast("int"), "piece")
        .repartition(partitions(spark), "section_id", "run")
        .sortWithinPartitions("section_id", "run", "block_ord", "piece_ord")
        .mapInPandas(_packer(limit), PACKED)
    )
    # A chunk holds at most ``limit`` characters, so these groups are small.
    ordered = F.sort_array(F.collect_list(F.struct("block_ord", "piece_ord", F.col("page").alias("page"), F.col("piece").alias("piece"))))
    chunks = cut_lineage(packed.groupBy("section_id", "run", "chunk_in_run").agg(ordered.alias("pieces")))

    def add(pages: Column, piece: Column) -> Column:
        last = F.element_at(pages, -1)
        joined = F.struct(piece["page"].alias("page"), F.concat(last["text"], F.lit("\n"), piece["piece"]).alias("text"))
        fresh = F.struct(piece["page"].alias("page"), piece["piece"].alias("text"))
        same = (F.size(pages) > 0) & last["page"].eqNullSafe(piece["page"])
        return F.when(same, F.concat(F.slice(pages, 1, F.greatest(F.size(pages) - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(pages, F.array(fresh))
        )

    start = F.array().cast("array<struct<page:int,text:string>>")
    # Chunks of a section are numbered through: runs before this one, then chunks of this run.
    runs = chunks.groupBy("section_id", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("section_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first = runs.select("section_id", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    trails = trailed.where("kind = 'heading' and block_ord = run").select("section_id", "run", "headings")
    named = (
        sections.where("section_id is not null and path is not null")
        .dropDuplicates(["section_id"])
        .select("section_id", F.coalesce("title", F.lit("")).alias("section_title"), F.col("path").alias("section_path"))
    )
    headings = F.coalesce("headings", F.array().cast("array<string>"))
    number = (F.col("first") + F.col("chunk_in_run")).cast("int")
    return (
        chunks.join(first, ["section_id", "run"])
        .join(trails, ["section_id", "run"], "left")
        .join(named, "section_id")
        .select(
            F.concat("section_path", F.lit("#"), number.cast("string")).alias("chunk_id"),
            "section_id",
            number.alias("chunk_in_section"),
            "section_title",
            "section_path",
            headings.alias("headings"),
            F.array_join(F.concat(F.array("section_title"), headings), " › ").alias("title"),
            F.aggregate("pieces", start, add).alias("pages"),
        )
    )


def length_statistics(chunks: DataFrame) -> DataFrame:
    """One row: chunks, shortest, median, 90th percentile and longest body, and chunks over several pages.

    Percentiles are the value at position min(n - 1, floor(n * q)) of the sorted lengths.  They are read off the counts
    per length, of which there are few, instead of sorting all chunks.
    """
    lengths = chunks.select(F.length(T.body_text(F.col("pages"))).alias("length"), (F.size("pages") > 1).alias("many"))
    counts = lengths.groupBy("length").agg(F.count("*").alias("n"), F.count_if("many").alias("many"))
    upto = Window.partitionBy(F.lit(0)).orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    running = counts.withColumns({"upto": F.sum("n").over(upto), "total": total})
    at = lambda q: F.min(
        F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.col("total") * q)), F.col("length"))
    )
    return running.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
        F.min("length").alias("shortest"),
        at(0.5).alias("median"),
        at(0.9).alias("p90"),
        F.max("length").alias("longest"),
        F.coalesce(F.sum("many"), F.lit(0)).alias("many_pages"),
    )
