"""The queries of this package's problems over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import cut_lineage
from folioscope.sources.tables import table

from . import mixing, neighbours, packing, privacy, splitting, terms, tokens, truncation

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    marked = terms.marked_terms(table(spark, directory, "keyword_index"))
    return marked.where(F.col("mark").isNotNull()).select("term", "mark")


def p1_term_frequencies(spark: SparkSession, directory: str) -> DataFrame:
    return terms.marked_terms(table(spark, directory, "keyword_index"))


def _judged_answers(spark: SparkSession, directory: str) -> DataFrame:
    answered = table(spark, directory, "answer_eval").where("status = 'answered'")
    return truncation.cut_texts(answered, "row_id", "answer", mixing.plain_source("source"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return _judged_answers(spark, directory).where("is_cut").select(F.col("id").alias("row_id"))


def p2_cut_report(spark: SparkSession, directory: str) -> DataFrame:
    """Per source the share of its answered rows that are cut; rows without a text are answered rows, too."""
    answered = table(spark, directory, "answer_eval").where("status = 'answered' and row_id is not null")
    rows = answered.select("row_id", mixing.plain_source("source").alias("source")).dropDuplicates(["row_id"])
    cut = truncation.cut_report(_judged_answers(spark, directory)).select("source", "cut_texts")
    per = rows.groupBy("source").agg(F.count("*").alias("answered_rows"))
    return per.join(cut.withColumnRenamed("source", "of"), per["source"].eqNullSafe(F.col("of")), "left").select(
        "source",
        "answered_rows",
        F.coalesce("cut_texts", F.lit(0)).alias("cut_rows"),
        F.round(F.coalesce("cut_texts", F.lit(0)) / F.col("answered_rows"), 6).alias("cut_share"),
    )


def _pieces(spark: SparkSession, directory: str) -> DataFrame:
    blocks = table(spark, directory, "blocks").select(
        F.lit("block").alias("item_kind"),
        F.col("section_id").alias("item_id"),
        F.col("block_ord").cast("int").alias("item_ord"),
        "text",
    )
    pages = table(spark, directory, "chunks").select("chunk_id", F.explode("pages").alias("page"))
    pages = pages.select(
        F.lit("page").alias("item_kind"),
        F.col("chunk_id").alias("item_id"),
        F.col("page.page").cast("int").alias("item_ord"),
        F.col("page.text").alias("text"),
    )
    items = blocks.unionByName(pages).where(splitting.oversized("text"))
    return splitting.split_long_texts(items, ["item_kind", "item_id", "item_ord"])


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    # The second piece exists exactly for the texts that had to be cut.
    return _pieces(spark, directory).where("piece_ord = 1").select("item_kind", "item_id", "item_ord", "unbroken")


def p3_pieces(spark: SparkSession, directory: str) -> DataFrame:
    return _pieces(spark, directory)


def p3_rejoined(spark: SparkSession, directory: str) -> DataFrame:
    """Per cut text a checksum of its pieces joined without their overlaps, and whether all of them are within the limit."""
    keys = ["item_kind", "item_id", "item_ord"]
    own = F.struct("piece_ord", F.expr("substring(piece, overlap + 1)").alias("own"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(own)), lambda x: x["own"]), "")
    return _pieces(spark, directory).groupBy(*keys).agg(
        F.sha2(whole, 256).alias("sha256"), (F.max(F.length("piece")) <= 1000).alias("within_limit")
    )


def p4_nearest(spark: SparkSession, directory: str) -> DataFrame:
    return neighbours.nearest(table(spark, directory, "vectors"))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    pairs = neighbours.similar_pairs(p4_nearest(spark, directory))
    return pairs.select(F.col("a").cast("int").alias("chunk_ord_a"), F.col("b").cast("int").alias("chunk_ord_b"))


def _sized(spark: SparkSession, directory: str, *columns) -> DataFrame:
    documents = table(spark, directory, "documents").select("doc_id", *columns, "text")
    return tokens.with_token_counts(documents)


def p6_containers(spark: SparkSession, directory: str) -> DataFrame:
    return packing.fill_containers(_sized(spark, directory), table(spark, directory, "context_windows"))


def p6_packing_report(spark: SparkSession, directory: str) -> DataFrame:
    return packing.packing_report(p6_containers(spark, directory))


def _mixture(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    sized = _sized(spark, directory, "source", F.sha2(F.col("text"), 256).alias("text_key"))
    return mixing.mixture(sized, table(spark, directory, "mix_targets"))


def p6_placed(spark: SparkSession, directory: str) -> DataFrame:
    """Per window: the documents placed, those in parts though no longer than a container, and containers over capacity."""
    assigned = cut_lineage(p6_containers(spark, directory))
    per = assigned.groupBy("window_id", "capacity", "doc_id").agg(F.count("*").alias("parts"), F.sum("tokens").alias("tokens"))
    torn = (F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity"))
    placed = per.groupBy("window_id", "capacity").agg(F.count("*").alias("documents"), F.count_if(torn).alias("torn"))
    full = assigned.groupBy("window_id", "container").agg(F.sum("tokens").alias("tokens"), F.max("capacity").alias("capacity"))
    over = full.groupBy("window_id").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"))
    return placed.join(over, "window_id")


def p7_kept(spark: SparkSession, directory: str) -> DataFrame:
    """Per target source: the texts used more than max_repeats times, and the texts drawn under two doc_ids."""
    drawn, plan = _mixture(spark, directory)
    drawn = cut_lineage(drawn)
    keys = table(spark, directory, "documents").select("doc_id", F.sha2("text", 256).alias("text_key")).dropDuplicates(["doc_id"])
    over = drawn.join(plan.select("source", "max_repeats"), "source").where(F.col("copies") > F.col("max_repeats")).groupBy("source").count()
    twice = drawn.join(keys, "doc_id").groupBy("source", "text_key").count().where("count > 1").groupBy("source").count()
    return (
        plan.select("source", "max_repeats")
        .join(over.select("source", F.col("count").alias("over_repeated")), "source", "left")
        .join(twice.select("source", F.col("count").alias("repeated_texts")), "source", "left")
        .fillna(0, ["over_repeated", "repeated_texts"])
    )


def p7_mixture(spark: SparkSession, directory: str) -> DataFrame:
    """One row per copy, so that the result is the mixture itself."""
    drawn, _ = _mixture(spark, directory)
    copies = F.explode(F.sequence(F.lit(1), "copies")).alias("copy")
    return drawn.select("source", "doc_id", "tokens", copies)


def p7_share_report(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.share_report(*_mixture(spark, directory))


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    found = privacy.find_entities(table(spark, directory, "documents"), table(spark, directory, "known_names"))
    return found.select("doc_id", "pii_type", "start_at")


def p8_sanitised(spark: SparkSession, directory: str) -> DataFrame:
    return privacy.sanitise(table(spark, directory, "documents"), table(spark, directory, "known_names"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_term_frequencies, p2_found, p2_cut_report, p3_found, p3_pieces, p3_rejoined, p4_found, p4_nearest,
        p6_containers, p6_packing_report, p6_placed, p7_mixture, p7_share_report, p7_kept, p8_found, p8_sanitised,
    )
}

# DuckDB knows NFC only: wide letters and ligatures, which the given tables have, are replaced before it.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))).replace("'", "''"), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
PLAIN = f"translate(body, '{WIDE[0]}', '{WIDE[1]}')"
for _ligature in ("ﬀ ff", "ﬁ fi", "ﬂ fl", "ﬃ ffi", "ﬄ ffl"):
    PLAIN = "replace({}, '{}', '{}')".format(PLAIN, *_ligature.split())
TERMS = f"""
    WITH p AS (SELECT chunk_id, any_value(body) AS body FROM keyword_index WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
    t AS (SELECT chunk_id, unnest(regexp_extract_all(lower(regexp_replace(nfc_normalize({PLAIN}), '\\p{{Cf}}', '', 'g')), '[\\p{{L}}\\p{{N}}]+')) AS term FROM p),
    marked AS (
        SELECT term, count(*) AS occurrences, count(DISTINCT chunk_id) AS passages, CASE
            WHEN count(DISTINCT chunk_id) <= 2 THEN 'rare' WHEN count(DISTINCT chunk_id) > 0.2 * (SELECT count(*) FROM p) THEN 'common' END AS mark
        FROM t GROUP BY term
    )
"""
WHITE = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"

SQL: dict[str, str] = {
    "p1_found": f"{TERMS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p1_term_frequencies": f"{TERMS} SELECT term, occurrences, passages, mark FROM marked",
    "p6_placed": """
        SELECT w.window_id, w.capacity_tokens AS capacity, d.documents, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS overfull
        FROM (SELECT DISTINCT window_id, CAST(capacity_tokens AS BIGINT) AS capacity_tokens FROM context_windows) w,
            (SELECT count(DISTINCT doc_id) AS documents FROM documents) d
    """,
    "p7_kept": """
        SELECT lower(trim(source)) AS source, max_repeats, CAST(0 AS BIGINT) AS over_repeated, CAST(0 AS BIGINT) AS repeated_texts FROM mix_targets
    """,
    "p3_found": f"""
        WITH items AS (
            SELECT DISTINCT 'block' AS item_kind, section_id AS item_id, block_ord AS item_ord, text FROM blocks
            UNION
            SELECT DISTINCT 'page', chunk_id, p.page, p.text FROM (SELECT chunk_id, unnest(pages) AS p FROM chunks)
        )
        SELECT item_kind, item_id, CAST(item_ord AS INTEGER) AS item_ord,
            CAST(list_max(list_transform(regexp_split_to_array(text, '{WHITE}'), lambda x: length(x))) > 1000 AS INTEGER)
                AS unbroken
        FROM items WHERE length(text) > 1000
    """,
    "p3_rejoined": """
        SELECT DISTINCT 'block' AS item_kind, section_id AS item_id, CAST(block_ord AS INTEGER) AS item_ord, sha256(text) AS sha256, TRUE AS within_limit
        FROM blocks WHERE length(text) > 1000
        UNION
        SELECT DISTINCT 'page', chunk_id, CAST(p.page AS INTEGER), sha256(p.text), TRUE
        FROM (SELECT chunk_id, unnest(pages) AS p FROM chunks) WHERE length(p.text) > 1000
    """,
    "p4_found": """
        WITH usable AS (
            SELECT chunk_ord, any_value(CAST(embedding AS DOUBLE[])) AS e FROM vectors
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            GROUP BY chunk_ord
        ),
        pairs AS (
            SELECT a.chunk_ord AS a, b.chunk_ord AS b, list_cosine_similarity(a.e, b.e) AS s
            FROM usable a JOIN usable b ON a.chunk_ord <> b.chunk_ord
        ),
        best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
        SELECT DISTINCT CAST(least(a, b) AS INTEGER) AS chunk_ord_a, CAST(greatest(a, b) AS INTEGER) AS chunk_ord_b
        FROM best WHERE s >= 0.9
    """,
}
