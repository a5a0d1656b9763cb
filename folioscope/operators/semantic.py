"""Exact cosine ranking of stated query vectors against all vectors, in blocks, and its keyword safety net."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.words import TOP_K

#: Pairs of a vector block and a query block there should be, so that there is work for many tasks (fewer in a small table).
PAIRS, LEAST_BLOCK = 36, 2048
#: Most vectors of a block, and most queries; they bound what a task holds.
VECTOR_BLOCK = QUERY_BLOCK = 65_536
#: Similarities that a task holds at a time.
AT_ONCE = 1 << 22
#: Bytes that leave a task for each pair of a query and a vector block, as a share of what the query's vector takes.
RESULT_SHARE = 0.9
#: Groups of which the highest similarities bound the ``k``-th, each of so many vectors.
GROUP = 64
#: More than single precision can be off by for unit vectors, twice, and the sixth digit.
MARGIN = 2e-5


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector has exactly this many finite numbers, not all zero."""
    inf = F.lit(float("inf")).cast("float")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce((F.size(vector) == dimensions) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable_vectors(vectors: DataFrame, dimensions: int = 64) -> DataFrame:
    return (
        vectors.where(F.col("chunk_ord").isNotNull() & usable(F.col("embedding"), dimensions))
        .dropDuplicates(["chunk_ord"])
        .select("chunk_ord", "embedding")
    )


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in order in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def _units(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, each once, and their vectors at length one."""
    ids, first = np.unique(rows["id"].to_numpy(np.int64), return_index=True)
    vectors = np.stack(rows["embedding"].to_numpy()[first]).astype(np.float64)
    return ids, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def best_columns(scores: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` highest scores of each row, and of those equal to the lowest of them."""
    n = scores.shape[1]
    bound = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    return np.nonzero((scores >= bound[:, None]) & (scores > least))


def block_pairs(left: DataFrame, left_blocks: int, right: DataFrame, right_blocks: int) -> DataFrame:
    """Every pair of a block of ``left`` and one of ``right``, each pair a key of its own.

    A stated query set against all rows: each row is shipped once per block of the other side.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = left.withColumnRenamed("block", "left_block").withColumn("right_block", every(right_blocks))
    b = right.withColumnRenamed("block", "right_block").withColumn("left_block", every(left_blocks))
    return a.join(b, ["left_block", "right_block"])


def block_numbers(vectors: int, queries: int) -> tuple[int, int]:
    """Into how many blocks to deal vectors and queries, so that about PAIRS pairs ship as few bytes as they can.

    A vector is shipped once per query block, a query once per vector block.
    """
    pairs = max(1, min(PAIRS, -(-vectors // LEAST_BLOCK)))
    query_blocks = max(1, round((pairs * (1 + RESULT_SHARE) * queries / max(vectors, 1)) ** 0.5))
    return max(-(-pairs // query_blocks), -(-vectors // VECTOR_BLOCK)), max(query_blocks, -(-queries // QUERY_BLOCK))


def best_of_block(v: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, vector numbers and similarities (6 digits) of the ``k`` most similar unit vectors of each query.

    Vectors are in the order that settles ties.  Single precision only finds the candidates: the ``k``-th highest of
    the groups' highest similarities is at most the ``k``-th of all.
    """
    v32, q32 = v.astype(np.float32), q.astype(np.float32)
    groups = len(v) // GROUP
    step = max(1, AT_ONCE // max(1, len(v)))
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for at in range(0, len(q), step):
        rough = q32[at : at + step] @ v32.T
        if groups >= 2 * k:
            high = rough[:, : groups * GROUP].reshape(len(rough), GROUP, groups).max(1)
        else:
            high = rough
        width = high.shape[1]
        bound = np.partition(high, width - k, axis=1)[:, width - k] - np.float32(MARGIN) if width > k else np.full(len(rough), -np.inf, np.float32)
        of, near = np.divmod(np.flatnonzero(rough >= bound[:, None]), len(v))
        for some in np.array_split(np.arange(len(of)), len(of) * q.shape[1] // AT_ONCE + 1):
            similar = np.round(np.einsum("id,id->i", q[at + of[some]], v[near[some]]), 6)
            parts.append((at + of[some], near[some], similar))
    of, near, similar = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((near, -similar, of))
    of, near, similar = of[order], near[order], similar[order]
    best = np.arange(len(of)) - np.searchsorted(of, of) < k
    return of[best], near[best], similar[best]


def semantic_topk(vectors: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """``query_ord, rank, chunk_ord, similarity``: the ``k`` most similar vectors of each query, itself included.

    Both tables have chunk_ord and embedding; unusable vectors are left out on both sides, repeated rows count once.
    Every pair of a query block and a vector block is a matrix product in a call of its own; only each block's ``k``
    best leave it.  Equal similarities (to 6 digits) go by chunk_ord.
    """
    held = lambda rows: rows.where(F.col("chunk_ord").isNotNull() & usable(F.col("embedding"), 64))
    every, asked = held(vectors), held(queries)
    # Rows repeating an id are in the same block, which counts them once.
    vector_blocks, query_blocks = block_numbers(every.count(), asked.count())

    def dealt(rows: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("chunk_ord"), F.lit(blocks)).cast("int").alias(own)
        each = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        return rows.select(F.col("chunk_ord").cast("long").alias("id"), "embedding", block, each)

    def rank(v_rows: pd.DataFrame, q_rows: pd.DataFrame) -> pd.DataFrame:
        if v_rows.empty or q_rows.empty:
            return pd.DataFrame({"query_ord": [], "chunk_ord": [], "similarity": []}).astype({"query_ord": "int64", "chunk_ord": "int64"})
        (v_ids, v), (q_ids, q) = _units(v_rows), _units(q_rows)
        of, near, similar = best_of_block(v, q, k)
        return pd.DataFrame({"query_ord": q_ids[of], "chunk_ord": v_ids[near], "similarity": similar})

    pair = ["vector_block", "query_block"]
    left = dealt(every, "vector_block", vector_blocks, "query_block", query_blocks).groupBy(*pair)
    right = dealt(asked, "query_block", query_blocks, "vector_block", vector_blocks).groupBy(*pair)
    found = left.cogroup(right).applyInPandas(rank, "query_ord long, chunk_ord long, similarity double")
    best = Window.partitionBy("query_ord").orderBy(F.desc("similarity"), "chunk_ord")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select(F.col("query_ord").cast("int"), "rank", F.col("chunk_ord").cast("int"), "similarity")
    )


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` (query_ord, chunk_ord, ...) with their `similarity` to 6 digits, null where a side has no usable vector."""
    every = usable_vectors(vectors)
    side = lambda name, to: every.select(F.col("chunk_ord").alias(name), F.col("embedding").alias(to))
    product = dot(F.col("_q"), F.col("_v")) / F.sqrt(dot(F.col("_q"), F.col("_q")) * dot(F.col("_v"), F.col("_v")))
    both = pairs.join(side("query_ord", "_q"), "query_ord", "left").join(side("chunk_ord", "_v"), "chunk_ord", "left")
    return both.withColumn("similarity", F.round(product, 6)).drop("_q", "_v")


def with_keyword_match(ranked: DataFrame, matches: DataFrame, k: int = TOP_K) -> DataFrame:
    """``query, rank, chunk_id, via``: the semantic top ``k``, the last one replaced by the keyword match if that is new.

    ``ranked`` has query, rank, chunk_id; ``matches`` at most one chunk_id per query.  Queries with a match but no
    semantic result get the match alone at rank 1.  ``k`` below 1 gives no rows.  Further columns that both have, such
    as the similarity, stay with their passage.
    """
    more = [c for c in ranked.columns if c in matches.columns and c not in ("query", "rank", "chunk_id", "via")]
    top = ranked.where(F.col("rank") <= k).select("query", "rank", "chunk_id", *more)
    new = matches.select("query", "chunk_id", *more).join(top.select("query", "chunk_id"), ["query", "chunk_id"], "left_anti")
    sizes = top.groupBy("query").agg(F.max("rank").alias("size"))
    placed = new.join(sizes, "query", "left").select(
        "query",
        F.when(F.coalesce("size", F.lit(0)) < k, F.coalesce("size", F.lit(0)) + 1).otherwise(k).cast("int").alias("rank"),
        "chunk_id",
        *more,
        F.lit("keyword").alias("via"),
    )
    kept = top.join(placed.select("query", "rank"), ["query", "rank"], "left_anti").withColumn("via", F.lit("semantic"))
    return kept.unionByName(placed) if k >= 1 else kept.unionByName(placed).limit(0)


def closest_sections(ranked: DataFrame, chunks: DataFrame, n: int = 3) -> DataFrame:
    """``query, position, section_path, title, page``: the first ``n`` distinct sections in rank order."""
    # Only the page's number is shuffled, not the texts.
    page = F.get(F.col("pages"), F.lit(0))["page"].alias("page")
    held = chunks.where("chunk_id is not null").select("chunk_id", "section_path", "title", page).dropDuplicates(["chunk_id"])
    first = (
        ranked.join(held, "chunk_id")
        .groupBy("query", "section_path")
        .agg(F.min(F.struct("rank", "title", "page")).alias("best"))
    )
    order = Window.partitionBy("query").orderBy("best.rank")
    return (
        first.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= n)
        .select("query", "position", "section_path", "best.title", "best.page")
    )


def round_robin(hits: DataFrame, seen: DataFrame, most: int) -> DataFrame:
    """``query, position, chunk_id``: hits of several follow-up searches taken in turn, without those already seen.

    ``hits`` has query, search, rank, chunk_id.  A passage counts where it comes first: by rank, then by search.
    """
    unseen = hits.join(seen.select("query", "chunk_id"), ["query", "chunk_id"], "left_anti")
    first = unseen.groupBy("query", "chunk_id").agg(F.min(F.struct("rank", "search")).alias("at"))
    order = Window.partitionBy("query").orderBy("at.rank", "at.search")
    return (
        first.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= most)
        .select("query", "position", "chunk_id")
    )


def one_after_another(front: DataFrame, back: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query, rank, chunk_id``: the passages of ``back`` after those of ``front``, without ids that are no chunk.

    Both have query, rank, chunk_id.
    """
    held = chunks.select("chunk_id").distinct()
    both = front.select("query", F.lit(0).alias("list"), "rank", "chunk_id").unionByName(
        back.select("query", F.lit(1).alias("list"), "rank", "chunk_id")
    )
    order = Window.partitionBy("query").orderBy("list", "rank")
    known = both.join(held, "chunk_id", "left_semi")
    return known.withColumn("rank", F.row_number().over(order)).select("query", "rank", "chunk_id")


def cites_added(cited: DataFrame, added: DataFrame) -> DataFrame:
    """``row_id``: the answers that cite any added passage; ``cited`` has row_id, query, chunk_id, ``added`` query, chunk_id."""
    return cited.join(added, ["query", "chunk_id"], "left_semi").select("row_id").distinct()
