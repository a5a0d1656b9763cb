"""Inverted keyword index: document frequencies, rare words and BM25 lookup.

Scores follow published BM25+ weighting with fixed parameters of this library (``words.BM25``); only which passage wins
is meant to be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.words import BM25, RARE_MAX_PASSAGES
from folioscope.operators.semantic import best_columns, block_pairs
from folioscope.session import cut_lineage, partitions

#: Passages and questions of one block; bound the score matrix of a task.
PASSAGE_BLOCK = 4096
QUESTION_BLOCK = 512
#: Products of a term's weight and a question that are added up at a time.
AT_ONCE = 1 << 22


def passages(index: DataFrame) -> DataFrame:
    """One row per chunk_id with title and body, null texts as empty; rows without a chunk_id are no passages.

    They stay in the session's number of partitions, since taking texts apart costs much more than their bytes suggest.
    """
    return (
        index.where("chunk_id is not null")
        .select("chunk_id", "title", "body")
        .repartition(partitions(index.sparkSession), "chunk_id")
        .dropDuplicates(["chunk_id"])
        .select("chunk_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"))
    )


def postings(index: DataFrame) -> DataFrame:
    """``chunk_id, field, term, tf, field_length, is_first``: terms per field; the length counts all terms of the field.

    Of the terms of a passage's field one is first, so that lengths can be added up once per passage.  The rows of a
    passage stay where its row is after the repeats are dropped, so this is one shuffle.
    """
    field = lambda name: F.struct(F.lit(name).alias("field"), T.tokens(F.col(name)).alias("words"))
    fields = passages(index).select("chunk_id", F.explode(F.array(field("title"), field("body"))).alias("f"))
    words = fields.select("chunk_id", "f.field", F.explode("f.words").alias("word"))
    each = words.select("chunk_id", "field", T.word_term(F.col("word")).alias("term")).where("term is not null")
    whole = Window.partitionBy("chunk_id", "field")
    return each.groupBy("chunk_id", "field", "term").agg(F.count("*").alias("tf")).withColumns(
        {"field_length": F.sum("tf").over(whole), "is_first": F.col("term") == F.min("term").over(whole)}
    )


def postings_of(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of the terms in ``terms`` (term), and those that lengths are added up by, written once."""
    asked = terms.select("term").distinct().withColumn("asked", F.lit(True))
    held = postings(index).join(asked, "term", "left").where("asked or is_first")
    return cut_lineage(held.drop("asked"))


def document_frequency(held: DataFrame) -> DataFrame:
    """``term, passages``: in how many passages each term of the postings ``held`` occurs, in title or body."""
    return held.select("chunk_id", "term").distinct().groupBy("term").agg(F.count("*").alias("passages"))


def rare_words(held: DataFrame, questions: DataFrame, most: int = RARE_MAX_PASSAGES) -> DataFrame:
    """``id, position, word, term, passages``: the words of each question that occur in 1 to ``most`` passages."""
    words = (
        questions.where("id is not null")
        .dropDuplicates(["id"])
        .select("id", F.posexplode(T.tokens(F.col("question"))).alias("position", "word"))
        .withColumn("term", T.word_term(F.col("word")))
    )
    frequency = document_frequency(held).where(F.col("passages") <= most)
    return words.join(frequency, "term").select("id", "position", "word", "term", "passages")


def question_terms(questions: DataFrame) -> DataFrame:
    """``id, term``: the distinct index terms of each question."""
    asked = questions.where("id is not null").dropDuplicates(["id"])
    return asked.select("id", F.explode(F.array_distinct(T.terms(F.col("question")))).alias("term"))


def term_weights(index: DataFrame, held: DataFrame, terms: DataFrame) -> DataFrame:
    """``chunk_id, term, weight``, a row per field, of the postings ``held`` of ``index`` whose term is in ``terms``.

    Terms are weighted per field; the collection's statistics are two rows.
    """
    k, b, d = BM25["k"], BM25["b"], BM25["d"]
    n = index.select("chunk_id").where("chunk_id is not null").distinct().count()
    total = F.sum(F.when(F.col("is_first"), F.col("field_length")))
    lengths = held.groupBy("field").agg((total / F.lit(max(n, 1))).alias("average")).withColumn("collection", F.lit(n))
    in_field = held.join(terms.select("term").distinct(), "term", "left_semi")
    frequency = in_field.groupBy("field", "term").agg(F.count("*").alias("n"))
    idf = F.log(1 + (F.col("collection") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    norm = k * (1 - b + b * F.col("field_length") / F.col("average"))
    weight = d + F.col("tf") * (k + 1) / (F.col("tf") + norm)
    boost = F.when(F.col("field") == "title", BM25["title_boost"]).otherwise(1.0)
    return (
        in_field.join(frequency, ["field", "term"])
        .join(F.broadcast(lengths), "field")  # two rows
        .select("chunk_id", "term", (boost * idf * weight).alias("weight"))
    )


def bm25_scores(index: DataFrame, held: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, chunk_id, score`` for distinct (id, term) pairs of ``wanted``: summed over terms and fields.

    ``held`` are postings of ``index``.  Only passages with a wanted term appear.  For rare terms: each is joined with
    all of its passages.
    """
    terms = wanted.select("id", "term").distinct()
    scored = term_weights(index, held, terms)
    return scored.join(terms, "term").groupBy("id", "chunk_id").agg(F.round(F.sum("weight"), 6).alias("score"))


def _pack(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows (``key``, term, weight) as blocks: ``block, ids, rows, terms, weights``, sorted by term; terms as hashes."""

    def pack(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, row = np.unique(pdf["id"].to_numpy(str), return_inverse=True)
        terms = pdf["term"].to_numpy(np.int64)
        order = np.lexsort((row, terms))
        return pd.DataFrame(
            {
                "block": [at[0]],
                "ids": [ids.tolist()],
                "rows": [row[order].astype(np.int32).tobytes()],
                "terms": [terms[order].tobytes()],
                "weights": [pdf["weight"].to_numpy(np.float64)[order].tobytes()],
            }
        )

    return (
        rows.select(F.col(key).alias("id"), F.xxhash64("term").alias("term"), "weight", F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"))
        .groupBy("block")
        .applyInPandas(pack, "block long, ids array<string>, rows binary, terms binary, weights binary")
    )


def _scores(p: tuple[np.ndarray, ...], q: tuple[np.ndarray, ...], passages_: int, questions_: int) -> np.ndarray:
    """Scores of all questions (rows) and passages (columns) of two blocks of (rows, terms, weights), sorted by term."""
    scores = np.zeros(questions_ * passages_)
    low, high = np.searchsorted(q[1], p[1], "left"), np.searchsorted(q[1], p[1], "right")
    upto = np.cumsum(high - low)
    at = 0
    while at < len(upto):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
        times = (high - low)[at:to]
        first = np.repeat(low[at:to] - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
        question = q[0][first + np.arange(len(first))]
        place = question.astype(np.int64) * passages_ + np.repeat(p[0][at:to], times)
        scores += np.bincount(place, np.repeat(p[2][at:to], times), len(scores))
        at = to
    return scores.reshape(questions_, passages_)


def bm25_best(index: DataFrame, questions: DataFrame, k: int, held: DataFrame | None = None) -> DataFrame:
    """``id, rank, chunk_id, score``: the ``k`` best passages of each question over all of its terms, ties by chunk_id.

    A common term meets a large share of all passages for many questions; so the questions are held against all
    passages in pairs of blocks, each one task, and only each block's ``k`` best leave it.  Questions without a known
    term have no rows.  ``held`` are the postings of the questions' terms, if there are some already.
    """
    wanted = cut_lineage(question_terms(questions))
    held = postings_of(index, wanted) if held is None else held
    n = index.select("chunk_id").where("chunk_id is not null").distinct().count()
    m = wanted.select("id").distinct().count()
    passage_blocks, question_blocks = max(1, -(-n // PASSAGE_BLOCK)), max(1, -(-m // QUESTION_BLOCK))
    name = lambda df, x: df.select("block", *(F.col(c).alias(f"{x}_{c}") for c in ("ids", "rows", "terms", "weights")))
    left = name(_pack(term_weights(index, held, wanted), "chunk_id", passage_blocks), "p")
    right = name(_pack(wanted.withColumn("weight", F.lit(1.0)), "id", question_blocks), "q")

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                p = (np.frombuffer(row.p_rows, np.int32), np.frombuffer(row.p_terms, np.int64), np.frombuffer(row.p_weights))
                q = (np.frombuffer(row.q_rows, np.int32), np.frombuffer(row.q_terms, np.int64))
                scores = np.round(_scores(p, q, len(row.p_ids), len(row.q_ids)), 6)
                of, found = best_columns(scores, k, 0.0)
                yield pd.DataFrame({"id": np.asarray(row.q_ids)[of], "chunk_id": np.asarray(row.p_ids)[found], "score": scores[of, found]})

    pairs = block_pairs(left, passage_blocks, right, question_blocks).drop("left_block", "right_block")
    return best_passages(pairs.mapInPandas(rank, "id string, chunk_id string, score double"), k)


def best_passages(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best passages per id, ties by chunk_id: ``id, rank, chunk_id, score``."""
    best = Window.partitionBy("id").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def rare_word_match(index: DataFrame, questions: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``id, chunk_id, score``: the passage that best matches each question's rare words, looked up whole.

    ``held`` are the postings of the questions' terms, if there are some already.
    """
    held = postings_of(index, question_terms(questions)) if held is None else held
    return best_passages(bm25_scores(index, held, rare_words(held, questions)), 1).drop("rank")
