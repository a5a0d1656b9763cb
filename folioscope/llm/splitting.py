"""Problem 3: cut long texts into pieces of bounded length at natural boundaries, with overlap.

Lexical-cohesion segmentation.  The places where a text may end a piece are, from best to worst, ends of paragraphs,
lines and sentences, white space, and any character.  Around each natural boundary the words of the block before are
compared with the words of the block after; a boundary where the similarity is much lower than on both sides is a deep
valley, hence a change of topic.  Of the best boundaries within reach, the deepest valley ends the piece.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import sqrt

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"\t-\r\x20\x85\xa0  -     　"
WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Where a paragraph, a line or a sentence ends; a piece keeps the white space that follows its last sentence.
PARAGRAPH = regex.compile(rf"\n[{WHITE}]*\n[{WHITE}]*")
LINE = regex.compile(rf"[\n\r  ]+[{WHITE}]*")
SENTENCE = regex.compile(rf"[.!?…。！？]+[\"'”’»)\]]*(?:\[\d+\])*[{WHITE}]+(?=[^\p{{Ll}}])")
SPACE = regex.compile(rf"[{WHITE}]+")
#: Words on each side of a boundary that are compared.
BLOCK_WORDS = 30
#: A piece that isn't the last is at least this share of the limit long if a natural boundary allows it.
LEAST_FILL = 0.5

PIECE = "piece_ord int, start_at int, end_at int, overlap int, unbroken int, piece string"


def valley_depths(words: list[tuple[int, str]], bounds: list[int]) -> list[float]:
    """Depth of the similarity valley at each of the ascending boundaries ``bounds``.

    ``words`` are (offset, word).  The blocks of the next boundary are those of the last one moved on by a few words,
    so the counts and their inner product are updated rather than computed again.
    """
    if not bounds:
        return []
    offsets = [at for at, _ in words]
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    inner = left_square = right_square = 0
    low = mid = high = 0
    similarity = []
    for bound in bounds:
        centre = bisect_left(offsets, bound)
        for i in range(mid, centre):  # words that move from the right block to the left one
            if i < high:
                word = words[i][1]
                n = right[word]
                right[word] = n - 1
                inner -= left.get(word, 0)
                right_square -= 2 * n - 1
            word = words[i][1]
            n = left.get(word, 0)
            left[word] = n + 1
            inner += right.get(word, 0)
            left_square += 2 * n + 1
        mid, high = centre, max(high, centre)
        while low < mid - BLOCK_WORDS:
            word = words[low][1]
            n = left[word]
            left[word] = n - 1
            inner -= right.get(word, 0)
            left_square -= 2 * n - 1
            low += 1
        while high < min(len(words), mid + BLOCK_WORDS):
            word = words[high][1]
            n = right.get(word, 0)
            right[word] = n + 1
            inner += left.get(word, 0)
            right_square += 2 * n + 1
            high += 1
        similarity.append(inner / sqrt(left_square * right_square) if left_square and right_square else 0.0)
    # The peak on either side: the highest similarity reached without falling again.
    n = len(similarity)
    left_peak, right_peak = similarity[:], similarity[:]
    for i in range(1, n):
        left_peak[i] = max(similarity[i], left_peak[i - 1]) if similarity[i - 1] >= similarity[i] else similarity[i]
    for i in range(n - 2, -1, -1):
        right_peak[i] = max(similarity[i], right_peak[i + 1]) if similarity[i + 1] >= similarity[i] else similarity[i]
    return [left_peak[i] + right_peak[i] - 2 * similarity[i] for i in range(n)]


def _overlap_start(text: str, end: int, floor: int, overlap: int) -> int:
    """Where the piece after one that ends at ``end`` starts: at a word, at most ``overlap`` characters before it."""
    low = max(floor + 1, end - overlap)
    for match in SPACE.finditer(text, low - 1, end):
        if low <= match.end() < end:
            return match.end()
    return low


def split_points(text: str, limit: int = 1000, overlap: int = 100) -> list[tuple[int, int]]:
    """The (start, end) of each piece of ``text``; a text within the limit is one piece, an empty one none."""
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    ranks: dict[int, int] = {}
    for rank, pattern in enumerate((SENTENCE, LINE, PARAGRAPH)):
        for match in pattern.finditer(text):
            ranks[match.end()] = rank
    bounds = sorted(b for b in ranks if 0 < b < len(text))
    depths = valley_depths([(m.start(), m.group().lower()) for m in WORD.finditer(text)], bounds)
    pieces, start, done = [], 0, 0
    while len(text) - start > limit:
        reach = start + limit
        least = max(done + 1, start + int(limit * LEAST_FILL))
        low, high = bisect_left(bounds, least), bisect_right(bounds, reach)
        if low == high:
            low = bisect_right(bounds, done + overlap)
        if low < high:
            end = bounds[max(range(low, high), key=lambda i: (depths[i] + 0.1 * ranks[bounds[i]], i))]
        else:
            spaces = [m.end() for m in SPACE.finditer(text, done + 1, reach) if m.end() < reach]
            if reach < len(text) and SPACE.match(text, reach - 1):
                spaces.append(reach)
            end = spaces[-1] if spaces else reach
            while not spaces and end > done + 1 and regex.match(r"[\p{M}‍]", text[end]):
                end -= 1
        pieces.append((start, end))
        done = end
        start = _overlap_start(text, end, pieces[-1][0], overlap)
    pieces.append((start, len(text)))
    return pieces


def split_long_texts(
    items: DataFrame,
    keys: list[str],
    text: str = "text",
    limit: int = 1000,
    overlap: int = 100,
) -> DataFrame:
    """The pieces of every text: ``keys`` and `piece_ord` (from 0), `start_at`, `end_at`, `overlap`, `unbroken`, `piece`.

    Each piece is exactly ``text[start_at:end_at]`` and at most ``limit`` characters (code points) long; each after the
    first starts with the last `overlap` characters of the one before, between 1 and ``overlap``; without these the
    pieces joined are the text.  `unbroken` is 1 if the text has a run of more than ``limit`` characters without white
    space, which no natural boundary can cut.  A text within the limit is one piece; null and empty texts give none.
    Rows repeating ``keys`` (nulls are equal) are one item.  Other columns are ignored.
    """
    unbroken = regex.compile(rf"[^{WHITE}]{{{limit + 1}}}")
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*keys).schema)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, value in batch.itertuples(index=False, name=None):
                broken = int(unbroken.search(value) is not None)
                before = 0
                for order, (start, end) in enumerate(split_points(value, limit, overlap)):
                    rows.append((*key, order, start, end, before - start if order else 0, broken, value[start:end]))
                    before = end
            yield pd.DataFrame(rows, columns=[*keys, *(c.split()[0] for c in PIECE.split(", "))])

    distinct = items.select(*keys, F.col(text).alias("_text")).where(F.length("_text") > 0).dropDuplicates(keys)
    return distinct.mapInPandas(pieces, f"{key_types}, {PIECE}")


def oversized(text: str | Column, limit: int = 1000) -> Column:
    """Whether a text is over the limit; filters before the operator, inside the scan's stage."""
    return F.length(text) > limit
