"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default folder and file of the tokenizer; both can be given to every operator.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
RANK_FILE = "byte_bpe_50k.tiktoken"
#: The pre-tokenization pattern published with these rank files; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters encoded at once; a text is cut only before white space followed by a letter or digit, where no token of
#: the pattern above spans the cut, so sizes are exact while memory stays bounded.
SPAN = 100_000


@lru_cache(1)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _spans(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > SPAN:
        end = start + SPAN
        while end > start and not (text[end] == " " and text[end - 1].isalnum() and text[end + 1 : end + 2].isalnum()):
            end -= 1
        if end == start:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def token_count(text: str | None, path: str) -> int:
    """Tokens of a text; 0 for null and empty texts."""
    if not text:
        return 0
    return sum(len(encoding(path).encode_ordinary(span)) for span in _spans(text))


def with_token_counts(
    documents: DataFrame,
    text: str = "text",
    name: str = "tokens",
    tokenizers: str = TOKENIZERS,
    rank_file: str = RANK_FILE,
) -> DataFrame:
    """``documents`` with the column ``text`` replaced by its size in tokens, ``name``: texts leave the plan here."""
    path = os.path.join(tokenizers, rank_file)
    kept = [c for c in documents.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*kept).schema)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [token_count(value, path) for value in batch[text]]
            yield batch[kept].assign(**{name: sizes})

    rows = documents.select(*kept, F.col(text))
    return rows.mapInPandas(count, f"{schema}, `{name}` long")
