"""Token counting and encoding.

``word_tokens`` / ``hash_ids`` are built-in expressions and run inside the JVM.
A real vocabulary plugs in through ``encoder_udf``: the factory runs once per
Python worker and its encoder then sees Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The built-in token pattern, block length and padding id.
TOKEN_PATTERN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
BLOCK = 512
PAD_ID = 0
HASH_VOCABULARY = 32_000


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))


def hash_id(token: Column) -> Column:
    """Stable id in 1..HASH_VOCABULARY from the md5 of a token; 0 is padding."""
    number = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")
    return (number % F.lit(HASH_VOCABULARY) + 1).cast("int")


def hash_ids(c: Column, limit: int | None = None) -> Column:
    """Token ids of a text; with ``limit`` only the first tokens are hashed."""
    tokens = word_tokens(c)
    if limit is not None:
        tokens = F.slice(tokens, 1, limit)
    return F.transform(tokens, hash_id)


def encoder_udf(factory: Callable[[], Callable[[str], Sequence[int]]]) -> Callable[[Column], Column]:
    """Arrow UDF text -> array<int> around an encoder built once per worker."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = factory()
        for texts in batches:
            yield texts.fillna("").map(lambda text: list(encoder(text)))

    return encode


def count_udf(factory: Callable[[], Callable[[str], Sequence[int]]]) -> Callable[[Column], Column]:
    """Arrow UDF text -> token count; the ids never leave the worker."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = factory()
        for texts in batches:
            yield texts.fillna("").map(lambda text: len(encoder(text)))

    return count


def token_count(c: Column, counter: Callable[[Column], Column] | None = None) -> Column:
    """Tokens per value; null counts as the empty text."""
    return counter(c) if counter else F.size(word_tokens(c))


def padded(ids: Column, length: int = BLOCK, pad_id: int = PAD_ID) -> Column:
    """Truncate to ``length`` and pad on the right."""
    kept = F.slice(ids, 1, length)
    return F.concat(kept, F.array_repeat(F.lit(pad_id), F.lit(length) - F.size(kept)))


def attention_mask(ids: Column, length: int = BLOCK) -> Column:
    used = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(length) - used))
