"""Tokens of the text index and a hashing embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """The lower-cased text split at everything that is neither letter nor number; tokens of fewer than two UTF-8 bytes are
    dropped. Null gives null, an empty text an empty array."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 2)


def word_hash(word: Column) -> Column:
    """h = 33 h + code point from 5381, in 32 bits."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(5381).cast("bigint"), lambda h, c: (h * 33 + F.ascii(c)) % F.lit(1 << 32))


def hash_embedding(text: Column, dim: int) -> Column:
    """White-space separated words as a unit embedding: a word adds ((hash + i) % 1000) / 1000 at position i. A text without
    words gives the zero embedding, null gives null."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hashes = F.transform(words, word_hash)
    at = F.sequence(F.lit(0), F.lit(dim - 1))
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  (a lambda variable is computed once)
    total = once(hashes, lambda hs: F.transform(at, lambda i: F.aggregate(hs, F.lit(0.0), lambda s, h: s + ((h + i) % F.lit(1 << 32) % 1000) / 1000.0)))
    scaled = lambda v, n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))
    unit = once(total, lambda v: once(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), lambda n: scaled(v, n)))
    return F.when(text.isNotNull(), unit)
