"""N-grams, buckets and padding of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramvec.functions.hashing import FNV_OFFSET_HI, FNV_OFFSET_LO, FNV_PRIME_LOW, bucket_ids
from gramvec.functions.text import BOUNDARY, char_ngrams

FNV_OFFSET = (FNV_OFFSET_HI << 32) + FNV_OFFSET_LO
_PRIME = np.uint64((1 << 40) + FNV_PRIME_LOW)


def word_ngrams(words: DataFrame, n: int) -> DataFrame:
    """``(word, ngrams array<string>)`` for a table of distinct words."""
    return words.select("word", char_ngrams("word", n).alias("ngrams"))


def word_buckets(words: DataFrame, n: int, num_buckets: int) -> DataFrame:
    """``(word, bucket_ids array<int>)``: n-grams hashed into 1..num_buckets-1.

    Computed once per distinct word, never per sample (the hash is a
    per-byte lambda, the costliest expression of the pipeline).
    """
    return word_ngrams(words, n).select("word", bucket_ids("ngrams", num_buckets).alias("bucket_ids"))


def _hashed_on(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """FNV-1a states ``h`` after the UTF-8 bytes of one more character each (code points)."""
    points = points.astype(np.uint64)
    if points.size == 0 or points.max() < 0x80:
        return (h ^ points) * _PRIME
    bits = np.select([points < 0x80, points < 0x800, points < 0x10000], [0, 6, 12], 18).astype(np.uint64)
    mark = np.select([bits == 0, bits == 6, bits == 12], [0, 0xC0, 0xE0], 0xF0).astype(np.uint64)
    h = (h ^ (mark | points >> bits)) * _PRIME
    for shift in (12, 6, 0):
        more = bits > shift
        byte = np.uint64(0x80) | (points[more] >> np.uint64(shift)) & np.uint64(0x3F)
        h[more] = (h[more] ^ byte) * _PRIME
    return h


def bucket_lists(words: list[str], n: int, num_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``(ends, ids)``: the buckets of word ``i`` are ``ids[ends[i]:ends[i + 1]]``; all words are hashed side by side."""
    if not words:
        return np.zeros(1, np.int32), np.zeros(0, np.int32)
    points = np.frombuffer("".join(f"{BOUNDARY}{w}{BOUNDARY}" for w in words).encode("utf-32-le"), np.uint32)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2 * len(BOUNDARY)
    start = np.cumsum(length) - length
    grams = np.maximum(length - n + 1, 0)
    ends = np.concatenate([[0], np.cumsum(grams + 1)])
    at = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
    first = np.repeat(start, grams) + at
    h = np.full(len(first), FNV_OFFSET, np.uint64)
    for j in range(n):
        h = _hashed_on(h, points[first + j])
    longest = np.argsort(-length, kind="stable")
    whole, begin, left = np.full(len(words), FNV_OFFSET, np.uint64), start[longest], -length[longest]
    for j in range(int(length.max())):
        k = np.searchsorted(left, -j, "left")  # the words that go on
        whole[:k] = _hashed_on(whole[:k], points[begin[:k] + j])
    ids = np.empty(ends[-1], np.uint64)
    ids[np.repeat(ends[:-1], grams) + at] = h
    ids[ends[1:][longest] - 1] = whole
    return ends.astype(np.int32), (ids % np.uint64(num_buckets - 1)).astype(np.int32) + 1


def buckets_of(words: str, n: int, num_buckets: int, nested: bool = False, text: bool = False) -> Column:
    """``word_buckets`` of a column of words, or with ``nested`` of arrays of words, where they stand: no join on samples.

    Each distinct word of an Arrow batch is hashed once. ``text``: the buckets as one string, joined by commas.
    """
    n, num_buckets = int(n), int(num_buckets)

    def found(col: pa.Array) -> pa.Array:
        flat = col.flatten() if nested else col
        coded = flat.dictionary_encode()
        ends, ids = bucket_lists(coded.dictionary.to_pylist(), n, num_buckets)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
        if text:
            lists = pc.binary_join(lists.cast(pa.list_(pa.string())), ",")
        out = lists.take(coded.indices)
        if not nested:
            return out
        ends = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), out)

    found.__annotations__ = {"col": pa.Array, "return": pa.Array}
    kind = "string" if text else "array<int>"
    return F.arrow_udf(found, f"array<{kind}>" if nested else kind)(F.col(words))


def hot_targets(frequent: DataFrame) -> DataFrame:
    """Salt counts for frequent words: ``ceil(cnt / (threshold * total))``.

    From ``drop_p = 1 - sqrt(t * total / cnt)``: ``cnt / (t * total) = (1 - drop_p)^-2``.
    Each salt then holds about ``threshold`` of the tokens; the table has
    fewer than ``1 / threshold`` rows and sums to at most ``2 / threshold`` salts.
    """
    return frequent.select(
        F.col("word").alias("key"),
        F.ceil(F.lit(1.0) / F.pow(F.lit(1.0) - F.col("drop_p"), 2)).cast("int").alias("n_salts"),
    )


def pad_expr(arr, width) -> F.Column:
    """Right-pad an int array with 0 to ``width`` (never truncates)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    w = F.col(width) if isinstance(width, str) else F.lit(int(width)) if isinstance(width, int) else width
    return F.concat(a, F.array_repeat(F.lit(0), F.greatest(w - F.size(a), F.lit(0))))


def query_word_buckets(words: DataFrame, n: int, num_buckets: int) -> DataFrame:
    """Query words -> n-gram buckets padded with 0 to the longest list.

    The width is one scalar aggregate over the words (a scalar subquery).
    """
    wb = word_buckets(words, n, num_buckets)
    width = wb.agg(F.max(F.size("bucket_ids"))).scalar()
    return wb.select("word", pad_expr("bucket_ids", width).alias("bucket_ids"))
