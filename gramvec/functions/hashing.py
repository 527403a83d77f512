"""Keyed uniform draws and the FNV-1a 64 bucket hash as Spark expressions.

Both are plain SQL expressions so that the same value can be recomputed by any
SQL engine: the uniform is the first 52 bits of an md5 over a '|'-joined key;
the hash keeps the 64-bit FNV state in two 32-bit halves because ANSI mode
forbids a wrapping 64-bit multiply.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a 64 offset basis 0xcbf29ce484222325 split into 32-bit
# halves, and the low part of the prime 2**40 + 435.
FNV_OFFSET_HI = 3421674724
FNV_OFFSET_LO = 2216829733
FNV_PRIME_LOW = 435
TWO_POW_52 = 4503599627370496.0


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def hash_hex(*parts) -> Column:
    """``md5(concat_ws('|', parts))``: 128 bits, enough for two 52-bit uniforms."""
    cols = [_as_col(p).cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *cols))


def uniform_from_hex(hexed: Column, slot: int = 0) -> Column:
    """Uniform in [0, 1) from hex digits 1-13 (slot 0) or 14-26 (slot 1) of an md5."""
    return F.conv(F.substring(hexed, 1 + 13 * int(slot), 13), 16, 10).cast("bigint") / F.lit(TWO_POW_52)


def hash_uniform(*parts) -> Column:
    """Uniform double in [0, 1) from the key ``parts`` (columns or literals).

    ``conv(substr(md5(concat_ws('|', parts)), 1, 13), 16, 10) / 2^52``.
    Literal strings are passed as ``F.lit``; plain ``str`` means a column name.
    """
    return uniform_from_hex(hash_hex(*parts), 0)


def fnv1a_bucket(col, modulus: int, offset: int = 1) -> Column:
    """Bucket of one string column (``octet_length`` 0 gives the basis hash)."""
    return _fnv_lambda(_as_col(col), modulus, offset)


def _fnv_lambda(x: Column, modulus: int, offset: int) -> Column:
    m = int(modulus)
    two32_mod = (2**32) % m
    hexed = F.hex(F.encode(x, "UTF-8"))
    # sequence(1, 0) counts down: the empty string has no bytes
    byte_vals = F.when(F.octet_length(x) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.octet_length(x)),
            lambda i: F.conv(F.substring(hexed, 2 * i - 1, 2), 16, 10).cast("bigint"),
        )
    )
    init = F.struct(F.lit(FNV_OFFSET_HI).cast("bigint").alias("hi"), F.lit(FNV_OFFSET_LO).cast("bigint").alias("lo"))

    def step(a, b):
        t = (a["lo"].bitwiseXOR(b)) * FNV_PRIME_LOW
        hi = ((a["hi"] * FNV_PRIME_LOW) + F.shiftright(t, 32) + F.shiftleft(a["lo"].bitwiseXOR(b), 8)).bitwiseAND(
            F.lit(4294967295)
        )
        lo = t.bitwiseAND(F.lit(4294967295))
        return F.struct(hi.alias("hi"), lo.alias("lo"))

    def finish(a):
        return ((((a["hi"] % m) * two32_mod) + (a["lo"] % m)) % m + int(offset)).cast("int")

    return F.aggregate(byte_vals, init, step, finish)


def bucket_ids(ngrams, num_buckets: int) -> Column:
    """Hash every n-gram into 1..num_buckets-1; bucket 0 stays reserved for padding."""
    return F.transform(_as_col(ngrams), lambda g: _fnv_lambda(g, num_buckets - 1, 1))
