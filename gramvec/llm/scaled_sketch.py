"""Threshold-scaled sketches of documents, with DataFrame functions only.

A document's shingles are its runs of ``SHINGLE`` words (lower case; fewer
words: the whole sequence). Each is hashed to 64 bits, and the sketch keeps
every hash below ``2^64 / scale``, counted as unsigned: a fixed fraction of the
distinct shingles. The scale is ``SCALE``, for texts of fewer than ``SMALL``
distinct shingles 1, and a sketch whose hashes are all above the limit keeps
the lowest one, so that only texts without words have an empty sketch.
Sketches merge by union, give the sketch of a coarser scale by dropping hashes,
and are compared at the coarser of their scales. They estimate containment
between documents of very unequal length: the share of one sketch's hashes
that the other has.

``fingerprint`` writes a sketch as text: number of distinct shingles, scale,
and the hashes in order. Texts with equal words have equal fingerprints, and
equal fingerprints have likeness 1, those of null, empty and other texts
without words among them.

A null doc_id comes after all others in descending order; rows with equal
doc_id are ordered by text. A single row is its own next one. An empty table
gives no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gramvec.llm.common import partitions, words_of

SHINGLE = 5
#: A power of two: one hash in so many is kept.
SCALE = 4
SMALL = 64
_SIGN = -(1 << 63)


def _once(df: DataFrame, **made: Column) -> DataFrame:
    """``df`` with further columns behind a generated row, so that later lambdas don't evaluate them anew."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(n) for n, c in made.items()])
    return df.select(F.inline(F.array(row)))


def _at(hashes: Column, scale: Column) -> Column:
    """Of all hashes (or those of a finer scale) the ones kept at ``scale``: at least the lowest."""
    shift = F.lit(64) - F.log2(scale).cast("int")
    kept = F.when(scale == 1, hashes).otherwise(F.filter(hashes, lambda h: F.call_function("shiftrightunsigned", h, shift) == 0))
    lowest = F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(_SIGN)))).bitwiseXOR(F.lit(_SIGN))
    return F.when((F.size(kept) == 0) & (F.size(hashes) > 0), F.array(lowest)).otherwise(kept)


def with_sketch(df: DataFrame, text: str, name: str, k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``df`` with ``name``: struct of ``n`` (distinct shingles), ``scale`` and ``hashes`` (those kept, in order)."""
    words, shingles = f"_{name}_words", f"_{name}_all"
    out = _once(df, **{words: F.transform(words_of(F.lower(F.col(text))), lambda w: F.xxhash64(w))})
    size = F.size(F.col(words))
    starts = F.when(size > 0, F.sequence(F.lit(0), F.greatest(size - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(k)]))
    out = _once(out, **{shingles: F.array_distinct(hashes)}).drop(words)
    n = F.size(shingles)
    used = F.when(n < SMALL, 1).otherwise(scale)
    kept = F.array_sort(_at(F.col(shingles), used))
    return _once(out, **{name: F.struct(n.alias("n"), used.alias("scale"), kept.alias("hashes"))}).drop(shingles)


def fingerprint(sketch: Column) -> Column:
    return F.concat_ws(":", sketch["n"], sketch["scale"], F.array_join(F.transform(sketch["hashes"], lambda h: F.lower(F.hex(h))), "."))


def coarser(sketch: Column, scale) -> Column:
    """The sketch at a larger ``scale`` (a number or a column)."""
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    to = F.greatest(sketch["scale"], scale)
    return F.struct(sketch["n"].alias("n"), to.alias("scale"), _at(sketch["hashes"], to).alias("hashes"))


def _shared(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hashes of either and of both at the coarser scale."""
    to = F.greatest(a["scale"], b["scale"])
    one, other = _at(a["hashes"], to), _at(b["hashes"], to)
    return F.size(one), F.size(other), F.size(F.array_intersect(one, other))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has (null if ``a`` has none)."""
    one, _, both = _shared(a, b)
    return F.when(one > 0, both / one)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingles; 1 between equal sketches."""
    one, other, both = _shared(a, b)
    union = one + other - both
    return F.when(union > 0, both / union).otherwise(1.0)


def merged(sketches: DataFrame, key: str, name: str = "sketch") -> DataFrame:
    """Per ``key`` the sketch of all its documents together, at their coarsest scale; ``n`` is estimated by the kept share."""
    rows = sketches.select(key, F.col(name)["scale"].alias("_scale"), F.explode(F.col(name)["hashes"]).alias("_h"))
    once = rows.groupBy(key, "_h").agg(F.max("_scale").alias("_scale"))
    found = once.groupBy(key).agg(F.max("_scale").alias("scale"), F.collect_list("_h").alias("_all"))
    kept = found.select(key, "scale", F.array_sort(_at(F.col("_all"), F.col("scale"))).alias("hashes"))
    return kept.select(key, F.struct((F.size("hashes") * F.col("scale")).cast("int").alias("n"), "scale", "hashes").alias(name))


# --------------------------------------------------------------- next document
def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: the text of the next document in descending doc_id (after the last: the first).

    Documents are dealt to ranges of doc_id by quantiles of all ids, so a text
    is shuffled once and a window holds one range. The first text of a range,
    one row for each, is added at the end of the range before.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    points = F.array(*[F.lit(i / n) for i in range(1, max(2, n))])
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", points, 100 * n).alias("c")).first()["c"] or []), reverse=True)

    def number(low: int, high: int) -> Column:
        """Of the cuts in descending order, the first that the id reaches."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("doc_id") >= cuts[mid], number(low, mid)).otherwise(number(mid + 1, high))

    dealt = rows.withColumn("_range", number(0, len(cuts)))
    tops = dealt.groupBy("_range").agg(F.max("doc_id").alias("_top")).orderBy("_range").collect()  # a row for each range
    before = {r["_range"]: p["_range"] for p, r in zip(tops[-1:] + tops[:-1], tops)}
    links = docs.sparkSession.createDataFrame(
        [(r["_range"], r["_top"], before[r["_range"]]) for r in tops], "_r int, _top long, _before int"
    )
    first = (
        dealt.join(F.broadcast(links), (F.col("_range") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_top")))
        .groupBy("_before")
        .agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("_before").alias("_range"), F.lit(1).alias("_last"))
    )
    order = W.partitionBy("_range").orderBy("_last", F.col("doc_id").desc_nulls_last(), "text")
    return (
        dealt.withColumn("_last", F.lit(0))
        .unionByName(first)
        .withColumn("next_text", F.lead("text").over(order))
        .where("_last = 0")
        .select("doc_id", "text", "next_text")
    )


def edit_likeness(docs: DataFrame, k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Each text against its edited text, whose second half begins the next document's text, and against the next text."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = _once(with_next(docs), edited=edited)
    for text, name in (("text", "own"), ("edited", "other"), ("next_text", "after")):
        rows = with_sketch(rows, text, name, k, scale)
    own, other, after = F.col("own"), F.col("other"), F.col("after")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"),
        fingerprint(other).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"),
        likeness(own, after).alias("near_next"),
    )
