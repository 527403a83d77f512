"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources in code-point order (null last) get the weights of ``WEIGHTS`` in
turn and share ``SHARE`` times all words. A target stops at ``MOST`` times its
source's words; what is above is shared again by weight among the others.

A source's documents are permuted by the md5 of seed and doc_id. Its target is
taken as whole passes over the permuted documents and then the first of them;
one document per source is cut, so that the words taken are the target,
rounded. A pass is dealt in blocks: documents whose md5 shares its leading
bits, as many as make blocks of about ``BLOCK_DOCS``. The exact numbers of blocks that the
sources give (their quotas) are split among the output shards by a binary
tree: the left child of a node with k shards draws its share of the node's
blocks from the multivariate hypergeometric distribution, seeded by the node.
Leaves take disjoint runs of each source's permuted blocks, and the documents
of a shard are put in an order of their own.

The size of a document is its number of words (null text: 0). Documents of
size 0 take nothing. Rows with equal doc_id and source are ordered by the hash
of their text; equal rows follow each other and are drawn one by one. A null
doc_id is permuted like any other; all of a source's rows without one have the
same md5, so their blocks follow from the hash of their text. An empty table gives an empty mix. Extra columns are ignored.
Weights, targets and quotas of the sources, a row for each source, pass the
driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gramvec.llm.common import WORD, staged
from gramvec.operators.ordinals import prefix_sums

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
SEED = 17
#: Documents of a block, about.
BLOCK_DOCS = 64
#: Hexadecimal digits of the md5, and bits, that blocks are numbered by, whatever their number.
BLOCK_DIGITS = 15
#: Bits of a block's number that part the rows without doc_id.
PART_BITS = 21
#: Words of an output shard, about.
SHARD_WORDS = 1_000_000
#: Blocks whose shards are broadcast, at most.
BROADCAST_BLOCKS = 500_000


def word_count(text: Column) -> Column:
    """Words of ``text``: places where one begins."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(spaced, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words per source: ``share`` of all by weight, none above ``most`` times its size."""
    caps = [most * s for s in sizes]
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= caps[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sized_columns() -> list[Column]:
    """``doc_id, source, size`` and ``key``, by which a source's documents are permuted."""
    key = F.md5(F.concat_ws("|", F.lit(str(SEED)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.concat(key, F.hex(F.xxhash64("text"))).alias("key"),
    ]


def sized(docs: DataFrame) -> DataFrame:
    """``_mix_row`` and ``sized_columns``; ``_mix_row`` tells equal rows apart."""
    return docs.select(F.monotonically_increasing_id().alias("_mix_row"), *sized_columns())


def source_plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target, passes, rest, shift`` of every source.

    ``passes`` whole passes and ``rest`` words of the next one make the target.
    A block's number begins with the key's first ``BLOCK_DIGITS`` digits shifted right by ``shift`` bits.
    """
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    out = []
    for r, t in zip(found, wanted):
        take = min(int(t + 0.5), int(most * r["size"]))
        passes = take // r["size"] if r["size"] else 0
        bits = (r["n"] // BLOCK_DOCS).bit_length()
        out.append((r["source"], r["size"], float(t), passes, take - passes * r["size"], 4 * BLOCK_DIGITS - bits))
    return rows.sparkSession.createDataFrame(
        out, "source string, source_size long, target double, passes long, rest long, shift int"
    )


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows beside their source's plan; the plan is the driver's own list, broadcast if it has at most 100,000 rows."""
    other = plan.withColumnRenamed("source", "_source")
    small = F.broadcast(other) if plan.count() <= 100_000 else other
    return rows.join(small, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")


def with_block(rows: DataFrame) -> DataFrame:
    """``block``: ascends with ``key``. In the block of the rows without doc_id, these have numbers by their text's hash."""
    none = hashlib.md5(f"{SEED}|null".encode()).hexdigest()
    md5, most = F.substring("key", 1, 32), 1 << (PART_BITS - 1)
    hashed = F.conv(F.substring("key", 33, (PART_BITS - 1) // 4), 16, 10).cast("long")
    part = F.when(md5 < none, F.lit(0)).when(md5 == none, 1 + hashed).otherwise(F.lit(most + 1)).cast("long")
    leading = F.expr(f"shiftright(cast(conv(substring(key, 1, {BLOCK_DIGITS}), 16, 10) as bigint), shift)")
    return rows.withColumn("block", leading * (1 << PART_BITS) + part)


def taken_words(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (``sized``) with their plan, ``block``, and ``first``: words of the last, partial pass that they give.

    Words before a document are those of earlier blocks plus those of earlier
    documents in its block, so no window holds a whole source's documents.
    """
    all_rows = with_block(with_plan(rows, plan))
    blocks = all_rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    before = prefix_sums(blocks, ["block"], "words", "earlier", by="source")
    before = before.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "earlier")
    joined = all_rows.join(before, all_rows["source"].eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")
    own = W.partitionBy("source", "block").orderBy("key", "_mix_row").rowsBetween(W.unboundedPreceding, 0)
    start = F.col("earlier") + F.sum("size").over(own) - F.col("size")
    return joined.withColumn("first", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start)).cast("long"))


# -------------------------------------------------------------- splitting tree
def leaf_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source that ``shard`` gets; over all shards they add up to ``quotas``."""
    low, high, left = 0, shards, quotas.astype(np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        total = int(left.sum())
        digest = hashlib.sha256(f"{seed}|{low}|{high}".encode()).digest()
        rng = np.random.Generator(np.random.PCG64(int.from_bytes(digest[:16], "big")))
        draw, open_ = np.zeros_like(left), total * (mid - low) // (high - low)
        rest = total
        for i, n in enumerate(left.tolist()):  # one source after another: what is left of the draw, from what is left of the blocks
            rest -= n
            draw[i] = rng.hypergeometric(n, rest, open_) if n and open_ and rest else min(n, open_)
            open_ -= int(draw[i])
        low, high, left = (low, mid, draw) if shard < mid else (mid, high, left - draw)
    return left


def shard_runs(spark: SparkSession, quotas: list[int], shards: int) -> DataFrame:
    """``number, shard, n``: how many blocks each shard takes of the source of that number; every shard walks its own path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.array(quotas, np.int64)
        for pdf in batches:
            for shard in pdf["id"].tolist():
                n = leaf_quotas(wanted, shards, shard)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"number": at, "shard": shard, "n": n[at]})

    return spark.range(shards).mapInPandas(run, "number long, shard long, n long")


def passes_of(rows: DataFrame) -> DataFrame:
    """A row for each ``copy`` of a row that gives ``words``: ``size`` in a whole pass, ``first`` in the partial one."""
    copies = F.expr("transform(sequence(0, cast(passes as int)), c -> if(c < passes, size, first))")
    return rows.select("*", F.posexplode(copies).alias("copy", "words")).where("words > 0")


def shard_plan(drawn: DataFrame, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """``_s, _c, _b, shard``: the shard of every block that a source gives in a pass; and the number of shards."""
    spark = drawn.sparkSession
    # Blocks in the order they are drawn: those of pass 0, of pass 1, ..., each pass in permuted order.
    blocks = passes_of(drawn).groupBy("source", "copy", "block").agg(F.sum("words").alias("words")).withColumn("one", F.lit(1).cast("long"))
    blocks = staged(prefix_sums(blocks, ["copy", "block"], "one", "turn", by="source"), "mix-blocks")
    found = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    shards = max(1, -(-sum(r["words"] for r in found) // shard_words))
    numbers = spark.createDataFrame([(r["source"], i) for i, r in enumerate(found)], "source string, number long")
    runs = prefix_sums(shard_runs(spark, [r["n"] for r in found], shards), ["shard"], "n", "begin", by="number")
    runs = runs.select("number", F.explode(F.expr("sequence(begin, begin + n - 1)")).alias("turn"), "shard")
    other = numbers.withColumnRenamed("source", "_s")
    numbered = blocks.join(other, blocks["source"].eqNullSafe(F.col("_s"))).drop("_s")
    placed = numbered.join(runs, ["number", "turn"]).select(
        F.col("source").alias("_s"), F.col("copy").alias("_c"), F.col("block").alias("_b"), "shard"
    )
    return staged(placed, "mix-placed"), shards


def with_shard(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """``pieces`` with their shard and ``turn``, by which (and ``_mix_row``) a shard's documents are ordered."""
    of_block = pieces["source"].eqNullSafe(F.col("_s")) & (F.col("copy") == F.col("_c")) & (F.col("block") == F.col("_b"))
    small = F.broadcast(placed) if placed.count() <= BROADCAST_BLOCKS else placed
    return pieces.join(small, of_block).drop("_s", "_c", "_b").withColumn("turn", F.md5(F.concat_ws("|", "shard", "copy", "key")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(mix, rows)``.

    ``mix``: ``shard, position, _mix_row, doc_id, copy, size, words`` of every document
    taken, ``words`` being its size unless it is cut. ``rows``: all documents,
    as ``sized``, with the plan of their source.
    """
    rows = staged(sized(docs), "mix-rows")
    plan = source_plan(rows, weights, share, most)
    drawn = staged(taken_words(rows, plan), "mix-drawn")
    out = with_shard(passes_of(drawn), shard_plan(drawn, shard_words)[0])
    order = W.partitionBy("shard").orderBy("turn", "_mix_row")
    out = out.withColumn("position", F.row_number().over(order).cast("long") - 1)
    return out.select("shard", "position", "_mix_row", "doc_id", "copy", "size", "words"), with_plan(rows, plan)


def mix_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document; ``taken`` adds up its rows of the mix.

    The mix is written with its shards and positions, and read back for the sums.
    """
    mixed, rows = mix(docs)
    taken = staged(mixed, "mix-shards").groupBy("_mix_row").agg(F.sum("words").alias("_taken"))
    found = rows.join(taken, "_mix_row", "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, shard_words: int = SHARD_WORDS, files: int = 10_000
) -> DataFrame:
    """The documents of the mix with the columns of ``docs``: partition i is shard i, in the order of ``mix``.

    More than ``files`` shards: each partition has a run of whole shards, one after another.
    A document that is cut keeps its text up to its last word taken, and
    ``n_chars``, if there, follows. Copies are rows of their own.

    Texts are shuffled once, to their shards: a document's block follows from
    its key, and which documents of the partial pass are taken, from the last of them in each source.
    """
    own = [F.col(c).alias(f"_of_{c}") for c in docs.columns]
    kept = staged(docs.select(F.monotonically_increasing_id().alias("_mix_row"), F.struct(*sized_columns()).alias("_mix"), *own), "mix-documents")
    rows = kept.select("_mix_row", "_mix.*")
    plan = source_plan(rows, weights, share, most)
    drawn = staged(taken_words(rows, plan), "mix-drawn")
    placed, shards = shard_plan(drawn, shard_words)
    last = drawn.where("first > 0").groupBy(F.col("source").alias("_l")).agg(F.max(F.struct("block", "key", "_mix_row", "first")).alias("last"))
    ends = staged(plan.join(last, plan["source"].eqNullSafe(F.col("_l")), "left").drop("_l"), "mix-ends")
    full = with_block(with_plan(kept.select("_mix_row", "_mix.*", *[f"_of_{c}" for c in docs.columns]), ends))
    at = F.struct("block", "key", "_mix_row")
    end = F.struct(*[F.col(f"last.{c}").alias(c) for c in ("block", "key", "_mix_row")])
    first = F.when(F.col("last").isNull() | (at > end), F.lit(0)).when(at < end, F.col("size")).otherwise(F.col("last.first"))
    out = with_shard(passes_of(full.withColumn("first", first.cast("long"))), placed)
    words = F.regexp_extract_all("_of_text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.col("words") < F.col("size")
    text = F.when(cut, F.array_join(F.slice(words, 1, F.col("words").cast("int")), "")).otherwise(F.col("_of_text"))
    out = out.withColumn("_of_text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("_of_n_chars", F.when(cut, F.length("_of_text").cast(kind)).otherwise(F.col("_of_n_chars")))
    parts = min(shards, files)
    needed = out.select("shard", "turn", "_mix_row", *[f"_of_{c}" for c in docs.columns])
    dealt = needed.repartitionById(parts, F.expr(f"cast(shard * {parts} div {shards} as int)"))
    ordered = dealt.sortWithinPartitions("shard", "turn", "_mix_row")
    return ordered.select(*[F.col(f"_of_{c}").alias(c) for c in docs.columns])


def oracle() -> str:
    """DuckDB SQL for the digest: the cap that holds is found on the sources in order of cap by weight."""
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, {MOST}::DOUBLE * source_size AS cap,
    [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS i FROM w),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM o),
u AS (SELECT min_by(unit, i) AS unit, min(i) AS first_open FROM
    (SELECT i, cap, weight, ({SHARE}::DOUBLE * (SELECT sum(source_size) FROM s) - cap_before) / weight_left AS unit FROM c) WHERE unit * weight < cap),
t AS (SELECT source, source_size, CASE WHEN first_open IS NULL OR i < first_open THEN cap ELSE unit * weight END AS target FROM c, u),
p AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), CAST(floor({MOST}::DOUBLE * source_size) AS BIGINT)) AS take FROM t),
f AS (SELECT d.*, p.source_size, p.target, CASE WHEN p.source_size = 0 THEN 0 ELSE take // p.source_size END AS passes, take,
    sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id) - size AS start FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(passes * size + greatest(0, least(size, take - passes * source_size - start)) AS BIGINT) AS taken FROM f"""
