"""Near-duplicates by SimHash fingerprints and pivot distance tables.

Fingerprint: the text with A-Z in lower case gives words, its runs of
``SHINGLE`` words (fewer words: the whole sequence) are hashed by XXH64, and a
bit is 1 if it is set in over half of the hashes. No words: fingerprint zero.
Equal fingerprints form one class, and all further work is on classes.

Pivot tables: the Hamming distance of every fingerprint to fixed reference
fingerprints. For each of ``BLOCKS`` blocks of bits there are ``PER_BLOCK``
references that differ from a base reference inside that block only, so their
distances minus the base's depend on that block alone. Two fingerprints within
``MAX_BITS`` = 2 differ in two blocks at most and have the same relative
coordinates in three of the five: classes meet under each choice of three
blocks. Said plainly, these coordinates spell out a block's bits: candidates
come from agreeing blocks, written as distances to pivots, and the maximum
coordinate difference only discards. Among those that meet, ``SPREAD`` further references all over the 64
bits discard each pair whose coordinates differ by more than ``MAX_BITS``
anywhere (the distance to a reference can't change by more than the distance of
the pair), and the survivors are verified by their differing bits. No link is
lost. A meeting place holds 2^26 classes at most, since 38 bits agree, and
each has 351 links there at most; of these only a spanning forest leaves the task.

Components come from alternating large-star and small-star steps on tables
that are written to the shared folder after each step.

Null and empty texts have fingerprint zero, linked like any other. A null
doc_id belongs to its component but never names it, unless all are null
(component_id null). Repeated rows are each returned. An empty table gives no
row; extra columns are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramvec.llm.common import fresh, partitions, shipped, staged
from gramvec.operators.joins import hot_keys, salted_join

SHINGLE, SEED, MAX_BITS = 3, 42, 2
BLOCKS, PER_BLOCK, SPREAD = (13, 13, 13, 13, 12), 16, 16
#: Shingles that are counted at once, and pairs that are held before they are united.
PART, HELD = 1 << 16, 1 << 20


# ------------------------------------------------------------- fingerprints
def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), PART):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans[at : at + PART]], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``fp``, the fingerprint of ``text`` as a signed long."""

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(made)], [*keep, "fp"])

    rows = docs.select(*[F.col(c).cast("long") for c in keep], "text")
    return shipped(rows).mapInArrow(run, ", ".join(f"{c} long" for c in [*keep, "fp"]))


# -------------------------------------------------------------- pivot tables
def references() -> tuple[np.uint64, np.ndarray, np.ndarray]:
    """The base, ``PER_BLOCK`` references for each block (rows of blocks), and ``SPREAD`` ones."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    base = rng.integers(0, 1 << 64, dtype=np.uint64)
    rows, low = [], 0
    for bits in BLOCKS:
        masks = rng.integers(1, 1 << bits, PER_BLOCK, dtype=np.uint64)
        masks[: min(bits, PER_BLOCK)] = np.uint64(1) << np.arange(min(bits, PER_BLOCK), dtype=np.uint64)
        rows.append(base ^ (masks << np.uint64(low)))
        low += bits
    return base, np.array(rows), rng.integers(0, 1 << 64, SPREAD, dtype=np.uint64)


BASE, BLOCK_REFERENCES, SPREAD_REFERENCES = references()


def distances(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Pivot table: Hamming distances, a row per fingerprint."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def meeting_keys(fps: np.ndarray) -> np.ndarray:
    """A key per fingerprint and choice of three blocks, from the relative coordinates of these blocks."""
    to_base = distances(fps, np.array([BASE]))
    mixed = []
    for refs in BLOCK_REFERENCES:
        h = np.zeros(len(fps), np.uint64)
        for column in (distances(fps, refs) - to_base + 32).T:
            h = (h ^ column.astype(np.uint64)) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        mixed.append(h)
    keys = []
    for n, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_BITS)):
        h = np.full(len(fps), n + 1, np.uint64)
        for b in chosen:
            h = (h ^ mixed[b]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        keys.append(h)
    return np.array(keys).T.reshape(len(fps), -1)


class Forest:
    """Union of pairs of positions, each named by the smallest position reached."""

    def __init__(self, n: int):
        self.root, self.left, self.right, self.held = np.arange(n), [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.left.append(a)
        self.right.append(b)
        self.held += len(a)
        if self.held >= HELD:
            self.unite()

    def unite(self) -> np.ndarray:
        if self.held:
            a, b = np.concatenate(self.left), np.concatenate(self.right)
            while True:
                x, y = self.root[a], self.root[b]
                if (x == y).all():
                    break
                np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
                while (self.root[self.root] != self.root).any():
                    self.root = self.root[self.root]
            self.left, self.right, self.held = [], [], 0
        return self.root


def linked(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of fingerprints that meet under a key and are within ``MAX_BITS``."""
    table = distances(fps, SPREAD_REFERENCES)
    order = np.lexsort((table[:, 0], keys))
    keys, fps, table = keys[order], fps[order], table[order]
    forest, at = Forest(len(fps)), np.arange(len(fps))
    step = 0
    while len(at):
        step += 1
        at = at[at + step < len(fps)]
        # partners of a key are sorted by their first coordinate: once too far apart, the later ones are too
        near = (keys[at] == keys[at + step]) & (table[at + step, 0] - table[at, 0] <= MAX_BITS)
        at = at[near]
        a, b = at, at + step
        for p in range(1, SPREAD):
            if not len(a):
                break
            ok = np.abs(table[a, p] - table[b, p]) <= MAX_BITS
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fps[a] ^ fps[b]) <= MAX_BITS
        if ok.any():
            forest.add(a[ok], b[ok])
    root = forest.unite()
    child = np.flatnonzero(root != np.arange(len(root)))
    return fps[child], fps[root[child]]


def links(classes: DataFrame) -> DataFrame:
    """``(u, v)``: links that connect all classes (column ``fp``) within ``MAX_BITS`` of each other."""

    def meet(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            keys = meeting_keys(fps)
            yield pa.record_batch(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(fps, keys.shape[1]).view(np.int64))], ["key", "fp"]
            )

    def compare(batches):
        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            keys, fps = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "fp")))
            cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last key may go on
            held = keys[cut:], fps[cut:]
            yield out(keys[:cut], fps[:cut])
        yield out(*held)

    def out(keys, fps):
        same = np.zeros(len(keys), bool)
        same[1:] |= keys[1:] == keys[:-1]
        same[:-1] |= keys[1:] == keys[:-1]
        u, v = linked(keys[same], fps[same].view(np.uint64))
        return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    n = partitions(classes.sparkSession)
    met = classes.select("fp").mapInArrow(meet, "key long, fp long").repartition(n, "key").sortWithinPartitions("key")
    return met.mapInArrow(compare, "u long, v long")


# -------------------------------------------------------------- components
def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` for every node of ``edges`` (u, v) but the roots; the root is the smallest node of its component."""

    def oriented(df):
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def sum_of(df):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = staged(oriented(edges), "links")
    seen = sum_of(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = staged(oriented(small), "small-star")
        last, seen = seen, sum_of(now)
        if last == seen:
            return now.withColumnRenamed("v", "root")


def named_classes(fps: DataFrame) -> DataFrame:
    """``fp, first, n, root`` of each distinct fingerprint; ``root`` is the fingerprint that names its component."""
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    stars = components(links(classes))
    joined = classes.join(stars, classes["fp"] == stars["u"], "left")
    return staged(joined.select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "named")


def _beside(fps: DataFrame, named: DataFrame, column: str, salt: str) -> DataFrame:
    """``fps`` with ``column`` of its class; the rows of a fingerprint that very many have are salted by ``salt``."""
    side = named.select(F.col("fp").alias("_fp"), column)
    return salted_join(fps, side, "fp", "_fp", hot_keys(named, "fp", "n"), [salt]).drop("_fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    fps = staged(fingerprints(docs), "fingerprints")
    named = named_classes(fps)
    first = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = staged(named.join(first, "root").select("fp", "n", "component_id"), "component-ids")
    found = _beside(fps, named, "component_id", "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all columns: that of the smallest doc_id (null last), of equal ones the first row."""
    row = fresh(docs, "_near_row")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "near-documents")
    fps = staged(fingerprints(rows, (row, "doc_id")), "fingerprints")
    rooted = _beside(fps, named_classes(fps), "root", row)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    kept = rooted.groupBy("root").agg(F.min(order)[row].alias(row)).select(row)
    return rows.join(kept, row, "left_semi").select(*docs.columns)
