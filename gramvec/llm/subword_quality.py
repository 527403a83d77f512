"""Quality classifier on learned subword embeddings.

A text's features are its words, its pairs of adjacent words (a word said
twice is the same pair whatever the word) and all its character n-grams
(lengths ``GRAMS``, white space as a space), hashed to ``BUCKETS``. Each bucket has a learned vector; the text's vector is the mean
over all its features, and a softmax over the classes follows. Vectors and
output weights are trained by stochastic gradient descent in numpy (one
document a step, step sizes adapted per row, linearly falling) on documents
with a label outside the held-out fold.

Training looks at no more than ``LABELLED`` documents, those whose id hashes
lowest; of each only counts per bucket travel, to one task. Everything else
covers all rows. Texts are cut at a space about every ``PART`` characters, so
memory doesn't grow with a text; n-grams don't run across a cut.

A null text is an empty one; a text without features has the score of the
intercept alone. Labels that are null, of unknown documents or contradictory
for one doc_id are left out, as are rows without doc_id; of rows that repeat a
doc_id one is learned from, and each is scored. Without labels of both kinds
the score is the share of the one kind there is, or 0.5. A null doc_id counts
as the empty text in the split. Extra columns are ignored; an empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramvec.llm.common import shipped

GRAMS = (2, 3, 4)
BUCKETS = 1 << 16
DIM = 8
LABELLED = 8_000
STEPS, RATE = 24_000, 1.0
#: What a row's step size starts from: rows seen rarely don't take large steps.
FLOOR = 0.1
THRESHOLD = 0.3
FOLDS, HELD = 5, 0
#: Characters that are hashed at once.
PART = 1 << 16

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Powers of the (odd) multiplier and of its inverse modulo 2^64: the hash of any run follows from prefix sums.
_POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(PART, _MULT))])
_INVERSE = np.concatenate([[np.uint64(1)], np.cumprod(np.full(PART, np.uint64(pow(int(_MULT), -1, 1 << 64))))])


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _MIX
    return ((h ^ (h >> np.uint64(32))) * _MULT >> np.uint64(48)).astype(np.uint16)


def parts(text: str) -> Iterator[str]:
    """``text`` in pieces of at most ``PART`` characters, cut at a space where there is one."""
    at = 0
    while at < len(text):
        to = at + PART
        if to < len(text):
            to = max(text.rfind(" ", at + 1, to), text.rfind("\n", at + 1, to), -1)
            to = at + PART if to < 0 else to
        yield text[at:to]
        at = to


def features(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all features, array by array."""
    for part in parts(text or ""):
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = (code == 32) | ((code >= 9) & (code <= 13))
        code = np.where(space, np.uint64(32), code.astype(np.uint64))
        run = code * _MULT
        for n in range(2, max(GRAMS) + 1):
            run = run[: len(code) - n + 1] if len(code) >= n else run[:0]
            run = (run ^ (run >> np.uint64(29))) * _MULT + code[n - 1 :] if len(run) else run
            if n in GRAMS and len(run):
                yield _bucket(run, n)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        first, last = edge[0::2], edge[1::2]
        if len(first):
            prefix = np.concatenate([[np.uint64(0)], np.cumsum((code + np.uint64(1)) * _POWERS[: len(code)])])
            word = (prefix[last] - prefix[first]) * _INVERSE[first]
            yield _bucket(word, 1000)
            if len(word) > 1:
                pair = (word[:-1] ^ (word[:-1] >> np.uint64(31))) * _MIX + word[1:]
                yield _bucket(np.where(word[:-1] == word[1:], np.uint64(0), pair), 2000)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and how often each occurs."""
    counts = np.zeros(BUCKETS, np.int64)
    for found in features(text):
        counts += np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.uint16), counts[at].astype(np.float32)


class Model:
    """Vectors per bucket, output weights and intercept per class."""

    def __init__(self, vectors: np.ndarray, output: np.ndarray, intercept: np.ndarray):
        self.vectors, self.output, self.intercept = vectors, output, intercept
        # of two classes only the difference of their logits matters: a number per bucket
        self.weight = (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32)
        self.base = float(intercept[1] - intercept[0])

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for found in features(text):
            total += float(self.weight[found].sum(dtype=np.float64))
            n += len(found)
        return float(1 / (1 + np.exp(-np.clip(self.base + total / max(1, n), -500, 500))))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = STEPS, rate: float = RATE, dim: int = DIM, seed: int = 7) -> Model:
    """Stochastic gradient descent over the bags in drawn order, passes repeated until ``steps`` steps are done."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output, intercept = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    seen_v, seen_o, seen_i = np.full(BUCKETS, FLOOR, np.float32), np.full((dim, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    kinds = np.unique(labels)
    if len(kinds) < 2:
        intercept[:] = 0 if not len(kinds) else np.where(np.arange(2) == kinds[0], 250, -250)
        return Model(vectors, output, intercept)
    weights = [c / max(1.0, float(c.sum())) for _, c in bags]
    done = 0
    while done < steps:
        for i in rng.permutation(len(bags)):
            pace = rate * (1 - done / steps)
            at, w = bags[i][0], weights[i]
            rows = vectors[at]
            hidden = w @ rows if len(at) else np.zeros(dim, np.float32)
            z = hidden @ output + intercept
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            back = output @ error
            if len(at):
                slope = w * np.float32(np.sqrt(back @ back))
                seen_v[at] += slope * slope
                vectors[at] = rows - (pace * w / np.sqrt(seen_v[at]))[:, None] * back
            grad = np.outer(hidden, error)
            seen_o += grad * grad
            output -= pace * grad / np.sqrt(seen_o)
            seen_i += error * error
            intercept -= pace * error / np.sqrt(seen_i)
            done += 1
            if done >= steps:
                break
    return Model(vectors, output, intercept)


# ------------------------------------------------------------------------ Spark
def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def labelled(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """``at, label, buckets, counts`` of at most ``most`` training documents."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
        .where("lo = hi")
        .select("doc_id", (F.col("lo") > 0).cast("int").alias("label"), F.xxhash64("doc_id").alias("at"))
        .orderBy("at", "doc_id")
        .limit(most)
    )
    # ``most`` rows of three numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                bags = [bag(t) for t in some.column("text").to_pylist()]
                yield pa.record_batch(
                    [some.column("at"), some.column("label"), pa.array([a.tobytes() for a, _ in bags], pa.binary()), pa.array([c.tobytes() for _, c in bags], pa.binary())],
                    ["at", "label", "buckets", "counts"],
                )

    bags = shipped(rows).select("at", "label", "text").mapInArrow(count, "at long, label int, buckets binary, counts binary")
    return bags.groupBy("at").agg(F.min(F.struct("label", "buckets", "counts")).alias("b")).select("at", "b.*")


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED, steps: int = STEPS, rate: float = RATE, dim: int = DIM) -> Model:
    """The model of the bounded sample, trained in one task."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        bags = [(np.frombuffer(b, np.uint16), np.frombuffer(c, np.float32)) for b, c in zip(group["buckets"], group["counts"])]
        m = train(bags, group["label"].to_numpy(), steps, rate, dim)
        return pd.DataFrame([{"vectors": m.vectors.tobytes(), "output": m.output.tobytes(), "intercept": m.intercept.tobytes()}])

    fitted = labelled(docs, labels, most).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "vectors binary, output binary, intercept binary").first()
    if fitted is None:
        return train([], np.zeros(0, np.int64), dim=dim)
    read = [np.frombuffer(fitted[c], np.float32) for c in ("vectors", "output", "intercept")]
    return Model(read[0].reshape(BUCKETS, dim), read[1].reshape(dim, 2), read[2])


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; only the text is looked at."""
    small = Model.__new__(Model)
    small.weight, small.base = model.weight, model.base  # a number per bucket is all that a score needs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([small.score(t.as_py()) for t in batch.column("text")], np.float64)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(F.col("doc_id")) == HELD).alias("held_out"))
    return shipped(rows).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled documents of the training folds and score every document."""
    return scored(docs, learn(docs, labels))
