"""Language identification by error-correcting output codes.

Each learned language has a codeword of ``bits`` bits. One binary classifier
per bit tells the languages with a 1 there from those with a 0 by hashed
character n-grams (lengths ``GRAMS``, lower case, words padded with a space):
its weight for an n-gram is the log ratio of the smoothed n-gram frequencies
of the two groups. A text's margin for a bit is the mean weight of its
n-grams. Decoding takes the language with the least loss, where bit b with
margin m costs ``reliability[b] * log(1 + exp(-SHARP * y * m))``, y being the
codeword's bit as +1 or -1; reliability is the bit's accuracy, above chance, on
one tenth of the training documents by the weights of the other nine. ``score`` is the share of
exp(-loss) that the chosen language has; a text is ``ambiguous`` if the
runner-up's loss is within ``MARGIN``.

Weights come from counts over the whole texts of all training documents, that
tenth included, summed by Spark to one row of counts per language.

A text that is null or has no letter is ``und`` with score 0, as is every text
if nothing was learned. A null doc_id counts as the empty text in the split.
Very long texts are counted in parts. Repeated rows are each predicted; extra
columns are ignored; an empty table gives no row. Ties go to the language that
comes first in code-point order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramvec.llm.common import shipped

GRAMS = (1, 2, 3)
BUCKETS = 1 << 15
SHARP, MARGIN = 4.0, 0.5
#: Characters that are hashed at once.
PART = 1 << 20
FOLDS, HELD = 5, 0
UNKNOWN = "und"


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the lower-case text, in parts."""
    low = text.lower()
    most = max(GRAMS)
    for at in range(0, max(1, len(low)), PART):
        part = (" " if at == 0 else "") + low[max(0, at - most + 1) if at else 0 : at + PART] + (" " if at + PART >= len(low) else "")
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        code = np.where((code >= 9) & (code <= 13), np.uint64(32), code)
        mixed = np.zeros(len(code), np.uint64)
        for n in range(1, most + 1):
            # the hash of the n-gram that ends at each character
            mixed = np.concatenate([[np.uint64(0)], mixed[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + code + np.uint64(n)
            if n in GRAMS and len(code) >= n:
                skip = n - 1 if at == 0 else most - 1
                h = mixed[skip:] * np.uint64(0xFF51AFD7ED558CCD)
                yield ((h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(49)).astype(np.int64)


def codewords(n: int, bits: int | None = None) -> np.ndarray:
    """``n`` codewords as rows of +1 and -1: bits drawn by hash, chosen for distance; each bit splits the languages."""
    bits = bits or max(7, 4 * max(1, n - 1).bit_length() + 3)
    rng = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(f"codes|{n}|{bits}".encode()).digest()[:8], "big")))
    best, apart = np.ones((n, bits), np.int64), -1
    if n < 2:
        return best
    for _ in range(200):
        code = np.where(rng.random((n, bits)) < 0.5, 1, -1)
        flat = np.abs(code.sum(0)) == n
        code[rng.integers(n), flat] *= -1
        distance = (code[:, None] != code[None]).sum(2) + bits * np.eye(n, dtype=int)
        if distance.min() > apart:
            best, apart = code, int(distance.min())
    return best


class Model:
    """Languages, codewords, weights per bucket and bit, reliability per bit."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
        # languages weigh alike within their group, however many texts they have
        self.weights = np.zeros((BUCKETS, self.code.shape[1]), np.float32)
        for b in range(self.code.shape[1]):
            one, other = self.code[:, b] > 0, self.code[:, b] < 0
            if one.any() and other.any():
                self.weights[:, b] = np.log(share[one].mean(0)) - np.log(share[other].mean(0))
        self.reliability = np.ones(self.code.shape[1])

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for buckets in grams(text):
            total += self.weights[buckets].sum(0, dtype=np.float64)
            n += len(buckets)
        return total / max(1, n)

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is ambiguous."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        loss = np.logaddexp(0.0, -SHARP * self.code * self.margins(text)) @ self.reliability
        order = np.argsort(loss, kind="stable")
        odds = np.exp(loss[order[0]] - loss)
        close = len(order) > 1 and loss[order[1]] - loss[order[0]] < MARGIN
        return self.languages[order[0]], float(1 / odds.sum()), bool(close)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def counted(train: DataFrame) -> DataFrame:
    """``lang, main, aside``: n-gram counts of the documents of each language, nine tenths and one tenth apart."""
    rows = train.select("lang", "text", aside().alias("aside"))

    def count(batches):
        held: dict[tuple[str, bool], np.ndarray] = {}
        for batch in batches:
            for lang, text, aside in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, aside) not in held:
                    held[lang, aside] = np.zeros(BUCKETS, np.int64)
                for buckets in grams(text):
                    held[lang, aside] += np.bincount(buckets, minlength=BUCKETS)
        for (lang, aside), n in held.items():
            at = np.flatnonzero(n)
            # a text without letters or other characters still makes its language known
            at = at if len(at) else np.zeros(1, np.int64)
            made = [pa.array([lang] * len(at), pa.string()), pa.array([aside] * len(at), pa.bool_()), pa.array(at), pa.array(n[at])]
            yield pa.record_batch(made, ["lang", "aside", "bucket", "n"])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((2, BUCKETS), np.int64)
        out[rows["aside"].to_numpy(np.int64), rows["bucket"]] = rows["n"]
        return pd.DataFrame([{"lang": rows["lang"].iloc[0], "main": out[0].tobytes(), "aside": out[1].tobytes()}])

    summed = shipped(rows).mapInArrow(count, "lang string, aside boolean, bucket long, n long").groupBy("lang", "aside", "bucket").agg(F.sum("n").alias("n"))
    return summed.groupBy("lang").applyInPandas(pack, "lang string, main binary, aside binary")


def aside() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0


def learn(docs: DataFrame) -> Model:
    """Fit on text and non-null lang of the documents outside fold ``HELD``.

    A task sends one row per language, part and n-gram bucket; the driver
    receives a row of counts per language. Reliabilities come from the weights
    without the tenth set aside; the model's own weights from all.
    """
    train = docs.where((fold(F.col("doc_id")) != HELD) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = sorted(counted(train).collect(), key=lambda r: r["lang"])
    languages = [r["lang"] for r in rows]
    main, rest = (np.array([np.frombuffer(r[c], np.int64) for r in rows]).reshape(len(rows), BUCKETS) for c in ("main", "aside"))
    if not languages:
        return Model(languages, main)
    model = Model(languages, main)
    seen = main.sum(1) > 0

    def test(batches):
        bits = model.code.shape[1]
        right, total = np.zeros(bits, np.int64), 0
        number = {x: i for i, x in enumerate(languages) if seen[i]}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                if lang in number:
                    right += np.sign(model.margins(text)) == model.code[number[lang]]
                    total += 1
        yield pa.record_batch([pa.array(range(bits), pa.int64()), pa.array(right), pa.array([total] * bits, pa.int64())], ["bit", "n", "total"])

    tested = train.where(aside()).select("lang", "text").mapInArrow(test, "bit long, n long, total long")
    whole = Model(languages, main + rest)
    for r in tested.groupBy("bit").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        if r["total"]:
            whole.reliability[r["bit"]] = max(0.05, 2 * r["n"] / r["total"] - 1)
    return whole


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous``; only the text is looked at."""

    def run(batches):
        for batch in batches:
            found = [model.decode(t) for t in batch.column("text").to_pylist()]
            langs, scores, close = zip(*found) if found else ([], [], [])
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text", (fold(F.col("doc_id")) == HELD).alias("held_out"))
    return shipped(rows).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the training folds and predict every document."""
    return predict(docs, learn(docs))
