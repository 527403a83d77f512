"""Quality rules whose cutoffs carry a proven limit on false rejections.

Each document gets counts over its whole text. Fixed base rules reject short
and repetitive texts. Beside them, ``RULES`` are ratios with a cutoff per
stratum (the language), chosen from labels in three steps:

1. One half of the labelled documents (by a hash of doc_id) proposes nested
   sets of cutoffs: a level (share, factor) puts each rule's cutoff at factor
   times the 1 - share quantile of the good documents, so later levels reject
   more.
2. The other half tests the levels of a stratum in that order. Level k holds
   if the exact binomial (Clopper-Pearson) upper bound on the share of good
   documents that it rejects is at most ``alpha``; the first failure ends the
   test (fixed-sequence testing). ``delta`` is split evenly over the strata
   (Bonferroni), so with probability 1 - delta no stratum loses more than
   ``alpha`` of its good documents to the learned rules.
3. Of the levels that hold, the most lenient one that rejects nearly all the
   bad documents any of them rejects (``ENOUGH``) is used. A stratum whose
   labels prove nothing has base rules alone.

Null text counts as no words (rejected as too short); a null language is a
stratum of its own; labels that are null, of unknown documents or
contradictory for one doc_id are left out; with no labels only base rules
hold. Repeated rows and extra columns pass through unchanged.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramvec.llm.common import WORD, fresh, shipped, staged

WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
WINDOW = 8
ALPHA, DELTA = 0.05, 0.05
#: Share of good documents beyond a rule's quantile, and factor on it, from lenient to strict.
LEVELS = ((0.0, 2.0), (0.0, 1.5), (0.0, 1.2), (0.0, 1.0), (0.0002, 1.0), (0.0005, 1.0), (0.001, 1.0), (0.002, 1.0), (0.005, 1.0), (0.01, 1.0))
ENOUGH = 0.995
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_exclaim", "n_capital"]
#: Ratios of the counts; a document is rejected above the cutoff.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "exclaim": ("n_exclaim", "n_words"),
    "capital": ("n_capital", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "short_words": ("n_words", "word_chars"),
    "sameness": ("n_words", "n_distinct"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}


def repeated_words(words: list[str]) -> int:
    """Words inside windows of ``WINDOW`` words that occur twice or more (exact: windows are ranked by doubling)."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(ids) == n:
        return 0
    rank = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    width, kinds = 1, len(ids)
    while width < WINDOW:
        pairs = rank[:-width] * kinds + rank[width:]
        seen, rank, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        width, kinds = 2 * width, len(seen)
        if kinds == len(rank):
            return 0
    at = np.flatnonzero(counts[rank] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The ``COUNTS`` of a text."""
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        text.count("!"),
        sum(map(str.isupper, words)),
    )


def with_counts(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with the ``COUNTS`` of ``text`` as further columns, named with ``prefix``."""
    names = [prefix + c for c in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts_of(t) for t in batch.column("text").to_pylist()]
            made = np.array(rows, np.int64).reshape(len(rows), len(names))
            yield pa.record_batch([*batch.columns, *map(pa.array, np.ascontiguousarray(made.T))], [*batch.schema.names, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{c}` long" for c in names])
    return shipped(docs).mapInArrow(run, schema)


def base_failed(prefix: str = "") -> Column:
    words, repeats = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < 20) | (100 * repeats > 30 * words)


def ratios(prefix: str = "") -> dict[str, Column]:
    return {r: F.col(prefix + a) / F.greatest(F.col(prefix + b), F.lit(1)) for r, (a, b) in RULES.items()}


def stratum() -> Column:
    return F.coalesce(F.concat(F.lit("lang "), F.col("lang")), F.lit("none"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p)."""
    if k >= n:
        return 1.0
    i = np.arange(k, dtype=np.float64)
    logs = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((n - i) / (i + 1)) + math.log(p / (1 - p)))])
    top = logs.max()
    return min(1.0, float(np.exp(logs - top).sum() * math.exp(top)))


def holds(rejected: int, n: int, alpha: float, delta: float) -> bool:
    """Whether the exact upper ``1 - delta`` bound on the rejected share of ``n`` is at most ``alpha``."""
    return n > 0 and rejected < alpha * n and binomial_cdf(rejected, n, alpha) <= delta


def certified_cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict]:
    """Per stratum ``{"cutoffs": {rule: value} or None, "level": k, "n": good holdouts, "rejected": of them}``.

    ``stats`` has doc_id, lang and ``COUNTS``. Two aggregations run on Spark;
    a row per stratum comes to the driver.
    """
    label = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
        .where("lo = hi")
        .select("doc_id", (F.col("lo") > 0).alias("good"))
    )
    rows = staged(
        stats.where(~base_failed())
        .join(label, "doc_id")
        .select(stratum().alias("stratum"), "good", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("fit"), *[v.alias(r) for r, v in ratios().items()]),
        "quality-labelled",
    )
    points = F.array(*[F.lit(1 - q) for q, _ in LEVELS])
    fitted = (
        rows.where("fit and good")
        .groupBy("stratum")
        .agg(*[F.percentile_approx(r, points, 20_000).alias(r) for r in RULES])
    )
    cuts = {r["stratum"]: r.asDict() for r in fitted.collect()}
    over = []
    for k, (_, factor) in enumerate(LEVELS):
        found = F.lit(0)
        for name, cut in cuts.items():
            beyond = [F.when(F.col(r) > F.lit(cut[r][k] * factor), 1).otherwise(0) for r in RULES]
            found = F.when(F.col("stratum") == name, F.greatest(*beyond)).otherwise(found)
        over.append(F.sum(found).alias(f"over{k}"))
    tested = rows.groupBy("stratum", "good", "fit").agg(F.count(F.lit(1)).alias("n"), *over).collect()
    out = {}
    for name, cut in sorted(cuts.items()):
        of = {(r["good"], r["fit"]): [r["n"], *(r[f"over{k}"] for k in range(len(LEVELS)))] for r in tested if r["stratum"] == name}
        n, *rejected = of.get((True, False), [0] * (len(LEVELS) + 1))
        caught = of.get((False, True), [0] * (len(LEVELS) + 1))[1:]
        good = 0
        while good < len(LEVELS) and holds(rejected[good], n, alpha, delta / len(cuts)):
            good += 1
        level = next((k for k in range(good) if caught[k] >= ENOUGH * caught[good - 1]), None)
        out[name] = {
            "cutoffs": None if level is None else {r: float(cut[r][level]) * LEVELS[level][1] for r in RULES},
            "level": level,
            "n": n,
            "rejected": None if level is None else rejected[level],
        }
    return out


def learned_reject(cutoffs: dict[str, dict], prefix: str = "") -> Column:
    """Whether a rule's ratio is above its stratum's cutoff."""
    found, of = F.lit(False), ratios(prefix)
    for name, c in cutoffs.items():
        if c["cutoffs"]:
            over = F.greatest(*[F.when(of[r] > F.lit(v), 1).otherwise(0) for r, v in c["cutoffs"].items()]) > 0
            found = F.when(stratum() == name, over).otherwise(found)
    return found


def quality_verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``doc_id, lang``, the counts, ``base_failed`` and ``kept`` of every document."""
    stats = staged(with_counts(docs.select("doc_id", "lang", "text")).drop("text"), "quality-counts")
    cutoffs = certified_cutoffs(stats, labels, alpha, delta)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~learned_reject(cutoffs))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that pass, with their own columns.

    The counts are taken twice, once for the cutoffs and once beside the text,
    so that no text is shuffled.
    """
    stats = staged(with_counts(docs.select("doc_id", "lang", "text")).drop("text"), "quality-counts")
    cutoffs = certified_cutoffs(stats, labels, alpha, delta)
    p = fresh(docs, "_quality_")
    return with_counts(docs, p).where(~base_failed(p) & ~learned_reject(cutoffs, p)).select(*docs.columns)
