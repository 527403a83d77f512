"""Skip-gram pairs, repeated passes, subsampling and label lookup."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramvec.functions.hashing import hash_uniform
from gramvec.operators.joins import bounded_join
from gramvec.params import DEFAULTS

PAIR_KEY = ["pass", "doc_id", "sent_idx", "pos", "off"]

# bytes per vocabulary row used for the broadcast bound (word, id, count, drop_p)
VOCAB_ROW_BYTES = 96


def _u(seed: int, tag: str, *cols) -> F.Column:
    return hash_uniform(F.lit(int(seed)), F.lit(tag), *cols)


def skipgram_pairs(sents: DataFrame, skip_window: int, seed: int, passes: int = 1) -> DataFrame:
    """``pairs(pass, doc_id, sent_idx, pos, off, target, context)``.

    Per target occurrence a window width ``1..skip_window`` is drawn once
    (key: seed, 'win', pass, doc_id, sent_idx, pos); the neighbours are one
    ``slice`` of the sentence array clipped to the sentence, exploded with
    their offset. No shuffle, and no per-token copy of the sentence array.
    With ``passes > 1`` each pass is a new set of draws (U2).
    """
    tok = sents.where(F.size("words") > 0).select(
        "doc_id", "sent_idx", "words", F.posexplode("words").alias("pos", "target")
    )
    if passes > 1:
        tok = tok.select("*", F.explode(F.sequence(F.lit(0), F.lit(int(passes) - 1))).alias("pass"))
    else:
        tok = tok.withColumn("pass", F.lit(0))
    # the width is exploded and the slice made inside the generator, so that no filter made from the explode draws again
    win = (F.lit(1) + F.floor(_u(seed, "win", "pass", "doc_id", "sent_idx", "pos") * int(skip_window))).cast("int")
    w = tok.select("pass", "doc_id", "sent_idx", "pos", "target", "words", F.explode(F.array(win)).alias("win"))
    lo = F.greatest(F.col("pos") - F.col("win"), F.lit(0))
    hi = F.least(F.col("pos") + F.col("win"), F.size("words") - 1)
    near = F.slice("words", lo + 1, hi - lo + 1)
    ex = w.select("pass", "doc_id", "sent_idx", "pos", "target", lo.alias("lo"), F.posexplode(near).alias("j", "context"))
    off = (F.col("lo") + F.col("j") - F.col("pos")).cast("int")
    return ex.select("pass", "doc_id", "sent_idx", "pos", off.alias("off"), "target", "context").where(F.col("off") != 0)


# bytes per row of the frequent words (word, drop_p)
FREQUENT_ROW_BYTES = 64


def _with_drop_p(pairs: DataFrame, frequent: DataFrame, column: str, name: str, threshold: float) -> DataFrame:
    """``pairs`` with ``name``: ``drop_p`` of ``column`` where it is a frequent word.

    Fewer than ``1 / threshold`` words are frequent; the join is a broadcast
    while that bound fits.
    """
    side = frequent.select(F.col("word").alias(column), F.col("drop_p").alias(name))
    return bounded_join(pairs, side, column, math.ceil(1 / threshold), FREQUENT_ROW_BYTES, "left")


def subsample(pairs: DataFrame, frequent: DataFrame, seed: int, threshold: float = DEFAULTS["rejection_threshold"]) -> DataFrame:
    """drop a pair if ``u_t < drop_p(target)`` or ``u_c < drop_p(context)``.

    Only frequent words (``drop_p > 0``) can be dropped, so only they are
    joined and only their draws computed. A pair that its target drops does
    not reach the join on the context.
    """
    p = _with_drop_p(pairs, frequent, "target", "_dp_t", threshold)
    p = p.where(F.col("_dp_t").isNull() | (_u(seed, "sub_t", *PAIR_KEY) >= F.col("_dp_t")))
    p = _with_drop_p(p, frequent, "context", "_dp_c", threshold)
    p = p.where(F.col("_dp_c").isNull() | (_u(seed, "sub_c", *PAIR_KEY) >= F.col("_dp_c")))
    return p.select(*PAIR_KEY, "target", "context")


def _vocab_join(pairs: DataFrame, side: DataFrame, vocabulary_size: int, frequent: DataFrame | None) -> DataFrame:
    """Join on ``context`` with at most ``vocabulary_size`` rows; frequent contexts are salted if that is no broadcast."""
    from gramvec.operators.samples import hot_targets

    hot = None if frequent is None else hot_targets(frequent)
    return bounded_join(pairs, side, "context", vocabulary_size, VOCAB_ROW_BYTES, hot=hot)


def lookup_label(pairs: DataFrame, vocab: DataFrame, vocabulary_size: int, frequent: DataFrame | None = None) -> DataFrame:
    """``label`` = vocabulary id of the context; out-of-vocabulary contexts vanish."""
    side = vocab.select(F.col("word").alias("context"), F.col("word_id").alias("label"))
    return _vocab_join(pairs, side, vocabulary_size, frequent).select(*PAIR_KEY, "target", "label")
