"""Dictionary-coded sentences: words meet their tables once per token, never per pair.

A dictionary row has all that pairs need of a word: its drop probability, its
vocabulary id and its n-gram buckets. Tokens are joined with it and put
together again as one row per sentence with parallel arrays, so that the pair
explode is narrow, decides subsampling and labels from the arrays, and has no
join above it. A window of ``w`` words makes about ``w + 1`` pairs a token, so
the joins see that many times fewer rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramvec.functions.hashing import TWO_POW_52
from gramvec.operators.joins import bounded_join
from gramvec.operators.pairs import PAIR_KEY, VOCAB_ROW_BYTES, _u
from gramvec.operators.samples import hot_targets
from gramvec.operators.text import WORD_MARK

SENTENCE_KEY = ["doc_id", "sent_idx", "row"]
#: Words of a chunk, into which a sentence is cut, so that no row grows with a text without marks.
CHUNK = 4096


def dictionary(dropp: DataFrame, vocab: DataFrame, vocabulary_size: int, buckets: DataFrame | None = None) -> DataFrame:
    """``(word, drop_p, label[, bucket_ids])``, one row per distinct word; ``label`` is null outside the vocabulary."""
    ids = vocab.select("word", F.col("word_id").alias("label"))
    out = bounded_join(dropp.select("word", "drop_p"), ids, "word", vocabulary_size, VOCAB_ROW_BYTES, "left")
    return out if buckets is None else out.join(buckets, "word")


#: Words of a piece, into which ``direct_pairs`` cuts a sentence: what it copies per word.
PIECE = 64


def known_words(vocab: DataFrame, frequent: DataFrame) -> DataFrame:
    """``(word, drop_at, label)`` of the vocabulary and the frequent words.

    All that pairs need: any other word is never dropped (``drop_at`` null) and
    has no label. The size is bounded by ``vocabulary_size + 1 / threshold``
    at any corpus size.
    """
    words = vocab.select("word", _drop_at(F.col("drop_p")).alias("drop_at"), F.col("word_id").alias("label"))
    rare = frequent.select("word", _drop_at(F.col("drop_p")).alias("drop_at")).join(words.select("word"), "word", "left_anti")
    return words.unionByName(rare.withColumn("label", F.lit(None).cast("int")))


def _drop_at(drop_p: Column) -> Column:
    """The least md5 whose uniform keeps a word, as hex digits: ``u >= drop_p`` if and only if ``md5 >= drop_at``.

    ``u`` is the first 13 digits over 2^52, a power of two, so this is exact.
    Null if the word is never dropped; beyond any digit if no draw keeps it.
    """
    at = F.ceil(drop_p * F.lit(TWO_POW_52)).cast("bigint")
    return F.when(drop_p > 0, F.when(at >= F.lit(int(TWO_POW_52)), F.lit("g")).otherwise(F.lower(F.lpad(F.hex(at), 13, "0"))))


def direct_pairs(
    sents: DataFrame, words: DataFrame, skip_window: int, seed: int, passes: int = 1, in_order: bool = False, piece: int = PIECE
) -> DataFrame:
    """The rows of ``coded_pairs`` straight from sentences, where ``known_words`` fit a broadcast: no token is shuffled.

    Each word is looked up once as a target and once per pair as a context.
    With ``in_order`` the sentences alone are dealt to ranges and sorted, so
    the pairs are in stream order. ``_key`` has a target's part of the draws'
    keys, made once for all its pairs.
    """
    w, piece = int(skip_window), max(int(piece), 2 * int(skip_window))
    rows = sents.where(F.size("words") > 0).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(int(passes) - 1))) if passes > 1 else F.lit(0))
    if in_order:
        key = [*(["pass"] if passes > 1 else []), *SENTENCE_KEY]
        n = int(sents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # the words travel as one string, a fraction of an array of strings in a shuffle; no word has the mark
        rows = rows.select(*key, F.array_join("words", WORD_MARK).alias("words")).repartitionByRange(n, *key).sortWithinPartitions(*key)
        rows = rows.select(*key, F.explode(F.array(F.split("words", WORD_MARK, -1))).alias("words"))
        rows = rows if "pass" in key else rows.withColumn("pass", F.lit(0))
    cut = rows.select("pass", "doc_id", "sent_idx", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(piece))).alias("start"))
    before = F.least(F.col("start"), F.lit(w))
    part = F.slice("words", F.col("start") - before + 1, before + F.lit(piece + w))
    cut = cut.select("pass", "doc_id", "sent_idx", "start", before.alias("halo"), F.explode(F.array(part)).alias("near"))
    tok = cut.select("pass", "doc_id", "sent_idx", "start", "halo", "near", F.posexplode("near").alias("at", "word"))
    tok = tok.where((F.col("at") >= F.col("halo")) & (F.col("at") < F.col("halo") + piece))
    tok = tok.withColumn("pos", F.col("start") - F.col("halo") + F.col("at"))
    # exploded, and sliced inside the generator below, so that no filter made from an explode draws again
    win = (F.lit(1) + F.floor(_u(seed, "win", "pass", "doc_id", "sent_idx", "pos") * w)).cast("int")
    drawn = F.struct(win.alias("win"), F.concat_ws("|", *(F.col(c).cast("string") for c in PAIR_KEY[:-1])).alias("key"))
    tok = tok.select("*", F.explode(F.array(drawn)).alias("drawn")).select("*", "drawn.win", F.col("drawn.key").alias("_key")).drop("drawn")
    tok = tok.join(F.broadcast(words.select("word", "drop_at")), "word", "left")
    lo = F.greatest(F.col("at") - F.col("win"), F.lit(0))
    hi = F.least(F.col("at") + F.col("win"), F.size("near") - 1)
    target = F.struct("word", "drop_at").alias("tgt")
    keys = ["pass", "doc_id", "sent_idx", "pos", "_key"]
    ex = tok.select(*keys, "word", "drop_at", (lo - F.col("at")).alias("lo"), F.posexplode(F.slice("near", lo + 1, hi - lo + 1)).alias("j", "context"))
    ex = ex.withColumn("off", F.col("lo") + F.col("j")).where(F.col("off") != 0)
    other = words.select(F.col("word").alias("context"), F.col("drop_at").alias("_at"), "label")
    ex = ex.join(F.broadcast(other), "context", "left")
    context = F.struct(F.col("context").alias("word"), F.col("_at").alias("drop_at"), "label").alias("ctx")
    return ex.select(*PAIR_KEY, target, context, "_key")


def coded_tokens(sents: DataFrame, words: DataFrame, frequent: DataFrame) -> DataFrame:
    """``(doc_id, sent_idx, row, pos, word, ...)``: tokens with their dictionary row.

    ``words`` is a written dictionary: it is broadcast only if its measured
    size allows; else the join is a shuffle salted on the frequent words.
    ``row`` tells sentences of repeated documents apart.
    """
    rows = sents.where(F.size("words") > 0).withColumn("row", F.monotonically_increasing_id())
    toks = rows.select("doc_id", "sent_idx", "row", F.posexplode("words").alias("pos", "word"))
    held = F.octet_length("word") + (4 * F.size("bucket_ids") if "bucket_ids" in words.columns else F.lit(0))
    n, most = words.agg(F.count(F.lit(1)), F.avg(held)).first()
    return bounded_join(toks, words, "word", n, VOCAB_ROW_BYTES + int(most or 0), hot=hot_targets(frequent))


def coded_sentences(tokens: DataFrame, skip_window: int, chunk: int = CHUNK) -> DataFrame:
    """One row per sentence, or ``chunk`` words of it: ``targets`` and ``contexts``, arrays of what either side of a pair needs.

    ``contexts`` begins ``halo`` words before the targets and ends as many
    after, ``skip_window`` at most, so a pair across a cut is made once, by its
    target's chunk. ``start`` is the position of the first target.
    """
    return _grouped(_halos(tokens, skip_window, chunk))


def ordered_sentences(tokens: DataFrame, skip_window: int, passes: int = 1, chunk: int = CHUNK) -> DataFrame:
    """``coded_sentences`` with their ``pass``, in stream order across partitions and inside each.

    ``tokens`` is a written table. One range shuffle by chunk serves the
    grouping too, so pairs made from the result are in stream order without
    ever being shuffled. Further passes repeat the tokens, not the pairs.
    """
    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, first = _halos(tokens, skip_window, chunk), ()
    if passes > 1:  # a constant would not count as a key of the grouping
        rows, first = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(int(passes) - 1)))), ("pass",)
    key = [*first, *SENTENCE_KEY, "start"]
    out = _grouped(rows.repartitionByRange(n, *key), first).sortWithinPartitions(*key)
    return out if first else out.withColumn("pass", F.lit(0))


def _halos(tokens: DataFrame, skip_window: int, chunk: int) -> DataFrame:
    """A row per token and chunk that needs it: its own, and the neighbours within ``skip_window``."""
    if skip_window >= chunk:
        raise ValueError(f"a chunk of {chunk} words can't hold a window of {skip_window}")
    first = F.greatest(F.floor((F.col("pos") - skip_window) / chunk), F.lit(0))
    last = F.floor((F.col("pos") + skip_window) / chunk)
    rows = tokens.withColumn("start", F.explode(F.transform(F.sequence(first, last), lambda c: c * chunk)))
    return rows.withColumn("own", F.floor(F.col("pos") / chunk) * chunk == F.col("start"))


def _grouped(rows: DataFrame, first: tuple[str, ...] = ()) -> DataFrame:
    more = [c for c in ("bucket_ids",) if c in rows.columns]
    target = F.when(F.col("own"), F.struct("word", "drop_p", *more)).alias("target")
    context = F.struct("word", "drop_p", "label").alias("context")
    chunks = rows.groupBy(*first, *SENTENCE_KEY, "start").agg(F.array_sort(F.collect_list(F.struct("pos", target, context))).alias("t"))
    chunks = chunks.select(
        *first,
        *SENTENCE_KEY,
        "start",
        (F.col("start") - F.col("t")[0]["pos"]).cast("int").alias("halo"),
        F.filter(F.col("t.target"), lambda x: x.isNotNull()).alias("targets"),
        F.col("t.context").alias("contexts"),
    )
    # a chunk of neighbours alone: the sentence ends before it
    return chunks.where(F.size("targets") > 0)


def coded_pairs(coded: DataFrame, skip_window: int, seed: int, passes: int = 1) -> DataFrame:
    """Pairs of ``skipgram_pairs`` as ``(pass, doc_id, sent_idx, pos, off, tgt, ctx)``, both sides as structs.

    ``coded`` that has a ``pass`` has its passes already. Pairs of a sentence
    and pass come in the order of ``PAIR_KEY``; no shuffle.
    """
    if "pass" not in coded.columns:
        coded = coded.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(int(passes) - 1))) if passes > 1 else F.lit(0))
    tok = coded.select("pass", "doc_id", "sent_idx", "start", "halo", "contexts", F.posexplode("targets").alias("i", "tgt"))
    tok = tok.withColumn("pos", (F.col("start") + F.col("i")).cast("int"))
    win = (F.lit(1) + F.floor(_u(seed, "win", "pass", "doc_id", "sent_idx", "pos") * int(skip_window))).cast("int")
    at = F.col("halo") + F.col("i")  # place of the target among the contexts
    w = tok.select("pass", "doc_id", "sent_idx", "pos", "tgt", "contexts", at.alias("at"), win.alias("win"))
    lo = F.greatest(F.col("at") - F.col("win"), F.lit(0))
    hi = F.least(F.col("at") + F.col("win"), F.size("contexts") - 1)
    near = w.select("pass", "doc_id", "sent_idx", "pos", "tgt", (lo - F.col("at")).alias("lo"), F.slice("contexts", lo + 1, hi - lo + 1).alias("near"))
    ex = near.select("pass", "doc_id", "sent_idx", "pos", "tgt", "lo", F.posexplode("near").alias("j", "ctx"))
    off = (F.col("lo") + F.col("j")).cast("int")
    return ex.select("pass", "doc_id", "sent_idx", "pos", off.alias("off"), "tgt", "ctx").where(F.col("off") != 0)


def _kept(side: str, tag: str, seed: int) -> Column:
    """Draws are made only for words that can be dropped."""
    p = F.col(side)["drop_p"]
    return (p <= 0) | (_u(seed, tag, *PAIR_KEY) >= p)


def _kept_at(side: str, tag: str, seed: int) -> Column:
    at = F.col(side)["drop_at"]
    return at.isNull() | (F.md5(F.concat(F.lit(f"{int(seed)}|{tag}|"), "_key", F.lit("|"), F.col("off").cast("string"))) >= at)


def coded_subsample(pairs: DataFrame, seed: int) -> DataFrame:
    """F4 on coded or direct pairs: the rows of ``subsample``."""
    if "_key" in pairs.columns:
        return pairs.where(_kept_at("tgt", "sub_t", seed)).where(_kept_at("ctx", "sub_c", seed))
    return pairs.where(_kept("tgt", "sub_t", seed)).where(_kept("ctx", "sub_c", seed))


def coded_samples(pairs: DataFrame, seed: int) -> DataFrame:
    """F4 + J1/F5 + P9/P12 on coded pairs: ``PAIR_KEY, target, label[, bucket_ids]``."""
    kept = coded_subsample(pairs.where(F.col("ctx")["label"].isNotNull()), seed)
    more = [F.col("tgt")["bucket_ids"].alias("bucket_ids")] if "bucket_ids" in kept.schema["tgt"].dataType.names else []
    return kept.select(*PAIR_KEY, F.col("tgt")["word"].alias("target"), F.col("ctx")["label"].alias("label"), *more)
