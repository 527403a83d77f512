"""Collocations: frequent phrases scored by how much more they occur together than their parts.

Texts are lower-cased (A-Z), split into pieces at ``BREAKS`` and pieces into
words at spaces and tabs. Phrases are counted per language within pieces, all
contiguous occurrences, by Rabin-Karp fingerprints:

1. Texts are packed into blocks of one language and about ``BLOCK`` bytes.
   A longer text is cut at a break; where it has none, between words, and the
   block carries the next words along, uncounted, so that every phrase lies
   whole in the block that counts it.
2. In each block, prefix polynomials over the bytes give the hash of every
   word and prefix polynomials over these the fingerprint of every run of 1 to
   ``LONGEST`` words. The block's distinct fingerprints, in order, go with
   their counts to buckets of the fingerprint's leading bits. A fingerprint's
   place in its block's order is its occurrence pointer.
3. A bucket adds up the counts of equal fingerprints and answers each block
   with a bit per pointer: whether the total reaches ``LEAST``.
4. Each block follows the pointers with a bit set into its text, compares
   every occurrence with the first one of its fingerprint, word by word, and
   sends the phrases of a bucket there, as text, with their counts; occurrences
   that merely collide go under their own text.
5. A bucket adds up the counts of equal texts, which settles collisions between
   blocks too, and answers each block with the totals of its phrases and which
   of them it is the first to hold.
6. The parts of a phrase stand where it stands, so each block has all counts
   that the score of its phrases needs: it writes each phrase that it is the
   first to hold with its best cut, and marks the shorter ones it covers.

A collision can only let a rare phrase through to step 4; its own count drops
it. Only fingerprints that may be frequent are ever turned into text. Blocks
are bounded by bytes and buckets hold about ``PER_BUCKET`` blocks' worth of
fingerprints; a frequent phrase has one entry a block, so no group follows its
frequency. With more memory a task, raise both: the number of (block, bucket)
rows falls with their product.

Null texts are empty, a null language is ``und``. Rows without doc_id and
repeated rows count like any other; extra columns are ignored; an empty table
gives no row. A single word longer than a block makes the block as long.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gramvec.llm.common import shipped, staged
from gramvec.operators.joins import bounded_join

LONGEST = 3
LEAST = 10
COVERED = 50
TOP = 2000
BLOCK = 1 << 22
PER_BUCKET = 4
#: Bits of a fingerprint beside those of its bucket.
TAIL = 40

# The bytes that end a piece, and those between words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"

_LOWER = bytes(range(256)).replace(bytes(range(65, 91)), bytes(range(97, 123)))
_BREAK = np.isin(np.arange(256), list(BREAKS))
_SPACE = np.isin(np.arange(256), list(SPACES))
_NEXT = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n-\r]+){0,%d}" % (LONGEST - 1))
_ANY_SEPARATOR = re.compile(rb"[ \t.,;:!?\n-\r]")
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xFF51AFD7ED558CCD)


# ---------------------------------------------------------------------- packing
def cut(data: bytes, block: int) -> Iterator[tuple[bytes, int]]:
    """``(bytes, own)`` of the parts of a long text: phrases that start before ``own`` belong to the part."""
    at = 0
    while len(data) - at > block:
        window = np.frombuffer(data, np.uint8, block, at)
        ends = np.flatnonzero(_BREAK[window])
        if len(ends):
            to = at + int(ends[-1]) + 1
            yield data[at:to], to - at
        else:
            gaps = np.flatnonzero(_SPACE[window])
            found = None if len(gaps) and gaps[-1] else _ANY_SEPARATOR.search(data, at + block)
            to = at + int(gaps[-1]) if len(gaps) and gaps[-1] else found.start() if found else len(data)
            yield data[at : _NEXT.match(data, to).end()], to - at
        at = to
    if at < len(data):
        yield data[at:], len(data) - at


def blocks_of(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``id, lang, own, text``: all texts in lower case, packed by language, written once (and as Zstandard frames)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(lang: str, own: int, data: bytes) -> pa.RecordBatch:
            packed = zstandard.ZstdCompressor(level=3).compress(data)
            return pa.record_batch([pa.array([lang], pa.string()), pa.array([own], pa.int64()), pa.array([packed], pa.binary())], ["lang", "own", "text"])

        held: dict[str, list[bytes]] = {}
        size: Counter = Counter()
        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("text")):
                data = (data.as_py() or b"").translate(_LOWER)
                if len(data) > block:
                    for part, own in cut(data, block):
                        yield row(lang, own, part)
                elif data:
                    held.setdefault(lang, []).append(data)
                    size[lang] += len(data) + 1
                    if size[lang] >= block or size.total() >= 4 * block:
                        most = size.most_common(1)[0][0]
                        yield row(most, size.pop(most), b"\n".join(held.pop(most)))
        for lang, texts in held.items():
            yield row(lang, size[lang], b"\n".join(texts))

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    packed = shipped(rows).mapInArrow(pack, "lang string, own long, text binary").withColumn("id", F.monotonically_increasing_id())
    return staged(packed, "phrase-blocks")


def plain(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# ----------------------------------------------------------------- fingerprints
class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were ever needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, n.bit_length())
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(cls, name, np.cumprod(factors))
        return cls.up, cls.down


def run_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes of the runs ``values[first:last]`` from one prefix polynomial."""
    up, down = Powers.upto(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return (prefix[last] - prefix[first]) * down[first]


class Words:
    """The words of a block: byte ranges, pieces and hashes."""

    def __init__(self, data: bytes, own: int, at_once: int = 1 << 19):
        self.data = data
        self.bytes = np.frombuffer(data, np.uint8)
        ends_piece = _BREAK[self.bytes]
        apart = ends_piece | _SPACE[self.bytes]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], apart, [True]]).astype(np.int8)))
        self.first, self.last = edge[0::2], edge[1::2]
        self.piece = np.cumsum(ends_piece, dtype=np.int32)[self.first] if len(self.first) else np.zeros(0, np.int32)
        self.own = int(np.searchsorted(self.first, own))
        hashes, at = [np.zeros(0, np.uint64)], 0
        while at < len(self.first):  # stretches of bytes, so that the polynomials stay small
            start = self.first[at]
            to = max(at + 1, int(np.searchsorted(self.last, start + at_once, "right")))
            some = self.bytes[start : self.last[to - 1]].astype(np.uint64) + np.uint64(1)
            hashes.append(run_hashes(some, self.first[at:to] - start, self.last[at:to] - start))
            at = to
        h = np.concatenate(hashes)
        self.hash = (h ^ (h >> np.uint64(32))) * _MIX

    def keys(self, n: int, lang: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints (``bits`` + ``TAIL`` bits) of all runs of ``n`` words, and the words where they start; own ones come first."""
        at = np.arange(max(0, len(self.first) - n + 1))
        at = at[self.piece[at] == self.piece[at + n - 1]]
        seed = int.from_bytes(hashlib.blake2b(f"{n}|{lang}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
        h = run_hashes(self.hash, at, at + n) + np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * _MIX
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_BASE)
        return (h ^ (h >> np.uint64(32))) >> np.uint64(64 - TAIL - bits), at

    def ids(self, at_once: int = 1 << 17) -> np.ndarray:
        """A number per word, equal only for equal words: hashes compared against the text."""
        _, rep, ids = np.unique(self.hash, return_index=True, return_inverse=True)
        size = self.last - self.first
        wrong = [np.zeros(0, np.int64)]
        for at in range(0, len(size), at_once):
            own = np.arange(at, min(at + at_once, len(size)))
            other = rep[ids[own]]
            differ = size[own] != size[other]
            own, other = own[~differ & (own != other)], other[~differ & (own != other)]
            wrong.append(np.arange(at, at + len(differ))[differ])
            if len(own):
                n = size[own]
                begin = np.cumsum(n) - n
                inside = np.arange(n.sum()) - np.repeat(begin, n)
                same = self.bytes[np.repeat(self.first[own], n) + inside] == self.bytes[np.repeat(self.first[other], n) + inside]
                wrong.append(own[~np.logical_and.reduceat(same, begin)])
        fresh: dict[bytes, int] = {}
        for i in np.concatenate(wrong):  # two words of one hash: numbered by their text
            ids[i] = len(rep) + fresh.setdefault(self.data[self.first[i] : self.last[i]], len(fresh))
        return ids

    def text(self, at: int, n: int) -> bytes:
        if n == 1:
            return self.data[self.first[at] : self.last[at]]
        return b" ".join([self.data[a:b] for a, b in zip(self.first[at : at + n], self.last[at : at + n])])


def planes(tails: np.ndarray) -> bytes:
    """Fingerprint tails byte plane by byte plane, highest first, which packs well where they ascend."""
    return np.ascontiguousarray(tails.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - TAIL // 8 :].T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(TAIL // 8, -1)
    out = np.zeros(raw.shape[1], np.uint64)
    for plane in raw:
        out = (out << np.uint64(8)) | plane
    return out


def bucket_edges(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(TAIL))


def all_keys(words: Words, lang: str, bits: int, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [words.keys(n, lang, bits) for n in range(1, longest + 1)]


def sent(blocks: DataFrame, bits: int, longest: int) -> DataFrame:
    """``id, bucket, tails, small, large``: each block's distinct fingerprints with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, lang, own, data = (batch.column(c)[i].as_py() for c in ("id", "lang", "own", "text"))
                words = Words(plain(data), own)
                found = all_keys(words, lang, bits, longest)
                keys, counts = np.unique(np.concatenate([k for k, _ in found]), return_counts=True)
                for k, at_word in found:  # runs that start in the words carried along have pointers but no count
                    np.subtract.at(counts, np.searchsorted(keys, k[at_word >= words.own]), 1)
                edge = bucket_edges(keys, bits)
                full = np.flatnonzero(np.diff(edge))
                small = np.minimum(counts, 255).astype(np.uint8)
                for some in np.array_split(full, -(-len(full) // 64)) if len(full) else []:
                    spans = [slice(edge[b], edge[b + 1]) for b in some]
                    yield pa.record_batch(
                        [
                            pa.array([at] * len(some), pa.int64()),
                            pa.array(some, pa.int64()),
                            pa.array([planes(keys[s] & np.uint64((1 << TAIL) - 1)) for s in spans], pa.binary()),
                            pa.array([small[s].tobytes() for s in spans], pa.binary()),
                            pa.array([counts[s][small[s] == 255].astype(np.uint32).tobytes() for s in spans], pa.binary()),
                        ],
                        ["id", "bucket", "tails", "small", "large"],
                    )

    return blocks.select("id", "lang", "own", "text").mapInArrow(run, "id long, bucket long, tails binary, small binary, large binary")


def answered(rows: DataFrame, least: int) -> DataFrame:
    """``id, bucket, bits``: per block and bucket a bit for each fingerprint whose total is ``least`` or more."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        tails = np.concatenate([from_planes(x) for x in group["tails"]])
        counts = np.frombuffer(b"".join(group["small"]), np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(b"".join(group["large"]), np.uint32)
        order = np.argsort(tails, kind="stable")
        tails = tails[order]
        begin = np.flatnonzero(np.concatenate([[True], tails[1:] != tails[:-1]]))
        enough = np.add.reduceat(counts[order], begin) >= least
        bits = np.empty(len(tails), bool)
        bits[order] = np.repeat(enough, np.diff(np.append(begin, len(tails))))
        ends = np.cumsum([len(x) for x in group["small"]])
        parts = np.split(bits, ends[:-1])
        some = [p.any() for p in parts]
        return pd.DataFrame({"id": group["id"], "bucket": group["bucket"], "bits": [np.packbits(p).tobytes() for p in parts]})[some]

    return rows.groupBy("bucket").applyInPandas(run, "id long, bucket long, bits binary")


class Entries:
    """The phrases of a block whose pointers were answered with a set bit, told apart by text, in order of bucket.

    ``size``, ``first`` and ``counts``: words of each phrase, the word where it
    first starts, and its occurrences. ``of[n]``: the phrase of ``n`` words that
    starts at each word, or -1. ``edge``: where each bucket's phrases begin.
    """

    def __init__(self, words: Words, lang: str, bits: int, longest: int, answers: list):
        self.words = words
        found = all_keys(words, lang, bits, longest)
        keys = np.unique(np.concatenate([k for k, _ in found]))
        edge = bucket_edges(keys, bits)
        wanted = np.zeros(len(keys), bool)
        for a in answers:
            lo, hi = edge[a["bucket"]], edge[a["bucket"] + 1]
            wanted[lo:hi] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=hi - lo).astype(bool)
        keys = keys[wanted]
        ids = words.ids() if len(keys) else None
        size, first, counts, bucket, of = [], [], [], [], [np.zeros(0, np.int64)]
        total = 0
        for n, (own, at) in enumerate(found, 1):
            numbers = np.full(len(words.first), -1, np.int64)
            if len(keys):
                place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[place] == own
                place, at = place[hit], at[hit]
                order = np.argsort(place, kind="stable")
                place, at = place[order], at[order]
                begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(at) else np.zeros(0, np.int64)
                group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(at))))
                rep = at[begin][group]
                same = np.ones(len(at), bool)
                for k in range(n):
                    same &= ids[at + k] == ids[rep + k]
                starts, held = at[begin].tolist(), keys[place[begin]].tolist()
                if not same.all():  # collisions within the block: entries of their own
                    others: dict[tuple, int] = {}
                    for j in np.flatnonzero(~same).tolist():
                        text = (held[group[j]], words.text(at[j], n))
                        if text not in others:
                            others[text] = len(starts)
                            starts.append(int(at[j]))
                            held.append(text[0])
                        group[j] = others[text]
                numbers[at] = total + group
                size.append(np.full(len(starts), n, np.int64))
                first.append(np.array(starts, np.int64))
                counts.append(np.bincount(group[at < words.own], minlength=len(starts)))
                bucket.append(np.array(held, np.uint64) >> np.uint64(TAIL))
                total += len(starts)
            of.append(numbers)
        empty = [np.zeros(0, np.int64)]
        bucket = np.concatenate(bucket or empty).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(total + 1, np.int64)
        back[order], back[total] = np.arange(total), -1
        self.size, self.first, self.counts = (np.concatenate(x or empty)[order] for x in (size, first, counts))
        self.of = [back[x] for x in of]
        self.edge = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))

    def texts(self, some: slice) -> bytes:
        """The texts of some entries, each ended by a line feed."""
        w, n = self.words, self.size[some]
        start, last = w.first[self.first[some]], w.last[self.first[some] + n - 1]
        odd = np.zeros(len(n), bool)  # words that more or other than one space parts
        for k in range(1, int(n.max(initial=1))):
            at = self.first[some][n > k] + k
            odd[n > k] |= (w.first[at] - w.last[at - 1] != 1) | (w.bytes[w.first[at] - 1] != 32)
        source = w.bytes
        if odd.any():
            made = [w.text(i, k) for i, k in zip(self.first[some][odd].tolist(), n[odd].tolist())]
            sizes = np.array([len(x) for x in made])
            start, last = start.copy(), last.copy()
            start[odd] = len(source) + np.cumsum(sizes) - sizes
            last[odd] = start[odd] + sizes
            source = np.concatenate([source, np.frombuffer(b"".join(made), np.uint8)])
        long = last - start + 1
        to = np.cumsum(long)
        out = source[np.minimum(np.arange(to[-1] if len(to) else 0) + np.repeat(start - to + long, long), len(source) - 1)]
        out[to - 1] = 10
        return out.tobytes()


def told(blocks: DataFrame, bits: int, longest: int) -> DataFrame:
    """``id, lang, bucket, texts, counts``: each block's phrases that may be frequent, by bucket. ``blocks`` has their ``answers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for i in range(batch.num_rows):
                at, lang, own, data, answers = (batch.column(c)[i].as_py() for c in ("id", "lang", "own", "text", "answers"))
                e = Entries(Words(plain(data), own), lang, bits, longest, answers)
                full = np.flatnonzero(np.diff(e.edge))
                for some in np.array_split(full, -(-len(full) // 64)) if len(full) else []:
                    spans = [slice(e.edge[b], e.edge[b + 1]) for b in some]
                    yield pa.record_batch(
                        [
                            pa.array([at] * len(some), pa.int64()),
                            pa.array([lang] * len(some), pa.string()),
                            pa.array(some, pa.int64()),
                            pa.array([pack.compress(e.texts(s)) for s in spans], pa.binary()),
                            pa.array([pack.compress(e.counts[s].astype(np.uint32).tobytes()) for s in spans], pa.binary()),
                        ],
                        ["id", "lang", "bucket", "texts", "counts"],
                    )

    return blocks.mapInArrow(run, "id long, lang string, bucket long, texts binary, counts binary")


def settled(rows: DataFrame) -> DataFrame:
    """``id, bucket, totals``: for each phrase of a block's bucket twice its total by text, and 1 more where the block is the first."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        known: dict[tuple[str, bytes], int] = {}
        totals: list[int] = []
        places = []
        for lang, texts, counts in zip(group["lang"], group["texts"], group["counts"]):
            place = []
            for text, n in zip(plain(texts).split(b"\n"), np.frombuffer(plain(counts), np.uint32).tolist()):
                at = known.setdefault((lang, text), len(totals))
                if at == len(totals):
                    totals.append(n)
                    place.append(2 * at + 1)
                else:
                    totals[at] += n
                    place.append(2 * at)
            places.append(np.array(place, np.int64))
        summed, pack = np.array(totals, np.int64), zstandard.ZstdCompressor(level=3)
        answers = [pack.compress((2 * summed[p >> 1] + (p & 1)).tobytes()) for p in places]
        return pd.DataFrame({"id": group["id"], "bucket": group["bucket"], "totals": answers})

    return rows.groupBy("bucket").applyInPandas(run, "id long, bucket long, totals binary")


def best_cut(a: int, parts: list[tuple[int, int]]) -> tuple[int, int, int]:
    """``(score, l, r)`` of the lowest-scoring cut, the earliest of equal ones; exact at any size."""
    return min(((1_000_000 * a * a // (left * right), left, right) for left, right in parts), key=lambda x: x[0])


def scored(blocks: DataFrame, bits: int, longest: int, least: int, covered: int) -> DataFrame:
    """Rows of phrases with ``a, l, r, score``, of phrases ``dropped``, and of each block's words ``n`` (no phrase)."""
    names = ["lang", "phrase", "a", "l", "r", "score", "dropped", "n"]

    def rows_of(e: Entries, totals: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
        seen: set[int] = set()
        for x in np.flatnonzero(first & (e.size > 1) & (totals >= least)).tolist():
            n, at, a = int(e.size[x]), int(e.first[x]), int(totals[x])
            count = [[int(totals[e.of[m][at + i]]) for i in range(n - m + 1)] for m in range(1, n)]
            score, left, right = best_cut(a, [(count[k - 1][0], count[n - k - 1][k]) for k in range(1, n)])
            yield e.words.text(at, n), a, left, right, score, False, None
            for m in range(2, n):
                for i in range(n - m + 1):
                    inner = int(e.of[m][at + i])
                    if 100 * a >= covered * count[m - 1][i] and inner not in seen:
                        seen.add(inner)
                        yield e.words.text(at + i, m), None, None, None, None, True, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), *[pa.int64()] * 4, pa.bool_(), pa.int64()]
        for batch in batches:
            for i in range(batch.num_rows):
                lang, own, data, answers, sums = (batch.column(c)[i].as_py() for c in ("lang", "own", "text", "answers", "sums"))
                words = Words(plain(data), own)
                rows = [(None, None, None, None, None, False, words.own)]
                if sums:
                    e = Entries(words, lang, bits, longest, answers)
                    totals = np.zeros(len(e.size), np.int64)
                    for s in sums:
                        totals[e.edge[s["bucket"]] : e.edge[s["bucket"] + 1]] = np.frombuffer(plain(s["totals"]), np.int64)
                    rows += rows_of(e, totals >> 1, totals & 1 == 1)
                for at in range(0, len(rows), 1 << 15):
                    some = list(zip(*rows[at : at + (1 << 15)]))
                    yield pa.record_batch([pa.array([lang] * len(some[0]), pa.string()), *map(pa.array, some, kinds)], names)

    return blocks.mapInArrow(run, "lang string, phrase binary, a long, l long, r long, score long, dropped boolean, n long")


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP, block: int = BLOCK, per_bucket: int = PER_BUCKET
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``top`` phrases of each language.

    ``least`` is 1 or more. Of the ways to cut a phrase in two, the
    lowest-scoring one counts (ties: the earliest). Phrases inside a longer one
    that has ``covered`` per cent of their count or more are dropped.
    """
    blocks = blocks_of(docs, block)
    bits = max(5, (blocks.count() // per_bucket).bit_length())
    # the joins hold answers in memory, not texts: bits and totals for the phrases of a partition's blocks
    bits_of = answered(sent(blocks, bits, longest), least).groupBy("id").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    asked = staged(bits_of, "phrase-answers")
    held = told(blocks.join(asked.hint("shuffle_hash"), "id"), bits, longest)
    sums = settled(held).groupBy("id").agg(F.collect_list(F.struct("bucket", "totals")).alias("sums"))
    full = blocks.join(asked.join(sums, "id").hint("shuffle_hash"), "id", "left")
    rows = scored(full, bits, longest, least, covered).groupBy("lang", "phrase")
    columns = [F.max(c).alias(c) for c in ("a", "l", "r", "score", "dropped")]
    table = staged(rows.agg(*columns, F.sum("n").alias("n")).withColumn("phrase", F.col("phrase").cast("string")), "phrase-scores")
    kept = table.where("a IS NOT NULL AND NOT dropped").select("lang", "phrase", "a", "l", "r", "score")
    totals = table.where("phrase IS NULL").select("lang", "n")
    langs, wide = totals.agg(F.count(F.lit(1)), F.max(F.octet_length("lang"))).first()
    found = bounded_join(ranked(kept, top), totals, "lang", langs, 48 + (wide or 0))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language, numbered; salts first choose ``top`` each, so no task sorts a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salts = max(1, round((rows.count() / top) ** 0.5))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("salt")


def oracle() -> str:
    """DuckDB SQL for the query."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({low}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
s AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, length(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM s, (SELECT unnest([1, 2, 3]) AS k) WHERE length(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}),
e AS (SELECT *, unnest(range(1, k)) AS at FROM c),
b AS (SELECT e.lang, e.phrase, e.k, e.a, e.w, e.at, x.f AS l, y.f AS r, (1000000::HUGEINT * e.a * e.a) // (x.f::HUGEINT * y.f) AS score
  FROM e JOIN f x ON x.lang = e.lang AND x.phrase = array_to_string(e.w[1 : e.at], ' ')
  JOIN f y ON y.lang = e.lang AND y.phrase = array_to_string(e.w[e.at + 1 :], ' ')
  QUALIFY row_number() OVER (PARTITION BY e.lang, e.phrase ORDER BY score, e.at) = 1),
o AS (SELECT lang, inner_phrase AS phrase, max(a) AS around FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inner_phrase FROM c WHERE k = 3) GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.around IS NULL OR 100 * o.around < {COVERED} * b.a)
SELECT z.lang, z.rank, z.phrase, z.a, z.l, z.r, n.n::BIGINT AS n, z.score::BIGINT AS score FROM z JOIN n ON n.lang = z.lang WHERE z.rank <= {TOP}"""
