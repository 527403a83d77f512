"""Token ids as canonical length-limited Huffman code in seekable binary files.

Counts of all ids give code lengths of at most ``max_bits`` (package-merge);
the canonical code follows from the lengths alone. A file holds

    "HUFIDS01" | u32 vocabulary | u8 max_bits | one length byte per id
    bit stream of all ids, most significant bit first
    u64 bit offset of every ``block_ids``-th id (the checkpoints)
    i64 doc_id, u8 whether it is null, u64 ids of every document
    u64 ids | u64 documents | u64 blocks | u64 bytes of the stream | u32 block_ids | "HUFIDS01"

so any block can be decoded alone, with one table look-up per id; many blocks
are decoded side by side. Documents are written in ascending doc_id order over
the files of one folder (null ids last, ties by their ids' hash).

Null and empty texts hold the end id alone. Repeated doc_ids keep one entry
per row. An empty table gives no file. Other columns are ignored. Files are
rolled at ``FILE_IDS`` ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramvec.llm.common import partitions, shipped, staged
from gramvec.llm.files import NewFile, open_file
from gramvec.llm.tokens import encoder, slices
from gramvec.session import scratch_path

MAGIC = b"HUFIDS01"
MAX_BITS = 16
BLOCK_IDS = 4096
FILE_IDS = 1 << 26
#: Ids that are encoded at once.
ENCODED = 1 << 18
#: Blocks that are decoded side by side.
LANES = 1024
TAIL = struct.Struct("<QQQQI8s")


# ------------------------------------------------------------------ tokens
def squeeze(ids: np.ndarray) -> bytes:
    """Ids as compressed bytes, for a shuffle or a table between two steps."""
    import zstandard

    small = not len(ids) or int(ids.max()) < 1 << 16
    return bytes([2 if small else 4]) + zstandard.compress(ids.astype("<u2" if small else "<u4").tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data[1:]), f"<u{data[0]}").astype(np.uint32)


def token_ids(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every document, the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in slices(batches):
            ids, at = enc.encode(batch.column("text").to_pylist())
            one = [squeeze(np.append(ids[a:b], np.uint32(end_id))) for a, b in zip(at[:-1], at[1:])]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.diff(at) + 1), pa.array(one, pa.binary())], ["doc_id", "n_tokens", "ids"]
            )

    return shipped(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(tokens: DataFrame) -> DataFrame:
    """``(id, n)`` over the whole table; at most one row per id of the vocabulary leaves a task."""

    def run(batches):
        total, held, n_held = np.zeros(0, np.int64), [], 0

        def counted():
            nonlocal total, held, n_held
            n = np.bincount(np.concatenate(held), minlength=len(total))
            n[: len(total)] += total
            total, held, n_held = n, [], 0

        for batch in batches:
            for data in batch.column("ids"):
                held.append(unsqueeze(data.as_py()))
                n_held += len(held[-1])
                if n_held >= ENCODED:
                    counted()
        if held:
            counted()
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return shipped(tokens).select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# -------------------------------------------------------------------- code
def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Length of each symbol's code (0 where the count is 0): optimal among codes of at most ``max_bits``."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit codes of {max_bits} bits")
    if n < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        even = len(level) // 2 * 2
        both = np.concatenate([leaves, level[:even:2] + level[1:even:2]])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        is_leaf.append(rank < n)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes that follow from the lengths: shorter first, then smaller symbols."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        n = lengths[order].astype(np.int64)
        widest = int(n[-1])
        share = np.uint64(1) << (widest - n).astype(np.uint64)
        first = np.concatenate([[np.uint64(0)], np.cumsum(share)[:-1]])
        codes[order] = first >> (widest - n).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every window of ``max_bits`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.int64(1) << (max_bits - lengths[order].astype(np.int64))
    symbols, sizes = np.zeros(1 << max_bits, np.uint32), np.ones(1 << max_bits, np.int64)
    full = int(spans.sum())
    symbols[:full], sizes[:full] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbols, sizes


class BitWriter:
    """Appends codes to a bit stream; whole bytes leave with every call."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.int64), canonical_codes(lengths)
        self.bits, self.rest, self.rest_bits = 0, 0, 0

    def add(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes that are full now, and the bit offset of every id."""
        n, code = self.lengths[ids], self.codes[ids]
        if len(ids) and not n.all():
            raise ValueError("an id has no code")
        ends = self.rest_bits + np.cumsum(n)
        starts = ends - n
        offsets = self.bits - self.rest_bits + starts
        total = int(ends[-1]) if len(ids) else self.rest_bits
        words = np.zeros(total // 64 + 2, np.uint64)
        if len(ids):
            word, free = starts >> 6, 64 - (starts & 63) - n
            over = np.maximum(-free, 0).astype(np.uint64)
            head = np.where(free >= 0, code << np.maximum(free, 0).astype(np.uint64), code >> over)
            edge = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[edge]] = np.bitwise_or.reduceat(head, edge)
            cut = np.flatnonzero(free < 0)
            words[word[cut] + 1] |= code[cut] << (np.uint64(64) - over[cut])
        words[0] |= np.uint64(self.rest << (64 - self.rest_bits) if self.rest_bits else 0)
        data = words.astype(">u8").tobytes()
        self.bits += total - self.rest_bits
        self.rest_bits = total % 8
        self.rest = data[total // 8] >> (8 - self.rest_bits) if self.rest_bits else 0
        return data[: total // 8], offsets

    def close(self) -> bytes:
        return bytes([self.rest << (8 - self.rest_bits)]) if self.rest_bits else b""


# ------------------------------------------------------------------- files
class IdFile:
    """One file of the format, written front to back."""

    def __init__(self, folder: str, stem: str, lengths: np.ndarray, max_bits: int, block_ids: int):
        self.file, self.block_ids = NewFile(folder, stem, ".hufids"), block_ids
        self.bits, self.n_ids, self.stream = BitWriter(lengths), 0, 0
        self.checkpoints: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.file.write(MAGIC + struct.pack("<IB", len(lengths), max_bits) + lengths.tobytes())

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= ENCODED:
            self.flush()

    def flush(self) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        self.held, self.n_held = [], 0
        for at in range(0, len(ids), ENCODED):
            data, offsets = self.bits.add(ids[at : at + ENCODED])
            self.checkpoints.append(offsets[-self.n_ids % self.block_ids :: self.block_ids])
            self.n_ids += len(offsets)
            self.stream += len(data)
            self.file.write(data)

    def close(self) -> str:
        self.flush()
        last = self.bits.close()
        points = np.concatenate([np.empty(0, np.int64), *self.checkpoints]).astype("<u8")
        docs = np.array(self.docs, [("id", "<i8"), ("null", "u1"), ("n", "<u8")])
        self.file.write(last + points.tobytes() + docs.tobytes())
        self.file.write(TAIL.pack(self.n_ids, len(docs), len(points), self.stream + len(last), self.block_ids, MAGIC))
        self.file.close()
        return self.file.name


class IdReader:
    """Random access to the blocks of one file."""

    def __init__(self, folder: str, name: str):
        self.file = open_file(folder, name)
        size = self.file.size()
        self.n_ids, n_docs, n_blocks, self.stream, self.block_ids, magic = TAIL.unpack(self._at(size - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no file of this format")
        vocabulary, self.max_bits = struct.unpack("<8xIB", self._at(0, 13))
        self.table = decode_table(np.frombuffer(self._at(13, vocabulary), np.uint8), self.max_bits)
        self.start = 13 + vocabulary
        at = self.start + self.stream
        self.checkpoints = np.frombuffer(self._at(at, 8 * n_blocks), "<u8").astype(np.int64)
        self.docs = np.frombuffer(self._at(at + 8 * n_blocks, 17 * n_docs), [("id", "<i8"), ("null", "u1"), ("n", "<u8")])

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks ``first`` to ``last`` (exclusive), decoded side by side."""
        points = self.checkpoints[first:last]
        if not len(points):
            return np.empty(0, np.uint32)
        begin = int(points[0]) >> 3
        end = (int(self.checkpoints[last]) >> 3) + 1 if last < len(self.checkpoints) else self.stream
        raw = np.frombuffer(self._at(self.start + begin, end - begin) + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        symbols, sizes = self.table
        at = points - 8 * begin
        n = min(self.n_ids, last * self.block_ids) - first * self.block_ids
        out = np.empty((len(at), self.block_ids), np.uint32)
        short = n - (len(at) - 1) * self.block_ids  # ids of the last block
        down, mask = 32 - self.max_bits, (1 << self.max_bits) - 1
        for k in range(self.block_ids):
            if k == short:
                at = at[:-1]
                if not len(at):
                    break
            seen = (window[at >> 3] >> (down - (at & 7))) & mask
            out[: len(at), k] = symbols[seen]
            at = at + sizes[seen]
        return out.reshape(-1)[:n]

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """Every document with its ids, which come in parts of a few blocks."""
        at, have = 0, np.empty(0, np.uint32)
        for doc in self.docs:
            need, parts = int(doc["n"]), []
            while need:
                if not len(have):
                    have = self.blocks(at, min(at + LANES, len(self.checkpoints)))
                    at += LANES
                parts.append(have[:need])
                have, need = have[need:], need - len(parts[-1])
            yield (None if doc["null"] else int(doc["id"])), parts


def write_ids(tokens: DataFrame, folder: str, max_bits: int = MAX_BITS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write ``token_ids`` rows to ``folder``; returns the manifest ``(file_no, name, first_id, n_ids, n_docs)``.

    The counts (one row per id of the vocabulary) pass the driver; documents
    are range-partitioned by doc_id, and a task encodes its documents batch by
    batch.
    """
    spark = tokens.sparkSession
    counts = {r["id"]: r["n"] for r in id_counts(tokens).collect()}
    freq = np.zeros(max(counts, default=-1) + 1, np.int64)
    freq[list(counts)] = list(counts.values())
    lengths = code_lengths(freq, max_bits)

    def run(batches):
        part, made, out = TaskContext.get().partitionId(), [], None

        def done():
            made.append((part, len(made), out.close(), out.n_ids, len(out.docs)))

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                out = out or IdFile(folder, f"part-{part:06d}", lengths, max_bits, block_ids)
                out.add(doc_id, unsqueeze(data.as_py()))
                if out.n_ids >= FILE_IDS:
                    done()
                    out = None
        if out:
            done()
        columns = zip(*made) if made else [[]] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, MANIFEST)], [f.name for f in manifest])

    MANIFEST = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    manifest = pa.schema(list(zip(["part", "seq", "name", "n_ids", "n_docs"], MANIFEST)))
    n = partitions(spark)
    order = [F.col("doc_id").asc_nulls_last(), "n_tokens", F.xxhash64("ids")]
    sorted_ids = tokens.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    written = sorted_ids.mapInArrow(run, "part long, seq long, name string, n_ids long, n_docs long")
    # The manifest is committed once: what its rows name are the files that count.
    rows = sorted(staged(written, "ids-manifest").collect(), key=lambda r: (r["part"], r["seq"]))
    first, out = 0, []
    for k, r in enumerate(rows):
        out.append((k, r["name"], first, r["n_ids"], r["n_docs"]))
        first += r["n_ids"]
    return spark.createDataFrame(out, "file_no long, name string, first_id long, n_ids long, n_docs long")


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader, start, rows = IdReader(folder, row["name"]), row["first_id"], []
                for doc_id, parts in reader.documents():
                    crc, n = 0, 0
                    for p in parts:
                        crc, n = zlib.crc32(p.astype("<u4").tobytes(), crc), n + len(p)
                    rows.append((doc_id, start, n, crc))
                    start += n
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("name", "first_id").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, ids)`` of every document."""

    def run(batches):
        for batch in batches:
            for name in batch.column("name").to_pylist():
                for doc_id, parts in IdReader(folder, name).documents():
                    ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
                    yield pa.record_batch([pa.array([doc_id], pa.int64()), pa.array([ids.astype(np.int64)])], ["doc_id", "ids"])

    return manifest.select("name").repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, ids array<long>")


def huffman_round_trip(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Tokenize ``docs``, write the files, read them back: one row per document."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-ids")
    tokens = staged(token_ids(docs, tokenizer_path, end_id), "tokens")
    return read_documents(spark, folder, write_ids(tokens, folder))
