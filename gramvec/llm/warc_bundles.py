"""WARC archives as seekable Zstandard bundles.

Records are written to bundles (``.warc.zst``): groups of records go into
independent Zstandard frames of about ``FRAME_BYTES``, and a footer in the
public seekable format (a skippable frame with the compressed and plain size
of every frame) ends the file, so the plain reader of any Zstandard library
reads the whole archive and a seek reads one frame. The index maps a record
identifier to bundle, frame and offset inside the plain frame.

Of the pages whose payloads are equal and at least ``MIN_REVISIT`` bytes long,
those with the smallest page_id are ``response`` records; the others are
``revisit`` records that refer to it and hold no payload. Shorter payloads
are always ``response``.

A null html is an empty payload. A null page_id is written without a number
and is never referred to unless all its equals are null, in which case all are
responses. Rows that repeat the smallest page_id are responses too; repeated
rows keep a record each. A null url gives a record without target; control
and non-ASCII characters in a url are percent-encoded. Extra columns are
ignored; an empty table gives no bundle.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramvec.llm.common import partitions, shipped, staged
from gramvec.llm.files import NewFile, open_file
from gramvec.operators.joins import hot_keys, salted_join
from gramvec.session import scratch_path

MIN_REVISIT = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the public formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:x-page:"


# ----------------------------------------------------------------- records
def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit of ``refers_to`` if that is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=URL_SAFE)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD_URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


URL_SAFE = "".join(map(chr, range(0x21, 0x7F)))


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, bytes]]:
    """``(offset, length, headers, HTTP head, payload)`` of each record in a plain frame."""
    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        lines = data[at:split].decode("ascii").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("no record begins here")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        end = split + 4 + int(headers["Content-Length"])
        http, _, payload = data[split + 4 : end].partition(b"\r\n\r\n")
        yield at, end + 4 - at, headers, http, payload
        at = end + 4


def number(urn: str) -> int | None:
    digits = urn.removeprefix(f"<{RECORD_URN}").removesuffix(">")
    return int(digits) if digits else None


# ----------------------------------------------------------------- bundles
class Bundle:
    """One archive file, written front to back."""

    def __init__(self, folder: str, stem: str, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.file, self.frame_bytes = NewFile(folder, stem, ".warc.zst"), frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.plain: list[bytes] = []
        self.held = self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset in it of the record."""
        if self.held and self.held + len(data) > self.frame_bytes:
            self.flush()
        self.plain.append(data)
        self.held += len(data)
        return len(self.frames), self.held - len(data)

    def flush(self) -> None:
        if self.held:
            packed = self.compressor.compress(b"".join(self.plain))
            self.file.write(packed)
            self.frames.append((len(packed), self.held))
            self.size += len(packed)
            self.plain, self.held = [], 0

    def close(self) -> str:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()
        return self.file.name


class BundleReader:
    """Random access to the frames of one archive by its footer."""

    def __init__(self, folder: str, name: str):
        self.file = open_file(folder, name)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags:
            raise ValueError(f"{name} has no seek table of this kind")
        sizes = struct.iter_unpack("<II", self._at(size - 9 - 8 * n, 8 * n))
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        import zstandard

        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self._at(at, packed), max_output_size=plain)


# ------------------------------------------------------------------- Spark
def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` (null for a response)."""
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    long_enough = F.octet_length("payload") >= min_bytes
    classes = rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = staged(classes.where("n > 1"), "payload-classes")
    hot = hot_keys(classes, "digest", "n")
    small = classes.select(F.col("digest").alias("_digest"), "first")
    joined = salted_join(rows.withColumn("_row", F.coalesce("page_id", F.xxhash64("url"))), small, "digest", "_digest", hot, ["_row"], "left")
    return joined.select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )


INDEX = "bundle string, frame long, offset long, length long, page_id long, record_type string"


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write one record per page; returns the committed index (``INDEX``)."""

    def run(batches):
        part, out, held = TaskContext.get().partitionId(), None, []

        def done():
            name = out.close()
            columns = list(zip(*held))
            kinds = [pa.int64()] * 4 + [pa.string()]
            return pa.record_batch(
                [pa.array([name] * len(held)), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["bundle", "frame", "offset", "length", "page_id", "record_type"],
            )

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or Bundle(folder, f"part-{part:06d}", frame_bytes)
                data = record(page_id, url, payload, digest, refers_to)
                frame, offset = out.add(data)
                held.append((frame, offset, len(data), page_id, "response" if refers_to is None else "revisit"))
                if out.size >= bundle_bytes:
                    yield done()
                    out, held = None, []
        if out:
            yield done()

    ordered = with_revisits(pages, min_bytes).sortWithinPartitions("page_id")
    return staged(shipped(ordered).mapInArrow(run, INDEX), "warc-index")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_bundles(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` lists (``READ``), frame by frame; payloads are checked against their digests."""

    def run(batches):
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                reader = BundleReader(folder, name)
                for k in range(len(reader.frames)):
                    rows = [seen(h, http, p) for _, _, h, http, p in parse_records(reader.frame(k))]
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in READ.split(", ")])

    def seen(headers, http, payload):
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        kind, size = headers["WARC-Type"], int(http.rpartition(b"Content-Length: ")[2])
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
        refers_to = headers.get("WARC-Refers-To")
        return number(headers["WARC-Record-ID"]), size, digest, kind, number(refers_to) if refers_to else None

    names = [(r["bundle"],) for r in index.select("bundle").distinct().collect()]  # one for each 64 MB, about
    return shipped(spark.createDataFrame(names, "bundle string")).repartition(max(1, len(names))).mapInArrow(run, READ)


def fetch_records(index: DataFrame, folder: str) -> DataFrame:
    """``page_id, payload`` of the rows of ``index`` by seeking to their frames alone."""

    def run(batches):
        last, reader, at, plain = None, None, None, b""
        for batch in batches:
            rows = []
            for name, frame, offset, length, page_id in zip(*(c.to_pylist() for c in batch.columns)):
                if name != last:
                    last, reader, at = name, BundleReader(folder, name), None
                if frame != at:
                    at, plain = frame, reader.frame(frame)
                rows.append((page_id, next(parse_records(plain[offset : offset + length]))[4]))
            columns = zip(*rows) if rows else [[], []]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.binary()])], ["page_id", "payload"])

    n = partitions(index.sparkSession)
    wanted = index.select("bundle", "frame", "offset", "length", "page_id")
    return shipped(wanted).repartition(n, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, "page_id long, payload binary")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_bundles(pages.sparkSession, folder, write_bundles(pages, folder))
