"""Sample ordinals, batches, padding, shards and the batch shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramvec.functions.permute import permuted
from gramvec.operators.ordinals import materialize, ordinal_in_place
from gramvec.operators.text import WORD_MARK
from gramvec.operators.samples import bucket_lists, buckets_of, pad_expr
from gramvec.session import small_arrow_batches

# Fixed value: the sharded writer moves to the next file every 1000 batches.
SHARD_SWITCH_EVERY = 1000


def sample_ordinals(samples: DataFrame, batch_size: int):
    """Position of every sample in stream order (pass, doc, sentence, pos, off).

    ``samples`` are in stream order, made from ordered sentences
    (``ordered_sentences``, ``direct_pairs``): a sample's number is the count
    of earlier partitions plus its place in its own. No sample is shuffled or
    sorted; the samples are written once. Returns ``(DataFrame with ord and
    batch_id, total samples)``.
    """
    out, total = ordinal_in_place(samples, "ord")
    return out.withColumn("batch_id", F.floor(F.col("ord") / int(batch_size)).cast("bigint")), total


def full_batches(total: int, batch_size: int) -> int:
    """the trailing partial batch is never emitted."""
    return int(total) // int(batch_size)


#: Samples of a chunk, at least.
CHUNK_SAMPLES = 8192
CHUNK_SCHEMA = "part int, at long, n int, words array<string>, places array<int>, labels array<int>"


def sample_chunks(samples: DataFrame, batch_size: int) -> tuple[DataFrame, int]:
    """``(chunks, total samples)`` of samples in stream order: a row per run of samples, written once.

    A chunk has its distinct target words, each sample's place among them and
    its label: a fraction of the bytes of a row per sample. ``ord`` is the
    number of its first sample, the samples of earlier partitions and chunks.
    """
    from pyspark import TaskContext

    spark = samples.sparkSession
    small_arrow_batches(spark)
    size = max(CHUNK_SAMPLES, 8 * int(batch_size))

    def packed(part, at, rows):
        coded = rows["target"].combine_chunks().dictionary_encode()
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        cols = [pa.array([part], pa.int32()), pa.array([at]), pa.array([len(coded)], pa.int32())]
        lists = [coded.dictionary, coded.indices, rows["label"].combine_chunks()]
        return pa.RecordBatch.from_arrays([*cols, *map(one, lists)], ["part", "at", "n", "words", "places", "labels"])

    def chunks(batches):
        part, at, held, n = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= size:
                rows, k = pa.Table.from_batches(held), 0
                while n - k >= size:
                    yield packed(part, at, rows.slice(k, size))
                    at, k = at + size, k + size
                held, n = rows.slice(k).to_batches(), n - k
        if n:
            yield packed(part, at, pa.Table.from_batches(held))

    out = materialize(samples.select("target", "label").mapInArrow(chunks, CHUNK_SCHEMA), "chunks", plain=True)
    offsets, total = [], 0
    for row in out.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        offsets.append((row["part"], total))
        total += row["n"]
    before = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "part int, _before long"))
    return out.join(before, "part").select((F.col("_before") + F.col("at")).alias("ord"), "n", "words", "places", "labels"), total


def batches(
    chunks: DataFrame, total: int, batch_size: int, ngram_size: int, num_buckets: int, padded: bool = False, words: bool = False
) -> DataFrame:
    """A5 + A4: ``batches(batch_id, inputs array<array<int>>, labels array<int>, width)``.

    A chunk (``sample_chunks``) holds most of its batches whole, which are made
    where it stands; only the samples before its first and after its last are
    shuffled, to meet the rest of their batch. Words are hashed into their
    buckets once a chunk. ``padded``: the lists come as of ``pad_batches``.
    ``words``: ``(batch_id, targets, labels)`` with the words themselves, one
    string of few bytes, of which ``hashed_batches`` makes the padded rows.
    """
    B, nb = int(batch_size), full_batches(total, batch_size)
    made = _worded(B) if words else _maker(B, int(ngram_size), int(num_buckets), padded)
    schema = WORDED_SCHEMA if words else BATCH_SCHEMA

    def whole(records):
        for row in _rows(records):
            first = -row["ord"] % B
            count = max(row["n"] - first, 0) // B
            if count:
                to = first + count * B
                yield made((row["ord"] + first) // B, row["words"], row["places"][first:to], row["labels"][first:to])

    def ends(records):
        for row in _rows(records):
            first = min(-row["ord"] % B, row["n"])
            last = max(first, row["n"] - (row["ord"] + row["n"]) % B)
            parts = [(a, b) for a, b in ((0, first), (last, row["n"])) if a < b]
            at = [row["ord"] + a for a, _ in parts]
            words = [row["words"].take(pa.array(row["places"][a:b])) for a, b in parts]
            cols = [pa.array([x // B for x in at], pa.int64()), pa.array(at, pa.int64())]
            cols += [_lists(words, pa.string()), _lists([pa.array(row["labels"][a:b]) for a, b in parts], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["batch_id", "ord", "words", "labels"])

    def joined(records):
        for b in records:
            for k in range(b.num_rows):
                words = b["words"][k].values.dictionary_encode()
                places, labels = (x.to_numpy(zero_copy_only=False) for x in (words.indices, b["labels"][k].values))
                yield made(b["batch_id"][k].as_py(), words.dictionary, places, labels)

    rest = chunks.mapInArrow(ends, "batch_id long, ord long, words array<string>, labels array<int>").where(F.col("batch_id") < nb)
    rest = rest.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("ord", "words", "labels"))).alias("_s"))
    rest = rest.select("batch_id", F.flatten("_s.words").alias("words"), F.flatten("_s.labels").alias("labels"))
    return chunks.mapInArrow(whole, schema).unionByName(rest.mapInArrow(joined, schema))


BATCH_SCHEMA = "batch_id long, inputs array<array<int>>, labels array<int>, width int"
WORDED_SCHEMA = "batch_id long, targets string, labels array<int>"


def hashed_batches(b: DataFrame, ngram_size: int, num_buckets: int) -> DataFrame:
    """``b`` with the padded ``inputs`` and ``width`` of its ``targets`` (``batches`` with ``words``)."""
    b = b.withColumn("targets", F.split("targets", WORD_MARK, -1))
    b = b.withColumn("inputs", buckets_of("targets", ngram_size, num_buckets, nested=True)).drop("targets")
    return pad_batches(b.withColumn("width", F.array_max(F.transform("inputs", F.size)).cast("int")))


def _rows(records):
    for b in records:
        for k in range(b.num_rows):
            places, labels = (b[c][k].values.to_numpy(zero_copy_only=False) for c in ("places", "labels"))
            yield {"ord": b["ord"][k].as_py(), "n": b["n"][k].as_py(), "words": b["words"][k].values, "places": places, "labels": labels}


def _lists(arrays: list, kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([pa.array([], kind), *arrays]))


def _worded(B: int):
    def made(batch_id: int, words: pa.Array, places: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
        count = len(labels) // B
        each = pa.array(np.arange(count + 1, dtype=np.int32) * B)
        targets = pc.binary_join(pa.ListArray.from_arrays(each, words.take(pa.array(places))), WORD_MARK)
        cols = [pa.array(batch_id + np.arange(count)), targets, pa.ListArray.from_arrays(each, pa.array(labels))]
        return pa.RecordBatch.from_arrays(cols, ["batch_id", "targets", "labels"])

    return made


def _maker(B: int, ngram_size: int, num_buckets: int, padded: bool):
    """Function that makes the record of the batches from number ``batch_id`` on, of their words, places and labels."""

    def made(batch_id: int, words: pa.Array, places: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
        count = len(labels) // B
        ends, ids = bucket_lists(words.to_pylist(), ngram_size, num_buckets)
        begin, size = ends[places].astype(np.int64), np.diff(ends)[places].astype(np.int64)
        width = size.reshape(count, B).max(axis=1)
        # each sample has its buckets at the head of its room
        room = np.repeat(width, B) if padded else size
        rooms = np.concatenate([[0], np.cumsum(room)])
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        flat = np.zeros(rooms[-1], np.int32)
        flat[np.repeat(rooms[:-1], size) + inside] = ids[np.repeat(begin, size) + inside]
        each = pa.array(np.arange(count + 1, dtype=np.int32) * B)
        inputs = pa.ListArray.from_arrays(each, pa.ListArray.from_arrays(pa.array(rooms.astype(np.int32)), pa.array(flat)))
        cols = [pa.array(batch_id + np.arange(count)), inputs, pa.ListArray.from_arrays(each, pa.array(labels)), pa.array(width.astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["batch_id", "inputs", "labels", "width"])

    return made


def pad_batches(b: DataFrame) -> DataFrame:
    """Pad every n-gram list of a batch with 0 to the batch width."""
    # exploded, so that the width, which each list needs, isn't made again for each
    b = b.select(*[c for c in b.columns if c != "width"], F.explode(F.array("width")).alias("width"))
    return b.withColumn("inputs", F.transform("inputs", lambda a: pad_expr(a, F.col("width"))))


def with_shards(b: DataFrame, num_batch_files: int) -> DataFrame:
    """``shard = floor(batch_id / 1000) % num_batch_files``."""
    return b.withColumn(
        "shard", F.pmod(F.floor(F.col("batch_id") / SHARD_SWITCH_EVERY), F.lit(int(num_batch_files))).cast("int")
    )


def shuffle_order(b: DataFrame, n: int, seed: int, round_: int = 0) -> DataFrame:
    """A full deterministic shuffle of the ``n`` batches: ``shuffle_rank`` by a keyed permutation, without a sort."""
    return b.select("batch_id", permuted(F.col("batch_id"), n, seed, "shuffle", round_).alias("shuffle_rank"))


def flatten_inputs(b: DataFrame) -> DataFrame:
    """Stored record layout: padded inputs flattened row-major + labels."""
    return b.select("batch_id", F.flatten("inputs").alias("inputs_flat"), "labels")


def unflatten_inputs(stored: DataFrame, batch_size: int, keep: list[str] = ()) -> DataFrame:
    """Reshape ``inputs_flat`` to ``[batch_size, -1]``."""
    B = int(batch_size)
    width = (F.size("inputs_flat") / B).cast("int")
    return stored.select(
        "batch_id",
        *keep,
        F.transform(F.sequence(F.lit(0), F.lit(B - 1)), lambda i: F.slice("inputs_flat", i * width + 1, width)).alias("inputs"),
        "labels",
        width.alias("width"),
    )
