"""Cost-balanced packing of documents into fixed-length training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention stays
inside a piece). Every full ``seq_len`` tokens of a document make a sequence
of their own. All pieces are dealt by a hash to groups of about
``GROUP_BYTES`` of text; a group with R remaining tokens opens R // seq_len
sequences of ``seq_len`` and one for each power of two in R % seq_len, so that
no padding is needed. Pieces go in descending order to the lowest-cost
sequence with room for them; a piece that fits nowhere is cut at the
lowest-cost sequence with any room left.

Pieces are dealt one by one, so neither a long document nor equal rows meet in
one group. Null and empty texts are packed as the end id alone. Repeated
doc_ids are packed row by row. An empty table gives no row; other columns are ignored.
Ties are broken by doc_id (null last), then the ids' checksum.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramvec.llm.common import shipped

from gramvec.llm.huffman_ids import squeeze, unsqueeze
from gramvec.llm.tokens import encoder, slices

SEQ_LEN = 4096
#: Cost of a token, and of a token pair in attention, for a model 4096 wide.
LINEAR, QUADRATIC = 1.0, 1.0 / (6 * 4096)
#: Bytes of text whose pieces are packed together.
GROUP_BYTES = 4_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def assign(lengths: np.ndarray, capacity: np.ndarray, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """``(item, start, length, sequence, offset)`` of pieces of descending ``lengths`` in sequences of ``capacity``.

    The capacities must hold all items.
    """
    room, cost = capacity.astype(np.int64), np.zeros(len(capacity))
    out = []
    for item, n in enumerate(lengths.tolist()):
        start = 0
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0
            seq = int(np.where(fits, cost, np.inf).argmin())
            put = min(n, int(room[seq]))
            out.append((item, start, put, seq, int(capacity[seq] - room[seq])))
            cost[seq] += linear * put + quadratic * put * put
            room[seq] -= put
            start, n = start + put, n - put
    return out


def capacities(tokens: int, seq_len: int) -> np.ndarray:
    """Sequences that hold exactly ``tokens``: full ones and one per power of two in the rest."""
    rest = tokens % seq_len
    return np.array([seq_len] * (tokens // seq_len) + [1 << b for b in range(rest.bit_length())[::-1] if rest >> b & 1], np.int64)


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    end_id: int = 2,
    seq_len: int = SEQ_LEN,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece (``PIECES``, with ``ids`` if ``with_ids``); ``sequence_id`` is group * 2^32 + number in the group.

    The sequences are built with all their ids; ``ids`` and ``ids_crc32`` are read from them.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    groups = ((size["b"] or 0) + 8 * size["n"]) // GROUP_BYTES + 1

    def tokenize(batches):
        enc = encoder(tokenizer_path)
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in slices(batches):
            ids, at = enc.encode(batch.column("text").to_pylist())
            rows = []
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                own = np.append(ids[a:b], np.uint32(end_id))
                name = -1 if doc_id is None else doc_id, crc(own)
                seen[name] += 1
                for start in range(0, len(own), seq_len):
                    piece = own[start : start + seq_len]
                    # equal rows of a partition are numbered, whatever their order, so a retry deals them alike
                    group = zlib.crc32(b"%d|%d|%d|%d|%d" % (*name, start, part, seen[name])) % groups
                    rows.append((group, doc_id or 0, doc_id is None, start, len(piece), len(own), crc(piece), squeeze(piece)))
            kinds = [pa.int64(), pa.int64(), pa.bool_()] + [pa.int64()] * 4 + [pa.binary()]
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)],
                ["grp", "doc_id", "none", "start", "length", "doc_tokens", "crc", "ids"],
            )

    def place(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "none", "doc_id", "crc", "start"], ascending=[False, True, True, True, True], kind="stable")
        full = pdf["length"].to_numpy() == seq_len
        n_full, rest = int(full.sum()), pdf[~full]
        base = int(key[0]) << 32
        held = capacities(int(rest["length"].sum()), seq_len)
        placed = assign(rest["length"].to_numpy(), held, linear, quadratic)
        head = pdf[full]
        item, cut, length, seq, offset = (np.array(c, np.int64) for c in (zip(*placed) if placed else [[]] * 5))
        src = rest.iloc[item]
        doc_id, none = (np.concatenate([head[c], src[c]]) for c in ("doc_id", "none"))
        # the sequences, one after another, and where each piece stands in them
        room = np.concatenate([np.full(n_full, seq_len, np.int64), held])
        begin = np.cumsum(room) - room
        sequences = np.zeros(int(room.sum()), np.uint32)
        at = np.concatenate([begin[:n_full], begin[n_full + seq] + offset]).astype(np.int64)
        lengths = np.concatenate([head["length"], length]).astype(np.int64)
        for i, x in enumerate(head["ids"]):
            sequences[at[i] : at[i] + seq_len] = unsqueeze(x)
        ids = [unsqueeze(x) for x in rest["ids"]]
        for to, (i, c, n, _, _) in zip(at[n_full:].tolist(), placed):
            sequences[to : to + n] = ids[i][c : c + n]
        pieces = [sequences[a : a + n] for a, n in zip(at.tolist(), lengths.tolist())]
        out = pd.DataFrame(
            {
                "doc_id": np.where(none.astype(bool), None, doc_id.astype(object)),
                "start": np.concatenate([head["start"], src["start"].to_numpy() + cut]).astype(np.int64),
                "length": lengths,
                "ids_crc32": np.array([crc(x) for x in pieces], np.int64),
                "doc_tokens": np.concatenate([head["doc_tokens"], src["doc_tokens"]]).astype(np.int64),
                "sequence_id": base + np.concatenate([np.arange(n_full), n_full + seq]).astype(np.int64),
                "offset": np.concatenate([np.zeros(n_full, np.int64), offset]).astype(np.int64),
            }
        )
        out["cost"] = linear * out["length"] + quadratic * out["length"] ** 2.0
        if with_ids:
            out["ids"] = [x.astype(np.int64) for x in pieces]
        return out

    pieces = shipped(docs).mapInArrow(tokenize, "grp long, doc_id long, none boolean, start long, length long, doc_tokens long, crc long, ids binary")
    return pieces.groupBy("grp").applyInPandas(place, PIECES + (", ids array<long>" if with_ids else ""))
