"""Merkle manifest of a dataset, its upper proofs exchanged like a butterfly.

Each row is a leaf: the hash of its fields, each ``-`` if null, else its UTF-8
byte count, ``:`` and the value. Within a language, leaves ascend by doc_id;
every ``FANOUT`` consecutive nodes become one node of the next level until one
is left, the subroot. Subroots in the order of the languages (null first,
UTF-8 bytewise) become the root in the same way.

Leaves are dealt to aligned blocks of ``FANOUT ** LEVELS``. A block hashes its
own subtree. Then, round by round, groups of ``FANOUT`` blocks that differ in
one base-``FANOUT`` digit of their number swap the roots they hold, and every
block hashes the parent for itself, so that after the last round each has all
its siblings up to the subroot and no pass leads back down. A ragged last
ancestor has fewer blocks than the groups that need its root: its blocks
send copies to those groups in turn. Languages are exchanged in the same way
up to the root.

A proof is an array of levels, each with the siblings left and right of the
path, as hex digests put together; hashing ``left + node + right`` level by
level gives the root (``folded``).

A null doc_id comes before all others; rows of equal doc_id ascend by leaf, so
repeated rows have a leaf each and their order doesn't matter. A null language
is one of its own, other than the empty one. Null and empty texts differ. An
empty table gives no row; extra columns are ignored. Blocks, not languages or
ids, are the unit of work, so no frequent language or id makes a large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gramvec.llm.common import staged
from gramvec.operators.joins import bounded_join
from gramvec.operators.ordinals import global_ordinal

FANOUT = 8
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


def sha256(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it enters the leaf."""
    s = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(fields: list[Column]) -> Column:
    return sha256(F.concat(*[field(c) for c in fields]))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ordered_language() -> Column:
    """Sorts like the language, null first, and differs for null and empty."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))


def leaves(docs: DataFrame, **more: Column) -> DataFrame:
    """``doc_id, tree`` (the language's sort key), ``leaf`` and further columns of every row, written once."""
    made = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        ordered_language().alias("tree"),
        leaf([F.col(c) for c in FIELDS]).alias("leaf"),
        F.monotonically_increasing_id().alias("row"),
        *[c.alias(n) for n, c in more.items()],
    )
    return staged(made, "merkle-leaves")


# ------------------------------------------------------------------ local trees
def digest(data: str) -> str:
    return hashlib.sha256(data.encode("ascii")).hexdigest()


def levels_of(nodes: list[str], last: bool, fanout: int, most: int) -> list[list[str]]:
    """The levels of a subtree, leaves first. ``last``: stop at one node; else always ``most`` levels above the leaves."""
    out = [nodes]
    while len(out) <= most and not (last and len(out[-1]) == 1):
        below = out[-1]
        out.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def local_proof(levels: list[list[str]], at: int, fanout: int) -> list[dict[str, str]]:
    """Siblings of leaf ``at`` on each level below the top."""
    out = []
    for nodes in levels[:-1]:
        first = at // fanout * fanout
        out.append({"left": "".join(nodes[first:at]), "right": "".join(nodes[at + 1 : first + fanout])})
        at //= fanout
    return out


def blocks_of(ranked: DataFrame, more: list[str], fanout: int, levels: int) -> DataFrame:
    """One row per aligned block: its leaves packed together, and the root of its subtree.

    ``ranked`` has ``tree, at`` (position in the tree), ``size`` (of the
    tree), ``doc_id, leaf`` and the columns ``more``. A block holds at most
    ``fanout ** levels`` narrow rows.
    """
    span = fanout**levels

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        nodes = group["leaf"].tolist()
        size = int(group["size"].iloc[0])
        root = levels_of(nodes, size <= span, fanout, levels)[-1][0]
        row = {
            "tree": group["tree"].iloc[0],
            "block": int(group["at"].iloc[0]) // span,
            "blocks": -(-size // span),
            "size": size,
            "node": root,
            "ids": group["id"].to_numpy(np.int64).tobytes(),
            "known": np.packbits(group["known"].to_numpy(bool)).tobytes(),
            "leaves": bytes.fromhex("".join(nodes)),
        }
        for c in more:
            row[c] = "\n".join("" if pd.isna(v) else str(v) for v in group[c])
        return pd.DataFrame([row])

    schema = "tree string, block long, blocks long, size long, node string, ids binary, known binary, leaves binary"
    schema += "".join(f", `{c}` string" for c in more)
    id_ = F.coalesce("doc_id", F.lit(0)).alias("id")  # beside nulls, ids would turn into floats
    rows = ranked.select("tree", "at", "size", id_, F.col("doc_id").isNotNull().alias("known"), "leaf", *more)
    rows = rows.withColumn("block", F.floor(F.col("at") / span))
    return rows.groupBy("tree", "block").applyInPandas(pack, schema)


# -------------------------------------------------------------------- butterfly
def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``tree, block, root, proof`` for every block of ``nodes(tree, block, blocks, node)``.

    Round r: blocks that agree in all base-``fanout`` digits but digit r swap
    the ancestors they hold, at most ``fanout`` rows a group.
    """
    most = nodes.agg(F.max("blocks")).first()[0] or 1
    rows = nodes.select("tree", "block", "blocks", "node", F.array().cast("array<struct<left: string, right: string>>").alias("proof"))
    width = 1
    while width < most:
        below, ancestor = F.col("block") % width, F.floor(F.col("block") / width)
        held = F.least(F.lit(width), F.col("blocks") - ancestor * width)  # blocks under this ancestor
        sent = rows.withColumn("low", F.explode(F.sequence(below, F.lit(width - 1).cast("long"), held))).withColumn("digit", ancestor % fanout)
        group = W.partitionBy("tree", "parent", "low")
        swapped = sent.withColumn("parent", F.floor(F.col("block") / (width * fanout))).withColumn(
            "run", F.array_sort(F.collect_list(F.struct("digit", "node")).over(group))
        )

        def side(keep):
            return F.array_join(F.transform(F.filter("run", keep), lambda x: x["node"]), "")

        step = F.struct(side(lambda x: x["digit"] < F.col("digit")).alias("left"), side(lambda x: x["digit"] > F.col("digit")).alias("right"))
        grows = F.col("blocks") > width  # trees of one node at this level are done
        rows = swapped.where(F.col("low") == F.col("block") % width).select(
            "tree",
            "block",
            "blocks",
            F.when(grows, sha256(F.array_join(F.transform("run", lambda x: x["node"]), ""))).otherwise(F.col("node")).alias("node"),
            F.when(grows, F.concat("proof", F.array(step))).otherwise(F.col("proof")).alias("proof"),
        )
        width *= fanout
    return rows.select("tree", "block", F.col("node").alias("root"), "proof")


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, **more: Column) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof`` of every row, and the columns ``more`` (hex digests, or null)."""
    rows = leaves(docs, **more)
    ranked = global_ordinal(rows, ["tree", F.col("doc_id").asc_nulls_first(), "leaf", "row"], name="ord")
    trees = staged(ranked.groupBy("tree").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("size")), "merkle-trees")
    # the language table is broadcast only if its measured size allows
    n, wide = trees.agg(F.count(F.lit(1)), F.max(F.octet_length("tree"))).first()
    width = 64 + (wide or 0)
    placed = bounded_join(ranked, trees, "tree", n, width).withColumn("at", F.col("ord") - F.col("first"))
    packed = staged(blocks_of(placed, list(more), fanout, levels), "merkle-blocks")
    upper = staged(butterfly(packed.select("tree", "block", "blocks", "node"), fanout), "merkle-proofs")
    numbered = global_ordinal(upper.where("block = 0").select("tree", F.col("root").alias("node")), ["tree"], name="block")
    top = butterfly(numbered.select(F.lit("").alias("tree"), "block", F.lit(n).cast("long").alias("blocks"), "node"), fanout)
    top = top.join(numbered.select("block", F.col("tree").alias("language")), "block").select(
        F.col("language").alias("tree"), F.col("root").alias("top"), F.col("proof").alias("top_proof")
    )
    proved = bounded_join(upper, staged(top, "merkle-top"), "tree", n, width + 1100 * 8)
    rest = proved.select("tree", "block", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("proof", "top_proof").alias("upper"))
    return unpacked(packed.join(rest, ["tree", "block"]), list(more), fanout, levels)


def unpacked(blocks: DataFrame, more: list[str], fanout: int, levels: int) -> DataFrame:
    """A row per leaf, its proof put together from the block's own tree and the upper levels."""
    span, rows_at_once = fanout**levels, 2048
    step = pa.struct([("left", pa.string()), ("right", pa.string())])
    names = ["doc_id", "leaf", "subroot", "root", "proof", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                text = row["leaves"].hex()
                nodes = [text[k : k + 2 * DIGEST] for k in range(0, len(text), 2 * DIGEST)]
                tree = levels_of(nodes, row["size"] <= span, fanout, levels)
                ids = np.frombuffer(row["ids"], np.int64)
                unknown = np.unpackbits(np.frombuffer(row["known"], np.uint8))[: len(ids)] == 0
                extra = {c: [v or None for v in row[c].split("\n")] for c in more}
                for at in range(0, len(nodes), rows_at_once):
                    to = min(len(nodes), at + rows_at_once)
                    proofs = [local_proof(tree, k, fanout) + row["upper"] for k in range(at, to)]
                    yield pa.record_batch(
                        [
                            pa.array(ids[at:to], mask=unknown[at:to]),
                            pa.array(nodes[at:to]),
                            pa.array([row["subroot"]] * (to - at)),
                            pa.array([row["root"]] * (to - at)),
                            pa.array(proofs, pa.list_(step)),
                            *[pa.array(extra[c][at:to], pa.string()) for c in more],
                        ],
                        names,
                    )

    schema = "doc_id long, leaf string, subroot string, root string, proof array<struct<left: string, right: string>>"
    return blocks.mapInArrow(run, schema + "".join(f", `{c}` string" for c in more))


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, node, lambda acc, x: sha256(F.concat(x["left"], acc, x["right"])))


def proof_digest(proof: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return sha256(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""))


def verified_manifest(docs: DataFrame, tampered: Column, changed: dict[str, Column]) -> DataFrame:
    """The manifest of ``docs`` held against a copy whose fields ``changed`` differ where ``tampered``.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.
    """
    other = F.when(tampered, leaf([changed.get(c, F.col(c)) for c in FIELDS]))
    found = manifest(docs, other=other)
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("proof")).alias("proof_sha256"),
        folded(F.coalesce("other", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 10) -> str:
    """DuckDB SQL for the query, the levels written one after the other."""
    def enter(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    def hashed(text):
        return "sha256(" + " || ".join(enter(c) if c != "text" else f"CASE WHEN text IS NULL THEN '-' ELSE strlen({text})::VARCHAR || ':' || {text} END" for c in FIELDS) + ")"

    # crc32 of the decimal id: per byte one exclusive or and eight shifts (marked -1)
    steps = "flatten(list_transform(range(1, length(t) + 1), lambda i: [ord(t[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce([4294967295::BIGINT] || {steps}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"

    def climb(name: str, source: str, tree: str) -> list[str]:
        """CTEs that climb from ``source(tree, pos, node, path)`` to one node a tree; every row keeps its own path."""
        out = []
        for k in range(levels):
            src = source if k == 0 else f"{name}{k - 1}"
            out.append(
                f"""{name}{k}n AS (SELECT {tree}, pos, any_value(node) AS node, count(*) OVER (PARTITION BY {tree}) AS m FROM {src} GROUP BY {tree}, pos),
{name}{k}p AS (SELECT {tree}, pos // {FANOUT} AS up, any_value(m) AS m, sha256(string_agg(node, '' ORDER BY pos)) AS node, list(node ORDER BY pos) AS run FROM {name}{k}n GROUP BY {tree}, pos // {FANOUT}),
{name}{k} AS (SELECT s.* EXCLUDE (pos, node, path), CASE WHEN p.m > 1 THEN p.up ELSE s.pos END AS pos, CASE WHEN p.m > 1 THEN p.node ELSE s.node END AS node,
  CASE WHEN p.m > 1 THEN s.path || [[array_to_string(p.run[1 : s.pos % {FANOUT}], ''), array_to_string(p.run[s.pos % {FANOUT} + 2 :], '')]] ELSE s.path END AS path
  FROM {src} s JOIN {name}{k}p p ON s.{tree} = p.{tree} AND s.pos // {FANOUT} = p.up)"""
            )
        return out

    return ",\n".join(
        [
            f"""WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {hashed('text')} AS leaf, {hashed(low)} AS other, doc_id::VARCHAR AS t FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS node, []::VARCHAR[][] AS path FROM d)""",
            *climb("a", "e", "tree"),
            f"""f AS (SELECT * EXCLUDE (pos), node AS subroot, dense_rank() OVER (ORDER BY tree) - 1 AS pos, 0 AS whole FROM a{levels - 1})""",
            *climb("b", "f", "whole"),
            f"""g AS (SELECT *, CASE WHEN t IS NOT NULL AND {crc} % 3 = 0 THEN other ELSE leaf END AS seen FROM b{levels - 1}),
h AS (SELECT *, list_reduce([seen] || list_transform(path, lambda p: p[1] || '|' || p[2]), lambda acc, p: sha256(split_part(p, '|', 1) || acc || split_part(p, '|', 2))) AS folded_root FROM g)
SELECT doc_id, leaf, subroot, node AS root, sha256(array_to_string(flatten(path), '')) AS proof_sha256, folded_root, folded_root = node AS verified FROM h""",
        ]
    )
