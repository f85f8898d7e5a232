"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and every row's proof.

Every three consecutive nodes become one until one is left. A tree is worked on in superblocks of ``3^HEIGHT`` nodes: going up, each
superblock gives one node to a smaller table, until a group is one node; going down, the rows of a superblock are cogrouped
with the outer nodes that they need, which are the siblings on the way from the superblock to the root. That task then has all
it needs for the proofs of its rows, and no task or driver holds more than a superblock and one path.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelab.operators.joins import attach_small
from sievelab.sources.scratch import save_table

ARITY = 3
HEIGHT = 7  # levels of a superblock, which so has at most 2,187 nodes
LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DIGEST = 64  # hex digits
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
Level = tuple[bytes, bytes]  # what stands before and behind a node in its run


def digest(raw: bytes) -> bytes:
    return hashlib.sha256(raw).hexdigest().encode()


def levels_of(size: int) -> int:
    """How often ``size`` nodes are joined by threes until one is left."""
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Digest of the fields' values in order; each is its UTF-8 length, a colon and itself, or a dash if it is null."""
    value = lambda c: c.cast("string")
    each = [F.coalesce(F.concat(F.octet_length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-")) for c in fields.values()]
    return F.sha2(F.concat(*each), 256)


def grown(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of each level, from the given ones to what ``levels`` levels of joining leave."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([digest(b"".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return found


def level_at(nodes: list[bytes], at: int) -> Level:
    run = at - at % ARITY
    return b"".join(nodes[run:at]), b"".join(nodes[at + 1 : run + ARITY])


def folded(node: bytes, path: list[Level]) -> bytes:
    for before, behind in path:
        node = digest(before + node + behind)
    return node


def path_bytes(path: list[Level]) -> bytes:
    """A path as bytes: for each level the number of nodes before and behind, and their digests."""
    return b"".join(bytes([len(a) // DIGEST, len(b) // DIGEST]) + a + b for a, b in path)


def path_of(raw: bytes) -> list[Level]:
    at, path = 0, []
    while at < len(raw):
        a, b = DIGEST * raw[at], DIGEST * raw[at + 1]
        path.append((raw[at + 2 : at + 2 + a], raw[at + 2 + a : at + 2 + a + b]))
        at += 2 + a + b
    return path


class Part(NamedTuple):
    """One superblock: its group and number, the rows in order, and its nodes by level."""

    group: str
    block: int
    rows: pd.DataFrame
    tree: list[list[bytes]]

    def paths(self) -> list[list[Level]]:
        """Each node's siblings inside the superblock; the three of a run share what is above them."""
        above: list[list[Level]] = [[]]
        for nodes in reversed(self.tree[:-1]):
            above = [[level_at(nodes, i), *above[i // ARITY]] for i in range(len(nodes))]
        return above


def parts(frame: pd.DataFrame, cap: int) -> Iterator[Part]:
    """The superblocks in a frame with group_key, pos, size and node."""
    height = levels_of(cap)
    frame = frame.assign(block=frame["pos"] // cap)
    for (group, block), rows in frame.groupby(["group_key", "block"], sort=False):
        rows = rows.sort_values("pos")
        size = int(rows["size"].iloc[0])
        nodes = [x.encode() for x in rows["node"]]
        yield Part(group, int(block), rows, grown(nodes, height if size > cap else levels_of(size)))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, from 0 in each group by ``order``, and the group's ``size``. Rows that are equal in ``order`` may stand in any order.

    Rows are range partitioned and sorted once; positions come from the ranges' counts, so a group of any size is no single task.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [group, *order, "__tie"]
    placed = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    held = save_table(placed.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    held = held.withColumn("__range", F.shiftright("__at", 33))
    spans = held.groupBy(group, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    whole = Window.partitionBy(group)
    upto = F.sum("__rows").over(whole.orderBy("__range"))
    spans = spans.select(group, "__range", "__first", (upto - F.col("__rows")).alias("__before"), F.sum("__rows").over(whole).alias("size"))
    joined = attach_small(held, save_table(spans, "spans"), [group, "__range"])
    pos = F.col("__before") + F.col("__at") - F.col("__first")
    return joined.withColumn("pos", pos).drop("__at", "__range", "__first", "__before")


class Forest:
    """The trees of all groups of ``rows`` (group_key, pos, size, node, ...), as one table for each height of superblocks."""

    def __init__(self, rows: DataFrame, height: int = HEIGHT):
        self.cap = ARITY**height
        self.stages, finished = [], []
        while True:
            # groups of one superblock share tasks
            small = rows.agg(F.count(F.when(F.col("size") <= self.cap, 1)), F.max("size")).first()
            if small[1] is None:
                break
            bundles = math.ceil(small[0] / self.cap) or 1
            self.stages.append((rows, bundles))
            up = save_table(self._lumps(rows, bundles).groupBy("lump").applyInPandas(self._tops(), "group_key string, pos long, size long, node string"), "nodes")
            finished.append(up.where("size = 1"))
            rows = up.where("size > 1")
        self.tops = reduce(DataFrame.union, finished).select("group_key", "node") if finished else None

    def _lumps(self, rows: DataFrame, bundles: int, pos: str = "pos") -> DataFrame:
        """Rows with the number of the task they belong to: that of their superblock, or of a bundle of small groups."""
        large = F.xxhash64("group_key", F.floor(F.col(pos) / self.cap).cast("long"))
        bundle = F.xxhash64(F.pmod(F.xxhash64("group_key"), F.lit(bundles)))
        return rows.withColumn("lump", F.when(F.col("size") > self.cap, large).otherwise(bundle))

    def _tops(self):
        cap = self.cap

        def tops(frame: pd.DataFrame) -> pd.DataFrame:
            found = [(p.group, p.block, -(-int(p.rows["size"].iloc[0]) // cap), p.tree[-1][0].decode()) for p in parts(frame, cap)]
            return pd.DataFrame(found, columns=["group_key", "pos", "size", "node"])

        return tops

    def _exchange(self, stage: int, outer: DataFrame, work, schema: str) -> DataFrame:
        """Cogroups a stage's rows with the paths of their superblocks (group_key, pos of the superblock, size, path, subroot, root)."""
        rows, bundles = self.stages[stage]
        first = outer.withColumn("at", F.col("pos") * self.cap)
        left = self._lumps(rows, bundles).groupBy("lump")
        return left.cogroup(self._lumps(first, bundles, "at").drop("at").groupBy("lump")).applyInPandas(work, schema)

    def descend(self, roots: DataFrame, work, schema: str) -> DataFrame:
        """Applies ``work`` to the lowest rows and their outer nodes. ``roots`` has each group's path from its top to the root."""
        cap = self.cap
        path_schema = "group_key string, pos long, path binary, subroot string, root string"

        def paths(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
            of = outer_rows(outer)
            found = []
            for part in parts(nodes, cap):
                above = of[part.group, part.block]
                for pos, path in zip(part.rows["pos"], part.paths(), strict=True):
                    found.append((part.group, pos, path_bytes(path) + above.path, above.subroot, above.root))
            return pd.DataFrame(found, columns=["group_key", "pos", "path", "subroot", "root"])

        higher = None
        for stage in reversed(range(len(self.stages))):
            rows, _ = self.stages[stage]
            sizes = rows.where("pos = 0").select("group_key", "size")
            outer = attach_groups(roots, sizes.where(F.col("size") <= cap)).withColumn("pos", F.lit(0).cast("long"))
            if higher is not None:
                outer = outer.unionByName(attach_groups(higher, sizes.where(F.col("size") > cap)))
            if stage:
                higher = save_table(self._exchange(stage, outer, paths, path_schema), "paths")
        return self._exchange(0, outer, work, schema)


def attach_groups(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of the groups in ``sizes``, with their size."""
    return attach_small(rows, sizes, ["group_key"])


class Outer(NamedTuple):
    path: bytes
    subroot: str
    root: str


def outer_rows(frame: pd.DataFrame) -> dict[tuple[str, int], Outer]:
    columns = [frame[c] for c in ("group_key", "pos", "path", "subroot", "root")]
    return {(g, int(b)): Outer(bytes(p), s, r) for g, b, p, s, r in zip(*columns, strict=True)}


def proofs_in(cap: int):
    """For cogrouped rows (doc_id, node, presented) and outer nodes: each row's proof digest, and the root that what is presented gives."""

    def work(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        of, found = outer_rows(outer), []
        for part in parts(leaves, cap):
            above = of[part.group, part.block]
            rest = path_of(above.path)
            behind = b"".join(a + b for a, b in rest)
            columns = [part.rows[c] for c in ("doc_id", "node", "presented")]
            for (doc, leaf, presented), path in zip(zip(*columns, strict=True), part.paths(), strict=True):
                proof = digest(b"".join(a + b for a, b in path) + behind).decode()
                root = folded(folded(presented.encode(), path), rest).decode()
                found.append((doc, leaf, above.subroot, above.root, proof, root, root == above.root))
        frame = pd.DataFrame(found, columns=[x.split()[0] for x in PROOFS.split(", ")])
        return frame.astype({"doc_id": "Int64"})

    return work


def dataset_manifest(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Proofs of all ``leaves`` (group, doc_id, leaf, presented): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A group's leaves ascend by doc_id, then leaf; groups by their name as bytes; null is first in both. ``presented`` is the leaf that
    a reader has computed; folded with the row's siblings it gives folded_root. Other columns are ignored. An empty table has no rows.
    """
    key = F.coalesce(F.concat(F.lit("1"), F.col("group").cast("string")), F.lit("0"))
    rows = leaves.select(key.alias("group_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("leaf").alias("node"), "presented")
    trees = Forest(save_table(numbered(save_table(rows, "leaves"), "group_key", ["doc_id", "node"]), "numbered"), height)
    if trees.tops is None:
        return leaves.sparkSession.createDataFrame([], PROOFS)
    tops = save_table(trees.tops, "subroots").select(F.lit("").alias("group_key"), F.col("group_key").alias("name"), "node")
    over = Forest(save_table(numbered(tops, "group_key", ["name"]), "numbered-subroots"), height)
    root = over.tops.first()["node"]  # one row
    whole = leaves.sparkSession.createDataFrame([("", b"", "", root)], "group_key string, path binary, subroot string, root string")
    roots = over.descend(whole, group_paths(over.cap), "group_key string, path binary, subroot string, root string")
    return trees.descend(save_table(roots, "group-paths"), proofs_in(trees.cap), PROOFS)


def group_paths(cap: int):
    """For cogrouped subroots (name, node): each group's path to the root."""

    def work(tops: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        of, found = outer_rows(outer), []
        for part in parts(tops, cap):
            above = of[part.group, part.block]
            for name, node, path in zip(part.rows["name"], part.rows["node"], part.paths(), strict=True):
                found.append((name, path_bytes(path) + above.path, node, above.root))
        return pd.DataFrame(found, columns=["group_key", "path", "subroot", "root"])

    return work


def document_leaves(docs: DataFrame) -> DataFrame:
    """group, doc_id, leaf and presented of each document; where 2 divides the crc32 of the id, the presented text has lost its line
    breaks. A null id is never tampered with."""
    fields = {c: F.col(c) for c in LEAF_FIELDS}
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    lost = leaf_digest(fields | {"text": F.translate("text", "\n", "")})
    leaf = leaf_digest(fields)
    presented = F.when(even & F.contains("text", F.lit("\n")), lost).otherwise(F.col("leaf"))
    return docs.withColumn("leaf", leaf).select(F.col("source").alias("group"), "doc_id", "leaf", presented.alias("presented"))


def verify_documents(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest's proofs of ``docs``, by source, checked against texts that were tampered with."""
    return dataset_manifest(document_leaves(docs), height)
