"""Merkle manifest of a dataset: a digest of everything, and for every row the proof that it belongs.

A row's leaf is the hash of its fields; the leaves of a source, in order of their ids, are a stream of
appends. Every ``FAN`` consecutive nodes become their hash, level by level, until one is left, the
source's subroot; the subroots, in order of source, are appended likewise and give the root.

Witnesses grow with the appends. A task reads one aligned block of ``FAN ** LEVELS`` nodes as a stream:
an appended node joins the open run of its level, and when that run is complete its members' partial
witnesses are extended by the siblings and its hash is appended one level up. The roots of the blocks
are appends of the next round, whose witnesses extend those of the blocks' members, and so on until
every source has one node. A leaf's witness is the siblings left and right of its way up.

Rows get their places by a range partitioning and the row counts of the partitions before, so a source
with most of the rows is spread like any other. A task never holds more than one block and one Arrow
batch of blocks. Upper rounds hold one row per block, a ``FAN ** LEVELS``-th of the rows.

Defined cases: a null field is ``-``, a null source an own one that comes first; null ids come first
within their source; equal ids are ordered by leaf, and equal leaves are each a leaf of their own; an
empty table gives an empty result (and no root); other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profila.llm.common import settled

FAN = 16
LEVELS = 2  # of one block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(fields: Sequence[Column]) -> Column:
    """Hash of the fields, each as ``bytes:value``, or ``-`` where it is null."""
    told = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in told]), 256)


class Subtrees:
    """Open subtrees over ``levels`` levels; ``witness[i]`` holds the (left, right) siblings of the i-th append so far."""

    def __init__(self, levels: int, fan: int = FAN):
        self.fan, self.root = fan, None
        self.open: list[list[tuple[str, range]]] = [[] for _ in range(levels)]
        self.witness: list[list[tuple[str, str]]] = []

    def append(self, node: str) -> None:
        n = len(self.witness)
        self.witness.append([])
        self._join(0, node, range(n, n + 1))

    def _join(self, level: int, node: str, members: range) -> None:
        if level == len(self.open):
            self.root = node
            return
        self.open[level].append((node, members))
        if len(self.open[level]) == self.fan:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _ in run]
        for i, (_, members) in enumerate(run):
            siblings = "".join(nodes[:i]), "".join(nodes[i + 1 :])
            for member in members:
                self.witness[member].append(siblings)
        self._join(level + 1, digest("".join(nodes)), range(run[0][1].start, run[-1][1].stop))

    def end(self) -> str:
        """No append follows: open runs are complete as they are. The root."""
        for level, run in enumerate(self.open):
            if run:
                self._complete(level)
        return self.root


def _streamed(nodes: Sequence[str], levels: int) -> Subtrees:
    tree = Subtrees(levels)
    for node in nodes:
        tree.append(node)
    tree.end()
    return tree


def numbered(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``place``, counted from 0 within ``key`` in ``order`` (whose first column is ``key``)."""
    parts = settled(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "merkle-order")
    before = Window.partitionBy(key).orderBy("_part")  # a row per partition that holds rows of the key
    shifts = parts.groupBy(key, "_part").agg(F.count("*").alias("n"), F.min("_at").alias("first")).select(
        key, "_part", (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("shift"))
    return parts.join(shifts, [key, "_part"]).withColumn("place", F.col("_at") + F.col("shift")).drop("_part", "_at", "shift")


def _blocks(nodes: DataFrame, held: Sequence[str], name: str) -> DataFrame:
    """(key, block, n, levels, nodes) from (key, place, *held): n counts the key's nodes, nodes are one block's in order."""
    size = FAN ** LEVELS
    grouped = settled(
        nodes.groupBy("key", F.floor(F.col("place") / size).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("place", *held))).alias("nodes")), name)
    counts = grouped.groupBy("key").agg(F.sum(F.size("nodes")).alias("n"))
    levels = sum((F.col("n") > FAN ** i).cast("int") for i in range(LEVELS))
    return grouped.join(counts, "key").select("key", "block", "n", levels.alias("levels"), "nodes")


def _roots(blocks: DataFrame) -> DataFrame:
    """The blocks' roots as nodes of the next round: key, place, node, n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots = [_streamed(nodes, levels).root for levels, nodes in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(roots, pa.string())], ["key", "place", "n", "node"])

    size = FAN ** LEVELS
    return blocks.select("key", "block", F.ceil(F.col("n") / size).alias("n"), "levels", F.col("nodes.node").alias("nodes")).mapInArrow(
        run, "key string, place long, n long, node string")


def _steps(blocks: DataFrame) -> DataFrame:
    """What a round adds to the witness of each of its nodes: key, at, steps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                found = _streamed([x["node"] for x in row["nodes"]], row["levels"]).witness
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["key"]] * len(found), pa.string()),
                    pa.array([x["place"] for x in row["nodes"]], pa.int64()),
                    pa.array([[{"left": a, "right": z} for a, z in w] for w in found],
                             pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))], ["key", "at", "steps"])

    return blocks.select("key", "levels", "nodes").mapInArrow(run, f"key string, at long, steps {STEPS}")


def _climbed(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rounds until every key has one node: (key, node) of those, and (key, block, up), the blocks' witnesses."""
    nodes = settled(_roots(blocks), "merkle-nodes")
    members = nodes.select("key", F.col("place").alias("block"), F.col("place").alias("at"), F.array().cast(STEPS).alias("up"))
    tops = nodes.where("n = 1").select("key", "node")
    while not (left := nodes.where("n > 1")).isEmpty():
        upper = _blocks(left, ["node"], "merkle-blocks")
        members = settled(
            members.join(_steps(upper), ["key", "at"], "left").select(
                "key", "block", F.floor(F.col("at") / FAN ** LEVELS).alias("at"),
                F.concat("up", F.coalesce("steps", F.array().cast(STEPS))).alias("up")), "merkle-witness")
        nodes = settled(_roots(upper), "merkle-nodes")
        tops = tops.unionByName(nodes.where("n = 1").select("key", "node"))
    return tops, members.select("key", "block", "up")


def _proved(docs: DataFrame, checked: Column | None, told: str, tell, id_col: str, source_col: str, fields: Sequence[str]) -> DataFrame:
    """``tell(leaf, checked, path, root)`` per row, for its columns ``told``; path holds (left, right) pairs.

    ``checked`` takes the place of the text when the leaf is computed once more.
    """
    columns = {c: F.col(c) for c in fields}
    own = leaf(list(columns.values()))
    other = own if checked is None else leaf(list((columns | {"text": checked}).values()))
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))  # null first, then by bytes
    leaves = settled(docs.select(
        key.alias("key"), F.col(id_col).alias("doc_id"), own.alias("node"), other.alias("checked"),
        F.monotonically_increasing_id().alias("_row")), "merkle-leaves")
    # The last column only spreads rows that are equal in all others.
    placed = numbered(leaves, "key", [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("node"), F.col("_row")])
    blocks = _blocks(placed, ["doc_id", "node", "checked"], "merkle-blocks")
    subroots, ways = _climbed(blocks)
    tops = settled(subroots.select(F.lit("").alias("all"), F.col("key").alias("source"), "node"), "merkle-subroots")
    tops = settled(numbered(tops, "all", [F.col("all"), F.col("source")]).select(
        F.col("all").alias("key"), "place", "source", "node"), "merkle-sources")
    over = _blocks(tops, ["node"], "merkle-blocks")
    root, above = _climbed(over)
    root = root.select("node").first()
    if root is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema[id_col].dataType.simpleString()}, {told}")
    root = root["node"]
    size = FAN ** LEVELS
    whole = (
        tops.join(_steps(over).select(F.col("at").alias("place"), "steps"), "place")
        .join(above.select(F.col("block").alias("of"), F.col("up").alias("upper")), F.floor(F.col("place") / size) == F.col("of"))
        .select(F.col("source").alias("key"), F.col("node").alias("subroot"), F.concat("steps", "upper").alias("over")))
    full = blocks.join(ways, ["key", "block"]).join(settled(whole, "merkle-over"), "key").select(
        "levels", "subroot", F.concat("up", "over").alias("up"), "nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_type = b.schema.field("nodes").type.value_type.field("doc_id").type
            for row in b.to_pylist():
                nodes = row["nodes"]
                above = [(s["left"], s["right"]) for s in row["up"]]
                grown = _streamed([x["node"] for x in nodes], row["levels"]).witness
                yield tell(pa.array([x["doc_id"] for x in nodes], id_type), nodes, grown, above, row["subroot"], root)

    return full.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {told}")


def witnesses(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: Sequence[str] = FIELDS,
) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root and ``path``, its siblings level by level as (left, right)."""
    def tell(ids, nodes, grown, above, subroot, root):
        paths = [[{"left": a, "right": z} for a, z in w + above] for w in grown]
        n = len(nodes)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([x["node"] for x in nodes]), pa.array([subroot] * n), pa.array([root] * n),
             pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))],
            ["doc_id", "leaf", "subroot", "root", "path"])

    return _proved(docs, None, f"leaf string, subroot string, root string, path {STEPS}", tell, id_col, source_col, fields)


def audited(
    docs: DataFrame, checked: Column, id_col: str = "doc_id", source_col: str = "source", fields: Sequence[str] = FIELDS,
) -> DataFrame:
    """The manifest held against ``checked``, the texts found now: does each row still lead to the root?

    Per row: doc_id, leaf, subroot, root, proof_sha256 (of the siblings, level by level), folded_root (from
    the leaf with the text found now) and verified.
    """
    def tell(ids, nodes, grown, above, subroot, root):
        rest, way = "".join(a + z for a, z in above), {}

        def folded(node, path):
            for left, right in path:
                node = digest(left + node + right)
            return node

        proofs, roots = [], []
        for x, own in zip(nodes, grown):
            proofs.append(digest("".join(a + z for a, z in own) + rest))
            reached = folded(x["checked"], own)
            if reached not in way:  # rows of a block that reach one node share the way from there
                way[reached] = folded(reached, above)
            roots.append(way[reached])
        n = len(nodes)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([x["node"] for x in nodes]), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs),
             pa.array(roots), pa.array([r == root for r in roots], pa.bool_())],
            ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    told = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _proved(docs, checked, told, tell, id_col, source_col, fields)
