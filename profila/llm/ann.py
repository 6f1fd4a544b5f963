"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is built on the driver from at most about ``sample`` vectors; every row is then assigned to
a leaf by descent. A query walks the tree with a priority queue of branches and lists the leaves it
would visit, nearest first. How many leaves are visited is widened until the recall among sampled
vectors reaches ``recall``. Queries then meet the rows of their leaves in blocks of bounded size, so
a leaf with very many equal vectors, or very many queries, is spread over tasks; each block gives
its best ``k`` per query. Scores are cosines of the original vectors, in double precision, summed in
one fixed order, so equal vectors tie exactly.

A walk goes on until the leaves it met hold ``k`` rows besides the query.

Defined cases: vectors that are null, zero or of another length than the commonest sampled one (the shorter
of equals), or hold null or non-finite components, take no part; null ids neither; equal scores go to the smaller id; a
query is not its own answer; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profila.llm.common import settled
from profila.llm.langid import clusters, unit

SAMPLE = 16_384
BRANCHES = 8
LEAF = 48
RECALL = 0.97
ROW_BLOCK, QUERY_BLOCK = 4096, 1024
SEED = 3


@dataclass
class Tree:
    """Node i has unit ``centres[i]`` and ``children[i]``; a leaf has none and is numbered by ``leaf[i]``."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[np.ndarray] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def grow(self, rows: np.ndarray, centre: np.ndarray, branches: int, size: int, seed: int) -> int:
        here = len(self.centres)
        self.centres.append(centre)
        self.children.append(np.zeros(0, np.int64))
        self.leaf.append(-1)
        centres = clusters(rows, branches, 8, seed) if len(rows) > size else rows[:0]
        own = (rows @ centres.T).argmax(axis=1) if len(centres) > 1 else np.zeros(len(rows), int)
        if len(np.unique(own)) < 2:
            self.leaf[here], self.leaves = self.leaves, self.leaves + 1
            return here
        self.children[here] = np.array(
            [self.grow(rows[own == i], centres[i], branches, size, seed + i) for i in np.unique(own)])
        return here

    def assign(self, rows: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if self.leaf[node] >= 0:
                out[at] = self.leaf[node]
            elif len(at):
                below = self.children[node]
                own = (rows[at] @ np.stack([self.centres[c] for c in below]).T).argmax(axis=1)
                todo += [(c, at[own == i]) for i, c in enumerate(below)]
        return out

    def visits(self, query: np.ndarray, most: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves, by a queue of branches ordered by cosine; more while they hold under ``least`` rows."""
        queue, out, met = [(-1.0, 0)], [], 0
        while queue and (len(out) < most or met < least):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                met += (sizes or {}).get(self.leaf[node], 0)
                continue
            below = self.children[node]
            near = np.stack([self.centres[c] for c in below]) @ query
            for c, s in zip(below, near):
                heapq.heappush(queue, (-float(s), int(c)))
        return out


def calibrated(tree: Tree, rows: np.ndarray, k: int, recall: float, seed: int, tests: int = 256) -> int:
    """Leaves to visit, doubled (finally by half) until sampled queries find their ``k`` nearest."""
    leaf = tree.assign(rows)
    chosen = np.random.default_rng(seed).permutation(len(rows))[:tests]
    places = []
    for q in chosen:
        near = rows @ rows[q]
        near[q] = -2
        top = np.argsort(-near, kind="stable")[:k]
        order = {n: i for i, n in enumerate(tree.visits(rows[q], tree.leaves))}
        places += [order[n] for n in leaf[top]]
    places = np.sort(places)
    need = int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1 if len(places) else 1
    visits = 1
    while visits < need:
        visits = min(tree.leaves, max(visits + 1, visits * 3 // 2))
    return visits


def _vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows of a column of arrays, as doubles, and their places."""
    rows, at = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == (width or len(v)) and None not in v:
            v = np.array(v, np.float64)
            if np.isfinite(v).all() and v.any():
                rows.append(v)
                at.append(i)
    return (np.stack(rows) if rows else np.zeros((0, max(width, 1)))), np.array(at, np.int64)


def _cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    def dots(a, b):
        out = np.zeros((len(a), len(b)))
        for d in range(a.shape[1]):
            out += a[:, d, None] * b[None, :, d]
        return out

    def norms(a):
        out = np.zeros(len(a))
        for d in range(a.shape[1]):
            out += a[:, d] * a[:, d]
        return np.sqrt(out)

    return dots(queries, rows) / (norms(queries)[:, None] * norms(rows)[None, :])


def nearest(
    vectors: DataFrame, is_query, k: int = 5, sample: int = SAMPLE, recall: float = RECALL, seed: int = SEED,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score. ``is_query`` is a condition on the id column ``vec_id``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        "vec_id is not null and v is not null")
    schema = "query_id long, rank int, vec_id long, score double"
    bound = min(1 << 30, (sample << 30) // max(rows.count(), 1))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < bound).orderBy("vec_id")
    held = pa.array([r["v"] for r in drawn.collect()], pa.list_(pa.float64()))
    lengths = Counter(len(v) for v in held if v.is_valid).most_common()
    width = min((n for n, c in lengths if c == lengths[0][1] and n), default=0)
    points, _ = _vectors(held, width)
    if not width or not len(points):
        return spark.createDataFrame([], schema)
    width, points = points.shape[1], unit(points)
    tree = Tree()
    tree.grow(np.unique(points, axis=0), points.mean(axis=0), BRANCHES, LEAF, seed)
    most = calibrated(tree, points, k, recall, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, at = _vectors(b.column(1), width)
            kept = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(tree.assign(unit(found)), pa.int64())], ["vec_id", "v", "leaf"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, at = _vectors(b.column(1), width)
            walks = [tree.visits(q, most, sizes, k + 1) for q in unit(found)]
            kept = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(walks, pa.list_(pa.int64()))], ["vec_id", "v", "leaves"])

    placed = settled(rows.mapInArrow(place, "vec_id long, v array<double>, leaf long"), "ann-rows")
    # one count per leaf of the tree: fewer than the sample; ids count once, as a query is not its own answer
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count_distinct("vec_id").alias("n")).collect()}
    walked = settled(
        rows.where(is_query).mapInArrow(walk, "vec_id long, v array<double>, leaves array<long>")
        .select("vec_id", "v", F.explode("leaves").alias("leaf")), "ann-queries")

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("leaf").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    counts = settled(blocks(placed, ROW_BLOCK, "row_blocks").join(blocks(walked, QUERY_BLOCK, "query_blocks"), "leaf"), "ann-blocks")
    counts = F.broadcast(counts)  # one row per leaf of the tree: fewer than the sample

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.col(own).cast("long")).cast("int").alias(own + "_at")
        return df.join(counts, "leaf").select(
            "vec_id", "v", "leaf", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other + "_at"))

    def best(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if not len(queries) or not len(found):
            return empty
        found = found.sort_values("vec_id")
        ids, rows_at = found["vec_id"].to_numpy(), np.stack(found["v"].to_numpy())
        out = []
        for at in range(0, len(queries), 64):
            part = queries.iloc[at : at + 64]
            scores = _cosines(np.stack(part["v"].to_numpy()), rows_at)
            for q, own in zip(part["vec_id"].to_numpy(), scores):
                own = np.where(ids == q, -np.inf, own)
                top = np.argsort(-own, kind="stable")[:k]
                top = top[np.isfinite(own[top])]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[top], "score": own[top]}))
        return pd.concat(out)

    key = ["leaf", "row_blocks_at", "query_blocks_at"]
    near = dealt(walked, "query_blocks", "row_blocks").groupBy(*key).cogroup(
        dealt(placed, "row_blocks", "query_blocks").groupBy(*key)).applyInPandas(
        best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
