"""Ranked lexical search: items ranked against documents by one scan of the text, without an index.

Terms are the runs of letters and digits of ASCII and of all characters beyond it; A-Z count as a-z. The
terms of all items go into one Aho-Corasick automaton, each guarded by a blank on both sides. A document is
mapped byte by byte to its terms with single separators turned into blanks, so the automaton matches
whole terms only and counts their occurrences straight from the text; its outputs are term numbers,
which lead to the items that hold them.

The scan leaves (term, occurrences) per document in a written table. Counts over all documents come from
there, then every task scores its documents for all items by one matrix product per batch and keeps its
best ``k`` per item; those few meet in one window. Products and sums are whole numbers and exact.

The automaton is broadcast. Items are cut by a hash of their id into as many blocks as keep the terms of a
block below ``BLOCK_BYTES`` (a single larger item is a block of its own); each block is one scan.

Defined cases: null texts and texts without a term have none and are not counted; null ids rank after
others; each row of documents is a document, also if it repeats an id; rows of ``items`` with one id are
one item with the terms of all; an item without terms has no rows; an empty table gives an empty result;
other columns are ignored. Document ids are read as long.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from profila.llm.common import settled

# What is no term, and the figures of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOP = 10
BLOCK_BYTES = 4 << 20
ITEM_GROUP = 256  # items that are scored by one product
ROW_GROUP = 256
EXACT_TERMS = 150_000  # terms of an item up to which sums stay below 2 ** 53

_PLAIN = bytes(
    32 if b < 128 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 128 else b for b in range(256))


def plain(text: str | None) -> str:
    """Blank-separated terms, one character per UTF-8 byte, a blank at both ends."""
    return (b" " + (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN) + b" ").decode("latin-1")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def automaton(words: list[str]):
    """Matches `` word `` in plain texts; its outputs are the places in ``words``."""
    found = ahocorasick.Automaton()
    for i, word in enumerate(words):
        found.add_word(plain(word), i)
    found.make_automaton()
    return found


def _scanned(docs: DataFrame, words: list[str]) -> DataFrame:
    """Per document with a term: doc_id, n, terms (places in ``words``) and their occurrences."""
    held = docs.sparkSession.sparkContext.broadcast(automaton(words))
    output = itemgetter(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held.value
        for b in batches:
            at, sizes, found, tf = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                text = plain(text)
                if n := len(text.split()):
                    counts = Counter(map(output, machine.iter(text)))
                    at.append(i)
                    sizes.append(n)
                    found.append(list(counts))
                    tf.append(list(counts.values()))
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


class Best:
    """The ``k`` best (score, smaller id first, null last) of each of ``items`` items."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64)] * 4  # item, -score, id is null, id

    def add(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray, first: int) -> None:
        """Scores of documents (rows) for the items from ``first`` on."""
        row, item = np.nonzero(scores >= self.least[first : first + scores.shape[1]])
        if not len(row):
            return
        more = item + first, -scores[row, item].astype(np.int64), null[row], ids[row]
        rows = [np.concatenate(x) for x in zip(self.rows, more)]
        order = np.lexsort(rows[::-1])
        rows = [x[order] for x in rows]
        starts = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))
        place = np.arange(len(rows[0])) - np.repeat(starts, np.diff(np.append(starts, len(rows[0]))))
        last = place == self.k - 1
        self.least[rows[0][last]] = -rows[1][last]
        self.rows = [x[place < self.k] for x in rows]


def _ranked(scanned: DataFrame, items: list, words: list[str], weights: np.ndarray, documents: int, length: int, k: int, id_type) -> DataFrame:
    """Each task's best ``k`` documents per item: item_id, doc_id, score."""
    place = {word: i for i, word in enumerate(words)}
    ids = pa.array([r["item_id"] for r in items], to_arrow_type(id_type))
    groups = []
    for first in range(0, len(items), ITEM_GROUP):
        part = items[first : first + ITEM_GROUP]
        used = sorted({place[w] for r in part for w in r["terms"]})
        column = {t: i for i, t in enumerate(used)}
        kind = np.float64 if max(len(r["terms"]) for r in part) <= EXACT_TERMS else np.int64
        cells = [(column[place[w]], i) for i, r in enumerate(part) for w in r["terms"]]
        groups.append((first, len(part), np.array(used), np.array(cells).T, kind))
    held = scanned.sparkSession.sparkContext.broadcast((groups, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, weights = held.value
        best = Best(len(ids), k)
        incidences = []
        for first, count, used, cells, kind in groups:
            matrix = np.zeros((len(used), count), kind)
            matrix[cells[0], cells[1]] = 1
            column = np.full(len(weights), -1, np.int64)
            column[used] = np.arange(len(used))
            incidences.append((first, column, matrix))
        for b in batches:
            null = b.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            doc_ids = b.column(0).fill_null(0).to_numpy()
            m = np.array([10 + 90 * n * documents // length for n in b.column(1).to_pylist()], np.int64)
            found, tf = b.column(2), b.column(3).flatten().to_numpy()
            ends = found.offsets.to_numpy() - found.offsets[0].as_py()
            term = found.flatten().to_numpy()
            row = np.repeat(np.arange(len(b)), np.diff(ends))
            part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
            for at in range(0, len(b), ROW_GROUP):
                end = min(at + ROW_GROUP, len(b))
                own = slice(ends[at], ends[end])
                for first, column, matrix in incidences:
                    place = column[term[own]]
                    mine = place >= 0
                    dense = np.zeros((end - at, len(matrix)), matrix.dtype)
                    dense[row[own][mine] - at, place[mine]] = part[own][mine]
                    best.add(dense @ matrix, null[at:end], doc_ids[at:end], first)
        item, score, null, doc = best.rows
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(item)), pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(-score)],
            ["item_id", "doc_id", "score"])

    return scanned.mapInArrow(run, f"item_id {id_type.simpleString()}, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Per item and rank: item_id, rank, doc_id, score (long, above 0)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    id_type = items.schema[item_col].dataType
    asked = settled(
        items.select(F.col(item_col).alias("item_id"), F.explode(terms(F.col(item_text_col))).alias("term")).distinct()
        .groupBy("item_id").agg(F.collect_list("term").alias("terms"))
        .withColumn("bytes", F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t) + 2)), "lexical-items")
    total = asked.agg(F.sum("bytes")).first()[0] or 0
    # Blocks are doubled until the largest is within the bound, or no larger than one item.
    blocks, hashed = 1, F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    while total:
        key = F.pmod(hashed, F.lit(blocks))
        fit = asked.groupBy(key).agg(F.sum("bytes").alias("s"), F.count("*").alias("c")).where(
            (F.col("s") > block_bytes) & (F.col("c") > 1)).isEmpty()
        if fit:
            break
        blocks *= 2
    parts, sums = [], None
    for block in range(blocks if total else 0):
        own = sorted(asked.where(key == block).select("item_id", "terms").collect(), key=lambda r: str(r["item_id"]))
        if not own:
            continue
        words = sorted({w for r in own for w in r["terms"]})
        scanned = settled(_scanned(docs, words), "lexical-terms")
        if sums is None:
            sums = scanned.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        if not sums["n"]:
            break
        df = {r["term"]: r["count"] for r in scanned.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
        weights = np.array(
            [floor(1000 * log((2 * sums["n"] + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(words))], np.int64)
        parts.append(_ranked(scanned, own, words, weights, sums["n"], sums["l"], k, id_type))
    if not parts:
        return spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
