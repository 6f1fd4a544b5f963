"""Remove long byte strings that occur more than once in the corpus, by suffix arrays of shards.

Only text that can repeat reaches a suffix array. Every window of ``length`` bytes is assigned to its
smallest 32-byte gram (the anchor); neighbouring windows with one anchor form a segment. Equal
windows have equal anchors at equal offsets, so only segments that share an anchor are compared. A
segment that occurs twice is repeated as a whole. Where an anchor has several segments, one copy of
each goes to the anchor's shard; there a suffix array of the segments is built by induced sorting,
and a window is repeated if its permuted common prefix with a neighbour covers it.

An anchor with more than ``BLOCK`` segments is dealt over several shards. Each finds what repeats
within it; of every group of equal windows one is then counted over the shards, by anchor and 64-bit
hash, and the windows that were alone in their shard get the answer. Shards tell of up to ``STEP`` neighbouring
windows in one row, by the hash of the bytes these have in common: equal windows lie at equal places from
their anchor, so only rows whose common bytes occur in another shard are opened. Counts are combined before each
shuffle; no group is gathered, except the findings of one text for that text.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; equal rows repeat each
other; an empty table gives an empty result; other columns are ignored. Segments that occur as a
whole are compared by the anchor and a 64-bit hash of their content, others byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from profila.llm.common import settled
from profila.llm.shingles import PLACE, mixed
from profila.llm.suffixes import common_prefixes, joined, suffix_array

LENGTH = 200
GRAM = 32
PIECE = 1 << 22
# Most segments of one anchor in one shard, and the bytes of segments per shard (on average).
BLOCK = 1024
SHARD = 1 << 19
# Neighbouring windows that a shard tells of in one row.
STEP = 16

_LOW = np.uint64((1 << 24) - 1)
_BYTES = np.random.default_rng(77).integers(0, 1 << 64, 256, np.uint64)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the place multiplier and of its inverse."""
    if len(_tables.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", int(PLACE)), ("down", pow(int(PLACE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"][:n], _tables["down"][:n]


class Hashes:
    """Hashes of any byte range of one piece of text."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.down[start])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.uint64((1 << 64) - 1))
    padded[: len(x)] = x
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def pieces(text: str | None, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping pieces: every window lies in exactly one."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(raw) - length + 1, PIECE):
        yield at, raw[at : at + PIECE + length - 1]


def segments(raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Per segment of a piece: anchor hash, offset of the anchor, content hash, first window, windows."""
    hashes = Hashes(raw)
    grams = hashes.of(np.arange(len(raw) - GRAM + 1), GRAM)
    placed = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_least(placed, length - GRAM + 1) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.append(first, len(anchor)))
    anchor = anchor[first]
    content = mixed(hashes.of(first, count + length - 1) + count.astype(np.uint64) * PLACE)
    return grams[anchor].view(np.int64), anchor - first, content.view(np.int64), first, count


def _sketch(docs: DataFrame, length: int) -> DataFrame:
    names = ["anchor", "offset", "content", "start", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for text in b.column(2).to_pylist():
                found = [(at, segments(raw, length)) for at, raw in pieces(text, length)]
                for i, row in enumerate(rows):
                    row.append(np.concatenate([f[i] + at * (i == 3) for at, f in found]).tolist() if found else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(r, pa.list_(pa.int64())) for r in rows]], ["doc_id", "mark", *names])

    schema = docs.select("doc_id", "mark").schema
    for name in names:
        schema = schema.add(name, ArrayType(LongType()))
    return docs.mapInArrow(run, schema)


def _opened(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the segments listed beside a text."""
    names = ["anchor", "offset", "content", "copies", "block", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = b.column(1).flatten()
            start, windows = (listed.field(c).to_pylist() for c in ("start", "windows"))
            cut, at = [], 0
            for text, n in zip(b.column(0), pa.compute.list_value_length(b.column(1)).to_pylist()):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                cut += [raw[i : i + w + length - 1] for i, w in zip(start[at : at + n], windows[at : at + n])]
                at += n
            yield pa.RecordBatch.from_arrays([*(listed.field(c) for c in names), pa.array(cut, pa.binary())], [*names, "raw"])

    return texts.mapInArrow(run, "anchor long, offset long, content long, copies long, block long, blocks long, raw binary")


def repeated_in_shard(shard: pd.DataFrame, length: int) -> pd.DataFrame:
    """Runs of repeated windows per segment, and what other shards of its anchor must hear of.

    ``core`` is null for runs. Else the row lists windows of one segment, one of each group of equal ones,
    with their hashes and whether they are alone here, and ``core`` is the hash of their common bytes.
    """
    shard = shard.sort_values(["anchor", "content"], ignore_index=True)
    text, begin = joined(shard["raw"].tolist())
    sizes = shard["raw"].map(len).to_numpy()
    order = suffix_array(text)
    segment = np.repeat(np.arange(len(shard)), sizes + 1)
    within = np.arange(len(segment)) - begin[segment]
    is_window = np.append(within <= (sizes - length)[segment], False)
    follows = np.concatenate(([False], common_prefixes(text, order) >= length, [False]))
    several = np.zeros(len(text), bool)
    several[order] = follows[:-1] | follows[1:]
    several[:-1] |= (shard["copies"].to_numpy() > 1)[segment]
    several &= is_window
    first = np.flatnonzero(several & ~np.concatenate(([False], several[:-1])))
    last = np.flatnonzero(several & ~np.append(several[1:], False))
    # One of each group of equal windows, where the anchor has other shards.
    heads = order[~follows[:-1]]
    heads = np.sort(heads[is_window[heads]])
    heads = heads[(shard["blocks"].to_numpy() > 1)[segment[heads]]]
    hashes = Hashes(np.frombuffer(b"\0".join(shard["raw"].tolist()), np.uint8))
    offset = shard["offset"].to_numpy()[segment[heads]]
    step = min(STEP, length - GRAM)
    nth = (offset - within[heads]) // step
    begins = np.flatnonzero(np.diff(segment[heads], prepend=-1) | np.diff(nth, prepend=-1))
    lead, nth, offset = heads[begins], nth[begins], offset[begins]
    # Windows begin up to step - 1 bytes before the last place they may begin at.
    core = hashes.of(lead - within[lead] + offset - nth * step, length - step + 1)
    core = mixed(core + nth.astype(np.uint64) * PLACE).view(np.int64)

    def listed(values: np.ndarray) -> list[np.ndarray]:
        return np.split(values, begins[1:]) if len(begins) else []

    at = np.concatenate([first, lead])
    own, none = segment[at], [None] * len(first)
    return pd.DataFrame({
        "anchor": shard["anchor"].to_numpy()[own], "content": shard["content"].to_numpy()[own],
        "block": shard["block"].to_numpy()[own], "within": within[at],
        "windows": np.concatenate([last - first + 1, np.ones(len(lead), np.int64)]),
        "core": pd.array(none + core.tolist(), "Int64"), "places": none + listed(within[heads]),
        "hashes": none + listed(hashes.of(heads, length).view(np.int64)), "alone": none + listed(~several[heads])})


def without_repeats(
    docs: DataFrame, length: int = LENGTH, block: int = BLOCK, shard_bytes: int = SHARD,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept (binary: the remaining bytes)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    docs = docs.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "mark"))
    drawn = settled(_sketch(docs.select("doc_id", "mark", "text"), length), "repeats-sketch")
    drawn = drawn.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "mark"))
    every = drawn.select("key", F.explode(F.arrays_zip("anchor", "offset", "content", "start", "windows")).alias("s")).select(
        "key", "s.*")
    shared = settled(
        every.groupBy("anchor").agg(F.count("*").alias("c"), (F.min("content") != F.max("content")).alias("several"))
        .where("c > 1").select("anchor", "several"), "repeats-anchors")
    rows = settled(every.join(shared, "anchor"), "repeats-segments")
    whole = rows.where("not several").select("key", "start", "windows")
    kinds = settled(
        rows.where("several").groupBy("anchor", "content").agg(
            F.count("*").alias("copies"), F.min(F.struct("key", "offset", "start", "windows")).alias("r"))
        .select("anchor", "content", "copies", "r.*"), "repeats-kinds")
    blocks = kinds.groupBy("anchor").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    kinds = kinds.join(blocks, "anchor").withColumn("block", F.pmod("content", "blocks"))
    opened = kinds.groupBy("key").agg(
        F.collect_list(F.struct("anchor", "offset", "content", "copies", "block", "blocks", "start", "windows")).alias("listed"))
    texts = docs.select("key", "text").join(opened.select("key"), "key", "left_semi").dropDuplicates(["key"])
    held = settled(_opened(texts.join(opened, "key").select("text", "listed"), length), "repeats-opened")
    size = held.agg(F.sum(F.length("raw"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("anchor", "block"), F.lit(size // shard_bytes + 1))
    heard = settled(
        held.groupBy(shard.alias("shard")).applyInPandas(
            lambda part: repeated_in_shard(part, length),
            "anchor long, content long, block long, within long, windows long, core long, places array<long>, "
            "hashes array<long>, alone array<boolean>"), "repeats-heard")
    listed = heard.where("core is not null")
    far = listed.groupBy("anchor", "core").agg((F.min("block") < F.max("block")).alias("far")).where("far").drop("far")
    told = listed.join(far, ["anchor", "core"], "left_semi").select(
        "anchor", "content", "block", "windows", F.explode(F.arrays_zip("places", "hashes", "alone")).alias("s")).select(
        "anchor", "content", "block", "windows", F.col("s.places").alias("within"), F.col("s.hashes").alias("hash"), "s.alone")
    met = told.groupBy("anchor", "hash").agg((F.min("block") < F.max("block")).alias("met")).where("met").drop("met")
    columns = ["anchor", "content", "within", "windows"]
    again = settled(
        heard.where("core is null").select(columns)
        .unionByName(told.where("alone").join(met, ["anchor", "hash"], "left_semi").select(columns)), "repeats-again")
    parts = rows.where("several").drop("windows").join(again, ["anchor", "content"]).select(
        "key", (F.col("start") + F.col("within")).alias("start"), "windows")
    found = (
        whole.unionByName(parts).groupBy("key").agg(F.collect_set(F.struct("start", "windows")).alias("found")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, gone, spans, kept = [], [], [], []
            for text, listed in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                change = np.zeros(len(raw) + 1, np.int32)
                for s in listed or ():
                    change[s["start"]] += 1
                    change[s["start"] + s["windows"] + length - 1] -= 1
                out = np.cumsum(change[:-1]) > 0
                sizes.append(len(raw))
                gone.append(int(out.sum()))
                spans.append(int((np.diff(out.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(raw[~out].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return docs.join(found, "key", "left").select("doc_id", "text", "found").mapInArrow(cut, schema)
