"""Near-duplicate documents: one-permutation MinHash, densified, in banded buckets.

A document is its set of distinct word shingles. Documents with equal sets form a class and are
represented by the smallest id. One hash per shingle serves all ``bins`` bins; an empty bin borrows
from the first filled one of its own random order (optimal densification). ``rows`` bins make a
band; classes that agree in a band share a bucket. With 113 bands of 8 a pair of similarity 0.8 shares no
bucket once in 10^9, one of 0.3 shares one with 0.7 %.

Candidates are stars: every member of a bucket is compared with the bucket's centre, the member that meets
most others over all its buckets, since that is the one others were copied from. The centre then leaves the
bucket. Found components are contracted: links between components, so nothing grows with the pairs of a group.

Buckets whose members still fall into several components get an exact prefix filter. Buckets that share members are
one cluster. Within it the shingles of a document are put in an order common to all: those that no other component
has, then the others, rarest first. Two similar documents have their first common shingle early in both orders: the
shingles from there on must suffice for the similarity. So only documents of different components are compared that
share a shingle, and both soon enough for both sizes; no pair that shares a bucket is lost, and outsiders of a large
group, whose early shingles are their own, meet none of it. Inside, a document is the number of its row in the
written sketches, whatever the type of its id.

A pair is first compared by ``SKETCH`` bytes of both signatures; below half agreement its similarity is under 0.8
but for less than one pair in 10^9. The rest is compared on full sets, which are written once.

Defined cases: null text and text without words have an empty set and no link; fewer words than a
shingle form one; rows that repeat an id are one document; a row without id has no link,
``component_id`` null, and is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profila.llm.common import dropped, settled
from profila.llm.links import components
from profila.llm.shingles import PLACE, mixed, shingle_set

WORDS = 5
SIMILARITY = 80  # per cent
BANDS, ROWS = 113, 8
CENTRES = 1  # per bucket
STEPS = 8
SKETCH = 128  # bytes, one per bin, spread over all bins
SIEVE, SIEVE_MOST = 16, 1 << 27  # bits per id asked for, and at most: 16 MB


@lru_cache(maxsize=4)
def _orders(bins: int) -> np.ndarray:
    """Row i: the order in which bin i looks for a filled bin, itself first."""
    random = np.random.default_rng(bins)
    out = np.argsort(random.random((bins, bins)), axis=1)
    at = np.argmax(out == np.arange(bins)[:, None], axis=1)
    out[np.arange(bins), at], out[:, 0] = out[:, 0], np.arange(bins)
    return out


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The smallest hash of each bin of a sorted, non-empty set; empty bins borrow."""
    width = (1 << 64) // bins
    edges = np.arange(bins, dtype=np.uint64) * np.uint64(width)
    first = np.searchsorted(shingles, edges)
    filled = first < np.append(first[1:], len(shingles))
    out = shingles[np.minimum(first, len(shingles) - 1)]
    orders, empty, step = _orders(bins), np.flatnonzero(~filled), 1
    while len(empty):
        # All bins still empty look at the next STEPS places of their orders.
        seen = orders[empty, step : step + STEPS]
        hit = filled[seen]
        at = np.argmax(hit, axis=1)
        rows = np.arange(len(empty))
        met = hit[rows, at]
        out[empty[met]] = out[seen[rows, at][met]]
        empty, step = empty[~met], step + STEPS
    return out


def buckets(held: np.ndarray, bands: int, rows: int) -> np.ndarray:
    held = held.reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        out = mixed(out * PLACE + held[:, i])
    return out.view(np.int64)


def sketch(held: np.ndarray) -> bytes:
    """A byte each of bins spread over the whole signature."""
    at = np.linspace(0, len(held) - 1, min(SKETCH, len(held))).astype(np.int64)
    return (held[at] >> np.uint64(17)).astype(np.uint8).tobytes()


def _sketch(docs: DataFrame, size: int, bands: int, rows: int, id_type) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, keys, found, short = [], [], [], []
            for text in b.column(1).to_pylist():
                held = shingle_set(text, size)
                counts.append(len(held))
                keys.append(hashlib.md5(held.tobytes()).digest())
                drawn = signature(held, bands * rows) if len(held) else held
                found.append(buckets(drawn, bands, rows) if len(held) else drawn.view(np.int64))
                short.append(sketch(drawn) if len(held) else b"")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(short, pa.binary()),
                 pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "key", "sketch", "buckets"])

    return docs.mapInArrow(run, f"doc_id {id_type}, n_shingles long, key binary, sketch binary, buckets array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """The full set of every row of (id, key, text) whose set has that key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sets = [], []
            for id_, key, text in zip(*(column.to_pylist() for column in b.columns)):
                held = shingle_set(text, size).tobytes()
                if hashlib.md5(held).digest() == key:
                    ids.append(id_)
                    sets.append(held)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "held"])

    return docs.select("id", "key", "text").mapInArrow(run, "id long, held binary")


def _sieved(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` may be in ``asked``: all that are, and few others.

    A bit is set for the hash of each id asked for, ``SIEVE`` bits an id. That is broadcast, so that the texts of the
    others are not shuffled to a join; beyond ``SIEVE_MOST`` bits more of them pass.
    """
    bits = min(SIEVE * max(1, asked.count()), SIEVE_MOST)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    part, at = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    sieve = asked.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(at).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return docs.withColumn("part", part).join(F.broadcast(sieve), "part").where(
        F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).drop("part", "bits")


def _listed(sets: DataFrame) -> DataFrame:
    """Rows of (id, cluster, component, held) with the set as an array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(3)
            ends = np.cumsum(pa.compute.binary_length(held).to_numpy(zero_copy_only=False) // 8)
            values = np.frombuffer(b"".join(held.to_pylist()), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], lists], ["id", "cluster", "component", "shingles"])

    return sets.select("id", "cluster", "component", "held").mapInArrow(
        run, "id long, cluster long, component long, shingles array<long>")


def _spots(places: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Shingles that may be the first common one of a document and a similar one of another component.

    ``places`` has id, n, cluster and component; ``at`` counts the document's shingles before that one.
    """
    shingles = _listed(sets.join(places, "id")).select("cluster", "component", "id", F.explode("shingles").alias("shingle"))
    seen = shingles.groupBy("cluster", "shingle").agg(
        F.count("*").alias("df"), (F.min("component") < F.max("component")).alias("several")).where("several").drop("several")
    mine = Window.partitionBy("id")
    ranked = shingles.drop("component").join(seen, ["cluster", "shingle"]).select(
        "id", "shingle", F.row_number().over(mine.orderBy("df", "shingle")).alias("nth"), F.count("*").over(mine).alias("several"))
    at = F.col("n") - F.col("several") + F.col("nth") - 1
    return ranked.join(places, "id").withColumn("at", at).where(f"100 * (n - at) >= {similarity} * n").select(
        "cluster", "shingle", "id", "n", "at", "component")


def _meeting(spots: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of different components whose shingles from a common one on suffice for the similarity."""
    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("cluster", "shingle", *[F.col(c).alias(f"{c}_{name}") for c in ("id", "n", "at", "component")])

    def enough(name: str) -> str:
        return f"{100 + similarity} * (n_{name} - at_{name}) >= {similarity} * (n_a + n_b)"

    # The smaller set, b, meets none smaller, so fewer of its shingles can be the first.
    smaller = side(spots.where(f"{100 + similarity} * (n - at) >= {2 * similarity} * n"), "b")
    met = side(spots, "a").join(smaller, ["cluster", "shingle"]).where(
        f"component_a <> component_b and (n_a > n_b or n_a = n_b and id_a > id_b) and {enough('a')} and {enough('b')}")
    return met.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b")).distinct()


def _alike(one: bytes, two: bytes, similarity: int) -> bool:
    one, two = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    return 100 * int((one == two).sum()) >= (similarity - 30) * len(one)


def _similar_sets(one: bytes, two: bytes, similarity: int) -> bool:
    one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    at = np.searchsorted(two, one)
    common = int((two[np.minimum(at, len(two) - 1)] == one).sum())
    return 100 * common >= similarity * (len(one) + len(two) - common)


def _passing(pairs: DataFrame, held: DataFrame, test, similarity: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose values in ``held`` (id, held) pass ``test``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [test(x.as_buffer(), y.as_buffer(), similarity) for x, y in zip(b.column("one"), b.column("two"))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = held.select(F.col("id").alias("a"), F.col("held").alias("one"))
    two = held.select(F.col("id").alias("b"), F.col("held").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def _contracted(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after more links (a, b): one row per vertex, whatever the number of links."""
    def seen(side: str) -> DataFrame:
        return found.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))

    between = links.join(seen("a"), "a", "left").join(seen("b"), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    moved = components(between).select(F.col("id").alias("component"), F.col("component").alias("onto"))
    kept = found.join(moved, "component", "left").select("id", F.coalesce("onto", "component").alias("component"))
    return settled(kept.unionByName(moved.select(F.col("component").alias("id"), F.col("onto").alias("component"))).distinct(), "near-found")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
    centres: int = CENTRES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id that links reach) and kept.

    ``similarity`` is the least Jaccard similarity of the shingle sets, in per cent. ``centres`` members of each bucket
    are compared with all its others before the exact filter.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    drawn = settled(
        _sketch(docs, words, bands, rows, id_type).withColumn("row", F.monotonically_increasing_id()), "near-sketch")
    named = drawn.where("doc_id is not null and n_shingles > 0")
    classes = settled(named.groupBy("key").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least")), "near-classes")
    own = settled(
        named.join(classes.select("key", "rep"), "key").where("row = rep")
        .select(F.col("rep").alias("id"), "doc_id", "key", F.col("n_shingles").alias("n"), "sketch", "buckets"), "near-own")
    members = own.select(F.explode("buckets").alias("bucket"), "id", "n")
    crowds = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = settled(members.join(crowds, "bucket"), "near-shared")
    weights = shared.groupBy("id").agg(F.sum("size").alias("w"))
    left = settled(shared.join(weights, "id").select("bucket", "id", "n", "w"), "near-left")
    short = settled(
        own.join(shared.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "key", F.col("sketch").alias("held")),
        "near-short")
    dropped(own, shared)

    def near(met: DataFrame) -> DataFrame:
        """The pairs (a, b) of members ``id`` and centres ``b`` whose sizes and sketches allow the similarity."""
        pairs = met.withColumnRenamed("id", "a").where(f"a <> b and 100 * least(n, m) >= {similarity} * greatest(n, m)")
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        return _passing(pairs, short, _alike, similarity)

    def sets_of(asked: DataFrame) -> DataFrame:
        # Written first: Spark then knows its size, and the texts of ids that nobody asks for are not shuffled.
        asked = settled(short.drop("held").join(asked, "id", "left_semi"), "near-asked")
        # Rows may repeat an id and its text.
        sets = settled(
            _sets(_sieved(docs, asked).join(asked, "doc_id"), words).groupBy("id").agg(F.first("held").alias("held")), "near-sets")
        dropped(asked)
        return sets

    def without(members: DataFrame, centres: DataFrame) -> DataFrame:
        gone = centres.select("bucket", F.col("b").alias("id"))
        return settled(members.select("bucket", "id", "n", "w").join(gone, ["bucket", "id"], "left_anti"), "near-left")

    def undecided(members: DataFrame) -> DataFrame:
        """The members, with their component, of buckets that hold several, and the bucket's smallest member."""
        placed = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        several = placed.groupBy("bucket").agg(
            F.min("component").alias("one"), F.max("component").alias("two"), F.min("id").alias("least"))
        return settled(placed.join(several.where("one < two").select("bucket", "least"), "bucket"), "near-placed")

    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("w"), "id"))
    chosen = settled(
        left.withColumn("at", rank).where(F.col("at") <= centres).select("bucket", F.col("id").alias("b"), F.col("n").alias("m")),
        "near-centres")
    pairs = settled(near(left.join(chosen, "bucket")), "near-alike")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    links = settled(_passing(pairs, sets, _similar_sets, similarity), "near-links")
    # Rows that repeat an id are one document, so its classes are linked.
    texts = named.select("doc_id", "key").distinct().join(classes.select("key", "rep"), "key")
    first = texts.groupBy("doc_id").agg(F.min("rep").alias("b"), F.count("*").alias("c")).where("c > 1")
    same = texts.join(first, "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b")
    found = settled(components(links.unionByName(same)), "near-found")
    rest = without(left, chosen)
    dropped(pairs, sets, links, left, chosen)
    placed = undecided(rest)
    dropped(rest)
    if not placed.isEmpty():
        clusters = components(placed.select(F.col("id").alias("a"), F.col("least").alias("b")))
        places = settled(
            placed.select("id", "n", "component").distinct().join(clusters.withColumnRenamed("component", "cluster"), "id", "left")
            .withColumn("cluster", F.coalesce("cluster", "id")), "near-places")
        sets = sets_of(places.select("id"))
        spots = settled(_spots(places, sets, similarity), "near-spots")
        pairs = settled(_passing(_meeting(spots, similarity), short, _alike, similarity), "near-alike")
        links = settled(_passing(pairs, sets, _similar_sets, similarity), "near-links")
        if not links.isEmpty():
            found = _contracted(found, links)
        dropped(places, sets, spots, pairs, links)
    dropped(placed, short)

    # A component is named by its smallest id.
    places = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", "least", F.coalesce("component", "rep").alias("component"))
    names = places.groupBy("component").agg(F.min("least").alias("name"))
    out = drawn.select("doc_id", "n_shingles", "key").join(places.join(names, "component").select("key", "name"), "key", "left")
    alone = F.col("doc_id").isNull() | F.col("name").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("name"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of every group, the one with the smallest id.

    Rows are told apart by id and hash of the text: different texts under one id are different documents,
    equal texts with or without an id are copies, and a missing id counts as the largest. Of rows equal in
    both, the first by all its columns stays.
    """
    key = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    keyed = docs.withColumn("_key", key)
    kept = settled(
        near_duplicates(keyed.select("_key", text_col), id_col="_key", text_col=text_col, **options)
        .where("kept").groupBy(F.col("doc_id").alias("_key")).agg(F.count("*").alias("n")), "near-kept")
    once = keyed.join(kept.where("n = 1"), "_key", "left_semi").select(docs.columns)
    whole = F.struct(*docs.columns)
    again = keyed.join(kept.where("n > 1"), "_key", "left_semi").groupBy("_key").agg(
        F.min_by(whole, F.to_json(whole)).alias("_row")).select("_row.*")
    return once.unionByName(again)
