"""Language identification by nearest centroid.

A text becomes a vector of its character pairs and triples (hashed to a fixed number of places),
weighted by damped frequency times inverse document frequency and scaled to length one. Each
language has a few centroids found by k-means on labelled texts; a text gets the language of the
centroid with the largest cosine. Texts much farther from it than labelled ones of like length are
rejected: cosines grow with length, so each language has a floor per power of two of the number of
grams. They are fitted on the labelled texts, beginnings of them, and several of them joined. Texts with
fewer grams than any fitted band are too short to judge and kept.

Training uses a bounded sample: about ``sample`` labelled rows, shared equally by the languages and
drawn by a hash of the id. All texts are read whole.

Defined cases: null text and text without a letter are ``und`` with score 0 and rejected; without
any labelled row every text is ``und`` with score 0, rejected only if it has no letter; equal
cosines go to the smaller language name; rows are answered one by one, so repeated rows get equal
answers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
PLACES = 4096
SAMPLE = 4000
CENTROIDS = 4
ROUNDS = 12
SEED = 7
# Rejected: a cosine below this share of the lowest ones (0.5 %) among labelled texts.
REJECT = 0.5
CUTS = (8, 16, 32, 64, 128)  # characters of the beginnings that floors are fitted on
BANDS = 48                   # powers of two of gram counts
BAND_ROWS = 8                # labelled texts that fit a floor
BLOCK = 1 << 20
ROWS = 512  # of a dense block of training rows

# Fixed: odd multipliers of the two n-gram hashes.
PAIR = (np.uint32(2654435761), np.uint32(2246822519))
TRIPLE = (np.uint32(3266489917), np.uint32(668265263), np.uint32(374761393))

_PLAIN = np.full(128, 32, np.uint32)
_PLAIN[97:123] = np.arange(97, 123)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(text: str, places: int = PLACES) -> np.ndarray:
    """Counts of hashed character pairs and triples; ASCII other than letters counts as space."""
    shift = np.uint32(32 - (places - 1).bit_length())
    out = np.zeros(places, np.int64)
    text = f" {text.lower()} "
    for at in range(0, max(len(text) - 1, 1), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < 128, _PLAIN[np.minimum(codes, 127)], codes)
        pairs = (codes[:-1] * PAIR[0] + codes[1:] * PAIR[1])[: BLOCK]
        out += np.bincount((pairs ^ pairs >> np.uint32(15)) * PAIR[0] >> shift, minlength=places)
        triples = (codes[:-2] * TRIPLE[0] + codes[1:-1] * TRIPLE[1] + codes[2:] * TRIPLE[2])[: BLOCK]
        out += np.bincount((triples ^ triples >> np.uint32(13)) * TRIPLE[2] >> shift, minlength=places)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def clusters(rows: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means on unit rows: centroids of length one."""
    k = min(k, len(rows))
    random = np.random.default_rng(seed)
    chosen = [int(random.integers(len(rows)))]
    while len(chosen) < k:  # far rows are more likely to start a cluster
        far = np.clip(1 - (rows @ rows[chosen].T).max(axis=1), 0, None)
        if not far.sum() > 1e-9:
            break
        chosen.append(int(random.choice(len(rows), p=far / far.sum())))
    centres = rows[chosen]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        centres = unit(np.stack([rows[own == i].sum(axis=0) for i in range(len(centres)) if (own == i).any()]))
    return centres


@dataclass
class Model:
    languages: list[str]  # of each centroid, in order
    centroids: np.ndarray
    weights: np.ndarray
    floors: np.ndarray  # lowest accepted cosine of each centroid's language, per band of gram counts

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit((np.log1p(counts) * self.weights).astype(np.float32))


def band(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(counts.sum(axis=1), 1)).astype(int)


def fit_floors(cosines: np.ndarray, bands: np.ndarray, reject: float) -> np.ndarray:
    """``reject`` times the low cosines of each band; bands without enough texts take the next lower fitted one."""
    out, last = np.zeros(BANDS), 0.0
    for i in range(BANDS):
        here = cosines[bands == i]
        out[i] = last = reject * float(np.quantile(here, 0.005)) if len(here) >= BAND_ROWS else last
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that are kept for measuring: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, places: int = PLACES, reject: float = REJECT,
    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Fit on about ``sample`` rows of ``docs`` with a language; their sparse counts come to the driver."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    empty = Model([], np.zeros((0, places), np.float32), np.ones(places), np.zeros((0, BANDS)))
    if not sizes:
        return empty
    share = max(8, sample // len(sizes))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string")), F.lit(1 << 30))
    bounds = docs.sparkSession.createDataFrame(
        [(lang, min(1 << 30, (share << 30) // n)) for lang, n in sizes.items()], "lang string, bound long")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, where, counts, cut = [], [], [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for part in [text, *(text[:n] for n in CUTS if n < len(text))] if has_letter(text) else []:
                    if not has_letter(part):
                        continue
                    found = gram_counts(part, places)
                    at = np.flatnonzero(found)
                    cut.append(part is not text)
                    langs.append(lang)
                    where.append(at.astype("<u4").tobytes())
                    counts.append(found[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array(langs, pa.string()), "at": pa.array(where, pa.binary()), "n": pa.array(counts, pa.binary()),
                "cut": pa.array(cut, pa.bool_())})

    # One row per language, counted above; without the broadcast every text would be shuffled by language.
    drawn = labelled.join(F.broadcast(bounds), "lang").where(place < F.col("bound")).select("lang", "text")
    found = sorted((r["lang"], bytes(r["at"]), bytes(r["n"]), r["cut"]) for r in drawn.mapInArrow(
        sparse, "lang string, at binary, n binary, cut boolean").collect())
    rows, cuts = [r[:3] for r in found if not r[3]], [r[:3] for r in found if r[3]]
    if not rows:
        return empty
    holding = sum(np.bincount(np.frombuffer(at, "<u4"), minlength=places) for _, at, _ in rows)
    model = Model([], np.zeros((0, places), np.float32), np.log((1 + len(rows)) / (1 + holding)) + 1, np.zeros(0))

    # Dense rows take many times the memory of sparse ones: only vectors of one language, else blocks of them, are made.
    def dense(rows: list[tuple], first: int, last: int, steps: list[int]) -> np.ndarray:
        """Counts of rows ``first`` to ``last``, each joined with those ``steps`` further on."""
        out = np.zeros((last - first, places), np.float32)
        for i in range(first, last):
            for step in steps:
                _, at, n = rows[i + step]
                out[i - first, np.frombuffer(at, "<u4")] += np.frombuffer(n, "<f4")
        return out

    def blocks(rows: list[tuple], n: int, steps: list[int]) -> Iterator[np.ndarray]:
        return (dense(rows, at, min(at + ROWS, n), steps) for at in range(0, n, ROWS))

    centres, floors = [], []
    for lang in sorted({r[0] for r in rows}):
        own, short = [r for r in rows if r[0] == lang], [r for r in cuts if r[0] == lang]
        vectors, bands = np.empty((len(own), places), np.float32), []
        for i, counts in enumerate(blocks(own, len(own), [0])):
            vectors[i * ROWS : i * ROWS + len(counts)] = model.vectors(counts)
            bands.append(band(counts))
        centres.append(clusters(vectors, centroids, ROUNDS, seed))
        seen = [((vectors @ centres[-1].T).max(axis=1), np.concatenate(bands))]
        del vectors

        def look(part: np.ndarray) -> None:
            seen.append(((model.vectors(part) @ centres[-1].T).max(axis=1), band(part)))

        for counts in blocks(short, len(short), [0]):
            look(counts)
        half, steps = len(own) // 2, [0]
        while half >= BAND_ROWS:  # pairs of texts, fours, eights...
            steps = steps + [step + half for step in steps]
            for counts in blocks(own, half, steps):
                look(counts)
            half //= 2
        model.languages += [lang] * len(centres[-1])
        floors += [fit_floors(*map(np.concatenate, zip(*seen)), reject)] * len(centres[-1])
    model.centroids, model.floors = np.concatenate(centres), np.array(floors)
    return model


def judge(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and rejection of each text."""
    letters = np.array([has_letter(t) for t in texts], bool)
    langs, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), ~letters
    if model.languages:
        for at in range(0, len(texts), 256):
            asked = at + np.flatnonzero(letters[at : at + 256])
            if len(asked):
                counts = np.stack([gram_counts(texts[i], model.centroids.shape[1]) for i in asked])
                cosines = model.vectors(counts) @ model.centroids.T
                best = cosines.argmax(axis=1)
                scores[asked] = np.clip(cosines[np.arange(len(asked)), best], 0, 1)
                rejected[asked] = scores[asked] < model.floors[best, band(counts)]
                for i, c in zip(asked, best):
                    langs[i] = model.languages[c]
    return langs, scores, rejected


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score and rejected."""
    schema = docs.select(F.col(id_col).alias("doc_id")).schema
    schema = schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, rejected = judge(b.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], schema.names)

    return docs.select(id_col, text_col).mapInArrow(predict, schema)


def keep_identified(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that a model trained on their own labels doesn't reject."""
    model, at = train(docs), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~judge(b.column(at).to_pylist(), model)[2]))

    return docs.mapInArrow(keep, docs.schema)
