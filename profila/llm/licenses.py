"""Licence scan: every five-word shingle of the texts is looked up in the licence templates; a whole template verifies.

Words are runs of a-z and 0-9 in the lower-cased text. Templates are notices of one sentence and whole
licence texts, of any length; the list is a parameter. A template is found if some stretch as long as
it holds at least ``containment`` of its distinct shingles. The share is taken over the whole template,
never over a part of it. A stretch slides over all positions: a shingle at q whose copy before was at p
counts for starts from max(p + 1, q - span + 1) to q, so a running sum gives the share at each start.

Templates that differ little: if another licence's template holds so many of a template's shingles that
it would pass for it, one shingle that it lacks must be in the stretch; and in a notice one shingle with
all its numbers (the version) must be, so version 2 is not taken for version 3.

Only texts with a signal word are cut. Signal words are chosen so that a text without any of them lacks
more of every template's shingles than may be missing; that loses no find.

Defined cases: null and empty text have no find; fewer than five words never match; repeated rows
and rows with one id give one row per licence, but rows are judged one by one; an empty table gives an
empty result; other columns are ignored. Everything is a column function; nothing of the rows reaches
the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profila.llm.common import let

SHINGLE = 5
CONTAINMENT = 0.8
NOTICE = 64  # templates of up to so many words are notices: their numbers are versions
WORD = "[a-z0-9]+"

# Notices by which licences are stated.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as "
        "published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
NOTICES = [
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0", _GNU.format("Affero General Public License", 3)),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", _GNU.format("General Public License", 2)),
    ("gpl-3.0", _GNU.format("General Public License", 3)),
    ("isc", "Released under the ISC License."),
    ("lgpl-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl-2.1", _GNU.format("Lesser General Public License", 2.1)),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl-3.0", _GNU.format("Lesser General Public License", 3)),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

Templates = dict[str, str] | Sequence[tuple[str, str]]


def every_template() -> list[tuple[str, str]]:
    """(licence, text): the notices and the whole texts kept beside this file, named by licence."""
    texts = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    return [*TEMPLATES.items(), *NOTICES,
            *((p.name.removesuffix(".txt").removesuffix(".3-clause"), p.read_text("utf-8")) for p in texts)]


def passages(templates: Templates) -> list[tuple[str, int, list[str]]]:
    """(licence, number, words) of each template, whole."""
    out = []
    for i, (name, text) in enumerate(sorted(templates.items() if isinstance(templates, dict) else templates)):
        words = re.findall(WORD, text.lower())
        if len(words) < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        out.append((name, i, words))
    return out


def _distinct(words: list[str]) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))


def signal_words(found: list[tuple[str, int, list[str]]], containment: float) -> list[str]:
    """Words of which every template's match must hold one: chosen words first, then the most telling."""
    chosen: set[str] = set()
    for _, _, words in found:
        free = _distinct(words)
        most = containment * len(free)
        while (free := [s for s in free if not chosen & set(s)]) and len(free) >= most:
            held = Counter(w for s in free for w in set(s))
            chosen.add(max(held, key=lambda w: (w.startswith("licens"), len(w) >= 8, held[w], w)))
    return sorted(chosen)


def telling(found: list[tuple[str, int, list[str]]], containment: float) -> list[list[set[tuple[str, ...]]]]:
    """Per template the sets of shingles of each of which a find must hold one."""
    sets, out = [set(_distinct(words)) for _, _, words in found], []
    for (name, _, words), own in zip(found, sets):
        groups = [own - other for (sibling, _, _), other in zip(found, sets)
                  if sibling != name and len(own & other) >= containment * len(own) and own - other]
        numbers = {w for w in words if w.isdigit()} if len(words) <= NOTICE else set()
        versioned = {s for s in own if numbers <= set(s)} if numbers else set()
        out.append([g for i, g in enumerate([*groups, versioned]) if g and g not in groups[:i]])
    return out


def _hashes(words: Column) -> Column:
    """Per position the hash of the shingle that begins there; null below five words."""
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))))


def scan(
    docs: DataFrame, templates: Templates | None = None, containment: float = CONTAINMENT,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document and licence found: doc_id, license, first_word (of the first best stretch), contained."""
    known = passages(every_template() if templates is None else templates)
    groups = telling(known, containment)
    most = max(map(len, groups))
    rows = []
    for (name, unit, words), wanted in zip(known, groups):
        shingles = _distinct(words)
        rows.append((unit, name, len(words) - SHINGLE + 1, len(shingles), len(wanted), [
            (" ".join(s), [int(g < len(wanted) and s in wanted[g]) for g in range(most)]) for s in shingles]))
    units = docs.sparkSession.createDataFrame(
        rows, "unit int, license string, span int, total int, groups int, shingles array<struct<words:string,tells:array<int>>>")
    units = units.select("unit", "license", "span", "total", "groups", F.explode("shingles").alias("s")).select(
        "unit", "license", "span", "total", "groups", "s.tells", F.get(_hashes(F.split("s.words", " ")), F.lit(0)).alias("hash"))

    likely = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("text")).where(
        F.col("text").rlike("|".join(signal_words(known, containment))))
    cut = likely.select(
        "doc_id", F.xxhash64("text").alias("copy"),
        F.posexplode(_hashes(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("at", "hash"))
    own = ["doc_id", "copy", "unit"]
    same = W.partitionBy(*own, "hash").orderBy("at")
    at, none = F.col("at"), F.array(*[F.lit(0)] * most)
    met = cut.join(F.broadcast(units), "hash").withColumn("before", F.lag("at").over(same))
    first = F.greatest(at - F.col("span") + 1, F.coalesce(F.col("before") + 1, F.lit(0)))
    steps = F.array(
        F.struct(first.alias("start"), F.lit(1).alias("step"), F.col("tells"), F.lit(False).alias("begins")),
        F.struct((at + 1).alias("start"), F.lit(-1).alias("step"), F.transform("tells", lambda t: -t).alias("tells"),
                 F.lit(False).alias("begins")),
        F.struct(at.alias("start"), F.lit(0).alias("step"), none.alias("tells"), F.lit(True).alias("begins")))
    # Rows with equal starts are summed together: the frame is a range.
    sliding = W.partitionBy(*own).orderBy("start").rangeBetween(W.unboundedPreceding, 0)
    held = met.select(*own, "license", "total", "groups", F.inline(steps)).select(
        *own, "license", "total", "groups", "start", "begins", F.sum("step").over(sliding).alias("found"),
        *[F.sum(F.get("tells", F.lit(g))).over(sliding).alias(f"told{g}") for g in range(most)])
    told = [(F.col("groups") <= g) | (F.col(f"told{g}") > 0) for g in range(most)]
    best = F.struct(F.col("contained"), (-F.col("start")).alias("later"))
    for rule in told:
        held = held.where(rule)
    return (
        held.where("begins").withColumn("contained", F.col("found") / F.col("total")).where(F.col("contained") >= containment)
        .groupBy("doc_id", "license").agg(F.max(best).alias("best"))
        .select("doc_id", "license", (-F.col("best.later")).cast("long").alias("first_word"), "best.contained"))
