"""Whole templates, against a brute force over all their shingles."""

import re

from profila.llm import licenses

SCHEMA = "doc_id long, text string"
PARTS = [
    ("half a notice", "governed by a MIT-style license that can be found in the LICENSE file", set()),
    ("other licence", "This Source Code Form is subject to the terms of the X License", set()),
    ("other version", "This work is licensed under the GNU General Public License, version 7.", set()),
    ("version 2", "This work is licensed under the GNU General Public License, version 2.", {"gpl-2.0"}),
    ("isc", "Released under the ISC License.", {"isc"}),
    ("lgpl", licenses._GNU.format("Lesser General Public License", 3), {"lgpl-3.0"}),
    ("agpl", licenses._GNU.format("Affero General Public License", 3), {"agpl-3.0"}),
    ("gpl", licenses._GNU.format("General Public License", 3), {"gpl-3.0"}),
    ("halves far apart", "Use of this source code is governed by a " + "word " * 40
     + "BSD-style license that can be found in the LICENSE file.", set()),
]


def brute(text, templates, containment=licenses.CONTAINMENT):
    """{licence: largest share in one stretch}; no rule about siblings."""
    words, out = re.findall("[a-z0-9]+", text.lower()), {}
    for name, template in templates:
        part = re.findall("[a-z0-9]+", template.lower())
        want = {tuple(part[i : i + 5]) for i in range(len(part) - 4)}
        for at in range(len(words)):
            near = words[at : at + len(part)]
            share = len({tuple(near[i : i + 5]) for i in range(len(near) - 4)} & want) / len(want)
            if share >= containment:
                out[name] = max(share, out.get(name, 0))
    return out


def found(spark, texts, templates=None):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {i: {} for i in range(len(texts))}
    for r in licenses.scan(docs, templates).collect():
        got[r.doc_id][r.license] = (r.contained, r.first_word)
    return [got[i] for i in range(len(texts))]


def test_parts_and_versions(spark):
    got = found(spark, [text for _, text, _ in PARTS])
    assert [(name, set(g)) for (name, _, _), g in zip(PARTS, got)] == [(name, want) for name, _, want in PARTS]


def test_whole_texts(spark):
    every = [(n, t) for n, t in licenses.every_template() if len(t) > 600]
    assert {n for n, _ in every} >= {"agpl-3.0", "apache-2.0", "bsd", "gpl-2.0", "gpl-3.0", "isc", "lgpl-2.1", "lgpl-3.0",
                                     "mit", "mpl-2.0", "unlicense"}
    got = found(spark, ["one two three " * 50 + t + " end" * 20 for _, t in every])
    for (name, _), g in zip(every, got):
        assert g[name] == (1.0, 150), name
    # no whole text is taken for another; texts may quote their own or another notice
    texts = found(spark, [t for _, t in every], every)
    assert [set(g) for g in texts] == [{n} for n, _ in every]


def test_equal_to_brute_force(spark):
    mit, bsd = (dict(licenses.every_template())[n] for n in ("mit", "bsd"))
    words = mit.split()
    holes = [" ".join(w for i, w in enumerate(words) if i % step) for step in (7, 20, 30, 40, 60)]
    texts = [mit, mit + " " + mit, *holes, " ".join(words[:100]), " ".join(words[:140]), " ".join(words[20:]),
             " ".join(words[:80]) + " x" * 60 + " ".join(words[80:]), " ".join(words[80:] + words[:80]), bsd + mit]
    templates = [("mit", mit), ("bsd", bsd)]
    got = found(spark, texts, templates)
    assert [{n: c for n, (c, _) in g.items()} for g in got] == [brute(t, templates) for t in texts]
    assert 3 < sum(map(bool, got)) < len(texts)


def test_rows_of_one_id_are_not_joined(spark):
    mit = dict(licenses.every_template())["mit"]
    docs = spark.createDataFrame([(1, mit[:500]), (1, mit[500:]), (None, mit), (None, mit)], SCHEMA)
    assert [(r.doc_id, r.license, r.contained) for r in licenses.scan(docs).collect()] == [(None, "mit", 1.0)]
