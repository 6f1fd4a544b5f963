import random

import pytest

from profila.llm import mixing
from profila.llm.queries import op6_mix_sources

SCHEMA = "doc_id long, text string, source string, size string"


def test_water_fill_shares_everything_within_limits():
    assert [float(x) for x in mixing.water_fill([100, 100, 100], [5, 2, 1])] == [187.5, 75.0, 37.5]
    shares = mixing.water_fill([10, 1000, 1000], [5, 2, 1])
    assert shares[0] == 30 and sum(shares) == 2010
    assert float(shares[1]) == 1320.0
    assert mixing.water_fill([], []) == [] and mixing.water_fill([0, 4], [5, 2]) == [0, 4]


@pytest.mark.parametrize("seed", range(30))
def test_fit_comes_as_near_as_brute_force(seed):
    r = random.Random(seed)
    lengths = sorted(r.sample(range(1, 40), 4))
    counts = [r.randint(1, 3) for _ in lengths]
    budget = r.randint(0, sum(n * c for n, c in zip(lengths, counts)))
    take = mixing.fit_lengths(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(take, counts))
    gap = abs(budget - sum(n * t for n, t in zip(lengths, take)))
    assert gap <= max(lengths)


def test_knapsack_equals_brute_force():
    items = [(3, 2), (7, 1), (10, 3)]
    sums = {3 * a + 7 * b + 10 * c for a in range(3) for b in range(2) for c in range(4)}
    for room in range(45):
        found = mixing._knapsack(items, room)
        assert sum(n * t for n, t in found.items()) == max(s for s in sums if s <= room)


def test_large_budget_closes_the_gap():
    lengths = list(range(1, 20_000, 7))
    take = mixing.fit_lengths(lengths, [9] * len(lengths), 123_456_789)
    assert sum(n * t for n, t in zip(lengths, take)) == 123_456_789


def test_edges(spark):
    rows = [(1, None, "b", "x"), (2, " \t", "b", None), (3, "a b c", None, "x"), (3, "a b c", None, "x"),
            (None, "one", "a", "x"), (4, "w " * 5000, "a", "x"), (5, "q r", "b", "x")]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.copies for r in out if r.size == 0} == {1: 0, 2: 0}
    assert all(0 <= r.copies <= 3 for r in out)
    assert {r.source: r.target for r in out}["b"] == 6.0
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_takes_whole_documents_near_targets(spark):
    one, two = (op6_mix_sources(spark, "/root/testdata/sf0.01").collect() for _ in range(2))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    taken, target, most = {}, {}, {}
    for r in one:
        assert r.taken % r.size == 0 if r.size else r.taken == 0
        assert r.taken <= 3 * r.size
        key = (r.source_size, r.target)
        taken[key] = taken.get(key, 0) + r.taken
    assert all(abs(taken[k] - k[1]) <= 3 for k in taken)
    assert abs(sum(r.size for r in one) - sum(t for _, t in taken)) < 1e-6
