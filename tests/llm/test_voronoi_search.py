"""The Voronoi search against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswire.llm import voronoi_search as search

SCHEMA = "vec_id long, embedding array<double>, label int, row string, cell string, score string, query string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z", "q") for i, v in rows], SCHEMA)


def by_hand(rows, k=20, every=20):
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
              if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(usable):
        if q is None or q % every:
            continue
        scored = sorted((-min(max(sum(x * y for x, y in zip(a, b)), -2**63), 2**63 - 1), i is None, i or 0)
                        for n, (i, b) in enumerate(usable) if n != at)
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def ours(df, k=20, every=20, **options):
    found = search.top_k(df, F.col("vec_id") % every == 0, k=k, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def clusters(n, width=6, centres=12, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(centres, width)) * 3
    return [(i, (middles[i % centres] + rng.normal(size=width) * 0.02).tolist()) for i in range(n)]


@pytest.mark.parametrize("pivots", [1, 7, 1024])
def test_clusters_and_noise(spark, pivots):
    rng = np.random.default_rng(3)
    rows = clusters(300) + [(i, rng.normal(size=6).tolist()) for i in range(300, 600)]
    assert ours(frame(spark, rows), pivots=pivots) == by_hand(rows)


def test_bounds_rule_out_cells_of_clustered_data(spark):
    rows = clusters(2400)
    cells, pivots = search.assigned(frame(spark, rows), F.col("vec_id") % 20 == 0)
    summary = search.Summary(cells, pivots, 20)
    units = np.array([[math.floor(64 * x) for x in v] for i, v in rows if i % 20 == 0], dtype=float)
    need = summary.needed(units, search._distances(units, pivots).argmin(1))
    assert need.mean() < 0.4
    assert ours(frame(spark, rows)) == by_hand(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [inf, 0.0]), (80, [None, 1.0]), (100, []),
            (None, [1.0, 2.0]), (None, [-1.0, 2.0]), (1, [0.5]), (2, [1.0, 2.0, 3.0]), (-20, [-1.5, 0.0]), (3, [1.0, 2.0]),
            (0, [1.0, 2.0]), (0, [0.0, 0.1]), (5, [1.0, 2.0]), (5, [1.0, 2.0])]
    assert ours(frame(spark, rows)) == by_hand(rows)
    assert ours(frame(spark, rows), k=3) == by_hand(rows, k=3)


def test_empty_and_alone(spark):
    assert ours(frame(spark, [])) == []
    assert ours(frame(spark, [(0, [1.0])])) == []
    assert ours(frame(spark, [(1, [1.0]), (2, [1.0])])) == []


def test_ties_and_one_hot_vector(spark):
    rows = [(i, [0.25, -0.5]) if i % 3 else (i, [i % 4 / 4, 0.5]) for i in range(900)]
    assert ours(frame(spark, rows)) == by_hand(rows)


def test_numbers_beyond_floats_are_exact(spark):
    rows = [(i, [float(2**40 + i), float(3 - i), 1e13 * i]) for i in range(60)]
    assert ours(frame(spark, rows)) == by_hand(rows)
    huge = [(i, [1e300 * (i - 20), 1.0]) for i in range(45)]
    assert ours(frame(spark, huge)) == by_hand(huge)


def test_groups_and_blocks_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(search, "GROUP_QUERIES", 7)
    monkeypatch.setattr(search, "BLOCK_ROWS", 50)
    rows = clusters(700) + [(i, [0.5] * 6) for i in range(700, 1000)]
    assert ours(frame(spark, rows), every=5) == by_hand(rows, every=5)
