"""Nearest sources, inverse distance and matrix products against plain loops, under skew; numbering; nearest instants."""

import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.operators import align, ordered, spatial

SHAPE = "id long, lat double, lon double"


def km(a, b):
    return math.sqrt(((a[1] - b[1]) * 111.0) ** 2 + ((a[2] - b[2]) * 75.8) ** 2)


def plain_nearest(targets, sources, exclude_self=False):
    found = {}
    for t in targets:
        best = min(((km(t, s), s[0]) for s in sources if None not in s and not (exclude_self and s[0] == t[0])), default=None) if None not in t else None
        if best:
            found[t[0]] = best
    return found


def got_nearest(spark, targets, sources, exclude_self=False):
    rows = spatial.nearest(spark.createDataFrame(targets, SHAPE), spark.createDataFrame(sources, SHAPE), exclude_self).collect()
    assert len({r["target"] for r in rows}) == len(rows)
    return {r["target"]: (r["km"], r["source"]) for r in rows}


def clusters(seed, n, spread):
    rng = np.random.default_rng(seed)
    return [(i, 46.6 + spread * y, -119.2 + spread * x) for i, (y, x) in enumerate(rng.normal(size=(n, 2)).tolist())]


@pytest.mark.parametrize("case", ["outlier", "coincident", "line", "even", "far"])
def test_nearest_by_cells_is_the_nearest_of_all(spark, monkeypatch, case):
    monkeypatch.setattr(spatial, "LEAF", 6)
    sources = {
        "outlier": [*clusters(1, 300, 1e-4), (900, 80.0, 100.0)],
        "coincident": [(i, 46.6, -119.2) for i in range(300)] + [(400 + i, 46.7, -119.2) for i in range(9)],
        "line": [(i, 46.0 + (i % 120) / 1000, -119.2) for i in range(300)],  # equal distances, places twice
        "even": [(i, 46.0 + i // 20 / 16, -119.0 + i % 20 / 16) for i in range(400)],
        "far": [*clusters(2, 200, 0.01), *((300 + i, a + 1.5, b - 3) for i, a, b in clusters(3, 200, 1e-3))],
    }[case]
    targets = [*clusters(4, 60, 0.02), (70, 46.6, -119.2), (71, 60.0, -100.0), (72, 46.05, -119.2), (73, None, 1.0), (74, 46.03125, -118.96875), (900, 46.6, -119.2)]
    for exclude_self in (False, True):
        got, want = got_nearest(spark, targets, sources, exclude_self), plain_nearest(targets, sources, exclude_self)
        assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)
    own = got_nearest(spark, sources, sources, True)
    assert {k: v[1] for k, v in own.items()} == {k: v[1] for k, v in plain_nearest(sources, sources, True).items()}


def test_leaves_are_small_whatever_the_extent(spark):
    """A dense cluster, one place far away: no leaf holds more than LEAF positions, and each position is in one leaf."""
    places = [*clusters(5, 3000, 1e-5), (9000, -80.0, 170.0)]
    s = spatial._spots(spark.createDataFrame(places, SHAPE).select(F.col("id").alias("source"), F.col("lat").alias("slat"), F.col("lon").alias("slon")))
    side = 40_000.0
    levels, leaves = spatial._tree(s, side, -81 * 111.0, -120 * 75.8)
    sizes = [r["count"] for r in leaves.groupBy("level", "cy", "cx").count().collect()]
    assert sum(sizes) == 3001 and max(sizes) <= spatial.LEAF and min(levels) > 5 and len(levels) < 6


def plain_idw(targets, sources, values, power, coincident, exclude_self=False):
    found = {}
    for t in targets:
        near = sorted((km(t, s), s[0]) for s in sources if s[0] in values and not (exclude_self and s[0] == t[0]))
        if coincident is not None and near[0][0] < coincident:
            found[t[0]] = values[near[0][1]]
        elif near[0][0] == 0:
            found[t[0]] = math.nan
        else:
            found[t[0]] = sum(values[i] / d**power for d, i in near) / sum(1 / d**power for d, i in near)
    return found


@pytest.mark.parametrize("most", [2_000, 1])
@pytest.mark.parametrize("power, coincident, exclude_self", [(2.0, 0.001, False), (1.0, None, False), (3.0, 0.001, False), (1.0, None, True)])
def test_inverse_distance_by_blocks(spark, monkeypatch, most, power, coincident, exclude_self):
    monkeypatch.setattr(spatial, "BLOCK", 7)
    monkeypatch.setattr(spatial, "MAX_BLOCKS", most)
    sources = [*clusters(6, 60, 0.05), (100, 46.6, -119.2), (101, 46.6, -119.2), (102, 46.7, -119.1)]
    targets = sources if exclude_self else [*clusters(7, 20, 0.1), (100, 46.6, -119.2), (200, 46.7, -119.1)]
    values = {s[0]: float(s[0] % 13) for s in sources if s[0] != 5}
    rows = spatial.inverse_distance(spark.createDataFrame(targets, SHAPE), spark.createDataFrame(sources, SHAPE), spark.createDataFrame([*values.items(), (5, None)], "source long, value double"), power, coincident, exclude_self)
    got, want = {r["target"]: r["value"] for r in rows.collect()}, plain_idw(targets, sources, values, power, coincident, exclude_self)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], nan_ok=True) for k in want)


@pytest.mark.parametrize("most", [100_000, 0])
def test_weights_times_values(spark, monkeypatch, most):
    """Instants without some sources, null values, a target that takes only some sources, blocks of two targets."""
    monkeypatch.setattr(spatial, "BLOCK", 2)
    monkeypatch.setattr(spatial, "MAX_SOURCES", most)
    weights = [(t, s, (t + 1) * 0.5 + s) for t in range(5) for s in range(6) if t != 3 or s < 2]
    values = [(s, ts, float(s * ts) if (s + ts) % 5 else None) for ts in range(7) for s in range(8) if (s * ts) % 7 != 3] + [(5, 99, 1.0), (1, 98, None)]
    got = spatial.apply_weights(spark.createDataFrame(weights, "target int, source int, weight double"), spark.createDataFrame(values, "source int, ts int, value double"), ["ts"])
    want = {}
    for t, s, w in weights:
        for s2, ts, v in values:
            if s == s2 and v is not None:
                want[t, ts] = want.get((t, ts), 0.0) + w * v
    assert {(r["target"], r["ts"]): r["value"] for r in got.collect()} == pytest.approx(want)


def test_product_has_no_row_for_target_source_and_instant(spark):
    weights = spark.createDataFrame([(t, s, 1.0) for t in range(20) for s in range(30)], "target int, source int, weight double")
    values = spark.createDataFrame([(s, ts, 1.0) for ts in range(50) for s in range(30)], "source int, ts int, value double")
    out = spatial.apply_weights(weights, values, ["ts"])
    assert out.count() == 20 * 50 and {r["value"] for r in out.collect()} == {30.0}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[target#\d+, ts", plan)  # nothing is summed over rows of a target and instant


def test_dense_index(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), "id").repartition(7)
    got = ordered.dense_index(rows, ["v", "id"]).collect()
    assert [r["index"] for r in sorted(got, key=lambda r: (r["v"], r["id"]))] == list(range(5000))
    ties = ordered.dense_index(rows.select("v"), ["v"], "at").collect()
    placed = sorted(ties, key=lambda r: r["at"])
    assert [r["at"] for r in placed] == list(range(5000)) and all(a["v"] <= b["v"] for a, b in zip(placed, placed[1:]))
    assert ordered.dense_index(rows.filter("id < 0"), ["v"]).count() == 0


def test_nearest_instant_in_dense_and_empty_stretches(spark):
    rng = np.random.default_rng(8)
    start = dt.datetime(2024, 3, 1)
    at = lambda s: start + dt.timedelta(seconds=float(s))
    given = [at(s) for s in np.round(rng.uniform(0, 400_000, 300)).tolist() + [10, 10, 20, 86_400, 86_400 * 3]] + [None]
    wanted = [(i, at(s)) for i, s in enumerate(np.round(rng.uniform(-20_000, 500_000, 200)).tolist() + [15, 86_400, 3_000_000] + [77] * 40)] + [(900, None)]
    for minutes in (1, 30, 6000):
        rows = align.nearest_instant(spark.createDataFrame(wanted, "id int, at timestamp_ntz"), spark.createDataFrame([(g,) for g in given], "ts timestamp_ntz"), minutes)
        want = {}
        for i, a in wanted:
            near = min(((abs((g - a).total_seconds()), g) for g in given if g is not None), default=None) if a else None
            want[i] = near[1] if near and near[0] <= 60 * minutes else None
        assert {r["id"]: r["near"] for r in rows.collect()} == want
