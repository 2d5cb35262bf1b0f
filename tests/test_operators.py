"""Semantics on hand-made rows."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.functions import columns as C
from sunloom.operators import align, audit, folds, metrics, ordered, quantiles, scaling, spatial
from sunloom.sources import files
from sunloom.streaming import series

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def rows_of(spark, values, loc="a"):
    return spark.createDataFrame([(loc, i, v if v is None else float(v)) for i, v in enumerate(values)], "loc string, i int, v double")


def test_interpolation(spark):
    n = None
    got = ordered.interpolate(rows_of(spark, [n, 1.0, n, n, n, 5.0, n, n, n]), ["loc"], "v", ["i"], 2).orderBy("i").collect()
    assert [r["v"] for r in got] == [n, 1, 2, 3, n, 5, 5, 5, n]


def test_interpolation_by_time(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 9, None), ("a", 10, 11.0)], "loc string, i int, v double")
    got = ordered.interpolate(rows, ["loc"], "v", ["i"], 12, F.col("i").cast("double")).orderBy("i").collect()
    assert [r["v"] for r in got] == [1, 2, 10, 11]


def test_asof_grid(spark):
    seen = spark.createDataFrame([("a", at(1), 1.0), ("a", at(11), 2.0), ("a", at(31), 3.0), ("a", at(32), None)], "loc string, ts timestamp_ntz, v double")
    grid = align.regular_grid(seen, ["loc"], 5)
    got = [(r["ts"], r["v"]) for r in align.asof_backward(grid, seen, ["loc"], "v").orderBy("ts").collect()]
    assert got == [(at(5 * k), v) for k, v in enumerate([None, 1, 1, 2, 2, 2, 2])]
    stale = [r["v"] for r in align.asof_backward(grid, seen, ["loc"], "v", stale_minutes=5).orderBy("ts").collect()]
    assert stale == [None, 1, None, 2, None, None, None]


def test_asof_over_days(spark):
    seen = spark.createDataFrame([("a", at(0), 1.0), ("b", at(5), 9.0)], "loc string, ts timestamp_ntz, v double")
    grid = spark.createDataFrame([("a", at(k * 700)) for k in range(6)], "loc string, ts timestamp_ntz")
    assert [r["v"] for r in align.asof_backward(grid, seen, ["loc"], "v").collect()] == [1.0] * 6


def test_downsample_and_missing_bin(spark):
    rows = spark.createDataFrame([("a", at(1), 1.0), ("a", at(11), 2.0), ("a", at(70), 3.0)], "loc string, ts timestamp_ntz, v double")
    means = align.downsample(rows, ["loc"], "v").select("loc", "ts", "v")
    grid = align.reindex(align.regular_grid(rows, ["loc"], 30), means, ["loc", "ts"]).orderBy("ts")
    assert [r["v"] for r in grid.collect()] == [1.5, None, 3]
    assert [r["ts"] for r in align.missing_slots(rows, ["loc"], 30).collect()] == [at(30)]


def test_clip_keeps_null_and_nan_is_null(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (0.5,), (9.0,)], "x double").select(C.nan_to_null(F.col("x")).alias("x"))
    assert [r[0] for r in rows.select(C.clip(F.col("x"), 0, 1.3)).collect()] == [None, None, 0, 0.5, 1.3]
    assert [r[0] for r in rows.select(C.tier_cap(F.col("x"), F.lit(50.0))).collect()] == [None, None, 0, 0.5, 0.85]
    assert [r[0] for r in rows.select(C.csi(F.col("x"), F.lit(10.0), 20)).collect()] == [0.0] * 5


def test_fall_back_night(spark):
    rows = spark.createDataFrame([(datetime(2024, 11, 3, 8, 30),), (datetime(2024, 11, 3, 9, 30),)], "ts timestamp_ntz")
    got = rows.select(C.local_time(F.col("ts")).alias("l"), C.fixed_to_utc(C.local_time(F.col("ts"), "Etc/GMT+8")).alias("u"), "ts").collect()
    assert [r["l"] for r in got] == [datetime(2024, 11, 3, 1, 30)] * 2 and [r["u"] for r in got] == [r["ts"] for r in got]


def test_knots_basis_and_pixels(spark):
    knots = spatial.knots(spark, (46.56, 46.82), (-119.29, -119.05))
    assert [r["n"] for r in knots.groupBy("level").agg(F.count("*").alias("n")).orderBy("level").collect()] == [12, 35, 104, 260]
    stations = spark.createDataFrame([("S1", 46.59, -119.150), ("S2", 46.82, -119.160), ("S3", 46.82, -119.150), ("P2", 46.78, -119.228)], "id string, lat double, lon double")
    phi = spatial.basis(stations, knots)
    assert spatial.active(phi).count() == 135
    assert spatial.masked(phi, spatial.active(phi, 0.5)).filter("phi > 0.5").count() == phi.filter("phi > 0.5").count()
    assert [r[0] for r in spark.range(1).select(C.wendland(F.lit(0.0), 1.0)).union(spark.range(1).select(C.wendland(F.lit(1.0), 1.0))).collect()] == [1, 0]
    pix = {r["id"]: (r["py"], r["px"]) for r in spatial.pixels(stations).collect()}
    assert pix["S2"] == pix["S3"] and len(set(pix.values())) == 3
    assert spatial.neighbours(spatial.pixels(stations)).count() == 16


def test_idw(spark):
    targets = spark.createDataFrame([(1, 46.6, -119.2), (2, 46.7, -119.1)], "id long, lat double, lon double")
    sources = spark.createDataFrame([(10, 46.6, -119.2), (11, 46.6, -119.2), (12, 46.8, -119.1), (13, 46.61, -119.25)], "id long, lat double, lon double")
    for power in (1.0, 2.0, 3.0):
        w = spatial.idw_weights(spatial.pairs(targets, sources), power)
        assert all(abs(r["s"] - 1) < 1e-12 for r in w.groupBy("target").agg(F.sum("weight").alias("s")).collect())
        assert {r["source"]: r["weight"] for r in w.filter("target = 1").collect()} == {10: 1, 11: 0, 12: 0, 13: 0}
        values = spark.createDataFrame([(10, 1.0), (11, 2.0), (12, 5.0), (13, 3.0)], "source long, value double")
        assert all(1 <= r["value"] <= 5 for r in spatial.apply_weights(w, values, []).collect())
        by_weights = {r["target"]: r["value"] for r in spatial.apply_weights(w, values, []).collect()}
        assert {r["target"]: r["value"] for r in spatial.inverse_distance(targets, sources, values, power).collect()} == pytest.approx(by_weights)
    assert [r["source"] for r in spatial.nearest(targets, sources).orderBy("target").collect()][0] == 10


def test_nearest_and_blocked_pairs(spark):
    """Clustered sources, a target among them, one far away, ties and a place without coordinates, against all pairs."""
    rng = np.random.default_rng(4)
    sources = [(i, 46.6 + 0.01 * y, -119.2 + 0.01 * x) for i, (y, x) in enumerate(rng.normal(size=(200, 2)).tolist())] + [(900, 46.6, -119.2), (901, 46.6, -119.2), (902, None, None)]
    targets = [(i, 46.6 + 0.05 * y, -119.2 + 0.05 * x) for i, (y, x) in enumerate(rng.normal(size=(60, 2)).tolist())] + [(70, 46.6, -119.2), (71, 60.0, -100.0)]
    s, t = (spark.createDataFrame(x, "id long, lat double, lon double") for x in (sources, targets))
    met = spatial.pairs(t, s.dropna()).collect()
    want = {}
    for r in met:
        want[r["target"]] = min(want.get(r["target"], (1e9, 0)), (r["km"], r["source"]))
    assert {r["target"]: (r["km"], r["source"]) for r in spatial.nearest(t, s).collect()} == want
    blocked = spatial.pairs(t, s.dropna(), most=50, parts=3).collect()
    assert sorted(map(tuple, blocked)) == sorted(map(tuple, met)) and len(met) == 62 * 202
    own = spatial.nearest(s.dropna(), s, exclude_self=True).collect()
    assert len(own) == 202 and all(r["source"] != r["target"] for r in own)
    none = s.filter("id < 0")
    assert spatial.nearest(t, none).count() == 0 and spatial.nearest(none, s).count() == 0


def test_near_duplicate_vectors(spark):
    """Vectors that start with zeros, equal ones and near ones: pairs of distinct vectors, equal ones linked to their first."""
    rng = np.random.default_rng(8)
    base = np.hstack([np.zeros((30, 5)), rng.normal(size=(30, 4))])
    near = base + rng.uniform(-1, 1, size=base.shape) * 2e-5
    rows = [(i, v) for i, v in enumerate(np.vstack([base, near]).tolist())] + [(100, base[3].tolist()), (101, base[3].tolist())]
    got = {(r["a"], r["b"]) for r in spatial.near_duplicate_vectors(spark.createDataFrame(rows, "id long, v array<double>"), 1e-4, 1e-4).collect()}
    want = {(i, j) for i, a in rows[:60] for j, b in rows[:60] if i < j and np.linalg.norm(np.array(a) - b) < 1e-4}
    assert got == want | {(3, 100), (3, 101)}


@pytest.mark.parametrize("few", [0, 10_000])
def test_exact_percentiles(spark, monkeypatch, few):
    """Large, tied, tiny and empty groups, null keys, against numpy; with few = 0 the sketch brackets every group."""
    from sunloom.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(1)
    groups = {"wide": rng.lognormal(0, 3, 30_000), "ties": rng.integers(0, 4, 20_000).astype(float), None: rng.normal(size=12_000)}
    if few:
        groups |= {"one": np.array([3.0]), "two": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("wide", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    shares = [0.0, 0.03, 0.5, 0.9, 0.99, 1.0]
    got = {r["g"]: r["p"] for r in quantiles.exact_percentiles(df, ["g"], "v", shares).collect()}
    assert got.pop("none") == [None] * 6
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k] == pytest.approx(np.quantile(vs, shares).tolist(), rel=1e-12)
    whole = quantiles.exact_percentiles(df.filter("g = 'ties'"), [], "v", [0.5]).first()[0]
    assert whole == [np.quantile(groups["ties"], 0.5)]


def test_factor_hours(spark):
    """Peak hours are 9 to 15, both counted: at 16 the factor is 1; a peak factor is held within its bounds."""
    rows = [(h, 100.0, g) for h, g in ((8, 50.0), (9, 50.0), (15, 80.0), (16, 80.0), (12, 400.0))]
    df = spark.createDataFrame(rows, "hour int, truth double, guess double")
    got = {r["hour"]: r["factor"] for r in metrics.factors(df, F.lit(1), F.col("hour"), "truth", "guess").collect()}
    assert got == {8: 1.0, 9: 1.5, 15: 1.25, 16: 1.0, 12: 0.5}


def test_blend_and_acceptance(spark):
    """Blending has no lower end, bg is held within [0, 1], the index within [0, 1.3]; clear days, noon and others decide."""
    shape = "loc string, clear double, raw double, bg double, final double, truth double, hour int, regime string"
    rows = [("a", 150.0, 0.8, 1.4, 0.2, 0.0, 10, "clear"), ("a", 199.0, -3.0, 0.5, 0.2, 0.0, 12, "clear"), ("a", 200.0, 0.8, 1.4, 0.2, 0.0, 12, None), ("a", 900.0, 0.8, 1.4, 9.0, 0.0, 15, None)]
    df = spark.createDataFrame(rows, shape)
    one = lambda at: metrics.blend_sweep(df.filter(F.col("clear") == at), [200], [0.5]).first()
    assert one(150.0)["overall_rmse"] == pytest.approx(0.9 * 150) and one(150.0)["noon_rmse"] is None
    assert one(199.0)["overall_rmse"] == 0.0 == one(199.0)["noon_rmse"]
    assert one(200.0)["overall_rmse"] == pytest.approx(0.2 * 200) and one(200.0)["clear_rmse"] is None
    assert one(900.0)["overall_rmse"] == pytest.approx(1.3 * 900)

    base = spark.createDataFrame([("a", 50.0, 40.0, 30.0), ("b", 20.0, 20.0, 20.0)], "loc string, overall_rmse double, clear_rmse double, noon_rmse double")

    def passes(a, b):
        table = spark.createDataFrame([(200.0, 0.5, "a", *a), (200.0, 0.5, "b", *b)], "threshold double, alpha double, loc string, overall_rmse double, clear_rmse double, noon_rmse double")
        return scaling.accept(table, base, "a").first()

    # clear days improve although the lead's and the pooled overall error rise
    assert passes((58.0, 39.9, 31.0), (21.0, 90.0, 90.0))["passes"]
    # the overall errors fall everywhere, but clear days do not, or noon loses more than 1, or another location does
    assert not passes((10.0, 40.0, 30.0), (10.0, 20.0, 20.0))["passes"]
    assert not passes((10.0, 39.0, 31.01), (10.0, 20.0, 20.0))["passes"]
    got = passes((10.0, 39.0, 30.0), (21.01, 20.0, 20.0))
    assert not got["passes"] and got["max_other_overall_delta"] == pytest.approx(1.01) and got["lead_clear_delta"] == -1.0 and got["pooled_overall_rmse"] == pytest.approx(15.505)
    table = spark.createDataFrame([(t, a, x, True) for t, a, x in ((300.0, 0.5, -2.0), (200.0, 0.5, -3.0), (200.0, 0.25, -3.0))] + [(400.0, 1.0, -9.0, False)], "threshold double, alpha double, lead_clear_delta double, passes boolean")
    assert [(r["threshold"], r["alpha"]) for r in scaling.passing(table).orderBy("place").collect()] == [(200.0, 0.25), (200.0, 0.5), (300.0, 0.5)]


def test_outages(spark):
    """Zeros in a row count only under a bright sky; a low share counts at any time of day, alone."""
    values = [(0.0, 201.0), (0.0, 300.0), (0.0, 201.0), (0.0, 200.0), (0.0, 300.0), (1.0, 300.0), (0.2, 5.0), (0.2, 6.0), (None, 300.0)]
    df = spark.createDataFrame([("a", at(i), i, *v) for i, v in enumerate(values)], "loc string, ts timestamp_ntz, i int, ghi double, clear double")
    runs = audit.zero_runs(df, ["loc"], F.col("ghi"), F.col("clear"), ["ts"]).collect()
    assert [(r["first_ts"], r["last_ts"], r["n"]) for r in runs] == [(at(0), at(2), 3)]
    low = audit.low_readings(df, F.col("ghi"), F.col("clear")).collect()
    assert sorted(r["i"] for r in low) == [0, 1, 2, 3, 4, 5, 7]


def test_snapshots_and_fallbacks(spark):
    day = lambda d, h, m=0: datetime(2024, 1, d, h, m)
    rows = [(day(1, 9), 10.0, 1.0), (day(1, 9, 30), 20.0, 5.0), (day(1, 12), 90.0, 2.0), (day(1, 14), 80.0, 5.0), (day(1, 15, 30), 85.0, None)]
    rows += [(day(2, 10), 1.0, None), (day(2, 11), 2.0, None), (day(2, 16), 3.0, None), (day(2, 17), 4.0, None), (day(2, 18), 0.0, None), (day(3, 8), 1.0, 1.0)]
    got = {r["day"].day: r for r in audit.snapshots(spark.createDataFrame(rows, "ts timestamp_ntz, mean double, spread double")).collect()}
    assert tuple(got[1])[1:] == (day(1, 9), day(1, 9, 30), day(1, 12), day(1, 15, 30))
    assert tuple(got[2])[1:] == (day(2, 10), None, day(2, 17), day(2, 11)) and got[3]["afternoon"] is None


def test_sky_picks_and_fallbacks(spark):
    day = lambda d, h, y=2024: datetime(y, 1, d, h)
    rows = [(day(1, 8), 999.0, 1.0), (day(1, 9), 600.0, 40.0), (day(1, 10), 500.0, 10.0), (day(1, 11), 470.0, 5.0), (day(2, 9), 200.0, 90.0), (day(2, 10), 210.0, 80.0), (day(3, 12), 300.0, 70.0)]
    rows += [(day(4, 9), 50.0, 1.0), (day(4, 10), 60.0, 1.0), (day(4, 11), 70.0, 1.0), (day(4, 12), 80.0, 1.0), (day(4, 16), 6.0, 1.0), (day(5, 9), 5.0, 1.0)]
    rows += [(day(1, 9, 2025), 130.0, 2.0), (day(2, 9, 2025), 140.0, 2.0)]
    got = {r["year"]: r for r in audit.sky_picks(spark.createDataFrame(rows, "ts timestamp_ntz, mean double, spread double")).collect()}
    assert tuple(got[2024]) == (2024, day(1, 10), day(2, 9), day(3, 12), day(4, 11))
    assert tuple(got[2025]) == (2025, day(2, 9, 2025), None, None, day(1, 9, 2025))


def test_parts_and_empty_rows(spark):
    rows = spark.createDataFrame([(2024, 2, 29, 5, 7), (2023, 2, 29, 0, 0), (2024, None, 1, 1, 1), (2024, 12, 31, 24, 0)], "y int, m int, d int, h int, n int")
    assert [r[0] for r in rows.select(C.from_parts(*map(F.col, "ymdhn"))).collect()] == [datetime(2024, 2, 29, 5, 7), None, None, None]
    rows = spark.createDataFrame([(None, None, 1), (1.0, None, 2), (None, "x", 3)], "a double, b string, i int")
    assert [r["i"] for r in rows.filter(C.any_value(["a", "b"])).collect()] == [2, 3]


def test_feed_audit(spark):
    rows = [("a", at(0)), ("a", at(10)), ("a", at(50)), ("b", at(0)), ("b", at(15)), ("c", at(5))]
    got = {r["feed"]: r for r in audit.feed_audit(spark.createDataFrame(rows, "feed string, ts timestamp_ntz"), "feed", ["ts"], 20).collect()}
    assert [(got[f]["n"], got[f]["n_gaps"], got[f]["same_start"]) for f in "abc"] == [(3, 1, 2), (2, 0, 2), (1, 0, 1)]
    assert {(r["starts"], r["ends"], r["gappy"]) for r in got.values()} == {(2, 3, 1)}


def test_patience(spark):
    """Slow drifts below the tolerance add up against the loss accepted last, not against the smallest one."""
    losses = [3.0, 3.0 - 0.8e-6, 3.0 - 1.6e-6, None, 5.0, 2.0]
    rows = ordered.history_best(rows_of(spark, losses), ["loc"], "v", "i", patience=2).orderBy("i").collect()
    assert [r["improved"] for r in rows] == [True, False, True, False, False, True]
    assert [r["waited"] for r in rows] == [0, 1, 0, 1, 2, 0] and [r["stopped"] for r in rows] == [False] * 4 + [True] * 2
    assert rows[-1]["best"] == 2.0 and rows[3]["best"] == losses[2]


def test_file_fallbacks(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path))
    (tmp_path / "b.csv").write_bytes(bytes.fromhex("69642c760a2c636166e90a2c780a"))  # a text with a stray byte, and one without
    (tmp_path / "a.csv").write_text("id,v\n,y\np7,z\n")
    found = files.list_files(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in found] == ["a.csv", "b.csv"]
    rows = files.id_or_stem(files.read_csv(spark, str(tmp_path), "id string, v string"), "id").collect()
    assert sorted((r["id"], r["v"]) for r in rows) == [("b", "caf"), ("b", "x"), ("p7", "y"), ("p7", "z")]


def test_islands(spark):
    got = ordered.runs(rows_of(spark, [0.0, 1, 1, 1, 0, 1, 1]), ["loc"], F.col("v") > 0, ["i"], ts="i").collect()
    assert [(r["first_ts"], r["last_ts"], r["n"]) for r in got] == [(1, 3, 3)]


@pytest.mark.parametrize("n, val", [(10, 2), (3, 1), (1, 1)])
def test_tail_split(spark, n, val):
    rows = ordered.tail_split(rows_of(spark, [1.0] * n), ["loc"], ["i"]).collect()
    assert sorted(r["i"] for r in rows if r["role"] == "val") == list(range(n - val, n))


def test_regimes(spark):
    rows = spark.createDataFrame([(0.0999,), (0.10,), (0.1999,), (0.20,), (None,)], "s double")
    assert [r[0] for r in rows.select(metrics.regime_of(F.col("s"))).collect()] == ["clear", "cloudy_smooth", "cloudy_smooth", "broken_cloud", None]


# Published errors of five estimators at four stations, and their published means.
PUBLISHED = {
    "nearest": ([64.032, 53.000, 53.000, 41.270], [-20.327, -4.251, 4.251, 16.993], 52.826, -0.834),
    "idw": ([66.055, 47.734, 52.239, 38.980], [-10.942, -5.299, 2.799, 15.704], 51.252, 0.565),
    "background": ([118.254, 118.378, 127.277, 133.875], [82.078, 86.244, 90.326, 102.313], 124.446, 90.240),
    "model": ([91.441, 58.004, 64.026, 59.288], [27.330, 11.123, 3.925, 24.671], 68.190, 16.763),
    "corrected": ([83.051, 58.007, 65.697, 52.743], [18.521, 4.126, -2.862, 17.500], 64.874, 9.321),
}


def test_roll_up(spark):
    rows = [(m, s, r, b) for m, (rs, bs, _, _) in PUBLISHED.items() for s, (r, b) in enumerate(zip(rs, bs))]
    got = audit.roll_up(spark.createDataFrame(rows, "method string, station int, rmse double, bias double"), ["rmse", "bias"], list(PUBLISHED)).orderBy("rank").collect()
    assert [r["method"] for r in got] == list(PUBLISHED)
    for r in got:
        assert r["rmse"] == pytest.approx(PUBLISHED[r["method"]][2], abs=0.002) and r["bias"] == pytest.approx(PUBLISHED[r["method"]][3], abs=0.002)


def test_errors(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("a", None, 1.0), ("b", 1.0, 1.0), ("c", 2.0, 2.5), ("c", 2.0, 1.5)], "g string, truth double, guess double")
    got = {r["g"]: r for r in metrics.error_table(rows, ["g"]).collect()}
    assert (got["a"]["rmse"], got["a"]["mae"], got["a"]["bias"], got["a"]["r2"], got["a"]["n"]) == (pytest.approx(0.5**0.5), 0.5, 0.5, 0.5, 2)
    assert got["b"]["rmse"] is None and got["b"]["n"] == 1 and got["c"]["r2"] is None


def test_common_rows(spark):
    rows = spark.createDataFrame([("s", 1.0, 1.0, None), ("s", 2.0, 2.0, 2.0), ("s", 3.0, 3.0, 4.0)], "loc string, truth double, a double, b double")
    counts = lambda common: {r["method"]: r["n"] for r in audit.benchmark(rows, {"a": F.col("a"), "b": F.col("b")}, ["loc"], common_rows=common).collect()}
    assert counts(False) == {"a": 3, "b": 2} and counts(True) == {"a": 2, "b": 2}


def test_lag_scopes(spark):
    rows = rows_of(spark, [1.0, 2, 3, 4]).withColumn("day", F.col("i") != 1)
    lags = lambda scope: [r["v_lag"] for r in ordered.lag_and_change(rows, ["loc"], "v", ["i"], F.col("day"), scope).orderBy("i").collect()]
    assert lags("full") == [None, 2, 3] and lags("daytime") == [None, 1, 3]


def test_splice_and_best(spark):
    a, b = rows_of(spark, [1.0, 2.0]), rows_of(spark, [7.0, 8.0, 9.0]).filter("i > 0")
    assert [r["v"] for r in ordered.splice([a, b], ["i"]).orderBy("i").collect()] == [1, 8, 9]
    best = ordered.history_best(rows_of(spark, [3.0, 2.0, 2.0 - 1e-9, 1.0]), ["loc"], "v", "i").orderBy("i").collect()
    assert [r["improved"] for r in best] == [True, True, False, True]


def test_folds_cover(spark):
    rows = spark.createDataFrame([(s, i) for s in "abc" for i in range(5)], "loc string, i int")
    held = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "fold_id int, held string")
    got = folds.leave_one_out(rows, held, "loc", ["i"]).groupBy("fold_id").pivot("role", ["train", "val", "test"]).count().collect()
    assert all((r["train"], r["val"], r["test"]) == (8, 2, 5) for r in got) and len(got) == 3


def test_covariates(spark):
    names = [c for c in folds.COVARIATES if c not in ("bg_lag", "bg_change", "clear_share", "bt_lag", "bt_change", "doy_sin", "doy_cos", "hour_sin", "hour_cos")]
    rows = spark.createDataFrame([("a", at(30 * i), 100.0 * i, *[float(i)] * len(names)) for i in range(3)], "loc string, ts timestamp_ntz, clear double, " + ", ".join(f"{n} double" for n in names))
    got = folds.covariates(rows, ["loc"], ["ts"], F.col("ts")).orderBy("ts").collect()
    assert [len(r["covariates"]) for r in got] == [18] * 3
    assert got[1]["covariates"][:4] == [1, 0, 1, 0.5]
    assert got[1]["covariates"][4] == 1 and got[1]["covariates"][8:14] == pytest.approx([(1 - r) / w for r, w in list(folds.NORMS.values())[1:]])
    scaled = spark.createDataFrame([([1.0, 4.0], [0.0, 2.0], [1.0, 2.0])], "x array<double>, m array<double>, s array<double>").select(folds.standardise("x", F.col("m"), F.col("s")))
    assert scaled.first()[0] == [1, 1]


def test_nearest_instant(spark):
    targets = spark.createDataFrame([(1, at(10)), (2, at(1000)), (3, at(25))], "id int, at timestamp_ntz")
    seen = spark.createDataFrame([(at(5),), (at(15),), (at(40),), (at(40),)], "ts timestamp_ntz")
    assert {r["id"]: r["near"] for r in align.nearest_instant(targets, seen, 60).collect()} == {1: at(5), 2: None, 3: at(15)}


def test_preamble_csv(spark, tmp_path):
    lines = ["Source,Location ID,City,State,Country,Latitude,Longitude,Time Zone,Elevation", "NSRDB,1,-,-,-,46.56,-119.29,-8,321", "Year,Month,Day,Hour,Minute,GHI", "2024,1,1,0,30,0", "2024,1,1,1,0,17"]
    (tmp_path / "46.56_-119.29_2024.csv").write_text("\n".join(lines))
    rows = files.read_preamble_csv(spark, str(tmp_path), ["Year", "Month", "GHI", "DNI"])
    lat, lon = files.place_of_file(F.col("file"))
    got = rows.select("meta", "GHI", "DNI", lat.alias("lat"), lon.alias("lon")).orderBy("GHI").collect()
    assert [tuple(r) for r in got] == [("321", "0", None, 46.56, -119.29), ("321", "17", None, 46.56, -119.29)]


def test_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿ts;v\n2024-01-01 00:00:00;1.5\n", encoding="utf-8")
    assert files.read_sniffed_csv(spark, str(tmp_path / "x.csv"), "ts timestamp_ntz, v double").collect()[0]["v"] == 1.5
    frame = files.with_optional(spark.range(1).withColumn("junk", F.lit(1)), {"refl": "double", "id": "long"}, ["junk", "absent"])
    assert frame.columns == ["id", "refl"]
    with pytest.raises(ValueError, match="b, c"):
        files.require(frame.withColumn("a", F.lit(1)), ["a", "b", "c"])
    files.write_rounded_csv(spark.createDataFrame([(1.23456,)], "v double"), str(tmp_path / "r"), 2)
    assert spark.read.csv(str(tmp_path / "r"), header=True).collect()[0]["v"] == "1.23"
    files.write_report(spark.createDataFrame([("a", 1.0), ("b", None)], "loc string, rmse double").orderBy("loc"), str(tmp_path / "report"), "errors")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["errors", "loc\trmse", "a\t1.0", "b\t"]
    files.write_vectors(spark.createDataFrame([("a", [1.0, 2.0])], "loc string, x array<double>"), str(tmp_path / "v"), ["loc"])
    assert dict(spark.read.parquet(str(tmp_path / "v")).dtypes)["x"] == "array<float>"


def stream(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def drain(frame, tmp_path, name):
    query = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name).collect()


def test_stream_means(spark, tmp_path):
    rows = stream(spark, tmp_path, [[("a", at(1), 1.0), ("a", at(11), 2.0)], [("a", at(600), 9.0)], [("a", at(700), 9.0)], [("a", at(2), 50.0), ("a", at(900), 1.0)]], "loc string, ts timestamp, v double")
    got = sorted(drain(series.stream_means(rows, "loc", "v"), tmp_path, "means"), key=lambda r: r["ts"])
    assert [(r["v"], r["n"]) for r in got] == [(1.5, 2), (9.0, 1), (9.0, 1)]  # the late row comes after its bin is closed


@pytest.fixture
def stateful(spark):
    spark.conf.set(*series.STORE)
    yield spark
    spark.conf.unset(series.STORE[0])


def test_stream_gaps(stateful, tmp_path):
    """Row 50 comes after rows 0 and 100: the gap between these two is none."""
    rows = stream(stateful, tmp_path, [[("a", at(0)), ("a", at(100))], [("a", at(50)), ("b", at(0))], [("c", at(5000))]], "loc string, ts timestamp")
    got = drain(series.stream_gaps(rows, "loc", 60), tmp_path, "gaps")
    assert got == []


def test_stream_gaps_equal_the_batch_operator(stateful, tmp_path):
    """Shuffled rows, as late as the watermark allows, repeated ones, three keys, one of which falls silent."""
    rng = np.random.default_rng(11)
    whole = [(k, int(m)) for k, n, top in (("a", 60, 3000), ("b", 40, 3000), ("c", 10, 400)) for m in rng.choice(top, n, replace=False)]
    whole += whole[:7]
    batches = [[(k, at(m)) for k, m in rng.permutation(np.array([w for w in whole if lo <= w[1] < lo + 500], dtype=object))] for lo in range(0, 3000, 500)]
    rows = stream(stateful, tmp_path, [*batches, [("z", at(20_000))], [("z", at(20_001))]], "loc string, ts timestamp")
    got = drain(series.stream_gaps(rows, "loc", 45, late="600 minutes"), tmp_path, "more")
    every = stateful.createDataFrame([(k, at(m)) for k, m in set(whole)], "loc string, ts timestamp")
    want = ordered.gaps(every, ["loc"], ["ts"], 45).collect()
    key = lambda r: (r["loc"], r["until"])
    assert [tuple(r) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(want, key=key)] and len(want) > 10


def test_stream_gaps_forgets_silent_keys(stateful, tmp_path):
    """After its time of silence a key begins anew: the gap that ends then is not told, those of others are."""
    batches = [[("a", at(0)), ("b", at(0))], [("b", at(2000))], [("b", at(4000))], [("b", at(6000))], [("a", at(6500)), ("b", at(6500))], [("z", at(20_000))], [("z", at(20_001))]]
    rows = stream(stateful, tmp_path, batches, "loc string, ts timestamp")
    got = drain(series.stream_gaps(rows, "loc", 1000, forget_minutes=2500), tmp_path, "silent")
    assert sorted((r["loc"], r["minutes"]) for r in got) == [("b", 2000.0)] * 3


def test_sketches_merge(spark):
    """Sketches by day, merged over days and locations: ranks within a hundredth; nulls count nowhere."""
    rng = np.random.default_rng(12)
    rows = [(f"s{i % 3}", i % 17, float(v) if i % 11 else None) for i, v in enumerate(rng.exponential(size=6000))] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "loc string, day int, v double")
    by_day = quantiles.sketches(df, ["loc", "day"], "v")
    for by in (["loc"], ["day"]):
        got = quantiles.rank_errors(df, by, "v", quantiles.sketched(quantiles.merged(by_day, by), by, [0.0, 0.25, 0.5, 0.99, 1.0])).collect()
        assert len(got) == 5 * (3 if by == ["loc"] else 17) and all(r["error"] <= 0.01 for r in got)
    n = sum(r["n"] for r in quantiles.merged(by_day, ["loc"]).collect())
    assert n == sum(v is not None for *_, v in rows)
    wrong = quantiles.merged(by_day, ["loc"]).select("loc", F.lit(0.5).alias("share"), "n", F.lit(99.0).alias("guess"))
    assert all(r["error"] == 0.5 for r in quantiles.rank_errors(df, ["loc"], "v", wrong).collect())


@pytest.mark.parametrize("width", [1, 3, 65_536])
def test_ranges_of_an_order_join_up(spark, monkeypatch, width):
    """What a range needs of other ranges is carried: any width gives the results of one."""
    monkeypatch.setattr(ordered, "NUMBERS", width)
    values = [None, 1, None, None, None, 5, 6, None, None, None, 2, 2, None]
    rows = rows_of(spark, values).unionByName(rows_of(spark, [3, None, 4], "b")).unionByName(rows_of(spark, [1, 2], None))
    key = lambda r: (r["loc"] or "", r["i"])
    collect = lambda df: sorted(df.collect(), key=key)
    assert [r["before"] and r["before"]["v"] for r in collect(ordered.previous(rows, ["loc"], ["i"], ["v"]))] == [None, 1, None, *values[:-1], None, 3, None]
    assert [r["total"] for r in collect(ordered.running_sum(rows, ["loc"], ["i"], "v", "total"))] == [1, 3, 0, 1, 1, 1, 1, 6, 12, 12, 12, 12, 14, 16, 16, 3, 3, 7]
    assert [(r["__n"], r["__total"]) for r in collect(ordered.numbered(rows, ["loc"], ["i"]))] == [(1, 2), (2, 2), *[(i + 1, 13) for i in range(13)], (1, 3), (2, 3), (3, 3)]
    filled = [r["v"] for r in collect(ordered.interpolate(rows, ["loc"], "v", ["i"], 2))]
    assert filled == [1, 2, None, 1, 2, 3, None, 5, 6, 5, 4, None, 2, 2, 2, 3, 3.5, 4]
    assert [(r["loc"], r["n"]) for r in ordered.runs(rows, ["loc"], F.col("v").isNull(), ["i"], 3, "i").collect()] == [("a", 3), ("a", 3)]


def test_order_by_text_and_refusal(spark):
    words = ["apple", "apples", "applf", "b", "", None, "zoo", "apple pie"]
    rows = spark.createDataFrame([("x", w, i) for i, w in enumerate(words)], "loc string, w string, i int")
    got = {r["w"]: r["total"] for r in ordered.running_sum(rows, ["loc"], ["w"], "i", "total").collect()}
    order, want, total = sorted(words, key=lambda w: (w is not None, w or "")), {}, 0
    for w in order:
        total += words.index(w)
        want[w] = total
    assert got == want
    with pytest.raises(TypeError):
        ordered.running_sum(rows.withColumn("a", F.array("i")), ["loc"], ["a"], "i", "total")
