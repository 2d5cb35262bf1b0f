"""Queries on stations and features: baselines from other stations, field statistics, features, scaling, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import align as A
from ..operators import audit, folds, metrics, mlp, quantiles, scaling, spatial
from ..operators import ordered as O
from ..sources.staging import durable
from .fields import DAY, PIXELS, REGIME, STACK, _errors, _folds, _labelled, _methods, _rounded
from .registry import KM, OBS, PLACES, observations, places, query, read

STATIONS = """
stations AS (
  SELECT loc AS id, 46.56e0 + 0.05e0 * CAST(k AS DOUBLE) AS lat, -119.29e0 + 0.04e0 * CAST((3 * k) % 5 AS DOUBLE) AS lon
  FROM (SELECT loc, row_number() OVER (ORDER BY loc) - 1 AS k FROM (SELECT DISTINCT loc FROM obs)))"""


def _stations(o: DataFrame) -> DataFrame:
    """The event types as places; as many rows as types."""
    s = o.select(F.col("loc").alias("id")).distinct().withColumn("k", F.row_number().over(Window.orderBy("id")) - 1)
    return s.select("id", (C.num(46.56) + C.num(0.05) * F.col("k")).alias("lat"), (C.num(-119.29) + C.num(0.04) * ((3 * F.col("k")) % 5).cast("double")).alias("lon"))


SERIES = f"""
bins AS (SELECT loc, time_bucket(INTERVAL 6 HOURS, ts) AS ts, avg(value) AS value, avg(bg) AS bg, avg(clear) AS clear, avg(k13) AS k13 FROM obs GROUP BY ALL),
whole AS (SELECT * FROM bins SEMI JOIN (SELECT ts FROM bins GROUP BY ts HAVING count(*) = (SELECT count(*) FROM stations)) USING (ts)),
met AS (SELECT t.id AS target, s.id AS source, {KM} AS km FROM stations t JOIN stations s ON t.id <> s.id)"""
BASELINES = f"""
WITH {OBS}, {STATIONS}, {SERIES},
w AS (SELECT target, source, (1e0 / km) / sum(1e0 / km) OVER (PARTITION BY target) AS weight FROM met),
idw AS (SELECT target AS loc, ts, sum(weight * value) AS idw FROM w JOIN whole ON source = loc GROUP BY ALL),
closest AS (SELECT target, min(struct_pack(km := km, source := source)).source AS source FROM met GROUP BY target),
copied AS (SELECT target AS loc, ts, value AS copied FROM closest JOIN whole ON source = loc),
side AS (SELECT loc, ts, value AS truth, idw, copied, least(greatest(bg, 0e0), 1.3e0) * clear AS background, clear FROM whole JOIN idw USING (loc, ts) JOIN copied USING (loc, ts))"""


def _baselines(o: DataFrame) -> DataFrame:
    """loc, ts, truth and the estimates of a station by its neighbours: nearest copy, inverse distance, background."""
    return _beside(durable(_stations(o)), durable(_bins(o)))


def _bins(o: DataFrame) -> DataFrame:
    return o.groupBy("loc", A.bin_start(F.col("ts"), 360).alias("ts")).agg(*[F.avg(c).alias(c) for c in ("value", "bg", "clear", "k13")])


def _beside(stations: DataFrame, bins: DataFrame) -> DataFrame:
    n = stations.count()
    whole = A.known(bins, bins.groupBy("ts").agg(F.count("*").alias("n")).filter(F.col("n") == n), ["ts"])
    met = spatial.pairs(stations, stations, exclude_self=True)
    series = whole.select(F.col("loc").alias("source"), "ts", "value")
    idw = spatial.apply_weights(spatial.idw_weights(met, 1.0, None), series, ["ts"]).select(F.col("target").alias("loc"), "ts", F.col("value").alias("idw"))
    copied = spatial.nearest(stations, stations, exclude_self=True).join(series, "source").select(F.col("target").alias("loc"), "ts", F.col("value").alias("copied"))
    side = A.align([whole, idw, copied], ["loc", "ts"])
    return durable(side.select("loc", "ts", F.col("value").alias("truth"), "idw", "copied", (C.clip(F.col("bg"), 0.0, 1.3) * F.col("clear")).alias("background"), "clear"))  # all that follows reads it again and again


@query(f"""{BASELINES}, stacked AS (
  SELECT loc, truth, 'nearest_copy' AS method, copied AS guess FROM side UNION ALL SELECT loc, truth, 'idw', idw FROM side UNION ALL SELECT loc, truth, 'background', background FROM side)
SELECT loc, method, {_errors('truth', 'guess')} FROM stacked GROUP BY ALL""")
def bench_stations(spark, d) -> DataFrame:
    """Baselines of every station from the others, on instants that all stations have."""
    methods = {"nearest_copy": F.col("copied"), "idw": F.col("idw"), "background": F.col("background")}
    return _rounded(audit.benchmark(_baselines(observations(spark, d)), methods, ["loc"]))


@query(f"""{BASELINES}, e AS (SELECT loc, sqrt(avg((copied - truth) * (copied - truth))) AS copied, sqrt(avg((idw - truth) * (idw - truth))) AS idw FROM side GROUP BY loc)
SELECT round(avg(copied), 5) AS copied, round(avg(idw), 5) AS idw, CASE WHEN avg(idw) < avg(copied) THEN 'idw' ELSE 'nearest_copy' END AS better FROM e""")
def verdict(spark, d) -> DataFrame:
    """Which of two baselines has the lower mean error over stations."""
    side = _baselines(observations(spark, d))
    rmse = lambda c: F.sqrt(F.avg((F.col(c) - F.col("truth")) * (F.col(c) - F.col("truth")))).alias(c)
    both = side.groupBy("loc").agg(rmse("copied"), rmse("idw")).agg(F.avg("copied").alias("copied"), F.avg("idw").alias("idw"))
    return both.select(F.round("copied", 5).alias("copied"), F.round("idw", 5).alias("idw"), F.when(F.col("idw") < F.col("copied"), "idw").otherwise("nearest_copy").alias("better"))


@query(f"WITH {OBS} SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS ts, round(avg(clear), 6) AS mean, round(stddev_samp(clear), 6) AS spread, median(clear) AS median, count(*) AS n FROM obs GROUP BY 1")
def row_stats(spark, d) -> DataFrame:
    """The field's mean, sample deviation and median over all locations at each instant; no task holds an instant's values."""
    rows = observations(spark, d).select(A.bin_start(F.col("ts"), 30).alias("ts"), "clear")
    means = rows.groupBy("ts").agg(F.round(F.avg("clear"), 6).alias("mean"), F.round(F.stddev_samp("clear"), 6).alias("spread"), F.count("*").alias("n"))
    medians = quantiles.exact_percentiles(rows, ["ts"], "clear", [0.5]).select("ts", F.get("p", F.lit(0)).alias("median"))
    return means.join(medians, "ts").select("ts", "mean", "spread", "median", "n")


_MONTHS = ", ".join(f"max(total) FILTER (month = {m}) AS m{m}" for m in range(1, 13))


@query(f"WITH t AS (SELECT dayofmonth(o_orderdate) AS day, month(o_orderdate) AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL) SELECT CAST(day AS INTEGER) AS day, {_MONTHS} FROM t GROUP BY day")
def calendar_pivot(spark, d) -> DataFrame:
    """A measure by two calendar parts, one of them as columns; the columns are given, so that no job looks for them."""
    o = read(spark, d, "orders")
    t = o.groupBy(F.dayofmonth("o_orderdate").alias("day"), F.month("o_orderdate").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    wide = t.groupBy("day").pivot("month", list(range(1, 13))).agg(F.max("total"))
    return wide.select("day", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


@query(f"WITH {OBS} SELECT loc, count(*) AS n, round(avg(raw) FILTER (clear >= 1e2), 6) AS day_mean, round(stddev_samp(raw) FILTER (clear >= 1e2), 6) AS day_spread, max(raw) FILTER (clear >= 1e2) AS day_top, round(count(*) FILTER (clear >= 1e2) / CAST(count(*) AS DOUBLE), 9) AS day_share FROM obs GROUP BY loc")
def sanity_stats(spark, d) -> DataFrame:
    by_day = F.when(F.col("clear") >= 100, F.col("raw"))
    return observations(spark, d).groupBy("loc").agg(
        F.count("*").alias("n"), F.round(F.avg(by_day), 6).alias("day_mean"), F.round(F.stddev_samp(by_day), 6).alias("day_spread"), F.max(by_day).alias("day_top"),
        F.round(F.count_if(F.col("clear") >= 100) / F.count("*"), 9).alias("day_share"),
    )


@query(f"""WITH {OBS}, x AS (SELECT *, row_number() OVER (PARTITION BY loc ORDER BY ts, event_id) AS rn FROM obs),
p AS (SELECT *, last_value(CASE WHEN ghi IS NOT NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY loc ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pn FROM x)
SELECT loc, count(*) FILTER (ghi IS NULL) AS before, count(*) FILTER (ghi IS NULL AND (pn IS NULL OR rn - pn > 2)) AS after FROM p GROUP BY loc""")
def fill_counts(spark, d) -> DataFrame:
    """Nulls of each location before and after gaps of at most two rows are filled."""
    o = observations(spark, d).withColumn("unfilled", F.col("ghi"))
    filled = O.interpolate(o, ["loc"], "ghi", ["ts", "event_id"], 2)
    return filled.groupBy("loc").agg(F.count_if(F.col("unfilled").isNull()).alias("before"), F.count_if(F.col("ghi").isNull()).alias("after"))


@query("SELECT event_id, event_type AS loc, sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM events")
def running_total(spark, d) -> DataFrame:
    rows = O.running_sum(read(spark, d, "events"), ["event_type"], ["ts", "event_id"], "user_id", "total")
    return rows.select("event_id", F.col("event_type").alias("loc"), "total")


@query(f"WITH {OBS} SELECT event_id, ghi, clear FROM obs WHERE ghi IS NOT NULL AND CASE WHEN k13 > 0 THEN value / k13 END IS NOT NULL")
def complete_rows(spark, d) -> DataFrame:
    """Rows without a null in any feature or the target."""
    o = observations(spark, d).withColumn("per", F.try_divide("value", "k13"))
    return o.select("event_id", "ghi", "clear", "per").dropna(how="any").drop("per")


@query("SELECT c_custkey, substr(c_name, 10) AS bare FROM customer WHERE starts_with(c_name, 'Customer#0000000')")
def prefix_strip(spark, d) -> DataFrame:
    c = read(spark, d, "customer").filter(F.col("c_name").startswith("Customer#0000000"))
    return c.select("c_custkey", F.regexp_replace("c_name", "^Customer#", "").alias("bare"))


@query("SELECT o_orderkey, try_strptime(printf('%04d-%02d-%02d %02d:%02d', 1990 + o_orderkey % 40, 1 + o_orderkey % 13, 1 + o_custkey % 31, o_orderkey % 24, o_custkey % 60), '%Y-%m-%d %H:%M') AS ts FROM orders")
def timestamp_parts(spark, d) -> DataFrame:
    """Instants from calendar parts; parts that name no instant (a 13th month, the 31st of April) give null."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, d, "orders").select("o_orderkey", C.from_parts(1990 + k % 40, 1 + k % 13, 1 + c % 31, k % 24, c % 60).alias("ts"))


@query(f"WITH {OBS} SELECT event_id, ghi, CASE WHEN k13 > 9 THEN raw END AS late FROM obs WHERE ghi IS NOT NULL OR k13 > 9")
def rows_with_any(spark, d) -> DataFrame:
    """Rows that have a value in any column; those that are null in all go."""
    o = observations(spark, d).withColumn("late", F.when(F.col("k13") > 9, F.col("raw")))
    return o.filter(C.any_value(["ghi", "late"])).select("event_id", "ghi", "late")


@query(f"""WITH {OBS}, g AS (SELECT loc, ts, lag(ts) OVER (PARTITION BY loc ORDER BY ts, event_id) AS before FROM obs WHERE value > 2e1 OR loc = 'click'),
f AS (SELECT loc, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (epoch_us(ts) - epoch_us(before) > 90 * 60000000::BIGINT) AS n_gaps FROM g GROUP BY loc)
SELECT *, (SELECT count(DISTINCT first_ts) FROM f) AS starts, (SELECT count(DISTINCT last_ts) FROM f) AS ends, count(*) OVER (PARTITION BY first_ts) AS same_start, (SELECT count(*) FROM f WHERE n_gaps > 0) AS gappy FROM f""")
def feed_audit(spark, d) -> DataFrame:
    """Feeds side by side: rows, range, gaps over 90 minutes, and whether they start and end together."""
    o = observations(spark, d).filter("value > 20 OR loc = 'click'")
    return audit.feed_audit(o, "loc", ["ts", "event_id"], 90)


SNAPPED = "(VALUES (1, TIMESTAMP '2024-01-10 12:07:00'), (2, TIMESTAMP '2024-01-15 11:40:00'), (3, TIMESTAMP '2024-01-21 13:00:00')) asked(id, wanted)"


@query(f"""WITH {OBS}, {PLACES}, {STATIONS},
bins AS (SELECT loc, time_bucket(INTERVAL 6 HOURS, ts) AS ts, avg(value) AS value FROM obs GROUP BY ALL),
snapped AS (SELECT asked.id AS moment, min(struct_pack(gap := abs(epoch_us(ts) - epoch_us(wanted)), ts := ts)).ts AS ts FROM {SNAPPED}, (SELECT DISTINCT ts FROM bins) b GROUP BY ALL),
nearest AS (SELECT t.id AS target, min(struct_pack(km := {KM}, source := s.id)).source AS loc FROM targets t CROSS JOIN stations s GROUP BY t.id),
both_ AS (SELECT moment, ts, value AS copy, value * (1e0 + (target % 17) / 1e2) AS model FROM nearest JOIN bins USING (loc) JOIN snapped USING (ts))
SELECT moment, ts, round(avg(model), 5) AS model_mean, round(stddev_pop(model), 5) AS model_spread, count(DISTINCT round(model, 1)) AS model_distinct, count(model) AS model_n,
round(avg(copy), 5) AS copy_mean, round(stddev_pop(copy), 5) AS copy_spread, count(DISTINCT round(copy, 1)) AS copy_distinct, count(copy) AS copy_n FROM both_ GROUP BY ALL""")
def diversity_vs_copy(spark, d) -> DataFrame:
    """At given moments, snapped to the field's instants: how varied a modelled field is against nearest-station copies."""
    o = observations(spark, d)
    bins = o.groupBy("loc", A.bin_start(F.col("ts"), 360).alias("ts")).agg(F.avg("value").alias("value"))
    asked = spark.createDataFrame([(1, "2024-01-10 12:07:00"), (2, "2024-01-15 11:40:00"), (3, "2024-01-21 13:00:00")], "id int, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    snapped = A.nearest_instant(asked, bins, 360).select(F.col("id").alias("moment"), F.col("near").alias("ts"))
    near = spatial.nearest(places(spark, d, "customer"), _stations(o)).select("target", F.col("source").alias("loc"))
    wanted = bins.join(quantiles.bounded(snapped), "ts")  # as many moments as are asked for
    both = near.join(wanted, "loc").select("moment", "ts", F.col("value").alias("copy"), (F.col("value") * (F.lit(1.0) + (F.col("target") % 17) / F.lit(100.0))).alias("model"))
    table = audit.diversity(both, ["moment", "ts"], ["model", "copy"])
    return table.withColumns({f"{v}_{m}": F.round(f"{v}_{m}", 5) for v in ("model", "copy") for m in ("mean", "spread")})


@query(f"WITH {OBS}, m AS (SELECT user_id, median(value) AS typical FROM obs GROUP BY user_id) SELECT event_id, CASE WHEN typical > 5e1 THEN value * 0.1e0 ELSE value END AS value FROM obs JOIN m USING (user_id)")
def unit_repair(spark, d) -> DataFrame:
    return scaling.rescale_by_median(observations(spark, d), ["user_id"], "value", 50, 0.1).select("event_id", "value")


@query(f"WITH {OBS}, m AS (SELECT user_id, quantile_cont(value, 0.99) AS top FROM obs GROUP BY user_id) SELECT event_id, round(CASE WHEN top > 2e2 THEN value / top ELSE value END, 7) AS value FROM obs JOIN m USING (user_id)")
def share_of_top(spark, d) -> DataFrame:
    return scaling.rescale_by_percentile(observations(spark, d), ["user_id"], "value", 200).select("event_id", F.round("value", 7).alias("value"))


@query(f"""WITH {OBS}, r AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY loc ORDER BY ts, event_id) > count(*) OVER (PARTITION BY loc) - greatest(1, floor(0.2e0 * count(*) OVER (PARTITION BY loc))) THEN 'val' ELSE 'train' END AS role FROM obs),
every AS (SELECT *, unnest(range(CASE WHEN role = 'train' AND value > 4.25e2 THEN 4 ELSE 1 END)) AS copy FROM r),
m AS (SELECT avg(raw) AS m0, stddev_pop(raw) AS s0, avg(bg) AS m1, stddev_pop(bg) AS s1 FROM every WHERE role = 'train')
SELECT event_id, copy, role, round((raw - m0) / s0, 6) AS x0, round((bg - m1) / s1, 6) AS x1 FROM every CROSS JOIN m""")
def scaled_features(spark, d) -> DataFrame:
    """Moments count oversampled training rows as often as they stand there."""
    o = O.tail_split(observations(spark, d), ["loc"], ["ts", "event_id"])
    copies = F.sequence(F.lit(0).cast("long"), F.when((F.col("role") == "train") & (F.col("value") > 425), F.lit(3).cast("long")).otherwise(F.lit(0).cast("long")))
    every = o.withColumn("copy", F.explode(copies)).withColumn("x", F.array("raw", "bg"))
    out = scaling.standardised(every, "x", F.col("role") == "train", 2)
    return out.select("event_id", "copy", "role", F.round(F.get("x", F.lit(0)), 6).alias("x0"), F.round(F.get("x", F.lit(1)), 6).alias("x1"))


@query(f"""WITH {OBS}, r AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY loc ORDER BY ts, event_id) > count(*) OVER (PARTITION BY loc) - greatest(1, floor(0.2e0 * count(*) OVER (PARTITION BY loc))) THEN 'val' ELSE 'train' END AS role FROM obs),
m AS (SELECT avg(raw) AS m1, stddev_pop(raw) AS s1, avg(bg) AS m2, stddev_pop(bg) AS s2 FROM r WHERE role = 'train')
SELECT event_id, k13 / 13e0 AS x0, round((raw - m1) / s1, 6) AS x1, round((bg - m2) / s2, 6) AS x2 FROM r CROSS JOIN m""")
def scaled_covariates(spark, d) -> DataFrame:
    """Basis values first, which stay as they are; only the covariates behind them are standardised."""
    o = O.tail_split(observations(spark, d), ["loc"], ["ts", "event_id"]).withColumn("x", F.array(F.col("k13") / 13.0, "raw", "bg"))
    at = lambda i: F.get("x", F.lit(i))
    return scaling.standardised(o, "x", F.col("role") == "train", 3, first=1).select("event_id", at(0).alias("x0"), F.round(at(1), 6).alias("x1"), F.round(at(2), 6).alias("x2"))


NORMED = {"cos_zenith": "raw", "temperature": "k13", "humidity": "value", "pressure": "event_id % 7", "water": "event_id % 5", "cloud": "event_id % 3", "elevation": "user_id"}


@query(f"""WITH {OBS}, c AS (
  SELECT *, bg - lag(bg) OVER w AS bg_change, lag(clear) OVER w AS bt_lag, clear / greatest(max(clear) OVER (PARTITION BY loc, {DAY}), 1e0) AS clear_share FROM obs WINDOW w AS (PARTITION BY loc ORDER BY ts, event_id))
SELECT event_id, 18 AS n, bg AS first, bg_change, bt_lag, clear_share, round((raw - 0e0) / 1e0, 9) AS cos_zenith, round((k13 - 15e0) / 20e0, 9) AS temperature, round((value - 70e0) / 30e0, 9) AS humidity,
round((event_id % 7 - 990e0) / 20e0, 9) AS pressure, round((event_id % 5 - 1e0) / 1e0, 9) AS water, round((event_id % 3 - 6e0) / 6e0, 9) AS cloud, round((user_id - 300e0) / 100e0, 9) AS elevation,
round(sin(2e0 * pi() * dayofyear(ts) / 365e0), 9) AS doy_sin, round(cos(2e0 * pi() * (hour(ts) + minute(ts) / 60e0) / 24e0), 9) + 0e0 AS last FROM c""")
def covariate_rows(spark, d) -> DataFrame:
    """The ordered covariates as one array a row, read back by place; the weather ones are normalised."""
    o = observations(spark, d).withColumns({"bg_csi": F.col("bg"), "bt": F.col("clear"), **{c: F.expr(e) for c, e in NORMED.items()}})
    rows = folds.covariates(o, ["loc"], ["ts", "event_id"], F.col("ts"))
    at = lambda name: F.get("covariates", F.lit(folds.COVARIATES.index(name)))
    return rows.select(
        "event_id", F.size("covariates").alias("n"), at("bg_csi").alias("first"), at("bg_change").alias("bg_change"), at("bt_lag").alias("bt_lag"), at("clear_share").alias("clear_share"),
        *[F.round(at(c), 9).alias(c) for c in NORMED], F.round(at("doy_sin"), 9).alias("doy_sin"), F.round(at("hour_cos"), 9).alias("last"),
    )


@query(f"""WITH {PLACES}, {PIXELS.format('targets')}, features AS (SELECT py, px, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM pix JOIN customer ON id = c_custkey GROUP BY ALL HAVING count(*) > 1)
SELECT id, py, px, n, total FROM pix JOIN features USING (py, px)""")
def pixel_fanout(spark, d) -> DataFrame:
    """Features are built once per pixel that several places share, and then handed to its places."""
    pix = spatial.pixels(places(spark, d, "customer")).select("id", "py", "px")
    values = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    features = pix.join(values, "id").groupBy("py", "px").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")).filter("n > 1")
    return pix.join(features, ["py", "px"]).select("id", "py", "px", "n", "total")


@query(f"WITH {PLACES}, {PIXELS.format('targets')}, other AS (SELECT DISTINCT CAST(round_even(lat / (2e0 / 111e0), 0) AS BIGINT) AS py, CAST(round_even(lon / (2e0 / 75.8e0), 0) AS BIGINT) AS px FROM sources) SELECT py, px FROM pix UNION SELECT py, px FROM other")
def pixels_union(spark, d) -> DataFrame:
    of = lambda name: spatial.pixels(places(spark, d, name)).select("py", "px")
    return of("customer").unionByName(of("supplier")).distinct()


@query("SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS ts FROM events WHERE event_type = 'click' INTERSECT SELECT time_bucket(INTERVAL 30 MINUTES, ts) FROM events WHERE event_type = 'view'")
def common_instants(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    of = lambda kind: e.filter(F.col("event_type") == kind).select(A.bin_start(F.col("ts"), 30).alias("ts"))
    return of("click").intersect(of("view"))


@query("SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS ts FROM events WHERE event_type = 'click' EXCEPT ALL SELECT time_bucket(INTERVAL 30 MINUTES, ts) FROM events WHERE event_type = 'view'")
def leftover_instants(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    of = lambda kind: e.filter(F.col("event_type") == kind).select(A.bin_start(F.col("ts"), 30).alias("ts"))
    return of("click").exceptAll(of("view"))


@query(f"{STACK} SELECT loc, method, regime, {_errors('truth', 'guess')} FROM stacked GROUP BY GROUPING SETS ((loc, method), (method, regime), (method))")
def bench_sets(spark, d) -> DataFrame:
    """Estimators per location, per regime and pooled, in one pass."""
    stacked = audit.stack_methods(_labelled(spark, d), _methods(), ["loc", "regime", "truth"])
    return _rounded(metrics.error_sets(stacked, [["loc", "method"], ["method", "regime"], ["method"]]))


@query("SELECT event_id, CAST((1 + user_id % 7) * (2 + event_id % 5) + (2 + event_id % 5) + (2 + event_id % 5) + 1 AS INTEGER) AS parameters FROM events")
def parameter_counts(spark, d) -> DataFrame:
    """Weights of perceptrons with one hidden layer, from their layer sizes."""
    sizes = F.array((1 + F.col("user_id") % 7).cast("int"), (2 + F.col("event_id") % 5).cast("int"), F.lit(1))
    return read(spark, d, "events").select("event_id", mlp.parameters(sizes).alias("parameters"))
