"""Queries on space, metrics, sweeps and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import align, audit, folds, metrics, ordered, quantiles, scaling, spatial
from ..sources import arrays
from ..sources.staging import durable, scratch
from .registry import KM, OBS, PLACES, observations, places, query, read

MET = f"met AS (SELECT t.id AS target, s.id AS source, {KM} AS km FROM targets t CROSS JOIN sources s)"
OWN = f"met AS (SELECT t.id AS target, s.id AS source, {KM} AS km FROM sources t JOIN sources s ON t.id <> s.id)"
DAY = "CAST(ts AS DATE)"


@query(f"WITH {PLACES}, {MET}, best AS (SELECT target, min(struct_pack(km := km, source := source)) AS b FROM met GROUP BY target) SELECT target, b.source AS source, b.km AS km FROM best")
def nearest_source(spark, d) -> DataFrame:
    return spatial.nearest(places(spark, d, "customer"), places(spark, d, "supplier"))


@query(f"""WITH {PLACES}, {MET}, b AS (SELECT *, min(struct_pack(km := km, source := source)) OVER (PARTITION BY target) AS best FROM met),
r AS (SELECT *, CASE WHEN best.km < 1e-3 THEN CASE WHEN source = best.source THEN 1e0 ELSE 0e0 END ELSE 1e0 / (km * km) END AS raw FROM b),
w AS (SELECT target, source, raw / sum(raw) OVER (PARTITION BY target) AS weight FROM r)
SELECT target, round(sum(weight * s_acctbal), 5) AS value FROM w JOIN supplier ON source = s_suppkey GROUP BY target""")
def idw_p2(spark, d) -> DataFrame:
    values = read(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_acctbal").alias("value"))
    return spatial.inverse_distance(places(spark, d, "customer"), places(spark, d, "supplier"), values).withColumn("value", F.round("value", 5))


@query(f"""WITH {PLACES}, {OWN}, w AS (SELECT target, source, (1e0 / km) / sum(1e0 / km) OVER (PARTITION BY target) AS weight FROM met)
SELECT target, round(sum(weight * s_acctbal), 5) AS value FROM w JOIN supplier ON source = s_suppkey GROUP BY target""")
def idw_p1_exclude_self(spark, d) -> DataFrame:
    """Distances of coincident places would divide by zero; these have none."""
    own = places(spark, d, "supplier")
    values = read(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_acctbal").alias("value"))
    return spatial.inverse_distance(own, own, values, 1.0, None, exclude_self=True).withColumn("value", F.round("value", 5))


LAT, LON = (46.56, 46.82), (-119.29, -119.05)
KNOTS = """
levels(level, spacing) AS (VALUES (0, 10e0), (1, 5e0), (2, 2.5e0), (3, 1.5e0)),
sized AS (
  SELECT *, spacing / 111e0 AS sy, spacing / 75.8e0 AS sx, CAST(ceil((46.82e0 - 46.56e0 + spacing / 111e0 / 2) / (spacing / 111e0)) AS BIGINT) AS ny,
         CAST(ceil((-119.05e0 + 119.29e0 + spacing / 75.8e0 / 2) / (spacing / 75.8e0)) AS BIGINT) AS nx FROM levels),
numbered AS (SELECT *, unnest(range(ny * nx)) AS knot FROM sized),
knots AS (SELECT level, knot, 46.56e0 + CAST(knot // nx AS DOUBLE) * sy AS lat, -119.29e0 + CAST(knot % nx AS DOUBLE) * sx AS lon, 2.5e0 * spacing AS support FROM numbered)"""


@query(f"WITH {KNOTS} SELECT level, count(*) AS n FROM knots GROUP BY level")
def knot_counts(spark, d) -> DataFrame:
    return spatial.knots(spark, LAT, LON).groupBy("level").agg(F.count("*").alias("n"))


PHI = f"""
dist AS (SELECT t.id AS target, s.level, s.knot, {KM} / s.support AS d FROM targets t CROSS JOIN knots s),
phi AS (SELECT target, level, knot, (1e0 - d) * (1e0 - d) * (1e0 - d) * (1e0 - d) * (1e0 - d) * (1e0 - d) * (35e0 * d * d + 18e0 * d + 3e0) / 3e0 AS phi FROM dist WHERE d < 1e0)"""


@query(f"WITH {PLACES}, {KNOTS}, {PHI} SELECT level, target, count(*) AS n, round(sum(phi), 8) AS total, round(max(phi), 8) AS top FROM phi WHERE phi > 0 GROUP BY ALL")
def wendland_basis(spark, d) -> DataFrame:
    phi = spatial.basis(places(spark, d, "customer"), spatial.knots(spark, LAT, LON))
    return phi.groupBy("level", "target").agg(F.count("*").alias("n"), F.round(F.sum("phi"), 8).alias("total"), F.round(F.max("phi"), 8).alias("top"))


@query(f"""WITH {PLACES}, {KNOTS}, {PHI.replace("targets t", "sources t")},
mask AS (SELECT level, knot FROM phi GROUP BY ALL HAVING max(abs(phi)) > 1e-6)
SELECT level, count(knots.knot) AS total, count(mask.knot) AS kept FROM knots LEFT JOIN mask USING (level, knot) GROUP BY level""")
def active_mask(spark, d) -> DataFrame:
    knots = spatial.knots(spark, LAT, LON)
    mask = spatial.active(spatial.basis(places(spark, d, "supplier"), knots)).withColumn("kept", F.lit(1))
    return knots.join(mask, ["level", "knot"], "left").groupBy("level").agg(F.count("*").alias("total"), F.count("kept").alias("kept"))


@query(f"""WITH {PLACES}, {KNOTS}, {PHI}, seen AS (SELECT DISTINCT s.level, s.knot FROM sources t JOIN knots s ON {KM} / s.support < 0.99e0)
SELECT target, count(*) AS n FROM phi SEMI JOIN seen USING (level, knot) WHERE phi > 0 GROUP BY target""")
def masked_basis(spark, d) -> DataFrame:
    knots = spatial.knots(spark, LAT, LON)
    t = places(spark, d, "supplier")
    seen = spatial.basis(t, knots)
    near = seen.filter(F.col("phi") > C.wendland(F.lit(0.99), 1.0)).select("level", "knot").distinct()
    return spatial.masked(spatial.basis(places(spark, d, "customer"), knots), near).groupBy("target").agg(F.count("*").alias("n"))


PIXELS = "pix AS (SELECT id, CAST(round_even(lat / (2e0 / 111e0), 0) AS BIGINT) AS py, CAST(round_even(lon / (2e0 / 75.8e0), 0) AS BIGINT) AS px FROM {0})"


@query(f"WITH {PLACES}, {PIXELS.format('targets')} SELECT * FROM pix")
def pixel_snap(spark, d) -> DataFrame:
    return spatial.pixels(places(spark, d, "customer")).select("id", "py", "px")


@query(f"""WITH {PLACES}, {PIXELS.format('targets')}, own AS (SELECT py, px, count(*) AS n FROM pix GROUP BY ALL),
beside AS (SELECT DISTINCT py + dy AS py, px + dx AS px FROM own, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dy, dx)),
allp AS (SELECT py, px FROM own UNION SELECT py, px FROM beside)
SELECT allp.py, allp.px, coalesce(n, 0) AS n_locations, CAST(row_number() OVER (ORDER BY allp.py, allp.px) - 1 AS INTEGER) AS pixel_index FROM allp LEFT JOIN own USING (py, px)""")
def neighbor_expand(spark, d) -> DataFrame:
    """All pixels with places and those beside them, numbered by place."""
    own = spatial.pixels(places(spark, d, "customer")).groupBy("py", "px").agg(F.count("*").alias("n"))
    beside = spatial.neighbours(own).select(F.col("ny").alias("py"), F.col("nx").alias("px"))
    every = own.select("py", "px").unionByName(beside).distinct().join(own, ["py", "px"], "left")
    every = every.select("py", "px", F.coalesce("n", F.lit(0)).cast("long").alias("n_locations"))
    return ordered.dense_index(every, ["py", "px"], "pixel_index").withColumn("pixel_index", F.col("pixel_index").cast("int"))


@query("""WITH own AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
vectors AS (SELECT id, v FROM own UNION ALL SELECT id + 1000000000, list_concat([v[1] + 5e-5], v[2:]) FROM own),
met AS (
  SELECT a.id AS a, b.id AS b, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance
  FROM vectors a JOIN vectors b ON a.id < b.id AND abs(a.v[1] - b.v[1]) < 1e-4)
SELECT a, b, round(distance, 8) AS distance FROM met WHERE distance < 1e-4""")
def near_duplicates(spark, d) -> DataFrame:
    """Vectors and a shifted copy of each: the pairs closer than 1e-4."""
    own = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    moved = own.select((F.col("id") + 1_000_000_000).alias("id"), F.concat(F.array(F.get("v", F.lit(0)) + F.lit(5e-5)), F.slice("v", 2, 1_000_000)).alias("v"))
    return spatial.near_duplicate_vectors(own.unionByName(moved), 1e-4, 1e-4).withColumn("distance", F.round("distance", 8))


@query("""SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE) * CAST(CAST(x AS FLOAT) AS DOUBLE)))), 5) AS norm, len(embedding) AS width FROM embeddings""")
def array_norms(spark, d) -> DataFrame:
    """Vectors written as array files, ids as a second array, and read again row by row."""
    spark.dataSource.register(arrays.NpySource)
    folder = scratch(spark, "arrays")
    # both arrays are written from the same rows in the same order
    rows = durable(read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("x")))
    for name, x in (("vectors", F.col("x")), ("ids", F.col("vec_id").cast("long"))):
        rows.select(x.alias("x")).write.format("npy").mode("append").save(f"{folder}/{name}")
    back = lambda name: spark.read.format("npy").load(f"{folder}/{name}")
    met = back("vectors").join(back("ids").withColumnRenamed("x", "id"), "row")
    square = F.aggregate("x", C.num(0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return met.select("id", F.round(F.sqrt(square), 5).alias("norm"), F.size("x").cast("long").alias("width"))


REGIME = "CASE WHEN spread < 0.1e0 THEN 'clear' WHEN spread < 0.2e0 THEN 'cloudy_smooth' WHEN spread IS NOT NULL THEN 'broken_cloud' END"


@query(f"WITH {OBS}, days AS (SELECT user_id, {DAY} AS day, stddev_samp(raw) AS spread FROM obs GROUP BY ALL) SELECT user_id, day, round(spread, 9) AS spread, {REGIME} AS regime FROM days")
def day_regime(spark, d) -> DataFrame:
    return metrics.day_regimes(observations(spark, d), ["user_id"], "raw", F.to_date("ts")).withColumn("spread", F.round("spread", 9))


FACTORS = """
ratios AS (SELECT CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) AS INTEGER) AS hour, median(value / clear) AS ratio FROM obs WHERE value >= 5e1 AND clear >= 5e1 GROUP BY ALL),
factors AS (SELECT month, hour, CASE WHEN hour BETWEEN 9 AND 15 THEN least(greatest(ratio, 0.5e0), 1.5e0) ELSE 1e0 END AS factor FROM ratios)"""


@query(f"WITH {OBS}, {FACTORS} SELECT * FROM factors")
def month_hour_factor(spark, d) -> DataFrame:
    return metrics.factors(observations(spark, d), F.month("ts"), F.hour("ts"), "value", "clear")


@query(f"WITH {OBS}, {FACTORS} SELECT event_id, clear * coalesce(factor, 1e0) AS corrected FROM obs LEFT JOIN factors ON month(ts) = factors.month AND hour(ts) = factors.hour")
def apply_factor(spark, d) -> DataFrame:
    o = observations(spark, d)
    table = metrics.factors(o, F.month("ts"), F.hour("ts"), "value", "clear")
    return align.lookup(o.withColumns({"month": F.month("ts"), "hour": F.hour("ts")}), table, ["month", "hour"], "factor", 1.0).select("event_id", (F.col("clear") * F.col("factor")).alias("corrected"))


def _errors(y: str, g: str) -> str:
    pair = f"FILTER ({y} IS NOT NULL AND {g} IS NOT NULL)"
    n = f"count(*) {pair}"
    return f"""CASE WHEN {n} >= 2 THEN round(sqrt(avg(({g} - {y}) * ({g} - {y})) {pair}), 5) END AS rmse, CASE WHEN {n} >= 2 THEN round(avg(abs({g} - {y})) {pair}, 5) END AS mae,
CASE WHEN {n} >= 2 AND var_pop({y}) {pair} > 0 THEN round(1e0 - sum(({g} - {y}) * ({g} - {y})) {pair} / (var_pop({y}) {pair} * {n}), 5) END AS r2,
CASE WHEN {n} >= 2 THEN round(avg({g} - {y}) {pair}, 5) END AS bias, {n} AS n"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 5) for c in ("rmse", "mae", "r2", "bias")})


@query(f"WITH {OBS} SELECT loc, {_errors('ghi', 'clear')} FROM obs GROUP BY loc")
def error_metrics(spark, d) -> DataFrame:
    return _rounded(metrics.error_table(observations(spark, d), ["loc"], "ghi", "clear"))


@query(f"WITH {OBS} SELECT loc, {_errors('ghi', 'clear')} FROM obs GROUP BY GROUPING SETS ((loc), ())")
def metrics_grouping_sets(spark, d) -> DataFrame:
    return _rounded(metrics.error_sets(observations(spark, d), [["loc"], []], "ghi", "clear"))


@query(f"""WITH {OBS}, r AS (SELECT * FROM obs WHERE ghi IS NOT NULL), q AS (SELECT loc, quantile_cont(ghi, 0.9) AS edge FROM r GROUP BY loc)
SELECT loc, CASE WHEN count(*) > 1 THEN round(sqrt(avg((clear - ghi) * (clear - ghi))), 5) END AS peak_rmse FROM r JOIN q USING (loc) WHERE ghi >= edge GROUP BY loc""")
def peak_rmse(spark, d) -> DataFrame:
    return metrics.peak_rmse(observations(spark, d), ["loc"], "ghi", "clear").withColumn("peak_rmse", F.round("peak_rmse", 5))


@query(f"""WITH {OBS}, r AS (SELECT loc, (clear - lag(clear) OVER w) - (ghi - lag(ghi) OVER w) AS e FROM obs WHERE ghi IS NOT NULL WINDOW w AS (PARTITION BY loc ORDER BY ts, event_id))
SELECT loc, round(sqrt(avg(e * e)), 5) AS ramp_rmse FROM r GROUP BY loc""")
def ramp_rmse(spark, d) -> DataFrame:
    return metrics.ramp_rmse(observations(spark, d), ["loc"], ["ts", "event_id"], "ghi", "clear").withColumn("ramp_rmse", F.round("ramp_rmse", 5))


def _methods() -> dict:
    night = F.col("clear") >= 50
    return {
        "background": F.when(night, C.clip(F.col("bg"), 0.0, 1.3) * F.col("clear")),
        "model": F.when(night, C.tier_cap(F.col("raw"), F.col("clear")) * F.col("clear")),
        "persistence": F.when(F.col("event_id") % 5 != 0, F.col("value")),
    }


STACK = f"""
WITH {OBS}, regimes AS (SELECT loc, {DAY} AS day, stddev_samp(raw) AS spread FROM obs GROUP BY ALL),
labelled AS (SELECT obs.*, {REGIME.replace("0.1e0", "0.5e0").replace("0.2e0", "0.56e0")} AS regime FROM obs JOIN regimes ON obs.loc = regimes.loc AND {DAY} = regimes.day),
stacked AS (
  SELECT loc, regime, ghi AS truth, 'background' AS method, CASE WHEN clear >= 5e1 THEN least(greatest(bg, 0e0), 1.3e0) * clear END AS guess FROM labelled
  UNION ALL SELECT loc, regime, ghi, 'model', CASE WHEN clear >= 5e1 THEN greatest(least(raw, CASE WHEN clear < 1e2 THEN 0.85e0 WHEN clear < 2e2 THEN 0.9e0 WHEN clear < 3.5e2 THEN 0.95e0 ELSE 1.3e0 END), 0e0) * clear END FROM labelled
  UNION ALL SELECT loc, regime, ghi, 'persistence', CASE WHEN event_id % 5 <> 0 THEN value END FROM labelled)"""


def _labelled(spark, d) -> DataFrame:
    o = observations(spark, d).withColumn("day", F.to_date("ts"))
    spread = o.groupBy("loc", "day").agg(F.stddev_samp("raw").alias("spread"))
    regime = F.when(F.col("spread") < C.num(0.5), "clear").when(F.col("spread") < C.num(0.56), "cloudy_smooth").when(F.col("spread").isNotNull(), "broken_cloud")
    return o.join(spread, ["loc", "day"]).withColumn("regime", regime).withColumn("truth", F.col("ghi"))


@query(f"{STACK} SELECT loc, method, regime, {_errors('truth', 'guess')} FROM stacked GROUP BY ALL")
def bench_methods(spark, d) -> DataFrame:
    """Estimators side by side, by location and day regime: one aggregation over the stacked rows."""
    return _rounded(audit.benchmark(_labelled(spark, d), _methods(), ["loc", "regime"]))


@query(f"""{STACK}, table_ AS (SELECT loc, method, {_errors('truth', 'guess')} FROM stacked GROUP BY ALL)
SELECT method, round(avg(rmse), 3) AS rmse, round(avg(bias), 3) AS bias, CASE method WHEN 'persistence' THEN 1 WHEN 'background' THEN 2 ELSE 3 END AS rank FROM table_ GROUP BY method""")
def method_rollup(spark, d) -> DataFrame:
    table = _rounded(audit.benchmark(_labelled(spark, d), _methods(), ["loc"]))
    return audit.roll_up(table, ["rmse", "bias"], ["persistence", "background", "model"])


@query(f"""{STACK}, table_ AS (SELECT method, regime, {_errors('truth', 'guess')} FROM stacked GROUP BY ALL)
SELECT method, max(rmse) FILTER (regime = 'clear') AS clear, max(rmse) FILTER (regime = 'cloudy_smooth') AS cloudy_smooth, max(rmse) FILTER (regime = 'broken_cloud') AS broken_cloud FROM table_ GROUP BY method""")
def method_regime_pivot(spark, d) -> DataFrame:
    table = _rounded(audit.benchmark(_labelled(spark, d), _methods(), ["regime"]))
    return table.groupBy("method").pivot("regime", list(metrics.REGIMES)).agg(F.max("rmse"))


THRESHOLDS, ALPHAS, LEAD = (200, 250, 300, 350, 400), (0.25, 0.5, 0.75, 1.0), "view"
# the rule of a sweep, as SQL: below the threshold the index is replaced, everything is held within [0, 1.3]
SWEEP = f"""
WITH {OBS}, regimes AS (SELECT loc, {DAY} AS day, stddev_samp(raw) AS spread FROM obs GROUP BY ALL),
rows_ AS (
  SELECT obs.loc, clear, value AS truth, 1e0 - raw AS raw_, bg, greatest(least(bg, 1.3e0), 0e0) AS final, CAST(hour(ts) AS INTEGER) AS hour,
         {REGIME.replace("0.1e0", "0.5e0").replace("0.2e0", "0.56e0")} AS regime FROM obs JOIN regimes ON obs.loc = regimes.loc AND {DAY} = regimes.day),
swept AS (
  SELECT loc, regime, hour, threshold, alpha,
         (least(greatest(CASE WHEN clear < threshold THEN alpha * raw_ + (1e0 - alpha) * least(greatest(bg, 0e0), 1e0) ELSE final END, 0e0), 1.3e0) * clear - truth) AS e
  FROM rows_, (VALUES (2e2), (2.5e2), (3e2), (3.5e2), (4e2)) t(threshold), (VALUES (0.25e0), (0.5e0), (0.75e0), (1e0)) a(alpha)),
table_ AS (
  SELECT threshold, alpha, loc, sqrt(avg(e * e)) AS overall_rmse, sqrt(avg(e * e) FILTER (regime = 'clear')) AS clear_rmse, sqrt(avg(e * e) FILTER (hour BETWEEN 11 AND 13)) AS noon_rmse
  FROM swept GROUP BY ALL),
base AS (
  SELECT loc, sqrt(avg((final * clear - truth) * (final * clear - truth))) AS overall_rmse, sqrt(avg((final * clear - truth) * (final * clear - truth)) FILTER (regime = 'clear')) AS clear_rmse,
         sqrt(avg((final * clear - truth) * (final * clear - truth)) FILTER (hour BETWEEN 11 AND 13)) AS noon_rmse FROM rows_ GROUP BY loc),
judged AS (
  SELECT threshold, alpha, avg(t.overall_rmse) AS pooled_overall_rmse, avg(t.clear_rmse) AS pooled_clear_rmse, avg(t.noon_rmse) AS pooled_noon_rmse,
         max(t.overall_rmse) FILTER (loc = '{LEAD}') AS lead_overall_rmse, max(t.clear_rmse) FILTER (loc = '{LEAD}') AS lead_clear_rmse, max(t.noon_rmse) FILTER (loc = '{LEAD}') AS lead_noon_rmse,
         max(t.overall_rmse - b.overall_rmse) FILTER (loc <> '{LEAD}') AS max_other_overall_delta,
         max(t.clear_rmse - b.clear_rmse) FILTER (loc = '{LEAD}') AS lead_clear_delta, max(t.noon_rmse - b.noon_rmse) FILTER (loc = '{LEAD}') AS lead_noon_delta
  FROM table_ t JOIN base b USING (loc) GROUP BY ALL),
ruled AS (SELECT *, coalesce(lead_clear_delta < 0 AND lead_noon_delta <= 1 AND max_other_overall_delta <= 1, false) AS passes FROM judged)"""


def _sweep(spark, d) -> tuple[DataFrame, DataFrame]:
    """Sensor rows as a sweep takes them, and its table."""
    o = _labelled(spark, d)
    final = C.clip(F.col("bg"), 0.0, 1.3)
    rows = o.select("loc", "regime", "clear", F.col("value").alias("truth"), (F.lit(1.0) - F.col("raw")).alias("raw"), "bg", final.alias("final"), F.hour("ts").alias("hour"), (final * F.col("clear")).alias("guess"))
    return rows, metrics.blend_sweep(rows, THRESHOLDS, ALPHAS)


@query(f"{SWEEP} SELECT threshold, alpha, loc, round(overall_rmse, 5) AS overall_rmse, round(clear_rmse, 5) AS clear_rmse, round(noon_rmse, 5) AS noon_rmse FROM table_")
def blend_sweep(spark, d) -> DataFrame:
    return _sweep(spark, d)[1].withColumns({c: F.round(c, 5) for c in ("overall_rmse", "clear_rmse", "noon_rmse")})


SWEPT = ("pooled_overall_rmse", "pooled_clear_rmse", "pooled_noon_rmse", "lead_overall_rmse", "lead_clear_rmse", "lead_noon_rmse", "max_other_overall_delta", "lead_clear_delta", "lead_noon_delta")


@query(f"{SWEEP} SELECT threshold, alpha, {', '.join(f'round({c}, 5) + 0e0 AS {c}' for c in SWEPT)}, passes FROM ruled")
def sweep_accepted(spark, d) -> DataFrame:
    """Every pair of parameters against the rule of three: the lead's clear days improve, its noon and the others hardly suffer."""
    rows, table = _sweep(spark, d)
    return scaling.accept(table, metrics.sweep_base(rows), LEAD).withColumns({c: F.round(c, 5) + F.lit(0.0) for c in SWEPT})


@query(f"{SWEEP}, placed AS (SELECT *, CAST(row_number() OVER (ORDER BY lead_clear_delta, threshold, alpha) AS INTEGER) AS place FROM ruled WHERE passes) SELECT place, threshold, alpha, round(lead_clear_delta, 5) AS lead_clear_delta FROM placed")
def passing_sweep(spark, d) -> DataFrame:
    """The pairs of parameters that pass, the best first."""
    rows, table = _sweep(spark, d)
    return scaling.passing(scaling.accept(table, metrics.sweep_base(rows), LEAD)).select("place", "threshold", "alpha", F.round("lead_clear_delta", 5).alias("lead_clear_delta"))


@query(f"{SWEEP} SELECT threshold, alpha, round(lead_clear_delta, 5) AS lead_clear_delta FROM ruled WHERE passes ORDER BY ruled.lead_clear_delta, threshold, alpha LIMIT 1")
def best_passing(spark, d) -> DataFrame:
    """The passing pair of parameters with the largest fall of the lead's clear-day error."""
    return passing_sweep(spark, d).filter("place = 1").drop("place")


@query("SELECT event_type AS loc, round(quantile_cont(value, 0.03), 6) AS p3, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentiles(spark, d) -> DataFrame:
    table = metrics.percentiles(observations(spark, d), ["loc"], "value", [0.03, 0.1, 0.5, 0.9, 0.99])
    return table.select("loc", *[F.round(c, 6).alias(c) for c in table.columns[1:]])


@query("""SELECT loc, share, n, true AS within FROM (SELECT event_type AS loc, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) g, (VALUES (0.1e0), (0.5e0), (0.9e0), (0.99e0)) s(share)""")
def percentiles_approx(spark, d) -> DataFrame:
    """Percentiles from sketches by location and day, merged over days; each is within a hundredth of its rank by exact counts."""
    o = observations(spark, d)
    by_day = quantiles.sketches(o.withColumn("day", F.to_date("ts")), ["loc", "day"], "value")
    guesses = quantiles.sketched(quantiles.merged(by_day, ["loc"]), ["loc"], [0.1, 0.5, 0.9, 0.99])
    return quantiles.rank_errors(o, ["loc"], "value", guesses).select("loc", "share", "n", (F.col("error") <= 0.01).alias("within"))


@query("SELECT CAST(floor(value / 25e0) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def histogram(spark, d) -> DataFrame:
    return metrics.histogram(observations(spark, d), "value", 25)


@query("SELECT event_type AS loc, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, d) -> DataFrame:
    return observations(spark, d).groupBy("loc").agg(F.count("*").alias("n"))


@query(f"WITH {OBS} SELECT {DAY} AS day, round(avg(clear), 5) AS clear_mean, round(stddev_pop(clear), 5) AS clear_spread, count(DISTINCT round(clear, 1)) AS clear_distinct, count(clear) AS clear_n FROM obs GROUP BY 1")
def diversity(spark, d) -> DataFrame:
    table = audit.diversity(observations(spark, d).withColumn("day", F.to_date("ts")), ["day"], ["clear"])
    return table.withColumns({c: F.round(c, 5) for c in ("clear_mean", "clear_spread")})


@query("""SELECT 'value' AS "column", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events UNION ALL SELECT 'user_id', round(avg(user_id), 6), round(stddev_pop(user_id), 6) FROM events""")
def scaler_moments(spark, d) -> DataFrame:
    return metrics.moments(read(spark, d, "events"), ["value", "user_id"]).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(f"WITH {OBS} SELECT loc, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, count(*) FILTER (ghi IS NULL) AS nulls, min(ghi) AS low, max(ghi) AS high, round(avg(ghi), 6) AS mean FROM obs GROUP BY loc")
def source_summary(spark, d) -> DataFrame:
    return audit.source_summary(observations(spark, d), ["loc"], "ghi").withColumn("mean", F.round("mean", 6))


OUT = """flagged AS (SELECT *, floor(value / 15e1) = 0 AND clear > 2e2 AS f FROM obs),
turned AS (SELECT *, CASE WHEN f <> lag(f, 1, false) OVER (PARTITION BY loc ORDER BY ts, event_id) THEN 1 ELSE 0 END AS t FROM flagged),
numbered AS (SELECT *, sum(t) OVER (PARTITION BY loc ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM turned)
SELECT loc, CAST(run AS BIGINT) AS run, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM numbered WHERE f GROUP BY loc, run HAVING count(*) >= 3"""


@query(f"WITH {OBS}, {OUT}")
def outage_runs(spark, d) -> DataFrame:
    """Three or more zeros in a row under a bright sky; the sensor counts in steps of 150, so that synthetic values give zeros."""
    o = observations(spark, d)
    return audit.zero_runs(o, ["loc"], F.floor(F.col("value") / 150.0).cast("double"), F.col("clear"), ["ts", "event_id"]).withColumn("run", F.col("run").cast("long"))


@query(f"WITH {OBS} SELECT event_id, loc, round(value / clear, 9) AS ratio FROM obs WHERE clear > 5 AND value / clear < 0.05e0")
def low_readings(spark, d) -> DataFrame:
    """Sensor rows by day that give less than a twentieth of the clear sky."""
    return audit.low_readings(observations(spark, d), F.col("value"), F.col("clear")).select("event_id", "loc", F.round("ratio", 9).alias("ratio"))


# a field of the five locations every half hour: values with ties broken by a small part of their own
FIELD = """
bins AS (SELECT loc, time_bucket(INTERVAL 30 MINUTES, ts) AS ts, max(value) + max(event_id) / 1e6 AS v FROM obs GROUP BY ALL),
field AS (SELECT ts, avg(v) AS mean, stddev_samp(v) AS spread FROM bins GROUP BY ts),
timed AS (SELECT *, CAST(ts AS DATE) AS day, year(ts) AS year, hour(ts) AS hour FROM field)"""


def _field(spark, d) -> DataFrame:
    bins = observations(spark, d).groupBy("loc", align.bin_start(F.col("ts"), 30).alias("ts")).agg((F.max("value") + F.max("event_id") / F.lit(1e6)).alias("v"))
    return audit.field_stats(bins, "v")


@query(f"""WITH {OBS}, {FIELD},
ends AS (SELECT day, list(ts ORDER BY ts) AS all_ts FROM timed GROUP BY day)
SELECT day, coalesce(min(ts) FILTER (hour = 9), min(ts)) AS morning, arg_max(ts, round(spread, 7)) AS widest, arg_max(ts, round(mean, 7)) AS brightest,
coalesce(arg_max(ts, round(mean, 7)) FILTER (hour BETWEEN 13 AND 15), CASE WHEN len(any_value(all_ts)) >= 4 THEN any_value(all_ts)[-4] END) AS afternoon FROM timed JOIN ends USING (day) GROUP BY day""")
def snapshots(spark, d) -> DataFrame:
    return audit.snapshots(_field(spark, d))


@query(f"""WITH {OBS}, {FIELD}, peak AS (SELECT * FROM timed WHERE hour BETWEEN 9 AND 15),
one AS (
  SELECT year, coalesce(arg_max(ts, mean) FILTER (mean > 450 AND spread < 30), arg_max(ts, mean)) AS clear, arg_max(ts, spread) FILTER (mean > 150 AND mean < 500) AS partly, arg_min(ts, mean) AS lowest
  FROM peak GROUP BY year),
two AS (SELECT peak.year, arg_max(ts, spread) FILTER (mean > 150 AND mean < 500 AND day <> CAST(partly AS DATE)) AS partly_other_day FROM peak JOIN one ON peak.year = one.year GROUP BY peak.year),
dim AS (SELECT year, ts, row_number() OVER (PARTITION BY year ORDER BY mean, ts) AS n FROM peak WHERE mean < 120 AND mean > 5)
SELECT CAST(year AS INTEGER) AS year, clear, partly, partly_other_day, coalesce((SELECT arg_max(ts, n) FROM dim WHERE dim.year = one.year AND n <= 3), lowest) AS overcast FROM one JOIN two USING (year)""")
def sky_picks(spark, d) -> DataFrame:
    """Instants of the year that show a clear, two partly cloudy and an overcast sky."""
    return audit.sky_picks(_field(spark, d))


@query(f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY loc ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY loc) AS n FROM obs),
folds AS (SELECT CAST(row_number() OVER (ORDER BY loc) - 1 AS INTEGER) AS fold_id, loc AS held FROM (SELECT DISTINCT loc FROM obs))
SELECT fold_id, CASE WHEN loc = held THEN 'test' WHEN rn > n - greatest(1, floor(0.2e0 * n)) THEN 'val' ELSE 'train' END AS role, count(*) AS n, sum(event_id) AS ids FROM r CROSS JOIN folds GROUP BY ALL""".replace("sum(event_id)", "CAST(sum(event_id) AS BIGINT)"))
def fold_split(spark, d) -> DataFrame:
    o = observations(spark, d)
    return folds.leave_one_out(o, _folds(o), "loc", ["ts", "event_id"]).groupBy("fold_id", "role").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _folds(o: DataFrame) -> DataFrame:
    return o.select(F.col("loc").alias("held")).distinct().withColumn("fold_id", F.row_number().over(Window.orderBy("held")) - 1)


@query(f"WITH {OBS} SELECT event_id, (raw + bg + k13 / 13e0 + value * 2e-3) / 4e0 AS guess FROM obs")
def ensemble_mean(spark, d) -> DataFrame:
    guesses = [F.col("raw"), F.col("bg"), F.col("k13") / 13.0, F.col("value") * F.lit(0.002)]
    return observations(spark, d).select("event_id", (sum(guesses[1:], guesses[0]) / F.lit(4.0)).alias("guess"))
