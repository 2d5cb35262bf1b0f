"""Queries on series: expressions, alignment, ordered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import align as A
from ..operators import folds
from ..operators import ordered as O
from .registry import OBS, observations, query, read

DAY = "CAST(ts AS DATE)"


@query("SELECT event_type AS loc, time_bucket(INTERVAL 30 MINUTES, ts) AS ts, round(avg(value), 4) AS value, count(value) AS n FROM events GROUP BY ALL")
def halfhour_mean(spark, d) -> DataFrame:
    return A.downsample(observations(spark, d), ["loc"], "value").withColumn("value", F.round("value", 4))


@query(f"WITH {OBS} SELECT event_id, CASE WHEN clear >= 2e1 THEN CASE WHEN ghi IS NOT NULL THEN least(greatest(ghi / clear, 0e0), 2e0) END ELSE 0e0 END AS csi FROM obs")
def csi_ratio(spark, d) -> DataFrame:
    return observations(spark, d).select("event_id", C.csi(F.col("ghi"), F.col("clear")).alias("csi"))


@query(f"""
WITH {OBS}, blended AS (
  SELECT *, CASE WHEN clear < 2e2 THEN (clear / 2e2) * raw + (1e0 - clear / 2e2) * least(greatest(bg, 0e0), 1e0) ELSE raw END AS b FROM obs),
capped AS (SELECT *, greatest(least(b, CASE WHEN clear < 1e2 THEN 0.85e0 WHEN clear < 2e2 THEN 0.9e0 WHEN clear < 3.5e2 THEN 0.95e0 ELSE 1.3e0 END), 0e0) AS c FROM blended)
SELECT event_id, b AS blended, c AS capped, CASE WHEN clear >= 1e2 THEN c * clear END AS ghi FROM capped""")
def lowsun_blend_cap_ghi(spark, d) -> DataFrame:
    o = observations(spark, d)
    o = o.withColumn("blended", C.low_sun_blend(F.col("raw"), F.col("bg"), F.col("clear")))
    o = o.withColumn("capped", C.tier_cap(F.col("blended"), F.col("clear")))
    return o.select("event_id", "blended", "capped", C.ghi_of(F.col("capped"), F.col("clear"), 100.0).alias("ghi"))


@query("""SELECT event_id, round(sin(2e0 * pi() * dayofyear(ts) / 365e0), 9) AS doy_sin, round(cos(2e0 * pi() * dayofyear(ts) / 365e0), 9) AS doy_cos,
round(sin(2e0 * pi() * (hour(ts) + minute(ts) / 60e0) / 24e0), 9) + 0e0 AS hour_sin, round(cos(2e0 * pi() * (hour(ts) + minute(ts) / 60e0) / 24e0), 9) + 0e0 AS hour_cos FROM events""")
def cyclic_time(spark, d) -> DataFrame:
    ts = F.col("ts")
    (a, b), (c, e) = C.cyclic(F.dayofyear(ts).cast("double"), 365.0), C.cyclic(F.hour(ts) + F.minute(ts) / C.num(60), 24.0)
    return read(spark, d, "events").select("event_id", F.round(a, 9).alias("doy_sin"), F.round(b, 9).alias("doy_cos"), F.round(c, 9).alias("hour_sin"), F.round(e, 9).alias("hour_cos"))


@query("SELECT event_id, CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS TIMESTAMP) AS local_ts, CAST(hour(timezone('America/Los_Angeles', timezone('UTC', ts))) AS INTEGER) AS local_hour, ts + INTERVAL 8 HOURS AS utc_of_fixed FROM events")
def local_hour(spark, d) -> DataFrame:
    local = C.local_time(F.col("ts"))
    return read(spark, d, "events").select("event_id", local.alias("local_ts"), F.hour(local).alias("local_hour"), C.fixed_to_utc(F.col("ts")).alias("utc_of_fixed"))


@query(f"WITH {OBS} SELECT event_id, (clear - 270e0) / 50e0 AS bt_norm, (raw - 0.5e0) / 0.5e0 AS refl_norm FROM obs")
def norm_features(spark, d) -> DataFrame:
    return observations(spark, d).select("event_id", C.normalise(F.col("clear"), 270, 50).alias("bt_norm"), C.normalise(F.col("raw"), 0.5, 0.5).alias("refl_norm"))


@query("SELECT event_id, TRY_CAST(substr(props, 2, 3) AS DOUBLE) AS coerced, try_strptime(substr(CAST(ts AS VARCHAR), 1, 10), '%Y-%m-%d') AS day FROM events")
def coerced_casts(spark, d) -> DataFrame:
    day = C.parse_mixed(F.substring(F.col("ts").cast("string"), 1, 10), "dd/MM/yyyy", "yyyy-MM-dd")
    return read(spark, d, "events").select("event_id", F.substring("props", 2, 3).try_cast("double").alias("coerced"), day.cast("timestamp_ntz").alias("day"))


HALF = "half(loc, ts, v) AS (SELECT loc, time_bucket(INTERVAL 30 MINUTES, ts), max(value) FROM obs GROUP BY ALL)"


def _half(o: DataFrame) -> DataFrame:
    return o.groupBy("loc", A.bin_start(F.col("ts"), 30).alias("ts")).agg(F.max("value").alias("v"))


@query(f"WITH {OBS}, wide AS (SELECT loc, time_bucket(INTERVAL 6 HOURS, ts) AS ts, max(value) AS v FROM obs GROUP BY ALL) SELECT a.ts, a.v AS click, b.v AS view, c.v AS purchase FROM wide a JOIN wide b ON a.ts = b.ts JOIN wide c ON a.ts = c.ts WHERE a.loc = 'click' AND b.loc = 'view' AND c.loc = 'purchase'")
def align_inner(spark, d) -> DataFrame:
    """Instants that all of three locations have; bins of six hours have rows at every scale."""
    bins = observations(spark, d).groupBy("loc", A.bin_start(F.col("ts"), 360).alias("ts")).agg(F.max("value").alias("v"))
    return A.align([bins.filter(F.col("loc") == x).select("ts", F.col("v").alias(x)) for x in ("click", "view", "purchase")], ["ts"])


@query(f"WITH {OBS}, {HALF} SELECT count(*) AS n FROM half a WHERE a.loc = 'click' AND NOT EXISTS (SELECT 1 FROM half b WHERE b.loc = 'view' AND b.ts = a.ts)")
def unmatched_report(spark, d) -> DataFrame:
    h = _half(observations(spark, d))
    return A.unmatched(h.filter("loc = 'click'"), h.filter("loc = 'view'"), ["ts"]).agg(F.count("*").alias("n"))


@query(f"WITH {OBS}, {HALF} SELECT coalesce(a.ts, b.ts) AS ts, a.v AS click, b.v AS view FROM (SELECT * FROM half WHERE loc = 'click') a FULL JOIN (SELECT * FROM half WHERE loc = 'view') b ON a.ts = b.ts")
def outer_concat(spark, d) -> DataFrame:
    h = _half(observations(spark, d))
    return A.outer_align(*[h.filter(F.col("loc") == x).select("ts", F.col("v").alias(x)) for x in ("click", "view")], ["ts"])


GRID = """
grid AS (
  SELECT loc, unnest(range(lo, hi + INTERVAL 30 MINUTES, INTERVAL 30 MINUTES)) AS ts
  FROM (SELECT loc, min(time_bucket(INTERVAL 30 MINUTES, ts)) AS lo, max(time_bucket(INTERVAL 30 MINUTES, ts)) AS hi FROM obs GROUP BY loc))"""


@query(f"WITH {OBS}, {HALF}, {GRID} SELECT loc, ts, v FROM grid LEFT JOIN half USING (loc, ts)")
def reindex_grid(spark, d) -> DataFrame:
    o = observations(spark, d)
    return A.reindex(A.regular_grid(o, ["loc"], 30), _half(o), ["loc", "ts"])


@query(f"WITH {OBS}, {HALF}, {GRID} SELECT loc, ts FROM grid ANTI JOIN half USING (loc, ts)")
def missing_slots(spark, d) -> DataFrame:
    return A.missing_slots(observations(spark, d), ["loc"], 30)


@query(f"WITH {OBS}, {GRID} SELECT g.loc, g.ts, o.ghi FROM grid g ASOF LEFT JOIN (SELECT * FROM obs WHERE ghi IS NOT NULL) o ON g.loc = o.loc AND g.ts >= o.ts")
def asof_backward(spark, d) -> DataFrame:
    o = observations(spark, d)
    return A.asof_backward(A.regular_grid(o, ["loc"], 30), o, ["loc"], "ghi")


@query(f"WITH {OBS}, {GRID} SELECT g.loc, g.ts, CASE WHEN epoch(g.ts) - epoch(o.ts) <= 1200 THEN o.ghi END AS ghi FROM grid g ASOF LEFT JOIN (SELECT * FROM obs WHERE ghi IS NOT NULL) o ON g.loc = o.loc AND g.ts >= o.ts")
def asof_stale(spark, d) -> DataFrame:
    o = observations(spark, d)
    return A.asof_backward(A.regular_grid(o, ["loc"], 30), o, ["loc"], "ghi", stale_minutes=20)


@query("""
WITH met AS (
  SELECT o_orderkey AS id, o_orderdate + INTERVAL 10600 DAYS AS moment FROM orders),
near AS (
  SELECT id, moment, min(struct_pack(gap := abs(epoch_us(e.ts) - epoch_us(moment)), near := e.ts)) AS best
  FROM met JOIN (SELECT DISTINCT ts FROM events) e ON e.ts BETWEEN moment - INTERVAL 60 MINUTES AND moment + INTERVAL 60 MINUTES GROUP BY ALL)
SELECT met.id, met.moment AS "at", best.near AS near FROM met LEFT JOIN near USING (id, moment)""")
def nearest_time(spark, d) -> DataFrame:
    targets = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderdate") + F.expr("interval 10600 days")).alias("at"))
    return A.nearest_instant(targets, read(spark, d, "events"), 60)


@query("WITH f AS (SELECT user_id, max(value) AS factor FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT event_id, value * coalesce(factor, 1e0) AS scaled FROM events LEFT JOIN f USING (user_id)")
def lookup_default(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    f = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("factor"))
    return A.lookup(e, f, ["user_id"], "factor", 1.0).select("event_id", (F.col("value") * F.col("factor")).alias("scaled"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_known(spark, d) -> DataFrame:
    return A.known(read(spark, d, "customer"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_missing(spark, d) -> DataFrame:
    return A.unmatched(read(spark, d, "customer"), read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_name")


@query(f"WITH {OBS}, l AS (SELECT *, lag(raw) OVER (PARTITION BY loc ORDER BY ts, event_id) AS raw_lag FROM obs) SELECT event_id, raw_lag, raw - raw_lag AS raw_change FROM l WHERE clear >= 1e2")
def lag_full(spark, d) -> DataFrame:
    return O.lag_and_change(observations(spark, d), ["loc"], "raw", ["ts", "event_id"], F.col("clear") >= 100).select("event_id", "raw_lag", "raw_change")


@query(f"WITH {OBS} SELECT event_id, lag(raw) OVER w AS raw_lag, raw - lag(raw) OVER w AS raw_change FROM obs WHERE clear >= 1e2 WINDOW w AS (PARTITION BY loc ORDER BY ts, event_id)")
def lag_daytime(spark, d) -> DataFrame:
    return O.lag_and_change(observations(spark, d), ["loc"], "raw", ["ts", "event_id"], F.col("clear") >= 100, "daytime").select("event_id", "raw_lag", "raw_change")


@query(f"WITH {OBS} SELECT event_id, clear / greatest(max(clear) OVER (PARTITION BY loc, {DAY}), 1e0) AS share FROM obs")
def daily_peak_share(spark, d) -> DataFrame:
    o = observations(spark, d)
    peak = o.groupBy("loc", F.to_date("ts").alias("day")).agg(F.max("clear").alias("peak"))
    return o.withColumn("day", F.to_date("ts")).join(peak, ["loc", "day"]).select("event_id", (F.col("clear") / F.greatest("peak", C.num(1))).alias("share"))


ISLANDS = """
flagged AS (SELECT *, coalesce(FLAG, false) AS f FROM obs),
turned AS (SELECT *, CASE WHEN f <> lag(f, 1, false) OVER (PARTITION BY loc ORDER BY ts, event_id) THEN 1 ELSE 0 END AS t FROM flagged),
numbered AS (SELECT *, sum(t) OVER (PARTITION BY loc ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM turned)
SELECT loc, CAST(run AS BIGINT) AS run, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM numbered WHERE f GROUP BY loc, run HAVING count(*) >= """


@query(f"WITH {OBS}, " + ISLANDS.replace("FLAG", "value > 5e1") + "3")
def islands_ge3(spark, d) -> DataFrame:
    return O.runs(observations(spark, d), ["loc"], F.col("value") > 50, ["ts", "event_id"]).withColumn("run", F.col("run").cast("long"))


@query(f"WITH {OBS}, g AS (SELECT loc, lag(ts) OVER (PARTITION BY loc ORDER BY ts, event_id) AS after, ts AS until FROM obs) SELECT loc, after, until, (epoch_us(until) - epoch_us(after)) / 60e6 AS minutes FROM g WHERE (epoch_us(until) - epoch_us(after)) / 60e6 > 20")
def gap_audit(spark, d) -> DataFrame:
    return O.gaps(observations(spark, d), ["loc"], ["ts", "event_id"], 20)


def _interp(place: str) -> str:
    return f"""
WITH {OBS}, x AS (SELECT *, row_number() OVER (PARTITION BY loc ORDER BY ts, event_id) AS rn FROM obs),
y AS (SELECT *, {place} AS pos FROM x),
z AS (
  SELECT *, last_value(CASE WHEN ghi IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS pn, last_value(CASE WHEN ghi IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
         last_value(ghi IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN ghi IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS qp, first_value(ghi IGNORE NULLS) OVER a AS qv
  FROM y WINDOW b AS (PARTITION BY loc ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY loc ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, coalesce(ghi, CASE WHEN rn - pn <= LIMIT THEN coalesce(pv + (qv - pv) * (pos - pp) / (qp - pp), pv) END) AS ghi FROM z"""


@query(_interp("CAST(rn AS DOUBLE)").replace("LIMIT", "2"))
def interp_position(spark, d) -> DataFrame:
    return O.interpolate(observations(spark, d), ["loc"], "ghi", ["ts", "event_id"], 2).select("event_id", "ghi")


@query(_interp("epoch_us(ts) / 1e6").replace("LIMIT", "12"))
def interp_time(spark, d) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return O.interpolate(observations(spark, d), ["loc"], "ghi", ["ts", "event_id"], 12, seconds).select("event_id", "ghi")


@query(f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY loc ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY loc) AS n FROM obs) SELECT event_id, CASE WHEN rn > n - greatest(1, floor(0.2e0 * n)) THEN 'val' ELSE 'train' END AS role FROM r")
def tail_split(spark, d) -> DataFrame:
    return O.tail_split(observations(spark, d), ["loc"], ["ts", "event_id"]).select("event_id", "role")


@query("SELECT user_id, arg_min(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY user_id")
def dedup_first(spark, d) -> DataFrame:
    return O.keep_one(read(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT user_id, arg_max(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY user_id")
def dedup_last(spark, d) -> DataFrame:
    return O.keep_one(read(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("SELECT event_type AS loc, max(struct_pack(v := value, t := -event_id)).v AS top, -max(struct_pack(v := value, t := -event_id)).t AS top_id, min(struct_pack(v := value, t := event_id)).t AS low_id FROM events GROUP BY event_type")
def argmax_instant(spark, d) -> DataFrame:
    e = read(spark, d, "events").groupBy(F.col("event_type").alias("loc"))
    best, least = F.max(F.struct(F.col("value").alias("v"), (-F.col("event_id")).alias("t"))), F.min(F.struct(F.col("value").alias("v"), F.col("event_id").alias("t")))
    return e.agg(best["v"].alias("top"), (-best["t"]).alias("top_id"), least["t"].alias("low_id"))


@query("SELECT event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) WHERE (rn - 1) % 8 = 0")
def every_eighth(spark, d) -> DataFrame:
    return O.every_nth(read(spark, d, "events"), ["event_type"], ["ts", "event_id"], 8).select("event_id", "value")


@query(f"WITH {OBS} SELECT loc, {DAY} AS day, min(ts) AS first_light, max(ts) AS last_light FROM obs WHERE clear >= 1e2 GROUP BY ALL")
def daylight_span(spark, d) -> DataFrame:
    return observations(spark, d).filter("clear >= 100").groupBy("loc", F.to_date("ts").alias("day")).agg(F.min("ts").alias("first_light"), F.max("ts").alias("last_light"))


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
h AS (
  SELECT user_id, event_id, n, value AS best, true AS improved, 0 AS waited, false AS stopped FROM r WHERE n = 1
  UNION ALL
  SELECT r.user_id, r.event_id, r.n, CASE WHEN r.value < h.best - 1e-6 THEN r.value ELSE h.best END, r.value < h.best - 1e-6, CASE WHEN r.value < h.best - 1e-6 THEN 0 ELSE h.waited + 1 END,
         h.stopped OR (r.value >= h.best - 1e-6 AND h.waited + 1 >= 9) FROM h JOIN r ON r.user_id = h.user_id AND r.n = h.n + 1)
SELECT user_id, event_id, best, improved, waited, stopped FROM h""")
def history_best(spark, d) -> DataFrame:
    """A history per user: the value accepted last, rows waited since, and whether patience (9) has run out."""
    rows = read(spark, d, "events").select("user_id", "event_id", "value")
    return O.history_best(rows, ["user_id"], "value", "event_id", patience=9).select("user_id", "event_id", "best", "improved", "waited", "stopped")


@query("SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-17' AND hour(ts) IN (9, 12, 15)")
def date_slice(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    return e.filter((F.col("ts") >= F.lit("2024-01-12").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-17").cast("timestamp_ntz")) & F.hour("ts").isin(9, 12, 15)).select("event_id", "ts", "value")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN value + 1e0 ELSE value END AS value FROM events")
def gap_splice(spark, d) -> DataFrame:
    """Two sources that overlap on some keys: the later source's rows win."""
    e = read(spark, d, "events")
    patch = e.filter(F.col("event_type").isin("click", "view")).withColumn("value", F.col("value") + 1.0)
    return O.splice([e, patch], ["event_id"]).select("event_id", "value")


@query("SELECT event_id, value, unnest(range(CASE WHEN value > 425e0 THEN 4 ELSE 1 END)) IS NOT NULL AS kept FROM events")
def oversample4(spark, d) -> DataFrame:
    return folds.oversample(read(spark, d, "events"), F.col("value") > 425, 4).select("event_id", "value", F.lit(True).alias("kept"))


@query("SELECT s_nationkey AS k, 'supplier' AS origin FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer")
def union_sources(spark, d) -> DataFrame:
    return read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("origin")).unionByName(read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("origin")))


@query("SELECT event_type AS loc, value AS third, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn FROM events) WHERE rn = 3")
def third_smallest(spark, d) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("value", "event_id")
    e = read(spark, d, "events").withColumn("rn", F.row_number().over(w)).filter("rn = 3")
    return e.select(F.col("event_type").alias("loc"), F.col("value").alias("third"), "event_id")
