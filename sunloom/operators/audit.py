"""Reports: benchmark of estimators, sensor outages, feed gaps, spatial diversity, snapshot picks, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import num
from .metrics import error_table, peak_rmse, ramp_rmse
from .ordered import gaps, runs


def stack_methods(df: DataFrame, methods: dict[str, Column], keep: Sequence[str], common_rows: bool = False) -> DataFrame:
    """keep, method, guess: one row per row and method; with common_rows only rows that every method has."""
    rows = df
    if common_rows:
        for c in methods.values():
            rows = rows.filter(c.isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("method"), c.cast("double").alias("guess")) for name, c in methods.items()]))
    return rows.select(*keep, each.alias("m")).select(*keep, "m.method", "m.guess")


def benchmark(df: DataFrame, methods: dict[str, Column], by: Sequence[str], truth: str = "truth", common_rows: bool = False) -> DataFrame:
    return error_table(stack_methods(df, methods, [*by, truth], common_rows), [*by, "method"], truth)


def full_benchmark(stacked: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """by, rmse, mae, r2, bias, n, peak_rmse and ramp_rmse of stacked rows (by, order, truth, guess); below two pairs all but n are null."""
    table = error_table(stacked, by)
    for found in (peak_rmse(stacked, by), ramp_rmse(stacked, by, order)):
        table = table.join(found, list(by), "left")
    return table.withColumns({c: F.when(F.col("n") >= 2, F.col(c)) for c in ("peak_rmse", "ramp_rmse")})


def regime_benchmark(stacked: DataFrame, by: Sequence[str], regime: str = "regime") -> DataFrame:
    """error_table by groups, of those with a regime and two rows at least."""
    rows = stacked.filter(F.col(regime).isNotNull())
    return error_table(rows, by).join(rows.groupBy(*by).agg(F.count("*").alias("__n")).filter("__n >= 2").drop("__n"), list(by), "left_semi")


def roll_up(table: DataFrame, measures: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Mean of measures per method over stations, in the given order of methods."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("method"))
    return table.groupBy("method").agg(*[F.round(F.avg(m), 3).alias(m) for m in measures]).withColumn("rank", rank.cast("int"))


# Clear sky above which a sensor should give something, and by which it is day; a share of it that is too low.
BRIGHT, DAY_ABOVE, LOW_SHARE = 200.0, 5.0, 0.05


def zero_runs(df: DataFrame, by: Sequence[str], ghi: Column, clear: Column, order: Sequence[str], least: int = 3) -> DataFrame:
    """by, run, first_ts, last_ts, n: least or more rows in a row in which the sensor gives zero under a bright sky."""
    return runs(df, by, (ghi == num(0)) & (clear > num(BRIGHT)), order, least)


def low_readings(df: DataFrame, ghi: Column, clear: Column) -> DataFrame:
    """The rows by day whose share of the clear sky is suspiciously low, with that ratio."""
    return df.filter(clear > num(DAY_ABOVE)).withColumn("ratio", ghi / clear).filter(F.col("ratio") < num(LOW_SHARE))


def diversity(df: DataFrame, at: Sequence[str], values: Sequence[str]) -> DataFrame:
    """at and, per column of values, its mean, spread (population), distinct values at a tenth and n, across locations.

    With a model's field and each location's nearest station copy as columns, this holds the one against the other.
    """
    of = lambda v: [F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_spread"), F.countDistinct(F.round(v, 1)).alias(f"{v}_distinct"), F.count(v).alias(f"{v}_n")]
    return df.groupBy(*at).agg(*[c for v in values for c in of(v)])


def feed_audit(df: DataFrame, by: str, order: Sequence[str], longer_minutes: float, ts: str = "ts") -> DataFrame:
    """One row per feed: n, first_ts, last_ts, n_gaps (neighbours further apart than longer_minutes), and against the others:
    starts and ends (how many distinct ones there are), same_start (feeds that start when it does), gappy (feeds with gaps).

    What is compared across feeds is one row a feed.
    """
    found = df.groupBy(by).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    holes = gaps(df, [by], order, longer_minutes, ts).groupBy(by).agg(F.count("*").alias("n_gaps"))
    found = found.join(holes, by, "left").withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0)))
    across = found.agg(F.countDistinct("first_ts").alias("starts"), F.countDistinct("last_ts").alias("ends"), F.count_if(F.col("n_gaps") > 0).alias("gappy"))
    alike = found.groupBy("first_ts").agg(F.count("*").alias("same_start"))
    return found.join(alike, "first_ts").crossJoin(F.broadcast(across)).select(by, "n", "first_ts", "last_ts", "n_gaps", "starts", "ends", "same_start", "gappy")


def source_summary(df: DataFrame, by: Sequence[str], value: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(*by).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("nulls"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))


def field_stats(df: DataFrame, value: str, ts: str = "ts") -> DataFrame:
    """ts, mean and spread (sample) of a field over all locations, for the instants at which any location has a value."""
    table = df.groupBy(ts).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("spread"), F.count(value).alias("__n"))
    return table.filter("__n > 0").drop("__n")


def _first_best(value: Column, ts: str, where: Column | None = None) -> Column:
    """The instant of the highest value, the first of several; null values are none."""
    holds = value.isNotNull() if where is None else value.isNotNull() & where
    return F.max(F.when(holds, F.struct(value.alias("v"), (-F.unix_micros(F.col(ts).cast("timestamp"))).alias("t"), F.col(ts).alias("ts"))))["ts"]


# Fixed values of the picks: hours of morning, afternoon and midday, how far from a day's end the afternoon falls back to,
# and the means and spreads that make a sky clear, partly cloudy or overcast.
MORNING, AFTERNOON, MIDDAY, FROM_END = 9, (13, 15), (9, 15), 4
CLEAR_MEAN, CLEAR_SPREAD, PARTLY_MEAN, OVERCAST_MEAN, OVERCAST_PLACE = 450.0, 30.0, (150.0, 500.0), (5.0, 120.0), 3


def snapshots(fields: DataFrame, ts: str = "ts") -> DataFrame:
    """Per day of field_stats: the instants morning, widest, brightest and afternoon.

    morning: the first of the 9th hour, else the day's first. widest and brightest: of the highest spread and mean.
    afternoon: of the highest mean from 13 to 15 h, else the fourth from the day's end (null on a day with fewer).
    """
    hour = F.hour(ts)
    # as many entries as a day has instants
    last = F.sort_array(F.collect_list(ts))
    table = fields.groupBy(F.to_date(ts).alias("day")).agg(
        F.coalesce(F.min(F.when(hour == MORNING, F.col(ts))), F.min(ts)).alias("morning"), _first_best(F.col("spread"), ts).alias("widest"), _first_best(F.col("mean"), ts).alias("brightest"),
        _first_best(F.col("mean"), ts, hour.between(*AFTERNOON)).alias("afternoon"), last.alias("__last"),
    )
    return table.withColumn("afternoon", F.coalesce("afternoon", F.get("__last", F.size("__last") - FROM_END))).drop("__last")


def sky_picks(fields: DataFrame, ts: str = "ts") -> DataFrame:
    """Per year of field_stats, over the hours 9 to 15: the instants clear, partly, partly_other_day and overcast.

    clear: the highest mean above 450 with a spread below 30, else the highest mean. partly: the highest spread with a mean
    between 150 and 500; partly_other_day: the same on another day. overcast: of means between 5 and 120 the third lowest
    (the highest of fewer), else the lowest mean. Ties go to the first instant.
    """
    rows = fields.filter(F.hour(ts).between(*MIDDAY)).withColumns({"year": F.year(ts), "__day": F.to_date(ts)})
    mean, spread = F.col("mean"), F.col("spread")
    broken = (mean > num(PARTLY_MEAN[0])) & (mean < num(PARTLY_MEAN[1]))
    picks = rows.groupBy("year").agg(
        F.coalesce(_first_best(mean, ts, (mean > num(CLEAR_MEAN)) & (spread < num(CLEAR_SPREAD))), _first_best(mean, ts)).alias("clear"),
        _first_best(spread, ts, broken).alias("partly"), _first_best(-mean, ts).alias("__lowest"),
    )
    other = rows.join(F.broadcast(picks.select("year", F.to_date("partly").alias("__taken"))), "year")  # one row a year
    other = other.groupBy("year").agg(_first_best(spread, ts, broken & (F.col("__day") != F.col("__taken"))).alias("partly_other_day"))
    dim = rows.filter((mean < num(OVERCAST_MEAN[1])) & (mean > num(OVERCAST_MEAN[0]))).withColumn("__n", F.row_number().over(Window.partitionBy("year").orderBy("mean", ts))).filter(F.col("__n") <= OVERCAST_PLACE)
    dim = dim.groupBy("year").agg(F.max_by(ts, "__n").alias("__dim"))
    met = picks.join(other, "year").join(dim, "year", "left")
    return met.select("year", "clear", "partly", "partly_other_day", F.coalesce("__dim", "__lowest").alias("overcast"))


def rank_in(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], place: int) -> DataFrame:
    """The row at a place of each key's order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") == place).drop("__n")
