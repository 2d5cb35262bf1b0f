"""Error metrics, day regimes, bias correction, distribution summaries and parameter sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, num
from .ordered import previous
from .quantiles import exact_percentiles

REGIMES = ("clear", "cloudy_smooth", "broken_cloud")
# Standard deviations of a day's index that part the regimes; factor's bounds and peak hours (both counted);
# hours of noon, and the bounds of a blended index.
CLEAR_BELOW, SMOOTH_BELOW = 0.10, 0.20
FACTOR_LOW, FACTOR_HIGH, PEAK_HOURS = 0.5, 1.5, (9, 15)
NOON, TOP_INDEX = (11, 13), 1.3


def errors(truth: Column, guess: Column) -> dict[str, Column]:
    """rmse, mae, r2 (1 - SSE / SST), bias and n over pairs without nulls; null below two pairs."""
    both = truth.isNotNull() & guess.isNotNull()
    y, e = F.when(both, truth), F.when(both, guess - truth)
    n = F.count(e)
    total = F.var_pop(y) * n
    enough = lambda c: F.when(n >= 2, c)
    return {
        "rmse": enough(F.sqrt(F.avg(e * e))), "mae": enough(F.avg(F.abs(e))),
        "r2": enough(F.when(total > 0, num(1) - F.sum(e * e) / total)), "bias": enough(F.avg(e)), "n": n,
    }


def error_table(df: DataFrame, by: Sequence[str], truth: str = "truth", guess: str = "guess") -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in errors(F.col(truth), F.col(guess)).items()])


def error_sets(df: DataFrame, sets: Sequence[Sequence[str]], truth: str = "truth", guess: str = "guess") -> DataFrame:
    """The same for several groupings in one pass; columns not grouped by are null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, names)).agg(*[c.alias(k) for k, c in errors(F.col(truth), F.col(guess)).items()])


def peak_rmse(df: DataFrame, by: Sequence[str], truth: str = "truth", guess: str = "guess", share: float = 0.9) -> DataFrame:
    """by, peak_rmse over rows whose truth reaches the group's percentile; null for a single such row.

    The percentile comes from quantiles.py and is joined back, so that a group is buffered in no task.
    """
    rows = df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    edge = exact_percentiles(rows, by, truth, [share]).select(*by, F.get("p", F.lit(0)).alias("edge"))
    top = rows.join(edge, list(by)).filter(F.col(truth) >= F.col("edge"))
    e = F.col(guess) - F.col(truth)
    return top.groupBy(*by).agg(F.when(F.count("*") > 1, F.sqrt(F.avg(e * e))).alias("peak_rmse"))


def ramp_rmse(df: DataFrame, by: Sequence[str], order: Sequence[str], truth: str = "truth", guess: str = "guess") -> DataFrame:
    """by, ramp_rmse of signed changes between consecutive rows that have both."""
    rows = previous(df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull()), by, order, [truth, guess], "__before")
    d = (F.col(guess) - F.col(f"__before.{guess}")) - (F.col(truth) - F.col(f"__before.{truth}"))
    return rows.withColumn("__d", d).groupBy(*by).agg(F.sqrt(F.avg(F.col("__d") * F.col("__d"))).alias("ramp_rmse"))


def regime_of(spread: Column) -> Column:
    """Day regime of the sample deviation of a day's index; null (a single value) has none."""
    return F.when(spread < num(CLEAR_BELOW), REGIMES[0]).when(spread < num(SMOOTH_BELOW), REGIMES[1]).when(spread.isNotNull(), REGIMES[2])


def day_regimes(df: DataFrame, by: Sequence[str], index: str, day: Column) -> DataFrame:
    return df.groupBy(*by, day.alias("day")).agg(F.stddev_samp(index).alias("spread")).withColumn("regime", regime_of(F.col("spread")))


def factors(df: DataFrame, month: Column, hour: Column, truth: str, guess: str, least: float = 50.0) -> DataFrame:
    """month, hour, factor: median of truth / guess where both reach least, within bounds; 1 outside the peak hours."""
    rows = df.filter((F.col(truth) >= num(least)) & (F.col(guess) >= num(least)))
    rows = rows.select(month.cast("int").alias("month"), hour.cast("int").alias("hour"), (F.col(truth) / F.col(guess)).alias("ratio"))
    table = exact_percentiles(rows, ["month", "hour"], "ratio", [0.5]).withColumn("ratio", F.get("p", F.lit(0)))
    return table.select("month", "hour", F.when(F.col("hour").between(*PEAK_HOURS), clip(F.col("ratio"), FACTOR_LOW, FACTOR_HIGH)).otherwise(num(1)).alias("factor"))


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, mean, std: population moments, a std under 1e-8 taken as 1."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    table = df.select(stacked.alias("s")).groupBy("s.column").agg(F.avg("s.v").alias("mean"), F.stddev_pop("s.v").alias("std"))
    return table.withColumn("std", F.when(F.col("std") < num(1e-8), num(1)).otherwise(F.col("std")))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / num(width)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], exact: bool = True) -> DataFrame:
    """by, p<share>...: linear between neighbours; with exact off, Spark's sketch."""
    table = exact_percentiles(df, by, value, shares) if exact else df.groupBy(*by).agg(F.percentile_approx(value, list(shares), 10_000).alias("p"))
    return table.select(*by, *[F.get("p", F.lit(i)).alias(f"p{round(100 * s)}") for i, s in enumerate(shares)])


def _three(truth: Column, guess: Column) -> list[Column]:
    """Root mean square errors over all rows, those of clear days, and those of noon."""
    e = (guess - truth) * (guess - truth)
    return [
        F.sqrt(F.avg(e)).alias("overall_rmse"), F.sqrt(F.avg(F.when(F.col("regime") == REGIMES[0], e))).alias("clear_rmse"),
        F.sqrt(F.avg(F.when(F.col("hour").between(*NOON), e))).alias("noon_rmse"),
    ]


def sweep_base(df: DataFrame, by: str = "loc") -> DataFrame:
    """by, overall_rmse (of guess), clear_rmse and noon_rmse (of final * clear): what a sweep is held against."""
    overall = _three(F.col("truth"), F.col("guess"))[0]
    return df.groupBy(by).agg(overall, *_three(F.col("truth"), F.col("final") * F.col("clear"))[1:])


def blend_sweep(df: DataFrame, thresholds: Sequence[float], alphas: Sequence[float], by: str = "loc") -> DataFrame:
    """threshold, alpha, by, overall_rmse, clear_rmse, noon_rmse: for every pair of parameters, errors of a blended index.

    Rows have truth, clear (sky), raw, bg (background) and final (the index as it is), hour and regime. Wherever clear is
    below the threshold the index becomes alpha * raw + (1 - alpha) * bg, bg within [0, 1]; every index is then held
    within [0, 1.3] and times clear is the guess. Pairs are exploded from each row's constant list and aggregated at
    once, map-side first.
    """
    grid = F.explode(F.array(*[F.struct(num(t).alias("threshold"), num(a).alias("alpha")) for t in thresholds for a in alphas]))
    rows = df.withColumn("g", grid).select("*", "g.threshold", "g.alpha").drop("g")
    blended = F.col("alpha") * F.col("raw") + (num(1) - F.col("alpha")) * clip(F.col("bg"), 0.0, 1.0)
    index = F.when(F.col("clear") < F.col("threshold"), blended).otherwise(F.col("final"))
    return rows.groupBy("threshold", "alpha", by).agg(*_three(F.col("truth"), clip(index, 0.0, TOP_INDEX) * F.col("clear")))
