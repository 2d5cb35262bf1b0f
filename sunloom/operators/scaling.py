"""Unit repair per location, standardisation from training rows, and acceptance of parameter sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import num
from .folds import standardise
from .quantiles import exact_percentiles


def rescale_by_median(df: DataFrame, by: Sequence[str], value: str, above: float, factor: float) -> DataFrame:
    """df with value times factor in the groups whose median is above a bound: those that came in another unit.

    The median comes from quantiles.py and is joined back, so that no task holds a group.
    """
    typical = exact_percentiles(df, by, value, [0.5]).select(*by, F.get("p", F.lit(0)).alias("__typical"))
    return df.join(typical, list(by)).withColumn(value, F.when(F.col("__typical") > num(above), F.col(value) * num(factor)).otherwise(F.col(value))).drop("__typical")


def rescale_by_percentile(df: DataFrame, by: Sequence[str], value: str, above: float, share: float = 0.99) -> DataFrame:
    """df with value over its group's percentile in the groups where that is above a bound: counts become shares."""
    top = exact_percentiles(df, by, value, [share]).select(*by, F.get("p", F.lit(0)).alias("__top"))
    return df.join(top, list(by)).withColumn(value, F.when(F.col("__top") > num(above), F.col(value) / F.col("__top")).otherwise(F.col(value))).drop("__top")


def standardised(df: DataFrame, x: str, fitted_on: Column, size: int, first: int = 0) -> DataFrame:
    """df with the array x standardised, from place first on, by the population moments of the rows that fitted_on selects.

    Places before first (a basis that is within [0, 1] already) stay as they are. The moments are one row of arrays.
    """
    at = lambda i: F.get(x, F.lit(i)).cast("double")
    spread = lambda i: F.when(F.stddev_pop(at(i)) < num(1e-8), num(1)).otherwise(F.stddev_pop(at(i)))
    moments = df.filter(fitted_on).agg(
        F.array(*[num(0) if i < first else F.avg(at(i)) for i in range(size)]).alias("__mean"), F.array(*[num(1) if i < first else spread(i) for i in range(size)]).alias("__std")
    )
    return df.crossJoin(F.broadcast(moments)).withColumn(x, standardise(x, F.col("__mean"), F.col("__std"))).drop("__mean", "__std")  # one row of moments


# What a pair of parameters may cost at the lead location's noon and at any other location.
NOON_LOSS, OTHER_LOSS = 1.0, 1.0


def accept(table: DataFrame, base: DataFrame, lead: str, by: str = "loc") -> DataFrame:
    """A sweep's table (metrics.blend_sweep) against its base (metrics.sweep_base), one row per threshold and alpha.

    pooled_<m>, the mean over locations, and lead_<m> for m in overall_rmse, clear_rmse, noon_rmse; max_other_overall_delta,
    the worst rise of the overall error at another location; lead_clear_delta and lead_noon_delta; and passes: the lead's
    clear-day error falls, its noon error rises by no more than 1, and no other location's overall error by more than 1.
    """
    names = ("overall_rmse", "clear_rmse", "noon_rmse")
    met = table.join(base.select(by, *[F.col(n).alias(f"__{n}") for n in names]), by)
    at_lead = F.col(by) == lead
    of_lead = lambda c: F.max(F.when(at_lead, c))
    out = met.groupBy("threshold", "alpha").agg(
        *[F.avg(n).alias(f"pooled_{n}") for n in names], *[of_lead(F.col(n)).alias(f"lead_{n}") for n in names],
        F.max(F.when(~at_lead, F.col("overall_rmse") - F.col("__overall_rmse"))).alias("max_other_overall_delta"),
        of_lead(F.col("clear_rmse") - F.col("__clear_rmse")).alias("lead_clear_delta"), of_lead(F.col("noon_rmse") - F.col("__noon_rmse")).alias("lead_noon_delta"),
    )
    verdict = (F.col("lead_clear_delta") < num(0)) & (F.col("lead_noon_delta") <= num(NOON_LOSS)) & (F.col("max_other_overall_delta") <= num(OTHER_LOSS))
    return out.withColumn("passes", F.coalesce(verdict, F.lit(False)))


def passing(accepted: DataFrame) -> DataFrame:
    """The rows of accept that pass, with their place: by the lead's fall of the clear-day error, then threshold and alpha.

    A sweep has as many rows as pairs of parameters, so one window over them is small.
    """
    order = Window.orderBy("lead_clear_delta", "threshold", "alpha")
    return accepted.filter("passes").withColumn("place", F.row_number().over(order))
