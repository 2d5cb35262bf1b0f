"""Alignment of series and dimensions: equi, as-of and nearest joins, regular grids, set differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Rows whose key is in every frame."""
    return reduce(lambda a, b: a.join(b, list(on), "inner"), frames)


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_anti")


def known(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_semi")


def reindex(keys: DataFrame, df: DataFrame, on: Sequence[str]) -> DataFrame:
    """df on exactly the rows of keys, null where it has none."""
    return keys.join(df, list(on), "left")


def lookup(df: DataFrame, dimension: DataFrame, on: Sequence[str], value: str, default: float) -> DataFrame:
    """df with the dimension's value, default where there is none."""
    return df.join(dimension.select(*on, value), list(on), "left").withColumn(value, F.coalesce(value, F.lit(default)))


def outer_align(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b, list(on), "full")


def bin_start(ts: Column, minutes: int) -> Column:
    """Start of the bin of an instant, bins counted from the epoch."""
    return F.window(ts, f"{minutes} minutes").start


def downsample(df: DataFrame, by: Sequence[str], value: str, minutes: int = 30, ts: str = "ts") -> DataFrame:
    """by, ts (bin start), mean of value, n. Bins without rows are not given; reindex to a grid gives them as nulls."""
    return df.groupBy(*by, bin_start(F.col(ts), minutes).alias("ts")).agg(F.avg(value).alias(value), F.count(value).alias("n"))


def regular_grid(df: DataFrame, by: Sequence[str], minutes: int, ts: str = "ts") -> DataFrame:
    """by and ts: every bin start from the first row's to the last row's, per key."""
    span = df.groupBy(*by).agg(F.min(bin_start(F.col(ts), minutes)).alias("lo"), F.max(bin_start(F.col(ts), minutes)).alias("hi"))
    return span.select(*by, F.explode(F.sequence("lo", "hi", F.expr(f"interval {minutes} minutes"))).alias("ts"))


def missing_slots(df: DataFrame, by: Sequence[str], minutes: int, ts: str = "ts") -> DataFrame:
    """Grid slots, between a key's first and last row, in whose bin it has no row."""
    present = df.select(*by, bin_start(F.col(ts), minutes).alias("ts")).distinct()
    return regular_grid(df, by, minutes, ts).join(present, [*by, "ts"], "left_anti")


def asof_backward(grid: DataFrame, observed: DataFrame, by: Sequence[str], value: str, stale_minutes: int | None = None, ts: str = "ts") -> DataFrame:
    """grid with the last observed value that is not null at or before its instant; older ones than stale_minutes are null.

    Union of both and a running last value, by key and day: what a day starts with comes from the last value of each
    earlier day, so a key's whole history never sorts in one task.
    """
    day = F.to_date(ts)
    seen = observed.filter(F.col(value).isNotNull()).select(*by, ts, F.col(value).alias("__v"), F.col(ts).alias("__at"), F.lit(0).alias("__grid"))
    slots = grid.select(*by, ts, F.lit(None).cast(dict(observed.dtypes)[value]).alias("__v"), F.lit(None).cast(dict(observed.dtypes)[ts]).alias("__at"), F.lit(1).alias("__grid"))
    both = seen.unionByName(slots).withColumn("__day", day)
    ends = both.groupBy(*by, "__day").agg(F.max(F.when(F.col("__grid") == 0, F.struct("__at", "__v"))).alias("end"))
    carry = ends.withColumn("carry", F.last("end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))).drop("end")
    running = Window.partitionBy(*by, "__day").orderBy(ts, "__grid").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.join(carry, [*by, "__day"]).withColumn("__hit", F.coalesce(F.last(F.when(F.col("__grid") == 0, F.struct("__at", "__v")), ignorenulls=True).over(running), F.col("carry")))
    fresh = F.lit(True) if stale_minutes is None else F.unix_timestamp(ts) - F.unix_timestamp("__hit.__at") <= 60 * stale_minutes
    return filled.filter("__grid = 1").select(*by, ts, F.when(fresh, F.col("__hit.__v")).alias(value))


def nearest_instant(targets: DataFrame, instants: DataFrame, reach_minutes: int, ts: str = "ts") -> DataFrame:
    """targets (columns id, at) with the instant nearest to at, the earlier of two, within reach_minutes; null without one.

    Distinct wanted and given instants are merged in slots as long as the reach: within a slot the last given before and
    the first after are running values of two sorts, and what a slot lacks comes from the last of the slot before and the
    first of the one after, one small row a slot. Rows shuffled are the two sides, however dense they are.
    """
    width = 60 * reach_minutes
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    slot = F.floor(F.col("__m") / (1_000_000 * width))
    given = instants.filter(F.col(ts).isNotNull()).select(F.col(ts).alias("near")).distinct().withColumn("__m", micros("near")).withColumn("slot", slot)
    wanted = targets.select("at").distinct().withColumn("__m", micros("at")).withColumn("slot", slot)
    mark = F.struct("__m", "near")
    ends = given.groupBy("slot").agg(F.min(mark).alias("first"), F.max(mark).alias("last"))
    both = given.select("slot", "__m", mark.alias("__given"), F.lit(0).alias("__want"), F.lit(None).cast(dict(targets.dtypes)["at"]).alias("at"))
    both = both.unionByName(wanted.select("slot", "__m", F.lit(None).cast(given.select(mark.alias("g")).schema["g"].dataType).alias("__given"), F.lit(1).alias("__want"), "at"))
    over = Window.partitionBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    before, after = over.orderBy("__m", "__want"), over.orderBy(F.desc("__m"), "__want")
    both = both.withColumns({"__b": F.last("__given", ignorenulls=True).over(before), "__a": F.last("__given", ignorenulls=True).over(after)}).filter("__want = 1 AND at IS NOT NULL")
    beside = lambda name, end, step: ends.select((F.col("slot") + step).alias("slot"), F.col(end).alias(name))
    both = both.join(beside("__b1", "last", 1), "slot", "left").join(beside("__a1", "first", -1), "slot", "left")
    gap = lambda c: F.struct(F.abs(F.col(f"{c}.__m") - F.col("__m")).alias("gap"), F.col(f"{c}.__m").alias("m"), F.col(f"{c}.near").alias("near"))
    near = F.array_min(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), gap(c)) for c in ("__b", "__a", "__b1", "__a1")])))
    found = both.select("at", near.alias("n")).select("at", F.when(F.col("n.gap") <= width * 1_000_000, F.col("n.near")).alias("near"))
    return targets.select("id", "at").distinct().join(found, "at", "left").select("id", "at", "near")
