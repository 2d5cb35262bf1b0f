"""Ordered operators within a location: lags, runs, interpolation, splits, first and last, extremes.

A location may hold a large share of all rows, so none of these sorts a location's history in one task. Rows are ordered
within a location's day (of the first order column); what a day needs of other days (the row before it, the rows and sums
before it, the next value after it) is one small row per location and day, carried over days by a window over those alone.
Order columns are a total order; null locations and null instants are groups of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import durable


def by_time(by: Sequence[str], *order: str) -> Window:
    return Window.partitionBy(*by).orderBy(*(order or ("ts",)))


#: Width of the ranges that stand for days where the first order column is a number.
NUMBERS = 65_536
#: Characters at the start of a string that stand for its day.
PREFIX = 4


def _with_day(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with __day: of an instant its day, of a number its range, of a string its first characters; other types are refused."""
    kind, c = dict(df.dtypes)[order[0]], F.col(order[0])
    if kind.startswith("timestamp") or kind == "date":
        day = F.to_date(c)
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        day = F.floor(c / NUMBERS)
    elif kind == "string":
        day = F.substring(c, 1, PREFIX)
    elif kind == "boolean":
        day = c
    else:
        raise TypeError(f"rows are not ordered by {order[0]}: {kind} has no ranges")
    return df.withColumn("__day", day)


def _carried(rows: DataFrame, days: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with the columns that days have beside by and __day."""
    keys = [*by, "__day"]
    other = days.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in days.columns if c not in keys])
    met = rows.join(other, [rows[k].eqNullSafe(other[f"__k{i}"]) for i, k in enumerate(keys)])
    return met.drop(*[f"__k{i}" for i in range(len(keys))])


def _over_days(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy("__day")


def previous(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str = "before") -> DataFrame:
    """df with a struct of columns of the row before, null for a location's first."""
    rows = _with_day(df, order)
    ends = rows.groupBy(*by, "__day").agg(F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*columns).alias("row"))).alias("end"))
    carry = ends.select(*by, "__day", F.lag("end.row").over(_over_days(by)).alias("__carry"))
    w = by_time([*by, "__day"], *order)
    met = _carried(rows, carry, by)
    return met.withColumn(name, F.when(F.row_number().over(w) > 1, F.lag(F.struct(*columns)).over(w)).otherwise(F.col("__carry"))).drop("__day", "__carry")


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the sum of value up to and with the row."""
    rows = _with_day(df, order)
    days = rows.groupBy(*by, "__day").agg(F.sum(value).alias("__sum"))
    carry = days.select(*by, "__day", F.coalesce(F.sum("__sum").over(_over_days(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__carry"))
    w = by_time([*by, "__day"], *order).rowsBetween(Window.unboundedPreceding, 0)
    return _carried(rows, carry, by).withColumn(name, F.col("__carry") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("__day", "__carry")


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "__n", total: str = "__total") -> DataFrame:
    """df with the row's number within its location, from 1, and the location's number of rows."""
    rows = _with_day(df, order)
    days = rows.groupBy(*by, "__day").agg(F.count("*").alias("__rows"))
    earlier = F.coalesce(F.sum("__rows").over(_over_days(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = days.select(*by, "__day", earlier.alias("__carry"), F.sum("__rows").over(Window.partitionBy(*by)).alias(total))
    return _carried(rows, carry, by).withColumn(name, F.col("__carry") + F.row_number().over(by_time([*by, "__day"], *order))).drop("__day", "__carry")


def lag_and_change(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], daytime: Column | None = None, scope: str = "full") -> DataFrame:
    """value_lag and value_change to the row before; scope 'daytime' filters first, 'full' lags over all rows and filters then."""
    if scope not in ("full", "daytime"):
        raise ValueError("scope is full or daytime")
    if daytime is not None and scope == "daytime":
        df = df.filter(daytime)
    out = previous(df, by, order, [value], "__before").withColumn(f"{value}_lag", F.col(f"__before.{value}")).drop("__before")
    out = out.withColumn(f"{value}_change", F.col(value) - F.col(f"{value}_lag"))
    return out.filter(daytime) if daytime is not None and scope == "full" else out


def runs(df: DataFrame, by: Sequence[str], flag: Column, order: Sequence[str], least: int = 3, ts: str = "ts") -> DataFrame:
    """by, run, first_ts, last_ts, n: maximal runs of rows where flag holds, of least rows or more."""
    w, over = by_time([*by, "__day"], *order), _over_days(by)
    rows = _with_day(df.withColumn("__flag", F.coalesce(flag, F.lit(False))), order)
    rows = rows.withColumn("__turn", F.when(F.row_number().over(w) > 1, (F.col("__flag") != F.lag("__flag").over(w)).cast("int")).otherwise(0))
    place = F.struct(*order)
    days = rows.groupBy(*by, "__day").agg(F.sum("__turn").alias("__turns"), F.min_by("__flag", place).alias("__first"), F.max_by("__flag", place).alias("__last"))
    # whether a day's first row turns depends on the last row of the day before
    days = days.withColumn("__begins", (F.col("__first") != F.coalesce(F.lag("__last").over(over), F.lit(False))).cast("int"))
    earlier = F.coalesce(F.sum(F.col("__turns") + F.col("__begins")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = days.select(*by, "__day", (earlier + F.col("__begins")).alias("__carry"))
    marked = _carried(rows, carry, by).withColumn("run", F.col("__carry") + F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("__flag").groupBy(*by, "run").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n")).filter(F.col("n") >= least)


def gaps(df: DataFrame, by: Sequence[str], order: Sequence[str], longer_minutes: float, ts: str = "ts") -> DataFrame:
    """by, after, until, minutes: neighbouring rows further apart than longer_minutes."""
    rows = previous(df.select(*dict.fromkeys([*by, *order, ts])), by, order, [ts], "__before")
    before = F.col(f"__before.{ts}")
    minutes = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 60e6
    return rows.select(*by, before.alias("after"), F.col(ts).alias("until"), minutes.alias("minutes")).filter(F.col("minutes") > longer_minutes)


def interpolate(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], limit: int, place: Column | None = None) -> DataFrame:
    """df with value's nulls filled between its neighbours, at most limit in a row; place: abscissa, row number by default.

    Leading nulls stay, of a long gap the first limit are filled, trailing nulls hold the last value for limit rows.
    """
    w = by_time([*by, "__day"], *order)
    rows = _with_day(df, order).withColumn("__r", F.row_number().over(w))
    rows = rows.withColumn("__here", F.when(F.col(value).isNotNull(), F.struct(F.col("__r").cast("long").alias("n"), (place if place is not None else F.lit(None)).cast("double").alias("x"), F.col(value).alias("v"))))
    days = rows.groupBy(*by, "__day").agg(F.count("*").alias("__rows"), F.max("__here").alias("__last"), F.min("__here").alias("__first"))
    before = Window.unboundedPreceding, -1
    days = days.withColumn("__before", F.coalesce(F.sum("__rows").over(_over_days(by).rowsBetween(*before)), F.lit(0)))

    def of(c: Column) -> Column:
        """A value's number within its location, its abscissa and itself."""
        n = c["n"] + F.col("__before")
        return F.when(c.isNotNull(), F.struct(n.alias("n"), (c["x"] if place is not None else n.cast("double")).alias("x"), c["v"].alias("v")))

    # what comes after is what came before in the opposite order, as a frame that runs to the end starts anew at every row
    back = Window.partitionBy(*by).orderBy(F.desc("__day")).rowsBetween(*before)
    carry = days.select(
        *by, "__day", "__before", F.last(of(F.col("__last")), ignorenulls=True).over(_over_days(by).rowsBetween(*before)).alias("__p0"),
        F.last(of(F.col("__first")), ignorenulls=True).over(back).alias("__q0"),
    )
    ahead = by_time([*by, "__day"], *[F.desc(c) for c in order])
    last = lambda over: F.last("__here", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))
    rows = _carried(rows.withColumns({"__b": last(w), "__a": last(ahead)}), carry, by)
    rows = rows.withColumns({"__p": F.coalesce(of(F.col("__b")), "__p0"), "__q": F.coalesce(of(F.col("__a")), "__q0"), "__n": F.col("__before") + F.col("__r")})
    rows = rows.withColumn("__x", place.cast("double") if place is not None else F.col("__n").cast("double"))
    between = F.col("__p.v") + (F.col("__q.v") - F.col("__p.v")) * (F.col("__x") - F.col("__p.x")) / (F.col("__q.x") - F.col("__p.x"))
    fill = F.when((F.col("__n") - F.col("__p.n") <= limit) & F.col("__p").isNotNull(), F.coalesce(F.when(F.col("__q.x") > F.col("__p.x"), between), F.col("__p.v")))
    return rows.withColumn(value, F.coalesce(value, fill)).drop("__n", "__r", "__before", "__x", "__day", "__here", "__p0", "__q0", "__p", "__q", "__a", "__b")


def tail_split(df: DataFrame, by: Sequence[str], order: Sequence[str], share: float = 0.2) -> DataFrame:
    """df with role 'val' for the last floor(share * n) rows of each key, one at least, else 'train'."""
    rows = numbered(df, by, order)
    last = F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("__total")))
    return rows.withColumn("role", F.when(F.col("__n") > F.col("__total") - last, "val").otherwise("train")).drop("__n", "__total")


def keep_one(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order; Spark limits each task to one row per key before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def every_nth(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    return numbered(df, by, order).filter((F.col("__n") - 1) % n == 0).drop("__n", "__total")


def history_best(df: DataFrame, by: Sequence[str], loss: str, epoch: str, tolerance: float = 1e-6, patience: int = 20) -> DataFrame:
    """df with best (the loss accepted last), improved (this row's is accepted), waited (rows since) and stopped.

    A loss is accepted if it is below the one accepted last by more than tolerance; a null loss is not. stopped: waited has
    come to patience at this row or an earlier one. Rows of a key are sorted by epoch in a partition and streamed, so a task
    holds one batch of a history, however long it is. Keys may be null; other columns are kept.
    """
    fields = [*df.schema.fields]
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "best double", "improved boolean", "waited int", "stopped boolean"])
    at = [df.columns.index(c) for c in by]
    here = df.columns.index(loss)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best, waited, stopped = None, None, 0, False
        for batch in batches:
            found: list[tuple] = []
            for *key, value in zip(*[batch.column(i).to_pylist() for i in [*at, here]]):
                if key != held:
                    held, best, waited, stopped = key, None, 0, False
                better = value is not None and (best is None or value < best - tolerance)
                best, waited = (float(value), 0) if better else (best, waited + 1)
                stopped = stopped or waited >= patience
                found.append((best, better, waited, stopped))
            if found:
                extra = [pa.array(c, t) for c, t in zip(zip(*found), (pa.float64(), pa.bool_(), pa.int32(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "best", "improved", "waited", "stopped"])

    return df.repartition(*by).sortWithinPartitions(*by, epoch).mapInArrow(fold, shape)


def dense_index(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """df with each row's place in the order, from 0 and without gaps; rows that agree in it are placed in any order.

    Rows are dealt in ranges of the order and sorted there, so a row's place in its range is known to its task; the rows
    of the ranges before it are one small row a range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = durable(ranged)  # ranges follow from a sample: they are drawn once
    part = F.shiftright("__id", 33)
    counts = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))  # as many rows as partitions
    met = ranged.join(F.broadcast(starts), part == F.col("__part"))
    return met.withColumn(name, F.col("__before") + (F.col("__id") - F.shiftleft("__part", 33))).drop("__id", "__part", "__before")


def splice(sources: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Union of the sources; where several have a key, the last source's row."""
    ranked = [s.withColumn("__rank", F.lit(i)) for i, s in enumerate(sources)]
    union = ranked[0]
    for r in ranked[1:]:
        union = union.unionByName(r)
    return keep_one(union, by, [F.desc("__rank")]).drop("__rank")
