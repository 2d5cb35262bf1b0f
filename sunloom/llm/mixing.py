"""Mixing sources to target weights: weighted fair queueing.

Every document gets a shuffled place within its source. Copy k of it finishes at the virtual time

    (k * source_size + words of the source up to and with the document) / target of the source

so at time 1 every source has given its target. Copies are range-sorted by finish time over all sources and truncated
at the total budget: a copy is taken if the words up to and with it fit.

Running sums never meet in one task: a source's shuffled order is cut into ranges of the shuffle key, and the global
order into ranges of finish time; sums per range are small, and only rows of one range are ordered together. A hot
source has as many ranges as its size asks for. Only scalars (rows, budget, the cut) pass through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, durable

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Rows of a range of the shuffled order, about.
RANGE_ROWS = 4_000
KEY_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(BLANK.replace("[", "[^", 1) + "+")), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, size: Column, seed: int = 0) -> Column:
    """A key of KEY_BITS bits, the same in every run: from MD5, which SQL engines share."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string"))), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) to (source, source_size, rank, target).

    Sources by code point, null last, weigh weights, repeating; they share the sum of all sizes, and targets stop at cap
    times the source's size, the excess reshared by weight until none is above. That is target = min(cap * size,
    level * weight), with the one level that uses the sum up; it lies where sources sorted by cap * size / weight stop
    being capped. One row per source: the only window over all of them, however many rows they have.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % n + 1).cast("int")))
    ranked = ranked.withColumns({"most": cap * F.col("source_size")}).withColumn("ratio", F.col("most").cast("double") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "rank")
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("double") / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("level", level)
    free = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)
    return levelled.withColumn("free", free).select("source", "source_size", "rank", F.least(F.col("most").cast("double"), F.coalesce(F.col("free.level") * F.col("weight"), F.col("most").cast("double"))).alias("target"))


def plan_mix(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", weights: Sequence[int] = WEIGHTS, seed: int = 0, count: Column | None = None) -> DataFrame:
    """key, source, size, source_size, target, copies, taken (copies * size), finish (time of the first copy; null without
    target) and number per row.

    A null source is a source, the last one; a null or empty text has size 0 and no copies. Rows that agree in key, source
    and size (repeated rows, null keys) share a shuffled place, are planned as one row of their count, and come out one
    after the other: number, from 1, is the row's place among them. An empty table gives none. count: of how many rows a row
    of docs stands for, one by default.
    """
    rows = docs.select(F.col(key).alias("__id"), F.col(source).alias("source"), size.alias("size"), (F.lit(1) if count is None else count).alias("n"))
    rows = rows.groupBy("__id", "source", "size").agg(F.sum("n").alias("n"))
    rows = durable(rows.withColumn("place", shuffle_key(F.col("__id"), F.col("size"), seed)))
    shift = max(0, (rows.count() // RANGE_ROWS).bit_length())
    rows = rows.withColumn("range", F.shiftright("place", KEY_BITS - shift))
    words = F.col("n") * F.col("size")
    ranges = rows.groupBy("source", "range").agg(F.sum(words).alias("words"))
    shares = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("before", F.coalesce(before, F.lit(0)))
    same = lambda a, b, *names: [a[x].eqNullSafe(b[x]) for x in names]
    ranges = ranges.join(shares, same(ranges, shares, "source")).select(ranges["source"], "range", "before", "source_size", "rank", "target")
    placed = rows.join(ranges, same(rows, ranges, "source", "range")).select(rows["*"], "before", "source_size", "rank", "target")
    order = Window.partitionBy("source", "range").orderBy("place", "__id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("before", F.col("before") + F.sum(words).over(order) - words)
    # as many rows as are repeated; those of a count over RANGE_ROWS are dealt as parts first
    parts = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / RANGE_ROWS) - 1)))
    parts = parts.filter(F.col("n") <= RANGE_ROWS).unionByName(parts.filter(F.col("n") > RANGE_ROWS).repartition("__id", "source", "size", "part"))
    number = F.explode(F.sequence(F.col("part") * RANGE_ROWS + 1, F.least("n", (F.col("part") + 1) * RANGE_ROWS)))
    placed = durable(parts.withColumn("number", number).withColumn("upto", F.col("before") + F.col("number") * F.col("size")).drop("n", "part", "before"))
    # copies in the global order, by ranges of finish time: those that start before time 1 hold the budget
    copies = placed.filter("size > 0 and target > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(MOST_COPIES - 1))))
    done = lambda k: F.try_divide((k * F.col("source_size") + F.col("upto")).cast("double"), F.col("target"))
    copies = copies.filter((F.col("k") * F.col("source_size") + F.col("upto") - F.col("size")) < F.col("target")).withColumn("finish", done(F.col("k")))
    copies = copies.withColumn("slot", F.floor(F.col("finish") * (1 << shift)))
    slots = copies.groupBy("slot").agg(F.sum("size").alias("words"))
    budget = shares.agg(F.sum("source_size")).first()[0] or 0
    running = F.sum("words").over(Window.orderBy("slot"))
    crossed = slots.withColumn("upto", running).filter(F.col("upto") > budget).orderBy("slot").limit(1).first()
    keys = ["finish", "rank", "place", "__id", "k"]
    taken = F.lit(MOST_COPIES)
    first_out = None
    if crossed:
        inside = copies.filter(F.col("slot") == crossed["slot"])
        inside = inside.withColumn("upto", F.lit(crossed["upto"] - crossed["words"]) + F.sum("size").over(Window.partitionBy("slot").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)))
        first_out = inside.filter(F.col("upto") > budget).orderBy(*keys).limit(1).select(*keys).first()
    fits = [F.lit(True)] * MOST_COPIES
    if first_out:

        def ahead(k: int) -> Column:
            out, same_so_far = F.lit(False), F.lit(True)
            for name, value in zip(keys, first_out):
                mine = {"finish": done(F.lit(k)), "k": F.lit(k)}.get(name, F.col(name))
                # nulls first, as in the order of the window
                less = mine < F.lit(value) if value is not None else F.lit(False)
                less = F.coalesce(less, mine.isNull()) if value is not None else less
                out, same_so_far = out | (same_so_far & less), same_so_far & mine.eqNullSafe(F.lit(value))
            return out

        fits = [ahead(k) for k in range(MOST_COPIES)]
    starts = [(F.lit(k) * F.col("source_size") + F.col("upto") - F.col("size")) < F.col("target") for k in range(MOST_COPIES)]
    count = sum((F.when(f & s, 1).otherwise(0) for f, s in zip(fits, starts)), F.lit(0))
    return placed.withColumn("copies", F.when((F.col("size") > 0) & (F.col("target") > 0), F.least(count, taken)).otherwise(0)).select(
        F.col("__id").alias(key), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), done(F.lit(0)).alias("finish"), "number"
    )


#: Rows that agree in key, source and size are numbered by so many parts, by the hash of their texts.
NUMBERED = 1024


def mixture(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[int] = WEIGHTS, seed: int = 0) -> DataFrame:
    """The rows of docs as the mix takes them: each as often as its copies say, range-sorted by finish time.

    Rows are found again by key, source and size; rows that agree in all three are interchangeable for the plan, are
    numbered by their texts' hashes, and take the copies of the plan's row of that number. Null texts have no words and are
    not taken. All columns of docs are kept, whatever their names, and no others; an empty table gives none.
    """
    group = lambda k, s, z: F.struct(k.alias("k"), s.alias("s"), z.alias("z"))  # noqa: E731  (never null: joins by plain equality)
    mine = docs.select(F.struct("*").alias("row"), group(F.col(key), F.col(source), word_count(F.col(text))).alias("g"), F.xxhash64(text).alias("h"))
    mine = mine.withColumn("part", F.pmod("h", NUMBERED))
    counts = durable(mine.groupBy("g", "part").agg(F.count("*").alias("rows")))
    plan = plan_mix(counts.select("g.*", "rows"), F.col("z"), "k", "s", weights, seed, F.col("rows")).filter("copies > 0")
    plan = plan.select(group(F.col("k"), F.col("source"), F.col("size")).alias("g"), F.col("number").alias("n"), "source_size", "target", "copies", "finish")
    earlier = F.sum("rows").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("g", "part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    mine = mine.withColumn("n", F.row_number().over(Window.partitionBy("g", "part").orderBy("h"))).join(counts, ["g", "part"])
    met = mine.select("row", "g", (F.col("n") + F.col("earlier")).alias("n")).join(plan, ["g", "n"])
    each = met.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    each = each.withColumn("at", F.col("finish") + F.col("copy") * F.col("source_size") / F.col("target"))
    return each.repartitionByRange("at", "g.k").sortWithinPartitions("at", "g.k").select("row.*")


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of sources takes. A null text has size 0; null sources are one source, the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan_mix(docs, word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken", "copies", "finish")


OP3_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
keyed AS (
  SELECT *, CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size), 1, {KEY_BITS // 4}) AS BIGINT) AS place FROM sized),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM sources),
weighed AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS most, CAST(3 * source_size AS DOUBLE) / ((rank - 1) % 3 + 1) AS ratio FROM ranked),
levelled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
shares AS (
  SELECT *, least(CAST(most AS DOUBLE), coalesce((SELECT level FROM levelled WHERE level < ratio ORDER BY ratio, rank LIMIT 1) * weight, CAST(most AS DOUBLE))) AS target FROM levelled),
placed AS (
  SELECT k.*, s.source_size, s.rank, s.target, CAST(sum(size) OVER (PARTITION BY k.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, row_number() OVER () AS rid
  FROM keyed k JOIN shares s ON k.source IS NOT DISTINCT FROM s.source),
copies AS (
  SELECT *, CAST(k * source_size + upto AS DOUBLE) / target AS done FROM placed, (VALUES (0), (1), (2)) c(k)
  WHERE size > 0 AND target > 0 AND k * source_size + upto - size < target),
taken AS (
  SELECT rid, count(*) AS n FROM (SELECT *, sum(size) OVER (ORDER BY done, rank, place, doc_id NULLS FIRST, k ROWS UNBOUNDED PRECEDING) AS used FROM copies)
  WHERE used <= (SELECT sum(source_size) FROM sources) GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(n, 0) * size AS BIGINT) AS taken, CAST(coalesce(n, 0) AS INTEGER) AS copies, CASE WHEN target > 0 THEN CAST(upto AS DOUBLE) / target END AS finish
FROM placed LEFT JOIN taken USING (rid)
"""
