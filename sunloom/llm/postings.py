"""Posting lists dealt to tasks: long lists without a task that grows, pairs only where components still differ.

A posting list is what an index files under one key (its columns LIST). A list of at most ``chunk`` nodes is one task's
work. A longer one is met twice. First every chunk is met by itself, together with LEADERS nodes (on average) that all of
the list's chunks share, so that a list of near copies is joined through its leaders by work in proportion to its length.
Then, components known, only lists that still hold several are met again: the nodes outside the list's largest component
(the rest) with each other and with that component, chunk by chunk. A pair within one component is not looked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes of a long list, on average, that are met with each of its chunks.
LEADERS = 32
#: Keys that are broadcast at most; beyond, the same join is shuffled.
MOST_BROADCAST = 500_000
#: Rows of one key are spread over so many sub-keys where they are joined to the key's own row.
SPREAD = 1024


def spread_join(rows: DataFrame, own: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined to own (one row a key) by key, without a task that holds all rows of one key.

    Rows of a key are spread by the hash of column ``by``; own's row goes to the sub-keys that occur, so that a key of few
    rows costs no copies. Nulls of key join nothing.
    """
    spread = rows.withColumn("__spread", F.pmod(F.xxhash64(by), SPREAD).cast("int"))
    parts = spread.select(key, "__spread").distinct().join(own, key)
    return spread.join(parts, [key, "__spread"]).drop("__spread")


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast where its counted rows are at most MOST_BROADCAST."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def narrow(df: DataFrame) -> DataFrame:
    """df in as many partitions as tasks run at a time where its counted rows are at most MOST_BROADCAST.

    What is joined to it then leaves few shuffle files, however many partitions the session asks for.
    """
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism) if df.count() <= MOST_BROADCAST else df


def deal_chunks(postings: DataFrame, lists: DataFrame, long: DataFrame | None, names: Sequence[str], node: str, chunk: int) -> DataFrame:
    """names, x, node, lead: each of lists (names, n) by its chunks x, the leaders (lead = 1) in all of them.

    long: the lists of more than chunk nodes, None if there are none. Postings of other lists, those of a single node, are
    dropped.
    """
    if long is None:
        return postings.join(lists.select(*names), list(names)).select(*names, F.lit(0).alias("x"), node, F.lit(0).alias("lead"))
    long = small(long.select(*names, F.col("n").alias("__n")))
    chunks = F.ceil(F.coalesce("__n", F.lit(1)) / chunk).cast("int")
    met = postings.join(long, list(names), "left").withColumn("__chunks", chunks)
    lead = (F.col("__chunks") > 1) & (F.pmod(F.xxhash64(F.col(node), F.lit(1)), F.coalesce("__n", F.lit(1))) < LEADERS)
    own = F.pmod(F.xxhash64(node), "__chunks").cast("int")
    met = met.withColumns({"lead": lead.cast("int"), "x": F.explode(F.when(lead, F.sequence(F.lit(0), F.col("__chunks") - 1)).otherwise(F.array(own)))})
    parts = lists.select(*names, F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / chunk).cast("int") - 1)).alias("x"))
    return met.join(parts, [*names, "x"]).select(*names, "x", node, "lead")


def deal_rest(members: DataFrame, names: Sequence[str], node: str) -> DataFrame:
    """names, x, y, node, root: members (names, node, root, weight) of lists with several components, met as the module says.

    weight: the share of a chunk that a node takes. Chunks of the rest are numbered from 0, those of the largest component
    from -1 downwards; a task (x, y) holds the chunks x and y, and looks for pairs of different roots.
    """
    parts = members.groupBy(*names, "root").agg(F.sum("weight").alias("w"))
    lists = parts.groupBy(*names).agg(F.max(F.struct("w", "root")).alias("most"), F.sum("w").alias("w"), F.count("*").alias("roots")).filter("roots > 1")
    several = F.col("w") > 1  # a list that fits into one chunk is one task, whatever its components
    chunks = lambda w: F.greatest(F.ceil(w), F.lit(1)).cast("int")
    lists = lists.select(
        *names, F.when(several, F.col("most.root")).alias("__most"), F.when(several, chunks(F.col("w") - F.col("most.w"))).otherwise(F.lit(1)).alias("__rests"),
        F.when(several, chunks(F.col("most.w"))).otherwise(F.lit(0)).alias("__mosts"),
    )
    met = members.join(small(lists), list(names))
    most = F.coalesce(F.col("root") == F.col("__most"), F.lit(False))
    at = F.when(most, -1 - F.pmod(F.xxhash64(node), "__mosts")).otherwise(F.pmod(F.xxhash64(node), "__rests")).cast("int")
    rests = F.sequence(F.lit(0), F.col("__rests") - 1)
    mosts = F.when(F.col("__mosts") > 0, F.sequence(-F.col("__mosts"), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    met = met.withColumns({"__at": at, "__other": F.explode(F.when(most, rests).otherwise(F.concat(rests, mosts)))})
    return met.select(*names, F.least("__at", "__other").alias("x"), F.greatest("__at", "__other").alias("y"), node, "root")
