"""What the training-data operators share: table reading, checkpoints and a few column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import checkpoint_folder, durable, remove, scratch  # noqa: F401  (what the operators take from here)

#: White space that separates words in the operators' contracts, as a regular expression class.
BLANK = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Rows that a Python task holds as objects at a time, whatever Arrow sends.
SLICE = 256


def map_rows(df: DataFrame, columns: list[str], schema: str, body: Callable[..., Iterator[tuple] | list[tuple]], once: Callable[[], object] | None = None) -> DataFrame:
    """Rows of schema from rows of columns: body(lists of values by column[, once()]) yields output tuples.

    Arrow batches are cut into slices of SLICE rows, so that memory does not grow with a partition; once() makes what a
    task needs for all of its rows (an automaton, a tokenizer).
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        extra = () if once is None else (once(),)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = list(body(*[part.column(i).to_pylist() for i in range(len(columns))], *extra))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), fields)], schema=fields)

    return df.select(*columns).mapInArrow(run, schema)
