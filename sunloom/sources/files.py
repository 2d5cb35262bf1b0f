"""File scans and sinks: CSV with preamble, sniffed separators, optional columns, arrays in Parquet, reports."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: str | StructType, sep: str = ",", **options) -> DataFrame:
    """CSV as UTF-8; bytes that are none are left out of the texts, as a lossy decoder does."""
    rows = spark.read.schema(schema).options(header=True, sep=sep, encoding="UTF-8", mode="PERMISSIVE", **options).csv(path)
    return rows.withColumns({c: F.replace(F.col(c), F.lit("\ufffd"), F.lit("")) for c, t in rows.dtypes if t == "string"})


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    """Paths of a folder's files, sorted by name; an error where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    glob = hadoop.Path(f"{folder.rstrip('/')}/{pattern}")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    paths = sorted(str(f.getPath().toString()) for f in found or [])
    if not paths:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return paths


def id_or_stem(df: DataFrame, column: str, path: Column | None = None) -> DataFrame:
    """df with column filled for the file a row comes from: the file's smallest id that is not null, else the file's stem.

    One row a file is aggregated and joined back.
    """
    path = path if path is not None else F.col("_metadata.file_path")
    rows = df.withColumn("__path", path)
    if column not in df.columns:
        rows = rows.withColumn(column, F.lit(None).cast("string"))
    ids = rows.groupBy("__path").agg(F.min(column).alias("__id"))
    stem = F.regexp_replace(F.element_at(F.split("__path", "/"), -1), r"\.[^.]*$", "")
    return rows.join(ids, "__path").withColumn(column, F.coalesce("__id", stem)).drop("__path", "__id")


def read_sniffed_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV whose separator (comma, semicolon, tab or bar) is guessed from the first line; a byte-order mark is dropped."""
    head = spark.read.text(path).limit(1).collect()
    if not head:
        return spark.createDataFrame([], schema)
    return read_csv(spark, path, schema, csv.Sniffer().sniff(head[0][0].lstrip("﻿"), delimiters=",;\t|").delimiter)


def read_preamble_csv(spark: SparkSession, path: str, columns: Sequence[str], row_pattern: str = r"^\d{4},", meta_pattern: str = "^NSRDB,", meta_field: int = 8) -> DataFrame:
    """CSV files with lines of metadata before the header.

    Rows are the lines that fit row_pattern, cut by the column order of the file's own header line (the one that starts
    with the first of columns). With them come file, and meta: the field of the metadata line. One row per data line.
    """
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_name"))
    heads = lines.groupBy("file").agg(
        F.max(F.when(F.col("value").startswith(f"{columns[0]},"), F.split("value", ","))).alias("__header"),
        F.max(F.when(F.col("value").rlike(meta_pattern), F.get(F.split("value", ","), F.lit(meta_field)))).alias("meta"),
    )
    rows = lines.filter(F.col("value").rlike(row_pattern)).withColumn("__cells", F.split("value", ",")).join(heads, "file")
    at = lambda name: F.array_position("__header", name) - 1
    cell = lambda name: F.when(at(name) >= 0, F.get("__cells", at(name).cast("int")))
    return rows.select("file", "meta", *[cell(c).alias(c) for c in columns])


def place_of_file(file: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a {lat}_{lon}_{year}.csv name."""
    part = lambda i: F.regexp_extract(file, r"^(-?[\d.]+)_(-?[\d.]+)_", i).try_cast("double")
    return part(1), part(2)


def with_optional(df: DataFrame, columns: dict[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """df with columns (name to type) added as nulls where they are missing, and without those of drop that are there."""
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.drop(*drop).withColumns(missing)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def write_rounded_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """A report: floating columns rounded, one file. For results of report size."""
    rounded = {c: F.round(c, digits) for c, t in df.dtypes if t in ("double", "float")}
    df.withColumns(rounded).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_vectors(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Dense rows as arrays of float in Parquet (array files themselves: arrays.NpySource)."""
    arrays = {c: F.col(c).cast("array<float>") for c, t in df.dtypes if t.startswith("array<")}
    writer = df.withColumns(arrays).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(table: DataFrame, path: str, title: str) -> None:
    """A text report: a title and one line per row, columns tab-separated, in the table's order. For results of report size."""
    spark = table.sparkSession
    head = spark.createDataFrame([(0, title), (1, "\t".join(table.columns))], "at long, value string")
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns])
    body = table.coalesce(1).select((F.monotonically_increasing_id() + 2).alias("at"), line.alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)
