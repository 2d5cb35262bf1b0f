"""Tables that are replaced whole: each version in a folder of its own, and a log whose last whole entry names the one that stands.

A version is staged where no reader looks, and stands once its entry is in the log: a file that is created if it is not
there, so of two writers one fails, and that counts if its line is whole. Whatever step a writer dies at, readers find the
version before or the new one. Folders that no entry names are removed by a later writer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DATA, LOG = "data", "log"


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _store(spark: SparkSession, path: str):
    target = _path(spark, path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    store, target = _store(spark, path), _path(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(target)) if store.exists(target) else []


def _entry(spark: SparkSession, path: str, name: str) -> str | None:
    """The folder that an entry names; None if its writer died before its line was whole."""
    line = _store(spark, path).open(_path(spark, path, LOG, name))
    try:
        text = bytes(line.readAllBytes()).decode()
    finally:
        line.close()
    return text.removesuffix("\n") if text.endswith("\n") else None


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Folder of every version in the log, by number."""
    found = {int(n): _entry(spark, path, n) for n in _names(spark, f"{path}/{LOG}") if n.isdigit()}
    return {k: v for k, v in found.items() if v}


def _stage(df: DataFrame, folder: str) -> None:
    df.write.parquet(folder)


def _enter(spark: SparkSession, path: str, number: int, folder: str) -> None:
    # create fails if the entry is there
    line = _store(spark, path).create(_path(spark, path, LOG, f"{number:012d}"), False)
    try:
        line.write(bytearray(f"{folder}\n".encode()))
    finally:
        line.close()


def _prune(spark: SparkSession, path: str, keep: int) -> None:
    """Remove versions before the last keep, entry first, and what earlier writers staged without entering it."""
    store, known = _store(spark, path), versions(spark, path)
    kept = sorted(known)[-keep:]
    for name in _names(spark, f"{path}/{LOG}"):
        if name.isdigit() and int(name) < kept[0]:
            store.delete(_path(spark, path, LOG, name), False)
    for folder in _names(spark, f"{path}/{DATA}"):
        # numbers are of the writers' turns: one that stages now has a later one
        if folder not in {known[k] for k in kept} and int(folder.split("-")[0]) <= kept[-1]:
            store.delete(_path(spark, path, DATA, folder), True)


def replace_table(df: DataFrame, path: str, keep: int = 2) -> int:
    """Make df the table at path, also where df reads that table; returns the version's number.

    The last ``keep`` versions stay readable (at least the one that stands). A writer that finds that another one has
    entered the same number raises FileExistsError, and nothing has changed. A folder that holds anything but versions is
    refused.
    """
    spark = df.sparkSession
    if other := [n for n in _names(spark, path) if n not in (DATA, LOG)]:
        raise ValueError(f"{path} is no versioned table: {', '.join(other[:5])}")
    number = max([0, *(int(n) for n in _names(spark, f"{path}/{LOG}") if n.isdigit())]) + 1
    folder = f"{number:012d}-{uuid.uuid4().hex}"
    _stage(df, f"{path}/{DATA}/{folder}")
    try:
        _enter(spark, path, number, folder)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            _store(spark, path).delete(_path(spark, path, DATA, folder), True)
            raise FileExistsError(f"version {number} of {path} was written by another") from e
        raise
    _prune(spark, path, max(1, keep))
    return number


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The version that stands, or the one of a number; FileNotFoundError without it."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no version {'' if version is None else version} of {path}")
    return spark.read.parquet(f"{path}/{DATA}/{known[max(known) if version is None else version]}")
