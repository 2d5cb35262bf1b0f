"""A training corpus from raw documents: quality rules, near-dedup, secrets out, source mix, packing.

Each stage takes all rows its predecessor kept, as (spark, docs, sf_dir), and returns a DataFrame; the last one's rows are
the packed pieces, those before return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.llm import mixing, nearcopies, packing, quality, secrets
from sunloom.llm.common import checkpoint_folder

POLICY = "web-1"


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the policy.

    A null or empty text has no words, fails and goes. Each row is judged by itself: ties and repeated rows stay or go
    alike, a null id is kept as it is. All columns come back, whatever their names; an empty table stays empty.
    """
    entries = quality.ledger(docs.withColumn("__entry", F.struct(*docs.columns)))
    return quality.apply_policy(entries, POLICY).select("__entry.*")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the one with the smallest doc_id.

    Pairs come from the SimHash index of op1_simhash and from wider fingerprints for what is further apart; all are verified.
    Null and empty texts are copies of each other. Rows that share a doc_id are one document, of which one row can stay;
    a row of a null doc_id takes part in no group's choice and stays. All columns come back, map columns and clashing
    names included; an empty table stays empty.
    """
    return nearcopies.drop_near_copies(docs)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark; n_chars follows the text.

    A null text stays null, with a null n_chars; an empty one stays empty. Each row is treated by itself, so repeated rows
    stay repeated and null ids stay. All columns come back; an empty table stays empty.
    """
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in its order.

    A null source is a source of its own. Texts without words (null, empty, blank) are not taken. Rows that agree in
    doc_id, source and number of words (repeated rows, null ids) take the copies of their places in turn. All columns come
    back, whatever their names; an empty table stays empty.
    """
    return mixing.mixture(docs)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids (little-endian unsigned 32-bit bytes) and their places in sequences.

    A null or empty text is its end id alone. Repeated rows and null ids are packed row by row; other columns are dropped;
    an empty table gives no pieces.
    """
    return packing.pack(packing.tokenize_pieces(docs, packing.tokenizer_path(), as_bytes=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stage_quality),
    ("near_dedup", stage_near_dedup),
    ("secret_scan", stage_secrets),
    ("mix_sources", stage_mix),
    ("pack", stage_pack),
]

#: None: SQL has neither the SimHash search nor the tokenizer; stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage but the last is written to the shared checkpoint folder and read again.

    A stage's table goes when the next one stands; the last one stays, as the rows returned are read from it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, written = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if written:
            remove(spark, written)
        written = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
