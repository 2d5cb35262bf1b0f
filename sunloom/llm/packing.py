"""Packing: documents into token sequences of fixed length.

Documents become byte-level BPE ids, end in id END, and are cut into pieces of at most a sequence. Pieces are dealt to
random groups of about GROUP_PIECES, and each group packs its own by first-fit decreasing: pieces by falling length,
each into the first bin with room, found in a tournament tree over the bins' free capacities. Groups bound a task's
memory whatever the input's size, and keep the packing as tight as one group's is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBpe, tokenizer_path
from .common import map_rows, scratch

LENGTH, END = 2048, 1
GROUP_PIECES = 20_000
SEED = 17


def tokenize_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_ids: bool = True, as_bytes: bool = False) -> DataFrame:
    """key, start, length, doc_tokens, ids_crc32 and, if wanted, ids of every piece of every row.

    ids are an array of int, or little-endian unsigned 32-bit bytes if as_bytes is set.

    A null text counts as empty: its document is END alone. Repeated rows give repeated pieces; other columns are dropped;
    an empty table gives none. tokenizer: path of a byte-level BPE file, the same on every executor.
    """

    def body(keys, texts, bpe):
        end = np.array([END], "<u4").tobytes()
        for k, t in zip(keys, texts):
            ids = bpe.ids(t or "") + end
            for at in range(0, len(ids), 4 * length):
                piece = ids[at : at + 4 * length]
                yield (k, at // 4, len(piece) // 4, len(ids) // 4, zlib.crc32(piece), *([piece if as_bytes else np.frombuffer(piece, "<u4")] if with_ids else []))

    schema = f"{key} {dict(docs.dtypes)[key]}, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint" + f", ids {'binary' if as_bytes else 'array<int>'}" * with_ids
    return map_rows(docs.withColumns({"__key": F.col(key), "__text": F.col(text)}), ["__key", "__text"], schema, body, lambda: ByteBpe(tokenizer))


def first_fit_decreasing(lengths: Iterable[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, longest first, in the first bin with room.

    The bins are leaves of a tournament tree whose inner nodes hold the largest free capacity below; the first bin with
    room is found from the root, turning left wherever enough is free.
    """
    lengths = np.asarray(list(lengths), np.int64)
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError(f"lengths are from 1 to {capacity}")
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    free = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - free[node]
        free[node] -= need
        while node > 1:
            node //= 2
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
    return bins, offsets


def pack(pieces: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """pieces (with a column length) and for each its sequence_id and offset there, from 0 and without gaps.

    Columns of these names are replaced, all others kept. Ties and repeated pieces are pieces of their own; an empty
    table gives none; a length below 1 or above length raises.
    """
    # the number within the written table spreads even pieces that agree in everything
    table = f"{scratch(pieces.sparkSession, 'pieces')}/rows"
    pieces.withColumn("__row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(table)
    numbered = pieces.sparkSession.read.parquet(table)
    groups = max(1, -(-numbered.count() // GROUP_PIECES))
    # lengths alone are packed, so that a group's memory has no part of the ids; each piece is then met with its place
    rows = numbered.select("__row", "length", F.pmod(F.xxhash64("__row", F.lit(seed)), F.lit(groups)).cast("long").alias("__group"))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__row")
        bins, offsets = first_fit_decreasing(group["length"], length)
        return group.assign(sequence_id=(group["__group"].to_numpy() << 32) + bins, offset=offsets)[["__row", "sequence_id", "offset"]]

    places = rows.groupBy("__group").applyInPandas(fill, "__row bigint, sequence_id bigint, offset bigint")
    names = [*pieces.columns, *(c for c in ("sequence_id", "offset") if c not in pieces.columns)]
    return numbered.drop("sequence_id", "offset").join(places, "__row").select(*names)


def op2_pack(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 ids. A null text is its end id alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack(tokenize_pieces(docs, tokenizer_path(), as_bytes=True))
    # what the packed ids are, not what the tokenizer said of them
    found = {"length": (F.octet_length("ids") / 4).cast("long"), "ids_crc32": F.crc32("ids")}
    return packed.withColumns(found).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
