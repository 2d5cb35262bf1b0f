"""BPE ids of whole texts and the texts of the ids again; long texts are encoded in halves and joined as a tree.

Texts of up to LEAF bytes are encoded where they are read. A longer one is cut at the strings of added tokens, and what
stands between them into halves of halves, at any character, until a leaf is no longer than LEAF: leaves are dealt to all
tasks. Sorted by text and leaf, they are joined pair by pair, the pairs pair by pair, and so on: at each join growing
windows around it are encoded again until both sides agree (ByteBpe.join). So no task encodes a whole long text, and what
one task holds of a text is its ids.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBpe, tokenizer_path
from .common import map_rows, table

LEAF = 32_768
#: Ids that are turned into bytes at a time.
BLOCK = 1 << 20


def halves(text: bytes, leaf: int) -> list[bytes]:
    """UTF-8 cut into halves of halves, each at a whole character, until none is longer than leaf (four bytes at least)."""
    leaf = max(leaf, 4)  # a character
    if len(text) <= leaf:
        return [text]
    at = next(i for k in range(4) for i in (len(text) // 2 - k, len(text) // 2 + k) if 0 < i < len(text) and text[i] & 0xC0 != 0x80)
    return halves(text[:at], leaf) + halves(text[at:], leaf)


class Tree:
    """Leaves in order, joined as soon as two of one height stand beside each other."""

    def __init__(self, bpe: ByteBpe):
        self._bpe, self._stack = bpe, []

    def add(self, ids: np.ndarray) -> None:
        height = 0
        while self._stack and self._stack[-1][0] == height:
            ids, height = self._bpe.join(self._stack.pop()[1], ids), height + 1
        self._stack.append((height, ids))

    def ids(self) -> np.ndarray:
        """All leaves' ids together; the tree is empty then."""
        ids = np.zeros(0, "<u4")
        while self._stack:
            ids = self._bpe.join(self._stack.pop()[1], ids)
        return ids


class Digest:
    """Number and digest of ids, and digest of the text they decode to; what is no UTF-8 decodes to U+FFFD."""

    def __init__(self, bpe: ByteBpe):
        self._bpe, self._n, self._ids, self._text, self._decoder = bpe, 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")

    def add(self, ids: np.ndarray) -> None:
        self._n += len(ids)
        self._ids.update(ids.tobytes())
        for at in range(0, len(ids), BLOCK):
            self._text.update(self._decoder.decode(self._bpe.bytes_of(ids[at : at + BLOCK])).encode())

    def row(self) -> tuple[int, str, str]:
        self._text.update(self._decoder.decode(b"", True).encode())
        return self._n, self._ids.hexdigest(), self._text.hexdigest()


RESULT = ("n_tokens", "ids_sha256", "decoded_sha256")


def encode_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every row.

    Ids are those of the file without special tokens added, as little-endian unsigned 32-bit integers; the text is decoded
    from them with special tokens kept. A null text counts as empty: no ids, digests of nothing. Repeated rows and null
    keys are rows of their own, other columns are dropped, an empty table gives no rows. tokenizer: path of a plain
    byte-level BPE file (others are refused), the same on every executor.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    long = F.octet_length("__text") > leaf

    def here(keys, texts, bpe):
        for k, t in zip(keys, texts):
            digest = Digest(bpe)
            digest.add(np.frombuffer(bpe.ids(t), "<u4"))
            yield (k, *digest.row())

    short = map_rows(rows.filter(~long), ["__key", "__text"], schema, here, lambda: ByteBpe(tokenizer))

    def cut(keys, numbers, texts, bpe):
        for k, n, t in zip(keys, numbers, texts):
            for at, (added, part) in enumerate(bpe.parts(t)):
                for i, piece in enumerate([part.encode()] if added else halves(part.encode(), leaf)):
                    yield (k, n, at, i, added, piece)

    # a row's number where it is read: rows that agree in everything stay apart
    numbered = rows.filter(long).withColumn("__row", F.monotonically_increasing_id())
    leaves = map_rows(numbered, ["__key", "__row", "__text"], f"k {kind}, row bigint, part int, leaf int, added boolean, piece binary", cut, lambda: ByteBpe(tokenizer))

    def encode(keys, numbers, parts, at, added, pieces, bpe):
        for k, n, p, i, a, piece in zip(keys, numbers, parts, at, added, pieces):
            yield (k, n, p, i, a, bpe.ids(piece.decode()) if a else bpe.plain(piece.decode()))

    encoded = map_rows(leaves.repartition("row", "part", "leaf"), ["k", "row", "part", "leaf", "added", "piece"], f"k {kind}, row bigint, part int, leaf int, added boolean, ids binary", encode, lambda: ByteBpe(tokenizer))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, held, tree, digest = ByteBpe(tokenizer), None, None, None

        def close() -> list[tuple]:
            digest.add(tree.ids())
            return [(held[0], *digest.row())]

        for batch in batches:
            done = []
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                k, n, part, ids, added = (c[i].as_py() for c in columns)
                if held is None or held[1] != n:
                    if held is not None:
                        done += close()
                    tree, digest, held = Tree(bpe), Digest(bpe), (k, n, part)
                elif held[2] != part:
                    digest.add(tree.ids())
                    held = (k, n, part)
                tree.add(np.frombuffer(ids, "<u4"))
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip((key, *RESULT), r)) for r in done], schema=arrow)
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((key, *RESULT), r)) for r in close()], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    ordered = encoded.repartition("row").sortWithinPartitions("row", "part", "leaf").select("k", "row", "part", "ids", "added")
    return short.unionByName(ordered.mapInArrow(join, schema))


def op13_bpe_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Number and digest of the byte-level BPE ids of every document, and the digest of the text decoded from them.

    Null texts are empty; rows of one doc_id are rows of their own; an empty table gives no rows.
    """
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
