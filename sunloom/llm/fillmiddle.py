"""Fill-in-the-middle by secondary sort: pieces of documents keyed by document and place in the output.

A document's units (a word with the white space before it, or white space at the end) are cut at two of its borders into
prefix, middle and suffix, and these into pieces of whole units of about PIECE bytes. Pieces are dealt by document and
sorted by their place in the output within partitions, so that a task streams each output piece by piece into a digest
and holds no whole document. The same stream is read back: marks are found in what was put out, its pieces get their
places in the original text, and a second sort within the same partitions streams the restored text into its own digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import table

PIECE = 32_768
# Fixed values of the format: marks of prefix, suffix and middle, and their order in either form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Places of the parts in the original text.
RANK = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
#: Bytes of output that a batch holds at most, about.
BATCH = 4 << 20
_LAST = (1 << 62) - 1


def unit_ends(text: bytes) -> np.ndarray:
    """Where each unit of UTF-8 ends: words take the white space before them, white space at the end is a unit."""
    blank = _BLANK[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1 if len(text) else np.zeros(0, np.int64)
    return np.append(ends, len(text)) if len(text) else ends


def draw(key: object, seed: int = 42) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document's key; a null key draws as an empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def plan(text: bytes, ends: np.ndarray, drawn: tuple[int, int, int, int], rate: int = 50, spm: int = 80) -> tuple[str, int, int]:
    """Form, and the bytes after which prefix and middle end."""
    n = len(ends)
    low, high = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    at = lambda k: int(ends[k - 1]) if k else 0
    if not text or any(m in text for m in RANK) or drawn[2] % 100 >= rate:
        return "plain", 0, 0
    return "spm" if drawn[3] % 100 < spm else "psm", at(low), at(high)


def cuts(ends: np.ndarray, lo: int, hi: int, piece: int) -> Iterator[tuple[int, int]]:
    """Pieces of whole units within lo and hi, of at most piece bytes where a unit allows; a longer unit is cut too."""
    while lo < hi:
        k = int(np.searchsorted(ends, lo + piece, "right")) - 1
        to = min(hi, int(ends[k]) if k >= 0 and ends[k] > lo else lo + piece)
        yield lo, to
        lo = to


class Restore:
    """Output, fed in pieces, to (place in the original, bytes): marks are found wherever pieces are cut."""

    def __init__(self, form: str):
        self._wait, self._rank, self._at, self._held = list(ORDER.get(form, ())), 0, 0, b""

    def feed(self, data: bytes, last: bool = False) -> Iterator[tuple[int, bytes]]:
        data = self._held + data
        while self._wait and (found := data.find(self._wait[0])) >= 0:
            yield from self._give(data[:found])
            self._rank, self._at, data = RANK[self._wait.pop(0)], 0, data[found + 3 :]
        keep = 0 if last or not self._wait else min(2, len(data))  # a mark may have begun
        self._held = data[len(data) - keep :]
        yield from self._give(data[: len(data) - keep])

    def _give(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        if data:
            yield (self._rank << 48) + self._at, data
            self._at += len(data)


def _emit(schema: pa.Schema, rows: Iterator[tuple], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows of about BATCH bytes in column size."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += 64 + len(r[size] or b"")
        if total >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, piece: int = PIECE) -> DataFrame:
    """row, place, piece, key, n, form, prefix_chars, middle_chars: the output of every row in pieces, by place.

    place is the piece's offset in the output; the row of place -1 has no piece, but the key and the facts of the
    document, which are null elsewhere. rate: of 100 texts, how many are rearranged; spm: of 100 of those, how many begin
    with the suffix. A null text counts as empty, and is plain; an empty table gives no pieces.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"row bigint, place bigint, piece binary, key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(row: int, k: object, body: bytes) -> Iterator[tuple]:
        ends = unit_ends(body)
        form, a, b = plan(body, ends, draw(k, seed), rate, spm)
        chars = lambda s: len(s.decode())
        plain = form == "plain"
        yield row, -1, None, k, len(ends), form, None if plain else chars(body[:a]), None if plain else chars(body[a:b])
        parts = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(body))}
        sizes = {m: hi - lo for m, (lo, hi) in parts.items()}
        if plain:
            for lo, to in cuts(ends, 0, len(body), piece):
                yield row, lo, body[lo:to], None, None, None, None, None
            return
        at, starts = 0, {}
        for m in ORDER[form]:
            starts[m] = at
            at += 3 + sizes[m]
        for m, (first, end) in parts.items():  # as the text has them; the sort puts them in the output's order
            yield row, starts[m], m, None, None, None, None, None
            for lo, to in cuts(ends, first, end, piece):
                yield row, starts[m] + 3 + lo - first, body[lo:to], None, None, None, None, None

    # a row's number where it is read: rows that agree in everything stay apart
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    return rows.mapInArrow(lambda batches: _emit(arrow, (p for r in _rows(batches) for p in run(*r)), 2), schema)


def assemble(found: DataFrame) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row that has pieces.

    Both digests are streamed over pieces sorted within partitions: by place in the output, then by place in the text
    restored from it. A task holds one piece at a time.
    """
    kind = dict(found.dtypes)["key"]
    facts = f"key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string"
    middle = to_arrow_schema(StructType.fromDDL(f"row bigint, place bigint, piece binary, {facts}"))
    result = f"{facts}, restored_sha256 string"
    final = to_arrow_schema(StructType.fromDDL(result))
    none = (None,) * 6

    def output(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        row, head, digest, restore = None, None, None, None

        def close() -> Iterator[tuple]:
            yield from ((row, place, data, *none) for place, data in restore.feed(b"", True))
            yield (row, _LAST, None, *head, digest.hexdigest())

        for r, place, data, *about in _rows(batches):
            if place < 0:
                if row is not None:
                    yield from close()
                row, head, digest, restore = r, about, hashlib.sha256(), Restore(about[2])
            else:
                digest.update(data)
                yield from ((row, at, part, *none) for at, part in restore.feed(data))
        if row is not None:
            yield from close()

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        digest = hashlib.sha256()
        for _, place, data, *about in _rows(batches):
            if place == _LAST:
                yield (*about, digest.hexdigest())
                digest = hashlib.sha256()
            else:
                digest.update(data)

    dealt = found.repartition("row").sortWithinPartitions("row", "place")
    put_out = dealt.mapInArrow(lambda batches: _emit(middle, output(batches), 2), ", ".join(f"{f.name} {t}" for f, t in zip(middle, ("bigint", "bigint", "binary", kind, "bigint", "string", "bigint", "bigint", "string"))))
    # a row's pieces stay in their partition: sorted there again, not dealt again
    return put_out.sortWithinPartitions("row", "place").mapInArrow(lambda batches: _emit(final, restored(batches), 5), result)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row.

    Texts that are null, empty or hold a mark are plain, as are those that are not drawn: their output is the text. Form
    and cuts depend on seed and key alone, so repeated rows and rows that share a key are drawn alike, each a row of its
    own; a null key draws as an empty string. Other columns are dropped; an empty table gives no rows.
    """
    found = assemble(pieces(docs, key, text, seed, rate, spm))
    return found.withColumnRenamed("key", key)


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    """Every document rearranged to fill in its middle, and restored, as digests. Null texts are empty, and plain."""
    return fill_in_middle(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM drawn),
counted AS (SELECT *, CAST(len(u) AS BIGINT) AS n FROM units),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM counted),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts"""
