"""Array files (.npy) as a Spark data source: format "npy", rows of a matrix as rows, read and written by ranges of rows.

    spark.dataSource.register(arrays.NpySource)
    spark.read.format("npy").load(path)            # row bigint, x array<float> (x float where the file has one dimension)
    df.select("x").write.format("npy").mode("append").save(folder)

A path is one file or a folder of files. A folder that was written here has an index of its parts, which is written last
and alone decides what is there; without one, all .npy files of a folder count, by name. Files are reached through
pyarrow's file systems, so a path may have a scheme.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

INDEX = "_parts.json"
#: Bytes of a read partition, and of a written file, about.
PART, FILE = 32 << 20, 64 << 20
# Fixed names of element types: of the file, and of Spark.
KINDS = {"f4": "float", "f8": "double", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "b1": "boolean"}


def _reach(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


@dataclass(frozen=True)
class Header:
    shape: tuple[int, ...]
    fortran: bool
    kind: str
    start: int

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))


def read_header(file) -> Header:
    """Shape, order, element type and where the elements begin; ValueError for what is no array of numbers."""
    head = io.BytesIO(file.read(65_536 + 12))
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if dtype.str[1:] not in KINDS or not shape:
        raise ValueError(f"no rows of numbers: {dtype} {shape}")
    return Header(tuple(shape), bool(fortran), dtype.str, head.tell())


def _parts(path: str) -> tuple[list[str], bool]:
    """Files of a path in order, and whether an index names them."""
    from pyarrow import fs

    store, at = _reach(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at], False
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if store.get_file_info(f"{at}/{INDEX}").type == fs.FileType.File:
        with store.open_input_stream(f"{at}/{INDEX}") as f:
            return [f"{at}/{p}" for p in json.loads(f.read())["parts"]], True
    found = sorted(i.path for i in store.get_file_info(fs.FileSelector(at)) if i.path.endswith(".npy"))
    return found, False


def _headers(path: str) -> list[tuple[str, Header]]:
    store, _ = _reach(path)
    found = []
    for p in _parts(path)[0]:
        with store.open_input_file(p) as f:
            found.append((p, read_header(f)))
    if not found:
        raise FileNotFoundError(f"no arrays in {path}")
    if len({(h.shape[1:], h.kind[1:]) for _, h in found}) > 1:
        raise ValueError("arrays of one table agree in width and type")
    return found


@dataclass
class Rows(InputPartition):
    path: str
    header: Header
    first: int  # number in the whole table of the file's first row
    lo: int
    hi: int


class NpyReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self._path, self._schema = path, schema

    def partitions(self) -> list[InputPartition]:
        found, first = [], 0
        for p, h in _headers(self._path):
            step = max(1, PART // max(1, h.width * int(h.kind[2:])))
            found += [Rows(p, h, first, lo, min(lo + step, h.shape[0])) for lo in range(0, h.shape[0], step)]
            first += h.shape[0]
        return found or [InputPartition(None)]  # a table without rows

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Rows):
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        h, size, n = part.header, int(part.header.kind[2:]), part.hi - part.lo
        store, _ = _reach(self._path)
        with store.open_input_file(part.path) as f:

            def take(at: int, count: int) -> np.ndarray:
                f.seek(h.start + at * size)
                return np.frombuffer(f.read(count * size), h.kind)

            if h.fortran:  # one stretch a column
                values = np.stack([take(c * h.shape[0] + part.lo, n) for c in range(h.width)], axis=1)
                if len(h.shape) > 2:  # rows flatten with the last dimension fastest, columns of the file have the first
                    values = values.reshape(n, *h.shape[:0:-1]).transpose(0, *range(len(h.shape) - 1, 0, -1)).reshape(n, -1)
            else:
                values = take(part.lo * h.width, n * h.width).reshape(n, h.width)
        values = np.ascontiguousarray(values).astype(values.dtype.newbyteorder("="))
        rows = pa.array(np.arange(part.first + part.lo, part.first + part.hi, dtype=np.int64))
        flat = pa.array(values.ravel())
        x = flat if len(h.shape) == 1 else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h.width), flat)
        schema = to_arrow_schema(self._schema)
        yield pa.RecordBatch.from_arrays([rows, x.cast(schema.field("x").type)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    task: int
    files: list[str]


class NpyWriter(DataSourceArrowWriter):
    """Each task writes files of its own into a folder that no reader looks at; commit writes the index that names them."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        kinds = {k: f"<{n}" for n, k in KINDS.items()}
        if schema.fieldNames() != ["x"]:
            raise ValueError("an array has one column, x")
        of = schema["x"].dataType
        self._flat = of.typeName() != "array"
        inner = of if self._flat else of.elementType
        if inner.simpleString() not in kinds:
            raise ValueError(f"no array of {inner.simpleString()}")
        self._kind = kinds[inner.simpleString()]
        self._path, self._overwrite, self._run = path, overwrite, f"run-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context, (store, at) = TaskContext.get(), _reach(self._path)
        folder, files, held, size = f"{at}/{self._run}", [], [], 0
        store.create_dir(folder, recursive=True)

        def put() -> None:
            nonlocal held, size
            name = f"{self._run}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(files):06d}.npy"
            body = io.BytesIO()
            np.save(body, np.concatenate(held), allow_pickle=False)
            with store.open_output_stream(f"{at}/{name}") as f:
                f.write(body.getbuffer())
            files.append(name)
            held, size = [], 0

        width = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0)
            if x.null_count:
                raise ValueError("an array has no nulls")
            if not self._flat:
                lengths = set(x.value_lengths().to_pylist()) | ({width} if width is not None else set())
                if len(lengths) > 1 or x.flatten().null_count:
                    raise ValueError("rows of an array are of one length and without nulls")
                width = lengths.pop()
            values = (x if self._flat else x.flatten()).to_numpy(zero_copy_only=False).astype(self._kind)
            held.append(values if self._flat else values.reshape(batch.num_rows, width))
            size += held[-1].nbytes
            if size >= FILE:
                put()
        if held:
            put()
        return Written(context.partitionId(), files)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _reach(self._path)
        before = []
        if not self._overwrite:
            before, indexed = _parts(self._path)
            before = [p.removeprefix(f"{at}/") for p in before] if indexed else []
        parts = before + [f for m in sorted((m for m in messages if m), key=lambda m: m.task) for f in m.files]
        if len({(h.shape[1:], h.kind) for h in self._shapes(parts)}) > 1:
            self.abort(messages)
            raise ValueError("rows of an array are of one length")
        with store.open_output_stream(f"{at}/.{self._run}") as f:
            f.write(json.dumps({"parts": parts}).encode())
        store.move(f"{at}/.{self._run}", f"{at}/{INDEX}")

    def _shapes(self, parts: list[str]) -> Iterator[Header]:
        store, at = _reach(self._path)
        for p in parts:
            with store.open_input_file(f"{at}/{p}") as f:
                yield read_header(f)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, at = _reach(self._path)
        if store.get_file_info(f"{at}/{self._run}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self._run}")


class NpySource(DataSource):
    """Array files; option path is a file or a folder."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        header = _headers(self.options["path"])[0][1]
        kind = KINDS[header.kind[1:]]
        return f"row bigint, x {kind if len(header.shape) == 1 else f'array<{kind}>'}"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], schema, overwrite)
