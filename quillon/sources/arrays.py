"""Array files as tables (S5, S9, K6): a data source that reads .npy files and caches of them by ranges of rows.

`npy` reads one array file, or each of a folder: a row for each first index, (row long, value array), where a row's numbers
are one flat array. `array_cache` reads and writes a folder of parts: each part has an array file for each column, and for
a column of lists their numbers end to end and the offsets where each row's begin, so that any range of rows is found
without reading what lies before. A manifest is written last, by the commit: rows, types, and size and sha256 of each
file; a folder without one can't be read, and one with it can't be written to. A reader takes only the columns that its
schema names, checks the files of its own parts against the manifest before it gives a row, and each task opens its own
files. Paths are any that pyarrow's file systems open (a path without a scheme is local, which is shared where all see it).

Nulls can't be kept in such files: they are refused.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

PART_ROWS, TASK_ROWS = 65_536, 65_536
_NUMBERS = {T.LongType: "<i8", T.IntegerType: "<i4", T.ShortType: "<i2", T.FloatType: "<f4", T.DoubleType: "<f8", T.BooleanType: "|b1"}
_KINDS = {np.dtype(v): k for k, v in _NUMBERS.items()} | {np.dtype("u1"): T.ShortType, np.dtype("u2"): T.IntegerType, np.dtype("u4"): T.LongType, np.dtype("i1"): T.ShortType}


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def _header(stream) -> tuple[np.dtype, tuple[int, ...], int]:
    """Type, shape and where the numbers begin of an .npy file."""
    version = np.lib.format.read_magic(stream)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if fortran and len(shape) > 1:
        raise ValueError("an array in column order can't be read by rows")
    return dtype, shape, stream.tell()


def rows_of(path: str, lo: int, hi: int) -> np.ndarray:
    """The rows from lo to hi of an .npy file; nothing else of it is read."""
    fs, place = _at(path)
    with fs.open_input_file(place) as f:
        dtype, shape, start = _header(f)
        size = dtype.itemsize * int(np.prod(shape[1:], dtype=np.int64))
        f.seek(start + lo * size)
        return np.frombuffer(f.read((hi - lo) * size), dtype).reshape(hi - lo, *shape[1:])


def _shape(path: str) -> tuple[np.dtype, tuple[int, ...]]:
    fs, place = _at(path)
    with fs.open_input_file(place) as f:
        return _header(f)[:2]


def _sha(fs: pafs.FileSystem, place: str) -> str:
    digest = hashlib.sha256()
    with fs.open_input_stream(place) as f:
        while block := f.read(1 << 22):
            digest.update(block)
    return digest.hexdigest()


@dataclass
class _Rows(InputPartition):
    path: str
    lo: int
    hi: int
    first: int = 0


class NpySource(DataSource):
    """spark.read.format("npy").load(path): the rows of one array file, or of a folder's in order of name."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _files(self) -> list[str]:
        path = self.options["path"]
        fs, place = _at(path)
        if fs.get_file_info(place).type == pafs.FileType.Directory:
            found = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(place)) if i.base_name.endswith(".npy"))
            return [f"{path.rstrip('/')}/{n}" for n in found]
        return [path]

    def schema(self) -> T.StructType:
        found = self._files()
        if not found:
            raise FileNotFoundError(self.options["path"])
        return T.StructType([T.StructField("row", T.LongType()), T.StructField("value", T.ArrayType(_KINDS[_shape(found[0])[0].newbyteorder("=")]()))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _NpyReader(self._files(), to_arrow_schema(schema), int(self.options.get("rows", TASK_ROWS)))


class _NpyReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: pa.Schema, rows: int):
        self.paths, self.types, self.rows = paths, schema, rows

    def partitions(self) -> list[InputPartition]:
        out, first = [], 0
        for p in self.paths:
            n = _shape(p)[1][0]
            out += [_Rows(p, lo, min(n, lo + self.rows), first) for lo in range(0, n, self.rows)]
            first += n
        return out or [_Rows(self.paths[0], 0, 0)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        if part.hi > part.lo:
            flat = rows_of(part.path, part.lo, part.hi).reshape(part.hi - part.lo, -1)
            n, width = flat.shape
            whole = {"row": pa.array(np.arange(part.first + part.lo, part.first + part.hi)), "value": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(flat.reshape(-1)))}
            yield pa.RecordBatch.from_arrays([whole[f.name].cast(f.type) for f in self.types], schema=self.types)


class ArrayCache(DataSource):
    """spark.read / df.write.format("array_cache"): see the module. Options: path; rows (of a part, when written)."""

    @classmethod
    def name(cls) -> str:
        return "array_cache"

    def _manifest(self) -> dict:
        fs, place = _at(self.options["path"])
        with fs.open_input_stream(f"{place}/manifest.json") as f:
            return json.loads(f.read())

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self._manifest()["schema"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _CacheReader(self.options["path"], self._manifest(), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _CacheWriter(self.options["path"], schema, int(self.options.get("rows", PART_ROWS)))


@dataclass
class _Part(InputPartition):
    name: str
    rows: int
    files: dict


class _CacheReader(DataSourceReader):
    def __init__(self, path: str, manifest: dict, schema: T.StructType):
        self.path, self.manifest, self.names, self.types = path.rstrip("/"), manifest, schema.fieldNames(), to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        needed = lambda f: f.removesuffix(".npy").removesuffix(".offsets") in self.names
        return [_Part(p["name"], p["rows"], {f: told for f, told in p["files"].items() if needed(f)}) for p in self.manifest["parts"]] or [_Part("", 0, {})]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        fs, top = _at(self.path)
        for f, (size, sha) in part.files.items():
            place = f"{top}/{part.name}/{f}"
            if fs.get_file_info(place).size != size or _sha(fs, place) != sha:
                raise ValueError(f"{place} is not the file of the manifest")
        columns = []
        for field in self.types:
            values = rows_of(f"{self.path}/{part.name}/{field.name}.npy", 0, _shape(f"{self.path}/{part.name}/{field.name}.npy")[1][0])
            array = pa.array(values)
            if pa.types.is_list(field.type):
                offsets = rows_of(f"{self.path}/{part.name}/{field.name}.offsets.npy", 0, part.rows + 1)
                array = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), array)
            columns.append(array.cast(field.type))
        yield pa.RecordBatch.from_arrays(columns, schema=self.types)


@dataclass
class _Written(WriterCommitMessage):
    parts: list


class _CacheWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, rows: int):
        self.path, self.json, self.rows, self.run = path.rstrip("/"), schema.jsonValue(), rows, uuid.uuid4().hex[:12]
        for f in schema:
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if type(inner) not in _NUMBERS:
                raise TypeError(f"{f.name} is of no kind that an array file holds")
        self.kinds = {f.name: _NUMBERS[type(f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType)] for f in schema}
        fs, top = _at(self.path)
        if fs.get_file_info(f"{top}/manifest.json").type != pafs.FileType.NotFound:
            raise FileExistsError(f"{self.path} is published")

    def _part(self, table: pa.Table, name: str) -> dict:
        fs, top = _at(self.path)
        fs.create_dir(f"{top}/{name}", recursive=True)
        files = {}

        def put(file: str, values: np.ndarray) -> None:
            with fs.open_output_stream(f"{top}/{name}/{file}") as f:
                np.lib.format.write_array_header_1_0(f, np.lib.format.header_data_from_array_1_0(values))
                f.write(np.ascontiguousarray(values).tobytes())
            info = fs.get_file_info(f"{top}/{name}/{file}")
            files[file] = [info.size, _sha(fs, f"{top}/{name}/{file}")]

        for column, kind in self.kinds.items():
            array = table.column(column).combine_chunks()
            if array.null_count or (pa.types.is_list(array.type) and array.flatten().null_count):
                raise ValueError(f"{column} holds nulls")
            if pa.types.is_list(array.type):
                put(f"{column}.offsets.npy", np.cumsum([0, *array.value_lengths().to_pylist()], dtype=np.int64))
                array = array.flatten()
            put(f"{column}.npy", array.to_numpy(zero_copy_only=False).astype(kind))
        return {"name": name, "rows": table.num_rows, "files": files}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        at, task = 0, TaskContext.get()
        held: list[pa.RecordBatch] = []
        parts = []

        def flush() -> None:
            nonlocal held
            if held:
                # a task that runs again writes parts of its own; only those of the one that is committed are named
                parts.append(self._part(pa.Table.from_batches(held), f"part-{self.run}-{task.partitionId():06d}-{task.taskAttemptId()}-{len(parts):04d}"))
                held = []

        for batch in iterator:
            for lo in range(0, batch.num_rows, self.rows):
                piece = batch.slice(lo, self.rows)
                if held and at + piece.num_rows > self.rows:
                    flush()
                    at = 0
                held.append(piece)
                at += piece.num_rows
        flush()
        return _Written(parts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((p for m in messages if m is not None for p in m.parts), key=lambda p: p["name"])
        fs, top = _at(self.path)
        fs.create_dir(top, recursive=True)
        if fs.get_file_info(f"{top}/manifest.json").type != pafs.FileType.NotFound:
            raise FileExistsError(f"{self.path} is published")
        with fs.open_output_stream(f"{top}/.manifest.json") as f:
            f.write(json.dumps({"schema": self.json, "parts": parts}).encode())
        fs.move(f"{top}/.manifest.json", f"{top}/manifest.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, top = _at(self.path)
        if fs.get_file_info(top).type == pafs.FileType.Directory:
            for info in fs.get_file_info(pafs.FileSelector(top)):
                if info.base_name.startswith(f"part-{self.run}-"):
                    fs.delete_dir(info.path)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(NpySource)
    spark.dataSource.register(ArrayCache)
