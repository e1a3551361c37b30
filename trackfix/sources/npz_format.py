"""NumPy archives as a data source: ``spark.read.format("npz")`` and ``df.write.format("npz")``.

An archive is read in ranges of frames, each a partition of its own, and never as one row. Archives are written
beside their folder first and moved there when all tasks have ended; a write that fails leaves nothing.
"""

from __future__ import annotations

import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from trackfix.sources.npz import TIDY

COORDINATES = {"pred_m": ("x", "y", "z"), "gt_m": ("gx", "gy", "gz"), "centers": ("cx", "cy", "cz")}
MASKS = {"pred_visible": "visible", "gt_valid": "measured"}


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, plain or with a scheme that Arrow's file systems know, and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def _header(stream) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read(stream)
    if by_column:
        raise ValueError("arrays of an archive must be in row order")
    return shape, kind


def _frames(archive: zipfile.ZipFile, name: str, first: int, last: int) -> np.ndarray:
    """Rows ``first`` to ``last`` along the frames of an array; what lies before is skipped in pieces, what lies behind is not read."""
    with archive.open(f"{name}.npy") as stream:
        shape, kind = _header(stream)
        row = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
        skip = first * row
        while skip:
            skip -= len(stream.read(min(skip, 1 << 20)))
        return np.frombuffer(stream.read((last - first) * row), kind).reshape(last - first, *shape[1:])


@dataclass
class FrameRange(InputPartition):
    path: str
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class NpzReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.frames = options["path"], int(options.get("framesPerPartition", 64))

    def partitions(self) -> list[InputPartition]:
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        files = [info] if info.is_file else system.get_file_info(pafs.FileSelector(path, recursive=True))
        out = []
        for f in sorted(f.path for f in files if f.is_file and f.extension == "npz"):
            with system.open_input_file(f) as raw, zipfile.ZipFile(raw) as archive, archive.open("pred_m.npy") as stream:
                n = _header(stream)[0][0]
            out += [FrameRange(f, lo, min(lo + self.frames, n)) for lo in range(0, n, self.frames)]
        return out or [FrameRange("", 0, 0)]

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _opened(self.path)
        with system.open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as archive:
            part = {name: _frames(archive, name, partition.first, partition.last) for name in (*COORDINATES, *MASKS)}
        for t in range(partition.last - partition.first):
            n = part["pred_m"].shape[1]
            columns = {"path": [partition.path] * n, "frame": np.full(n, partition.first + t, np.int32), "query": np.arange(n, dtype=np.int32)}
            for name, axes in COORDINATES.items():
                value = np.broadcast_to(part[name][t], (n, 3)).astype(float)
                columns |= {a: value[:, i] for i, a in enumerate(axes)}
            columns |= {column: part[name][t].astype(bool) for name, column in MASKS.items()}
            yield pa.RecordBatch.from_pydict({c.split()[0]: pa.array(columns[c.split()[0]]) for c in TIDY.split(", ")})


class NpzWriter(DataSourceArrowWriter):
    """One archive per ``path`` of the rows; a path's rows must be dealt to one task, as ``repartition("path")`` does."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.beside = f"{self.path}-unfinished-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        batches = list(iterator)
        rows = pa.Table.from_batches(batches).to_pandas() if batches else None
        names = []
        for path, own in rows.groupby("path") if rows is not None else ():
            own = own.sort_values(["frame", "query"])
            t, n = own["frame"].nunique(), own["query"].nunique()
            if len(own) != t * n:
                raise ValueError(f"{path} is no complete grid of frames and queries")
            arrays = {name: own[list(axes)].to_numpy(np.float32).reshape(t, n, 3) for name, axes in COORDINATES.items()}
            arrays["centers"] = arrays["centers"][:, 0]
            arrays |= {name: own[column].to_numpy(bool).reshape(t, n) for name, column in MASKS.items()}
            name = posixpath.basename(str(path)).removesuffix(".npz") + ".npz"
            system, folder = _opened(f"{self.beside}/{uuid.uuid4().hex}")
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{name}") as out:
                np.savez_compressed(out, **arrays)
            names.append(f"{folder}/{name}")
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [n for m in messages if m for n in m.names]
        names = [posixpath.basename(f) for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one path came from several tasks; repartition by path before writing")
        system, folder = _opened(self.path)
        if self.overwrite and system.get_file_info(folder).type == pafs.FileType.Directory:
            system.delete_dir_contents(folder)
        system.create_dir(folder, recursive=True)
        for f, name in zip(files, names, strict=True):
            system.move(f, f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _opened(self.beside)
        if system.get_file_info(folder).type == pafs.FileType.Directory:
            system.delete_dir(folder)


class NpzSource(DataSource):
    """Option ``framesPerPartition``: frames of an archive that a task reads (64)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return TIDY

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpzReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NpzWriter(dict(self.options), overwrite)


def register_npz(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(NpzSource)
