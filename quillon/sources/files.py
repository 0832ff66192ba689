"""Spark data sources for NPZ archives and for sets of whole files.

``quillon_npz`` reads vectors: partitions are row ranges planned from the archives' headers, so a large archive is read by
many tasks, and row numbers go on over files in order of their names.  ``quillon_files`` writes one file a row (name,
content): tasks write into a folder of the job, and only the commit of the whole job moves files to their places, so that
a lost task or job leaves no half file under a final name.

Paths with a scheme go through pyarrow's file systems; without one they must be on storage that all executors mount.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quillon.sources.readers import load_array

ROWS = 100_000


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if ":" in path.split("/", 1)[0]:
        found, at = fs.FileSystem.from_uri(path if "://" in path else path.replace(":", "://", 1))
        return found, at.rstrip("/")
    return fs.LocalFileSystem(), path.rstrip("/")


def _header(archive: zipfile.ZipFile, key: str) -> tuple[tuple, np.dtype, int]:
    """Shape, type and length of the header of an array in an archive, without its data."""
    with archive.open(f"{key}.npy") as f:
        version = np.lib.format.read_magic(f)
        shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        return shape, kind, f.tell()


@dataclass
class RowRange(InputPartition):
    path: str
    first: int  # row number of the file's row ``low``
    low: int
    high: int
    whole: bool


class NpzReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.key, self.ids = options["path"], options.get("key", "word_reps"), options.get("ids")
        self.rows = int(options.get("rows", ROWS))

    def partitions(self):
        store, at = _place(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
        out, number = [], 0
        for name in sorted(x.path for x in found if x.path.endswith(".npz")):
            with store.open_input_file(name) as f, zipfile.ZipFile(f) as z:
                shape, kind, _ = _header(z, self.key)
            # Arrays of objects are one stream and can't be entered in the middle.
            step = max(1, shape[0] if kind.hasobject else self.rows)
            for low in range(0, shape[0], step):
                out.append(RowRange(name, number + low, low, min(low + step, shape[0]), kind.hasobject))
            number += shape[0]
        return out or [RowRange("", 0, 0, 0, True)]

    def read(self, part: RowRange):
        if not part.path:
            return
        store, _ = _place(self.path)
        with store.open_input_file(part.path) as f, zipfile.ZipFile(f) as z:
            if part.whole:
                v = [np.asarray(x, float) for x in load_array(z, self.key)]
            else:
                shape, kind, skip = _header(z, self.key)
                width = int(np.prod(shape[1:], dtype=int)) * kind.itemsize
                with z.open(f"{self.key}.npy") as member:
                    member.seek(skip + part.low * width)  # a jump where the member is stored as it is
                    raw = member.read((part.high - part.low) * width)
                v = np.frombuffer(raw, dtype=kind).reshape(part.high - part.low, -1).astype(float)
            n = load_array(z, self.ids)[part.low : part.high] if self.ids else np.arange(part.first, part.first + len(v))
        lists = pa.array([[None if c != c else c for c in row] for row in (x.tolist() for x in v)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(n, np.int64)), lists], names=["token_id", "v"])


class NpzSource(DataSource):
    """Options: path (a file or a folder), key (the array), ids (an array of row ids; default: row numbers), rows (a
    partition's)."""

    @classmethod
    def name(cls):
        return "quillon_npz"

    def schema(self):
        return "token_id long, v array<double>"

    def reader(self, schema):
        return NpzReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows):
        from pyspark import TaskContext

        store, at = _place(self.path)
        task = TaskContext.get()
        folder, names = f"{at}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}", []
        for row in rows:
            name = row["name"]
            if not name or name.startswith(("/", "_")) or ".." in name.split("/"):
                raise ValueError(f"no file name: {name!r}")
            to = f"{folder}/{name}"
            store.create_dir(to.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(to) as f:
                f.write(bytes(row["content"] or b""))
            names.append(name)
        return Written(folder, names)

    def commit(self, messages):
        store, at = _place(self.path)
        names = [n for m in messages if m for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a file name occurs twice")
        store.create_dir(at, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                if "/" in name:
                    store.create_dir(f"{at}/{name}".rsplit("/", 1)[0], recursive=True)
                store.move(f"{m.folder}/{name}", f"{at}/{name}")
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        store, at = _place(self.path)
        if store.get_file_info(f"{at}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{at}/{self.job}")


class FileSink(DataSource):
    """Columns name (relative path) and content (binary; null is an empty file); option path."""

    @classmethod
    def name(cls):
        return "quillon_files"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return FileWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make both sources known to a session."""
    spark.dataSource.register(NpzSource)
    spark.dataSource.register(FileSink)


def read_npz_rows(spark: SparkSession, path: str, key: str = "word_reps", ids: str | None = None, rows: int = ROWS) -> DataFrame:
    """(token_id, v) of the NPZ files at ``path``; NaN becomes null.  Without ``ids`` rows are numbered over all files."""
    register(spark)
    r = spark.read.format("quillon_npz").option("path", path).option("key", key).option("rows", rows)
    return (r.option("ids", ids) if ids else r).load()


def write_files(df: DataFrame, path: str) -> None:
    """Write (name, content) as files below ``path``, all or none; files of other names that are there stay."""
    register(df.sparkSession)
    df.select("name", "content").write.format("quillon_files").mode("append").option("path", path).save()


def write_npz_files(df: DataFrame, path: str, id_col: str = "token_id", vector_col: str = "v", rows: int = ROWS) -> None:
    """Real ``.npz`` files of at most ``rows`` vectors (arrays token_id and word_reps), named by partition and number.

    Vectors of one file must have one length; null components become NaN."""

    def run(batches):
        from pyspark import TaskContext

        task, k, held = TaskContext.get().partitionId(), 0, []
        for pdf in batches:
            held += list(zip(pdf[id_col], pdf[vector_col]))
            while len(held) >= rows:
                yield _archive(held[:rows], task, k)
                held, k = held[rows:], k + 1
        if held:
            yield _archive(held, task, k)

    write_files(df.select(id_col, vector_col).mapInPandas(run, "name string, content binary"), path)


def _archive(rows, task: int, k: int):
    import pandas as pd

    out = io.BytesIO()
    v = np.array([[np.nan if c is None else c for c in x] for _, x in rows], dtype=float)
    np.savez(out, token_id=np.array([i for i, _ in rows], dtype=np.int64), word_reps=v)
    return pd.DataFrame({"name": [f"part-{task:05d}-{k:05d}.npz"], "content": [out.getvalue()]})
