"""Files of a run as rows, written to a workspace under caps.

Which files may be written is decided in Spark: by their names, by their own size, and by
the size of a run so far, in the run's order (a file that doesn't fit is skipped, smaller
ones are still tried).  A data source writes what is admitted: each task into a staging
folder of its own, which a commit moves into place file by file and an abort deletes.
"""

from __future__ import annotations

import contextlib
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

PER_FILE = 2 * 1024 * 1024
PER_RUN = 200 * 1024 * 1024
STAGING = "_staging"


def name_fault(path: Column) -> Column:
    """Why a name can't be written (NUL, absolute, parent folder, empty), null if it can."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return (
        F.when(F.instr(path, "\u0000") > 0, "NUL in name")
        .when(path.startswith("/"), "absolute path")
        .when(F.array_contains(parts, ".."), "parent folder in path")
        .when(path.isNull() | (F.size(parts) == 0), "no name")
    )


def admit(files: DataFrame, run: str = "run", order: str = "ord", path: str = "path", content: str = "content", per_file: int = PER_FILE, per_run: int = PER_RUN) -> DataFrame:
    """``files`` (a run's rows told apart by ``order``) plus size (bytes in UTF-8) and fault, null for files to write.

    A null content counts as empty.  Only names' verdicts and sizes are shuffled for the running
    cap; a run streams in order through one task that holds one number, and rows meet their
    contents again by run and order.
    """
    size = F.octet_length(F.coalesce(F.col(content), F.lit(""))).cast("long")
    marked = files.withColumns({"size": size, "__sl_fault": F.coalesce(name_fault(F.col(path)), F.when(size > per_file, "file too large"))})
    narrow = marked.filter("__sl_fault IS NULL").select(F.col(run).alias("__sl_run"), F.col(order).alias("__sl_ord"), F.col("size").alias("__sl_size"))
    streamed = narrow.repartition("__sl_run").sortWithinPartitions("__sl_run", "__sl_ord")
    held = streamed.mapInArrow(lambda it: _over_cap(it, per_run), T.StructType([*streamed.schema, T.StructField("__sl_over", T.BooleanType())])).filter("__sl_over")
    met = marked.join(held.drop("__sl_size"), F.col(run).eqNullSafe(F.col("__sl_run")) & F.col(order).eqNullSafe(F.col("__sl_ord")), "left")
    fault = F.coalesce(F.col("__sl_fault"), F.when(F.col("__sl_over"), "run too large"))
    return met.withColumn("fault", fault).drop("__sl_fault", "__sl_run", "__sl_ord", "__sl_over")


def _over_cap(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """The batches with whether a row would take its run over the cap; such a row adds nothing."""
    at, total = object(), 0
    for b in batches:
        over = []
        for run, size in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if run != at:
                at, total = run, 0
            over.append(total + size > cap)
            total += 0 if over[-1] else size
        yield b.append_column("__sl_over", pa.array(over, pa.bool_()))


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: its folder, and the files below it."""

    folder: str
    names: list[str]


def _through_link(store: fs.FileSystem, root: str, name: str) -> bool:
    """Whether the name, or a folder on its way, is a symbolic link."""
    if not isinstance(store, fs.LocalFileSystem):
        return False
    at = root
    return any(os.path.islink(at := f"{at}/{p}") for p in name.split("/"))


class WorkspaceWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        #: Of this write; all its tasks stage below it.
        self.staging = f"{STAGING}/{uuid.uuid4().hex}"
        # Made once, by the driver: tasks never make it, so none can write after an abort took it away.
        store, root = self._open()
        store.create_dir(f"{root}/{self.staging}", recursive=True)

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = self._open()
        folder, names, made = f"{root}/{self.staging}/{uuid.uuid4().hex}", {}, set()

        def make(at: str) -> None:
            if at not in made:
                if at != folder:
                    make(at.rpartition("/")[0])
                store.create_dir(at, recursive=False)
                made.add(at)

        try:
            make(folder)
            for b in iterator:
                for run, path, content in zip(*(b.column(b.schema.names.index(n)).to_pylist() for n in ("run", "path", "content"))):
                    name = "/".join(p for p in f"{run}/{path}".split("/") if p not in ("", "."))
                    target = f"{folder}/{name}"
                    make(target.rpartition("/")[0])
                    with store.open_output_stream(target) as f:
                        f.write((content or "").encode("utf-8", "replace"))
                    names[name] = None
        except BaseException:
            # A task that fails leaves nothing.
            with contextlib.suppress(OSError):
                store.delete_dir(folder)
            raise
        return Staged(folder, list(names))

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = self._open()
        made: set[str] = set()
        for m in filter(None, messages):
            for name in m.names:
                if _through_link(store, root, name):
                    continue
                folder = f"{root}/{name}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                store.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*self._open())

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        """What this write staged goes, of lost and failed tasks too."""
        for _ in range(5):  # a task that isn't stopped yet can write while folders go
            try:
                store.delete_dir(f"{root}/{self.staging}")
            except FileNotFoundError:
                break
            except OSError:
                time.sleep(0.1)
        with contextlib.suppress(OSError):
            if not store.get_file_info(fs.FileSelector(f"{root}/{STAGING}")):
                store.delete_dir(f"{root}/{STAGING}")


class WorkspaceSink(DataSource):
    """Writes run, path, content to ``<option path>/<run>/<path>``; the rows are those that :func:`admit` finds no fault with."""

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return "run string, path string, content string"

    def writer(self, schema, overwrite: bool) -> WorkspaceWriter:
        return WorkspaceWriter({k.lower(): v for k, v in self.options.items()})


def write(files: DataFrame, root: str) -> None:
    """Write run, path, content below ``root``; other columns are not read.  A name that comes twice in a run is written once, from either row."""
    files.sparkSession.dataSource.register(WorkspaceSink)
    files.select(F.col("run").cast("string"), "path", "content").write.format("workspace").option("path", root).mode("append").save()
