"""A folder as a data source that prunes before it reads.

The driver lists folders level by level and doesn't descend into skipped or ignored ones, so
what lies below them is neither listed nor opened; files that are left are dealt to
partitions by size and opened there.  Any file system that pyarrow knows can be read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ignore import Walk

# What a scan never reads.
SKIPPED_DIRS = [
    ".git",
    ".hg",
    ".svn",
    ".venv",
    "venv",
    "env",
    "node_modules",
    "__pycache__",
    ".mypy_cache",
    ".pytest_cache",
    ".ruff_cache",
    ".tox",
    "dist",
    "build",
    ".idea",
    ".vscode",
    "htmlcov",
    "vuln-result",
    "sec-report",
    "reports",
    "coverage",
    "test-results",
    "artifacts",
]
SKIPPED_NAMES = ["security-scan-report.md"]
SKIPPED_SUFFIX = ".patch"
IGNORE_FILE = ".gitignore"
MAX_FILE = 1_000_000

#: Bytes and files of a partition.
BATCH_BYTES, BATCH_FILES = 32_000_000, 2_000
SCHEMA = "path string, size long, content string"


@dataclass
class Files(InputPartition):
    """Paths below the root, with their sizes."""

    names: list[tuple[str, int]]


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.under = options.get("under", "").strip("/")
        self.max_size = int(options.get("maxsize", MAX_FILE))
        self.skip = set(json.loads(options["skip"])) if "skip" in options else set(SKIPPED_DIRS)
        self.given = json.loads(options["ignore"]) if "ignore" in options else None
        self.batch_bytes, self.batch_files = int(options.get("batchbytes", BATCH_BYTES)), int(options.get("batchfiles", BATCH_FILES))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def _ignore_lines(self, store: fs.FileSystem, base: str) -> list[str]:
        """The lines given, else those of the folder's own ignore file; one that can't be read drops nothing."""
        if self.given is not None:
            return self.given
        try:
            with store.open_input_file(f"{base}/{IGNORE_FILE}") as f:
                return f.read().decode().splitlines()
        except (OSError, UnicodeDecodeError):
            return []

    def listed(self) -> Iterator[tuple[str, int]]:
        """(path relative to the root, size) of the files that are to be read."""
        store, root = self._open()
        root = root.rstrip("/")
        base = f"{root}/{self.under}" if self.under else root
        walk = Walk(self._ignore_lines(store, base))
        level = [(base, walk.start())]
        while level:
            below = []
            for folder, state in level:
                try:
                    entries = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
                except OSError:
                    continue
                for e in sorted(entries, key=lambda e: e.base_name):
                    name, is_dir = e.base_name, e.type == fs.FileType.Directory
                    if is_dir and name in self.skip or not is_dir and (name in SKIPPED_NAMES or name.endswith(SKIPPED_SUFFIX)):
                        continue
                    inner = walk.step(state, name, is_dir)
                    if walk.drops(inner):
                        continue
                    if is_dir:
                        below.append((f"{folder}/{name}", inner))
                    elif e.type == fs.FileType.File and e.size <= self.max_size:
                        yield f"{folder}/{name}"[len(root) + 1 :], e.size
            level = below

    def partitions(self) -> list[Files]:
        out, names, size = [], [], 0
        for name, n in self.listed():
            names.append((name, n))
            size += n
            if size >= self.batch_bytes or len(names) >= self.batch_files:
                out.append(Files(names))
                names, size = [], 0
        return [*out, Files(names)] if names or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = self._open()
        rows, held = [], 0
        for name, size in partition.names:
            try:
                with store.open_input_file(f"{root.rstrip('/')}/{name}") as f:
                    text = f.read().decode()
            except (OSError, UnicodeDecodeError):  # gone meanwhile, not readable, not text
                continue
            # As text files are read: every end of line is a line feed.
            rows.append((name, size, text.replace("\r\n", "\n").replace("\r", "\n")))
            held += size
            if held >= 8_000_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    names, sizes, texts = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64()), pa.array(texts)], ["path", "size", "content"])


class PrunedFolder(DataSource):
    """path, size, content of the UTF-8 files below the option ``path``.

    Options: ``under`` (a folder below the path where the walk begins; its own ignore file
    counts), ``skip`` and ``ignore`` (JSON lists of folder names and ignore lines),
    ``maxSize``, ``batchBytes``, ``batchFiles``.
    """

    @classmethod
    def name(cls) -> str:
        return "pruned_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader({k.lower(): v for k, v in self.options.items()})


def scan(spark: SparkSession, root: str, max_size: int = MAX_FILE, skip: list[str] | None = None, ignore: list[str] | None = None, under: str = "", batch_files: int = BATCH_FILES) -> DataFrame:
    """Path (relative), size, content of the UTF-8 files below a folder; pruned folders are never listed, dropped files never opened.

    ``ignore`` are lines of an ignore file; None reads the folder's own.
    """
    spark.dataSource.register(PrunedFolder)
    how = {"path": root, "maxSize": str(max_size), "under": under, "batchFiles": str(batch_files), "skip": json.dumps(SKIPPED_DIRS if skip is None else skip)}
    if ignore is not None:
        how["ignore"] = json.dumps(list(ignore))
    return spark.read.format("pruned_folder").options(**how).load()
