"""Files behind an interface that lists folders and gives a file a request.

A data source: the driver lists folders (one request each) and deals the files to partitions
in batches; a task asks for its batch one file after the other, with a pause between two,
and decodes the answers.  A file that can't be had is a row with an error.  The base is an
http(s) address, or a folder of recorded answers (a Parquet table of path and answer, which
any file system that pyarrow knows can hold).
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TIMEOUT, PAUSE, ATTEMPTS, BATCH = 30.0, 0.2, 3, 100
SCHEMA = "path string, content string, error string"


class NotThere(LookupError):
    """The interface has no such path."""


#: What a source is: for a list of paths and where they are a function that has the answer for each of them, or raises NotThere.
Source = Callable[[list[str], dict[str, list[int]] | None], Callable[[str], str]]


def _over_http(base: str, ref: str, token: str | None) -> Source:
    headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})

    def ask(path: str) -> str:
        url = f"{base.rstrip('/')}/contents/{urllib.parse.quote(path)}?{urllib.parse.urlencode({'ref': ref})}"
        for attempt in range(ATTEMPTS):
            if attempt:
                time.sleep(2.0 ** (attempt - 1))
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT) as r:
                    return r.read().decode("utf-8", "replace")
            except urllib.error.HTTPError as e:
                fault = f"status {e.code}"
                if e.code in (401, 403, 404):
                    break
            except OSError as e:
                fault = f"no answer: {type(e).__name__}"
        raise NotThere(fault)

    return lambda paths, where: ask


class _Recorded:
    """Recorded answers: the driver reads the table's footers once and tells each task the row groups that may have its paths."""

    def __init__(self, base: str):
        self.base, self.index = base, None

    def __getstate__(self) -> dict:
        return {"base": self.base, "index": None}

    def where(self, paths: list[str]) -> dict[str, list[int]]:
        """Row groups by file; few of them where the table is in order of its paths."""
        if self.index is None:
            store, at = fs.FileSystem.from_uri(self.base)
            pieces = ds.dataset(at, filesystem=store, format="parquet").get_fragments()
            told = [(g.statistics and g.statistics.get("path"), piece.path, g.id) for piece in pieces for g in piece.row_groups]
            known = sorted((x["min"], x["max"], file, group) for x, file, group in told if x)
            reach = list(accumulate((x[1] for x in known), max))
            self.index = known, [x[0] for x in known], reach, [x[1:] for x in told if not x[0]]
        known, begins, reach, rest = self.index
        found = set(rest)
        for path in paths:
            k = bisect_right(begins, path) - 1
            while k >= 0 and reach[k] >= path:
                if known[k][1] >= path:
                    found.add(known[k][2:])
                k -= 1
        groups: dict[str, list[int]] = {}
        for file, group in sorted(found):
            groups.setdefault(file, []).append(group)
        return groups

    def __call__(self, paths: list[str], where: dict[str, list[int]] | None) -> Callable[[str], str]:
        store, _ = fs.FileSystem.from_uri(self.base)
        have: dict[str, str] = {}
        for file, groups in (where or {}).items():
            piece = ds.ParquetFileFormat().make_fragment(file, filesystem=store, row_groups=groups)
            table = piece.to_table(columns=["path", "answer"], filter=pc.field("path").isin(paths))
            have.update(zip(table.column("path").to_pylist(), table.column("answer").to_pylist()))

        def ask(path: str) -> str:
            if have.get(path) is None:
                raise NotThere("status 404")
            return have[path]

        return ask


def decoded(answer: dict) -> str:
    """The text of a file's answer: base64 with bytes that aren't UTF-8 replaced, else as it is."""
    if answer.get("encoding") == "base64":
        return base64.b64decode(answer.get("content") or "").decode("utf-8", "replace")
    return answer.get("content") or ""


@dataclass
class Paths(InputPartition):
    names: list[str]
    errors: list[tuple[str, str]]
    where: dict[str, list[int]] | None = None


class RemoteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        base, self.start = options["base"], options.get("start", "")
        web = base.startswith(("http://", "https://"))
        self.source = _over_http(base, options.get("ref", "HEAD"), options.get("token")) if web else _Recorded(base)
        self.where = (lambda paths: None) if web else self.source.where
        self.batch, self.pause = int(options.get("batch", BATCH)), float(options.get("pause", PAUSE if web else 0))

    def _answers(self, paths: list[str], where: dict[str, list[int]] | None) -> Iterator[tuple[str, object]]:
        """(path, answer) one after the other; a fault in place of an answer that can't be had."""
        ask = self.source(paths, where)
        for k, path in enumerate(paths):
            if k and self.pause:
                time.sleep(self.pause)
            try:
                yield path, json.loads(ask(path))
            except NotThere as fault:
                yield path, fault
            except ValueError:
                yield path, NotThere("answer is no JSON")

    def partitions(self) -> list[Paths]:
        files, errors, level = [], [], [self.start]
        while level:
            below = []
            for path, answer in self._answers(level, self.where(level)):
                if isinstance(answer, Exception):
                    errors.append((path, str(answer)))
                elif isinstance(answer, dict):
                    files += [path] if answer.get("type") == "file" else []
                else:
                    files += [x["path"] for x in answer if x.get("type") == "file"]
                    below += [x["path"] for x in answer if x.get("type") == "dir"]
            level = below
        batches = [files[i : i + self.batch] for i in range(0, len(files), self.batch)]
        parts = [Paths(names, [], self.where(names)) for names in batches]
        return parts + ([Paths([], errors)] if errors or not parts else [])

    def read(self, partition: Paths) -> Iterator[pa.RecordBatch]:
        rows = [(p, None, e) for p, e in partition.errors]
        for path, answer in self._answers(partition.names, partition.where):
            fine = isinstance(answer, dict) and answer.get("type") == "file"
            try:
                rows.append((path, decoded(answer), None) if fine else (path, None, str(answer) if isinstance(answer, Exception) else "not a file"))
            except ValueError:
                rows.append((path, None, "content is no base64"))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["path", "content", "error"])


class RemoteContents(DataSource):
    """path, content, error of all files below ``start``.

    Options: ``base``, ``start``, ``ref``, ``token``, ``batch`` (files a partition), ``pause``
    (seconds between two requests of a task).
    """

    @classmethod
    def name(cls) -> str:
        return "remote_contents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RemoteReader:
        return RemoteReader(dict(self.options))


def contents(spark: SparkSession, base: str, start: str = "", batch: int = BATCH, **options: str) -> DataFrame:
    """S3: every file below ``start``, listed folder by folder."""
    spark.dataSource.register(RemoteContents)
    return spark.read.format("remote_contents").options(base=base, start=start, batch=str(batch), **options).load()


_FILES = T.ArrayType(T.StructType([T.StructField("filename", T.StringType()), T.StructField("patch", T.StringType())]))


def diff_files(compared: DataFrame, answer: Column, *keys: str) -> DataFrame:
    """Keys, path, patch of the files of comparison answers (JSON); files without name or patch are left out."""
    files = F.from_json(answer, T.StructType([T.StructField("files", _FILES)]))["files"]
    rows = compared.select(*keys, F.explode(files).alias("__sl_f"))
    return rows.select(*keys, F.col("__sl_f.filename").alias("path"), F.col("__sl_f.patch").alias("patch")).filter("path <> '' AND patch IS NOT NULL")
