"""Corpus operators: size estimates and the budget under which files are read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import BUDGET_RISK_PREFIXES, risky
from ..functions.text import total_lines

CHARS_PER_TOKEN = 4
TOKEN_BUDGET = 150_000


def size_estimate(files: DataFrame, keys: list[str], content: str = "content", budget: int = TOKEN_BUDGET) -> DataFrame:
    """A11-A13 by keys: n_files, tokens (characters over four, floored), over_budget (strictly), n_lines."""
    chars = F.coalesce(F.sum(F.length(content)), F.lit(0))
    return files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.floor(chars / CHARS_PER_TOKEN).alias("tokens"),
        (chars > budget * CHARS_PER_TOKEN).alias("over_budget"),
        F.coalesce(F.sum(total_lines(F.col(content))), F.lit(0)).alias("n_lines"),
    )


def take_while_fits(items: Column, cap: Column | int) -> Column:
    """Of an ordered array<struct<size, ...>> those taken: each that still fits, skipping those that don't."""
    empty = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<boolean>").alias("taken"))

    def step(a, x):
        fits = a["total"] + x["size"] <= cap
        return F.struct((a["total"] + F.when(fits, x["size"]).otherwise(0)).cast("long").alias("total"), F.concat(a["taken"], F.array(fits)).alias("taken"))

    return F.aggregate(items, empty, step, lambda a: a["taken"])


def trim_to_budget(files: DataFrame, snapshot: str = "snapshot_id", path: str = "path", size: Column | None = None, priority: Column | None = None, budget: int = TOKEN_BUDGET) -> DataFrame:
    """B2: (snapshot, path, size, kept): risky paths first, then by path; a file that doesn't fit is skipped and smaller ones still tried.

    Only paths and sizes are shuffled, never contents; a snapshot's are sorted and stream
    through one task that holds a running total, so it may have any number of files.  A
    null size counts as 0.
    """
    size = F.length("content") if size is None else size
    first = risky(F.col(path), BUDGET_RISK_PREFIXES) if priority is None else priority
    listed = files.select(F.col(snapshot).alias("snapshot"), (~first).alias("last"), F.col(path).alias("path"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    ordered = listed.repartition("snapshot").sortWithinPartitions("snapshot", "last", "path", "size")
    cap = budget * CHARS_PER_TOKEN
    return ordered.mapInArrow(lambda batches: _fitting(batches, cap), T.StructType([*ordered.schema, T.StructField("kept", T.BooleanType())])).select("snapshot", "path", "size", "kept")


def _fitting(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """The batches with kept: whether a row still fits under its snapshot's total; a snapshot's rows come one after another."""
    at, total = object(), 0
    for batch in batches:
        out = []
        for snapshot, size in zip(batch.column("snapshot").to_pylist(), batch.column("size").to_pylist()):
            if snapshot != at:
                at, total = snapshot, 0
            out.append(total + size <= cap)
            total += size if out[-1] else 0
        yield batch.append_column("kept", pa.array(out, pa.bool_()))
