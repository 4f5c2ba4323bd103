"""Keeping rows of a table that an operator chose by id and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "__sl_"


def identity(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with __sl_tid, a hash that with the id tells a row; equal ids and texts are told apart by nothing."""
    return docs.withColumn(f"{MARK}tid", F.xxhash64(F.col(text_col).cast("string"), F.col(text_col).isNull()))


def keep_chosen(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` in ``chosen`` (id, tid, times), all columns kept.

    ``times`` is how many rows with that id and text were seen; where it is more than
    one a single row of them stays.  One shuffled join; hot ids are split by it.
    """
    keys = chosen.select(F.col("id").alias(f"{MARK}i"), F.col("tid").alias(f"{MARK}t"), F.col("times").alias(f"{MARK}n"))
    met = identity(docs, id_col, text_col).join(keys, (F.col(f"{MARK}tid") == F.col(f"{MARK}t")) & F.col(id_col).eqNullSafe(F.col(f"{MARK}i")))
    once = met.filter(f"{MARK}n = 1")
    more = met.filter(f"{MARK}n > 1").dropDuplicates([f"{MARK}t", f"{MARK}i"])
    return once.unionByName(more).select(*[F.col(f"`{c}`") for c in docs.columns])
