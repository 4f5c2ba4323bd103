"""Exact deduplication with a heavy-hitter split (native).

Misra-Gries counters (``freqItems``) propose digests that may be frequent; an
exact count over only those rows verifies them, and the verified winners, at
most ``1 / support`` of them, are broadcast so that their copies are settled
map-side.  All other digests take one ordinary shuffled aggregation and join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: What normalisation deletes: the characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.translate(text, BLANKS, ""), 256))


def _winner() -> Column:
    return F.min(F.struct((-F.col("cp")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("uid")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, text_length, row_uid.

    Texts are equal when identical after deleting blanks; of equal texts the row
    with the most code points in its original text stays, then the smallest id
    (null ids come last), then one row of those that are the same in both.

    Null texts count as empty, and empty texts form one group like any other.
    Repeated rows are separate rows of one group, of which one is kept.  An empty
    table gives an empty result.  Other columns of ``docs`` are not read.
    """
    ws = Workspace(docs.sparkSession, "exact_dedup")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = ws.store(base.select("doc_id", _digest(F.col("t")).alias("sha"), F.length("t").cast("long").alias("cp"), F.monotonically_increasing_id().alias("uid")), "digests")
    least = max(2, math.ceil(support * rows.count()))
    proposed = rows.select(F.hex("sha").alias("h")).stat.freqItems(["h"], support).select(F.explode("h_freqItems").alias("h"))
    proposed = proposed.select(F.unhex("h").alias("sha"))
    # At most 1 / support counters, hence rows, by Misra-Gries.
    heavy = ws.store(rows.join(F.broadcast(proposed), "sha").groupBy("sha").agg(F.count(F.lit(1)).alias("n"), _winner().alias("w")).filter(F.col("n") >= least), "heavy")
    of_heavy = rows.join(F.broadcast(heavy), "sha")
    rest = rows.join(F.broadcast(heavy.select("sha")), "sha", "left_anti")
    groups = rest.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), _winner().alias("w"))
    of_rest = rest.join(groups, "sha")
    return of_heavy.unionByName(of_rest).select(
        "doc_id",
        F.col("w.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("uid") == F.col("w.uid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("cp").alias("text_length"),
        F.col("uid").alias("row_uid"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Frequent texts are cut map-side to the rows that look like the winner; the
    rest meet the kept keys in one shuffled join.  Rows that share id, text and
    length with the winner are the same document several times: one stays.
    """
    ws = Workspace(docs.sparkSession, "keep_first")
    decided = exact_dedup(docs, id_col, text_col, support)
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    per = decided.filter(same).groupBy(F.unhex("text_sha256").alias("__sl_sha"), F.col("doc_id").alias("__sl_id"), F.col("text_length").alias("__sl_len"))
    keys = ws.store(per.agg(F.bool_or("kept").alias("__sl_kept"), F.count(F.lit(1)).alias("__sl_same"), F.max("group_size").alias("__sl_size")).filter("__sl_kept").drop("__sl_kept"), "keys")
    least = max(2, math.ceil(support * docs.count()))
    # A text with at least that share of all rows: at most 1 / support of them.
    heavy = F.broadcast(keys.filter(F.col("__sl_size") >= least).select(F.col("__sl_sha").alias("__sl_h"), F.col("__sl_id").alias("__sl_hid"), F.col("__sl_len").alias("__sl_hlen")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumns({"__sl_d": _digest(text), "__sl_n": F.length(text).cast("long")}).join(heavy, F.col("__sl_d") == F.col("__sl_h"), "left")
    marked = marked.filter(F.col("__sl_h").isNull() | (F.col(id_col).eqNullSafe(F.col("__sl_hid")) & (F.col("__sl_n") == F.col("__sl_hlen"))))
    met = marked.join(keys, (F.col("__sl_d") == F.col("__sl_sha")) & F.col(id_col).eqNullSafe(F.col("__sl_id")) & (F.col("__sl_n") == F.col("__sl_len")))
    once = met.filter("__sl_same = 1")
    more = met.filter("__sl_same > 1").dropDuplicates(["__sl_sha", "__sl_id", "__sl_len"])
    return once.unionByName(more).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha AS text_sha256
FROM d
WINDOW w AS (PARTITION BY sha ORDER BY length(t) DESC, doc_id ASC NULLS LAST)
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
