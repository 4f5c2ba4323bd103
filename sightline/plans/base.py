"""What the query catalogues share: the registry and the stand-in tables.

The tables stand in for the engine's own: ``lineitem`` for findings, ``orders`` for runs,
``events`` for audit and usage rows, ``documents`` for files, ``customer``, ``nation``
and ``region`` for users, groups and permissions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function by its name, with its SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# ---- stand-ins -------------------------------------------------------------------------

FINDINGS = """
f AS (SELECT l_orderkey AS scan_id, CAST(l_linenumber AS BIGINT) AS ord, l_partkey, l_suppkey,
  CASE WHEN l_quantity >= 45 THEN 'Critical' WHEN l_quantity >= 30 THEN 'High' WHEN l_quantity >= 12 THEN 'Medium' ELSE 'Low' END AS severity,
  CASE WHEN l_discount >= 0.06 THEN 'High' WHEN l_discount >= 0.03 THEN 'Medium' ELSE 'Low' END AS confidence,
  CASE WHEN l_returnflag = 'R' THEN 'verified' WHEN l_returnflag = 'A' THEN 'unverified' WHEN l_tax >= 0.04 THEN 'conflicting' ELSE 'advisory_real' END AS verification_status
  FROM lineitem)
"""


def as_findings(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scan_id"),
        F.col("l_linenumber").cast("long").alias("ord"),
        "l_partkey",
        "l_suppkey",
        F.when(q >= 45, "Critical").when(q >= 30, "High").when(q >= 12, "Medium").otherwise("Low").alias("severity"),
        F.when(d >= 0.06, "High").when(d >= 0.03, "Medium").otherwise("Low").alias("confidence"),
        F.when(F.col("l_returnflag") == "R", "verified").when(F.col("l_returnflag") == "A", "unverified").when(F.col("l_tax") >= 0.04, "conflicting").otherwise("advisory_real").alias("verification_status"),
    )


FILES = """
d AS (SELECT doc_id, text, lang, source,
  CASE WHEN doc_id % 7 = 0 THEN 'tests/' WHEN doc_id % 7 = 1 THEN 'vendor/' WHEN doc_id % 7 = 2 THEN 'auth/' WHEN doc_id % 7 = 3 THEN 'api/v1/' ELSE '' END
  || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR)
  || CASE WHEN doc_id % 11 = 0 THEN '.py' WHEN doc_id % 11 = 1 THEN '.js' WHEN doc_id % 11 = 2 THEN '.min.js' WHEN doc_id % 11 = 3 THEN '.html' WHEN doc_id % 11 = 4 THEN '.env'
     WHEN doc_id % 11 = 5 THEN '.yaml.example' WHEN doc_id % 11 = 6 THEN '.sql' WHEN doc_id % 11 = 7 THEN '_test.py' ELSE '.txt' END AS path
  FROM documents)
"""


def as_files(spark, sf_dir):
    k7, k11 = F.col("doc_id") % 7, F.col("doc_id") % 11
    head = F.when(k7 == 0, "tests/").when(k7 == 1, "vendor/").when(k7 == 2, "auth/").when(k7 == 3, "api/v1/").otherwise("")
    ends = [".py", ".js", ".min.js", ".html", ".env", ".yaml.example", ".sql", "_test.py"]
    tail = F.lit(".txt")
    for i, e in enumerate(ends):
        tail = F.when(k11 == i, F.lit(e)).otherwise(tail)
    path = F.concat(head, F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), tail)
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", path.alias("path"))
