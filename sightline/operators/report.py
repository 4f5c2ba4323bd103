"""Aggregates and sentences of reports, counters of dashboards, numbered histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Categories of ids, and their ids of the next list (null: no category of its own any more).
CATEGORIES = {
    "A01:2021": ("Broken Access Control", "A01:2025"),
    "A02:2021": ("Cryptographic Failures", "A02:2025"),
    "A03:2021": ("Injection", "A05:2025"),
    "A04:2021": ("Insecure Design", "A04:2025"),
    "A05:2021": ("Security Misconfiguration", "A05:2025"),
    "A06:2021": ("Vulnerable and Outdated Components", "A06:2025"),
    "A07:2021": ("Identification and Authentication Failures", "A07:2025"),
    "A08:2021": ("Software and Data Integrity Failures", "A08:2025"),
    "A09:2021": ("Security Logging and Monitoring Failures", "A09:2025"),
    "A10:2021": ("Server-Side Request Forgery", None),
    "SECRET-001": ("Hard-coded Credentials", "A04:2025"),
}


def bucket(severity: Column) -> Column:
    """urgent, cleanup or advisory; null for an unknown severity."""
    return F.when(severity.isin("Critical", "High"), "urgent").when(severity == "Medium", "cleanup").when(severity == "Low", "advisory")


def category(finding_id: Column) -> Column:
    """struct(name, next_id) of a finding's id; nulls for unknown ids."""
    name = F.create_map(*[F.lit(x) for k, (n, _) in CATEGORIES.items() for x in (k, n)])
    later = F.create_map(*[F.lit(x) for k, (_, i) in CATEGORIES.items() if i for x in (k, i)])
    return F.struct(F.try_element_at(name, finding_id).alias("name"), F.try_element_at(later, finding_id).alias("next_id"))


def finding_groups(findings: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """By keys, id and severity: n, first (least order) and place among the groups of its keys and bucket, by first sight."""
    groups = findings.groupBy(*keys, "vulnerability_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).withColumn("bucket", bucket(F.col("severity")))
    w = W.partitionBy(*keys, "bucket").orderBy("first", "vulnerability_id", "severity")
    return groups.withColumn("place", F.row_number().over(w))


def fix_first(findings: DataFrame, keys: list[str], order: str = "ord", k: int = 3) -> DataFrame:
    """The first Critical and High findings in their own order, with place."""
    w = W.partitionBy(*keys).orderBy(order)
    return findings.filter(F.col("severity").isin("Critical", "High")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def outcome_line(decision: Column, critical: Column, high: Column, medium: Column, low: Column, by: Column, at: Column) -> Column:
    """One line on a scan by its decision (block, pass, advisory, failed, bypassed) from its counts; null for another decision."""
    n = critical + high + medium + low
    return (
        F.when(decision == "block", F.format_string("Security scan failed: %d Critical, %d High findings detected. Deployment blocked. See report artifact for details and patches.", critical, high))
        .when(decision == "pass", F.format_string("Security scan passed. %d Medium/Low findings noted — see report for details.", medium + low))
        .when(decision == "advisory", F.format_string("Security scan advisory: %d findings present but not blocking (confidence or verification threshold not met). See report.", n))
        .when(decision == "failed", "Security scan unavailable. Deployment allowed to proceed — scan manually before release.")
        .when(decision == "bypassed", F.format_string("Deployment gate bypassed by %s at %s. %d High/Critical findings were present at time of bypass.", by, at, critical + high))
    )


def plain_summary(verified: Column, top: Column, total: Column) -> Column:
    """The first sentence: verified Critical and High findings if any, else detected ones, else all."""
    return (
        F.when(verified > 0, F.concat(verified.cast("string"), F.lit(" verified critical or high-severity "), F.when(verified == 1, "issue").otherwise("issues"), F.lit(" were identified in this repository.")))
        .when(top > 0, F.concat(top.cast("string"), F.lit(" critical or high-severity findings were detected, though none have been verified.")))
        .otherwise(F.concat(total.cast("string"), F.when(total == 1, " finding").otherwise(" findings"), F.lit(" were identified, all medium severity or below.")))
    )


def voter_bucket(score: Column) -> Column:
    """A24: "1", "2", "3" or "4+"; null for less than one."""
    return F.when(score >= 4, "4+").when(score >= 1, score.cast("string"))


def voter_counts(clusters: DataFrame, score: str = "consensus_score") -> DataFrame:
    """Clusters by the number of their voters."""
    return clusters.groupBy(voter_bucket(F.col(score)).alias("voter_count")).agg(F.count(F.lit(1)).alias("n"))


def next_index(names: DataFrame, name: str, pattern: str, keys: list[str] = ()) -> DataFrame:
    """The number after the largest in names that match the pattern whole (group 1 is the number); 1 if none does."""
    n = F.regexp_extract(F.col(name), f"^(?:{pattern})$", 1).try_cast("long")
    return names.groupBy(*keys).agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_index"))


def enabled_count(flags: list[str], default: bool = True) -> Column:
    """How many flags are on; a flag without a value counts as its default."""
    return sum((F.coalesce(F.col(f), F.lit(default)).cast("int") for f in flags), F.lit(0))


def usage_of_calls(calls: DataFrame, keys: list[str], order: str, call_id: str = "call_id") -> DataFrame:
    """By keys the summed tokens and the calls' ids in order, comma-separated; null ids are left out."""
    ids = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(call_id).cast("string").alias("i")))), lambda x: x["i"]), lambda i: i.isNotNull())
    return calls.groupBy(*keys).agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.array_join(ids, ",").alias("call_ids"))
