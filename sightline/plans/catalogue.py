"""Named queries over the driver tables, each with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.secrets import DETECTORS, redacted, secret_hits
from ..operators import context, corpus, findings, history
from ..sources import tools
from . import accounts, guarding, outputs, records, reviews, stores  # noqa: F401  (register their queries)
from .base import FINDINGS, FILES, ORACLES, QUERIES, as_files, as_findings, query, table


# ---- aggregates over history -----------------------------------------------------------


@query("""
SELECT repo, critical, high, medium, low, score FROM (
  SELECT repo, critical, high, medium, low, 4 * critical + 3 * high + 2 * medium + low AS score
  FROM (
    SELECT 'repo' || CAST(user_id % 50 AS VARCHAR) AS repo,
           CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS critical,
           CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS high,
           CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS medium,
           CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS low
    FROM events GROUP BY 1) s
  ORDER BY score DESC, repo LIMIT 10) t
WHERE score > 0
""")
def at_risk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels of scan history, weighted severity score by repository, the ten highest above zero."""
    e = table(spark, sf_dir, "events")
    severity = {"critical": "error", "high": "purchase", "medium": "signup", "low": "click"}
    flags = [(F.col("event_type") == kind).cast("long").alias(name) for name, kind in severity.items()]
    repo = F.concat(F.lit("repo"), (F.col("user_id") % 50).cast("string")).alias("repo")
    local = e.filter(F.col("user_id") % 2 == 0).select(repo, *flags)
    ci = e.filter(F.col("user_id") % 2 != 0).select(repo, *flags)
    sums = local.unionByName(ci).groupBy("repo").agg(*[F.sum(c).alias(c) for c in severity])
    scored = sums.withColumn("score", 4 * F.col("critical") + 3 * F.col("high") + 2 * F.col("medium") + F.col("low"))
    return scored.orderBy(F.desc("score"), "repo").limit(10).filter("score > 0")


@query("""
SELECT count(*) AS n_scans, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS n_recent,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS n_failed, CAST(coalesce(sum(CAST(o_totalprice AS BIGINT) % 7), 0) AS BIGINT) AS findings,
  count(DISTINCT CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_custkey END) AS active_users,
  count(DISTINCT CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 7 > 0 THEN o_custkey END) AS users_at_risk
FROM (SELECT *, 1 AS one FROM (SELECT o_orderstatus, o_orderdate, o_custkey, floor(o_totalprice) AS o_totalprice FROM orders))
""")
def dashboard_kpis(spark, sf_dir):
    """A1-A4."""
    o = table(spark, sf_dir, "orders")
    scans = o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"), (F.floor("o_totalprice") % 7).alias("findings"))
    return history.dashboard(scans, F.lit("1998-01-01").cast("timestamp_ntz"), failed="F")


@query("""
WITH s AS (SELECT o_custkey, o_custkey % 97 AS repo, CAST(floor(o_totalprice) AS BIGINT) % 11 = 0 AS critical, CAST(floor(o_totalprice) AS BIGINT) % 13 = 0 AS high FROM orders)
SELECT CAST(count(DISTINCT CASE WHEN o_custkey % 3 = 0 AND (critical OR high) THEN repo END) + count(DISTINCT CASE WHEN o_custkey % 3 <> 0 AND (critical OR high) THEN repo END) AS BIGINT) AS repos_at_risk FROM s
""")
def repos_at_risk(spark, sf_dir):
    """A4, F16: two channels' counts added."""
    o, n = table(spark, sf_dir, "orders"), F.floor("o_totalprice")
    scans = o.select("o_custkey", (F.col("o_custkey") % 97).alias("repo_url"), (n % 11 == 0).cast("int").alias("critical"), (n % 13 == 0).cast("int").alias("high"))
    return history.repos_at_risk(scans.filter("o_custkey % 3 = 0"), scans.filter("o_custkey % 3 <> 0"))


@query("""
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, max(ts) AS last_seen
FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1
""")
def user_activity(spark, sf_dir):
    """A5, F14."""
    e = table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("ts").alias("last_seen"))


@query("""
SELECT user_id, event_type, strftime(ts, '%Y-%m') AS year_month, round(sum(value), 4) AS value, count(*) AS scan_count, max(ts) AS last_updated
FROM events GROUP BY 1, 2, 3
""")
def monthly_usage_rollup(spark, sf_dir):
    """A8."""
    return history.monthly_rollup(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", ["value"]).withColumn("value", F.round("value", 4))


@query("""
SELECT user_id, strftime(ts, '%Y-%m') AS year_month, CAST(sum(event_id % 1000) AS BIGINT) AS input_tokens, count(*) AS scan_count, max(ts) AS last_updated
FROM events GROUP BY 1, 2
""")
def monthly_usage_upsert(spark, sf_dir):
    """The counters of even events plus those of odd ones equal those of all."""
    e = table(spark, sf_dir, "events").withColumn("input_tokens", F.col("event_id") % 1000)
    state = history.monthly_rollup(e.filter("event_id % 2 = 0"), ["user_id"], "ts", ["input_tokens"])
    delta = history.monthly_rollup(e.filter("event_id % 2 = 1"), ["user_id"], "ts", ["input_tokens"])
    return history.upsert_add(state, delta, ["user_id", "year_month"], ["input_tokens", "scan_count"], ["last_updated"])


@query("""
SELECT event_type, CAST(sum(event_id % 1000) AS BIGINT) AS input_tokens, CAST(sum(event_id % 100) AS BIGINT) AS output_tokens,
  round((sum(event_id % 1000) * coalesce(max(i), 0.0) + sum(event_id % 100) * coalesce(max(o), 0.0)) / 1000000, 6) AS cost
FROM events LEFT JOIN (VALUES ('click', 3.0, 15.0), ('view', 0.25, 1.25)) p(kind, i, o) ON event_type = kind GROUP BY 1
""")
def usage_cost(spark, sf_dir):
    """A20, A21, J16."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.col("event_id") % 1000).alias("input_tokens"), F.sum(F.col("event_id") % 100).alias("output_tokens"))
    prices = spark.sql("SELECT * FROM VALUES ('click', 3.0D, 15.0D), ('view', 0.25D, 1.25D) AS t(event_type, input_price, output_price)")
    return history.priced(e, prices, ["event_type"])


@query("""
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1
""")
def latest_config(spark, sf_dir):
    """W1."""
    return history.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query("""
SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'error'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1
""")
def latest_active(spark, sf_dir):
    """The latest row that isn't revoked."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return history.latest(e, ["user_id"], "event_id", F.col("event_type") != "error")


@query("SELECT event_id, ts, event_type, user_id FROM events WHERE event_type = 'error' AND CAST(user_id AS VARCHAR) ILIKE '%1%' ORDER BY ts DESC, event_id DESC LIMIT 101 OFFSET 100")
def audit_page(spark, sf_dir):
    """The second page of a hundred and one row more."""
    e = table(spark, sf_dir, "events").withColumn("user_email", F.col("user_id").cast("string"))
    e = history.audit_filter(e, "1", "error", ["click", "error", "purchase", "signup", "view"])
    return history.page(e.select("event_id", "ts", "event_type", "user_id"), [F.desc("ts"), F.desc("event_id")], 100, 1)


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus <> 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def recent_failed(spark, sf_dir):
    """The newest of both channels."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return history.newest([o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1")], "o_orderdate", "o_orderkey", 10)


@query("""
WITH b AS (SELECT user_id, ts, 1 AS c FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, ts, 0 FROM events WHERE event_type = 'view')
SELECT user_id, max(ts) AS ts, CASE WHEN max(CASE WHEN c = 1 THEN ts END) = max(ts) THEN 'first' ELSE 'second' END AS channel FROM b GROUP BY 1
""")
def last_scan(spark, sf_dir):
    """W7."""
    e = table(spark, sf_dir, "events")
    return history.last_across(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["user_id"], "ts")


@query("SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderkey % 5 <> 0 GROUP BY 1")
def retention_purge(spark, sf_dir):
    """What a purge by time and by key leaves."""
    o = table(spark, sf_dir, "orders")
    kept = history.retain(o, "o_orderdate", F.lit("1998-07-01").cast("timestamp_ntz"))
    left = history.delete_keys(kept, o.filter("o_orderkey % 5 = 0"), ["o_orderkey"])
    return left.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH u AS (SELECT c_custkey AS user_id, n_regionkey AS region, c_mktsegment = 'MACHINERY' AS admin FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT user_id, 'view_reports' AS permission FROM u WHERE region IN (1, 3) OR user_id IN (7, 11)
UNION ALL SELECT user_id, 'admin_access' FROM u WHERE region = 2 OR admin OR user_id IN (7, 11)
""")
def permission_check(spark, sf_dir):
    """Nations are groups, regions grant one permission or the other; one segment is of admins, who have but the second by role; two users are protected."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("user").alias("role"), F.col("c_nationkey").alias("group_id"))
    region = F.col("n_regionkey")
    grants = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_id"), F.when(region.isin(1, 3), "view_reports").when(region == 2, "admin_access").otherwise("other").alias("permission"))
    of = lambda p: history.permitted(users.select("user_id", "role"), users.select("user_id", "group_id"), grants, p, [7, 11]).withColumn("permission", F.lit(p))
    return of("view_reports").unionByName(of("admin_access"))


@query("""
SELECT n_nationkey AS group_id, n_name AS name, count(c_custkey) AS n_members, coalesce(string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment), '') AS permissions
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2
""")
def group_summary(spark, sf_dir):
    """J6."""
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("name"))
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "group_id")
    out = history.group_summary(groups, c, c.select("group_id", F.col("c_mktsegment").alias("permission")))
    return out.withColumn("permissions", F.array_join("permissions", ","))


@query("""
SELECT 'orders_without_customer' AS rule, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL
UNION ALL SELECT 'lines_without_order', count(*) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL
UNION ALL SELECT 'orders_repeated', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
""")
def integrity_checks(spark, sf_dir):
    """Foreign and primary keys, which Spark doesn't enforce."""
    o, c, l = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    rule = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
    a = rule("orders_without_customer", o.join(c, o.o_custkey == c.c_custkey, "left_anti"))
    b = rule("lines_without_order", l.join(o, l.l_orderkey == o.o_orderkey, "left_anti"))
    return a.unionByName(b).unionByName(rule("orders_repeated", o.groupBy("o_orderkey").count().filter("count > 1")))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'unknown' WHEN c_nationkey % 5 = 0 THEN 'revoked' WHEN event_id % 11 = 0 THEN 'mismatch'
  WHEN c_nationkey % 7 = 0 THEN 'expired' WHEN c_acctbal < 0 THEN 'inactive' ELSE 'ok' END AS outcome
FROM events JOIN customer ON c_custkey = 1 + user_id % (SELECT count(*) FROM customer)
""")
def token_ladder(spark, sf_dir):
    """J8."""
    c = table(spark, sf_dir, "customer")
    n = c.count()
    now = F.lit("2024-06-01").cast("timestamp_ntz")
    tokens = c.select(F.col("c_custkey").alias("token_id"), F.lit("h").alias("token_hash"), F.col("c_custkey").alias("user_id"), F.when(F.col("c_nationkey") % 5 == 0, now).alias("revoked_at"), F.when(F.col("c_nationkey") % 7 == 0, F.lit("2024-01-01")).otherwise(F.lit("2025-01-01")).cast("timestamp_ntz").alias("expires_at"))
    users = c.select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") >= 0).alias("is_active"))
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(1 + F.col("user_id") % n).alias("token_id"), F.when(F.col("event_id") % 11 == 0, "x").otherwise("h").alias("token_hash"))
    return history.token_outcome(e, tokens, users, now).select("event_id", "outcome")


@query("""
SELECT c_custkey AS user_id, c_nationkey AS group_id FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT DISTINCT c_custkey, c_nationkey FROM customer WHERE c_custkey % 3 = 0 AND c_acctbal > 0
""")
def membership_insert(spark, sf_dir):
    """Pairs are inserted only where absent, however often they are offered."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("group_id"), "c_acctbal")
    have = c.filter("user_id % 3 <> 0").drop("c_acctbal")
    offered = c.filter("c_acctbal > 0 OR user_id % 3 <> 0").drop("c_acctbal")
    return history.insert_absent(have, offered.unionByName(offered), ["user_id", "group_id"])


# ---- findings --------------------------------------------------------------------------

SUMMARY = f"""
WITH {FINDINGS},
g AS (SELECT scan_id, count(*) AS n,
  count(*) FILTER (WHERE severity = 'Critical') AS critical, count(*) FILTER (WHERE severity = 'High') AS high,
  count(*) FILTER (WHERE severity = 'Medium') AS medium, count(*) FILTER (WHERE severity = 'Low') AS low,
  CAST(least(100, sum(CASE severity WHEN 'Critical' THEN CASE WHEN verification_status = 'verified' THEN 18 ELSE 12 END
    WHEN 'High' THEN CASE WHEN verification_status = 'verified' THEN 8 ELSE 5 END
    WHEN 'Medium' THEN CASE WHEN verification_status = 'verified' THEN 3 ELSE 2 END ELSE 1 END)) AS BIGINT) AS score,
  count(*) FILTER (WHERE severity = 'Critical' AND verification_status = 'verified') AS cv,
  count(*) FILTER (WHERE severity = 'High' AND verification_status = 'verified') AS hv,
  count(*) FILTER (WHERE verification_status <> 'advisory_real' AND confidence = 'High' AND (severity = 'High' OR (severity = 'Critical' AND verification_status = 'verified'))) AS blocking,
  count(*) FILTER (WHERE verification_status = 'conflicting') AS conflicting,
  count(*) FILTER (WHERE verification_status = 'advisory_real') AS triaged,
  count(*) FILTER (WHERE severity IN ('Critical', 'High') AND confidence IN ('Medium', 'Low')) AS demoted
  FROM f GROUP BY 1)
"""


@query(SUMMARY + "SELECT scan_id, critical, high, medium, low FROM g")
def severity_pivot(spark, sf_dir):
    """A9."""
    return findings.scan_summary(as_findings(spark, sf_dir), ["scan_id"]).select("scan_id", "critical", "high", "medium", "low")


@query(SUMMARY + "SELECT scan_id, score, CASE WHEN score >= 81 THEN 'Critical Risk' WHEN score >= 51 THEN 'High Risk' WHEN score >= 21 THEN 'Medium Risk' ELSE 'Low Risk' END AS label FROM g")
def risk_score(spark, sf_dir):
    """A14, A15."""
    return findings.scan_summary(as_findings(spark, sf_dir), ["scan_id"]).select("scan_id", "score", "label")


@query(SUMMARY + "SELECT scan_id, CASE WHEN cv >= 3 THEN 'Critical' WHEN cv >= 1 OR hv >= 3 THEN 'High' WHEN hv >= 1 THEN 'Medium' ELSE 'Low' END AS complexity FROM g")
def remediation_complexity(spark, sf_dir):
    """A16."""
    return findings.scan_summary(as_findings(spark, sf_dir), ["scan_id"]).select("scan_id", "complexity")


@query(
    SUMMARY
    + """SELECT scan_id, CASE WHEN blocking > 0 THEN 'block' ELSE 'advisory' END AS decision,
  concat_ws(',', CASE WHEN scan_id % 9 = 0 THEN 'partial' END, CASE WHEN conflicting > 0 THEN 'conflicting' END, CASE WHEN demoted > 0 THEN 'demoted' END, CASE WHEN triaged > 0 THEN 'auto_triaged' END) AS warnings,
  CAST(critical + high > 0 AS INTEGER) AS exit_status FROM g"""
)
def gate_decision(spark, sf_dir):
    """F10, A18, A26, A29; every ninth scan was cut short."""
    return findings.scan_summary(as_findings(spark, sf_dir).withColumn("partial", F.col("scan_id") % 9 == 0), ["scan_id"]).select("scan_id", "decision", "warnings", "exit_status")


@query(f"""WITH {FINDINGS}
SELECT scan_id, ord, batch, min(severity) OVER (PARTITION BY scan_id, batch) = max(severity) OVER (PARTITION BY scan_id, batch) AS homogeneous FROM (
  SELECT scan_id, ord, severity, (row_number() OVER (PARTITION BY scan_id ORDER BY severity, ord) - 1) // 5 AS batch FROM f)""")
def batch_of_five(spark, sf_dir):
    """V1."""
    return findings.verdict_batches(as_findings(spark, sf_dir), ["scan_id"], by="severity").select("scan_id", "ord", "batch", "homogeneous")


@query(f"""WITH {FINDINGS},
v AS (SELECT scan_id * 10 + ord AS candidate_ord, CASE WHEN l_suppkey % 4 = 0 THEN 'false_positive' ELSE 'real' END AS verdict,
  CASE WHEN l_suppkey % 3 = 0 THEN lower(confidence) END AS c, l_partkey FROM f WHERE l_partkey % 5 <> 0)
SELECT f.scan_id * 10 + f.ord AS candidate_ord,
  CASE WHEN verdict IS NULL THEN 'unverified' WHEN verdict = 'false_positive' THEN 'dropped'
    WHEN coalesce(c, 'low') = 'high' OR (coalesce(c, 'low') = 'medium' AND f.l_partkey % 2 = 0) THEN 'verified'
    WHEN coalesce(c, 'low') = 'medium' THEN 'advisory_real' ELSE 'dropped' END AS route
FROM f LEFT JOIN v ON f.scan_id * 10 + f.ord = v.candidate_ord""")
def verdict_routing(spark, sf_dir):
    """V3: even parts lie on a risky path."""
    f = as_findings(spark, sf_dir).withColumn("candidate_ord", F.col("scan_id") * 10 + F.col("ord"))
    cand = f.select("candidate_ord", F.when(F.col("l_partkey") % 2 == 0, "auth/x.py").otherwise("lib/x.py").alias("file"))
    v = f.filter("l_partkey % 5 <> 0").select("candidate_ord", F.when(F.col("l_suppkey") % 4 == 0, "false_positive").otherwise("real").alias("verdict"), F.when(F.col("l_suppkey") % 3 == 0, F.col("confidence")).alias("confidence"))
    return findings.route_verdicts(cand, v, ["high"], ["medium"]).select("candidate_ord", "route")


@query(f"""WITH {FINDINGS},
c AS (SELECT l_suppkey, l_partkey % 40 AS kind, count(*) AS n, min(scan_id * 10 + ord) AS first FROM f WHERE severity IN ('Critical', 'High') GROUP BY 1, 2)
SELECT l_suppkey, kind, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, first, kind) AS INTEGER) AS rank FROM c) WHERE rank <= 2""")
def common_types(spark, sf_dir):
    """A17."""
    f = as_findings(spark, sf_dir).withColumns({"vulnerability_id": F.col("l_partkey") % 40, "ord": F.col("scan_id") * 10 + F.col("ord")})
    return findings.top_types(f, ["l_suppkey"]).select("l_suppkey", F.col("vulnerability_id").alias("kind"), "n", "rank")


@query(f"""WITH {FINDINGS},
a AS (SELECT scan_id, l_partkey % 3 AS action, min(struct_pack(s := CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END, u := verification_status <> 'verified', o := ord)) AS r FROM f GROUP BY 1, 2)
SELECT scan_id, action, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY r, action) AS INTEGER) AS rank FROM a""")
def first_actions(spark, sf_dir):
    """W11."""
    f = as_findings(spark, sf_dir).withColumn("action", F.col("l_partkey") % 3)
    return findings.first_actions(f, ["scan_id"]).select("scan_id", "action", "rank")


RULES = [("standard", "xss"), ("small-plated", "sqli"), ("small", "ssrf"), ("promo", "path_traversal"), ("economy", "command_injection"), ("large", "xxe")]


@query(f"""
SELECT p_partkey, lower(p_brand || '-' || p_type) AS raw_rule_id,
  coalesce((SELECT min_by(c, o) FROM (VALUES {", ".join(f"('{k}', '{c}', {i})" for i, (k, c) in enumerate(RULES))}) r(k, c, o) WHERE contains(lower(p_brand || '-' || p_type), k)),
    replace(replace(lower(p_brand || '-' || p_type), ' ', '_'), '-', '_')) AS vuln_class
FROM part
""")
def normalize_rule(spark, sf_dir):
    """J10."""
    raw = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat("p_brand", F.lit("-"), "p_type")).alias("raw_rule_id"))
    rules = spark.createDataFrame([(k, c, i) for i, (k, c) in enumerate(RULES)], "key string, vuln_class string, rule_ord int")
    return findings.normalize_rules(raw, rules)


@query("""
WITH e AS (SELECT user_id, event_type, CAST(floor(epoch(ts) / 60) AS BIGINT) AS lo, CAST(floor(epoch(ts) / 60) AS BIGINT) + event_id % 30 AS hi FROM events),
m AS (SELECT *, max(hi) OVER (PARTITION BY user_id, event_type ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, event_type, CAST(island AS BIGINT) AS island, CAST(min(lo) AS BIGINT) AS lo, CAST(max(hi) AS BIGINT) AS hi, count(*) AS n FROM i GROUP BY 1, 2, 3
""")
def consensus_sorted(spark, sf_dir):
    """B1 on input in line order: events as minutes."""
    lo = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).cast("long")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", lo.alias("lo0"), (lo + F.col("event_id") % 30).alias("hi0"))
    return findings.islands(e, ["user_id", "event_type"], "lo0", "hi0", 2)


@query(f"""
WITH {FINDINGS.strip()},
c AS (SELECT CAST(l_suppkey AS VARCHAR) AS file, severity AS cls, scan_id * 10 + ord AS o, CAST(l_partkey % 500 AS INTEGER) AS lo, CAST(l_partkey % 500 + ord % 3 AS INTEGER) AS hi, confidence AS tool, CAST(l_partkey AS VARCHAR) AS rid FROM f),
g AS (SELECT file, cls, list([struct_pack(lo := lo, hi := hi, o := o, tools := [tool], votes := 1)] ORDER BY o, lo, hi, tool, rid) AS cs FROM c GROUP BY 1, 2),
r AS (SELECT file, cls, unnest(list_reduce(cs, lambda a, b: CASE
  WHEN coalesce(list_position(list_transform(a, lambda x: greatest(x.lo, b[1].lo) <= least(x.hi, b[1].hi) + 2), true), 0) = 0 THEN list_concat(a, b)
  ELSE list_transform(a, lambda x, i: CASE WHEN i = list_position(list_transform(a, lambda y: greatest(y.lo, b[1].lo) <= least(y.hi, b[1].hi) + 2), true)
    THEN struct_pack(lo := least(x.lo, b[1].lo), hi := greatest(x.hi, b[1].hi), o := x.o, tools := CASE WHEN list_contains(x.tools, b[1].tools[1]) THEN x.tools ELSE list_concat(x.tools, b[1].tools) END, votes := x.votes + 1) ELSE x END) END)) AS k FROM g)
SELECT file, cls AS vuln_class, k.o AS ord, k.lo AS line_start, k.hi AS line_end, array_to_string(k.tools, ',') AS sources, CAST(len(k.tools) AS INTEGER) AS consensus_score, CAST(k.votes AS INTEGER) AS votes FROM r
""")
def consensus_input_order(spark, sf_dir):
    """B1, A10: order-dependent clusters."""
    f = as_findings(spark, sf_dir)
    cand = f.select(F.col("l_suppkey").cast("string").alias("file"), F.col("severity").alias("vuln_class"), (F.col("scan_id") * 10 + F.col("ord")).alias("ord"), (F.col("l_partkey") % 500).cast("int").alias("line_start"), (F.col("l_partkey") % 500 + F.col("ord") % 3).cast("int").alias("line_end"), F.col("confidence").alias("tool"), F.lit("m").alias("message"), F.col("l_partkey").cast("string").alias("raw_rule_id"), F.lit("high").alias("severity_hint"))
    out = findings.consensus(cand)
    return out.select("file", "vuln_class", "ord", "line_start", "line_end", F.array_join("sources", ",").alias("sources"), "consensus_score", F.size("raw_rule_ids").alias("votes"))


@query("""
WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS m, event_type FROM events),
l AS (SELECT event_id AS left_ord, user_id, m FROM e WHERE event_type = 'error'), r AS (SELECT event_id AS right_ord, user_id, m FROM e WHERE event_type = 'purchase'),
b AS (SELECT left_ord, min(right_ord) AS right_ord FROM l JOIN r ON l.user_id = r.user_id AND abs(l.m - r.m) <= 600 GROUP BY 1)
SELECT CASE WHEN b.right_ord IS NULL THEN 'left_only' ELSE 'merged' END AS kind, l.left_ord, b.right_ord, CAST(least(l.m, coalesce(r.m, l.m)) AS BIGINT) AS line_start FROM l LEFT JOIN b USING (left_ord) LEFT JOIN r ON r.right_ord = b.right_ord
UNION ALL SELECT 'right_only', NULL, right_ord, CAST(m AS BIGINT) FROM r WHERE right_ord NOT IN (SELECT right_ord FROM b)
""")
def interval_merge(spark, sf_dir):
    """Errors and purchases of a user within ten hours."""
    m = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).cast("long")
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("file"), m.alias("line_start"), m.alias("line_end"), "event_type")
    left = e.filter("event_type = 'error'").withColumn("classes", F.array(F.lit("purchase"))).withColumnRenamed("event_id", "left_ord").drop("event_type")
    right = e.filter("event_type = 'purchase'").withColumnsRenamed({"event_id": "right_ord", "event_type": "vuln_class"})
    return findings.merge_sources(left, right, 600).select("kind", "left_ord", "right_ord", "line_start")


@query("""
SELECT l.doc_id, CASE WHEN quality IS NULL OR l.doc_id % 6 = 5 THEN 'severity' WHEN l.doc_id % 4 = 3 THEN 'cvss_band' WHEN l.doc_id % 9 = 0 THEN 'vulnerability_id'
  WHEN toxic = 1 THEN 'verification_status' WHEN d.n_chars % 2 = 0 THEN 'exploit_scenario' END AS reason
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
""")
def finding_validation(spark, sf_dir):
    """Each rule is broken by some documents; the first one is told."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    raw = j.select(
        "doc_id",
        F.when(F.col("doc_id") % 6 == 5, "Severe").otherwise("High").alias("severity"),
        F.when(F.col("doc_id") % 4 == 3, "9.0-10.0").when(F.col("doc_id") % 4 == 2, "7.0–8.9").otherwise("7.0-8.9").alias("cvss_band"),
        F.when(F.col("doc_id") % 9 == 0, "A3").otherwise("A03:2021").alias("vulnerability_id"),
        F.when(F.col("toxic") == 1, "maybe").alias("verification_status"),
        F.when(F.col("n_chars") % 2 == 0, "  ").otherwise("A forged request reaches x.py").alias("exploit_scenario"),
        F.lit("app/x.py").alias("affected_file"),
    )
    return raw.select("doc_id", findings.reject_reason().alias("reason"))


@query("""
SELECT state, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM (
  SELECT DISTINCT coalesce(b.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'fixed' WHEN b.k IS NULL THEN 'introduced' ELSE 'remaining' END AS state
  FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0) b FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 1) a ON a.k = b.k)
GROUP BY 1
""")
def regression_diff(spark, sf_dir):
    """J13, U7, U8."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    d = findings.regression(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ["k"])
    return d.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CAST(event_id % 3 AS VARCHAR) AS cls, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS a FROM events),
t AS (SELECT event_id, user_id % 50 AS file, cls, a, a + event_id % 4 AS b FROM e WHERE event_type IN ('error', 'view')), f AS (SELECT user_id % 50 AS file, cls, a, a + event_id % 2 AS b FROM e WHERE event_type = 'purchase'),
h AS (SELECT t.file, event_id, EXISTS (SELECT 1 FROM f WHERE f.file = t.file AND f.cls = t.cls AND greatest(t.a, f.a) <= least(t.b, f.b) + 3) AS hit FROM t)
SELECT file, count(*) AS n_truth, count(*) FILTER (hit) AS n_found, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS recall FROM h GROUP BY 1
""")
def truth_recall(spark, sf_dir):
    """The share of true rows near a found one; hours stand for lines, so many pairs lie on either side of the tolerance."""
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 50).alias("file"), (F.col("event_id") % 3).cast("string").alias("vuln_class"), hour.alias("line_start"))
    t = e.filter(F.col("event_type").isin("error", "view")).withColumn("line_end", F.col("line_start") + F.col("event_id") % 4)
    f = e.filter("event_type = 'purchase'").withColumn("line_end", F.col("line_start") + F.col("event_id") % 2)
    hit = findings.truth_matches(t, f).select("event_id", F.lit(1).alias("hit"))
    j = t.join(hit, "event_id", "left")
    return j.groupBy("file").agg(F.count(F.lit(1)).alias("n_truth"), F.count("hit").alias("n_found"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


# ---- corpus ----------------------------------------------------------------------------


@query(f"""WITH {FILES}
SELECT doc_id, path, doc_id % 7 NOT IN (1) AND doc_id % 11 IN (0, 1, 6, 7) AS llm_view, doc_id % 7 <> 1 AND doc_id % 11 IN (0, 1, 3, 6, 7) AS scanner_view,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 7 THEN 'test_or_fixture_path' WHEN doc_id % 7 = 1 THEN 'lockfile_or_vendored' END AS drop_rule,
  doc_id % 11 = 5 AS sample, doc_id % 7 IN (2, 3) AS risky FROM d""")
def source_filter(spark, sf_dir):
    """F1, F2, F3, F5, F6."""
    d, p, c = as_files(spark, sf_dir), F.col("path"), F.col("text")
    return d.select("doc_id", "path", paths.readable_source(p, c).alias("llm_view"), paths.readable_source(p, c, True).alias("scanner_view"), paths.drop_rule(p).alias("drop_rule"), paths.sample_file(p).alias("sample"), paths.risky(p, paths.BUDGET_RISK_PREFIXES).alias("risky"))


@query("""
SELECT source, count(*) AS n_files, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens, sum(length(text)) > 600000 AS over_budget,
  CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines FROM documents GROUP BY 1
""")
def token_budget_by_source(spark, sf_dir):
    """A11-A13."""
    return corpus.size_estimate(table(spark, sf_dir, "documents"), ["source"], "text")


@query("""
WITH o AS (SELECT source, list(struct_pack(id := doc_id, s := CAST(length(text) AS BIGINT)) ORDER BY lang <> 'en', lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS fs FROM documents GROUP BY 1),
t AS (SELECT source, fs, list_reduce(list_prepend(struct_pack(total := CAST(0 AS BIGINT), taken := CAST([] AS BIGINT[])), list_transform(fs, lambda f: struct_pack(total := f.s, taken := [f.id]))),
  lambda a, f: CASE WHEN a.total + f.total <= 40000 THEN struct_pack(total := a.total + f.total, taken := list_concat(a.taken, f.taken)) ELSE a END) AS r FROM o)
SELECT source, CAST(len(r.taken) AS INTEGER) AS n_kept, CAST(len(fs) AS INTEGER) AS n_files, r.total AS total FROM t
""")
def trim_to_budget(spark, sf_dir):
    """B2 with a budget of 10,000 tokens a source, English documents first."""
    d = table(spark, sf_dir, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.length("text").alias("n"), (F.col("lang") == "en").alias("first"))
    out = corpus.trim_to_budget(d, "source", "path", F.col("n"), F.col("first"), 10_000)
    return out.groupBy(F.col("snapshot").alias("source")).agg(F.count_if("kept").cast("int").alias("n_kept"), F.count(F.lit(1)).cast("int").alias("n_files"), F.sum(F.when(F.col("kept"), F.col("size")).otherwise(0)).alias("total"))


@query(r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT doc_id, source, line, CASE
  WHEN regexp_matches(line, '\bgh[opsur]_[A-Za-z0-9]{36}\b') THEN 'github_token'
  WHEN regexp_matches(line, '\b(?:AKIA|ASIA)[0-9A-Z]{16}\b') THEN 'aws_access_key'
  WHEN regexp_matches(line, '(?i)\b((?:password|passwd|pwd|pass|secret|token|api[_\-]?key|auth[_\-]?token|private[_\-]?key|client[_\-]?secret|access[_\-]?key|credential|bearer|[A-Z][A-Z0-9]*_(?:KEY|TOKEN|SECRET|PASSWORD|PWD))\s*[:=]\s*)([^\s''"()\[\]{},+]{4,}|"[^\s''"()\[\]{},+]{4,}"|''[^\s''"()\[\]{},+]{4,}'')') THEN 'config_secret' END AS detector FROM l)
SELECT source, detector, count(*) AS n_lines FROM k WHERE detector IS NOT NULL GROUP BY 1, 2
""")
def secret_hits_by_detector(spark, sf_dir):
    """Lines with a credential by source and first detector (quoted random strings alone are left out, SQL can't match their quotes)."""
    d = table(spark, sf_dir, "documents")
    hits = secret_hits(d.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")), without=("high_entropy",))
    # Of a line's hits, which can end on different lines, the detector that comes first.
    place = F.array_position(F.array(*[F.lit(name) for name, *_ in DETECTORS]), F.col("detector"))
    per = hits.select(F.col("path").cast("long").alias("doc_id"), "line", "detector").groupBy("doc_id", "line").agg(F.min_by("detector", place).alias("detector"))
    return per.join(d.select("doc_id", "source"), "doc_id").groupBy("source", "detector").agg(F.count(F.lit(1)).alias("n_lines"))


@query()
def secret_hits_all_detectors(spark, sf_dir):
    """Lines with a credential by source and detector, of all detectors; tests hold it against a plain model."""
    d = table(spark, sf_dir, "documents").select("source", F.col("text").alias("content")).withColumn("path", F.monotonically_increasing_id().cast("string"))
    hits = secret_hits(d, keep=["source"])
    return hits.select("source", "path", "line", "detector").distinct().groupBy("source", "detector").agg(F.count(F.lit(1)).alias("n_lines"))


@query()
def secret_redacted_docs(spark, sf_dir):
    """Documents that redaction changes, and by how much; tests hold it against a plain model."""
    d = table(spark, sf_dir, "documents")
    out = d.select("doc_id", "text", redacted(F.col("text"), F.lit("a.txt")).alias("clean"))
    return out.filter("clean <> text").select("doc_id", F.md5(F.col("clean").cast("binary")).alias("clean_md5"), ((F.length("clean") - F.length(F.replace("clean", F.lit("[SECRET REDACTED]"), F.lit("")))) / 17).cast("int").alias("marks"))


@query("SELECT DISTINCT source || '/' || lang AS value, round(list_aggregate(string_split(source || '/' || lang, ''), 'entropy'), 6) AS entropy FROM documents")
def token_entropy(spark, sf_dir):
    """A23."""
    v = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang").alias("value")).distinct()
    return v.select("value", F.round(text.entropy(F.col("value")), 6).alias("entropy"))


@query(r"""
SELECT value, round(list_aggregate(string_split(value, ''), 'entropy'), 6) AS entropy FROM (
  SELECT DISTINCT substr(m, 2, length(m) - 2) AS value FROM (SELECT unnest(regexp_extract_all(text, '''[A-Za-z0-9+/=_\-]{20,}''|"[A-Za-z0-9+/=_\-]{20,}"')) AS m FROM documents))
""")
def quoted_value_entropy(spark, sf_dir):
    """A23 over the distinct quoted values of 20 or more characters in whole texts."""
    found = F.regexp_extract_all("text", F.lit(r"""(['"])([A-Za-z0-9+/=_\-]{20,})\1"""), F.lit(2))
    v = table(spark, sf_dir, "documents").select(F.explode(found).alias("value")).distinct()
    return v.select("value", F.round(text.entropy(F.col("value")), 6).alias("entropy"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))")
def caller_search(spark, sf_dir):
    """Benchmark passages in documents."""
    b = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "needle")
    return context.contained_passages(b, table(spark, sf_dir, "documents").select("doc_id", "text"), "item_id", "needle", "doc_id", "text")


@query("""
WITH l AS (SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS t FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
h AS (SELECT doc_id, line, last_value(CASE WHEN length(t) <= 20 AND length(t) > 0 THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS heading FROM l)
SELECT doc_id, count(*) AS n_lines, count(DISTINCT heading) AS n_headings, count(*) FILTER (WHERE heading IS NULL) AS n_outside FROM h GROUP BY 1
""")
def enclosing_heading(spark, sf_dir):
    """Short lines head those below."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
    out = history.enclosing(lines, ["doc_id"], "line", F.when((F.length("t") <= 20) & (F.length("t") > 0), F.col("t")))
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("enclosing").alias("n_headings"), F.count_if(F.col("enclosing").isNull()).alias("n_outside"))


@query("SELECT event_id, 'f' || CAST(user_id AS VARCHAR) || '.py' AS file, CAST(json_extract(props, '$.k') AS INTEGER) AS line_start, event_type AS raw_rule_id, CASE WHEN event_type = 'error' THEN 'high' ELSE 'medium' END AS severity_hint FROM events")
def json_ingest(spark, sf_dir):
    """The tool's JSON around the events' own."""
    e = table(spark, sf_dir, "events")
    line = F.get_json_object("props", "$.k").cast("int")
    result = F.struct(F.col("event_type").alias("check_id"), F.concat(F.lit("/work/f"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), F.struct(line.alias("line")).alias("start"), F.struct(F.lit("m").alias("message"), F.col("event_type").alias("severity")).alias("extra"))
    raw = e.select("event_id", F.to_json(F.struct(F.array(result).alias("results"))).alias("json"))
    return tools.semgrep(raw, keep=["event_id"], root="/work").select("event_id", "file", "line_start", "raw_rule_id", "severity_hint")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


REPLY = """
r AS (SELECT doc_id, 'VERDICT #' || (doc_id % 7) || ': ' || CASE doc_id % 3 WHEN 0 THEN 'real - because' WHEN 1 THEN 'FALSE_POSITIVE' ELSE 'maybe' END || chr(10)
  || '  verdict ' || (doc_id % 5 + 1) || ' : real' || chr(10) || 'CONFIDENCE 1: ' || CASE doc_id % 4 WHEN 0 THEN 'High, surely' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'unknown' END || chr(10)
  || 'REASON #1:  ' || n_chars || ' chars of ' || source AS reply FROM documents)
"""


@query(f"""
WITH {REPLY},
p AS (SELECT *, list_reverse(list_transform(regexp_extract_all(reply, '(?im)^\\s*VERDICT\\s*#?\\s*(\\d+)\\s*:\\s*(real|false_positive)\\b', 1), lambda x: CAST(x AS INTEGER))) AS vn,
  list_reverse(regexp_extract_all(reply, '(?im)^\\s*VERDICT\\s*#?\\s*(\\d+)\\s*:\\s*(real|false_positive)\\b', 2)) AS vv,
  regexp_extract(reply, '(?im)^\\s*CONFIDENCE\\s*#?\\s*1\\s*:\\s*(high|medium|low)\\b', 1) AS c,
  regexp_extract(reply, '(?im)^\\s*REASON\\s*#?\\s*1\\s*:\\s*(.+)$', 1) AS why FROM r)
SELECT doc_id, CAST(k AS INTEGER) AS candidate, lower(vv[list_position(vn, k)]) AS verdict,
  CASE WHEN k = 1 AND c <> '' THEN lower(c) ELSE 'low' END AS confidence, CASE WHEN k = 1 THEN left(trim(why), 240) ELSE '' END AS reason
FROM p, unnest(range(1, 6)) AS u(k) WHERE list_contains(vn, k)
""")
def verdict_parsing(spark, sf_dir):
    """V2: replies of several shapes, with numbers out of range and words that are no verdict."""
    d = table(spark, sf_dir, "documents")
    word = F.when(F.col("doc_id") % 3 == 0, "real - because").when(F.col("doc_id") % 3 == 1, "FALSE_POSITIVE").otherwise("maybe")
    sure = F.when(F.col("doc_id") % 4 == 0, "High, surely").when(F.col("doc_id") % 4 == 1, "low").when(F.col("doc_id") % 4 == 2, "medium").otherwise("unknown")
    text_ = lambda c: c.cast("string")
    reply = F.concat(F.lit("VERDICT #"), text_(F.col("doc_id") % 7), F.lit(": "), word, F.lit("\n  verdict "), text_(F.col("doc_id") % 5 + 1), F.lit(" : real\nCONFIDENCE 1: "), sure, F.lit("\nREASON #1:  "), text_(F.col("n_chars")), F.lit(" chars of "), F.col("source"))
    return findings.parse_verdicts(d.select("doc_id", reply.alias("reply"))).drop("reply")


@query("""
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' WHEN n <= 1 THEN '1-line fix' WHEN n <= 3 THEN 'quick fix' ELSE '' END AS label
FROM (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: regexp_matches(x, '\\S'))) AS n FROM documents)
""")
def fix_labels(spark, sf_dir):
    """X24."""
    return table(spark, sf_dir, "documents").select("doc_id", text.quick_fix_label(F.col("text")).alias("label"))
