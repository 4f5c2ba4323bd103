"""Queries of what a run hands out: metrics, diffs, edited files, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import diffs, fixes, markdown, metrics
from .base import FINDINGS, as_findings, query, table

_SECONDS = "0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0"
_TYPES = "CASE user_id % 5 WHEN 0 THEN 'local' WHEN 1 THEN 'deployment_gate' WHEN 2 THEN 'pull_request' WHEN 3 THEN 'scheduled' ELSE 'other' END"
_DECISIONS = "CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'advisory' WHEN 'purchase' THEN 'block' WHEN 'error' THEN 'error' ELSE 'other' END"
_TOOLS = "CASE user_id % 6 WHEN 0 THEN 'bandit' WHEN 1 THEN 'gitleaks' WHEN 2 THEN 'opengrep' WHEN 3 THEN 'semgrep' ELSE 'other' END"


def _counter(metric: str, source: str, value: str = "count(*)", when: str = "true", **labels: str) -> str:
    told = " || ',' || ".join(f"'{n}=\"' || {x} || '\"'" for n, x in labels.items()) or "''"
    return f"SELECT '{metric}' AS metric, {told} AS labels, '' AS le, CAST({value} AS DOUBLE) AS value FROM {source} WHERE {when} GROUP BY 2"


def _histogram(metric: str, label: str, x: str, value: str, when: str) -> str:
    told = f"'{label}=\"' || {x} || '\"'"
    return f"""
SELECT '{metric}_bucket' AS metric, {told} AS labels, CAST(b AS VARCHAR) AS le, CAST(count(*) FILTER ({value} <= b) AS DOUBLE) AS value FROM events, (SELECT unnest([{_SECONDS}]::DOUBLE[]) AS b) WHERE {when} GROUP BY 2, 3
UNION ALL SELECT '{metric}_count', {told}, '', CAST(count(*) AS DOUBLE) FROM events WHERE {when} GROUP BY 2
UNION ALL SELECT '{metric}_sum', {told}, '', CAST(sum({value}) AS DOUBLE) FROM events WHERE {when} GROUP BY 2"""


_QUARTERS = "(CAST(floor(value) AS BIGINT) % 64) / 4.0"


@query(
    f"WITH {FINDINGS.strip()} SELECT * FROM ("
    + " UNION ALL ".join(
        [
            _counter("scan_requests_total", "events", scan_type=_TYPES, gate_decision=_DECISIONS),
            _histogram("scan_duration_seconds", "scan_type", _TYPES, _QUARTERS, "value IS NOT NULL"),
            _counter("claude_api_calls_total", "events", when="event_type <> 'click'", path="CASE WHEN user_id % 2 = 0 THEN 'generate' ELSE 'verify' END", outcome="CASE event_type WHEN 'error' THEN 'error' ELSE 'success' END"),
            _counter("github_api_calls_total", "events", outcome="CASE event_type WHEN 'view' THEN 'success' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'auth_error' WHEN 'click' THEN 'circuit_open' ELSE 'other' END"),
            _counter("local_scan_auth_outcomes_total", "events", when="event_type = 'signup'", outcome="CASE user_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'revoked' WHEN 2 THEN 'bad_format' ELSE 'legacy_ok' END"),
            _counter("scanner_runs_total", "events", tool=_TOOLS, outcome="CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'timeout' WHEN 'signup' THEN 'skipped' ELSE 'success' END"),
            _histogram("scanner_duration_seconds", "tool", _TOOLS, _QUARTERS, "event_type = 'view' AND value IS NOT NULL"),
            _counter("secrets_found_total", "lineitem", "sum(l_linenumber)", "l_returnflag = 'R'"),
            _counter("findings_total", "f", severity="severity"),
            _counter("vuln_verifier_calls_total", "f", outcome="CASE verification_status WHEN 'verified' THEN 'real' WHEN 'unverified' THEN 'unverified' WHEN 'conflicting' THEN 'error' ELSE 'other' END"),
            _counter("consensus_findings_total", "lineitem", voter_count="CASE WHEN l_linenumber >= 4 THEN '4+' ELSE CAST(l_linenumber AS VARCHAR) END"),
        ]
    )
    + ") WHERE value <> 0"
)
def metrics_of_runs(spark, sf_dir):
    """All eleven collectors, filled by two queries that read ``events`` and ``lineitem`` once each."""
    u, kind = F.col("user_id"), F.col("event_type")
    of = lambda key, *values: F.get(F.array(*map(F.lit, values)), key.cast("int"))
    by = lambda **names: F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), kind)
    scan, tool = of(u % 5, "local", "deployment_gate", "pull_request", "scheduled", "elsewhere"), of(u % 6, "bandit", "gitleaks", "opengrep", "semgrep", "new tool", None)
    seconds = (F.floor("value") % 64) / 4.0
    runs, of_runs = metrics.observed(
        table(spark, sf_dir, "events"),
        "runs",
        metrics.series("scan_requests_total", [scan, by(view="pass", click="advisory", purchase="block", error="error")]),
        metrics.series("scan_duration_seconds", [scan], seconds),
        metrics.series("claude_api_calls_total", [of(u % 2, "generate", "verify"), F.when(kind == "error", "error").otherwise("success")], when=kind != "click"),
        metrics.series("github_api_calls_total", [by(view="success", error="error", signup="auth_error", click="circuit_open")]),
        metrics.series("local_scan_auth_outcomes_total", [of(u % 4, "ok", "revoked", "bad_format", "legacy_ok")], when=kind == "signup"),
        metrics.series("scanner_runs_total", [tool, F.coalesce(by(error="error", click="timeout", signup="skipped"), F.lit("success"))]),
        metrics.series("scanner_duration_seconds", [tool], seconds, when=kind == "view"),
    )
    status = F.col("verification_status")
    found, of_findings = metrics.observed(
        as_findings(spark, sf_dir),
        "findings",
        metrics.series("secrets_found_total", value=F.col("ord"), when=status == "verified"),
        metrics.series("findings_total", [F.col("severity")]),
        metrics.series("vuln_verifier_calls_total", [F.when(status == "verified", "real").when(status == "unverified", status).when(status == "conflicting", "error")]),
        metrics.series("consensus_findings_total", [metrics.voter_label(F.col("ord"))]),
    )
    for df in (runs, found):
        df.write.format("noop").mode("overwrite").save()
    return metrics.table(spark, of_runs, of_findings)


@query(rf"""
WITH d AS (SELECT doc_id, string_split('first' || chr(10) || replace(replace(replace(replace(replace(replace(coalesce(text, ''), chr(13), ' '), chr(11), ' '), chr(12), ' '), chr(133), ' '), chr(8232), ' '), chr(8233), ' ') || chr(10) || 'last', chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, ls, CAST(len(ls) AS INTEGER) AS n, CAST(1 + doc_id % len(ls) AS INTEGER) AS s FROM d),
r AS (SELECT *, CAST(least(n, s + doc_id % 3) AS INTEGER) AS e, greatest(s - 3, 1) AS a FROM n),
p AS (SELECT *, least(e + 3, n) AS z FROM r)
SELECT doc_id, '7_' || doc_id || '_' || doc_id || '.py.patch' AS name,
  '--- a/src/' || doc_id || '.py' || chr(10) || '+++ b/src/' || doc_id || '.py' || chr(10)
  || '@@ -' || CASE WHEN z = a THEN '' || a ELSE a || ',' || (z - a + 1) END || ' +' || CASE WHEN z = a THEN '' || a ELSE a || ',' || (z - a + 1) END || ' @@' || chr(10)
  || array_to_string(list_transform(ls[a:s - 1], lambda x: ' ' || x || chr(10)), '') || array_to_string(list_transform(ls[s:e], lambda x: '-' || x || chr(10)), '')
  || array_to_string(list_transform(range(s, e + 1), lambda i: '+safe(' || i || ')' || chr(10)), '') || array_to_string(list_transform(ls[e + 1:z], lambda x: ' ' || x || chr(10)), '') AS patch
FROM p WHERE doc_id % 5 <> 4
""")
def fix_patches(spark, sf_dir):
    """A fix of one to three lines in every document, the lines around it as context; every fifth fix has no code."""
    text = F.translate(F.coalesce("text", F.lit("")), "\r\x0b\x0c\x85  ", "      ")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("first\n"), text, F.lit("\nlast")).alias("content"))
    n = F.size(F.split("content", "\n"))
    s = (1 + F.col("doc_id") % n).cast("int")
    e = F.least(n, (s + F.col("doc_id") % 3).cast("int"))
    code = F.array_join(F.transform(F.sequence(s, e), lambda i: F.format_string("safe(%d)", i)), "\n")
    path = F.format_string("src/%d.py", "doc_id")
    files = d.select(path.alias("path"), "content")
    found = d.select("doc_id", F.lit(7).alias("scan_id"), F.col("doc_id").alias("finding_index"), path.alias("affected_file"), F.format_string("%d-%d", s, e).alias("affected_lines"), F.when(F.col("doc_id") % 5 == 4, "see above").otherwise(F.concat(F.lit("```py\n"), code, F.lit("\n```"))).alias("suggested_fix"))
    return diffs.patches(found, files, ["doc_id"])


@query(r"""
WITH d AS (SELECT doc_id, string_split('a = 0' || chr(10) || 'b = (1,' || chr(10) || '  2)' || chr(10) || array_to_string(list_transform(range(CAST(doc_id % 40 AS BIGINT)), lambda i: 'c' || i || ' = ' || i), chr(10)), chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, doc_id % 2 = 0 AS py, CASE WHEN doc_id % 40 = 0 THEN ls[:3] ELSE ls END AS ls FROM d),
e AS (SELECT doc_id, py, ls, list_filter(range(1, CAST(len(ls) + 3 AS BIGINT)), lambda i: i % 3 <> 2) AS tries FROM n),
m AS (SELECT *, list_filter(tries, lambda i: i <= len(ls) AND NOT (i = 3 AND py)) AS made FROM e)
SELECT doc_id, array_to_string(list_transform(ls, lambda x, i: CASE WHEN list_contains(made, i) THEN 'new' || i || ' = (' || i || ')' ELSE x END), chr(10)) || CASE WHEN list_contains(made, len(ls)) OR doc_id % 40 = 0 THEN chr(10) ELSE '' END AS content,
  CAST(len(made) AS INTEGER) AS n_made, CAST(2 * len(list_filter(tries, lambda i: i > len(ls))) AS INTEGER) AS n_outside, CAST(CASE WHEN py THEN 2 ELSE 0 END AS INTEGER) AS n_broken, CAST(len(made) AS INTEGER) AS n_overlapping
FROM m
""")
def spliced_files(spark, sf_dir):
    """X21, gate 8: many edits a file, each made twice, some outside; in Python files those that break the syntax are taken back."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    body = F.array_join(F.transform(F.when(F.col("doc_id") % 40 > 0, F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 40 - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: F.format_string("c%d = %d", i, i)), "\n")
    path = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".txt"))
    files = d.select(path.alias("path"), F.concat(F.lit("a = 0\nb = (1,\n  2)\n"), body).alias("content"), "doc_id")
    lines = F.explode(F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 40 + 5)).alias("at")
    at = d.select("doc_id", path.alias("affected_file"), lines).filter("at % 3 <> 2")
    edits = at.select("affected_file", F.col("at").alias("start"), F.col("at").alias("end"), F.format_string("new%d = (%d)", "at", "at").alias("code"), F.explode(F.array(F.col("at") * 2, F.col("at") * 2 + 1)).alias("ord"))
    out = fixes.spliced(edits, files)
    n = lambda why: F.size(F.filter("decided", lambda x: x["reason"].eqNullSafe(F.lit(why)))).cast("int")
    of = F.regexp_extract("path", r"^\d+", 0).cast("long")
    return out.select(of.alias("doc_id"), "content", n(None).alias("n_made"), n(fixes.OUT_OF_BOUNDS).alias("n_outside"), n(fixes.BREAKS_SYNTAX).alias("n_broken"), n(fixes.OVERLAPS).alias("n_overlapping"))


_IDS = ["A03:2021", "XSS", "custom_rule", "LLM01:2025"]
_NAMED = ["A03:2021 (Injection)", "XSS (Cross-Site Scripting)", "custom_rule", "LLM01:2025 (Prompt Injection)"]
_SUMMARY = "Validation: type  — Naming: random — Storage: disk — Limits: 5 MB — Access: signed — Processing: none "
_PANEL = "Validation: type — Naming: random — Storage: disk — Limits: 5 MB — Access: signed — Processing: none"


def _pick(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query(rf"""
WITH {FINDINGS.strip()},
o AS (SELECT * EXCLUDE (ord), row_number() OVER (PARTITION BY scan_id ORDER BY ord, l_partkey, l_suppkey, severity, confidence, verification_status) AS ord FROM f),
g AS (SELECT *, {_pick("l_partkey", _NAMED)} AS id, 'src/' || l_suppkey || '|a.py' AS file, CASE WHEN l_partkey % 3 > 0 THEN l_partkey || '-' || (l_partkey + 2) ELSE '' END AS span FROM o),
h AS (SELECT *,
  '| ' || id || ' | ' || severity || ' | ' || confidence || ' | ' || verification_status || ' | ' || replace(file, '|', '\|') || ' | ' || CASE WHEN span = '' THEN '—' ELSE span END || ' | ref one |' AS tr,
  '### ' || id || ' — ' || severity || ' (confidence: ' || confidence || ', verification: ' || verification_status || ')' || CASE WHEN verification_status = 'advisory_real' THEN chr(10) || '> **Potential issue (auto-triaged, not blocking)**' ELSE '' END
  || chr(10) || chr(10) || '- **Location**: `' || file || CASE WHEN span = '' THEN '' ELSE ':' || span END || '`' || chr(10) || '- **OWASP reference**: ref' || chr(10) || 'one' || chr(10) || '- **Patch file**: `' || scan_id || '_' || ord || '.patch`' || chr(10)
  || CASE ord % 3 WHEN 0 THEN '' WHEN 1 THEN '- **Detected by**: bandit (1 voter)' || chr(10) ELSE '- **Detected by**: bandit, semgrep (2 voters)' || chr(10) END
  || chr(10) || '**Description**' || chr(10) || chr(10) || 'about ' || l_partkey || chr(10) || chr(10) || '**Exploit scenario**' || chr(10) || chr(10) || 'how' || chr(10) || chr(10) || '**Suggested fix**' || chr(10) || chr(10) || 'do it'
  || CASE l_suppkey % 4 WHEN 0 THEN chr(10) || '**Upload context**' || chr(10) || chr(10) || '- {_PANEL}' || chr(10) WHEN 1 THEN chr(10) || '**Upload context**' || chr(10) || chr(10) || '```' || chr(10) || 'Validation: odd' || chr(10) || '```' || chr(10)
     WHEN 2 THEN chr(10) || '**Cross-file context**' || chr(10) || chr(10) || '```' || chr(10) || 'called by x' || chr(10) || '```' || chr(10) ELSE '' END AS det FROM g),
t AS (SELECT scan_id, count(*) AS n, string_agg(tr, chr(10) ORDER BY ord) AS rows_, string_agg(det, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ord) AS dets,
  count(*) FILTER (severity = 'Critical' AND verification_status = 'conflicting') AS c, count(*) FILTER (severity IN ('Critical', 'High') AND confidence IN ('Medium', 'Low')) AS a, count(*) FILTER (verification_status = 'advisory_real') AS v
  FROM h WHERE scan_id % 4 <> 0 GROUP BY 1),
s AS (SELECT o_orderkey AS scan_id, {_pick("o_custkey", ["deployment_gate", "local"])} AS kind, o_custkey % 6 = 0 AS partial, coalesce(t.n, 0) AS n, t.* EXCLUDE (scan_id, n), o_custkey FROM orders LEFT JOIN t ON t.scan_id = o_orderkey),
w AS (SELECT *, concat_ws(chr(10) || chr(10), CASE WHEN partial THEN '⚠️ **PARTIAL SCAN** — the following files were not analysed: ' || CASE WHEN o_custkey % 12 = 0 THEN '`a.py`, `b.py`' ELSE '_(none listed)_' END END,
  CASE WHEN c > 0 THEN '⚠️ **CONFLICTING FINDINGS** — ' || c || ' Critical findings were not confirmed by the verification pass. These are reported as advisories.' END,
  CASE WHEN a > 0 THEN '⚠️ **ADVISORY** — ' || a || ' findings are High/Critical severity but have Medium/Low confidence. These are not blocking.' END,
  CASE WHEN v > 0 THEN 'ℹ️ **AUTO-TRIAGED** — ' || v || ' findings were auto-triaged as potential issues with medium confidence. These are not blocking — review at your discretion.' END,
  CASE WHEN n = 0 THEN '⚠️ **NO FINDINGS DETECTED** — developer acknowledgement required before gate passes.' END) AS warnings FROM s)
SELECT scan_id, concat_ws(chr(10) || chr(10), '# Security Scan Report',
  '## Scan metadata' || chr(10) || '- **Scan ID**: `' || scan_id || '`' || chr(10) || '- **Repository**: repo' || o_custkey || chr(10) || '- **Timestamp**: now' || chr(10) || '- **Scan type**: `' || kind || '`' || chr(10) || '- **Scan target**: `full`' || chr(10) || '- **Triggered by**: someone',
  CASE WHEN warnings <> '' THEN '## Warnings' || chr(10) || chr(10) || warnings END, CASE WHEN kind = 'deployment_gate' THEN '## Gate decision: `BLOCK`' END,
  CASE WHEN n > 0 THEN '## Findings (' || n || ')' || chr(10) || chr(10) || '| ID | Severity | Confidence | Verification | File | Lines | OWASP reference |' || chr(10) || '| --- | --- | --- | --- | --- | --- | --- |' || chr(10) || rows_ END,
  CASE WHEN n > 0 THEN '## Finding details' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || dets END, '---' || chr(10) || chr(10) || '*Findings: ' || n || '*') || chr(10) AS report
FROM w
""")
def markdown_reports(spark, sf_dir):
    """The whole report of every run, a quarter of them without findings."""
    part, supp, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("ord")
    of = lambda key, values: F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))
    # Line numbers repeat within an order.
    nth = F.row_number().over(Window.partitionBy("scan_id").orderBy("ord", "l_partkey", "l_suppkey", "severity", "confidence", "verification_status"))
    f = as_findings(spark, sf_dir).filter("scan_id % 4 <> 0").withColumn("ord", nth.cast("long"))
    f = f.withColumns(
        {
            "vulnerability_id": of(part, _IDS),
            "affected_file": F.format_string("src/%d|a.py", supp),
            "affected_lines": F.when(part % 3 > 0, F.format_string("%d-%d", part, part + 2)),
            "owasp_reference": F.lit("ref\none"),
            "patch_file_path": F.format_string("%d_%d.patch", "scan_id", order),
            "consensus_score": (order % 3).cast("int"),
            "sources": F.when(order % 3 == 2, F.array(F.lit("bandit"), F.lit("semgrep"))).otherwise(F.array(F.lit("bandit"))),
            "description": F.format_string("about %d", part),
            "exploit_scenario": F.lit("how"),
            "suggested_fix": F.lit("do it"),
            "context_summary": of(supp, [_SUMMARY, "Validation: odd", "called by x", ""]),
        }
    )
    c = F.col("o_custkey")
    scans = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scan_id"),
        F.format_string("repo%d", c).alias("repo_url"),
        F.lit("now").alias("timestamp"),
        of(c, ["deployment_gate", "local"]).alias("scan_type"),
        F.lit("full").alias("scan_target"),
        F.lit("someone").alias("triggered_by"),
        (c % 6 == 0).alias("partial_scan"),
        F.when(c % 12 == 0, F.array(F.lit("a.py"), F.lit("b.py"))).alias("unscanned_files"),
        F.lit("block").alias("gate_decision"),
    )
    return markdown.reports(scans, f)
