"""Queries of reviews and reports: findings made of candidates and hits, context, fixes, aggregates, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, context, fixes, history, report, review
from .base import FINDINGS, as_findings, query, table

S = lambda c: F.col(c).cast("string")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pick(by, values: list, otherwise=None):
    """The value for each remainder from 0, else the last."""
    out = F.lit(otherwise)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(by == i, F.lit(v)).otherwise(out)
    return out


def pick_sql(by: str, values: list, otherwise=None) -> str:
    show = lambda v: "NULL" if v is None else sql_text(v)
    return f"CASE {' '.join(f'WHEN {by} = {i} THEN {show(v)}' for i, v in enumerate(values))} ELSE {show(otherwise)} END"


PROSE = ["Reflected HTML of a name", "An os.system call", "SSTI by a name", "Unsafe YAML", "An LDAP filter", "A $where clause", "A raw SQL query", "Path traversal by ../", "An open redirect", "pickle of a cookie", "File upload"]
IDS = ["A03:2021", "A01:2021", "a03:2021"]
PRIMARY = ["sqli", "auth_bypass", "sqli"]


@query(f"""
WITH d AS (SELECT doc_id, {pick_sql("doc_id % 13", PROSE, "A flaw")} || chr(10) || coalesce(text, '') AS t, {pick_sql("doc_id % 5", IDS, "A05:2021")} AS id, {pick_sql("doc_id % 5", PRIMARY, "misconfiguration")} AS p FROM documents),
c AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(t, {sql_text('(?i)' + pattern)}) THEN '{name}'" for name, pattern in review.CLASS_HINTS)} ELSE p END AS c FROM d)
SELECT doc_id, CASE upper(id) {" ".join(f"WHEN '{k}' THEN concat_ws(',', c, array_to_string(list_filter({v}, lambda x: x <> c), ','))" for k, v in review.BROAD_IDS.items())} ELSE p END AS classes FROM c
""")
def finding_classes(spark, sf_dir):
    """Classes told by the prose of whole texts."""
    k = F.col("doc_id") % 5
    prose = F.concat(pick(F.col("doc_id") % 13, PROSE, "A flaw"), F.lit("\n"), F.coalesce("text", F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", prose.alias("t"), pick(k, IDS, "A05:2021").alias("id"), pick(k, PRIMARY, "misconfiguration").alias("p"))
    return d.select("doc_id", F.array_join(review.candidate_classes(F.col("id"), F.col("t"), F.col("p")), ",").alias("classes"))


TEMPLATES = {"sqli": ("Bind the value.", "A payload ends the statement."), "xss": ("Escape the value.", "A script runs.")}
REFERENCES = {"A03:2021": "https://example.org/a03"}


@query(f"""
WITH {FINDINGS},
c AS (SELECT scan_id, ord, CASE l_partkey % 3 WHEN 0 THEN 'sqli' WHEN 1 THEN 'xss' ELSE 'ssrf' END AS k, CASE WHEN l_suppkey % 5 = 0 THEN 'Severe' ELSE severity END AS severity,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE confidence END AS confidence, CASE l_partkey % 4 WHEN 0 THEN 'A03:2021' WHEN 1 THEN '' END AS id, 'f' || l_suppkey || '.py' AS file,
  l_partkey % 50 AS a, l_partkey % 50 + ord % 2 AS b, CASE WHEN l_partkey % 6 = 0 THEN 'own' END AS own FROM f)
SELECT scan_id, ord, CASE WHEN severity = 'Severe' THEN 'Medium' ELSE severity END AS severity, coalesce(confidence, 'Medium') AS confidence,
  CASE severity WHEN 'Critical' THEN '9.0-10.0' WHEN 'High' THEN '7.0-8.9' WHEN 'Low' THEN '0.1-3.9' ELSE '4.0-6.9' END AS cvss_band, coalesce(nullif(id, ''), upper(k)) AS vulnerability_id,
  CASE WHEN a <> 0 THEN CASE WHEN b <> a THEN a || '-' || b ELSE CAST(a AS VARCHAR) END END AS affected_lines, coalesce(own, k || ' detected') AS description,
  coalesce(own, CASE k WHEN 'sqli' THEN 'Bind the value.' WHEN 'xss' THEN 'Escape the value.' ELSE 'Review and remediate the identified vulnerability.' END) AS suggested_fix,
  coalesce(own, CASE k WHEN 'sqli' THEN 'A payload ends the statement.' WHEN 'xss' THEN 'A script runs.' ELSE 'Attacker exploits ' || k || ' in ' || file || '.' END) AS exploit_scenario,
  CASE WHEN id = 'A03:2021' THEN 'https://example.org/a03' ELSE '' END AS owasp_reference FROM c
""")
def candidate_findings(spark, sf_dir):
    """V4: candidates of three classes, with unknown severities and with fields of their own."""
    f, own = as_findings(spark, sf_dir), F.when(F.col("l_partkey") % 6 == 0, "own")
    c = f.select(
        "scan_id",
        "ord",
        pick(F.col("l_partkey") % 3, ["sqli", "xss"], "ssrf").alias("vuln_class"),
        F.when(F.col("l_suppkey") % 5 == 0, "Severe").otherwise(F.col("severity")).alias("severity"),
        F.when(F.col("l_suppkey") % 7 != 0, F.col("confidence")).alias("confidence"),
        F.lit(None).cast("string").alias("cvss_band"),
        pick(F.col("l_partkey") % 4, ["A03:2021", ""]).alias("vulnerability_id"),
        F.concat(F.lit("f"), S("l_suppkey"), F.lit(".py")).alias("file"),
        (F.col("l_partkey") % 50).alias("line_start"),
        (F.col("l_partkey") % 50 + F.col("ord") % 2).alias("line_end"),
        own.alias("description"),
        F.lit("").alias("scanner_message"),
        own.alias("suggested_fix"),
        own.alias("exploit_scenario"),
        F.lit("").alias("owasp_reference"),
    )
    return review.to_findings(c, TEMPLATES, REFERENCES).select("scan_id", "ord", "severity", "confidence", "cvss_band", "vulnerability_id", "affected_lines", "description", "suggested_fix", "exploit_scenario", "owasp_reference")


HITS = """h AS (SELECT event_id, 'f' || user_id || CASE event_id % 3 WHEN 0 THEN '.env.example' ELSE '.py' END AS path, event_id % 90 + 1 AS line, event_id % 90 + 1 + event_id % 2 AS end_line, CASE WHEN event_id % 4 > 0 THEN event_type || ' = ' ELSE '' END AS hint, 'd' || event_id % 5 AS detector FROM events)"""


def as_hits(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("f"), S("user_id"), F.when(i % 3 == 0, ".env.example").otherwise(".py")).alias("path"), (i % 90 + 1).alias("line"), (i % 90 + 1 + i % 2).alias("end_line"), F.when(i % 4 > 0, F.concat("event_type", F.lit(" = "))).otherwise("").alias("hint"), F.concat(F.lit("d"), (i % 5).cast("string")).alias("detector"))


@query(f"""
WITH {HITS}, l AS (SELECT *, CASE WHEN line = end_line THEN CAST(line AS VARCHAR) ELSE line || '-' || end_line END AS place FROM h)
SELECT 'SECRET-001' AS vulnerability_id, 'Critical' AS severity, 'High' AS confidence, '9.0-10.0' AS cvss_band, 'verified' AS verification_status, path AS affected_file, place AS affected_lines,
  'A credential (' || detector || ') stands in line ' || place || '.' || CASE WHEN hint <> '' THEN ' The line begins with `' || hint || '`.' ELSE '' END AS description FROM l
""")
def secret_findings(spark, sf_dir):
    """X7."""
    return review.secret_findings(as_hits(spark, sf_dir)).drop("suggested_fix")


@query(f"""
WITH {HITS}, v AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'real' END AS v FROM h)
SELECT event_id, CASE WHEN ends_with(path, '.example') AND v IS DISTINCT FROM 'real' THEN 'Medium' ELSE 'Critical' END AS severity FROM h JOIN v USING (event_id) WHERE v IS DISTINCT FROM 'false_positive'
""")
def secret_verification(spark, sf_dir):
    """V5: some hits have a verdict."""
    h = as_hits(spark, sf_dir)
    v = h.filter("event_id % 7 < 2").select("event_id", F.when(F.col("event_id") % 7 == 0, "FALSE_POSITIVE").otherwise("real").alias("verdict"))
    return review.verified_secrets(h, v, ["event_id"]).select("event_id", "severity")


@query(f"""
WITH {FINDINGS} SELECT scan_id, ord, d.doc_id IS NULL AS missing_file, length(d.text) AS n_chars FROM f LEFT JOIN documents d ON l_partkey = d.doc_id * 3
""")
def finding_contents(spark, sf_dir):
    """A third of the parts name a document."""
    f = as_findings(spark, sf_dir).select("scan_id", "ord", F.col("l_partkey").alias("affected_file"))
    files = table(spark, sf_dir, "documents").select((F.col("doc_id") * 3).alias("path"), F.col("text").alias("content"))
    return review.with_content(f, files).select("scan_id", "ord", "missing_file", F.length("content").alias("n_chars"))


CODE = ["ALLOWED_EXTENSIONS = 1", "MAX_FILE_SIZE = 2", "f.filename; open('/static/x')", "z.extractall(p)", "limits: {}\nextension in [1]"]


@query(f"""
WITH s AS (SELECT doc_id, doc_id || '.py' AS path, 36 + doc_id % 3 AS line, repeat(chr(10), 4) || {pick_sql("doc_id % 6", CODE, "pass")} || repeat(chr(10), 60) || CASE WHEN doc_id % 4 = 0 THEN 'maxFileSize' ELSE 'x' END || chr(10) AS t FROM documents),
k AS (SELECT * FROM s WHERE doc_id % 7 <> 3 AND doc_id % 5 <> 2),
w AS (SELECT path, line, array_to_string(list_slice(string_split(t, chr(10)), line - 30, line + 60), chr(10)) AS w FROM k),
n AS (SELECT path, line, CAST(NOT regexp_matches(w, {sql_text(review.SUFFIX_LIST)}) AS INTEGER) + CAST(NOT regexp_matches(w, {sql_text(review.SIZE_LIMIT)}) AS INTEGER)
  + CAST(regexp_matches(w, {sql_text(review.RAW_NAME)}) AND regexp_matches(w, {sql_text(review.PUBLIC_FOLDER)}) AS INTEGER) + CAST(regexp_matches(w, {sql_text(review.UNPACKS)}) AND NOT regexp_matches(w, {sql_text(review.MAGIC_BYTES)}) AS INTEGER) AS weak FROM w)
SELECT path, line, weak FROM n WHERE weak >= 2
""")
def upload_synthesis(spark, sf_dir):
    """Code at the rim of the window, flagged files and files that left the snapshot."""
    i = F.col("doc_id")
    content = F.concat(F.lit("\n" * 4), pick(i % 6, CODE, "pass"), F.lit("\n" * 60), F.when(i % 4 == 0, "maxFileSize").otherwise("x"), F.lit("\n"))
    f = table(spark, sf_dir, "documents").select("doc_id", F.concat(S("doc_id"), F.lit(".py")).alias("path"), content.alias("content"))
    kept = review.aligned(f, f.filter("doc_id % 7 <> 3"))
    handlers = kept.select("path", (36 + i % 3).alias("line"))
    flags = f.select(F.col("path").alias("file"), F.when(i % 5 == 2, review.UPLOAD_CLASS).otherwise("xss").alias("vuln_class"))
    return review.synthetic_candidates(handlers, flags, kept)


@query(f"""
WITH a AS (SELECT doc_id, {pick_sql("doc_id % 4", ["Bind it.", "```\nx\n```", "Fix the SQLI"], "Look at it")} AS fix, {pick_sql("doc_id % 3", ["csrf by a form", "a flaw"])} AS d, {pick_sql("doc_id % 5", ["```\nbetter\n```", "no code", ""])} AS i, {pick_sql("doc_id % 2", ["told"])} AS s FROM documents),
q AS (SELECT *, NOT contains(fix, '```') AND ({" OR ".join(f"contains(lower(coalesce(d, '') || ' ' || fix), '{x}')" for x in review.FIXABLE)}) AS ask FROM a)
SELECT doc_id, CASE WHEN ask AND coalesce(contains(i, '```'), false) THEN i ELSE fix END AS suggested_fix, CASE WHEN ask THEN coalesce(s, 'old') ELSE 'old' END AS exploit_scenario FROM q
""")
def fix_strengthening(spark, sf_dir):
    """V8."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    f = d.select("doc_id", pick(i % 4, ["Bind it.", "```\nx\n```", "Fix the SQLI"], "Look at it").alias("suggested_fix"), pick(i % 3, ["csrf by a form", "a flaw"]).alias("description"), F.lit("old").alias("exploit_scenario"))
    a = d.select("doc_id", pick(i % 5, ["```\nbetter\n```", "no code", ""]).alias("improved_fix"), pick(i % 2, ["told"]).alias("improved_scenario"))
    return review.strengthened(f, a, "doc_id").select("doc_id", "suggested_fix", "exploit_scenario")


@query("""
SELECT source, lang, count(*) FILTER (WHERE toxic = 1) = 0 AND NOT coalesce(bool_or(n_chars > 100000), false) AND sum(length(text) - length(replace(text, chr(10), '')) + 1) > 500 AS retry
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2
""")
def retry_trigger(spark, sf_dir):
    """Scans by source and language; toxic labels are findings, very long texts cut a scan short."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    n_lines = F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    by = d.groupBy("source", "lang").agg(F.count_if(F.col("toxic") == 1).alias("n"), F.bool_or(F.col("n_chars") > 100000).alias("cut"), n_lines.alias("l"))
    return by.select("source", "lang", review.wants_retry(F.col("n"), F.col("cut"), F.col("l")).alias("retry"))


NAMED = [f"A{i:02d}:2021" for i in range(1, 11)] + ["SECRET-001", "LLM01:2025"]


@query(f"""
WITH {FINDINGS},
g AS (SELECT l_suppkey, {pick_sql("l_partkey % 12", NAMED)} AS id, severity, count(*) AS n, min(scan_id * 10 + ord) AS first FROM f GROUP BY 1, 2, 3),
b AS (SELECT *, CASE WHEN severity IN ('Critical', 'High') THEN 'urgent' WHEN severity = 'Medium' THEN 'cleanup' ELSE 'advisory' END AS bucket FROM g)
SELECT l_suppkey, id, severity, n, first, bucket, CAST(row_number() OVER (PARTITION BY l_suppkey, bucket ORDER BY first, id, severity) AS INTEGER) AS place,
  CASE id {" ".join(f"WHEN {sql_text(k)} THEN {sql_text(n)}" for k, (n, _) in report.CATEGORIES.items())} END AS name, CASE id {" ".join(f"WHEN {sql_text(k)} THEN {sql_text(i)}" for k, (_, i) in report.CATEGORIES.items() if i)} END AS next_id FROM b
""")
def report_groups(spark, sf_dir):
    """Groups of a report in its buckets, by first sight, with their categories."""
    f = as_findings(spark, sf_dir).select("l_suppkey", "severity", pick(F.col("l_partkey") % 12, NAMED).alias("vulnerability_id"), (F.col("scan_id") * 10 + F.col("ord")).alias("ord"))
    g = report.finding_groups(f, ["l_suppkey"]).withColumn("c", report.category(F.col("vulnerability_id")))
    return g.select("l_suppkey", F.col("vulnerability_id").alias("id"), "severity", "n", "first", "bucket", "place", "c.name", "c.next_id")


@query(f"""WITH {FINDINGS} SELECT scan_id, ord, place FROM (SELECT scan_id, ord, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY ord) AS INTEGER) AS place FROM f WHERE severity IN ('Critical', 'High')) WHERE place <= 3""")
def fix_first(spark, sf_dir):
    """W12."""
    return report.fix_first(as_findings(spark, sf_dir), ["scan_id"]).select("scan_id", "ord", "place")


COUNTED = f"""WITH {FINDINGS},
g AS (SELECT scan_id, count(*) AS n, count(*) FILTER (WHERE severity = 'Critical') AS c, count(*) FILTER (WHERE severity = 'High') AS h, count(*) FILTER (WHERE severity = 'Medium') AS m, count(*) FILTER (WHERE severity = 'Low') AS l,
  count(*) FILTER (WHERE severity IN ('Critical', 'High') AND verification_status = 'verified') AS v FROM f GROUP BY 1)
"""


def as_counts(spark, sf_dir):
    s = F.col("severity")
    verified = s.isin("Critical", "High") & (F.col("verification_status") == "verified")
    return as_findings(spark, sf_dir).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(s == x).alias(x[0].lower()) for x in ("Critical", "High", "Medium", "Low")], F.count_if(verified).alias("v"))


@query(
    COUNTED
    + """SELECT scan_id, CASE scan_id % 6 WHEN 0 THEN 'Security scan failed: ' || c || ' Critical, ' || h || ' High findings detected. Deployment blocked. See report artifact for details and patches.'
  WHEN 1 THEN 'Security scan passed. ' || (m + l) || ' Medium/Low findings noted — see report for details.' WHEN 2 THEN 'Security scan advisory: ' || n || ' findings present but not blocking (confidence or verification threshold not met). See report.'
  WHEN 3 THEN 'Security scan unavailable. Deployment allowed to proceed — scan manually before release.' WHEN 4 THEN 'Deployment gate bypassed by u' || scan_id || ' at noon. ' || (c + h) || ' High/Critical findings were present at time of bypass.' END AS line FROM g"""
)
def outcome_lines(spark, sf_dir):
    """A28."""
    decision = pick(F.col("scan_id") % 6, ["block", "pass", "advisory", "failed", "bypassed"], "other")
    line = report.outcome_line(decision, *[F.col(x) for x in "chml"], F.concat(F.lit("u"), S("scan_id")), F.lit("noon"))
    return as_counts(spark, sf_dir).select("scan_id", line.alias("line"))


@query(
    COUNTED
    + """SELECT scan_id, CASE WHEN v > 0 THEN v || ' verified critical or high-severity ' || CASE WHEN v = 1 THEN 'issue' ELSE 'issues' END || ' were identified in this repository.'
  WHEN c + h > 0 THEN (c + h) || ' critical or high-severity findings were detected, though none have been verified.' ELSE n || CASE WHEN n = 1 THEN ' finding' ELSE ' findings' END || ' were identified, all medium severity or below.' END AS summary FROM g"""
)
def plain_summaries(spark, sf_dir):
    """A30."""
    return as_counts(spark, sf_dir).select("scan_id", report.plain_summary(F.col("v"), F.col("c") + F.col("h"), F.col("n")).alias("summary"))


@query("SELECT CASE WHEN s >= 4 THEN '4+' ELSE CAST(s AS VARCHAR) END AS voter_count, count(*) AS n FROM (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS d, count(DISTINCT event_type) AS s FROM events GROUP BY 1, 2) GROUP BY 1")
def voter_buckets(spark, sf_dir):
    """The kinds of events of a user's day are voters."""
    day = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400)
    return report.voter_counts(table(spark, sf_dir, "events").groupBy("user_id", day).agg(F.count_distinct("event_type").alias("consensus_score")))


@query(r"SELECT o_custkey, CAST(coalesce(max(try_cast(nullif(regexp_extract(name, '^REVIEW\.(\d+)\.md$', 1), '') AS BIGINT)), 0) + 1 AS BIGINT) AS next_index FROM (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'REVIEW.' || o_orderkey || '.md' WHEN o_orderkey % 3 = 1 THEN 'REVIEW.x.md' ELSE 'old.REVIEW.' || o_orderkey || '.md' END AS name FROM orders) GROUP BY 1")
def next_report_index(spark, sf_dir):
    """A25."""
    k = F.col("o_orderkey") % 3
    name = F.when(k == 0, F.concat(F.lit("REVIEW."), S("o_orderkey"), F.lit(".md"))).when(k == 1, "REVIEW.x.md").otherwise(F.concat(F.lit("old.REVIEW."), S("o_orderkey"), F.lit(".md")))
    return report.next_index(table(spark, sf_dir, "orders").select("o_custkey", name.alias("name")), "name", r"REVIEW\.(\d+)\.md", ["o_custkey"])


@query("""
WITH l AS (SELECT o_custkey, max_by(struct_pack(a := nullif(o_orderkey % 3, 2) = 0, b := o_orderkey % 2 = 0), o_orderkey) AS r FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN r IS NULL THEN false ELSE coalesce(r.a, false) END AS scanners, CASE WHEN r IS NULL THEN true ELSE coalesce(r.b, false) END AS retry, true AS partial, CAST(CASE WHEN r IS NULL THEN 2 ELSE CAST(coalesce(r.a, false) AS INTEGER) + CAST(coalesce(r.b, false) AS INTEGER) + 1 END AS INTEGER) AS n_enabled
FROM customer LEFT JOIN l ON c_custkey = o_custkey
""")
def resolved_flags(spark, sf_dir):
    """The latest order is a customer's config row; others go by environment and defaults."""
    k = F.col("o_orderkey")
    configs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(k % 3 != 2, k % 3 == 0).alias("scanners"), (k % 2 == 0).alias("retry"), F.lit(True).alias("partial"))
    flags = {"scanners": True, "retry": True, "partial": True}
    out = history.resolved_flags(table(spark, sf_dir, "customer").select("c_custkey"), configs, ["c_custkey"], "o_orderkey", {"scanners": False}, flags)
    return out.withColumn("n_enabled", report.enabled_count(list(flags)))


@query("""SELECT user_id, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, CAST(sum(event_id % 7) AS BIGINT) AS output_tokens, coalesce(string_agg(CASE WHEN event_id % 4 > 0 THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY event_id), '') AS call_ids FROM events GROUP BY 1""")
def usage_of_calls(spark, sf_dir):
    """Some calls have no id."""
    i = F.col("event_id")
    return report.usage_of_calls(table(spark, sf_dir, "events").select("user_id", "event_id", F.when(i % 4 > 0, S("event_id")).alias("call_id"), (i % 100).alias("input_tokens"), (i % 7).alias("output_tokens")), ["user_id"], "event_id")


@query("SELECT o_orderkey AS token_id, o_orderdate AS issued_at FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '%urgent%' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500")
def revoked_tokens(spark, sf_dir):
    """Fulfilled orders are revoked tokens."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token_id"), F.col("o_orderpriority").alias("user_email"), F.col("o_orderdate").alias("issued_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked_at"))
    return history.token_list(t, "revoked", email_part="urgent").select("token_id", "issued_at")


@query("""
SELECT CASE WHEN event_id % 3 = 0 THEN 'ci' ELSE 'portal' END AS source, event_id AS scan_id, coalesce(CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'r' END, '') <> '' AS has_report
FROM events ORDER BY ts DESC, event_id DESC LIMIT 26 OFFSET 50
""")
def report_page(spark, sf_dir):
    """The third page of both channels' reports, newest first."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("scan_id"), F.col("ts").alias("started_at"), pick(F.col("event_id") % 4, ["", "r"]).alias("html_report"))
    rows = history.report_rows(e.filter("scan_id % 3 <> 0"), e.filter("scan_id % 3 = 0"))
    return history.page(rows, [F.desc("started_at"), F.desc("scan_id")], 25, 2).select("source", "scan_id", "has_report")


@query("""
WITH r AS (SELECT event_id, user_id, ts, event_type, event_id % 100 AS t, event_id % 3 = 0 AS ci FROM events WHERE user_id % 10 > 0)
SELECT 'scans' AS kind, ci, count(*) AS n, count(*) FILTER (WHERE ci OR event_type <> 'error') AS ok, CAST(NULL AS BIGINT) AS tokens FROM r GROUP BY ci
UNION ALL SELECT 'usage', ci, count(*), NULL, CAST(sum(t) AS BIGINT) FROM r WHERE NOT ci GROUP BY ci
UNION ALL SELECT 'monthly', ci, count(DISTINCT user_id || strftime(ts, '%Y-%m')), NULL, CAST(sum(t) AS BIGINT) FROM r GROUP BY ci
UNION ALL SELECT 'audit', ci, count(*), NULL, NULL FROM r WHERE NOT ci GROUP BY ci
""")
def run_records(spark, sf_dir):
    """What finished runs of both channels add to each table."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(i.alias("scan_id"), F.when(F.col("user_id") % 10 > 0, S("user_id")).otherwise("").alias("user_email"), F.col("ts").alias("finished_at"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.lit("p").alias("provider"), F.lit("m").alias("model"), (i % 100).alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), F.lit(1).alias("findings"))
    parts = []
    for ci, runs in ((False, e.filter("scan_id % 3 <> 0")), (True, e.filter("scan_id % 3 = 0"))):
        for kind, rows in history.run_rows(runs, F.lit("2026-01-01").cast("timestamp"), ci).items():
            ok = F.count_if(F.col("status") == "ok") if kind == "scans" else F.lit(None).cast("long")
            tokens = F.sum("input_tokens") if kind in ("usage", "monthly") else F.lit(None).cast("long")
            parts.append(rows.agg(F.lit(kind).alias("kind"), F.lit(ci).alias("ci"), F.count(F.lit(1)).alias("n"), ok.alias("ok"), tokens.alias("tokens")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


CALLS = ["can_read(x); query(y); foo(z)", "get_user(u).filter_by(a); verify_token(t)", "if (a) print(b)", "cursor(); Update(); helper_1(); zeta(); alpha(); beta(); gamma(); delta(); eps_(); eta_(); iota()"]


@query(f"""
WITH s AS (SELECT doc_id, {pick_sql("doc_id % 5", CALLS, "none")} || chr(10) || coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS p, '{kind}' AS kind, unnest(regexp_extract_all(t, {sql_text(pattern.replace('U)', ')').replace('(?)', ''))}, 1)) AS name FROM s" for i, (kind, pattern) in enumerate(context.CALLEES))}),
m AS (SELECT doc_id, name, min(struct_pack(p := p, kind := kind)) AS b FROM k WHERE p < 3 OR name NOT IN ({", ".join(map(sql_text, context.NOT_CALLED))}) GROUP BY 1, 2),
r AS (SELECT doc_id, name, b.kind AS kind, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b.p, name) AS INTEGER) AS place FROM m)
SELECT doc_id, name, kind, place FROM r WHERE place <= 10
""")
def callees_of_snippets(spark, sf_dir):
    """Calls in whole texts, with some lines of code before them."""
    t = F.concat(pick(F.col("doc_id") % 5, CALLS, "none"), F.lit("\n"), F.coalesce("text", F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(context.callees(t)).alias("pos", "c"))
    return d.select("doc_id", "c.name", "c.kind", (F.col("pos") + 1).alias("place"))


STACKS = ["@login_required\n@app.route('/x')\ndef f():", "@admin_required(1)\n\ndef g():", "@cached\n@jwt_required\nasync def h():", "@protected\nclass A:"]


@query(rf"""
WITH s AS (SELECT doc_id, 'x' || chr(10) || {pick_sql("doc_id % 5", STACKS, "def k():")} AS t FROM documents),
l AS (SELECT doc_id, i AS line, string_split(t, chr(10))[i] AS x FROM (SELECT doc_id, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM s)),
d AS (SELECT *, regexp_extract(x, '^\s*@([\w.]+(?:\([^)]*\))?)\s*$', 1) AS name FROM l),
e AS (SELECT *, first_value(CASE WHEN name = '' THEN regexp_matches(x, '^\s*(?:async\s+)?def\s+\w+') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM d)
SELECT doc_id, CAST(line AS INTEGER) AS line, name FROM e WHERE name <> '' AND f AND regexp_matches(name, {sql_text(access.GUARD_NAMES)})
""")
def guarding_decorators(spark, sf_dir):
    """Stacks over a function, over a class, and with a line between."""
    t = F.concat(F.lit("x\n"), pick(F.col("doc_id") % 5, STACKS, "def k():"))
    lines = context.lines_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), t.alias("content")))
    return access.guarding_decorators(lines).select(F.col("path").alias("doc_id"), "line", "name")


FIXES = ["```py\nx = 1\n```", "```py\n# add your check\n```", "```py\nrun(c, shell=True)\n```", "no code", "```py\nDEBUG = 1\n```", "```py\n" + "y\n" * 21 + "```"]
FIX_IDS = ["A03:2021", "A01:2021", "SECRET-001", "A05:2021"]
FIX_PATHS = ["app/", "Auth/", "app/conf/"]
FIX_LINES = ["2", "2-3", "3–3", "1-99", "x"]


@query(f"""
WITH s AS (SELECT doc_id, {pick_sql("doc_id % 7", FIXES)} AS fix, {pick_sql("doc_id % 4", FIX_IDS)} AS id, {pick_sql("doc_id % 3", FIX_PATHS)} || doc_id || '.py' AS path, {pick_sql("doc_id % 6", FIX_LINES, "2")} AS r, doc_id % 11 = 0 AS gone, {pick_sql("doc_id % 5", ["A pickle is read"], "A flaw")} AS d, doc_id % 13 = 0 AS had FROM documents),
k AS (SELECT *, CASE WHEN starts_with(id, 'A01:') THEN id WHEN contains(d, 'pickle') THEN 'pickle' END AS cat, starts_with(path, 'Auth/') AS prot,
  CASE WHEN r IN ('1-99') THEN 99 WHEN r = '2-3' THEN 2 WHEN r <> 'x' THEN 1 END AS n, coalesce(contains(fix, 'DEBUG'), false) AS var FROM s),
o AS (SELECT *, CASE WHEN id = 'SECRET-001' THEN NULL WHEN r = 'x' OR gone OR fix IS NULL OR fix = 'no code' THEN 'no drop-in' WHEN contains(fix, '# add') THEN 'sketch' WHEN n > 20 OR contains(fix, 'y') AND NOT contains(fix, 'x = 1') AND NOT contains(fix, 'DEBUG') AND NOT contains(fix, 'shell') THEN 'too large'
  WHEN contains(fix, 'shell') AND NOT (had AND r = '2-3' OR had AND r = '2') THEN 'introduces shell=True' END AS reason FROM k)
SELECT doc_id, CASE WHEN id = 'SECRET-001' THEN 'secret' WHEN reason IS NOT NULL THEN 'manual' ELSE 'edit' END AS outcome, reason,
  CASE WHEN id <> 'SECRET-001' AND reason IS NULL THEN nullif(concat_ws('; ', 'category ' || cat, CASE WHEN prot THEN 'protected path' END, CASE WHEN var THEN 'touches DEBUG' END), '') END AS risk_note FROM o
""")
def fix_gates(spark, sf_dir):
    """Fixes of many shapes through the gates."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    path = F.concat(pick(i % 3, FIX_PATHS), S("doc_id"), F.lit(".py"))
    f = d.select("doc_id", pick(i % 7, FIXES).alias("suggested_fix"), pick(i % 4, FIX_IDS).alias("vulnerability_id"), path.alias("affected_file"), pick(i % 6, FIX_LINES, "2").alias("affected_lines"), F.lit("").alias("owasp_reference"), pick(i % 5, ["A pickle is read"], "A flaw").alias("description"))
    files = d.filter("doc_id % 11 <> 0").select(path.alias("path"), F.concat(F.lit("a\n"), F.when(i % 13 == 0, "old(shell=True)").otherwise("b"), F.lit("\nc\n")).alias("content"))
    return fixes.classify_fixes(f, files).select("doc_id", "outcome", "reason", "risk_note")
