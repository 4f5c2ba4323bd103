"""Queries of accounts' changes, deletions, log lines, alerts, replies and snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import context, findings, fixes, history
from ..sources import tools
from ..sources.shared import shared_folder
from .base import as_findings, query, table
from .reviews import S, pick, pick_sql, sql_text

EPOCH = lambda x: F.timestamp_seconds(x)


@query("""
WITH u AS (SELECT 'u' || c_custkey AS email, CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role, CASE WHEN c_custkey % 2 = 0 THEN 5 END AS seen FROM customer),
s AS (SELECT 'u' || (user_id * 2) AS email, bool_or(event_type = 'error') AS is_admin, max(event_id) AS seen FROM events GROUP BY 1)
SELECT email, CASE WHEN s.is_admin THEN 'admin' ELSE coalesce(u.role, 'user') END AS role, CAST(coalesce(s.seen, u.seen) AS BIGINT) AS last_login FROM u FULL JOIN s USING (email)
""")
def last_logins(spark, sf_dir):
    """U2 with the time of the last login."""
    c = F.col("c_custkey")
    users = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), S("c_custkey")).alias("email"), F.when(c % 10 == 0, "admin").otherwise("user").alias("role"), F.lit(None).cast("array<string>").alias("groups"), EPOCH(F.when(c % 2 == 0, 5)).alias("last_login_at"))
    seen = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") * 2).cast("string")).alias("email"), (F.col("event_type") == "error").alias("is_admin"), F.lit(None).cast("array<string>").alias("groups"), EPOCH(F.col("event_id")).alias("at"))
    return history.promote_users(users, seen, at="at").select("email", "role", F.unix_timestamp("last_login_at").alias("last_login"))


@query("""
WITH l AS (SELECT 'u' || (user_id * 3) AS email, user_id, user_id % 7 = 0 AS grp, user_id % 4 AS prov FROM events), n AS (SELECT DISTINCT * FROM l WHERE email NOT IN (SELECT 'u' || c_custkey FROM customer))
SELECT 'u' || c_custkey AS email, 'local' AS auth_provider, 'user' AS role, NULL AS display_name FROM customer
UNION ALL SELECT email, CASE prov WHEN 0 THEN 'local' WHEN 1 THEN 'saml' ELSE 'okta' END, CASE WHEN grp OR user_id IN (500, 501, 502) THEN 'admin' ELSE 'user' END, 'n' || user_id FROM n
""")
def first_logins(spark, sf_dir):
    """Accounts made at the first login, admins by group or by name."""
    now, u = EPOCH(F.lit(1700000000)), F.col("user_id")
    users = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), S("c_custkey")).alias("email"), F.lit("local").alias("auth_provider"), F.lit("user").alias("role"), F.lit(True).alias("is_active"), now.alias("created_at"), now.alias("last_login_at"), F.lit(None).cast("string").alias("display_name"))
    logins = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (u * 3).cast("string")).alias("email"), F.when(u % 7 == 0, F.array(F.lit("staff"), F.lit("admins"))).alias("groups"), pick(u % 4, ["local", "saml", "unknown"]).alias("auth_provider"), F.concat(F.lit("n"), S("user_id")).alias("name"))
    return history.provision(users, logins, ["u1500", "u1503", "u1506"], "admins", now).select("email", "auth_provider", "role", "display_name")


_ACTIONS = ["deactivate", "reactivate", "promote", "demote", "delete"]
_CHANGES = f"""
u AS (SELECT 'u' || c_custkey AS email, CASE WHEN c_custkey % 3 = 0 THEN 'admin' ELSE 'user' END AS role, c_custkey % 4 > 0 AS is_active FROM customer),
r AS (SELECT event_id, 'u' || user_id AS email, 'u' || (user_id + event_id % 2) AS actor, {pick_sql("event_id % 6", _ACTIONS, "demote")} AS action FROM events),
o AS (SELECT r.*, CASE WHEN u.email IS NULL THEN 'not_found' WHEN action = 'delete' THEN 'unknown' WHEN action = 'demote' AND r.email = actor THEN 'own_role' WHEN r.email IN ('u2', 'u3', 'u4') AND action IN ('deactivate', 'demote') THEN 'protected'
  ELSE 'user_' || action || 'd' END AS outcome FROM r LEFT JOIN u USING (email)),
p AS (SELECT event_id, email, actor, action, outcome FROM o)"""


def _account_changes(spark, sf_dir):
    c, i, u = F.col("c_custkey"), F.col("event_id"), F.col("user_id")
    users = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), S("c_custkey")).alias("email"), F.when(c % 3 == 0, "admin").otherwise("user").alias("role"), (c % 4 > 0).alias("is_active"), F.lit(None).cast("timestamp").alias("reactivated_at"))
    asked = table(spark, sf_dir, "events").select(i.alias("request_id"), F.concat(F.lit("u"), S("user_id")).alias("email"), F.concat(F.lit("u"), (u + i % 2).cast("string")).alias("actor"), pick(i % 6, _ACTIONS, "demote").alias("action"), EPOCH(i).alias("at"))
    return history.change_accounts(users, asked, ["u2", "u3", "u4"])


@query(f"""
WITH {_CHANGES},
l AS (SELECT email, arg_max(action, event_id) FILTER (outcome IN ('user_deactivated', 'user_reactivated')) AS a, arg_max(action, event_id) FILTER (outcome IN ('user_promoted', 'user_demoted')) AS b, max(event_id) FILTER (outcome = 'user_reactivated') AS t FROM p GROUP BY 1)
SELECT email, CASE b WHEN 'promote' THEN 'admin' WHEN 'demote' THEN 'user' ELSE role END AS role, CASE a WHEN 'reactivate' THEN true WHEN 'deactivate' THEN false ELSE is_active END AS is_active, CAST(t AS BIGINT) AS reactivated FROM u LEFT JOIN l USING (email)
""")
def changed_accounts(spark, sf_dir):
    """Deactivated, reactivated, promoted and demoted accounts."""
    return _account_changes(spark, sf_dir)[0].select("email", "role", "is_active", F.unix_timestamp("reactivated_at").alias("reactivated"))


@query(f"WITH {_CHANGES} SELECT event_id, outcome FROM p")
def account_change_outcomes(spark, sf_dir):
    """What became of each request."""
    return _account_changes(spark, sf_dir)[1].select(F.col("request_id").alias("event_id"), "outcome")


@query("""
WITH k AS (SELECT DISTINCT event_id * 3 AS k FROM events), a AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 4 = 0), b AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 4 IN (0, 1)),
t AS (SELECT k, CASE WHEN k IN (SELECT k FROM a) THEN 'portal' WHEN k IN (SELECT k FROM b) THEN 'ci' END AS channel FROM k)
SELECT coalesce(channel, 'none') AS what, count(*) AS n FROM t GROUP BY 1
UNION ALL SELECT 'portal left', count(*) FROM a WHERE k NOT IN (SELECT k FROM t WHERE channel = 'portal') UNION ALL SELECT 'ci left', count(*) FROM b WHERE k NOT IN (SELECT k FROM t WHERE channel = 'ci')
""")
def channel_deletes(spark, sf_dir):
    """Each key goes from the first channel that has it; keys in both stay in the second."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).distinct()
    a, b, told = history.delete_by_channel(o.filter("k % 4 = 0"), o.filter("k % 4 IN (0, 1)"), table(spark, sf_dir, "events").select((F.col("event_id") * 3).alias("k")), "k")
    n = F.count(F.lit(1)).alias("n")
    return told.groupBy(F.coalesce("channel", F.lit("none")).alias("what")).agg(n).unionByName(a.agg(F.lit("portal left").alias("what"), n)).unionByName(b.agg(F.lit("ci left").alias("what"), n))


@query("""
SELECT 'repo' || o_custkey % 40 AS repo_url, CAST(sum(o_orderkey % 5) AS BIGINT) AS total_critical, CAST(sum(o_orderkey % 7) AS BIGINT) AS total_high, max(o_orderdate) AS last_scan
FROM orders WHERE o_custkey % 20 = 3 AND o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY 1 ORDER BY total_critical DESC, total_high DESC, repo_url LIMIT 5
""")
def risky_repositories(spark, sf_dir):
    """One user's repositories by Critical, then High findings since a day."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    scans = table(spark, sf_dir, "orders").select((c % 20).cast("string").alias("user_email"), F.col("o_orderdate").alias("started_at"), F.concat(F.lit("repo"), (c % 40).cast("string")).alias("repo_url"), (k % 5).alias("critical"), (k % 7).alias("high"))
    return history.risky_repositories(scans, "3", F.lit("1994-01-01").cast("timestamp_ntz"))


@query("SELECT l_orderkey AS scan_id, count(*) AS n, count(*) FILTER (l_quantity >= 45 AND l_linenumber % 4 = 0 AND l_orderkey % 2 = 0) AS again FROM lineitem GROUP BY 1")
def second_pass_selection(spark, sf_dir):
    """V6: which findings are looked at again: Critical, by the model alone, on the gate's path."""
    f, k = as_findings(spark, sf_dir), F.col("ord") % 4
    sources = F.when(k == 0, F.array(F.lit("claude"))).when(k == 1, F.array(F.lit("claude"), F.lit("bandit"))).when(k == 2, F.array(F.lit("bandit")))
    return f.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(findings.wants_second_pass(F.col("severity"), sources, F.col("scan_id") % 2 == 0)).alias("again"))


@query("""
SELECT 'all' AS choice, s_name AS name FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT 'some', s_name FROM supplier WHERE s_suppkey IN (1, 2, 4, 5)
""")
def rule_packs(spark, sf_dir):
    """All packs that are there, a subset, none, and a subset that lacks a required pack."""
    k = F.col("s_suppkey")
    packs = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (k % 6 == 2).alias("required"), (k % 3 > 0).alias("present"))
    broken = packs.withColumn("present", F.col("present") & ~F.col("required"))
    ids = {r.s_suppkey: r.s_name for r in table(spark, sf_dir, "supplier").filter("s_suppkey IN (1, 2, 3, 4, 5)").select("s_suppkey", "s_name").collect()}
    of = lambda df, which, label: findings.chosen_packs(df, which).select(F.lit(label).alias("choice"), "name")
    return of(packs, None, "all").unionByName(of(packs, list(ids.values()), "some")).unionByName(of(packs, [], "none")).unionByName(of(broken, list(ids.values()), "broken"))


@query("""
SELECT event_id, '{"timestamp":"t' || event_id || '","level":"INFO","message":"m"' || CASE WHEN event_id % 3 = 0 THEN ',"scan_id":"s"' ELSE '' END || ',"ctx_name":"' || event_type || '","password":"[REDACTED]","user":"' || user_id || '"}' AS line,
  event_id % 4 <> 0 AND NOT (event_id % 4 = 1 AND user_id % 5 = 0) AS told FROM events
""")
def log_lines(spark, sf_dir):
    """Log records with fields to blank, to rename and to leave out; which bypasses are told."""
    i = F.col("event_id")
    fields = F.create_map(F.lit("user"), S("user_id"), F.lit("password"), F.lit("x"), F.lit("name"), F.col("event_type"), F.lit("_own"), F.lit("y"))
    line = text.log_line(F.concat(F.lit("t"), S("event_id")), F.lit("INFO"), F.lit("m"), F.when(i % 3 == 0, "s"), fields)
    told = text.alerts(pick(i % 4, ["none", "dev_only", "all"], "other"), F.when(F.col("user_id") % 5 == 0, "pipeline").when(F.col("user_id") % 5 == 1, "app"), "pipeline")
    return table(spark, sf_dir, "events").select("event_id", line.alias("line"), told.alias("told"))


_REPLIES = ['Here: ```json\n[{"vulnerability_id": "A ] \\" x", "severity": "High"}]\n``` and [more]', '{"findings": [{"vulnerability_id": "B"}, null]} tail }', "no json", '[{"vulnerability_id": "C"', '{"a": "]"} [1]']
_PAYLOADS = ['[{"vulnerability_id": "A ] \\" x", "severity": "High"}]', '{"findings": [{"vulnerability_id": "B"}, null]}', None, None, '{"a": "]"}']
_PROMOTES = ["PROMOTES: 1, 3, 9", "text\n promotes : 2,2,1\nend", "PROMOTES: none", "PROMOTES: 1"]


@query(f"""
WITH r AS (SELECT event_id, {pick_sql("event_id % 5", _PAYLOADS)} AS payload, CASE event_id % 4 WHEN 0 THEN [1, 3] WHEN 1 THEN [2, 1] ELSE [] END AS listed, event_id % 4 = 3 AND event_id % 3 > 0 AS one FROM events)
SELECT event_id, payload, CASE WHEN event_id % 3 = 0 THEN '' WHEN one THEN '1' WHEN event_id % 3 = 1 THEN array_to_string(list_filter(listed, lambda x: x <= 2), ',') ELSE array_to_string(listed, ',') END AS promoted FROM r
""")
def reply_parts(spark, sf_dir):
    """JSON cut out of replies, promoted numbers within one, two and five findings."""
    i = F.col("event_id")
    promoted = findings.promotions(pick(i % 4, _PROMOTES), pick(i % 3, [1, 2], 5))
    return table(spark, sf_dir, "events").select("event_id", tools.json_payload(pick(i % 5, _REPLIES)).alias("payload"), F.array_join(promoted, ",").alias("promoted"))


@query(f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS raw, CAST(doc_id % 9 AS INTEGER) AS s, doc_id % 3 = 0 AS wide, CASE WHEN doc_id % 2 = 0 THEN doc_id % 9 + doc_id % 4 END AS e, doc_id FROM documents),
n AS (SELECT *, CASE WHEN raw[-1] = '' THEN raw[:-2] ELSE raw END AS ls, CASE WHEN wide THEN 14 ELSE 8 END AS w FROM d),
b AS (SELECT *, greatest(s - w + 1, 1) AS a, coalesce(nullif(e, 0), s) + w AS z FROM n)
SELECT doc_id, array_to_string(CASE WHEN s = 0 THEN ls[1:30] ELSE ls[a:least(z, a + 29)] END, chr(10)) AS snippet,
  regexp_replace('<DATA>' || doc_id || '</data >', '(?i)<(/?)\\s*data', '&lt;\\1data', 'g') AS inner_text, replace(replace(replace(replace('a<"' || doc_id || '">&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS attribute FROM b
WHERE true""")
def snippets(spark, sf_dir):
    """Lines around a place in whole texts; texts made safe for a tag and for an attribute."""
    i = F.col("doc_id")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    cut = context.snippet(lines, (i % 9).cast("int"), F.when(i % 2 == 0, i % 9 + i % 4), i % 3 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", cut.alias("snippet"), text.defanged(F.concat(F.lit("<DATA>"), S("doc_id"), F.lit("</data >")), "data").alias("inner_text"), text.attribute(F.concat(F.lit('a<"'), S("doc_id"), F.lit('">&'))).alias("attribute"))


_SHAPES = [
    ("@bp.route('/a', methods=['PUT', 'patch'])\ndef one(): pass", ".py", [(0, "flask", "/a", "PUT", "one"), (0, "flask", "/a", "PATCH", "one")]),
    ("@api.get('/b')\n\n\nasync def two(x): pass", ".py", [(0, "fastapi", "/b", "GET", "two")]),
    ("x\nrouter.add_route('post', '/c', three)\napp.router.add_delete('/d', four)", ".py", [(1, "aiohttp", "/c", "POST", "three"), (2, "aiohttp", "/d", "DELETE", "four")]),
    ("urls = [re_path(r'^e/$', views.five)]", ".py", [(0, "django", "^e/$", "ANY", "views.five")]),
    ("app.post('/f', (req) => 1)\nrouter.all(`/g`, six)", ".js", [(0, "express", "/f", "POST", "<anonymous>"), (1, "express", "/g", "ALL", "six")]),
    ('  r.Any("/h", Seven)', ".go", [(0, "gin", "/h", "ANY", "Seven")]),
    ("@app.route('/i')" + "\n" * 7 + "def late(): pass", ".py", [(0, "flask", "/i", "GET", "<unknown>")]),
    ("@app.route('/j')\ndef no(): pass", ".txt", []),
]
_ROUTES = " UNION ALL ".join(f"SELECT {i} AS k, {line + 1} AS line, '{fw}' AS framework, {sql_text(route)} AS route, '{m}' AS method, '{h}' AS handler" for i, (_, _, rows) in enumerate(_SHAPES) for line, fw, route, m, h in rows)


@query(f"WITH r AS ({_ROUTES}) SELECT doc_id, CAST(line AS INTEGER) AS line, framework, route, method, handler FROM documents JOIN r ON r.k = doc_id % {len(_SHAPES)}")
def routes_of_files(spark, sf_dir):
    """Every known shape of a route, and one in a file of another kind."""
    k = F.col("doc_id") % len(_SHAPES)
    f = table(spark, sf_dir, "documents").select(F.concat(S("doc_id"), pick(k, [e for _, e, _ in _SHAPES])).alias("path"), pick(k, [t for t, _, _ in _SHAPES]).alias("content"))
    return context.routes(context.lines_of(f)).select(F.regexp_extract("path", r"^\d+", 0).cast("long").alias("doc_id"), "line", "framework", "route", "method", "handler")


_BODY = "def a():\n  x = 1\n\n\ndef b():\n  y"


@query(rf"""
WITH l AS (SELECT doc_id, CAST(i AS INTEGER) AS line, string_split(t, chr(10))[i] AS x FROM (SELECT doc_id, {sql_text(_BODY)} || repeat(chr(10) || 'z', CAST(doc_id % 60 AS INTEGER)) AS t, unnest(range(1, 7 + doc_id % 60)) AS i FROM documents)),
d AS (SELECT *, nullif(regexp_extract(x, '^\s*def\s+(\w+)', 1), '') AS n FROM l)
SELECT doc_id, line, last_value(n IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS function, first_value(n IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS next_function FROM d
""")
def functions_around(spark, sf_dir):
    """The function at or above a line within 50 lines, and the next one within six."""
    f = table(spark, sf_dir, "documents").select(F.concat(S("doc_id"), F.lit(".py")).alias("path"), F.concat(F.lit(_BODY), F.repeat(F.lit("\nz"), (F.col("doc_id") % 60).cast("int"))).alias("content"))
    return context.functions_of(context.lines_of(f)).select(F.regexp_extract("path", r"^\d+", 0).cast("long").alias("doc_id"), "line", "function", "next_function")


@query("""
WITH f AS (SELECT l_orderkey AS scan, l_partkey, l_partkey % 3 AS k, 'p' || l_partkey || ':' || CASE WHEN l_partkey % 2 = 0 THEN '4' ELSE '' END || ' (V' || l_suppkey || ')' AS at_, l_suppkey FROM lineitem)
SELECT scan, coalesce(string_agg(CASE WHEN k = 0 THEN at_ || CASE WHEN l_suppkey % 2 = 0 THEN ' — note' ELSE '' END END, '|' ORDER BY at_ || CASE WHEN l_suppkey % 2 = 0 THEN ' — note' ELSE '' END), '') AS applied,
  coalesce(string_agg(CASE WHEN k = 1 THEN at_ || ' — why' END, '|' ORDER BY at_ || ' — why'), '') AS manual, coalesce(string_agg(DISTINCT CASE WHEN k = 2 THEN 'p' || l_partkey END, '|' ORDER BY CASE WHEN k = 2 THEN 'p' || l_partkey END), '') AS secret_files FROM f GROUP BY 1
""")
def review_sections(spark, sf_dir):
    """By run the edits with their notes, the manual fixes with their reasons, the files with secrets."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan"), pick(p % 3, ["edit", "manual"], "secret").alias("outcome"), F.concat(F.lit("p"), S("l_partkey")).alias("affected_file"), F.when(p % 2 == 0, "4").alias("affected_lines"), F.concat(F.lit("V"), S("l_suppkey")).alias("vulnerability_id"), F.when((p % 3 == 0) & (s % 2 == 0), "note").alias("risk_note"), F.when(p % 3 == 1, "why").alias("reason"))
    return fixes.review_sections(f, ["scan"]).select("scan", *[F.array_join(c, "|").alias(c) for c in ("applied", "manual", "secret_files")])


@query("""
WITH r AS (SELECT o_orderkey, o_custkey % 5 > 0 AS known FROM orders)
SELECT 'b1' AS batch, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM r WHERE known AND o_orderkey % 2 = 0 UNION ALL SELECT 'b2', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM r WHERE known AND o_orderkey % 2 = 1
""")
def published_runs(spark, sf_dir):
    """Runs appended in batches, one of them twice, and read back; a batch without its manifest isn't there."""
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(
        k.alias("scan_id"), F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("u"), S("o_custkey"))).alias("user_email"), F.col("o_orderdate").alias("finished_at"), F.col("o_orderstatus").alias("status"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"), F.lit(0).alias("findings")
    )
    root, now = shared_folder(spark, "history"), EPOCH(F.lit(1700000000))
    for batch, odd in (("b1", 0), ("b1", 0), ("b2", 1)):
        history.publish(history.run_rows(runs.filter(k % 2 == odd), now), root, batch)
    history.run_rows(runs, now)["scans"].write.parquet(f"{root}/scans/batch=b3")
    return history.published(spark, root, "scans").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("scan_id").alias("ids"))


#: A line for each anti-pattern, in their order, and lines that are none.
_LINES = [
    "get(u, verify = False)", "c = C(use_ssl=False)", "x.check_hostname = false", "m = ssl.CERT_NONE", "ssl._create_unverified_context()", "{ rejectUnauthorized: false }", "NODE_TLS_REJECT_UNAUTHORIZED='0'", "curl --insecure u",
    "allow_origins=['*']", "'Access-Control-Allow-Origin': '*'", "CORS_ORIGIN_ALLOW_ALL = True", "auth_disabled=True", "login_required = False", "@csrf.exempt", "WTF_CSRF_ENABLED = False", "SESSION_COOKIE_SECURE = False", "CSRF_COOKIE_SECURE=False",
    "SESSION_COOKIE_HTTPONLY = False", "SECURE_SSL_REDIRECT = False", "permission_classes = [AllowAny]", "authentication_classes = []", "{'alg': 'none'}", "decode(t, algorithms=[])", "{'verify_signature': False}", "eval(x)", "exec (x)", "run(c, shell=True)",
    "os.system(c)", "pickle.loads(b)", "marshal.load(f)", "yaml.unsafe_load(f)", "yaml.load(f)", "__import__ (n)", "dill.load(f)", "jsonpickle.decode(s)", "pd.read_pickle(f)", "torch.load(f)", "joblib.load(f)", "hashlib.md5(b)", "hashlib.new('sha1')",
    "DES.new(k)", "ssl.PROTOCOL_TLSv1", "app.run(debug=True)", "FLASK_DEBUG=1", "SECRET_KEY = 'test'", "chmod -R 0777 d", "os.umask(0)", "tempfile.mktemp()", "z.extractall(d)",
    "yaml.load(f, Loader=L)", "hashlib.md5(b, usedforsecurity=False)", "verify=True", "safe()",
]
_BAD = lambda c, p, ok: f"(regexp_matches({c}, {sql_text(p)})" + (f" AND NOT regexp_matches({c}, {sql_text(ok)}))" if ok else ")")


@query(f"""
WITH d AS (SELECT doc_id, {pick_sql(f"doc_id % {len(_LINES)}", _LINES)} AS new, {pick_sql(f"(doc_id // 7) % {len(_LINES)}", _LINES)} AS old FROM documents),
p AS (SELECT DISTINCT new, old FROM d), l AS (SELECT new, old, CASE {" ".join(f"WHEN {_BAD('new', p, ok)} AND NOT {_BAD('old', p, ok)} THEN {sql_text(label)}" for label, p, ok in fixes.ANTI_PATTERNS)} END AS label FROM p)
SELECT doc_id, label FROM d JOIN l USING (new, old)
""")
def introduced_patterns(spark, sf_dir):
    """Each of the anti-patterns put in, some of them there before."""
    i, n = F.col("doc_id"), len(_LINES)
    of = lambda key: F.get(F.array(*map(F.lit, _LINES)), key.cast("int"))
    # Bound once, so that the lines are picked once and not for each pattern.
    pair = F.array(F.struct(of(F.floor(i / 7) % n).alias("old"), of(i % n).alias("new")))
    return table(spark, sf_dir, "documents").select("doc_id", F.get(F.transform(pair, lambda x: fixes.introduced(x["old"], x["new"])), 0).alias("label"))


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Tests/' WHEN 1 THEN 'a/__tests__/' WHEN 2 THEN 'a\test\' WHEN 3 THEN 'contest/' WHEN 4 THEN 'a/tests/' ELSE '' END || doc_id || CASE doc_id % 8 WHEN 0 THEN '.PY' WHEN 1 THEN '.spec.js' WHEN 2 THEN '.rb' WHEN 3 THEN '.test.tsx' WHEN 4 THEN '.kt.txt' WHEN 5 THEN '.rs' WHEN 6 THEN '.go' ELSE '' END AS path FROM documents)
SELECT doc_id, doc_id % 6 IN (0, 1, 2, 4) OR doc_id % 8 IN (1, 3) AS test_file, doc_id % 8 IN (0, 1, 2, 3, 5, 6) AS code_file FROM d
""")
def path_kinds(spark, sf_dir):
    """tests as the search for callers sees them, files of code."""
    i = F.col("doc_id")
    path = F.concat(pick(i % 6, ["Tests/", "a/__tests__/", "a\\test\\", "contest/", "a/tests/"], ""), S("doc_id"), pick(i % 8, [".PY", ".spec.js", ".rb", ".test.tsx", ".kt.txt", ".rs", ".go"], ""))
    return table(spark, sf_dir, "documents").select("doc_id", paths.caller_test_file(path).alias("test_file"), paths.code_file(path).alias("code_file"))
