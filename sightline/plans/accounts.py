"""Queries of accounts, claims and settings, of other tools' raw output, and of code lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import context, findings, history
from ..sources import tools
from .base import query, table
from .reviews import S, pick, pick_sql, sql_text

MAIL = lambda c: F.concat(F.lit("u"), c.cast("string"))


@query("""
WITH u AS (SELECT 'u' || c_custkey AS email, CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role, 'n' || c_nationkey AS groups FROM customer),
s AS (SELECT 'u' || (user_id * 2) AS email, bool_or(event_type = 'error') AS is_admin, arg_max(CASE WHEN event_id % 3 = 0 THEN event_type END, event_id) AS groups FROM events GROUP BY 1)
SELECT email, CASE WHEN s.is_admin THEN 'admin' ELSE coalesce(u.role, 'user') END AS role, coalesce(s.groups, u.groups) AS groups FROM u FULL JOIN s USING (email)
""")
def user_promotion(spark, sf_dir):
    """Many logins by user, users with and without one, logins of new users."""
    users = table(spark, sf_dir, "customer").select(MAIL(F.col("c_custkey")).alias("email"), F.when(F.col("c_custkey") % 10 == 0, "admin").otherwise("user").alias("role"), F.array(F.concat(F.lit("n"), S("c_nationkey"))).alias("groups"))
    seen = table(spark, sf_dir, "events").select(MAIL(F.col("user_id") * 2).alias("email"), (F.col("event_type") == "error").alias("is_admin"), F.when(F.col("event_id") % 3 == 0, F.array("event_type")).alias("groups"), "event_id")
    return history.promote_users(users, seen, "event_id").withColumn("groups", F.array_join("groups", ","))


@query("""
WITH t AS (SELECT 'u' || o_custkey AS u, 't' || o_orderkey AS token, o_orderkey, o_orderstatus = 'F' AS closed FROM orders), r AS (SELECT 'u' || c_custkey AS u FROM customer WHERE c_custkey % 3 = 0)
SELECT u AS "user", token, FALSE AS issued_now, CASE WHEN closed THEN 'before' WHEN u IN (SELECT u FROM r) THEN 'now' END AS revoked FROM t
UNION ALL SELECT u, 'n-' || u, TRUE, NULL FROM r
""")
def token_rotation(spark, sf_dir):
    """Some tokens are closed already; each request comes twice."""
    before, now = F.timestamp_seconds(F.lit(800000000)), F.timestamp_seconds(F.lit(1700000000))
    tokens = table(spark, sf_dir, "orders").select(MAIL(F.col("o_custkey")).alias("user"), F.concat(F.lit("t"), S("o_orderkey")).alias("token"), before.alias("issued_at"), F.when(F.col("o_orderstatus") == "F", before).alias("revoked_at"))
    asked = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(MAIL(F.col("c_custkey")).alias("user"))
    asked = asked.unionByName(asked).withColumn("new_token", F.concat(F.lit("n-"), "user"))
    out = history.rotate(tokens, asked, now)
    return out.select("user", "token", (F.col("issued_at") == now).alias("issued_now"), F.when(F.col("revoked_at") == now, "now").when(F.col("revoked_at") == before, "before").alias("revoked"))


REQUESTS = """r AS (SELECT event_id, 'u' || user_id AS email, 'u' || (user_id + event_id % 3) AS actor, event_type IN ('signup', 'click') AS active FROM events),
ok AS (SELECT * FROM r WHERE email NOT IN ('u1', 'u2', 'u3') AND (email <> actor OR active))"""


def flag_requests(spark, sf_dir):
    e, user = table(spark, sf_dir, "events"), F.col("user_id")
    users = table(spark, sf_dir, "customer").select(MAIL(F.col("c_custkey")).alias("email"), (F.col("c_custkey") % 4 != 0).alias("is_active"))
    asked = e.select(F.col("event_id").alias("request_id"), MAIL(user).alias("email"), MAIL(user + F.col("event_id") % 3).alias("actor"), F.col("event_type").isin("signup", "click").alias("active"))
    return history.set_flags(users, asked, ["u1", "u2", "u3"], F.timestamp_seconds(F.lit(1700000000)))


@query(f"""
WITH {REQUESTS}, l AS (SELECT email, arg_max(active, event_id) AS wanted FROM ok GROUP BY 1)
SELECT email, coalesce(wanted, c_custkey % 4 <> 0) AS is_active FROM (SELECT *, 'u' || c_custkey AS email FROM customer) LEFT JOIN l USING (email)
""")
def account_flags(spark, sf_dir):
    """Protected accounts and one's own demotion are left alone; the last request counts."""
    return flag_requests(spark, sf_dir)[0]


@query(f"WITH {REQUESTS} SELECT CASE WHEN active THEN 'user_reactivated' ELSE 'user_deactivated' END AS event_type, email AS user_email, actor AS actor_email FROM ok")
def account_flag_audit(spark, sf_dir):
    """A row for each request that was granted."""
    return flag_requests(spark, sf_dir)[1].drop("at")


@query("""
WITH c AS (SELECT event_id, CASE WHEN event_id % 17 > 0 THEN 'k' || event_id % 3 END AS kid, CASE WHEN event_id % 23 > 0 THEN event_id % 7 > 0 END AS verified, CASE WHEN event_id % 19 > 0 THEN 1000000000 + event_id % 101 END AS exp,
  CASE WHEN event_id % 5 = 0 THEN 1000000090 + event_id % 21 END AS nbf, CASE user_id % 3 WHEN 0 THEN 'own/ci/' || user_id WHEN 1 THEN '' END AS job, CASE user_id % 4 WHEN 0 THEN 'own/ci' WHEN 1 THEN 'own/other' ELSE NULL END AS flow, CASE WHEN user_id % 5 > 0 THEN 'x/' || user_id ELSE '' END AS repository FROM events)
SELECT event_id, CASE WHEN kid IS NULL OR kid NOT IN ('k0', 'k1') THEN 'key' WHEN NOT coalesce(verified, false) THEN 'claims' WHEN exp IS NULL OR exp <= 1000000040 THEN 'expired' WHEN nbf > 1000000100 THEN 'not_yet'
  WHEN NOT starts_with(coalesce(nullif(job, ''), flow, ''), 'own/ci') THEN 'not_allowed' WHEN repository = '' THEN 'repository' END AS reason FROM c
""")
def claim_checks(spark, sf_dir):
    """keys, results of the signature, expiry and not-before on both sides of the skew, workflows in and out of the list, repositories."""
    i, u = F.col("event_id"), F.col("user_id")
    claims = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(i % 17 > 0, F.concat(F.lit("k"), (i % 3).cast("string"))).alias("kid"),
        F.when(i % 23 > 0, i % 7 > 0).alias("verified"),
        F.when(i % 19 > 0, 1000000000 + i % 101).alias("exp"),
        F.when(i % 5 == 0, 1000000090 + i % 21).alias("nbf"),
        F.when(u % 3 == 0, F.concat(F.lit("own/ci/"), S("user_id"))).when(u % 3 == 1, "").alias("job_workflow_ref"),
        F.when(u % 4 == 0, "own/ci").when(u % 4 == 1, "own/other").alias("workflow_ref"),
        F.when(u % 5 > 0, F.concat(F.lit("x/"), S("user_id"))).otherwise("").alias("repository"),
    )
    return history.identity_outcome(claims, ["k0", "k1"], ["own/ci"], F.timestamp_seconds(F.lit(1000000070))).select("event_id", "reason")


@query("""
WITH u AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN 's' || c_custkey END AS subject, 'e' || c_custkey AS email, c_custkey % 5 = 0 AS is_local FROM customer),
l AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 's' || user_id END AS subject, 'e' || (user_id + event_id % 4) AS email FROM events),
j AS (SELECT event_id, a.id AS u1, b.id AS u2, a.id IS NULL AND coalesce(b.is_local, FALSE) AS conflict FROM l LEFT JOIN u a ON l.subject = a.subject LEFT JOIN u b ON l.email = b.email)
SELECT event_id, CASE WHEN NOT conflict THEN coalesce(u1, u2) END AS user_id, conflict FROM j
""")
def identity_resolution(spark, sf_dir):
    """Subjects known, unknown and null; e-mails of the same and of other users, of none and of local accounts."""
    c, i = F.col("c_custkey"), F.col("event_id")
    users = table(spark, sf_dir, "customer").select(c.alias("user_id"), F.when(c % 3 > 0, F.concat(F.lit("s"), c.cast("string"))).alias("subject"), F.concat(F.lit("e"), c.cast("string")).alias("email"), (c % 5 == 0).alias("is_local"))
    logins = table(spark, sf_dir, "events").select("event_id", F.when(i % 2 == 0, F.concat(F.lit("s"), S("user_id"))).alias("subject"), F.concat(F.lit("e"), (F.col("user_id") + i % 4).cast("string")).alias("email"))
    return history.resolve_identity(logins, users).select("event_id", "user_id", "conflict")


DAYS, SWITCH = ["30", "x", "", "007"], [" ON ", "no", "True", "1", "yes "]


@query(f"""
WITH r AS (SELECT event_id, event_id % 40 - 10 AS p, {pick_sql("event_id % 5", DAYS)} AS d, {pick_sql("event_id % 6", SWITCH)} AS e FROM events)
SELECT event_id, least(greatest(p, 1), 16) AS parallelism, CASE WHEN regexp_full_match(d, '[0-9]+') THEN CAST(d AS INTEGER) END AS retention_days, coalesce(lower(trim(e)) IN ('1', 'on', 'true', 'yes'), FALSE) AS enabled FROM r
""")
def settings_rows(spark, sf_dir):
    """F27."""
    i = F.col("event_id")
    return history.settings_row(table(spark, sf_dir, "events").select("event_id", (i % 40 - 10).alias("parallelism"), pick(i % 5, DAYS).alias("retention_days"), pick(i % 6, SWITCH).alias("enabled")))


@query("""
WITH m AS (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer),
g AS (SELECT c_custkey, h, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM m)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'portal:' || id || ',' END || 'CI:' || upper(id) AS ids FROM g
""")
def scan_id_lists(spark, sf_dir):
    """lists with blanks around items, items without a source, without hyphens, and a good one in every third list spoilt by a letter."""
    k = S("c_custkey")
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    t = table(spark, sf_dir, "customer").select("c_custkey", F.md5(k.cast("binary")).alias("h"))
    t = t.withColumn("id", F.concat_ws("-", *[F.substring("h", a, n) for a, n in cuts]))
    first = F.concat(F.lit("portal:"), "id", F.when(F.col("c_custkey") % 3 == 0, "g").otherwise(""))
    value = F.concat_ws(",", first, F.lit(" "), F.col("id"), F.concat(F.lit("ci:"), "h"), F.concat(F.lit(" CI:"), F.upper("id"), F.lit(" ")))
    return t.select("c_custkey", F.array_join(history.id_list(value), ",").alias("ids"))


URLS = ["https://git.example.org/o{k}/r.x.git", "git@git.example.org:o{k}/r", "https://git.example.org/r{k}", "ftp://git.example.org/o{k}/r", "http://git.example.org/o{k}/r/", "a|b{k}"]
URL_SQL = "CASE {} END".format(" ".join(f"{'WHEN o_orderkey % 6 = ' + str(i) + ' THEN' if i < 5 else 'ELSE'} replace({sql_text(u)}, '{{k}}', CAST(o_custkey AS VARCHAR))" for i, u in enumerate(URLS)))


@query(f"""
WITH u AS (SELECT o_orderkey, {URL_SQL} AS u FROM orders),
p AS (SELECT *, regexp_extract(u, '^(?:https?://[^/]+/|git@[^:]+:)([^/]+)/([^/]+?)(?:\\.git)?/?$', ['owner', 'name']) AS m, list_filter(regexp_split_to_array(regexp_replace(u, '(\\.git)?/*$', ''), '[/:]'), lambda x: x <> '') AS s FROM u)
SELECT o_orderkey, nullif(m.owner, '') AS owner, nullif(m.name, '') AS name, CASE WHEN len(s) >= 2 THEN s[-2] || '/' || s[-1] ELSE u END AS display, repeat('*', length(u) - 4) || right(u, 4) AS masked, replace(u, '|', '\\|') AS cell FROM p
""")
def repo_names(spark, sf_dir):
    """Both shapes of repository URLs and others."""
    o = table(spark, sf_dir, "orders")
    u = o.select("o_orderkey", F.replace(pick(F.col("o_orderkey") % 6, URLS[:5], URLS[5]), F.lit("{k}"), S("o_custkey")).alias("u"))
    parts = text.repo_parts(F.col("u"))
    return u.select("o_orderkey", parts["owner"].alias("owner"), parts["name"].alias("name"), text.repo_display(F.col("u")).alias("display"), text.masked(F.col("u")).alias("masked"), text.table_cell(F.col("u")).alias("cell"))


# ---- raw output of tools -----------------------------------------------------------------

LEVELS = ["HIGH", "medium", "Low", "odd"]


@query(f"""
WITH e AS (SELECT event_id AS i, event_id % 4 AS k, event_id % 50 + 1 AS n, {pick_sql("event_id % 5", LEVELS)} AS level, {pick_sql("event_id % 7", ["LOW", "low"], "HIGH")} AS sure FROM events)
SELECT i, 'bandit' AS tool, 'a' || i || '.py' AS file, n AS line_start, CASE WHEN i % 3 = 0 THEN n ELSE n + 2 END AS line_end, 'B1' AS raw_rule_id, 'b' AS message, CASE WHEN lower(level) IN ('high', 'medium', 'low') THEN lower(level) ELSE 'medium' END AS severity_hint FROM e WHERE k = 0
UNION ALL SELECT i, 'gosec', 'a' || i || '.go', n, CASE WHEN i % 3 = 0 THEN n ELSE n + 3 END, 'G1', 'g', CASE WHEN lower(level) IN ('high', 'medium', 'low') THEN lower(level) ELSE 'medium' END FROM e WHERE k = 1 AND sure = 'HIGH'
UNION ALL SELECT i, 'eslint', 'a' || i || '.js', n, CASE WHEN i % 3 = 0 THEN n ELSE n + 1 END, 'no-eval', 'm', CASE WHEN i % 8 = 2 THEN 'high' ELSE 'medium' END FROM e WHERE k = 2
""")
def tool_findings(spark, sf_dir):
    """One JSON text an event; ranges given or not, unknown levels, low confidence, items without a rule, torn texts (k = 3)."""
    i, n = F.col("event_id"), F.col("event_id") % 50 + 1
    e = table(spark, sf_dir, "events").select(i.alias("i"), (i % 4).alias("k"), n.alias("n"), pick(i % 5, LEVELS).alias("level"), pick(i % 7, ["LOW", "low"], "HIGH").alias("sure"))
    third, num = F.col("i") % 3 == 0, lambda d: (F.col("n") + d).cast("string")
    level = F.when(F.col("level").isNotNull(), F.concat(F.lit('"'), "level", F.lit('"'))).otherwise("null")
    bandit = F.format_string('{"results":[{"filename":"/w/a%d.py","test_id":"B1","line_number":%d,"line_range":[%s],"issue_text":"b","issue_severity":%s},{"filename":"x","line_number":1}]}', "i", "n", F.when(third, "").otherwise(F.concat(num(0), F.lit(","), num(2))), level)
    gosec = F.format_string('{"Issues":[{"file":"a%d.go","rule_id":"G1","line":"%s","details":"g","severity":%s,"confidence":"%s"},{"file":"y","rule_id":"G2","line":"no"}]}', "i", F.when(third, num(0)).otherwise(F.concat(num(0), F.lit("-"), num(3))), level, "sure")
    eslint = F.format_string('[{"filePath":"a%d.js","messages":[{"ruleId":"no-eval","line":%d%s,"message":"m","severity":%d},{"ruleId":null,"line":3}]}]', "i", "n", F.when(third, "").otherwise(F.concat(F.lit(',"endLine":'), num(1))), F.when(F.col("i") % 8 == 2, 2).otherwise(1))
    k = F.col("k")
    raw = e.select("i", pick(k, ["bandit", "gosec", "eslint"], "bandit").alias("tool_name"), F.when(k == 0, bandit).when(k == 1, gosec).when(k == 2, eslint).otherwise('{"results":[').alias("json"))
    out = tools.candidates(raw, keep=["i"])
    return out.withColumn("file", F.regexp_replace("file", "^/w/", "")).withColumns({c: F.col(c).cast("long") for c in ("line_start", "line_end")})


ANSWERS = ["yes", " YES, it is", "no", "uncertain", "", "yesterday"]


@query(f"""
WITH a AS (SELECT event_id, {pick_sql("event_id % 8", ANSWERS)} AS a, event_id % 3 AS critical, {pick_sql("event_id % 5", ["ok", " ", ""])} AS j FROM events)
SELECT event_id, CASE WHEN starts_with(lower(trim(a)), 'yes') THEN 'verified' ELSE 'conflicting' END AS second, CASE WHEN critical > 0 AND trim(coalesce(j, '')) = '' THEN 'rejected' ELSE 'bypassed' END AS bypass FROM a
""")
def second_opinions(spark, sf_dir):
    """V6, F24."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", findings.blind_pass(pick(i % 8, ANSWERS)).alias("second"), findings.bypass(i % 3, pick(i % 5, ["ok", " ", ""])).alias("bypass"))


# ---- lines of code ------------------------------------------------------------------------

ENDS = [".py", ".js", ".go", "_test.py", ".txt"]
CODE = ["def f{k}(x):", "    y = f{k}(1) + f{j}(2)", "@login_required", "user = Depends(get_user{k})", "app.use('/x', auth{k})", "if row.owner_id == current_user.id:", "if (post.userId !== req.user.id) {", "data = request.files['f']", "upload = multer({ dest: 'x' })", "file, _, _ := r.FormFile(name)", "func f{k}(w Writer) {", "x = 1"]
LINES = f"""c AS (SELECT 'd' || user_id % 40 || {pick_sql("user_id % 6", ENDS, "")} AS path, {pick_sql("user_id % 6", ENDS, "")} AS ending, event_id AS line,
  replace(replace({pick_sql(f"event_id % {len(CODE) + 1}", CODE, "")}, '{{k}}', CAST(event_id % 9 AS VARCHAR)), '{{j}}', CAST(event_id % 7 AS VARCHAR)) AS text FROM events)"""


def code_lines(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    line = F.replace(F.replace(pick(i % (len(CODE) + 1), CODE, ""), F.lit("{k}"), (i % 9).cast("string")), F.lit("{j}"), (i % 7).cast("string"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("d"), (u % 40).cast("string"), pick(u % 6, ENDS, "")).alias("path"), i.alias("line"), line.alias("text"))


@query(f"""
WITH {LINES}, s AS (SELECT DISTINCT path, line, text, unnest(regexp_extract_all(text, '\\b(\\w+)\\s*\\(', 1)) AS name,
  nullif(regexp_extract(text, CASE WHEN ending IN ('.py', '_test.py') THEN '^\\s*(?:async\\s+)?def\\s+(\\w+)\\s*\\(' WHEN ending = '.js' THEN '^\\s*(?:export\\s+)?(?:async\\s+)?function\\s+(\\w+)\\s*\\(' WHEN ending = '.go' THEN '^\\s*func\\s+(\\w+)\\s*\\(' ELSE '^x^' END, 1), '') AS defined FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, line) AS rn FROM s WHERE name IS DISTINCT FROM defined AND name IN ('f0', 'f1', 'f2', 'f3', 'multer', 'absent'))
SELECT name, path, line, text FROM r WHERE rn <= 5
""")
def function_callers(spark, sf_dir):
    """The first five lines that call each function; definitions of the file's language are none."""
    names = spark.createDataFrame([(n,) for n in ("f0", "f1", "f2", "f3", "multer", "absent", "f0")], "name string")
    return context.callers(names, code_lines(spark, sf_dir)).select("name", "path", "line", "text")
