"""Queries of guards, ownership checks, upload handlers and routes over files of code.

A document stands for a file: its name and its lines are picked by its id from the pieces below.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, context
from .accounts import LINES, code_lines
from .base import query, table
from .reviews import pick, pick_sql, sql_text

NAMES = ["settings.py", "views.py", "app.JS", "up.ts", "main.go", "note.txt", "config/base.py"]
PIECES = [
    "@login_required\n@cached(60)\ndef show(id, user=Depends(get_user), db=Depends(base.session(1))):\n    return can_read(current_user.id)",
    "MIDDLEWARE = [\n  'a.Auth', \"b.Csrf\",\n  'c.Log',\n]\nOTHER = ['d']",
    "app.use('/x', auth)\nrouter.use(helmet)\napp.use(cors())",
    "q = 'SELECT 1 WHERE user_id = current_user.id AND owner_id = ?'\nq2 = \"where org_id = req.params.x; x\"\nif require_admin(u): has_permission(u)",
    "async def put(f: UploadFile = File(...)):\n    name = f.filename\n    if name.endswith('.png'): limits: { }\n    user = Depends(get_current_user)\n    open('static/' + name)",
    "const save = async (req) => {\n  upload.single('f')\n  req.files[0].originalname\n  fs.write('/var/x')",
    "func Put(w W) {\n  r.FormFile(n)\n  http.ServeFile(w)\n  hashlib.md5(x)",
    "request.files['a']\nz.extractall(p)\nos.path.abspath(p)\nyaml.load(f, Loader=yaml.SafeLoader)\nmagic.from_buffer(b)",
    "@app.route('/uploads/<n>', methods=['POST', 'PUT'])\ndef get_one(n):\n    request.FILES\n    extension not in ['exe']\n    yaml.load(x)\n    z.extractall(q)",
    "class A:\n\n    x = 1",
]
_KEYS = ["doc_id % 10", "(doc_id // 10) % 10", "(doc_id * 7 + 3) % 10"]
FILE = " || chr(10) || ".join(pick_sql(k, PIECES) for k in _KEYS)
CODE = f"""
d AS (SELECT 'p' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '/' || {pick_sql(f"doc_id % {len(NAMES)}", NAMES)} AS path, {FILE} AS t FROM documents),
l AS (SELECT path, CAST(i AS INTEGER) AS line, string_split(t, chr(10))[i] AS text, lower(path) AS low FROM (SELECT *, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d))"""


def files(spark, sf_dir):
    i = F.col("doc_id")
    keys = [i % 10, F.floor(i / 10) % 10, (i * 7 + 3) % 10]
    path = F.concat(F.lit("p"), F.lpad(i.cast("string"), 9, "0"), F.lit("/"), pick(i % len(NAMES), NAMES))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.concat_ws("\n", *[pick(k, PIECES) for k in keys]).alias("content"))


def _re(pattern: str) -> str:
    return sql_text(pattern)


_GUARDS = rf"""
n AS (SELECT *, regexp_extract(text, {_re(access.DECORATOR)}, 1) AS name FROM l WHERE low LIKE '%.py'),
f AS (SELECT *, first_value(CASE WHEN name = '' THEN regexp_matches(text, {_re(access.FUNCTION_LINE)}) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fn FROM n),
s AS (SELECT path, min(line) AS a FROM l WHERE low LIKE '%.py' AND regexp_matches(low, 'settings|config') AND regexp_matches(text, {_re(access.SETTINGS_LIST)}) GROUP BY 1),
e AS (SELECT s.path, s.a, min(line) AS z FROM s JOIN l ON l.path = s.path AND line > a AND contains(text, ']') GROUP BY 1, 2)
SELECT path, line, 'decorator' AS kind, name FROM f WHERE name <> '' AND fn AND regexp_matches(name, {_re(access.GUARD_NAMES)})
UNION ALL SELECT path, line, 'Depends', 'Depends(' || unnest(regexp_extract_all(text, {_re(access.DEPENDS)}, 1)) || ')' FROM l WHERE low LIKE '%.py'
UNION ALL SELECT path, line, 'app.use', regexp_extract(text, {_re(access.EXPRESS_USE)}, 1) FROM l WHERE regexp_matches(low, '[.](js|ts)$') AND regexp_matches(text, {_re(access.EXPRESS_USE)})
UNION ALL SELECT l.path, line, 'django_middleware', unnest(regexp_extract_all(text, {_re(access.SETTINGS_ENTRY)}, 1)) FROM l JOIN e ON e.path = l.path AND line > a AND line < z
"""


@query(f"WITH {CODE},{_GUARDS}")
def guards_of_files(spark, sf_dir):
    """X11: decorators, dependencies, used and listed middleware, each in the files that have such."""
    return access.guards(context.lines_of(files(spark, sf_dir)))


_SAFE = f"regexp_matches(v, {_re(access.CURRENT_USER)}) AND NOT regexp_matches(v, {_re(access.ATTACKER)})"


_OWNERS = rf"""
w AS (SELECT path, line, unnest(list_zip(regexp_extract_all(text, {_re(access.SQL_OWNER)}, 1), regexp_extract_all(text, {_re(access.SQL_OWNER)}, 2))) AS z FROM l),
cl AS (SELECT path, line, z[1] AS i, z[2] AS v FROM w)
SELECT path, line, 'WHERE ' || i || ' =' AS pattern, i AS identifier, {_SAFE} AS current_user_derived FROM cl
UNION ALL SELECT path, line, n, n, true FROM (SELECT path, line, unnest(regexp_extract_all(text, {_re(access.REQUIRES)}, 1)) AS n FROM l)
UNION ALL SELECT path, line, n, n, safe FROM (SELECT path, line, regexp_matches(text, {_re(access.CURRENT_USER)}) AS safe, unnest(regexp_extract_all(text, {_re(access.ALLOWS)}, 1)) AS n FROM l)
UNION ALL SELECT path, line, 'current_user.id', 'current_user.id', true FROM l WHERE regexp_matches(text, {_re(access.CURRENT_USER)})
UNION ALL SELECT path, line, 'Depends(get_current_user)', 'get_current_user', true FROM l WHERE regexp_matches(text, {_re(access.DEPENDS_USER)})
"""


@query(f"WITH {CODE},{_OWNERS}")
def ownership_of_files(spark, sf_dir):
    """Five shapes, with whether the current user decides."""
    return access.ownership_checks(context.lines_of(files(spark, sf_dir)))


_EVENT_LINES = f"{LINES}, l AS (SELECT path, line, text, lower(path) AS low FROM c)"


@query(f"""
SELECT path, line, kind, name FROM (WITH {_EVENT_LINES},{_GUARDS})
UNION ALL SELECT path, line, 'ownership', identifier FROM (WITH {_EVENT_LINES},{_OWNERS})
""")
def guards_and_owners(spark, sf_dir):
    """X11, X12 over lines dealt from events."""
    lines = code_lines(spark, sf_dir)
    owners = access.ownership_checks(lines).select("path", "line", F.lit("ownership").alias("kind"), F.col("identifier").alias("name"))
    return access.guards(lines).unionByName(owners)


_PLACES = " ".join(f"WHEN lang = '{k}' AND regexp_matches(text, {_re(p)}) THEN struct_pack(place := {i}, framework := '{f}')" for k, shapes in access.UPLOADS.items() for i, (p, f) in enumerate(shapes))
_CALLED = " ".join(f"WHEN lang = '{k}' AND regexp_matches(text, {_re(p)}) THEN coalesce(nullif(regexp_extract(text, {_re(p)}, 1), ''), nullif(regexp_extract(text, {_re(p)}, 2), ''), '<unknown>')" for k, p in access.FUNCTIONS.items())
HANDLERS = rf"""
g AS (SELECT *, CASE WHEN low LIKE '%.py' THEN 'py' WHEN regexp_matches(low, '[.](js|ts)$') THEN 'js' WHEN low LIKE '%.go' THEN 'go' END AS lang FROM l),
k AS (SELECT *, CASE {_PLACES} END AS at_, CASE {_CALLED} END AS called FROM g),
m AS (SELECT *, coalesce(last_value(called IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), '<module>') AS fn FROM k),
h AS (SELECT path, line, at_.framework AS framework, fn AS function FROM m WHERE at_ IS NOT NULL ORDER BY path, at_.place, line LIMIT 200)"""


@query(f"WITH {CODE}, {HANDLERS} SELECT * FROM h")
def first_upload_handlers(spark, sf_dir):
    """The first 200 (the operator's own limit) of the handlers, with framework and function."""
    return access.upload_handlers(context.lines_of(files(spark, sf_dir)))


def _has(signal: str) -> str:
    # The one pattern with a look-ahead is spelled line by line.
    pattern = access.SIGNALS[signal]
    if "(?!" in pattern:
        rest = "(?i)" + pattern.partition(")|")[2]
        return f"(regexp_matches(near, {_re(rest)}) OR len(list_filter(string_split(near, chr(10)), lambda x: regexp_matches(x, 'yaml[.]load') AND NOT regexp_matches(x, 'SafeLoader'))) > 0)"
    return f"regexp_matches(near, {_re(pattern)})"


def _some(other: str, **signals: str) -> str:
    told = ", ".join(f"CASE WHEN {c} THEN '{n.replace('_', '-')}' END" for n, c in signals.items())
    return f"coalesce(nullif(array_to_string(list_filter([{told}], lambda x: x IS NOT NULL), ' | '), ''), '{other}')"


@query(rf"""
WITH {CODE}, {HANDLERS},
x AS (SELECT h.*, (SELECT string_agg(text, chr(10) ORDER BY l.line) FROM l WHERE l.path = h.path AND l.line BETWEEN h.line - 30 AND h.line + 60) AS near,
  (SELECT coalesce(bool_or(regexp_matches(text, {_re(access.SIGNALS["direct-by-filename"])})), false) FROM l WHERE l.path = h.path) AS direct FROM h)
SELECT path, line, framework, function, CASE WHEN direct THEN 'direct-by-filename' ELSE 'none' END AS retrieval,
  {_some("none", magic_bytes=_has("magic-bytes"), extension_allowlist=_has("extension-allowlist"), MIME_only=f"{_has('MIME-only')} AND NOT {_has('magic-bytes')}", blocklist=f"{_has('blocklist')} AND NOT {_has('extension-allowlist')}")} AS validation,
  {_some("unknown", server_generated=_has("server-generated"), preserved_user_filename=_has("preserved-user-filename"))} AS naming,
  CASE WHEN {_has("public-path")} THEN 'public-path' WHEN {_has("outside-webroot")} THEN 'outside-webroot' ELSE 'unknown' END AS storage, CASE WHEN {_has("size")} THEN 'yes' ELSE 'none' END AS limits,
  {_some("none", **{"archive_extract_with_containment": f"{_has('archive')} AND {_has('containment')}", "archive_extract": f"{_has('archive')} AND NOT {_has('containment')}", "risky_parser": _has("parser")})} AS processing
FROM x
""")
def upload_contexts(spark, sf_dir):
    """What the lines around the first handlers tell."""
    lines = context.lines_of(files(spark, sf_dir))
    out = access.upload_context(access.upload_handlers(lines), lines, context.routes(lines))
    of = {"retrieval": "retrieval_signals", "validation": "validation_signals", "naming": "filename_handling", "storage": "storage_signals", "limits": "size_limit_signals", "processing": "post_processing_signals"}
    return out.select("path", "line", "framework", "function", *[F.array_join(c, " | ").alias(n) for n, c in of.items()])


_ROUTE = sql_text("@app.route('/uploads/<n>', methods=['POST', 'PUT'])")


@query(rf"""
WITH {CODE},
gd AS (SELECT path, string_agg(kind || ' ' || name, ',' ORDER BY line, kind, name) AS guards FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, kind, name) AS rn FROM (WITH z AS (SELECT 1){"," + _GUARDS})) WHERE rn <= 10 GROUP BY 1),
ow AS (SELECT path, string_agg(pattern, ',' ORDER BY line, pattern, identifier, current_user_derived) AS owners FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, pattern, identifier, current_user_derived) AS rn FROM (WITH z AS (SELECT 1){"," + _OWNERS})) WHERE rn <= 10 GROUP BY 1),
rt AS (SELECT path, line, unnest(['POST', 'PUT']) AS method FROM l WHERE low LIKE '%.py' AND text = {_ROUTE}),
rf AS (SELECT path, string_agg(method || ' ' || path || ':' || line, ',' ORDER BY line, method) AS routes FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, method) AS rn FROM rt) WHERE rn <= 5 GROUP BY 1),
ro AS (SELECT string_agg(method || ' ' || path || ':' || line, ',' ORDER BY path, line, method) AS routes FROM (SELECT * FROM rt ORDER BY path, line, method LIMIT 5)),
sn AS (SELECT path, string_split(t, chr(10)) AS ls FROM d)
SELECT path, array_to_string(ls[1:14], chr(10)) AS snippet, coalesce(rf.routes, ro.routes, '') AS routes, coalesce(guards, '') AS guards, coalesce(owners, '') AS owners
FROM sn LEFT JOIN rf USING (path) LEFT JOIN gd USING (path) LEFT JOIN ow USING (path), ro
""")
def context_bundles(spark, sf_dir):
    """What surrounds a finding in lines 5 and 6 of every file; files without routes get the snapshot's first."""
    f = files(spark, sf_dir)
    cand = f.select(F.xxhash64("path").alias("candidate_ord"), F.col("path").alias("file"), F.lit(5).alias("line_start"), F.lit(6).alias("line_end"), F.array(F.lit("llm")).alias("sources"))
    b = context.bundles(cand, f)
    told = lambda c, f: F.array_join(F.transform(c, f), ",")
    routes = told("routes", lambda r: F.concat(r["method"], F.lit(" "), r["path"], F.lit(":"), r["line"].cast("string")))
    return b.select(F.col("file").alias("path"), "snippet", routes.alias("routes"), told("guards", lambda g: F.concat(g["kind"], F.lit(" "), g["name"])).alias("guards"), told("ownership", lambda o: o["pattern"]).alias("owners"))
