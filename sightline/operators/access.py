"""Who may call what: guards, ownership checks, upload handlers and what surrounds them.

Everything is read line by line (path, line, text), as :func:`context.lines_of` gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# File endings, guard names and shapes, ownership shapes.
PY, JS, GO = [".py"], [".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs"], [".go"]
GUARD_NAMES = r"(?i)login_required|require_admin|require_staff|permission_required|admin_required|auth_required|authenticated|requires_auth|jwt_required|token_required|verify_jwt|check_permission|authorize|secured|protected"
DECORATOR = r"^\s*@([\w.]+(?:\([^)]*\))?)\s*$"
FUNCTION_LINE = r"^\s*(?:async\s+)?def\s+\w+"
DEPENDS = r"(?i)Depends\s*\(\s*([\w.]+(?:\([^)]*\))?)\s*\)"
EXPRESS_USE = r"(?i)(?:app|router)\.use\s*\(\s*(?:['\"` ][^)]*)?(\w+)\s*\)"
SETTINGS_LIST, SETTINGS_ENTRY = r"MIDDLEWARE\s*=\s*\[", r"['\"]([\w.]+)['\"]"
SQL_OWNER = r"(?i)WHERE\s+(user_id|tenant_id|org_id|owner_id|account_id|created_by)\s*=\s*(.+?)(?:\s*AND|\s*OR|\s*$|;)"
REQUIRES = r"(?i)\b(require_(?:admin|permission|role|staff|authenticated|login))\b"
ALLOWS = r"(?i)\b(has_permission|can_(?:read|write|access|delete|edit|update|view))\s*\("
CURRENT_USER = r"(?i)(?:current_user|request\.user)\.(?:id|pk|user_id|uuid|uid)\b"
DEPENDS_USER = r"(?i)Depends\s*\(\s*get_current_user\s*\)"
ATTACKER = r"(?i)(?:request\.(?:GET|POST|args|json|data|form)|(?:params|body|query)\[|(?:\?|\$\{)|request\.params\.|req\.(?:params|query|body)\.|ctx\.params\.)"

# Upload handlers by language, in the order in which they are looked for: (pattern, framework).
UPLOADS = {
    "py": [
        (r"\brequest\.files\b", "flask"),
        (r"\bUploadFile\b", "fastapi"),
        (r"(?i)\bFile\s*\(\s*\.\.\.", "fastapi"),
        (r"\brequest\.FILES\b", "django"),
        (r"(?i)\bmultipart\.parse_form_data\b", "multipart"),
        (r"(?i)\bFlask-Uploads\b|\bsave_file\b.*\bupload\b", "flask"),
    ],
    "js": [
        (r"(?i)\bmulter\s*\(", "multer"),
        (r"(?i)\bupload\.(single|array|fields)\s*\(", "multer"),
        (r"(?i)\breq\.file\b", "express"),
        (r"(?i)\breq\.files\b", "express"),
        (r"(?i)\bnew\s+Busboy\b|\bbusboy\s*\(", "busboy"),
        (r"(?i)\bnew\s+(?:formidable\.)?(?:IncomingForm|Formidable)\s*\(", "formidable"),
        (r"(?i)\bformidable\.parse\b", "formidable"),
    ],
    "go": [
        (r"(?i)\br\.FormFile\s*\(", "gin"),
        (r"(?i)\br\.MultipartForm\b", "go_multipart"),
        (r"(?i)\bmultipart\.NewReader\s*\(", "go_multipart"),
        (r"(?i)\bio\.Copy\s*\(.*\bmultipart\b", "go_multipart"),
        (r"(?i)\.FormFile\s*\(", "go_multipart"),
    ],
}
FUNCTIONS = {"py": r"(?:async\s+)?def\s+(\w+)()\s*\(", "js": r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\())", "go": r"^func\s+(?:\(\s*\w+\s+\*?\w+\s*\)\s+)?(\w+)()\s*\("}
MAX_HANDLERS, FUNCTION_LINES = 200, 50

# What the lines around a handler tell.
BEFORE, AFTER = 30, 60
MAX_ROUTES, MAX_GUARDS = 5, 10
SIGNALS = {
    "extension-allowlist": r"(?i)(?:ALLOWED_EXTENSIONS|allowed_ext|ALLOWED_FILETYPES|whitelist)|\.endswith\s*\(['\"]\.\w+['\"]|extension\s+in\s+[\[{(]|splitext\s*\(.*\)\s*\[[-12]\]\s*in|\.mimetype\s*in\s+",
    "blocklist": r"(?i)(?:BLOCKED_EXTENSIONS|blacklist|blocklist|DENY_EXT)|extension\s+not\s+in\s+[\[{(]|\.endswith\s*\(.*\)\s*(?:and|or)\s+(?:raise|return|abort)",
    "MIME-only": r"(?i)(?:content.?type|mimetype|mime_type)\s*[=!]=?\s*['\"]|content.?type\s+in\s+[\[{(]|\.mimetype\b",
    "magic-bytes": r"(?i)python.magic|filetype\.guess|imghdr\.|sndhdr\.|f\.read\s*\(\s*\d+\s*\)\s*\.startswith|file\.read\s*\(\s*\d+\s*\)|magic\.from_buffer|what\s*\(.*\)",
    "server-generated": r"(?i)uuid\.uuid4\(\)|secrets\.token_hex|secrets\.token_urlsafe|hashlib\.\w+\(|uuid4\(\)|str\(uuid\b|generate_filename|secure_filename\s*\(",
    "preserved-user-filename": r"(?i)\.filename\b|\.originalname\b|\.name\b.*upload|file\.name\b|req\.file\.originalname",
    "size": r"(?i)MAX_CONTENT_LENGTH|MAX_FILE_SIZE|max_file_size|maxFileSize|limits\s*:\s*\{|fileSize\s*:|os\.path\.getsize|content.length\b|\.size\s*>\s*\d|\.size\s*<\s*\d|MAX_UPLOAD|upload_max_filesize",
    "public-path": r"(?i)['\"](/|\./)?(static|public|uploads|media|wwwroot|assets)/|os\.path\.join\s*\(.*(?:static|public|uploads|media)|multer\s*\(\s*\{[^}]*dest\s*:\s*['\"](?:public|uploads|static)",
    "outside-webroot": r"(?i)UPLOAD_FOLDER|upload_dir|MEDIA_ROOT|DATA_DIR|STORAGE_PATH|/var/|/tmp/|/home/|/srv/|os\.environ.*(?:upload|media|storage)",
    "direct-by-filename": r"(?i)send_from_directory\s*\(|send_file\s*\(.*filename|@.*route.*uploads.*<.*>|@.*route.*files.*<.*>|res\.sendFile\s*\(|res\.download\s*\(|r\.Static\s*\(|http\.ServeFile|ServeContent",
    # Two of these are followed by blanks.
    "archive": r"(?i)zipfile\.ZipFile|\.extractall\s*\(|tarfile\.open|\.extractall {8}|shutil\.unpack_archive {4}",
    "parser": r"(?i)yaml\.load\s*\((?!.*Loader\s*=\s*yaml\.SafeLoader)|yaml\.unsafe_load|xml\.etree\.ElementTree\.parse|ElementTree\.parse\s*\(|template.*\.render\s*\(.*upload|jinja.*\.from_string\s*\(.*upload",
    "containment": r"(?i)os\.path\.commonpath|commonprefix|os\.path\.abspath|PurePosixPath|Path\(.*\)\.resolve|\.resolve\(\)",
}


def _unicode(pattern: str) -> str:
    """The pattern with letters, digits and blanks of all scripts."""
    return "(?iU)" + pattern[4:] if pattern.startswith("(?i)") else "(?U)" + pattern


def _ends(path: Column, endings: list[str]) -> Column:
    low = F.lower(path)
    out = F.lit(False)
    for e in endings:
        out = out | low.endswith(e)
    return out


def language(path: Column) -> Column:
    """py, js or go by the ending, null for others."""
    return F.when(_ends(path, PY), "py").when(_ends(path, JS), "js").when(_ends(path, GO), "go")


def _every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(_unicode(pattern)), F.lit(group))


def guarding_decorators(lines: DataFrame) -> DataFrame:
    """(path, line, name) of the guards among the decorators stacked right above a function; any other line between breaks the stack."""
    # From below upwards, so that each row looks at what is already known.
    w = W.partitionBy("path").orderBy(F.col("line").desc()).rowsBetween(W.unboundedPreceding, -1)
    decorator = F.col("text").rlike(_unicode(DECORATOR))
    below = F.last(F.when(~decorator, F.col("text").rlike(_unicode(FUNCTION_LINE))), True).over(w)
    name = F.regexp_extract("text", _unicode(DECORATOR), 1)
    return lines.withColumn("__sl_def", below).filter(decorator & F.col("__sl_def") & name.rlike(GUARD_NAMES)).select("path", "line", name.alias("name"))


def _listed_middleware(lines: DataFrame) -> DataFrame:
    """The entries of the first list of a settings file, between the line that opens it and the first with a closing bracket."""
    w = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    opened = F.coalesce(F.bool_or(F.col("text").rlike(_unicode(SETTINGS_LIST))).over(w), F.lit(False))
    marked = lines.filter(_ends(F.col("path"), PY) & F.lower("path").rlike("settings|config")).withColumn("__sl_in", opened)
    closed = F.bool_or(F.col("__sl_in") & F.col("text").contains("]")).over(W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("__sl_out", closed).filter("__sl_in AND NOT __sl_out").select("path", "line", F.explode(_every(F.col("text"), SETTINGS_ENTRY)).alias("name"))


def guards(lines: DataFrame) -> DataFrame:
    """X11: path, line, kind, name: decorators over functions, dependencies and listed middleware of Python files, used middleware of scripts."""
    path, text = F.col("path"), F.col("text")
    py, js = lines.filter(_ends(path, PY)), lines.filter(_ends(path, JS))
    of = lambda df, kind: df.select("path", "line", F.lit(kind).alias("kind"), "name")
    depends = py.select("path", "line", F.explode(_every(text, DEPENDS)).alias("n")).select("path", "line", F.concat(F.lit("Depends("), F.col("n"), F.lit(")")).alias("name"))
    used = js.filter(text.rlike(_unicode(EXPRESS_USE))).select("path", "line", F.regexp_extract(text, _unicode(EXPRESS_USE), 1).alias("name"))
    return of(guarding_decorators(py), "decorator").unionByName(of(depends, "Depends")).unionByName(of(used, "app.use")).unionByName(of(_listed_middleware(lines), "django_middleware"))


def ownership_checks(lines: DataFrame) -> DataFrame:
    """Path, line, pattern, identifier, current_user_derived, for each check of a line."""
    text = F.col("text")
    has = lambda c, p: c.rlike(_unicode(p))
    one = lambda pattern, name, safe: F.struct(pattern.alias("pattern"), name.alias("identifier"), safe.alias("current_user_derived"))
    clauses = F.arrays_zip(_every(text, SQL_OWNER, 1).alias("column"), _every(text, SQL_OWNER, 2).alias("value"))
    by_clause = F.transform(clauses, lambda c: one(F.concat(F.lit("WHERE "), c["column"], F.lit(" =")), c["column"], has(c["value"], CURRENT_USER) & ~has(c["value"], ATTACKER)))
    required = F.transform(_every(text, REQUIRES), lambda n: one(n, n, F.lit(True)))
    allowed = F.transform(_every(text, ALLOWS), lambda n: one(n, n, has(text, CURRENT_USER)))
    said = lambda p, pattern, name: F.when(has(text, p), F.array(one(F.lit(pattern), F.lit(name), F.lit(True)))).otherwise(F.array().cast("array<struct<pattern:string,identifier:string,current_user_derived:boolean>>"))
    every = F.concat(by_clause, required, allowed, said(CURRENT_USER, "current_user.id", "current_user.id"), said(DEPENDS_USER, "Depends(get_current_user)", "get_current_user"))
    return lines.select("path", "line", F.explode(every).alias("c")).select("path", "line", "c.*")


def upload_handlers(lines: DataFrame, cap: int = MAX_HANDLERS) -> DataFrame:
    """Path, line, framework, function of the first ``cap`` handlers, by path, then in the order of the patterns, then by line.

    A line is a handler once, by the first pattern that it fits.  Its function is the last one
    that begins in the ``FUNCTION_LINES`` lines up to it, ``<module>`` where none does.
    """
    lang, text = language(F.col("path")), F.col("text")
    place, name = F.lit(None), F.lit(None)
    for key, shapes in UPLOADS.items():
        found = F.lit(None)
        for i, (pattern, framework) in reversed(list(enumerate(shapes))):
            found = F.when(text.rlike(_unicode(pattern)), F.struct(F.lit(i).alias("place"), F.lit(framework).alias("framework"))).otherwise(found)
        place = F.when(lang == key, found).otherwise(place)
        called = F.when(text.rlike(_unicode(FUNCTIONS[key])), F.coalesce(*[F.nullif(F.regexp_extract(text, _unicode(FUNCTIONS[key]), g), F.lit("")) for g in (1, 2)], F.lit("<unknown>")))
        name = F.when(lang == key, called).otherwise(name)
    w = W.partitionBy("path").orderBy("line").rangeBetween(-(FUNCTION_LINES - 1), 0)
    marked = lines.withColumns({"__sl_at": place, "__sl_name": name}).withColumn("function", F.coalesce(F.last("__sl_name", True).over(w), F.lit("<module>")))
    hits = marked.filter(F.col("__sl_at").isNotNull()).select("path", F.col("__sl_at.place").alias("place"), "line", F.col("__sl_at.framework").alias("framework"), "function")
    return hits.orderBy("path", "place", "line").limit(cap).select("path", "line", "framework", "function")


def upload_context(handlers: DataFrame, lines: DataFrame, routes: DataFrame) -> DataFrame:
    """Handlers (path, line) with the lists of signals around them and a line that sums them up.

    Naming, checks, limits, storage and processing are read from the lines ``BEFORE`` to
    ``AFTER`` the handler, retrieval from the whole file; routes (:func:`context.routes`) and
    guards are the first of the file.  At most MAX_HANDLERS handlers ask, so their files are few.
    """
    asked = handlers.select("path").distinct()
    own = lines.join(asked, "path", "left_semi")
    at = handlers.select("path", F.col("line").alias("at")).distinct()
    near = at.join(own, "path").filter(F.col("line").between(F.col("at") - BEFORE, F.col("at") + AFTER))
    window = near.groupBy("path", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("near"))
    # Retrieval is a matter of single lines, so files needn't be put together.
    whole = own.groupBy("path").agg(F.bool_or(F.col("text").rlike(SIGNALS["direct-by-filename"])).alias("direct"))

    def firsts(rows: DataFrame, said: Column, order: list[str], name: str, most: int | None) -> DataFrame:
        rows = rows.join(asked, "path", "left_semi").withColumn("__sl_n", F.row_number().over(W.partitionBy("path").orderBy(*order)))
        rows = rows.filter(F.col("__sl_n") <= most) if most else rows
        return rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("__sl_n", said.alias("said")))), lambda x: x["said"]).alias(name))

    kinds = F.array_position(F.array(*map(F.lit, ("decorator", "Depends", "django_middleware", "app.use"))), F.col("kind"))
    owner = F.concat(F.col("pattern"), F.lit(" (current_user-derived: "), F.initcap(F.col("current_user_derived").cast("string")), F.lit(")"))
    route = F.concat("method", F.lit(" "), "route", F.lit(" → "), "handler")
    parts = [
        firsts(routes, route, ["line", "framework", "method"], "route_summary", MAX_ROUTES),
        firsts(guards(own).withColumn("kind_place", kinds), F.col("name"), ["kind_place", "line", "name"], "middleware_summary", MAX_GUARDS),
        firsts(ownership_checks(own), owner, ["line", "pattern"], "authz_signals", None),
        whole,
    ]
    out = handlers.join(window.withColumnRenamed("at", "line"), ["path", "line"], "left")
    for p in parts:
        out = out.join(p, "path", "left")
    none = F.array().cast("array<string>")
    has = lambda k: F.coalesce(F.col("near"), F.lit("")).rlike(SIGNALS[k])
    some = lambda *signals, other: F.coalesce(F.nullif(F.array_compact(F.array(*[F.when(c, n) for n, c in signals])), none), F.array(F.lit(other)))
    magic, allowed = has("magic-bytes"), has("extension-allowlist")
    archive = F.when(has("archive") & has("containment"), "archive-extract-with-containment").when(has("archive"), "archive-extract")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("route_summary", "middleware_summary", "authz_signals")}).withColumns(
        {
            "filename_handling": some(("server-generated", has("server-generated")), ("preserved-user-filename", has("preserved-user-filename")), other="unknown"),
            "validation_signals": some(("magic-bytes", magic), ("extension-allowlist", allowed), ("MIME-only", has("MIME-only") & ~magic), ("blocklist", has("blocklist") & ~allowed), other="none"),
            "size_limit_signals": F.array(F.when(has("size"), "yes").otherwise("none")),
            "storage_signals": F.array(F.when(has("public-path"), "public-path").when(has("outside-webroot"), "outside-webroot").otherwise("unknown")),
            "retrieval_signals": F.array(F.when(F.col("direct"), "direct-by-filename").otherwise("none")),
            "post_processing_signals": F.coalesce(F.nullif(F.array_compact(F.array(archive, F.when(has("parser"), "risky-parser"))), none), F.array(F.lit("none"))),
        }
    )
    access = F.when((F.size("authz_signals") > 0) | (F.size("middleware_summary") > 0), F.array(F.lit("yes"))).otherwise(F.array(F.lit("none")))
    told = [("Validation", "validation_signals"), ("Naming", "filename_handling"), ("Storage", "storage_signals"), ("Limits", "size_limit_signals"), ("Access", access), ("Processing", "post_processing_signals")]
    summary = F.concat_ws(" — ", *[F.concat(F.lit(f"{n}: "), F.array_join(c, " | ")) for n, c in told])
    return out.withColumn("overall_summary", summary).drop("near", "direct")
