"""Whether a suggested fix may be written: its shape, where it goes, what it touches and what it would introduce."""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fenced_code, range_anchored, split_lines

MAX_CHANGED = 20
# What reads as a sketch, what only people decide on, what is never edited unseen.
SKETCH = r"(?imdU)^\s*\.\.\.\s*$|^\s*#\s*(in|add|then|todo|note|rest|replace|example|your)\b|<[A-Z][A-Z0-9_]{1,}>|\brest of (the )?(code|file|function)\b|\btruncated for brevity\b"
MANUAL_IDS = ["A01:", "A02:", "A07:", "A08:"]
MANUAL_WORDS = r"(?iU)(command injection|os command|remote code execution|insecure deserialization|deserializ\w+|\bpickle\b|session fixation|session management|broken authentication|auth(?:entication|orization) bypass|privilege escalation|access control|broken access)"
PROTECTED_FOLDERS = ["auth", "security", "middleware", "jwt", "jwts", "session", "sessions", "config", "configs", "deployment", "deploy", "docker", "k8s", "kubernetes"]
PROTECTED_NAMES = r"^(settings|config|conf|configuration)\.[a-z0-9_]+$|^dockerfile$|^docker-compose[.\w-]*\.ya?ml$"
PROTECTED_VARIABLES = r"(?U)\b(SECRET_KEY|JWT_SECRET\w*|SESSION_COOKIE\w*|CSRF\w*|DEBUG|ALLOWED_HOSTS|CORS\w*)\b"
# Anti-patterns that a fix must not introduce: label, danger, what makes it safe.
ANTI_PATTERNS = [
    ("verify=False (TLS verification off)", r"(?i)\bverify\s*=\s*False\b", None),
    ("ssl/verify_ssl=False (TLS off)", r"(?i)\b(?:ssl|use_ssl|ssl_verify|verify_ssl|sslverify)\s*=\s*False\b", None),
    ("check_hostname=False", r"(?i)\bcheck_hostname\s*=\s*False\b", None),
    ("ssl.CERT_NONE", r"\bCERT_NONE\b", None),
    ("ssl._create_unverified_context", r"_create_unverified_context", None),
    ("rejectUnauthorized:false (node TLS off)", r"(?i)rejectUnauthorized\s*[:=]\s*false", None),
    ("NODE_TLS_REJECT_UNAUTHORIZED=0", r"(?i)NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]?0", None),
    ("--insecure flag", r"--insecure\b", None),
    ('allow_origins=["*"] (CORS wildcard)', r"(?i)allow_origins\s*=\s*[\[(]\s*['\"]\*['\"]", None),
    ("Access-Control-Allow-Origin: * (CORS wildcard)", r"(?i)Access-Control-Allow-Origin['\"]?\s*[:,]\s*['\"]?\*", None),
    ("CORS_ORIGIN_ALLOW_ALL=True", r"(?i)\bCORS_ORIGIN_ALLOW_ALL\s*=\s*True\b", None),
    ("auth_disabled=True", r"(?i)\bauth_disabled\s*=\s*True\b", None),
    ("authentication/login disabled", r"(?i)\b(?:authentication(?:_required)?|login_required)\s*=\s*False\b", None),
    ("csrf_exempt", r"(?i)\bcsrf_exempt\b|@?\s*csrf\.exempt", None),
    ("WTF_CSRF_ENABLED=False", r"(?i)\bWTF_CSRF_ENABLED\s*=\s*False\b", None),
    ("SESSION_COOKIE_SECURE=False", r"(?i)\bSESSION_COOKIE_SECURE\s*=\s*False\b", None),
    ("CSRF_COOKIE_SECURE=False", r"(?i)\bCSRF_COOKIE_SECURE\s*=\s*False\b", None),
    ("SESSION_COOKIE_HTTPONLY=False", r"(?i)\bSESSION_COOKIE_HTTPONLY\s*=\s*False\b", None),
    ("SECURE_SSL_REDIRECT=False", r"(?i)\bSECURE_SSL_REDIRECT\s*=\s*False\b", None),
    ("DRF permission_classes=[AllowAny]", r"(?i)permission_classes\s*=\s*\[\s*AllowAny", None),
    ("DRF authentication_classes=[] (auth removed)", r"(?i)authentication_classes\s*=\s*\[\s*\]", None),
    ('JWT alg "none"', r"(?i)\balg(?:orithm)?['\"]?\s*[:=]\s*['\"]?\s*none\b", None),
    ("JWT algorithms=[] (any alg accepted)", r"(?i)\balgorithms\s*=\s*\[\s*\]", None),
    ("verify_signature=False", r"(?i)['\"]?\bverify_signature\b['\"]?\s*[:=]\s*False\b", None),
    ("eval(", r"\beval\s*\(", None),
    ("exec(", r"\bexec\s*\(", None),
    ("shell=True", r"(?i)\bshell\s*=\s*True\b", None),
    ("os.system(", r"\bos\.system\s*\(", None),
    ("pickle.load(s)(", r"\b(?:cPickle|_pickle|pickle)\s*\.\s*loads?\s*\(", None),
    ("marshal.load(s)(", r"\bmarshal\s*\.\s*loads?\s*\(", None),
    ("yaml.unsafe_load(", r"\byaml\s*\.\s*unsafe_load\s*\(", None),
    ("yaml.load( without Loader=", r"\byaml\s*\.\s*load\s*\(", r"Loader\s*=|safe_load"),
    ("__import__(", r"\b__import__\s*\(", None),
    ("dill.load(s)(", r"\bdill\s*\.\s*loads?\s*\(", None),
    ("jsonpickle.decode(", r"\bjsonpickle\s*\.\s*decode\b", None),
    ("pandas.read_pickle(", r"\b(?:pd|pandas)\s*\.\s*read_pickle\s*\(", None),
    ("torch.load( (pickle)", r"\btorch\s*\.\s*load\s*\(", None),
    ("joblib.load(", r"\bjoblib\s*\.\s*load\s*\(", None),
    ("hashlib.md5/sha1 (weak hash)", r"\bhashlib\s*\.\s*(?:md5|sha1)\s*\(", r"usedforsecurity\s*=\s*False"),
    ('hashlib.new("md5"/"sha1")', r"(?i)\bhashlib\s*\.\s*new\s*\(\s*['\"](?:md5|sha1)['\"]", r"usedforsecurity\s*=\s*False"),
    ("weak cipher (ECB/ARC4/DES/Blowfish)", r"\b(?:MODE_ECB|ARC4|DES\.new|Blowfish)\b", None),
    ("obsolete TLS protocol", r"\bssl\s*\.\s*PROTOCOL_(?:SSLv2|SSLv3|TLSv1)(?:_1)?\b", None),
    ("debug=True", r"(?i)\bdebug\s*=\s*True\b", None),
    ("FLASK_DEBUG=1", r"(?i)\bFLASK_DEBUG\s*=\s*['\"]?1\b", None),
    ('SECRET_KEY = "random"/"test"', r"(?i)SECRET_KEY\s*=\s*['\"](?:random|test)['\"]", None),
    ("chmod 0777", r"chmod[^\n]*\b0o?777\b", None),
    ("os.umask(0)", r"\bos\s*\.\s*umask\s*\(\s*0\s*\)", None),
    ("tempfile.mktemp(", r"\btempfile\s*\.\s*mktemp\s*\(", None),
    ("archive .extractall( (path traversal)", r"\.extractall\s*\(", None),
]


def is_sketch(code: Column) -> Column:
    """Missing, empty or only an illustration."""
    return (F.coalesce(F.length(code), F.lit(0)) == 0) | F.coalesce(code.rlike(SKETCH), F.lit(False))


def manual_category(finding_id: Column, reference: Column, description: Column) -> Column:
    """The id or the words (lower case) for which a fix is left to people, null if none."""
    by_id = F.exists(F.array(*map(F.lit, MANUAL_IDS)), lambda p: F.coalesce(finding_id, F.lit("")).startswith(p))
    words = F.regexp_extract(F.concat_ws("\n", finding_id, reference, description), MANUAL_WORDS, 1)
    return F.when(by_id, finding_id).otherwise(F.nullif(F.lower(words), F.lit("")))


def protected_path(path: Column) -> Column:
    """In a protected folder, or a file of settings; in any case and with either slash."""
    parts = F.filter(F.split(F.lower(F.translate(path, "\\", "/")), "/"), lambda p: p != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.coalesce(F.arrays_overlap(folders, F.array(*map(F.lit, PROTECTED_FOLDERS))) | F.coalesce(F.get(parts, F.size(parts) - 1).rlike(PROTECTED_NAMES), F.lit(False)), F.lit(False))


def protected_variable(old: Column, new: Column) -> Column:
    """The first protected variable of the replaced lines, else of the new ones, null if none."""
    name = lambda c: F.nullif(F.regexp_extract(c, PROTECTED_VARIABLES, 1), F.lit(""))
    return F.coalesce(name(old), name(new))


def introduced(old: Column, new: Column) -> Column:
    """The label of the first anti-pattern that the new lines have and the old ones have not, null if none."""
    out = F.lit(None).cast("string")
    for label, danger, safe in reversed(ANTI_PATTERNS):
        bad = lambda c: F.coalesce(c.rlike(danger) & ~c.rlike(safe) if safe else c.rlike(danger), F.lit(False))  # noqa: B023, E731
        out = F.when(bad(new) & ~bad(old), F.lit(label)).otherwise(out)
    return out


def classify_fixes(findings: DataFrame, files: DataFrame, strict: bool = False, max_changed: int = MAX_CHANGED, path: str = "path", content: str = "content") -> DataFrame:
    """X21 but for writing: findings with outcome (secret, manual, edit), reason (of manual) and risk_note (of edit).

    findings: vulnerability_id, affected_file, affected_lines, owasp_reference, description,
    suggested_fix.  In order: secrets are never edited; with ``strict`` a sensitive category
    or a protected path is manual, else a note; a fix needs a file, a line range and a code
    block, no sketch, at most ``max_changed`` lines and a range within the file; protected
    variables are manual or a note like categories; what introduces an anti-pattern is
    manual.  Edits are spliced and parsed by whoever writes files.  A path is once in ``files``.
    """
    f = files.select(F.col(path).alias("affected_file"), split_lines(F.col(content)).alias("__sl_lines"))
    start, end = range_anchored(F.col("affected_lines"))
    j = findings.join(f, "affected_file", "left").withColumns({"__sl_s": start, "__sl_e": end, "__sl_code": fenced_code(F.col("suggested_fix"))})
    s, e, code, lines = (F.col("__sl_" + x) for x in ("s", "e", "code", "lines"))
    within = F.coalesce((s >= 1) & (s <= e) & (e <= F.size(lines)), F.lit(False))
    # Lines are cut only where the range is good.
    old = F.when(within, F.array_join(F.slice(lines, F.when(within, s).otherwise(1).cast("int"), F.when(within, e - s + 1).otherwise(0).cast("int")), "\n"))
    j = j.withColumns(
        {
            "__sl_old": old,
            "__sl_cat": manual_category(F.col("vulnerability_id"), F.col("owasp_reference"), F.col("description")),
            "__sl_path": protected_path(F.col("affected_file")),
            "__sl_n": F.greatest(e - s + 1, F.size(split_lines(code)), F.lit(1)),
        }
    ).withColumns({"__sl_var": protected_variable(F.col("__sl_old"), code), "__sl_bad": F.when(within, introduced(F.col("__sl_old"), code))})
    cat, at, var = F.col("__sl_cat"), F.col("__sl_path"), F.col("__sl_var")
    strictly = F.lit(strict)
    reason = (
        F.when(strictly & cat.isNotNull(), "category")
        .when(strictly & at, "protected path")
        .when((F.coalesce(F.col("affected_file"), F.lit("")) == "") | s.isNull() | code.isNull() | lines.isNull(), "no drop-in")
        .when(is_sketch(code), "sketch")
        .when(F.col("__sl_n") > max_changed, "too large")
        .when(~within, "out of bounds")
        .when(strictly & var.isNotNull(), "protected variable")
        .when(F.col("__sl_bad").isNotNull(), F.concat(F.lit("introduces "), F.col("__sl_bad")))
    )
    secret = F.coalesce(F.col("vulnerability_id") == "SECRET-001", F.lit(False))
    note = F.nullif(F.concat_ws("; ", F.concat(F.lit("category "), cat), F.when(at, "protected path"), F.concat(F.lit("touches "), var)), F.lit(""))
    out = j.withColumn("reason", F.when(~secret, reason))
    out = out.withColumn("outcome", F.when(secret, "secret").when(F.col("reason").isNotNull(), "manual").otherwise("edit"))
    return out.withColumn("risk_note", F.when(F.col("outcome") == "edit", note)).drop(*[c for c in out.columns if c.startswith("__sl_")])


def review_sections(classified: DataFrame, keys: list[str]) -> DataFrame:
    """By keys the places of edits (with their notes), of manual fixes (with their reasons) and the files with secrets, sorted; places are path:lines (id)."""
    place = F.concat(F.col("affected_file"), F.lit(":"), F.coalesce("affected_lines", F.lit("")), F.lit(" ("), F.coalesce("vulnerability_id", F.lit("")), F.lit(")"))
    told = lambda kind, extra: F.array_sort(F.collect_list(F.when(F.col("outcome") == kind, F.concat_ws(" — ", place, extra))))
    return classified.groupBy(*keys).agg(told("edit", F.col("risk_note")).alias("applied"), told("manual", F.col("reason")).alias("manual"), F.array_sort(F.collect_set(F.when(F.col("outcome") == "secret", F.col("affected_file")))).alias("secret_files"))


OVERLAPS, OUT_OF_BOUNDS, BREAKS_SYNTAX = "overlaps another edit", "out of bounds", "syntax error after the fix"
_SPLICED = "path string, content string, decided array<struct<ord:bigint,reason:string>>"


def splice(content: str, edits: list[tuple[int, int, str, int]], parsed: bool) -> tuple[str, list[dict]]:
    """The text with its edits (start, end, code, ord), and of each the reason why it wasn't made, null for those made.

    From the bottom up, so line numbers hold; of edits that overlap the one that starts lower
    is made, then the one of lower ord.  Where ``parsed``, an edit after which the text is no
    Python is taken back.
    """
    lines, low, decided = content.splitlines(keepends=True), None, []
    n, below = len(lines), []  # what stands from line ``low`` on, last piece first
    low = n + 1
    # Where statements of the module begin and end above ``low``, if the text is Python as it stands.
    spans = _statements(content, lines) if parsed else None
    for start, end, code, ord_ in sorted(edits, key=lambda e: (-e[0], e[3])):
        reason = OUT_OF_BOUNDS if not 1 <= start <= end <= n else OVERLAPS if end >= low else None
        if reason is None:
            piece = "".join(lines[end : low - 1])
            new = code if code.endswith("\n") else code + "\n"
            # Whole statements in place of whole statements leave the rest as it is parsed.
            if parsed and not (spans and start in spans[0] and end in spans[1] and is_python(new)):
                text = "".join(lines[: start - 1]) + new + piece + "".join(reversed(below))
                if is_python(text):
                    spans = _statements(text, lines[: start - 1])
                else:
                    reason = BREAKS_SYNTAX
            if reason is None:
                below += [piece, new]
                low = start
        decided.append({"ord": ord_, "reason": reason})
    return "".join(lines[: low - 1]) + "".join(reversed(below)), decided


def _statements(text: str, lines: list[str]) -> tuple[set[int], set[int]] | None:
    """First and last lines of the module's statements that have their lines to themselves; null if ``text`` is no Python or its lines aren't those of ``lines``."""
    if "\\\n" in text or any(x in text for x in "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"):
        return None
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError):
        return None
    spans = [(min([x.lineno, *(d.lineno for d in getattr(x, "decorator_list", []))]), x.end_lineno) for x in body]
    firsts, lasts = Counter(a for a, _ in spans), Counter(b for _, b in spans)
    # Several on a line share it with another's end or begin.
    alone = [(a, b) for a, b in spans if firsts[a] == 1 and lasts[b] == 1 and (a == b or not (lasts[a] or firsts[b])) and b <= len(lines)]
    return {a for a, _ in alone}, {b for _, b in alone}


def is_python(text: str) -> bool:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError):
        return False
    return True


def spliced(edits: DataFrame, files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """X21, gate 8: path, content, decided of every file that has edits; decided: (ord, reason), null where the edit was made.

    edits: affected_file, start, end (lines), code, ord (unique in a file).  Python files are
    parsed after each edit, others are not.  A file's edits meet in one row; edits of files that
    aren't there give no row.
    """
    one = edits.groupBy(F.col("affected_file").alias("__sl_file")).agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("start", "end", "ord")], "code")).alias("edits"))
    met = files.select(F.col(path).alias("path"), F.col(content).alias("content")).join(one, F.col("path") == F.col("__sl_file")).select("path", "content", "edits")
    return met.mapInArrow(_splice_batches, _SPLICED)


def _splice_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("ord", pa.int64()), ("reason", pa.string())]))
    for b in batches:
        texts, told = [], []
        for p, text, edits in zip(*(b.column(i).to_pylist() for i in range(3))):
            new, decided = splice(text or "", [(e["start"], e["end"], e["code"], e["ord"]) for e in edits], p.endswith(".py"))
            texts.append(new)
            told.append(decided)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(told, kind)], ["path", "content", "decided"])
