"""Column functions over file texts, paths and line ranges, all JVM-side.

Line rules differ on purpose: totals and secrets count "\\n" alone, snippets use every
line boundary of :data:`LINE_BREAK`; and there are three readings of a line range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All line boundaries, a carriage return with line feed as one.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
SEVERITIES = ["Critical", "High", "Medium", "Low"]


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


def total_lines(text: Column) -> Column:
    """A13's line count of one text: line feeds plus one."""
    return (newline_count(text) + 1).cast("long")


def split_lines(text: Column) -> Column:
    """Lines at every boundary; a final empty line is dropped, an empty text has none."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last dotted part of the base name with its dot; none for dotfiles and trailing dots."""
    name = F.regexp_extract(basename(path), r"^[.]*[^.].*(\.[^.]+)$", 1)
    return name


def csv_list(value: Column) -> Column:
    """Comma-separated text to trimmed, non-empty items."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character, 0 for an empty text."""
    n = F.length(value)
    chars = F.array_distinct(F.filter(F.split(value, ""), lambda c: c != ""))
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))))


def range_hyphen(lines: Column) -> tuple[Column, Column]:
    """ "42" or "42-55"; 0, 0 if it can't be read."""
    start = F.try_to_number(F.trim(F.substring_index(lines, "-", 1)), F.lit("9999999999")).cast("long")
    tail = F.when(F.instr(lines, "-") > 0, F.substr(lines, F.instr(lines, "-") + 1)).otherwise(lines)
    end = F.try_to_number(F.trim(tail), F.lit("9999999999")).cast("long")
    good = start.isNotNull() & end.isNotNull()
    return F.when(good, start).otherwise(F.lit(0)), F.when(good, end).otherwise(F.lit(0))


def range_anchored(lines: Column) -> tuple[Column, Column]:
    """Whole text a number or two with hyphen or en dash; null otherwise."""
    pattern = "^\\s*(\\d+)\\s*(?:[-–]\\s*(\\d+))?\\s*$"
    start = F.nullif(F.regexp_extract(lines, pattern, 1), F.lit("")).cast("long")
    end = F.nullif(F.regexp_extract(lines, pattern, 2), F.lit("")).cast("long")
    return start, F.coalesce(end, start)


def range_searched(lines: Column) -> tuple[Column, Column]:
    """The first number or pair anywhere, put in order; null without any."""
    pattern = "(\\d+)(?:\\s*[-–]\\s*(\\d+))?"
    start = F.nullif(F.regexp_extract(lines, pattern, 1), F.lit("")).cast("long")
    end = F.coalesce(F.nullif(F.regexp_extract(lines, pattern, 2), F.lit("")).cast("long"), start)
    return F.least(start, end), F.greatest(start, end)


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column, tolerance: int) -> Column:
    return F.greatest(a0, b0) <= F.least(a1, b1) + tolerance


def window_of_lines(lines: Column, line: Column, before: int, after: int, cap: int | None = None) -> Column:
    """The lines around a 1-based line, at most ``cap``."""
    first = F.greatest(line - before, F.lit(1))
    n = line + after - first + 1
    n = F.least(n, F.lit(cap)) if cap else n
    return F.when(F.size(lines) > 0, F.slice(lines, first, F.greatest(n, F.lit(0)))).otherwise(lines)


def normal_band(band: Column) -> Column:
    """CVSS bands with an ASCII hyphen."""
    return F.translate(band, "–", "-")


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for i, name in reversed(list(enumerate(SEVERITIES))):
        out = F.when(severity == name, F.lit(i)).otherwise(out)
    return out


def repo_parts(url: Column) -> Column:
    """owner and name of an https or ssh repository URL, a final .git left out; nulls if neither."""
    pattern = r"^(?:https?://[^/]+/|git@[^:]+:)([^/]+)/([^/]+?)(?:\.git)?/?$"
    part = lambda i: F.nullif(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.struct(part(1).alias("owner"), part(2).alias("name"))


def repo_display(url: Column) -> Column:
    """The last two segments of a URL."""
    parts = F.filter(F.split(F.regexp_replace(url, r"(\.git)?/*$", ""), "[/:]"), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(url)


def masked(value: Column, shown: int = 4) -> Column:
    """Stars but for the last characters."""
    n = F.length(value)
    return F.concat(F.repeat(F.lit("*"), F.greatest(n - shown, F.lit(0))), F.right(value, F.least(n, F.lit(shown))))


def table_cell(value: Column) -> Column:
    """A text for one cell of a Markdown table."""
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def fenced_code(value: Column) -> Column:
    """The body of the first fenced block, null without one."""
    found = F.regexp_extract(value, "(?s)```[^\n`]*\n(.*?)```", 0)
    return F.when(found != "", F.regexp_extract(value, "(?s)```[^\n`]*\n(.*?)```", 1))


def quick_fix_label(fix: Column) -> Column:
    """How small a fix is by its lines that are not blank; empty if there is none or it is longer than three."""
    n = F.size(F.filter(split_lines(fix), lambda x: x.rlike(r"\S")))
    return F.when(F.coalesce(F.length(fix), F.lit(0)) == 0, "").when(n <= 1, "1-line fix").when(n <= 3, "quick fix").otherwise("")


def defanged(value: Column, tag: str) -> Column:
    """A text in which the tag can't be closed or opened, for wrapping in it."""
    return F.regexp_replace(value, rf"(?i)<(/?)\s*{tag}", f"&lt;$1{tag}")


def attribute(value: Column) -> Column:
    """A value for a double-quoted attribute."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value


# Fields whose values are never logged, names that a record has itself.
DENIED_FIELDS = ["content", "source_code", "code", "file_content", "prompt", "payload", "api_key", "password", "secret", "private_key", "access_token", "session_token", "webhook_url", "token_value"]
OWN_FIELDS = ["args", "asctime", "created", "exc_info", "exc_text", "filename", "funcName", "levelname", "levelno", "lineno", "message", "module", "msecs", "msg", "name", "pathname", "process", "processName", "relativeCreated", "stack_info", "thread", "threadName", "taskName"]


def redacted_fields(fields: Column, denied: list[str] = DENIED_FIELDS) -> Column:
    """A map whose denied keys have their values blanked."""
    return F.transform_values(fields, lambda k, v: F.when(k.isin(list(denied)), F.lit("[REDACTED]")).otherwise(v))


def log_line(at: Column, level: Column, message: Column, scan_id: Column, fields: Column) -> Column:
    """A log record as JSON: timestamp, level, message, scan_id if there is one, and the fields, redacted, by name.

    Fields with a name that a record has itself get the prefix ctx_, those with a leading _ are left out.
    """
    kept = F.map_filter(F.coalesce(fields, F.create_map().cast("map<string,string>")), lambda k, _: ~k.startswith("_"))
    own = redacted_fields(F.transform_keys(kept, lambda k, _: F.when(k.isin(OWN_FIELDS), F.concat(F.lit("ctx_"), k)).otherwise(k)))
    # A field of the same name stands for the record's.
    head = F.map_filter(F.create_map(F.lit("timestamp"), at, F.lit("level"), level, F.lit("message"), message, F.lit("scan_id"), scan_id), lambda k, v: ((k != "scan_id") | v.isNotNull()) & ~F.map_contains_key(own, k))
    return F.to_json(F.map_concat(head, F.map_from_entries(F.array_sort(F.map_entries(own)))), {"ignoreNullFields": "false"})


def alerts(mode: Column, repo: Column, pipeline_repo: str) -> Column:
    """Whether a bypass is told: never in mode none, not for the pipeline's own repository in dev_only, else always."""
    return F.when(mode == "none", False).when((mode == "dev_only") & F.coalesce(repo == pipeline_repo, F.lit(False)), False).otherwise(True)
