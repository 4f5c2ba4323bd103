"""From candidates and hits to findings: classes from prose, projections, weak signals, fixes that are asked for again."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import sample_file
from ..functions.text import split_lines, window_of_lines
from .findings import BANDS

# Classes that broad ids stand for, and the prose that tells them apart (first match counts).
BROAD_IDS = {
    "A01:2021": ["auth_bypass", "csrf", "open_redirect", "path_traversal"],
    "A03:2021": ["code_injection", "command_injection", "ldap_injection", "nosqli", "sqli", "unsafe_yaml", "xss"],
}
CLASS_HINTS = [
    ("xss", r"cross.site scripting|\bxss\b|innerHTML|outerHTML|dangerouslySetInnerHTML|document\.write|html.*inject|reflected.*html|stored.*html|autoescape.*false|jinja.*\bsafe\b"),
    ("command_injection", r"command.injection|subprocess.*shell|os\.system|os\.popen|child_process|shell=True|shell.*true"),
    ("code_injection", r"code.injection|\beval\b|\bexec\b|server.side template|\bssti\b|template.*inject"),
    ("unsafe_yaml", r"unsafe.yaml|yaml\.load"),
    ("ldap_injection", r"\bldap\b.*inject|inject.*\bldap\b|\bldap\b.*filter|directory.*inject|ldap\.search|ldap3\.|DirContext|escape_filter_chars"),
    ("nosqli", r"nosql.*inject|inject.*nosql|mongodb.*inject|pymongo|mongoose.*inject|\$where|\$ne|\$regex|\$gt|\$lt|document.*store.*inject"),
    ("sqli", r"\bsql\b.*inject|inject.*\bsql\b|\bsql.*quer|cursor\.execute|raw.*quer|orm.*raw|prepared.*statement"),
    ("path_traversal", r"path.*travers|directory.*travers|zip.*slip|tar.*slip|arbitrary.*file|\blfi\b|\brfi\b|file.*inclus|\.\./"),
    ("open_redirect", r"open.*redirect|unvalidated.*redirect"),
    ("deserialization", r"deserializ|pickle|marshal|java.*serial|untrusted.*object"),
    ("unsafe_file_upload", r"file.*upload|upload.*file|mime.*type|arbitrary.*upload|file.*ext(?:ension)?"),
]
# Classes whose fixes can be written as code.
FIXABLE = ["sqli", "xss", "command_injection", "ssrf", "path_traversal", "code_injection", "deserialization", "unsafe_yaml", "xxe", "ldap_injection", "nosqli", "open_redirect", "csrf"]
# Defences whose absence around an upload handler counts, and what they are to guard.
SUFFIX_LIST = r"(?i)ALLOWED_EXTENSIONS|allowed_ext|extension\s+in\s+[\[{(]|splitext.*\[[-12]\]\s+in"
SIZE_LIMIT = r"(?i)MAX_CONTENT_LENGTH|MAX_FILE_SIZE|maxFileSize|limits\s*:\s*\{|fileSize\s*:"
RAW_NAME = r"(?i)\.filename\b|\.originalname\b"
PUBLIC_FOLDER = r"(?i)['\"/](static|public|uploads|media|wwwroot)/"
UNPACKS = r"(?i)\.extractall\s*\("
MAGIC_BYTES = r"(?i)python.magic|filetype\.guess|magic\.from_buffer|imghdr\."
UPLOAD_CLASS = "unsafe_file_upload"
RETRY_LINES = 500


def _or_empty(value: Column | str) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(value if isinstance(value, Column) else F.col(value), F.lit(""))


def class_from_prose(description: Column, fallback: Column) -> Column:
    """The class of the first hint that the description matches in any case, else the fallback.  Null matches none."""
    out = fallback
    for name, pattern in reversed(CLASS_HINTS):
        out = F.when(description.rlike("(?idU)" + pattern), F.lit(name)).otherwise(out)
    return out


def candidate_classes(finding_id: Column, description: Column, primary: Column) -> Column:
    """The classes under which a finding may meet candidates, in order: for a broad id the inferred one and then the id's others by name, else the primary one."""
    inferred = class_from_prose(description, primary)
    out = F.array(primary)
    for broad, classes in BROAD_IDS.items():
        # Bound once, so that the patterns are tried once.
        listed = F.get(F.transform(F.array(inferred), lambda c: F.concat(F.array(c), F.filter(F.array(*map(F.lit, classes)), lambda x: ~x.eqNullSafe(c)))), 0)  # noqa: B023
        out = F.when(F.upper(finding_id) == broad, listed).otherwise(out)
    return out


def line_text(start: Column, end: Column) -> Column:
    """"42" or "42-55"; null without a start (null or 0)."""
    one = start.cast("string")
    return F.when(F.coalesce(start, F.lit(0)) != 0, F.when((F.coalesce(end, F.lit(0)) != 0) & (end != start), F.concat(one, F.lit("-"), end.cast("string"))).otherwise(one))


def to_findings(candidates: DataFrame, templates: Mapping[str, tuple[str, str]], references: Mapping[str, str], status: str = "unverified") -> DataFrame:
    """V4: candidates as findings; other columns stay.

    An unknown severity is Medium, an unknown confidence too; the band follows the
    severity, the id is the class in capitals, and fix and scenario come from the class's
    template (class to fix and scenario), each where the candidate's own is null or empty.
    A known id's reference wins over the candidate's.
    """
    known = lambda c, names: F.when(c.isin(list(names)), c).otherwise("Medium")
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) if m else F.lit(None).cast("map<string,string>")
    severity, kind = known(F.col("severity"), BANDS), F.col("vuln_class")
    fix, scenario = (table({k: v[i] for k, v in templates.items()}) for i in (0, 1))
    out = candidates.withColumns({"__sl_severity": severity, "__sl_id": F.coalesce(_or_empty("vulnerability_id"), F.upper(kind))})
    return out.withColumns(
        {
            "cvss_band": F.coalesce(_or_empty("cvss_band"), F.try_element_at(table(BANDS), F.col("__sl_severity"))),
            "severity": F.col("__sl_severity"),
            "confidence": known(F.col("confidence"), ["High", "Medium", "Low"]),
            "vulnerability_id": F.col("__sl_id"),
            "affected_lines": line_text(F.col("line_start"), F.col("line_end")),
            "description": F.coalesce(_or_empty("description"), _or_empty("scanner_message"), F.concat(kind, F.lit(" detected"))),
            "suggested_fix": F.coalesce(_or_empty("suggested_fix"), F.try_element_at(fix, kind), F.lit("Review and remediate the identified vulnerability.")),
            "exploit_scenario": F.coalesce(_or_empty("exploit_scenario"), F.try_element_at(scenario, kind), F.concat(F.lit("Attacker exploits "), kind, F.lit(" in "), F.col("file"), F.lit("."))),
            "owasp_reference": F.coalesce(F.try_element_at(table(references), F.col("__sl_id")), F.col("owasp_reference"), F.lit("")),
            "verification_status": F.lit(status),
        }
    ).drop("__sl_severity", "__sl_id")


def secret_findings(hits: DataFrame) -> DataFrame:
    """A verified Critical finding for each hit (path, line, end_line, hint, detector); the value itself is never part of it."""
    at = F.when(F.col("line") == F.col("end_line"), F.col("line").cast("string")).otherwise(F.concat_ws("-", "line", "end_line"))
    hint = F.when(_or_empty("hint").isNotNull(), F.concat(F.lit(" The line begins with `"), F.col("hint"), F.lit("`."))).otherwise("")
    return hits.select(
        *[F.lit(v).alias(k) for k, v in {"vulnerability_id": "SECRET-001", "severity": "Critical", "confidence": "High", "cvss_band": BANDS["Critical"], "verification_status": "verified"}.items()],
        F.col("path").alias("affected_file"),
        at.alias("affected_lines"),
        F.concat(F.lit("A credential ("), F.col("detector"), F.lit(") stands in line "), at, F.lit("."), hint).alias("description"),
        F.lit("Take the credential out of the repository and rotate it.").alias("suggested_fix"),
    )


def verified_secrets(hits: DataFrame, verdicts: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """V5: hits with severity, but those that a verdict (keys, verdict) calls false_positive.

    Without a verdict a hit stays.  In sample files, which hold placeholders, a hit is
    Medium unless its verdict is real; elsewhere it is Critical.
    """
    v = verdicts.groupBy(*keys).agg(F.max(F.lower("verdict")).alias("__sl_v"))
    j = hits.join(v, keys, "left").filter(~F.col("__sl_v").eqNullSafe(F.lit("false_positive")))
    placeholder = sample_file(F.col(path)) & ~F.col("__sl_v").eqNullSafe(F.lit("real"))
    return j.withColumn("severity", F.when(placeholder, "Medium").otherwise("Critical")).drop("__sl_v")


def with_content(findings: DataFrame, files: DataFrame, file: str = "affected_file", path: str = "path", content: str = "content") -> DataFrame:
    """Findings with the content of their file and missing_file (boolean); a path is once in ``files``."""
    f = files.select(F.col(path).alias(file), F.col(content).alias("content"), F.lit(False).alias("missing_file"))
    return findings.join(f, file, "left").withColumn("missing_file", F.coalesce("missing_file", F.lit(True)))


def aligned(files: DataFrame, kept: DataFrame, path: str = "path") -> DataFrame:
    """Of the scanners' files those that are still in the snapshot."""
    return files.join(kept.select(path), path, "left_semi")


def weak_signals(window: Column) -> Column:
    """how many defences a window lacks: a list of suffixes, a size limit, a name of its own in a public folder, a look at the bytes before unpacking."""
    has = lambda p: F.coalesce(window.rlike(p), F.lit(False))
    signs = [~has(SUFFIX_LIST), ~has(SIZE_LIMIT), has(RAW_NAME) & has(PUBLIC_FOLDER), has(UNPACKS) & ~has(MAGIC_BYTES)]
    return reduce(lambda a, b: a + b, [s.cast("int") for s in signs])


def synthetic_candidates(handlers: DataFrame, candidates: DataFrame, files: DataFrame, path: str = "path", content: str = "content", least: int = 2) -> DataFrame:
    """(path, line, weak) of upload handlers (path, line) with ``least`` weak signals or more, in files that no upload candidate (file, vuln_class) has flagged.

    The signals are looked for from 30 lines above to 60 below; a file that is missing has every line missing.
    """
    flagged = candidates.filter(F.col("vuln_class") == UPLOAD_CLASS).select(F.col("file").alias("path"))
    open_ = handlers.select("path", "line").join(flagged, "path", "left_anti")
    text = files.select(F.col(path).alias("path"), split_lines(F.col(content)).alias("__sl_lines"))
    window = F.array_join(window_of_lines(F.coalesce("__sl_lines", F.array().cast("array<string>")), F.col("line"), 30, 60), "\n")
    return open_.join(text, "path", "left").select("path", "line", weak_signals(window).alias("weak")).filter(F.col("weak") >= least)


def needs_code(fix: Column, description: Column) -> Column:
    """V8: a fix without a code fence for a class that can be fixed in code, named in description or fix."""
    prose = F.lower(F.concat_ws(" ", F.coalesce(description, F.lit("")), F.coalesce(fix, F.lit(""))))
    return ~F.coalesce(fix.contains("```"), F.lit(False)) & reduce(or_, [prose.contains(x) for x in FIXABLE])


def strengthened(findings: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """V8: findings with better fixes and scenarios from answers (key, improved_fix, improved_scenario), one a key.

    Only findings that need code change; a fix is taken only with a code fence, a scenario
    only if it isn't empty; no finding is dropped.
    """
    j = findings.join(answers.select(key, "improved_fix", "improved_scenario"), key, "left")
    ask = needs_code(F.col("suggested_fix"), F.col("description"))
    fix = F.when(ask & F.coalesce(F.col("improved_fix").contains("```"), F.lit(False)), F.col("improved_fix")).otherwise(F.col("suggested_fix"))
    scenario = F.when(ask, F.coalesce(_or_empty("improved_scenario"), "exploit_scenario")).otherwise(F.col("exploit_scenario"))
    return j.withColumns({"suggested_fix": fix, "exploit_scenario": scenario}).drop("improved_fix", "improved_scenario")


def wants_retry(n_findings: Column, partial: Column, n_lines: Column, enabled: Column | bool = True) -> Column:
    """Nothing found in more than 500 lines that were read whole."""
    return (F.coalesce(n_findings, F.lit(0)) == 0) & ~F.coalesce(partial, F.lit(False)) & (F.coalesce(n_lines, F.lit(0)) > RETRY_LINES) & (enabled if isinstance(enabled, Column) else F.lit(enabled))
