"""Findings from the JSON of other tools, as candidate rows; malformed items are left out one by one."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEVERITY = {"error": "high", "warning": "medium", "info": "low", "high": "high", "medium": "medium", "low": "low"}
COLUMNS = ["tool", "file", "line_start", "line_end", "raw_rule_id", "message", "severity_hint"]

SEMGREP = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,`end`:struct<line:int>,extra:struct<message:string,severity:string>>>>"
BANDIT = "struct<results:array<struct<test_id:string,filename:string,line_number:int,line_range:array<int>,issue_text:string,issue_severity:string>>>"
GOSEC = "struct<Issues:array<struct<rule_id:string,file:string,line:string,details:string,severity:string,confidence:string>>>"
ESLINT = "array<struct<filePath:string,messages:array<struct<ruleId:string,line:int,endLine:int,message:string,severity:int>>>>"


def _severity(value: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(value)), F.lit("medium"))


def _inside(path: Column, root: str) -> Column:
    """A path below the workspace without the workspace."""
    prefix = root.rstrip("/") + "/" if root else ""
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path) if prefix else path


def _finish(rows: DataFrame, tool: str, keep: list[str]) -> DataFrame:
    good = F.col("file").isNotNull() & F.col("raw_rule_id").isNotNull() & F.col("line_start").isNotNull()
    return rows.withColumn("tool", F.lit(tool)).filter(good).select(*keep, *COLUMNS)


def semgrep(raw: DataFrame, column: str = "json", keep: list[str] = (), root: str = "") -> DataFrame:
    """S7."""
    r = raw.select(*keep, F.explode(F.from_json(column, SEMGREP)["results"]).alias("r"))
    start = F.col("r.start.line")
    return _finish(r.select(*keep, _inside(F.col("r.path"), root).alias("file"), start.alias("line_start"), F.coalesce("r.end.line", start).alias("line_end"), F.col("r.check_id").alias("raw_rule_id"), F.coalesce("r.extra.message", F.lit("")).alias("message"), _severity(F.col("r.extra.severity")).alias("severity_hint")), "semgrep", keep)


def bandit(raw: DataFrame, column: str = "json", keep: list[str] = (), root: str = "") -> DataFrame:
    """The last line is that of the range."""
    r = raw.select(*keep, F.explode(F.from_json(column, BANDIT)["results"]).alias("r"))
    last = F.try_element_at("r.line_range", F.lit(-1))
    return _finish(r.select(*keep, _inside(F.col("r.filename"), root).alias("file"), F.col("r.line_number").alias("line_start"), F.coalesce(last, "r.line_number").alias("line_end"), F.col("r.test_id").alias("raw_rule_id"), F.coalesce("r.issue_text", F.lit("")).alias("message"), _severity(F.col("r.issue_severity")).alias("severity_hint")), "bandit", keep)


def gosec(raw: DataFrame, column: str = "json", keep: list[str] = (), root: str = "") -> DataFrame:
    """Lines may be a range; low confidence is left out."""
    r = raw.select(*keep, F.explode(F.from_json(column, GOSEC)["Issues"]).alias("r")).filter(F.lower(F.coalesce("r.confidence", F.lit(""))) != "low")
    lines = F.split("r.line", "-")
    number = lambda c: F.expr(f"try_cast({c} AS int)")
    r = r.select(*keep, "r", F.get(lines, 0).alias("l0"), F.element_at(lines, -1).alias("l1"))
    return _finish(r.select(*keep, _inside(F.col("r.file"), root).alias("file"), number("l0").alias("line_start"), F.coalesce(number("l1"), number("l0")).alias("line_end"), F.col("r.rule_id").alias("raw_rule_id"), F.coalesce("r.details", F.lit("")).alias("message"), _severity(F.col("r.severity")).alias("severity_hint")), "gosec", keep)


def eslint(raw: DataFrame, column: str = "json", keep: list[str] = (), root: str = "") -> DataFrame:
    """Messages by file; severity 2 and up is high."""
    f = raw.select(*keep, F.explode(F.from_json(column, ESLINT)).alias("f")).select(*keep, F.col("f.filePath").alias("path"), F.explode("f.messages").alias("m"))
    hint = F.when(F.col("m.severity") >= 2, "high").otherwise("medium")
    return _finish(f.select(*keep, _inside(F.col("path"), root).alias("file"), F.col("m.line").alias("line_start"), F.coalesce("m.endLine", "m.line").alias("line_end"), F.col("m.ruleId").alias("raw_rule_id"), F.coalesce("m.message", F.lit("")).alias("message"), hint.alias("severity_hint")), "eslint", keep)


TOOLS = {"semgrep": semgrep, "bandit": bandit, "gosec": gosec, "eslint": eslint}


def candidates(raw: DataFrame, enabled: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    """Raw (tool_name, json) of the enabled tools (None: all; empty: none) as one table."""
    names = [n for n in TOOLS if enabled is None or n in enabled]
    out = None
    for n in names:
        one = TOOLS[n](raw.filter(F.col("tool_name") == n), keep=keep)
        out = one if out is None else out.unionByName(one)
    return semgrep(raw.limit(0), keep=keep) if out is None else out


#: A quoted string (to the end if it isn't closed), or a bracket.
_JSON_PART = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[\[\]{}]', re.DOTALL)


@F.pandas_udf(T.StringType())
def json_payload(replies: pd.Series) -> pd.Series:
    """The JSON array or object of a model's reply: fences off, prose around it off, brackets balanced."""

    def payload(text: str | None) -> str | None:
        at = min((i for i in (text.find("["), text.find("{")) if i >= 0), default=-1) if text else -1
        depth = 0
        for part in _JSON_PART.finditer(text, at) if at >= 0 else ():
            depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(part.group(), 0)
            if depth == 0:
                return text[at : part.end()]
        return None

    return replies.map(payload)


FINDING = "struct<vulnerability_id:string,severity:string,confidence:string,cvss_band:string,affected_file:string,affected_lines:string,description:string,suggested_fix:string,exploit_scenario:string,verification_status:string>"


def model_findings(replies: DataFrame, column: str = "reply", keep: list[str] = ()) -> DataFrame:
    """Findings of a model's replies, an array or an object with ``findings``; unreadable replies give none."""
    r = replies.select(*keep, json_payload(column).alias("j"))
    listed = F.when(F.col("j").startswith("["), F.from_json("j", f"array<{FINDING}>")).otherwise(F.from_json("j", f"struct<findings:array<{FINDING}>>")["findings"])
    return r.select(*keep, F.explode(listed).alias("f")).filter("f IS NOT NULL").select(*keep, "f.*")
