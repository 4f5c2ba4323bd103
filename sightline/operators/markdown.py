"""A run's report as one Markdown text, by ordered string aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of finding ids, and the wording and order of a report's sections.
NAMES = {
    "A01:2021": "Broken Access Control",
    "A02:2021": "Cryptographic Failures",
    "A03:2021": "Injection",
    "A04:2021": "Insecure Design",
    "A05:2021": "Security Misconfiguration",
    "A06:2021": "Vulnerable and Outdated Components",
    "A07:2021": "Identification and Authentication Failures",
    "A08:2021": "Software and Data Integrity Failures",
    "A09:2021": "Security Logging and Monitoring Failures",
    "A10:2021": "Server-Side Request Forgery",
    "LLM01:2025": "Prompt Injection",
    "LLM02:2025": "Sensitive Information Disclosure",
    "LLM03:2025": "Supply Chain",
    "LLM04:2025": "Data and Model Poisoning",
    "LLM05:2025": "Improper Output Handling",
    "LLM06:2025": "Excessive Agency",
    "LLM07:2025": "System Prompt Leakage",
    "LLM08:2025": "Vector and Embedding Weaknesses",
    "LLM09:2025": "Misinformation",
    "LLM10:2025": "Unbounded Consumption",
    "SECRET-001": "Hardcoded Credential",
    "SQLI": "SQL Injection",
    "XSS": "Cross-Site Scripting",
    "COMMAND_INJECTION": "Command Injection",
    "PATH_TRAVERSAL": "Path Traversal",
    "SSRF": "Server-Side Request Forgery",
    "DESERIALIZATION": "Insecure Deserialization",
    "WEAK_CRYPTO": "Weak Cryptography",
    "XXE": "XML External Entity",
    "CSRF": "Cross-Site Request Forgery",
    "OPEN_REDIRECT": "Open Redirect",
    "AUTH_BYPASS": "Authentication Bypass",
    "CODE_INJECTION": "Code Injection",
    "INSECURE_RANDOM": "Insecure Randomness",
    "UNSAFE_YAML": "Unsafe YAML Deserialization",
    "UNSAFE_FILE_UPLOAD": "Unsafe File Upload",
    "INJECTION_GENERIC": "Injection",
    "REDOS": "Regular Expression DoS",
    "RUNTIME_PANIC": "Runtime Panic / DoS",
    "SUBPROCESS_USAGE": "Subprocess Usage",
    "INSECURE_NETWORK_CONFIG": "Insecure Network Configuration",
    "POOR_ERROR_HANDLING": "Poor Error Handling",
    "INFO_DISCLOSURE": "Information Disclosure",
    "INSECURE_DESIGN": "Insecure Design",
    "SECURITY_MISCONFIGURATION": "Security Misconfiguration",
    "VULNERABLE_COMPONENTS": "Vulnerable Components",
    "LOGGING_MONITORING_FAILURE": "Insufficient Logging & Monitoring",
    "MEMORY_SAFETY": "Memory Safety Issue",
    "LDAP_INJECTION": "LDAP Injection",
    "NOSQLI": "NoSQL Injection",
    "HARDCODED_SECRET": "Hardcoded Credential",
}
TITLE = "# Security Scan Report"
METADATA = [("Scan ID", "scan_id", "`"), ("Repository", "repo_url", ""), ("Timestamp", "timestamp", ""), ("Scan type", "scan_type", "`"), ("Scan target", "scan_target", "`"), ("Triggered by", "triggered_by", "")]
GATED = "deployment_gate"
PARTIAL = "⚠️ **PARTIAL SCAN** — the following files were not analysed: "
NONE_LISTED = "_(none listed)_"
CONFLICTING = "⚠️ **CONFLICTING FINDINGS** — %d Critical findings were not confirmed by the verification pass. These are reported as advisories."
ADVISORY = "⚠️ **ADVISORY** — %d findings are High/Critical severity but have Medium/Low confidence. These are not blocking."
AUTO_TRIAGED = "ℹ️ **AUTO-TRIAGED** — %d findings were auto-triaged as potential issues with medium confidence. These are not blocking — review at your discretion."
NO_FINDINGS = "⚠️ **NO FINDINGS DETECTED** — developer acknowledgement required before gate passes."
TABLE_HEAD = ["| ID | Severity | Confidence | Verification | File | Lines | OWASP reference |", "| --- | --- | --- | --- | --- | --- | --- |"]
BADGE = "\n> **Potential issue (auto-triaged, not blocking)**"
UPLOAD_FIELDS = ["Validation", "Naming", "Storage", "Limits", "Access", "Processing"]
UPLOAD = r"(?s)Validation:\s*([^—]+)—\s*Naming:\s*([^—]+)—\s*Storage:\s*([^—]+)—\s*Limits:\s*([^—]+)—\s*Access:\s*([^—]+)—\s*Processing:\s*(.+)"


def cell(value: Column) -> Column:
    """A table cell: bars escaped, line feeds as blanks."""
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def named(finding_id: Column) -> Column:
    """The id, with its name where it has one."""
    name = F.try_element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), finding_id)
    return F.when(name.isNotNull(), F.concat(finding_id, F.lit(" ("), name, F.lit(")"))).otherwise(finding_id)


def _or(value: Column, other: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", other).otherwise(value)


def table_row(f: DataFrame) -> Column:
    cells = [named(f.vulnerability_id), f.severity, f.confidence, f.verification_status, f.affected_file, _or(f.affected_lines, "—"), f.owasp_reference]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.coalesce(c, F.lit(""))) for c in cells]), F.lit(" |"))


def upload_panel(summary: Column) -> Column:
    """What is told of an upload's context: a line of its fields, or the summary as it is."""
    fields = [F.concat(F.lit(f"{name}: "), F.regexp_replace(F.regexp_extract(summary, UPLOAD, i), r"^\s+|\s+$", "")) for i, name in enumerate(UPLOAD_FIELDS, 1)]
    plain = F.concat(F.lit("\n**Upload context**\n\n```\n"), summary, F.lit("\n```\n"))
    return F.when(summary.rlike(UPLOAD), F.concat(F.lit("\n**Upload context**\n\n- "), F.concat_ws(" — ", *fields), F.lit("\n"))).otherwise(plain)


def detail(f: DataFrame) -> Column:
    """The section of one finding."""
    lines, score, summary = F.coalesce(f.affected_lines, F.lit("")), f.consensus_score, f.context_summary
    location = F.concat(F.lit("`"), f.affected_file, F.when(lines != "", F.concat(F.lit(":"), lines)).otherwise(""), F.lit("`"))
    by = F.concat(F.lit("- **Detected by**: "), F.array_join("sources", ", "), F.format_string(" (%d voter%s)\n", score, F.when(score == 1, "").otherwise("s")))
    context = F.when(summary.contains("Validation:"), upload_panel(summary)).otherwise(F.concat(F.lit("\n**Cross-file context**\n\n```\n"), summary, F.lit("\n```\n")))
    part = lambda head, c: F.concat(F.lit(f"\n\n**{head}**\n\n"), F.coalesce(c, F.lit("")))
    return F.concat(
        F.lit("### "),
        named(f.vulnerability_id),
        F.lit(" — "),
        f.severity,
        F.format_string(" (confidence: %s, verification: %s)", f.confidence, f.verification_status),
        F.when(f.verification_status == "advisory_real", BADGE).otherwise(""),
        F.lit("\n\n- **Location**: "),
        location,
        F.lit("\n- **OWASP reference**: "),
        F.coalesce(f.owasp_reference, F.lit("")),
        F.lit("\n- **Patch file**: `"),
        F.coalesce(f.patch_file_path, F.lit("")),
        F.lit("`\n"),
        F.when((score >= 1) & (F.size("sources") > 0), by).otherwise(""),
        F.lit("\n**Description**\n\n"),
        F.coalesce(f.description, F.lit("")),
        part("Exploit scenario", f.exploit_scenario),
        part("Suggested fix", f.suggested_fix),
        F.when(F.coalesce(summary, F.lit("")) != "", context).otherwise(""),
    )


def reports(scans: DataFrame, findings: DataFrame, key: str = "scan_id", order: str = "ord") -> DataFrame:
    """key, report: one text a scan, also for scans without findings.

    scans: the columns of METADATA, partial_scan, unscanned_files (array), gate_decision.
    findings: key, order (unique in a scan), vulnerability_id, severity, confidence,
    verification_status, affected_file, affected_lines, owasp_reference, patch_file_path,
    consensus_score, sources (array), description, exploit_scenario, suggested_fix,
    context_summary.  Each level of a report is one ordered aggregation of strings; a scan's
    report is one row and is put together by the task that has its findings.
    """
    f = findings.select("*", table_row(findings).alias("__sl_row"), detail(findings).alias("__sl_detail"))
    in_order = lambda c, by: F.expr(f"listagg({c}, '{by}') WITHIN GROUP (ORDER BY `{order}`)")
    critical, high = F.col("severity") == "Critical", F.col("severity") == "High"
    told = f.groupBy(F.col(key).alias("__sl_key")).agg(
        F.count(F.lit(1)).alias("__sl_n"),
        in_order("__sl_row", "\\n").alias("__sl_rows"),
        in_order("__sl_detail", "\\n\\n---\\n\\n").alias("__sl_details"),
        F.count_if(critical & (F.col("verification_status") == "conflicting")).alias("__sl_conflicting"),
        F.count_if((critical | high) & F.col("confidence").isin("Medium", "Low")).alias("__sl_advisory"),
        F.count_if(F.col("verification_status") == "advisory_real").alias("__sl_triaged"),
    )
    # A null-safe join would deal the texts anew; by plain keys they stay where they were put together.
    met = scans.filter(F.col(key).isNotNull()).join(told, F.col(key) == F.col("__sl_key"), "left")
    met = met.unionByName(scans.filter(F.col(key).isNull()).join(told.filter("__sl_key IS NULL"), F.lit(True), "left"))
    n = F.coalesce("__sl_n", F.lit(0))
    some = lambda c, text: F.when(F.col(c) > 0, F.format_string(text, F.col(c)))
    unread = F.array_join(F.transform(F.coalesce("unscanned_files", F.array().cast("array<string>")), lambda p: F.concat(F.lit("`"), p, F.lit("`"))), ", ")
    warnings = F.concat_ws(
        "\n\n",
        F.when(F.col("partial_scan"), F.concat(F.lit(PARTIAL), _or(unread, NONE_LISTED))),
        some("__sl_conflicting", CONFLICTING),
        some("__sl_advisory", ADVISORY),
        some("__sl_triaged", AUTO_TRIAGED),
        F.when(n == 0, NO_FINDINGS),
    )
    metadata = F.concat_ws("\n", F.lit("## Scan metadata"), *[F.concat(F.lit(f"- **{name}**: {mark}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(mark)) for name, c, mark in METADATA])
    report = F.concat_ws(
        "\n\n",
        F.lit(TITLE),
        metadata,
        F.when(warnings != "", F.concat(F.lit("## Warnings\n\n"), warnings)),
        F.when(F.col("scan_type") == GATED, F.concat(F.lit("## Gate decision: `"), F.upper("gate_decision"), F.lit("`"))),
        F.when(n > 0, F.concat_ws("\n", F.format_string("## Findings (%d)", n), F.lit(""), *map(F.lit, TABLE_HEAD), F.col("__sl_rows"))),
        F.when(n > 0, F.concat(F.lit("## Finding details\n\n---\n\n"), F.col("__sl_details"))),
        F.format_string("---\n\n*Findings: %d*", n),
    )
    return met.select(key, F.concat(report, F.lit("\n")).alias("report"))
