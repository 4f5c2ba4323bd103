"""Findings from candidates, context bundles, fix gates and published runs against plain models and boundary cases."""

import re

from pyspark.sql import functions as F

from sightline.operators import context, fixes, history, report, review


def test_classes_of_broad_ids(spark):
    rows = [("A03:2021", "eval in an XSS sink innerHTML", "sqli"), ("A03:2021", "", "sqli"), ("a01:2021", None, "auth_bypass"), ("A05:2021", "xss", "misconfig"), ("A01:2021", "an XSS", "auth_bypass")]
    df = spark.createDataFrame(rows, "id string, d string, p string")
    got = [r.c for r in df.select(review.candidate_classes(F.col("id"), F.col("d"), F.col("p")).alias("c")).collect()]
    broad = review.BROAD_IDS
    assert got[0] == ["xss"] + [c for c in broad["A03:2021"] if c != "xss"]
    assert got[1][0] == "sqli" and sorted(got[1]) == broad["A03:2021"]
    assert got[2][0] == "auth_bypass" and sorted(got[2]) == broad["A01:2021"]
    assert got[3] == ["misconfig"]
    assert got[4] == ["xss", *broad["A01:2021"]]


def test_line_text_and_unknown_values(spark):
    rows = [(0, 5, "4"), (None, None, None), (3, None, ""), (3, 3, "High"), (3, 9, "Critical")]
    df = spark.createDataFrame(rows, "line_start int, line_end int, severity string")
    for c in ("cvss_band", "vulnerability_id", "description", "scanner_message", "suggested_fix", "exploit_scenario", "owasp_reference", "confidence"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    out = review.to_findings(df.withColumns({"vuln_class": F.lit("xxe"), "file": F.lit("a")}), {}, {}).collect()
    assert [r.affected_lines for r in out] == [None, None, "3", "3", "3-9"]
    assert [r.severity for r in out] == ["Medium", "Medium", "Medium", "High", "Critical"]
    assert {r.description for r in out} == {"xxe detected"} and {r.owasp_reference for r in out} == {""}


def test_secret_findings_never_hold_values(spark):
    hits = spark.createDataFrame([("a.py", 3, 3, "KEY =", "d"), ("a.py", 5, 9, "", "pem")], "path string, line int, end_line int, hint string, detector string")
    got = {r.affected_lines: r for r in review.secret_findings(hits).collect()}
    assert set(got) == {"3", "5-9"} and "`KEY =`" in got["3"].description and "begins" not in got["5-9"].description


def _plain_callees(text):
    seen = {}
    for kind, pattern in context.CALLEES:
        pattern, flags = pattern.replace("(?iU)", "").replace("(?U)", ""), re.I if pattern.startswith("(?i") else 0
        for m in re.finditer(pattern, text, flags):
            if kind != "other" or m.group(1) not in context.NOT_CALLED:
                seen.setdefault(m.group(1), kind)
    order = [k for k, _ in context.CALLEES]
    return sorted(seen.items(), key=lambda x: (order.index(x[1]), x[0]))


def test_callees(spark):
    texts = ["if (x) foo(y); Query(z); verify_it(a)", "", "ab(c) abc(d)", "can_x(); can_x(); delete(); größe(1)", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [[tuple(c) for c in r.c] for r in df.select(context.callees(F.col("t"), None).alias("c")).collect()]
    assert got == [_plain_callees(t or "") for t in texts]


def test_bundles(spark):
    body = "\n".join(f"l{i}" for i in range(1, 61))
    files = [("a.py", "@app.get('/a')\ndef a(): query(x)\n"), ("b.py", body), ("c.py", "\n".join(f"@app.get('/c{i}')" for i in range(9)))]
    cand = [(1, "a.py", 2, None, ["llm"]), (2, "b.py", 30, 31, ["llm"]), (3, "b.py", 30, None, ["bandit"]), (4, "gone.py", 1, 1, ["llm"]), (5, "b.py", 0, None, ["llm"]), (6, "c.py", 1, 1, ["llm"]), (7, "b.py", 90, 95, ["llm"])]
    out = context.bundles(spark.createDataFrame(cand, "candidate_ord int, file string, line_start int, line_end int, sources array<string>"), spark.createDataFrame(files, "path string, content string"))
    got = {r.candidate_ord: r for r in out.collect()}
    assert len(got) == len(cand)
    assert [c.name for c in got[1].callees] == ["query", "get"] and [r.route for r in got[1].routes] == ["/a"]
    assert got[2].snippet.split("\n") == [f"l{i}" for i in range(23, 40)]
    assert got[3].snippet.split("\n") == [f"l{i}" for i in range(17, 45)]
    assert got[4].snippet == "" and got[4].routes == [] and got[4].callees == []
    assert got[5].snippet.split("\n") == [f"l{i}" for i in range(1, 31)]
    assert len(got[6].routes) == context.MAX_ROUTES and got[7].snippet == ""
    assert [(r.path, r.route) for r in got[2].routes] == [("a.py", "/a")] + [("c.py", f"/c{i}") for i in range(4)]


def _plain_introduced(old, new):
    for label, danger, safe in fixes.ANTI_PATTERNS:
        bad = lambda t: bool(re.search(danger, t)) and not (safe and re.search(safe, t))  # noqa: B023, E731
        if bad(new) and not bad(old):
            return label
    return None


def test_introduced_patterns(spark):
    samples = ["yaml.load(x)", "yaml.load(x, Loader=L)", "hashlib.md5(x)", "hashlib.md5(x, usedforsecurity=False)", "verify = false", "debug=True", "eval (x)", "x.extractall(y)", "chmod 0777", "algorithms = []", "ok", "SECRET_KEY='test'"]
    pairs = [(a, b) for a in samples for b in samples]
    df = spark.createDataFrame(pairs, "old string, new string")
    got = [r[0] for r in df.select(fixes.introduced(F.col("old"), F.col("new"))).collect()]
    assert got == [_plain_introduced(a, b) for a, b in pairs]
    assert "yaml.load( without Loader=" in got and "debug=True" in got


def test_strict_gates_and_sections(spark):
    code = "```py\nx\n```"
    rows = [("SECRET-001", "k.py", "1", "", code), ("A01:2021", "a.py", "1", "", code), ("A03:2021", "auth/a.py", "1", "", code), ("A03:2021", "a.py", "1", "", "```py\nDEBUG = 1\n```"), ("A03:2021", "a.py", "2-1", "", code), ("A03:2021", "a.py", "1", "", code), (None, None, None, None, None)]
    f = spark.createDataFrame(rows, "vulnerability_id string, affected_file string, affected_lines string, description string, suggested_fix string").withColumns({"owasp_reference": F.lit(None).cast("string"), "i": F.monotonically_increasing_id(), "scan": F.lit(1)})
    files = spark.createDataFrame([("a.py", "l\n"), ("auth/a.py", "l")], "path string, content string")
    strict = fixes.classify_fixes(f, files, strict=True)
    assert [(r.outcome, r.reason) for r in strict.orderBy("i").collect()] == [("secret", None), ("manual", "category"), ("manual", "protected path"), ("manual", "protected variable"), ("manual", "out of bounds"), ("edit", None), ("manual", "no drop-in")]
    loose = fixes.classify_fixes(f, files)
    assert [r.risk_note for r in loose.orderBy("i").collect()][1:4] == ["category A01:2021", "protected path", "touches DEBUG"]
    s = fixes.review_sections(strict, ["scan"]).collect()[0]
    assert s.secret_files == ["k.py"] and s.applied == ["a.py:1 (A03:2021)"] and len(s.manual) == 5


def test_published_batches(spark, tmp_path):
    runs = spark.createDataFrame([("s1", "u", "ok", 5), ("s2", "", "ok", 7), ("s3", "u", "failed", 9)], "scan_id string, user_email string, status string, input_tokens long")
    runs = runs.withColumns({"finished_at": F.lit("2026-03-01").cast("timestamp"), "provider": F.lit("p"), "model": F.lit("m"), "output_tokens": F.lit(1).cast("long"), "findings": F.lit(2)})
    now, folder = F.lit("2026-03-02").cast("timestamp"), str(tmp_path)
    history.publish(history.run_rows(runs, now), folder, "b1")
    history.publish(history.run_rows(runs, now), folder, "b1")
    history.publish(history.run_rows(runs, now, ci=True), folder, "b2")
    runs.limit(1).select("scan_id", "user_email", "finished_at", "status", "findings").write.parquet(f"{folder}/scans/batch=broken")
    scans = history.published(spark, folder, "scans").collect()
    assert sorted((r.batch, r.scan_id, r.status) for r in scans) == [("b1", "s1", "ok"), ("b1", "s3", "failed"), ("b2", "s1", "ok"), ("b2", "s3", "ok")]
    assert history.published(spark, folder, "usage").count() == 2
    monthly = history.published(spark, folder, "monthly").collect()
    assert {(r.input_tokens, r.scan_count) for r in monthly} == {(14, 2)}


def test_small_reports(spark):
    names = spark.createDataFrame([("R.9.md",), ("R.12.md",), ("xR.99.md",), (None,)], "n string")
    assert report.next_index(names, "n", r"R\.(\d+)\.md").collect()[0][0] == 13
    assert report.next_index(names.limit(0), "n", r"R\.(\d+)\.md").collect()[0][0] == 1
    audit = history.audit_rows(spark.createDataFrame([("e", "u", "a", 1, None), ("e", "u", "a", None, None)], "event_type string, user_email string, actor_email string, x int, y string"), ["x", "y"], F.current_timestamp())
    assert [r.metadata for r in audit.collect()] == ['{"x":1}', None]
