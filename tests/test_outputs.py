"""Diffs, edited files, metrics and reports against plain models."""

import ast
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.operators import diffs, fixes, markdown, metrics

# ---- diffs -----------------------------------------------------------------------------


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(row[-1], before[j + 1]))
    return row[-1]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14))
def test_matches_are_a_longest_common_subsequence(a, b):
    got = diffs.matches(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(i < u and j < v for (i, j), (u, v) in zip(got, got[1:]))
    assert len(got) == longest(a, b)


def apply(patch, old, first):
    """The new lines, by a plain reading of the format."""
    if not patch:
        return old
    lines, out, at = patch.splitlines(keepends=True)[2:], [], 0
    for x in lines:
        if x.startswith("@@"):
            start, _, n = x.split()[1][1:].partition(",")
            i = int(start) - first + (n == "0")
            out, at = out + old[at:i], i
        elif x[0] == " ":
            assert old[at] == x[1:]
            out, at = [*out, x[1:]], at + 1
        elif x[0] == "-":
            assert old[at] == x[1:]
            at += 1
        else:
            out.append(x[1:])
    return out + old[at:]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(["a\n", "b\n", "c\n"]), max_size=40), st.lists(st.sampled_from(["a\n", "b\n", "d\n"]), max_size=40), st.integers(1, 50))
def test_patches_apply(old, new, first):
    assert apply(diffs.unified(old, new, "f", first), old, first) == new


def test_hunks():
    old = [f"{i}\n" for i in range(1, 31)]
    new = old[:4] + ["x\n"] + old[5:11] + ["y\n"] + old[11:24] + old[25:]
    assert diffs.unified(old, new, "d/f.py") == "".join(
        ["--- a/d/f.py\n", "+++ b/d/f.py\n", "@@ -2,13 +2,14 @@\n", " 2\n", " 3\n", " 4\n", "-5\n", "+x\n", " 6\n", " 7\n", " 8\n", " 9\n", " 10\n", " 11\n", "+y\n", " 12\n", " 13\n", " 14\n", "@@ -22,7 +23,6 @@\n", " 22\n", " 23\n", " 24\n", "-25\n", " 26\n", " 27\n", " 28\n"]
    )
    assert diffs.unified([], ["a\n"], "f") == "--- a/f\n+++ b/f\n@@ -0,0 +1 @@\n+a\n"
    long = [f"{i % 7}\n" for i in range(4000)]
    assert apply(diffs.unified(long, long[:2000] + ["n\n"] + long[2100:], "f"), long, 1) == long[:2000] + ["n\n"] + long[2100:]


def test_patches_of_findings(spark):
    content = "\n".join(f"line {i}" for i in range(1, 13))
    files = spark.createDataFrame([("d/a.py", content), ("b.py", "one"), ("none.py", None)], "path string, content string")
    rows = [
        (1, "d/a.py", "4-5", "```py\nline 4\nnew\nline 5\n```"),
        (2, "b.py", "1", "text\n```\ntwo\nthree```"),
        (3, "b.py", "2", "```\nx\n```"),
        (4, "b.py", "1", "no code"),
        (5, "gone.py", "1", "```\nx\n```"),
        (6, "b.py", "1-1", "```\none\n```"),
        (7, "b.py", None, "```\nx\n```"),
        (8, "b.py", "1", None),
        (9, "none.py", "1", "```\nx\n```"),
        (10, "d/a.py", "12", "```\nlast\n```"),
        (11, "d/a.py", "5-4", "```\nx\n```"),
    ]
    found = spark.createDataFrame([(n, "s", n, *r) for n, *r in rows], "n int, scan_id string, finding_index int, affected_file string, affected_lines string, suggested_fix string")
    got = {r.n: (r.name, r.patch) for r in diffs.patches(found, files, ["n"]).collect()}
    assert got == {
        1: ("s_1_a.py.patch", "--- a/d/a.py\n+++ b/d/a.py\n@@ -2,6 +2,7 @@\n line 2\n line 3\n line 4\n+new\n line 5\n line 6\n line 7\n"),
        2: ("s_2_b.py.patch", "--- a/b.py\n+++ b/b.py\n@@ -1 +1,2 @@\n-one\n+two\n+three\n"),
        6: ("s_6_b.py.patch", ""),
        10: ("s_10_a.py.patch", "--- a/d/a.py\n+++ b/d/a.py\n@@ -9,4 +9,4 @@\n line 9\n line 10\n line 11\n-line 12\n+last\n"),
    }


# ---- edited files -----------------------------------------------------------------------


def plain_splice(content, edits, parsed):
    lines, low, out = content.splitlines(keepends=True), 10**9, {}
    n = len(lines)
    for s, e, code, o in sorted(edits, key=lambda x: (-x[0], x[3])):
        if not 1 <= s <= e <= n:
            out[o] = "out of bounds"
            continue
        if e >= low:
            out[o] = "overlaps another edit"
            continue
        new = lines[: s - 1] + [code if code.endswith("\n") else code + "\n"] + lines[e:]
        if parsed:
            try:
                ast.parse("".join(new))
            except (SyntaxError, ValueError):
                out[o] = "syntax error after the fix"
                continue
        lines, low, out[o] = new, s, None
        # Lines put in don't move those above.
    return "".join(lines), out


def test_splice_equals_plain_model(spark):
    rng, rows, edits = random.Random(5), [], []
    for i in range(60):
        body = [rng.choice(["x = 1", "def f():", "    return 2", "if a:", "    pass", "y = (1,", "  2)"]) for _ in range(rng.randint(0, 12))]
        rows.append((f"f{i}.{'py' if i % 2 else 'js'}", rng.choice(["\n", "\r\n"]).join(body) + rng.choice(["", "\n"])))
        for o in range(rng.randint(0, 9)):
            s = rng.randint(-1, 13)
            edits.append((rows[-1][0], s, s + rng.randint(-1, 3), rng.choice(["z = 3", "z = 3\n", "    pass\n", "a\nb", ""]), o))
    rows.append(("empty.py", None))
    edits += [("empty.py", 1, 1, "x", 0), ("gone.py", 1, 1, "x", 0)]
    got = {r.path: (r.content, {d.ord: d.reason for d in r.decided}) for r in fixes.spliced(spark.createDataFrame(edits, "affected_file string, start int, end int, code string, ord int"), spark.createDataFrame(rows, "path string, content string")).collect()}
    for path, content in rows:
        mine = [(s, e, c, o) for f, s, e, c, o in edits if f == path]
        if mine:
            assert got.pop(path) == plain_splice(content or "", mine, path.endswith(".py")), path
    assert got == {}


def test_many_edits_of_one_file():
    n = 30_000
    text, decided = fixes.splice("a\n" * n, [(i, i, f"b{i}", i) for i in range(1, n + 1)], False)
    assert text == "".join(f"b{i}\n" for i in range(1, n + 1)) and all(d["reason"] is None for d in decided)


# ---- metrics -----------------------------------------------------------------------------


def test_metrics_of_a_running_query(spark):
    df = spark.createDataFrame([("Critical", 0.004), ("Critical", 3.0), ("odd", None), (None, 99.0)], "severity string, s double")
    df, seen = metrics.observed(df, "t", metrics.series("findings_total", [F.col("severity")]), metrics.series("secrets_found_total", value=F.col("s"), when=F.col("severity") == "Critical"), metrics.series("scanner_duration_seconds", [F.lit("semgrep")], F.col("s")))
    assert df.filter("severity = 'Critical'").count() == 2  # the rows come on as they were; all of them are counted
    rows = {r[:3]: r[3] for r in metrics.samples(seen)}
    assert rows["findings_total", 'severity="Critical"', ""] == 2 and rows["findings_total", 'severity="other"', ""] == 2
    assert rows["secrets_found_total", "", ""] == 3.004
    assert rows["scanner_duration_seconds_count", 'tool="semgrep"', ""] == 3 and rows["scanner_duration_seconds_bucket", 'tool="semgrep"', "5.0"] == 2
    text = metrics.exposition(metrics.samples(seen))
    assert '# TYPE findings_total counter\nfindings_total{severity="Critical"} 2\nfindings_total{severity="other"} 2\n' in text
    assert 'scanner_duration_seconds_bucket{tool="semgrep",le="+Inf"} 3\nscanner_duration_seconds_count{tool="semgrep"} 3\n' in text
    assert len(metrics.COLLECTORS) == 11 and text.count("# TYPE") == 11


# ---- reports -----------------------------------------------------------------------------


def test_splice_parses_what_changes(monkeypatch):
    """Whole statements are parsed on their own, with the outcome of parsing the text after each edit."""
    rng, whole = random.Random(8), fixes.is_python
    blocks = ["a = 1\n", "b = (1,\n  2)\n", "@dec\ndef f():\n    return 1\n", "if a:\n    b = 2\nelse:\n    c = 3\n", "x = 1; y = 2\n", "# note\n", "\n", "s = \"\"\"\n t\n\"\"\"\n", "z = 1 + \\\n  2\n"]
    codes = ["n = 1", "n = (", "  n = 1", "else:\n    n = 1", "if a:\n    n = 1", "# n", "", "\"\"\"", "@dec", "n = 1; m = 2", "n = 1 \\", "return 1", ")"]
    for k in range(3000):
        content = "".join(rng.choice(blocks[: 8 + k % 2]) for _ in range(rng.randint(1, 8)))
        m = len(content.splitlines())
        edits = [(a, min(m, a + rng.choice([0, 0, 1, 2])), rng.choice(codes), o) for o in range(6) for a in [rng.randint(1, m + 1)]]
        text, decided = fixes.splice(content, edits, True)
        assert (text, {d["ord"]: d["reason"] for d in decided}) == plain_splice(content, edits, True), (content, edits)
    read = []
    monkeypatch.setattr(fixes, "is_python", lambda text: read.append(len(text)) or whole(text))
    fixes.splice("a = 1\n" * 5000, [(i, i, "b = 2", i) for i in range(1, 5001)], True)
    assert sum(read) == 5000 * len("b = 2\n")


def test_markdown_report(spark):
    f = "scan_id string, ord int, vulnerability_id string, severity string, confidence string, verification_status string, affected_file string, affected_lines string, owasp_reference string, patch_file_path string, consensus_score int, sources array<string>, description string, exploit_scenario string, suggested_fix string, context_summary string"
    found = [
        ("s1", 2, "mine", "Low", "High", "verified", "a.py", None, None, None, 0, None, None, None, None, None),
        ("s1", 1, "SQLI", "Critical", "High", "conflicting", "x|y.py", "3", "r\nq", "p.patch", 1, ["semgrep"], "d", "e", "fix", "seen from main"),
    ]
    s = "scan_id string, repo_url string, timestamp string, scan_type string, scan_target string, triggered_by string, partial_scan boolean, unscanned_files array<string>, gate_decision string"
    scans = [("s1", "r", "t", "deployment_gate", "full", "me", False, None, "advisory"), ("s2", None, None, "local", "full", "me", True, [], None)]
    got = {r.scan_id: r.report for r in markdown.reports(spark.createDataFrame(scans, s), spark.createDataFrame(found, f)).collect()}
    one = got["s1"].split("\n\n")
    assert one[0] == "# Security Scan Report" and one[1].startswith("## Scan metadata\n- **Scan ID**: `s1`\n- **Repository**: r\n")
    assert one[2] == "## Warnings" and one[3].startswith("⚠️ **CONFLICTING FINDINGS** — 1 Critical") and one[4] == "## Gate decision: `ADVISORY`" and one[5] == "## Findings (2)"
    assert one[6].split("\n")[2:] == ["| SQLI (SQL Injection) | Critical | High | conflicting | x\\|y.py | 3 | r q |", "| mine | Low | High | verified | a.py | — |  |"]
    assert "### SQLI (SQL Injection) — Critical (confidence: High, verification: conflicting)\n\n- **Location**: `x|y.py:3`\n- **OWASP reference**: r\nq\n- **Patch file**: `p.patch`\n- **Detected by**: semgrep (1 voter)\n\n**Description**\n\nd\n\n**Exploit scenario**\n\ne\n\n**Suggested fix**\n\nfix\n**Cross-file context**\n\n```\nseen from main\n```\n\n\n---\n\n### mine — Low" in got["s1"]
    assert got["s1"].endswith("---\n\n*Findings: 2*\n")
    assert "following files were not analysed: _(none listed)_" in got["s2"] and "NO FINDINGS DETECTED" in got["s2"] and "## Findings" not in got["s2"] and "Gate decision" not in got["s2"]


def test_reports_of_null_keys_and_their_plan(spark):
    """Scans without an id meet findings without one; the texts are dealt by key once."""
    text = "vulnerability_id severity confidence verification_status affected_file affected_lines owasp_reference patch_file_path description exploit_scenario suggested_fix context_summary".split()
    found = spark.createDataFrame([(k, o, 1, ["x"], *["a"] * len(text)) for k, o in (("s", 1), ("s", 2), (None, 1))], "scan_id string, ord int, consensus_score int, sources array<string>, " + ", ".join(f"{c} string" for c in text))
    s = "scan_id string, repo_url string, timestamp string, scan_type string, scan_target string, triggered_by string, partial_scan boolean, unscanned_files array<string>, gate_decision string"
    scans = spark.createDataFrame([(k, "r", "t", "local", "full", "me", False, None, "pass") for k in ("s", "u", None)], s)
    out = markdown.reports(scans, found)
    assert {r.scan_id: int(r.report.rsplit(": ", 1)[1].rstrip("*\n")) for r in out.collect()} == {"s": 2, "u": 0, None: 1}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "<=>" not in plan
