"""Consensus in dense islands, needles of any length, access rules: against plain models."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.operators import context, findings, history


def plain_first_fit(rows, tolerance):
    ranges, out = [], []
    for lo, hi in rows:
        known = lo is not None and hi is not None
        n = next((i for i, r in enumerate(ranges) if known and r and max(lo, r[0]) <= min(hi, r[1]) + tolerance), len(ranges))
        if n == len(ranges):
            ranges.append([lo, hi] if known else None)
        else:
            ranges[n] = [min(lo, ranges[n][0]), max(hi, ranges[n][1])]
        out.append(n)
    return out


def fitted(rows, tolerance):
    b = pa.RecordBatch.from_arrays([pa.array(["f"] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["k", "line_start", "line_end"])
    return [n for out in findings._first_fit([b], ["k"], tolerance) for n in out.column("cluster").to_pylist()]


@pytest.mark.parametrize("seed", range(12))
def test_first_fit_equals_plain_fold(seed):
    rng = random.Random(seed)
    span = rng.choice([20, 200, 3000])
    rows = [(a, a + rng.choice([0, 1, 3, 40, -2])) for a in (rng.randint(-5, span) for _ in range(400))] + [(None, 3), (4, None), (None, None)] * 3
    rng.shuffle(rows)
    for tolerance in (0, 2, 5):
        assert fitted(rows, tolerance) == plain_first_fit(rows, tolerance)


def test_dense_island_in_good_time():
    rng = random.Random(1)
    rows = [(a, a) for a in (4 * rng.randrange(60_000) for _ in range(120_000))]
    began = time.time()
    got = fitted(rows, 2)
    assert len(set(got)) == len({a for a, _ in rows}) and time.time() - began < 120


@pytest.mark.parametrize("pass_chars", [2_000_000, 25])
def test_contained_passages(spark, pass_chars):
    rng = random.Random(pass_chars)
    words = ["ab", "Abc", "b", "cab", "é", "İx", "a b", "|"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) if i % 9 else None) for i in range(80)]
    needles = [(i, " ".join(rng.choice(words) for _ in range(1 + i % 6))) for i in range(30)] + [(100, ""), (101, None), (102, "ab"), (103, "ab"), (104, "x" * 60)]
    n, t = spark.createDataFrame(needles, "item_id int, needle string"), spark.createDataFrame(texts, "doc_id int, text string")
    out = context.contained_passages(n, t, "item_id", "needle", "doc_id", "text", pass_chars)
    assert not any(x in out._jdf.queryExecution().toString() for x in ("NestedLoop", "CartesianProduct"))
    got = sorted(tuple(r) for r in out.collect())
    low = {r.i: r.low for r in spark.createDataFrame([(("n", i), s) for i, s in needles] + [(("t", i), s) for i, s in texts], "i struct<k:string,n:int>, s string").select("i", F.lower("s").alias("low")).collect()}
    low = {(k.k, k.n): v for k, v in low.items()}
    assert got == sorted((i, j) for i, _ in needles for j, _ in texts if low["n", i] and low["t", j] is not None and low["n", i] in low["t", j])
    assert context.contained_passages(n.limit(0), t, "item_id", "needle", "doc_id", "text").collect() == []


def test_roles_stand_in_for_admin_access_alone(spark):
    users = spark.createDataFrame([("a", "admin"), ("u", "user"), ("v", "user"), ("p", "user")], "user_id string, role string")
    members = spark.createDataFrame([("u", 1), ("v", 2), (None, 1)], "user_id string, group_id int")
    grants = spark.createDataFrame([(1, "view_reports"), (2, "admin_access"), (2, "view_reports")], "group_id int, permission string")
    of = lambda p, **kw: sorted(r.user_id for r in history.permitted(users, members, grants, p, **kw).collect())
    assert of("view_reports") == ["u", "v"] and of("admin_access") == ["a", "v"] and of("none") == []
    assert of("view_reports", protected=["p", "u"]) == ["p", "u", "v"]


def test_claim_ladder(spark):
    good = ("k", True, 1000, None, "own/ci", None, "r")
    rows = [
        (good, None),
        ((None, *good[1:]), "key"),
        (("x", *good[1:]), "key"),
        (("k", None, *good[2:]), "claims"),
        (("k", False, 0, None, "", "", ""), "claims"),
        (("k", True, 970, *good[3:]), "expired"),
        (("k", True, 971, *good[3:]), None),
        (("k", True, None, *good[3:]), "expired"),
        (("k", True, 1000, 1030, *good[4:]), None),
        (("k", True, 1000, 1031, *good[4:]), "not_yet"),
        (("k", True, 1000, None, "", "own/ci/x", "r"), None),
        (("k", True, 1000, None, "bad", "own/ci/x", "r"), "not_allowed"),
        (("k", True, 1000, None, None, None, ""), "not_allowed"),
        (("k", True, 1000, None, "own/ci", None, ""), "repository"),
        (("k", True, 1000, None, "own/ci", None, None), "repository"),
    ]
    df = spark.createDataFrame([(i, *r[0]) for i, r in enumerate(rows)], "i int, kid string, verified boolean, exp long, nbf long, job_workflow_ref string, workflow_ref string, repository string")
    got = {r.i: r.reason for r in history.identity_outcome(df, ["k"], ["own/"], F.timestamp_seconds(F.lit(1000))).collect()}
    assert [got[i] for i in range(len(rows))] == [r[1] for r in rows]
    off = {r.i: r.reason for r in history.identity_outcome(df, ["k"], [], F.timestamp_seconds(F.lit(1000))).collect()}
    assert off[11] is None and off[12] == "repository"


def test_truth_matches(spark):
    rng = random.Random(2)
    cols = "file string, vuln_class string, line_start long, line_end long, n int"
    make = lambda k, wide: [(rng.choice("ab"), rng.choice("xy"), s, s + rng.choice([0, 1, 5, wide]), i) for i, s in enumerate(rng.randint(1, 3000) for _ in range(k))]
    truth, found = make(150, 2000), make(60, 70)
    truth += truth[:3] + [("a", "x", None, None, 900), ("a", "x", 5, None, 901)]
    got = sorted(r.n for r in findings.truth_matches(spark.createDataFrame(truth, cols), spark.createDataFrame(found + [("a", "x", None, 3, 1)], cols)).collect())
    want = sorted(n for f, c, a, b, n in truth if b is not None and a is not None and any(f == g and c == d and max(a, x) <= min(b, y) + 3 for g, d, x, y, _ in found))
    assert got == want and 0 < len(got) < len(truth)


def test_account_changes(spark):
    users = spark.createDataFrame([("a", "user", True, None), ("b", "admin", False, None), ("p", "admin", True, None)], "email string, role string, is_active boolean, reactivated_at timestamp")
    asked = [(1, "a", "b", "promote"), (2, "a", "b", "deactivate"), (3, "b", "b", "demote"), (4, "b", "a", "reactivate"), (5, "p", "b", "deactivate"), (6, "x", "b", "promote"), (7, "a", "b", "demote"), (8, "a", "b", "rename"), (9, "p", "p", "demote"), (10, "b", "a", "deactivate"), (11, "b", "a", "reactivate")]
    df = spark.createDataFrame(asked, "request_id int, email string, actor string, action string").withColumn("at", F.timestamp_seconds("request_id"))
    after, told = history.change_accounts(users, df, ["p"])
    assert {r.email: (r.role, r.is_active, r.reactivated_at and int(r.reactivated_at.timestamp())) for r in after.collect()} == {"a": ("user", False, None), "b": ("admin", True, 11), "p": ("admin", True, None)}
    assert [r.outcome for r in told.orderBy("request_id").collect()] == ["user_promoted", "user_deactivated", "own_role", "user_reactivated", "protected", "not_found", "user_demoted", "unknown", "own_role", "user_deactivated", "user_reactivated"]


def test_log_lines_and_alerts(spark):
    from sightline.functions import text

    df = spark.createDataFrame([(1, "s", {"code": "x", "Code": "y", "msg": "z", "_in": "n", "level": "mine", "none": None}), (2, None, None)], "n int, scan string, fields map<string,string>")
    got = [r[0] for r in df.orderBy("n").select(text.log_line(F.lit("t"), F.lit("INFO"), F.lit("m"), F.col("scan"), F.col("fields"))).collect()]
    assert got == ['{"timestamp":"t","message":"m","scan_id":"s","Code":"y","code":"[REDACTED]","ctx_msg":"z","level":"mine","none":null}', '{"timestamp":"t","level":"INFO","message":"m"}']
    rows = [("all", "p", True), ("dev_only", "p", False), ("dev_only", "a", True), ("dev_only", None, True), ("none", "a", False)]
    assert all(r[0] == r[1] for r in spark.createDataFrame(rows, "mode string, repo string, want boolean").select(text.alerts(F.col("mode"), F.col("repo"), "p"), "want").collect())


def test_packs_and_second_pass(spark):
    packs = spark.createDataFrame([("a", True, True), ("b", False, True), ("c", False, False)], "name string, required boolean, present boolean")
    of = lambda df, which: sorted(r.name for r in findings.chosen_packs(df, which).collect())
    assert of(packs, None) == ["a", "b"] and of(packs, ["b", "c"]) == ["b"] and of(packs, []) == []
    assert of(packs.withColumn("present", F.col("name") == "b"), None) == [] and of(packs.withColumn("present", F.col("name") == "b"), ["b"]) == ["b"]
    rows = [("Critical", ["claude"], True, True), ("Critical", ["claude"], False, False), ("High", ["claude"], True, False), ("Critical", ["claude", "x"], True, False), ("Critical", None, True, False), ("Critical", ["x"], True, False)]
    df = spark.createDataFrame(rows, "severity string, sources array<string>, gate boolean, want boolean")
    assert all(r[0] == r[1] for r in df.select(findings.wants_second_pass(F.col("severity"), F.col("sources"), F.col("gate")), "want").collect())


@pytest.mark.parametrize("longest", [False, True])
def test_large_rule_tables_are_joined(spark, longest):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abAB") for _ in range(rng.randint(1, 4)))
    rules = spark.createDataFrame([(i, word(), f"c{i}") for i in range(40)], "rule_ord int, key string, vuln_class string")
    raw = spark.createDataFrame([(i, word() + rng.choice(["", " - x"]) if i % 9 else None) for i in range(120)] + [(500, "ZZ q-1")], "n int, raw_rule_id string")
    small = sorted(tuple(r) for r in findings.normalize_rules(raw, rules, longest=longest).collect())
    large = sorted(tuple(r) for r in findings.normalize_rules(raw, rules, longest=longest, max_rules=5).collect())
    assert small == large and (500, "ZZ q-1", "zz_q_1") in small
