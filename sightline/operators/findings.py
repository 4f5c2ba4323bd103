"""Findings: taxonomy, consensus, merge with a second source, verdicts, gate and scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import VERIFIER_RISK_PREFIXES, risky
from ..functions.text import basename, normal_band, overlaps, severity_rank
from .context import contained_passages

# Domains and limits that decide results.
BANDS = {"Critical": "9.0-10.0", "High": "7.0-8.9", "Medium": "4.0-6.9", "Low": "0.1-3.9"}
RAW_VERIFICATIONS = ["verified", "unverified", "conflicting"]
FINDING_ID = r"^(A\d{2}:20\d{2}|LLM\d{2}:20\d{2}|SECRET-001)$"
CONSENSUS_LINES = 2
MERGE_LINES = 5
TRUTH_LINES = 3
VERDICT_BATCH = 5
MAX_RULES = 2000
#: Clusters of an island up to which they are tried one by one.
FEW_CLUSTERS = 16


def normalize_rules(raw: DataFrame, rules: DataFrame, raw_id: str = "raw_rule_id", longest: bool = False, max_rules: int = MAX_RULES) -> DataFrame:
    """``raw`` plus vuln_class: the rule of that very key, else the first (or longest) rule whose key the id contains, else the id cleaned up.

    ``rules`` (key, vuln_class, rule_ord).  A table of at most ``max_rules`` goes into the
    expression as a literal array, so no join is needed; a larger one is joined, by key
    and by what one search of all keys finds in the distinct ids.
    """
    listed = rules.select("rule_ord", "key", "vuln_class").limit(max_rules + 1).collect()
    clean = F.translate(F.lower(raw_id), " -", "__")
    if len(listed) > max_rules:
        return _normalized_by_join(raw, rules, raw_id, longest, clean)
    table = sorted((r.rule_ord, r.key, r.vuln_class) for r in listed)
    first = {k: c for _, k, c in reversed(table)}  # a key that comes twice means its first rule
    exact = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    if longest:
        table.sort(key=lambda r: (-len(r[1]), r[0]))
    contained = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for _, k, c in table])
    hit = F.get(F.filter(contained, lambda r: F.col(raw_id).contains(r["k"])), 0)["c"]
    return raw.withColumn("vuln_class", F.coalesce(F.try_element_at(exact, F.col(raw_id)), hit, clean))


def _normalized_by_join(raw: DataFrame, rules: DataFrame, raw_id: str, longest: bool, clean: Column) -> DataFrame:
    ids = raw.select(F.col(raw_id).alias("__sl_id")).distinct()
    exact = rules.groupBy(F.col("key").alias("__sl_id")).agg(F.min_by("vuln_class", "rule_ord").alias("__sl_exact"))
    # The search ignores case, which these keys don't.
    met = contained_passages(rules.select("rule_ord", "key"), ids.withColumn("__sl_text", F.col("__sl_id")), "rule_ord", "key", "__sl_id", "__sl_text").join(rules, "rule_ord")
    rank = F.struct(-F.length("key"), "rule_ord") if longest else F.struct("rule_ord")
    held = met.filter(F.col("__sl_id").contains(F.col("key"))).groupBy("__sl_id").agg(F.min_by("vuln_class", rank).alias("__sl_held"))
    known = ids.join(exact, "__sl_id", "left").join(held, "__sl_id", "left").withColumnRenamed("__sl_id", "__sl_of")
    out = raw.join(known, F.col(raw_id) == F.col("__sl_of"), "left").withColumn("vuln_class", F.coalesce("__sl_exact", "__sl_held", clean))
    return out.drop("__sl_of", "__sl_exact", "__sl_held")


def consensus(candidates: DataFrame, tolerance: int = CONSENSUS_LINES) -> DataFrame:
    """B1 and A10: clusters of candidates of one file and class, in input order.

    A candidate joins the first cluster whose range so far it overlaps within the
    tolerance; clusters never merge afterwards, so the order (``ord``) matters.  The
    result has the first voter's message and severity, the tools in order of first vote,
    their number and all rule ids.  A group is the candidates of one class in one file.

    Candidates of different islands of lines can't meet, so each island is folded on its
    own: sorted rows stream through a task that holds nothing but the ranges of one
    island's clusters, in a tree that finds a candidate's cluster in logarithmic time.  A candidate without lines is a cluster of its own.
    """
    names = ["file", "vuln_class", "ord", "line_start", "line_end", "tool", "message", "raw_rule_id", "severity_hint"]
    keys = ["file", "vuln_class", "island"]
    placed = numbered_islands(candidates.select(*names), keys[:2], "line_start", "line_end", tolerance)
    # The window has them by file and class already; within that, islands in turn and in them input order.
    ordered = placed.sortWithinPartitions(*keys, *names[2:])
    fold = lambda batches: _first_fit(batches, keys, tolerance)
    numbered = ordered.mapInArrow(fold, T.StructType([*ordered.schema, T.StructField("cluster", T.LongType())]))
    first = F.min(F.struct("ord", "line_start", "line_end", "tool", "message", "raw_rule_id", "severity_hint"))
    votes = F.array_sort(F.collect_list(F.struct("ord", "line_start", "line_end", "tool", "message", "raw_rule_id")))
    one = numbered.groupBy(*keys, "cluster").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), first.alias("f"), votes.alias("v"))
    tools = F.array_distinct(F.transform("v", lambda m: m["tool"]))
    return one.select(
        "file",
        "vuln_class",
        "line_start",
        "line_end",
        F.col("f.message").alias("message"),
        tools.alias("sources"),
        F.size(tools).alias("consensus_score"),
        F.transform("v", lambda m: m["raw_rule_id"]).alias("raw_rule_ids"),
        F.col("f.severity_hint").alias("severity_hint"),
        F.col("f.ord").alias("ord"),
    )


class _Cover:
    """The least number laid over any place of a range, for numbers laid over ranges one by one.

    A segment tree over all integers, kept in two dictionaries: a node (level, place) stands for
    the places [place << level, (place + 1) << level).  Both steps take time in the logarithm of
    the widest range, whatever the number of ranges.
    """

    TOP = 40

    def __init__(self):
        self.laid: dict[tuple[int, int], int] = {}
        self.below: dict[tuple[int, int], int] = {}

    @staticmethod
    def _nodes(lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """The fewest nodes that make up [lo, hi]."""
        level, hi = 0, hi + 1
        while lo < hi:
            if lo & 1:
                yield level, lo
                lo += 1
            if hi & 1:
                hi -= 1
                yield level, hi
            lo, hi, level = lo >> 1, hi >> 1, level + 1

    def lay(self, lo: int, hi: int, n: int) -> None:
        for level, at in self._nodes(lo, hi):
            if self.laid.get((level, at), n) >= n:
                self.laid[level, at] = n
            while self.below.get((level, at), n + 1) > n:
                self.below[level, at] = n
                level, at = level + 1, at >> 1
                if level > self.TOP:
                    break

    def least(self, lo: int, hi: int) -> int | None:
        best = None
        for level, at in self._nodes(lo, hi):
            n = self.below.get((level, at))
            if n is not None and (best is None or n < best):
                best = n
        # What lies over whole nodes above the ends; between them the nodes above are part of the range.
        for at in (lo, hi):
            for level in range(1, self.TOP + 1):
                at >>= 1
                n = self.laid.get((level, at))
                if n is not None and (best is None or n < best):
                    best = n
        return best


def _first_fit(batches: Iterator[pa.RecordBatch], keys: list[str], tolerance: int) -> Iterator[pa.RecordBatch]:
    """The batches with the number of each row's cluster, counted by island; rows of an island come one after another."""
    at, ranges, cover = None, [], None
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in (*keys, "line_start", "line_end"))
        for *key, lo, hi in zip(*columns):
            if key != at:
                at, ranges, cover = key, [], None
            n, known = None, lo is not None and hi is not None
            if known:
                # A range and a cluster meet where the range meets the cluster widened by the tolerance.
                n = cover.least(lo, hi) if lo <= hi and cover else next((i for i, r in enumerate(ranges) if r and max(lo, r[0]) <= min(hi, r[1]) + tolerance), None)
            if n is None:
                n = len(ranges)
                ranges.append([lo, hi] if known else None)
                grown = known
            else:
                grown = lo < ranges[n][0] or hi > ranges[n][1]
                ranges[n] = [min(lo, ranges[n][0]), max(hi, ranges[n][1])]
            if cover is None and len(ranges) > FEW_CLUSTERS:
                cover = _Cover()
                for i, r in enumerate(ranges):
                    if r:
                        cover.lay(r[0] - tolerance, r[1] + tolerance, i)
            elif grown and cover:
                cover.lay(ranges[n][0] - tolerance, ranges[n][1] + tolerance, n)
            out.append(n)
        yield batch.append_column("cluster", pa.array(out, pa.int64()))


def numbered_islands(rows: DataFrame, keys: list[str], start: str, end: str, tolerance: int) -> DataFrame:
    """Rows with island: a new one where a range begins beyond the reach of all before it in line order."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("__sl_new", (F.coalesce(F.col(start) > reach + tolerance, F.lit(True))).cast("int"))
    return marked.withColumn("island", F.sum("__sl_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("__sl_new")


def islands(rows: DataFrame, keys: list[str], start: str, end: str, tolerance: int) -> DataFrame:
    """B1 for input in line order, where it is gaps and islands: keys, island, lo, hi, n.

    Runs in a window, so a key may have any number of rows.
    """
    numbered = numbered_islands(rows, keys, start, end, tolerance)
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias("lo"), F.max(end).alias("hi"), F.count(F.lit(1)).alias("n"))


#: Cells of lines in which ranges meet: the narrowest width, the factor from level to level, the number of levels.
CELL_LINES, CELL_FACTOR, CELL_LEVELS = 64, 32, 4


def _in_cells(rows: DataFrame, lo: Column, hi: Column, own: str, other: str) -> DataFrame:
    """Rows by level, cell and side: a range in the cells of its own level (the first whose cells are no shorter than it), and in those of that and all coarser ones for the other side.

    Two ranges that meet share a cell at the coarser one's level, and short ranges never
    meet others just because a cell is large.  A range has two cells a level at most (but
    beyond the coarsest level, whose cells have two million lines).
    """
    level = F.lit(CELL_LEVELS - 1)
    for k in reversed(range(CELL_LEVELS - 1)):
        level = F.when(hi - lo + 1 <= CELL_LINES * CELL_FACTOR**k, F.lit(k)).otherwise(level)
    width = F.get(F.array(*[F.lit(CELL_LINES * CELL_FACTOR**k).cast("long") for k in range(CELL_LEVELS)]), F.col("level"))
    out = rows.withColumns({"__sl_lo": lo.cast("long"), "__sl_hi": hi.cast("long"), "__sl_own": level})
    out = out.withColumn("level", F.explode(F.sequence("__sl_own", F.lit(CELL_LEVELS - 1))))
    out = out.withColumn("cell", F.explode(F.sequence(F.floor(F.col("__sl_lo") / width), F.floor(F.col("__sl_hi") / width))))
    sides = F.when(F.col("level") == F.col("__sl_own"), F.array(F.lit(own), F.lit(other))).otherwise(F.array(F.lit(other)))
    return out.withColumn("side", F.explode(sides)).drop("__sl_lo", "__sl_hi", "__sl_own")


def merge_sources(left: DataFrame, right: DataFrame, tolerance: int = MERGE_LINES) -> DataFrame:
    """Every left finding with its first overlapping right candidate, then the right ones that none took.

    left: left_ord, file, classes (ordered array), line_start, line_end.
    right: right_ord, file, vuln_class, line_start, line_end.
    A start of 0 is an unknown line and matches nothing.  Result: kind (merged, left_only,
    right_only), left_ord, right_ord, file, vuln_class, line_start, line_end.  A right
    candidate may serve many left findings.
    """
    probes = left.select("left_ord", "file", F.col("line_start").alias("l0"), F.col("line_end").alias("l1"), F.posexplode("classes").alias("pos", "vuln_class")).filter("l0 <> 0")
    cand = right.filter("line_start <> 0").select("right_ord", "file", "vuln_class", F.col("line_start").alias("r0"), F.col("line_end").alias("r1"))
    near = overlaps(F.col("l0"), F.col("l1"), F.col("r0"), F.col("r1"), tolerance)
    # Ranges meet in cells of lines, so a file with very many findings is no single group.
    mine = _in_cells(probes, F.least("l0", "l1") - tolerance, F.greatest("l0", "l1") + tolerance, "l", "r")
    theirs = _in_cells(cand, F.least("r0", "r1"), F.greatest("r0", "r1"), "r", "l")
    met = mine.join(theirs, ["file", "vuln_class", "level", "cell", "side"])
    # The best match of a left row is an aggregate, combined before and after the shuffle.
    best = met.filter(near).groupBy("left_ord").agg(F.min(F.struct("pos", "right_ord", "vuln_class", "r0", "r1")).alias("m"))
    joined = left.join(best, "left_ord", "left")
    hit = F.col("m").isNotNull()
    first = joined.select(
        F.when(hit, "merged").otherwise("left_only").alias("kind"),
        "left_ord",
        F.col("m.right_ord").alias("right_ord"),
        "file",
        F.coalesce(F.col("m.vuln_class"), F.get("classes", 0)).alias("vuln_class"),
        F.when(hit, F.least("line_start", "m.r0")).otherwise(F.col("line_start")).alias("line_start"),
        F.when(hit, F.greatest("line_end", "m.r1")).otherwise(F.col("line_end")).alias("line_end"),
    )
    taken = best.select(F.col("m.right_ord").alias("right_ord")).distinct()
    rest = right.join(taken, "right_ord", "left_anti").select(F.lit("right_only").alias("kind"), F.lit(None).cast(left.schema["left_ord"].dataType).alias("left_ord"), "right_ord", "file", "vuln_class", "line_start", "line_end")
    return first.unionByName(rest)


def truth_matches(truth: DataFrame, findings: DataFrame, tolerance: int = TRUTH_LINES) -> DataFrame:
    """The truth rows with a finding of their file and class within some lines; rows that are repeated stay repeated.

    Ranges meet in cells of lines, as those of two sources do, so a file with very many of
    either is no single group.  Rows without lines match nothing.
    """
    t = truth.filter("line_start IS NOT NULL AND line_end IS NOT NULL").select("file", "vuln_class", F.col("line_start").alias("t0"), F.col("line_end").alias("t1")).distinct()
    f = findings.filter("line_start IS NOT NULL AND line_end IS NOT NULL").select("file", "vuln_class", F.col("line_start").alias("f0"), F.col("line_end").alias("f1"))
    mine = _in_cells(t, F.least("t0", "t1") - tolerance, F.greatest("t0", "t1") + tolerance, "t", "f")
    theirs = _in_cells(f, F.least("f0", "f1"), F.greatest("f0", "f1"), "f", "t")
    met = mine.join(theirs, ["file", "vuln_class", "level", "cell", "side"]).filter(overlaps(F.col("t0"), F.col("t1"), F.col("f0"), F.col("f1"), tolerance))
    hit = met.select("file", "vuln_class", F.col("t0").alias("line_start"), F.col("t1").alias("line_end")).distinct()
    return truth.join(hit, ["file", "vuln_class", "line_start", "line_end"], "left_semi").select(*truth.columns)


def reject_reason(finding: dict[str, Column] | None = None) -> Column:
    """F8: the first rule that a raw finding breaks, null if none: severity, band, id, status, scenario."""
    c = finding or {x: F.col(x) for x in ("severity", "cvss_band", "vulnerability_id", "verification_status", "exploit_scenario", "affected_file")}
    severity_ok = F.coalesce(c["severity"].isin(list(BANDS)), F.lit(False))
    bands = F.create_map(*[F.lit(x) for kv in BANDS.items() for x in kv])
    band_ok = F.coalesce(normal_band(c["cvss_band"]) == F.try_element_at(bands, c["severity"]), F.lit(False))
    id_ok = F.coalesce(c["vulnerability_id"].rlike(FINDING_ID), F.lit(False))
    status_ok = F.coalesce(c["verification_status"], F.lit("unverified")).isin(RAW_VERIFICATIONS)
    return (
        F.when(~severity_ok, "severity")
        .when(~band_ok, "cvss_band")
        .when(~id_ok, "vulnerability_id")
        .when(~status_ok, "verification_status")
        .when(~well_formed(c["exploit_scenario"], c["affected_file"]), "exploit_scenario")
    )


#: Words of which a scenario names one.
SCENARIO_WORDS = ["payload", "request", "query", "parameter", "injection", "bypass", "forge"]


def well_formed(scenario: Column, path: Column) -> Column:
    """not blank, names the path or its base name, and has one of the words."""
    named = scenario.contains(path) | ((basename(path) != "") & scenario.contains(basename(path)))
    worded = reduce(or_, [F.lower(scenario).contains(w) for w in SCENARIO_WORDS])
    return F.coalesce((F.trim(scenario) != "") & (path != "") & named & worded, F.lit(False))


def blocks(severity: Column, confidence: Column, status: Column) -> Column:
    """High at high confidence blocks; Critical also has to be verified; auto-triaged never does."""
    return (status != "advisory_real") & (confidence == "High") & ((severity == "High") | ((severity == "Critical") & (status == "verified")))


def advisory(severity: Column, confidence: Column, status: Column) -> Column:
    """what looks like a blocker and isn't one."""
    top = severity.isin("Critical", "High")
    return (status == "advisory_real") | (top & confidence.isin("Medium", "Low")) | ((severity == "Critical") & (status == "conflicting"))


def route_verdicts(candidates: DataFrame, verdicts: DataFrame, keep: list[str], advise: list[str]) -> DataFrame:
    """V3: candidates (candidate_ord, file, ...) plus route: verified, advisory_real, unverified or dropped.

    verdicts: candidate_ord, verdict (real, false_positive), confidence.  Without a verdict a
    candidate stays unverified; risky paths keep medium confidence too; a missing confidence is low.
    """
    v = verdicts.select("candidate_ord", F.lower("verdict").alias("__v"), F.coalesce(F.lower("confidence"), F.lit("low")).alias("__c"))
    j = candidates.join(v, "candidate_ord", "left")
    kept = F.col("__c").isin(keep) | ((F.col("__c") == "medium") & risky(F.col("file"), VERIFIER_RISK_PREFIXES))
    route = F.when(F.col("__v").isNull(), "unverified").when(F.col("__v") == "false_positive", "dropped").when(kept, "verified").when(F.col("__c").isin(advise), "advisory_real").otherwise("dropped")
    return j.withColumn("route", route).drop("__v", "__c")


def blind_pass(answer: Column) -> Column:
    """V6: yes confirms; no, uncertain, errors and silence conflict."""
    return F.when(F.lower(F.trim(answer)).startswith("yes"), "verified").otherwise("conflicting")


def wants_second_pass(severity: Column, sources: Column, gate: Column, model: str = "claude") -> Column:
    """V6: whether a finding gets the blind second pass: Critical, from the model alone, on the gate's path."""
    return F.coalesce(gate & (severity == "Critical") & (F.size(sources) == 1) & (F.get(sources, 0) == model), F.lit(False))


def chosen_packs(packs: DataFrame, chosen: list[str] | None) -> DataFrame:
    """Packs (name, required, present) that a run uses: all for None, a subset for a list, none for an empty one.

    If a required one of them isn't there no pack is used; others that aren't there are left out.
    """
    wanted = packs if chosen is None else packs.filter(F.col("name").isin(list(chosen)))
    lacking = wanted.filter("required AND NOT present").limit(1).select(F.lit(1).alias("__sl_lacking"))
    return wanted.filter("present").join(lacking, F.lit(True), "left_anti")


def parse_verdicts(replies: DataFrame, text: str = "reply", size: int = VERDICT_BATCH) -> DataFrame:
    """V2: (reply's columns, candidate, verdict, confidence, reason) from lines ``VERDICT #n: x``, ``CONFIDENCE #n: y``, ``REASON #n: z``.

    The mark before the number may be missing and text may follow the word.  Verdicts are
    real and false_positive; numbers count from 1 to ``size``, others are passed over; the
    last of duplicates wins.  Without a known confidence it is low, without a reason the
    reason is empty; reasons are cut at 240 characters.
    """

    def pairs(name: str, value: str) -> Column:
        pattern = F.lit(rf"(?im)^\s*{name}\s*#?\s*(\d+)\s*:\s*({value})")
        found = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("v"))
        found = F.filter(F.transform(found, lambda x: F.struct(x["n"].try_cast("int").alias("n"), x["v"].alias("v"))), lambda x: x["n"].between(1, size))
        return F.aggregate(found, F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>")), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["n"]), F.create_map(x["n"], x["v"])))

    out = replies.withColumns({"__v": pairs("VERDICT", r"real\b|false_positive\b"), "__c": pairs("CONFIDENCE", r"high\b|medium\b|low\b"), "__r": pairs("REASON", ".+")})
    out = out.withColumn("candidate", F.explode(F.map_keys("__v")))
    at = lambda m: F.try_element_at(F.col(m), F.col("candidate"))
    reason = F.coalesce(F.substring(F.regexp_replace(at("__r"), r"^\s+|\s+$", ""), 1, 240), F.lit(""))
    return out.withColumns({"verdict": F.lower(at("__v")), "confidence": F.coalesce(F.lower(at("__c")), F.lit("low")), "reason": reason}).drop("__v", "__c", "__r")


def verdict_batches(candidates: DataFrame, keys: list[str], by: str = "vuln_class", order: str = "ord", size: int = VERDICT_BATCH) -> DataFrame:
    """V1: candidates plus batch and homogeneous: sorted by class, cut by fives whatever the class.

    ``keys`` name a scan; batches are numbered within it.
    """
    w = W.partitionBy(*keys).orderBy(by, order)
    out = candidates.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
    one = W.partitionBy(*keys, "batch")
    return out.withColumn("homogeneous", F.min(by).over(one) == F.max(by).over(one))


def promotions(reply: Column, n: Column) -> Column:
    """V7: the in-range numbers of a line ``PROMOTES: 1, 3``; none for fewer than two findings."""
    listed = F.regexp_extract(reply, r"(?im)^\s*PROMOTES\s*:\s*([\d,\s]+)$", 1)
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(listed, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int")))
    return F.when(n >= 2, F.filter(numbers, lambda x: (x >= 1) & (x <= n))).otherwise(F.array().cast("array<int>"))


def risk_points(severity: Column, verified: Column) -> Column:
    """A14's weights."""
    return F.when(severity == "Critical", F.when(verified, 18).otherwise(12)).when(severity == "High", F.when(verified, 8).otherwise(5)).when(severity == "Medium", F.when(verified, 3).otherwise(2)).otherwise(1)


def risk_label(score: Column) -> Column:
    """A15."""
    return F.when(score >= 81, "Critical Risk").when(score >= 51, "High Risk").when(score >= 21, "Medium Risk").otherwise("Low Risk")


def remediation_complexity(critical: Column, high: Column) -> Column:
    """A16, from the numbers of verified Critical and High findings."""
    return F.when(critical >= 3, "Critical").when((critical >= 1) | (high >= 3), "High").when(high >= 1, "Medium").otherwise("Low")


def scan_summary(findings: DataFrame, keys: list[str]) -> DataFrame:
    """A9, A14-A16, A18, A26, A29 in one pass: counts by severity, score, label, decision and warnings by scan.

    findings: severity, confidence, verification_status and, if there is one, a boolean
    partial that tells of a scan that was cut short.
    """
    s, c, v = F.col("severity"), F.col("confidence"), F.col("verification_status")
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    out = findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[n(s == x).alias(x.lower()) for x in BANDS],
        F.least(F.lit(100), F.sum(risk_points(s, v == "verified"))).cast("long").alias("score"),
        n((s == "Critical") & (v == "verified")).alias("critical_verified"),
        n((s == "High") & (v == "verified")).alias("high_verified"),
        n(blocks(s, c, v)).alias("blocking"),
        n(advisory(s, c, v)).alias("advisory"),
        n(v == "conflicting").alias("conflicting"),
        n(v == "advisory_real").alias("triaged"),
        n(s.isin("Critical", "High") & c.isin("Medium", "Low")).alias("demoted"),
        *([F.coalesce(F.bool_or("partial"), F.lit(False)).alias("__partial")] if "partial" in findings.columns else []),
    )
    cut = "partial" in findings.columns
    warnings = F.array_compact(F.array(F.when(F.col("__partial"), F.lit("partial")) if cut else F.lit(None).cast("string"), F.when(F.col("conflicting") > 0, F.lit("conflicting")), F.when(F.col("demoted") > 0, F.lit("demoted")), F.when(F.col("triaged") > 0, F.lit("auto_triaged"))))
    return out.withColumns(
        {
            "label": risk_label(F.col("score")),
            "complexity": remediation_complexity(F.col("critical_verified"), F.col("high_verified")),
            "decision": F.when(F.col("blocking") > 0, "block").when(F.col("n") > 0, "advisory").otherwise("pass"),
            "warnings": F.array_join(warnings, ","),
            "exit_status": (F.col("critical") + F.col("high") > 0).cast("int"),
        }
    ).drop("__partial")


def top_types(findings: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    """The most common ids among Critical and High, ties by first sight."""
    counts = findings.filter(F.col("severity").isin("Critical", "High")).groupBy(*keys, "vulnerability_id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    w = W.partitionBy(*keys).orderBy(F.desc("n"), "first", "vulnerability_id")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_actions(findings: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The first distinct actions by severity, then verified, then order."""
    rank = F.struct(severity_rank(F.col("severity")).alias("s"), (F.col("verification_status") != "verified").alias("u"), F.col("ord").alias("o"))
    best = findings.groupBy(*keys, "action").agg(F.min(rank).alias("r"))
    w = W.partitionBy(*keys).orderBy("r", "action")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("r")


def regression(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with state fixed, remaining or introduced."""
    b, a = before.select(*keys).distinct(), after.select(*keys).distinct()
    named = lambda x, s: x.withColumn("state", F.lit(s))
    return named(b.subtract(a), "fixed").unionByName(named(b.intersect(a), "remaining")).unionByName(named(a.subtract(b), "introduced"))


def bypass(critical: Column, justification: Column) -> Column:
    """a Critical without a justification is not bypassed."""
    return F.when((critical > 0) & (F.trim(F.coalesce(justification, F.lit(""))) == ""), "rejected").otherwise("bypassed")
