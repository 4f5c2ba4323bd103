"""Eleven collectors, gathered by the queries that run anyway.

A collector is a set of aggregate expressions with fixed labels.  ``observed`` attaches them
to a DataFrame as an ``Observation``: whatever action runs the query also fills them, and no
row is read twice.  A label outside its known values counts as ``other``, so the number of
series is bounded and totals stay whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

OTHER = "other"


@dataclass(frozen=True)
class Collector:
    """A counter, or a histogram if it has bounds; ``labels`` name each label's known values."""

    name: str
    help: str
    labels: tuple[tuple[str, tuple[str, ...]], ...] = ()
    bounds: tuple[float, ...] = ()


# Names, labels and bounds of the collectors.
_SECONDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
_TOOLS = ("bandit", "gitleaks", "opengrep", "semgrep")
COLLECTORS = {
    c.name: c
    for c in [
        Collector("scan_requests_total", "Scan requests.", (("scan_type", ("deployment_gate", "local", "pull_request", "scheduled")), ("gate_decision", ("pass", "advisory", "block", "error")))),
        Collector("scan_duration_seconds", "Seconds of a scan.", (("scan_type", ("deployment_gate", "local", "pull_request", "scheduled")),), _SECONDS),
        Collector("claude_api_calls_total", "Calls of the model.", (("path", ("generate", "verify")), ("outcome", ("success", "error", "timeout")))),
        Collector("github_api_calls_total", "Calls of the code host.", (("outcome", ("success", "error", "auth_error", "circuit_open")),)),
        Collector("secrets_found_total", "Secrets removed before analysis."),
        Collector("findings_total", "Findings.", (("severity", ("Critical", "High", "Medium", "Low")),)),
        Collector("local_scan_auth_outcomes_total", "Token checks.", (("outcome", ("ok", "unknown_token", "revoked", "bad_signature", "bad_format", "legacy_ok", "legacy_unauthorized")),)),
        Collector("scanner_runs_total", "Runs of tools.", (("tool", _TOOLS), ("outcome", ("success", "timeout", "error", "skipped")))),
        Collector("scanner_duration_seconds", "Seconds of a tool's run.", (("tool", _TOOLS),), _SECONDS),
        Collector("vuln_verifier_calls_total", "Calls of the verifier.", (("outcome", ("real", "false_positive", "unverified", "error")),)),
        Collector("consensus_findings_total", "Candidates by number of voters.", (("voter_count", ("1", "2", "3", "4+")),)),
    ]
}


def voter_label(score: Column) -> Column:
    """1, 2, 3 or 4+."""
    return F.when(score >= 4, "4+").otherwise(score.cast("string"))


def series(name: str, labels: list[Column] = (), value: Column | None = None, when: Column | None = None) -> list[Column]:
    """The expressions of one collector over a DataFrame's rows.

    ``labels`` in the collector's order; a null label is ``other``.  ``value`` is what a counter
    adds (one if not given) or a histogram observes; rows where ``when`` isn't true, and null
    values, count nowhere.
    """
    c = COLLECTORS[name]
    if len(labels) != len(c.labels):
        raise ValueError(f"{name} has {len(c.labels)} labels")
    known = [F.when(x.isin(list(v)), x).otherwise(OTHER) for x, (_, v) in zip(labels, c.labels)]
    out = []
    for combo in product(*[(*v, OTHER) for _, v in c.labels]):
        here = reduce(lambda a, b: a & b, [k == v for k, v in zip(known, combo)], F.lit(True) if when is None else F.coalesce(when, F.lit(False)))
        told = "|".join(combo)
        if c.bounds:
            here = here & value.isNotNull()
            out += [F.count_if(here & (value <= b)).cast("double").alias(f"{name}_bucket|{told}|{b}") for b in c.bounds]
            out += [F.count_if(here).cast("double").alias(f"{name}_count|{told}"), F.coalesce(F.sum(F.when(here, value)), F.lit(0)).cast("double").alias(f"{name}_sum|{told}")]
        else:
            added = F.count_if(here) if value is None else F.coalesce(F.sum(F.when(here, value)), F.lit(0))
            out.append(added.cast("double").alias(f"{name}|{told}"))
    return out


def observed(df: DataFrame, name: str, *collectors: list[Column]) -> tuple[DataFrame, Observation]:
    """``df`` and the observation that its next action fills."""
    seen = Observation(name)
    return df.observe(seen, *[e for c in collectors for e in c]), seen


def samples(*observations: Observation) -> list[tuple[str, str, str, float]]:
    """(metric, labels, le, value) of the series that have counted something; waits for the actions."""
    out = []
    for o in observations:
        for key, value in o.get.items():
            metric, *told = key.split("|")
            base = next(n for n in (metric, metric.rpartition("_")[0]) if n in COLLECTORS)
            c = COLLECTORS[base]
            labels = ",".join(f'{n}="{v}"' for (n, _), v in zip(c.labels, told))
            out.append((metric, labels, told[-1] if metric.endswith("_bucket") and c.bounds else "", float(value)))
    return [s for s in out if s[3]]


def exposition(rows: list[tuple[str, str, str, float]]) -> str:
    """The text format: help and type by collector, then its series; a histogram's buckets end with that of everything."""
    out = []
    for c in COLLECTORS.values():
        kind = "histogram" if c.bounds else "counter"
        out += [f"# HELP {c.name} {c.help}", f"# TYPE {c.name} {kind}"]
        mine = [r for r in rows if r[0] == c.name or c.bounds and r[0].rpartition("_")[0] == c.name]
        for metric, labels, le, value in mine:
            if metric.endswith("_count") and c.bounds:
                out.append(f"{c.name}_bucket{{{','.join(x for x in (labels, 'le=\"+Inf\"') if x)}}} {value:g}")
            inner = ",".join(x for x in (labels, f'le="{le}"' if le else "") if x)
            out.append(f"{metric}{'{' + inner + '}' if inner else ''} {value:g}")
    return "\n".join(out) + "\n"


def table(spark: SparkSession, *observations: Observation) -> DataFrame:
    """metric, labels, le, value; as many rows as there are series."""
    return spark.createDataFrame(samples(*observations), "metric string, labels string, le string, value double")
