"""Quality rules: base counts, then robust multivariate outliers by language and source (native).

The base counts come from higher-order functions within a row.  The verdict is a
minimum-covariance-determinant estimate: from several starts, concentration steps refit
mean and covariance of each group on the ``coverage`` share of rows with the smallest
Mahalanobis distance, which lowers the determinant.  The start with the least determinant
after two steps goes on until its determinant stands still, and the least one met is
taken; a consistency factor and one reweighted fit follow, and rows beyond the chi-square
cut are rejected.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SPLIT = "[\\x20\\x09-\\x0D]+"

#: Transformed statistics, and the standard deviation below which each one's spread doesn't count.
FLOORS = {"__sl_word": 0.08, "__sl_symbol": 0.06, "__sl_line": 0.12, "__sl_repeat": 0.20}
#: Chi-square quantiles for four degrees of freedom: 0.5, 0.975 and 0.9999.
CHI2_HALF, CHI2_REWEIGHT, CHI2_CUT = 3.3567, 11.1433, 23.5127


def base_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``' rows as given columns plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long).

    A null text has no words and no lines.  Lines are split at \\n and count if they
    hold a word; a line that equals an earlier one is a duplicate.  Repeated words are
    those in any three-word window that occurs twice or more in the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__sl_words", F.filter(F.split(text, SPLIT), lambda w: w != ""))
    out = out.withColumn("__sl_lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0))
    words = F.col("__sl_words")
    three = lambda i: [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]
    windows = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(*three(i)).alias("h"), i.alias("p"))))
    out = out.withColumn("__sl_windows", F.sort_array(windows))
    sorted_ = F.col("__sl_windows")
    # Windows are sorted by hash; the words themselves are compared only where hashes are equal.
    words_of = lambda x: F.concat_ws(" ", *three(x["p"]))
    same = lambda x, j: F.coalesce((F.get(sorted_, j)["h"] == x["h"]) & (words_of(F.get(sorted_, j)) == words_of(x)), F.lit(False))
    repeated = F.filter(sorted_, lambda x, i: same(x, i - 1) | same(x, i + 1))
    out = out.withColumn("__sl_places", F.sort_array(F.transform(repeated, lambda x: x["p"])))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("__sl_places", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    bare = F.translate(text, BLANKS, "")
    counts = {
        "n_words": F.size("__sl_words"),
        "word_chars": F.length(bare),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_lines": F.size("__sl_lines"),
        "n_dup_lines": F.size("__sl_lines") - F.size(F.array_distinct("__sl_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    return out.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("__sl_words", "__sl_lines", "__sl_windows", "__sl_places")


def _vector() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "__sl_word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "__sl_symbol": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "__sl_line": F.sqrt(F.col("n_dup_lines") / lines),
        "__sl_repeat": F.sqrt(F.col("n_repeat_words") / words),
    }


def _distance(xs: list[str]) -> Column:
    """Squared Mahalanobis distance with the group's mean m<x> and precision p_*_*."""
    d = {x: F.col(x) - F.col(f"m{x}") for x in xs}
    return reduce(add, [(1 if a == b else 2) * F.col(f"__sl_p_{i}_{j}") * d[a] * d[b] for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j])


def _estimate(moments: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    """``moments`` (keys, __sl_n, means m<x>, covariances __sl_c_*_*) to precision __sl_p_*_* and __sl_logdet; the floors' squares are added to the variances."""
    n = len(xs)
    out = moments.withColumns({f"__sl_c_{i}_{i}": F.col(f"__sl_c_{i}_{i}") + F.lit(FLOORS[x] ** 2) for i, x in enumerate(xs)})
    for i in range(n):  # Cholesky factor l, row by row
        for j in range(i + 1):
            left = reduce(add, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.lit(0.0))
            value = F.sqrt(F.col(f"__sl_c_{i}_{i}") - left) if i == j else (F.col(f"__sl_c_{i}_{j}") - left) / F.col(f"l_{j}_{j}")
            out = out.withColumn(f"l_{i}_{j}", value)
    for j in range(n):  # its inverse r
        for i in range(j, n):
            value = 1 / F.col(f"l_{i}_{i}") if i == j else -reduce(add, [F.col(f"l_{i}_{k}") * F.col(f"r_{k}_{j}") for k in range(j, i)]) / F.col(f"l_{i}_{i}")
            out = out.withColumn(f"r_{i}_{j}", value)
    out = out.withColumns({f"__sl_p_{i}_{j}": reduce(add, [F.col(f"r_{k}_{i}") * F.col(f"r_{k}_{j}") for k in range(j, n)]) for i in range(n) for j in range(i, n)})
    logdet = reduce(add, [2 * F.log(f"l_{i}_{i}") for i in range(n)])
    return out.select(*keys, "__sl_n", *[f"m{x}" for x in xs], *[f"__sl_p_{i}_{j}" for i in range(n) for j in range(i, n)], logdet.alias("__sl_logdet"))


def _moments(rows: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    """By keys: number, mean, precision and log-determinant of the rows."""
    sums = [F.covar_pop(a, b).alias(f"__sl_c_{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if j <= i]
    return _estimate(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__sl_n"), *[F.avg(x).alias(f"m{x}") for x in xs], *sums), keys, xs)


def _starts(fit: DataFrame, xs: list[str], ws: Workspace) -> DataFrame:
    """Starting estimates by __sl_grp, numbered by __sl_start.

    0: medians and quartile spreads, coordinate by coordinate.  1: mean and covariance of
    all rows.  2: those of the half nearest to the medians.  3: as 0, with the spreads of
    the lower half alone, for groups whose statistics crowd at the lower end.
    """
    n = len(xs)
    quarters = fit.groupBy("__sl_grp").agg(F.count(F.lit(1)).alias("__sl_n"), *[F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(f"q{x}") for x in xs])

    def diagonal(number: int, spread) -> DataFrame:
        cov = [(F.pow(spread(x), F.lit(2)) if i == j else F.lit(0.0)).alias(f"__sl_c_{i}_{j}") for i, x in enumerate(xs) for j in range(i + 1)]
        made = quarters.select("__sl_grp", "__sl_n", *[F.get(f"q{x}", 1).cast("double").alias(f"m{x}") for x in xs], *cov)
        return _estimate(made, ["__sl_grp"], xs).withColumn("__sl_start", F.lit(number))

    first = diagonal(0, lambda x: (F.get(f"q{x}", 2) - F.get(f"q{x}", 0)) / 1.349)
    lower = diagonal(3, lambda x: (F.get(f"q{x}", 1) - F.get(f"q{x}", 0)) / 0.6745)
    whole = _moments(fit, ["__sl_grp"], xs).withColumn("__sl_start", F.lit(1))
    kept = ws.store(first.unionByName(lower).unionByName(whole), "diagonal")
    near = _concentrated(fit, kept.filter("__sl_start = 0"), 0.5, xs).withColumn("__sl_start", F.lit(2))
    return kept.unionByName(near.select(*kept.columns))


def _concentrated(fit: DataFrame, params: DataFrame, coverage: float, xs: list[str], hint=F.broadcast) -> DataFrame:
    """One concentration step of each start: estimates from the ``coverage`` share of rows nearest to the one before."""
    keys = ["__sl_start", "__sl_grp"]
    ranked = fit.join(hint(params), "__sl_grp").select(*keys, *xs, _distance(xs).alias("__sl_d"))
    edge = ranked.groupBy(*keys).agg(F.percentile_approx("__sl_d", coverage, F.lit(1000)).alias("__sl_edge"))
    return _moments(ranked.join(hint(edge), keys).filter("__sl_d <= __sl_edge"), keys, xs)


def _best(params: DataFrame) -> DataFrame:
    """Of each group the estimate of least determinant."""
    columns = [c for c in params.columns if c not in ("__sl_grp", "__sl_logdet")]
    least = params.groupBy("__sl_grp").agg(F.min(F.struct("__sl_logdet", *columns)).alias("x"))
    return least.select("__sl_grp", "x.*").select(*params.columns)


def robust_estimates(fit: DataFrame, xs: list[str], coverage: float, steps: int, tolerance: float, ws: Workspace, hint=F.broadcast) -> DataFrame:
    """Minimum-covariance-determinant estimates of ``fit`` (__sl_grp, xs): __sl_grp, __sl_n, means, precision, __sl_logdet.

    Two concentration steps from every start, then at most ``steps`` from the best of each
    group, until no group's log-determinant falls by more than ``tolerance``.
    """
    params = ws.store(_starts(fit, xs, ws), "starts")
    for k in range(2):
        params = ws.store(_concentrated(fit, params, coverage, xs, hint), f"all{k}")
    best = params = ws.store(_best(params), "best")
    for k in range(steps):
        params = ws.store(_concentrated(fit, params, coverage, xs, hint), f"step{k}")
        before = best
        best = ws.store(_best(before.unionByName(params.select(*before.columns))), f"best{k}")
        fall = before.select("__sl_grp", F.col("__sl_logdet").alias("was")).join(hint(best), "__sl_grp").agg(F.max(F.col("was") - F.col("__sl_logdet"))).first()[0]
        if fall is None or fall <= tolerance:
            break
    return best


def outliers(rows: DataFrame, group_cols: list[str], min_group: int = 50, coverage: float = 0.75, steps: int = 10, tolerance: float = 0.01, cut: float = CHI2_CUT, broadcast_groups: int = 5_000) -> DataFrame:
    """``rows`` (with the columns of :func:`base_stats` and a boolean ``base_failed``) plus ``distance`` and ``outlier``.

    Estimates use the rows that did not fail.  Groups are the combinations of
    ``group_cols`` (null is a value); those with fewer than ``min_group`` such rows
    join a common group of their first column's value, and where that is still too
    small there is no estimate: distance null, outlier false.  Group parameters are
    broadcast while there are at most ``broadcast_groups`` groups, else joined by key.
    """
    ws = Workspace(rows.sparkSession, "quality_rules")
    xs = list(FLOORS)
    name = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"g{i}") for i, c in enumerate(group_cols)]))
    broad = F.to_json(F.struct(F.lit("*").alias("all"), F.col(group_cols[0]).cast("string").alias("g0")))
    data = ws.store(rows.withColumns(_vector()).withColumns({"__sl_own": name, "__sl_broad": broad}), "vectors")
    sizes = data.filter(~F.col("base_failed")).groupBy("__sl_own").agg(F.count(F.lit(1)).alias("__sl_n"))
    sizes = ws.store(sizes.filter(F.col("__sl_n") >= min_group).select("__sl_own"), "sizes")
    # A group in ``sizes`` has a broad one at most beside it.
    hint = F.broadcast if sizes.count() <= broadcast_groups and data.select(group_cols[0]).distinct().count() <= broadcast_groups else (lambda x: x)
    known = data.join(hint(sizes.withColumn("__sl_big", F.lit(True))), "__sl_own", "left")
    known = known.withColumn("__sl_grp", F.when(F.col("__sl_big"), F.col("__sl_own")).otherwise(F.col("__sl_broad"))).drop("__sl_big")
    fit = known.filter(~F.col("base_failed")).select("__sl_grp", *xs)
    params = robust_estimates(fit, xs, coverage, steps, tolerance, ws, hint)
    ranked = fit.join(hint(params), "__sl_grp").select("__sl_grp", *xs, _distance(xs).alias("__sl_d"))
    # Consistency: distances scaled so that their median is the chi-square median, never below what the floors allow.
    scale = ranked.groupBy("__sl_grp").agg(F.greatest(F.percentile_approx("__sl_d", 0.5, F.lit(1000)) / CHI2_HALF, F.lit(1.0)).alias("__sl_scale"))
    final = ws.store(_moments(ranked.join(hint(scale), "__sl_grp").filter(F.col("__sl_d") <= F.col("__sl_scale") * CHI2_REWEIGHT), ["__sl_grp"], xs), "final")
    final = final.filter(F.col("__sl_n") >= min_group // 2).drop("__sl_n", "__sl_logdet")
    judged = known.join(hint(final), "__sl_grp", "left").withColumn("__sl_d", _distance(xs))
    return judged.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("__sl_d").alias("distance"), F.coalesce(F.col("__sl_d") > cut, F.lit(False)).alias("outlier"))


def quality_rules(docs: DataFrame, text_col: str = "text", group_cols=("lang", "source"), min_words: int = 50, max_repeat: int = 50, **options) -> DataFrame:
    """Per row: the columns of ``docs`` but the text, base counts, base_failed, distance, outlier, kept.

    Columns of ``docs`` named like a result are replaced, all others stay.  Groups without
    an estimate (see :func:`outliers`) keep what passes the base rules.  Null texts have no
    words and fail; repeated rows are judged alike.  An empty table gives an empty result.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "outlier", "kept"]
    stats = base_stats(docs.drop(*made), text_col).drop(text_col)
    stats = stats.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    return outliers(stats, list(group_cols), **options).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def query_base(spark, sf_dir: str) -> DataFrame:
    """The base counts alone, as :data:`ORACLE_BASE` states them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return base_stats(docs).drop("text", "n_lines")


#: The base counts: places of windows that occur twice or more, each counting the words that it is the first to cover.
ORACLE_BASE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
wins AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM w, unnest(range(1, len(ws) - 1)) AS u(i) WHERE len(ws) >= 3),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM wins) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(3, i - before)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 3) AS before FROM rep) GROUP BY 1),
ls AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
FROM w JOIN ls ON w.doc_id = ls.doc_id LEFT JOIN cov ON w.doc_id = cov.doc_id
"""
