"""Mixing sources to target weights by Pfair scheduling (native).

Each source's documents form blocks of equal text size.  With weight n / D a source's
block j may run from slot floor(j * D / n), its release, and must end by slot
ceil((j + 1) * D / n), its deadline; in every slot the released block with the earliest
deadline runs.  The weights sum to one, so no slot is idle, every deadline is met and
after any number of slots each source is less than one block from its due share.  The
schedule repeats after D slots: one period is folded over the sources alone, and blocks
find their slots by arithmetic, so no task ever walks the documents in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rows import identity
from .workspace import Workspace


def target_weights(sizes: DataFrame, alpha: float = 0.5, slots: int = 1000) -> DataFrame:
    """(source, size) to (source, share): whole shares of ``slots`` in proportion to size ** alpha.

    Shares sum to ``slots`` (or to ten a source, where that is more); leftovers go to
    the largest remainders, then in order of the source.  Sources without text get none.
    """
    one = W.partitionBy(F.lit(0))
    live = sizes.filter("size > 0").withColumn("w", F.pow(F.col("size").cast("double"), F.lit(alpha)))
    live = live.withColumn("total", F.greatest(F.lit(slots), 10 * F.count(F.lit(1)).over(one)))
    live = live.withColumn("exact", F.col("w") / F.sum("w").over(one) * F.col("total"))
    live = live.withColumn("floor", F.greatest(F.floor("exact"), F.lit(1)))
    live = live.withColumn("rank", F.row_number().over(one.orderBy(F.desc(F.col("exact") - F.col("floor")), "source")))
    return live.select("source", (F.col("floor") + (F.col("rank") <= F.col("total") - F.sum("floor").over(one)).cast("int")).cast("long").alias("share"))


def period(shares: DataFrame) -> DataFrame:
    """(source, share, nth, cycle, slot): when in a period each source's nth block runs.

    Earliest deadline first over the released blocks, ties by the order of the source.
    The fold sees one row with the shares of all sources, never a document.
    """
    named = shares.filter("share > 0").agg(F.sort_array(F.collect_list(F.struct("source", "share"))).alias("s"))
    named = named.withColumn("cycle", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["share"])).filter("cycle > 0")
    s, cycle = F.col("s"), F.col("cycle")

    def run(state, t):
        """state: how many blocks each source has run, and the picks so far."""
        due = F.transform(
            s,
            lambda x, i: F.struct(
                # Released if floor(j * cycle / share) <= t; the deadline is ceil((j + 1) * cycle / share).
                (F.floor(F.get(state["ran"], i) * cycle / x["share"]) > t).alias("waits"),
                (-F.floor(-(F.get(state["ran"], i) + 1) * cycle / x["share"])).alias("deadline"),
                i.alias("i"),
            ),
        )
        pick = F.array_min(due)["i"]
        return F.struct(
            F.transform(state["ran"], lambda n, i: n + (i == pick).cast("long")).alias("ran"),
            F.concat(state["picks"], F.array(pick)).alias("picks"),
        )

    start = F.struct(F.transform(s, lambda x: F.lit(0).cast("long")).alias("ran"), F.array().cast("array<int>").alias("picks"))
    picks = F.aggregate(F.sequence(F.lit(0).cast("long"), cycle - 1), start, run, lambda a: a["picks"])
    flat = named.select("s", "cycle", F.posexplode(picks).alias("slot", "pick")).select(F.get("s", F.col("pick")).alias("x"), "cycle", F.col("slot").cast("long"))
    nth = F.row_number().over(W.partitionBy("x").orderBy("slot")) - 1
    return flat.withColumn("nth", nth.cast("long")).select("x.source", "x.share", "nth", "cycle", "slot")


def blocks(docs: DataFrame, block_size: int, rows_per_bucket: int = 100_000) -> DataFrame:
    """``docs`` (row_id, source, size, key) plus ``block`` and ``place``: cumulative size and rank within the source.

    Documents run in the order of ``key`` (hexadecimal, evenly spread), then row_id.  A
    source is cut by key into buckets so that even a source with all rows is ranked by
    many tasks; only the buckets' sums are accumulated across.
    """
    ws = Workspace(docs.sparkSession, "mixing_blocks")
    n = docs.count()
    bits = 4
    while bits < 20 and (n >> bits) > rows_per_bucket:
        bits += 4
    data = docs.withColumn("bucket", F.substring("key", 1, bits // 4))
    sums = ws.store(data.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "buckets")
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    within = W.partitionBy("source", "bucket").orderBy("key", "row_id")
    data = data.withColumn("cum", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).withColumn("nth", F.row_number().over(within) - 1)
    met = data.join(starts.withColumnsRenamed({"source": "s", "bucket": "b"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return met.select(*docs.columns, F.floor((F.col("cum") + F.col("size0")) / block_size).alias("block"), (F.col("nth") + F.col("n0")).cast("long").alias("place"))


def pfair_mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_size: int = 16_384, slots: int = 1000, alpha: float = 0.5, strict: bool = False) -> DataFrame:
    """One row per input row: doc_id, source, size, block, release, deadline, slot, place, mixed, tid.

    Text size is counted in code points (null: 0).  ``weights`` are the target weights
    of the sources, scaled to sum to one (unnamed sources get none); without them they
    follow the sources' own size ** alpha.  Rows are in mixing order when sorted by
    (slot, place).  A source that has run out leaves: its further slots hold no text, so
    they fall to the sources that remain, which keep their shares to one another (each
    within a block of its share of the slots) until the last has run out.  ``mixed`` is
    false for sources of no weight (slot null); if ``strict``, the mixture ends at the
    first slot whose block the source hasn't got, and rows beyond it aren't mixed either.
    ``tid`` is a hash of the text.  A null source is a source of its own.  Repeated rows are rows of their own; an
    empty table gives an empty result.  Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    tid = F.xxhash64(F.col(text_col).cast("string"), F.col(text_col).isNull()).alias("tid")
    base = docs.select(F.col(id_col).alias("doc_id"), tid, F.col(source_col).cast("string").alias("source"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    data = ws.store(base.withColumn("row_id", F.monotonically_increasing_id()), "rows")
    sizes = data.groupBy("source").agg(F.sum("size").alias("size"))
    if weights:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        sizes = sizes.select("source", F.when(F.col("size") > 0, F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0))).alias("size"))
        alpha = 1.0
    shares = target_weights(sizes, alpha, slots)
    table = ws.store(period(shares), "period")
    placed = ws.store(blocks(data, block_size).drop("key"), "blocks")

    # One row a slot of the period: slots, or ten a source where that is more.
    hint = F.broadcast if table.count() <= 200_000 else (lambda x: x)
    per = table.groupBy("source").agg(F.max("share").alias("share"), F.max("cycle").alias("cycle"))
    lookup = table.select(F.col("source").alias("p_source"), F.col("nth").alias("p_nth"), F.col("slot").alias("p_slot"))
    totals = per.select(F.col("source").alias("t_source"), "share", "cycle")

    def with_slot(x: DataFrame, block: str) -> DataFrame:
        x = x.join(hint(totals), F.col("source").eqNullSafe(F.col("t_source")), "left").withColumn("nth", F.col(block) % F.col("share"))
        x = x.join(hint(lookup), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("nth") == F.col("p_nth")), "left")
        return x.withColumn("slot", F.floor(F.col(block) / F.col("share")) * F.col("cycle") + F.col("p_slot"))

    mixed = F.col("slot").isNotNull()
    if strict:
        own = ws.store(placed.groupBy("source").agg(F.max("block").alias("last")), "own")
        missing = with_slot(own.withColumn("next", F.col("last") + 1), "next").agg(F.min("slot")).first()[0]
        mixed = F.coalesce(F.col("slot") < F.lit(missing).cast("long"), F.lit(False))
    out = with_slot(placed, "block")
    return out.select(
        "doc_id",
        "source",
        "size",
        "block",
        F.floor(F.col("block") * F.col("cycle") / F.col("share")).alias("release"),
        (-F.floor(-(F.col("block") + 1) * F.col("cycle") / F.col("share"))).alias("deadline"),
        "slot",
        "place",
        mixed.alias("mixed"),
        "tid",
    )


def keep_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`pfair_mix` takes into the mixture, in its order.

    Partitions follow one another by slot and place and are sorted within, so a written table
    holds the mixture from its first file to its last.  Rows equal in id and text are taken or
    left together, at the first one's place.
    """
    ws = Workspace(docs.sparkSession, "mixture")
    found = pfair_mix(docs, id_col=id_col, text_col=text_col, **options).filter("mixed")
    first = found.groupBy(F.col("doc_id").alias("__sl_i"), F.col("tid").alias("__sl_t")).agg(F.min(F.struct("slot", "place")).alias("__sl_at"))
    rows = identity(docs, id_col, text_col)
    met = rows.join(first, (F.col("__sl_tid") == F.col("__sl_t")) & F.col(id_col).eqNullSafe(F.col("__sl_i")))
    # Written first: the ranges are found by a sample of it.
    placed = ws.store(met.select(*[F.col(f"`{c}`") for c in docs.columns], "__sl_at"), "placed")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, "__sl_at").sortWithinPartitions("__sl_at").drop("__sl_at")


def query(spark, sf_dir: str) -> DataFrame:
    """The strict mixture, as :data:`ORACLE` states it."""
    return pfair_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), strict=True).drop("tid")


def query_whole(spark, sf_dir: str) -> DataFrame:
    """The mixture to the end of all sources."""
    return pfair_mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tid")


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(length(text), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
sizes AS (SELECT source, pow(CAST(sum(size) AS DOUBLE), 0.5) AS w FROM d GROUP BY 1 HAVING sum(size) > 0),
exact AS (SELECT source, greatest(1000, 10 * count(*) OVER ()) AS total, w / sum(w) OVER () * greatest(1000, 10 * count(*) OVER ()) AS e FROM sizes),
floors AS (SELECT source, total, e, greatest(CAST(floor(e) AS BIGINT), 1) AS f FROM exact),
ranks AS (SELECT source, f, row_number() OVER (ORDER BY e - f DESC, source) AS r, total - sum(f) OVER () AS more FROM floors),
shares AS (SELECT source, f + CASE WHEN r <= more THEN 1 ELSE 0 END AS share FROM ranks),
every AS (SELECT list(CAST(share AS BIGINT) ORDER BY source) AS s, list(source ORDER BY source) AS names, CAST(sum(share) AS BIGINT) AS cycle FROM shares),
run AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(s, lambda x: CAST(0 AS BIGINT)) AS ran, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS nth FROM every
  UNION ALL
  SELECT t + 1, list_transform(ran, lambda n, i: n + CASE WHEN i = p THEN 1 ELSE 0 END), p, ran[p] FROM (
    SELECT run.t, run.ran, s, cycle,
      list_min(list_transform(run.ran, lambda n, i: CASE WHEN n * cycle // s[i] <= run.t + 1 THEN ((n + 1) * cycle + s[i] - 1) // s[i] * 100000 + i END)) % 100000 AS p
    FROM run, every WHERE run.t + 1 < cycle) z),
period AS (SELECT names[pick] AS source, s[pick] AS share, cycle, nth, t AS p_slot FROM run, every WHERE t >= 0),
placed AS (
  SELECT *, (sum(size) OVER w - size) // 16384 AS block, row_number() OVER w - 1 AS place FROM d
  WINDOW w AS (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING)),
per AS (SELECT DISTINCT source, share, cycle FROM period),
slots AS (
  SELECT p.*, q.share, q.cycle, p.block // q.share * q.cycle + r.p_slot AS slot FROM placed p LEFT JOIN per q ON p.source = q.source
  LEFT JOIN period r ON r.source = p.source AND r.nth = p.block % q.share),
horizon AS (
  SELECT min((b.next // q.share) * q.cycle + r.p_slot) AS h FROM (SELECT source, max(block) + 1 AS next FROM placed GROUP BY 1) b
  JOIN per q ON b.source = q.source JOIN period r ON r.source = b.source AND r.nth = b.next % q.share)
SELECT doc_id, source, size, CAST(block AS BIGINT) AS block, CAST(block * cycle // share AS BIGINT) AS release,
  CAST(((block + 1) * cycle + share - 1) // share AS BIGINT) AS deadline, CAST(slot AS BIGINT) AS slot, CAST(place AS BIGINT) AS place, coalesce(slot < h, FALSE) AS mixed
FROM slots, horizon
"""

#: The same schedule, in which sources leave one by one.
ORACLE_WHOLE = ORACLE.replace("coalesce(slot < h, FALSE) AS mixed\nFROM slots, horizon", "slot IS NOT NULL AS mixed\nFROM slots")
