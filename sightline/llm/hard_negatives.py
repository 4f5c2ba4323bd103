"""Hard negatives by one-dimensional distance keys.

Vectors get one more component, so that all have the same length M and a larger inner
product with an anchor means a smaller distance to it.  A row's key is its nearest pivot
and its distance from it; rows are stored sorted by that key.  By the triangle inequality
a row within ``r`` of an anchor lies in the key interval ``[d - r, d + r]`` of its pivot,
``d`` being the anchor's distance from that pivot.  An anchor searches these intervals in
rounds of growing ``r``, each round only the annuli not yet seen, until every row unseen is
farther than what it has found: that bound certifies its result.

Anchors take turns in blocks of about ``block``, whose vectors are broadcast; the index is
scanned for a block in tasks that keep the best few by anchor, and Spark merges them.  What
a block found stays in tables; the driver sees the scores that steer the next round alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Rows from which the pivots are computed: a bounded sample, by row hash.  Every row is indexed.
PIVOT_ROWS = 4096
#: Scores of vectors with a squared length below this, and a hundred times them, fit a long.
MAX_SQUARE = 2.0**56
#: Rows that meet the anchors at a time.
TILE = 1024
_FOUND = "a_uid long, anchor_id long, slot int, score long, vec_id long"
#: Slot of the rows found as positives.
POSITIVE = -1


def integer_vectors(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, x as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def finite(vector: Column) -> Column:
    """Whether a vector is there and every component is a finite number."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~odd


def _matrix(column, width: int) -> np.ndarray:
    """Lists as rows of a matrix; what a list lacks is zero, as it adds nothing to a product."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if len(ends) and (ends == width).all():
        return flat.reshape(len(ends), width)
    out = np.zeros((len(ends), width))
    out[np.repeat(np.arange(len(ends)), ends), np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def _exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; doubles are exact as long as the products of lengths are below 2^52."""
    if len(a) and len(b) and np.sqrt((a**2).sum(1).max() * (b**2).sum(1).max()) >= 2.0**52:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a @ b.T).astype(np.int64)


def _rest(x: np.ndarray, square: float) -> np.ndarray:
    """The component that brings each row to the squared length."""
    return np.sqrt(np.maximum(0.0, square - (x**2).sum(1)))


def choose_pivots(x: np.ndarray, count: int, steps: int = 5, seed: int = 7) -> np.ndarray:
    """Means of groups of near rows."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[rng.permutation(len(x))[:count]]
    for _ in range(steps if len(x) else 0):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class Index:
    """The stored rows sorted by (pivot, dist), the pivots with their last component, and the key span by pivot."""

    table: DataFrame
    pivots: np.ndarray
    square: float
    spans: np.ndarray

    @property
    def width(self) -> int:
        return self.pivots.shape[1] - 1

    @property
    def slack(self) -> float:
        """More than what rounding can move a distance by."""
        return 1e-6 * math.sqrt(self.square) + 1e-9


def _keys(batches, pivots: np.ndarray, square: float):
    for b in batches:
        x = _matrix(b.column("q").combine_chunks() if isinstance(b.column("q"), pa.ChunkedArray) else b.column("q"), pivots.shape[1] - 1)
        x = np.hstack([x, _rest(x, square)[:, None]])
        d = np.empty(len(x))
        near = np.empty(len(x), np.int32)
        for i in range(0, len(x), TILE):
            gaps = (x[i : i + TILE] ** 2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x[i : i + TILE] @ pivots.T
            near[i : i + TILE] = gaps.argmin(1)
            d[i : i + TILE] = np.sqrt(np.maximum(0.0, gaps.min(1)))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(d)], [*b.schema.names, "pivot", "dist"])


def build_index(rows: DataFrame, ws: Workspace, pivots: int = 32) -> Index:
    """Index all of ``rows`` (vec_id, label, q, is_anchor)."""
    flat = ws.store(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    size = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    square, width = flat.agg(F.max(size), F.max(F.size("q"))).first()
    square, width = float(square or 0.0), int(width or 0)
    sample = flat.select("q").orderBy(F.xxhash64("vec_id", "q"), "uid").limit(PIVOT_ROWS).collect()
    x = np.zeros((len(sample), width + 1))
    for i, r in enumerate(sample):
        x[i, : len(r.q)] = r.q
    x[:, -1] = _rest(x[:, :-1], square)
    centres = choose_pivots(x, pivots)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema) + ", pivot int, dist double"
    keyed = flat.mapInArrow(lambda it: _keys(it, centres, square), schema)
    parts = int(flat.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = ws.store(keyed.repartitionByRange(parts, "pivot", "dist", "uid").sortWithinPartitions("pivot", "dist"), "index")
    spans = np.full((len(centres), 2), np.nan)
    for p, low, high in table.groupBy("pivot").agg(F.min("dist"), F.max("dist")).collect():
        spans[p] = low, high
    ws.drop("rows")
    return Index(table, centres, square, spans)


@dataclass
class _Block:
    """Anchors that search together; ``seen`` and ``reach`` bound the annulus of this round."""

    uid: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    x: np.ndarray
    to_pivot: np.ndarray
    norm: np.ndarray
    seen: np.ndarray
    reach: np.ndarray
    #: Rows without use below it: the k-th score that a slot has, and the positives' scores (anchor, slot).
    bar: np.ndarray
    goal: np.ndarray | None = None

    def pick(self, which: np.ndarray) -> _Block:
        return _Block(*(None if v is None else v[which] for v in (self.uid, self.ids, self.label, self.x, self.to_pivot, self.norm, self.seen, self.reach, self.bar, self.goal)))


def _best(anchor, slot, score, vec_id, k: int, slots: int):
    """Of each anchor's slot the k rows with the highest score, ties by smaller id."""
    key = anchor.astype(np.int64) * slots + slot
    order = np.lexsort((vec_id, -score, key))
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    keep = order[np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key)))) < k]
    return anchor[keep], slot[keep], score[keep], vec_id[keep]


def _wanted(block: _Block, at: np.ndarray, score: np.ndarray, label: np.ndarray, uid: np.ndarray, fresh: np.ndarray, low: int, full: int):
    """(anchor, slot, row) of what a tile has for its anchors."""
    same = block.label[at][:, None] == label
    if block.goal is None:
        a, r = np.nonzero(fresh & same & (score >= block.bar[at, 0][:, None]) & (block.uid[at][:, None] != uid))
        return at[a], np.zeros(len(a), np.int64), r, score[a, r]
    goal = block.goal[at]
    # A goal of -1 stands for no search: no score lies in its range.
    open_ = np.where(goal < 0, np.iinfo(np.int64).max // 128, goal).min(1)
    a, r = np.nonzero(fresh & ~same & (full * score >= low * open_[:, None]) & (score <= goal.max(1)[:, None]))
    s = score[a, r]
    out = [[], [], [], []]
    for j in range(goal.shape[1]):
        g = goal[a, j]
        fits = (g >= 0) & (s <= g) & (full * s >= low * g) & (s >= block.bar[at[a], j])
        for o, v in zip(out, (at[a][fits], np.full(fits.sum(), j), r[fits], s[fits])):
            o.append(v)
    return tuple(np.concatenate(v) for v in out)


def _scan(batches, block: _Block, k: int, low: int, full: int, width: int):
    slots = 1 if block.goal is None else block.goal.shape[1]
    bar = block.bar.copy()
    block = _Block(**{**block.__dict__, "bar": bar})
    have = tuple(np.zeros(0, np.int64) for _ in range(4))
    for b in batches:
        cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        pivot, dist, label, ids, uid = (cols[n].to_numpy(zero_copy_only=False) for n in ("pivot", "dist", "label", "vec_id", "uid"))
        x = _matrix(cols["q"], width)
        cuts = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1])).tolist() + [len(pivot)]
        for i, j in ((s, min(s + TILE, e)) for c, e in zip(cuts, cuts[1:]) for s in range(c, e, TILE)):
            d, mine = dist[i:j], block.to_pivot[:, pivot[i]]
            at = np.flatnonzero((d.min() <= mine + block.reach) & (d.max() >= mine - block.reach))
            for m in range(0, len(at), TILE):
                part = at[m : m + TILE]
                gap = np.abs(d - mine[part][:, None])
                fresh = (gap <= block.reach[part][:, None]) & (gap > block.seen[part][:, None])
                if not fresh.any():
                    continue
                a, slot, r, s = _wanted(block, part, _exact_products(block.x[part], x[i:j]), label[i:j], uid[i:j], fresh, low, full)
                if not len(a):
                    continue
                have = _best(*(np.concatenate(v) for v in zip(have, (a, slot, s, ids[i:j][r]))), k, slots)
                key, at_slot = have[0] * slots + have[1], np.zeros(len(block.uid) * slots, np.int64)
                np.add.at(at_slot, key, 1)
                lowest = np.full(len(at_slot), np.iinfo(np.int64).max)
                np.minimum.at(lowest, key, have[2])
                better = np.where(at_slot >= k, lowest, np.iinfo(np.int64).min).reshape(bar.shape)
                np.maximum(bar, better, out=bar)
    slot = have[1] if block.goal is not None else np.full(len(have[1]), POSITIVE)
    yield pa.RecordBatch.from_arrays(
        [pa.array(block.uid[have[0]], pa.int64()), pa.array(block.ids[have[0]], pa.int64()), pa.array(slot, pa.int32()), pa.array(have[2], pa.int64()), pa.array(have[3], pa.int64())],
        ["a_uid", "anchor_id", "slot", "score", "vec_id"],
    )


def _rank(found: DataFrame, k: int) -> DataFrame:
    """The best k by anchor and slot, numbered from 1."""
    w = Window.partitionBy("a_uid", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class _Search:
    """The rounds of one block."""

    def __init__(self, index: Index, ws: Workspace, name: str, k: int, low: int, full: int):
        self.index, self.ws, self.name, self.k, self.low, self.full = index, ws, name, k, low, full
        self.tables: list[str] = []

    def distance(self, block: _Block, score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, block.norm[:, None] + self.index.square - 2.0 * score))

    def all_of_it(self, block: _Block) -> np.ndarray:
        """The reach that takes in every key."""
        low, high = self.index.spans[:, 0], self.index.spans[:, 1]
        return np.nanmax(np.maximum(block.to_pivot - low, high - block.to_pivot), axis=1) + self.index.slack

    def round(self, block: _Block) -> np.ndarray:
        """Scan the annuli; (anchor, slot, k) of the scores found so far, the least possible where there are fewer."""
        spark, k, low, full, width = self.index.table.sparkSession, self.k, self.low, self.full, self.index.width
        sent = spark.sparkContext.broadcast(block)
        from_, to = (block.to_pivot - block.reach[:, None]).min(0), (block.to_pivot + block.reach[:, None]).max(0)
        near = F.lit(False)
        for p in np.flatnonzero(~np.isnan(self.index.spans[:, 0])):
            if from_[p] <= self.index.spans[p, 1] and to[p] >= self.index.spans[p, 0]:
                near = near | ((F.col("pivot") == int(p)) & F.col("dist").between(float(from_[p]), float(to[p])))
        found = self.index.table.filter(near).drop("is_anchor").mapInArrow(lambda it: _scan(it, sent.value, k, low, full, width), _FOUND)
        name = f"{self.name}_{'near' if block.goal is None else 'far'}{len(self.tables)}"
        self.ws.store(_rank(found, k).drop("rank"), name)
        self.tables.append(name)
        same = [t for t in self.tables if ("near" in t) == (block.goal is None)]
        got = _rank(spark.read.schema(_FOUND).parquet(*map(self.ws.path, same)), k).select("a_uid", "slot", "rank", "score").toArrow()
        sent.destroy()
        out = np.full((len(block.uid), 1 if block.goal is None else block.goal.shape[1], k), np.iinfo(np.int64).min)
        where = np.argsort(block.uid)
        uid, slot, rank, score = (got.column(n).to_numpy() for n in ("a_uid", "slot", "rank", "score"))
        place = np.minimum(np.searchsorted(block.uid[where], uid), len(where) - 1)
        mine = block.uid[where][place] == uid
        out[where[place[mine]], np.maximum(slot[mine], 0), rank[mine] - 1] = score[mine]
        return out

    def positives(self, block: _Block) -> np.ndarray:
        """The k best scores by anchor among rows of its label."""
        whole, slack, none = self.all_of_it(block), self.index.slack, np.iinfo(np.int64).min
        out = np.full((len(block.uid), self.k), none)
        left = np.arange(len(block.uid))
        block.reach = np.minimum(whole, math.sqrt(self.index.square) / 8)
        while len(left):
            now = block.pick(left)
            out[left] = self.round(now)[:, 0]
            last = out[left, -1]
            radius = self.distance(now, last[:, None].astype(np.float64))[:, 0] + 2 * slack
            done = (now.reach >= whole[left]) | ((last > none) & (radius <= now.reach))
            block.seen[left], block.bar[left, 0] = now.reach, last
            block.reach[left] = np.minimum(whole[left], np.where(last > none, radius, now.reach * 2 + slack))
            left = left[~done]
        return out

    def negatives(self, block: _Block, goal: np.ndarray) -> None:
        """Search, for each positive, the rows of other labels from its score down to the share ``low`` of it."""
        none = np.iinfo(np.int64).min
        left = np.flatnonzero((goal >= 0).any(1))
        least = np.where(goal < 0, np.iinfo(np.int64).max // 128, goal).min(1)
        slack = self.index.slack
        end = np.minimum(self.all_of_it(block), self.distance(block, (least * (self.low / self.full))[:, None])[:, 0] + 2 * slack)
        block.reach = np.minimum(end, self.distance(block, least[:, None].astype(np.float64))[:, 0] + math.sqrt(self.index.square) / 32)
        block.seen, block.goal, block.bar = np.full(len(block.uid), -1.0), goal, np.full(goal.shape, none)
        while len(left):
            now = block.pick(left)
            got = self.round(now)[:, :, -1]
            wanted = now.goal >= 0
            full = (got > none) | ~wanted
            radius = np.where(wanted & (got > none), self.distance(now, got.astype(np.float64)), 0.0).max(1) + 2 * slack
            done = (now.reach >= end[left]) | (full.all(1) & (radius <= now.reach))
            block.seen[left], block.bar[left] = now.reach, got
            block.reach[left] = np.minimum(end[left], np.where(full.all(1), radius, now.reach * 1.5 + slack))
            left = left[~done]


def _blocks(index: Index, block: int):
    """The anchors, block after block, those of one pivot together."""
    anchors = index.table.filter("is_anchor").select("uid", "vec_id", "label", "q", "pivot")
    counts = {r.pivot: r.n for r in anchors.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = F.lit(0), 0
    for p in sorted(counts):
        before = F.when(F.col("pivot") == p, F.lit(at) + F.pmod(F.xxhash64("uid"), F.lit(counts[p]))).otherwise(before)
        at += counts[p]
    marked = anchors.withColumn("block", F.floor(before / block))
    for b in range(-(-at // block)):
        rows = marked.filter(F.col("block") == b).toArrow()
        if not rows.num_rows:
            continue
        x = _matrix(rows.column("q").combine_chunks(), index.width)
        norm = (x**2).sum(1)
        # Anchors have no last component: the longer the product, the smaller the distance to any row.
        far = norm[:, None] + (index.pivots**2).sum(1) - 2 * x @ index.pivots[:, :-1].T
        uid, ids, label = (rows.column(n).to_numpy() for n in ("uid", "vec_id", "label"))
        yield _Block(uid, ids, label, x, np.sqrt(np.maximum(0.0, far)), norm, np.full(len(uid), -1.0), np.zeros(len(uid)), np.full((len(uid), 1), np.iinfo(np.int64).min))


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "q", k: int = 5, low: int = 80, full: int = 100, pivots: int = 32, block: int = 2048) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has integer components.  An anchor's positives are the ``k`` other rows of its
    label with the highest inner product; for each, the ``k`` best rows of other labels with
    ``low * positive <= full * negative <= full * positive``, ties by smaller id.

    Rows without id, label or vector, or with a null component take no part, nor do vectors whose
    squared length is 2^56 or more (their scores need not fit a long).  A shorter vector counts as
    if zeros followed.  Repeated rows are rows of their own: a copy of an anchor is one of its
    positives.  A positive with a score below zero has no negatives; an empty table gives no rows.
    """
    spark: SparkSession = vectors.sparkSession
    ws = Workspace(spark, "hard_negatives")
    q = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), q.alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    length = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("q").isNotNull() & ~F.exists("q", lambda x: x.isNull()) & (length < MAX_SQUARE))
    index = build_index(rows.withColumn("q", F.col("q").cast("array<int>")), ws, pivots)
    tables: list[str] = []
    for n, b in enumerate(_blocks(index, block)):
        search = _Search(index, ws, f"b{n}", k, low, full)
        goal = search.positives(b)
        search.negatives(b, np.maximum(goal, -1))
        tables += search.tables
    ws.drop("index")
    near, far = ([ws.path(t) for t in tables if part in t] for part in ("near", "far"))
    read = lambda paths: spark.read.schema(_FOUND).parquet(*paths) if paths else spark.createDataFrame([], _FOUND)
    pos = _rank(read(near), k).select("a_uid", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    neg = _rank(read(far), k)
    return neg.join(pos, ["a_uid", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector of ``embeddings`` against all of them."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(finite(F.col("embedding")))
    label = F.col("label").cast("long")
    v = e.select("vec_id", F.when(F.pmod("vec_id", F.lit(7)) == 0, (label + 1) % 10).otherwise(label).alias("label"), integer_vectors(F.col("embedding")).alias("q"))
    return mine(v, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
    s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
