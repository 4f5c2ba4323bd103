"""The trie of conversation prefixes by LCP-aware external mergesort.

A conversation is a sequence of turn digests.  Spark deals the conversations by ranges of
(sequence, conv_id), so that no range depends on how often a sequence is repeated.  Each range
is written as sorted runs in which a conversation carries its longest common prefix (LCP) with
the one before and only the turns beyond it.  One task a range merges its runs with a loser
tree: contenders are told apart by their LCPs with the last winner, and turns are compared only
where these are equal, from there on.  The merged stream meets a stack of open nodes: what lies
deeper than the next conversation's LCP is finished and emitted, its sums added to its parent.

A path that crosses the border of two ranges is open in both.  The LCPs of neighbouring
ranges' outermost conversations tell which nodes those are; their parts, all of them sums and
least ids, are added up by node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Bytes of a turn's digest (the head of a SHA-256).
D = 16
#: Conversations and bytes of digests in a run.
RUN_ROWS, RUN_BYTES = 2048, 4 << 20
#: Rows handed on at a time.
OUT = 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()

_RUNS = "part int, first binary, last binary, ids array<long>, lcps array<int>, lengths array<int>, digests binary, sizes array<int>"
_NODES = "kind int, node_id binary, parent_id binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Kinds of rows: a node of one range, a range's part of a shared node, a conversation that ends at a shared node.
WHOLE, SHARED, END = 0, 1, 2


def digest(role: Column, text: Column) -> Column:
    """The head of the SHA-256 of ``<code points of role>:<role><text>``, which tells role and text apart."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * D))


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: of each conversation its turns (key: digest, size: bytes of the text) in order."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turn = F.col(turn_col)
    narrow = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.struct(turn.isNotNull().alias("there"), F.coalesce(turn, F.lit(0)).alias("at"), digest(role, text).alias("key"), F.octet_length(text).alias("size")).alias("t")
    )
    of = narrow.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return of.select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"))).alias("turns"))


def branched(seqs: DataFrame, every: int = 5, spread: int = 9) -> DataFrame:
    """Conversation c starts with the first h turns of conversation c - c % every and goes on with its own after its first h; h = crc32(c) % spread."""
    ids = F.col("conv_id")
    heads = seqs.filter(ids % every == 0).select(ids.alias("base"), F.slice("turns", 1, max(1, spread - 1)).alias("head"))
    own = seqs.withColumns({"h": (F.crc32(ids.cast("string").cast("binary")) % spread).cast("int"), "of": ids - ids % every})
    met = own.join(heads, F.col("of") == F.col("base"), "left")
    none = F.slice("turns", 1, 0)
    head = F.when(F.col("head").isNull(), none).otherwise(F.slice("head", F.lit(1), F.col("h")))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return met.select("conv_id", F.concat(head, rest).alias("turns"))


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """How many turns two sequences start with in common, ``known`` of them without a look."""
    n = min(len(a), len(b)) // D
    while known < n and a[known * D : known * D + D] == b[known * D : known * D + D]:
        known += 1
    return known


def _run(rows: list, part: int) -> dict:
    rows.sort(key=lambda r: (r[0], r[1]))
    lcps, lengths, digests, sizes, before = [], [], [], [], b""
    for key, _, size in rows:
        k = shared_turns(before, key)
        lcps.append(k)
        lengths.append(len(key) // D - k)
        digests.append(key[k * D :])
        sizes += size[k:]
        before = key
    return {"part": part, "first": rows[0][0], "last": before, "ids": [r[1] for r in rows], "lcps": lcps, "lengths": lengths, "digests": b"".join(digests), "sizes": sizes}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held, part = [], 0, 0
    schema = pa.schema([("part", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("ids", pa.list_(pa.int64())), ("lcps", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("digests", pa.binary()), ("sizes", pa.list_(pa.int32()))])
    for b in batches:
        for i in range(b.num_rows):
            part = b.column(0)[i].as_py()
            key = b"".join(b.column(2)[i].as_py())
            rows.append((key, b.column(1)[i].as_py(), b.column(3)[i].as_py()))
            held += len(key)
            if len(rows) >= RUN_ROWS or held >= RUN_BYTES:
                yield pa.RecordBatch.from_pylist([_run(rows, part)], schema)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist([_run(rows, part)], schema)


class Cursor:
    """One run, read in order: the sequence at hand, its id, turn sizes, and its LCP with the one before."""

    __slots__ = ("run", "at", "turn", "key", "conv", "lcp", "sizes")

    def __init__(self, run: dict):
        self.run, self.at, self.turn, self.key, self.sizes = run, -1, 0, b"", []
        self.step()

    def step(self) -> None:
        self.at += 1
        r = self.run
        if self.at == len(r["ids"]):
            self.key = None
            return
        k, n = r["lcps"][self.at], r["lengths"][self.at]
        self.key = self.key[: k * D] + r["digests"][self.turn * D : (self.turn + n) * D]
        self.sizes = self.sizes[:k] + r["sizes"][self.turn : self.turn + n]
        self.turn += n
        self.conv, self.lcp = r["ids"][self.at], k


def merge(cursors: list[Cursor]) -> Iterator[tuple[bytes, int, list[int], int]]:
    """(sequence, conv_id, turn sizes, LCP with the sequence before) of all runs in order.

    A loser tree.  Every contender's ``lcp`` refers to the last winner that passed its place;
    the one that has more in common with it is the smaller.  With the same LCP the sequences
    are compared from there on, and the loser keeps what it has in common with its victor.
    """
    n = len(cursors)
    losers = [-1] * n

    def beats(a: int, b: int) -> bool:
        x, y = cursors[a], cursors[b]
        if x.key is None or y.key is None:
            return y.key is None
        if x.lcp != y.lcp:
            return x.lcp > y.lcp
        k = shared_turns(x.key, y.key, x.lcp)
        p, q = x.key[k * D : k * D + D], y.key[k * D : k * D + D]
        first = p < q or (p == q and x.conv < y.conv)
        (y if first else x).lcp = k
        return first

    for c in cursors:
        c.lcp = 0
    for i in range(n):
        at, who = (i + n) // 2, i
        while at > 0:
            if losers[at] < 0:
                losers[at], who = who, -1
                break
            if beats(losers[at], who):
                losers[at], who = who, losers[at]
            at //= 2
        if at == 0:
            losers[0] = who
    who = losers[0]
    while n and cursors[who].key is not None:
        c = cursors[who]
        yield c.key, c.conv, c.sizes, c.lcp
        c.step()
        at = (who + n) // 2
        while at > 0:
            if beats(losers[at], who):
                losers[at], who = who, losers[at]
            at //= 2


class _Open:
    """A node of the path at hand."""

    __slots__ = ("least", "convs", "children", "leaves", "saved", "hash", "ends", "size", "fresh", "parent", "rows")

    def __init__(self, size: int, fresh: bool):
        self.least, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.hash, self.ends, self.size, self.fresh, self.parent, self.rows = None, [], size, fresh, False, []


class Path:
    """The stack of open nodes.  ``before`` and ``after`` are the depths to which the paths of the neighbouring ranges reach; -1 where there is none."""

    def __init__(self, before: int, after: int):
        self.before, self.after = before, after
        self.open: list[_Open] = []
        self.key = b""
        self.rows: list[list] = []

    def _node_id(self, depth: int) -> bytes:
        return hashlib.sha256(self.key[: depth * D]).digest()

    def add(self, key: bytes, conv: int, sizes: list[int], lcp: int) -> None:
        first = not self.open
        self._close(lcp + 1)
        self.key = key
        for d in range(len(self.open), len(key) // D + 1):
            self.open.append(_Open(sizes[d - 1] if d else 0, not (first and d <= self.before)))
            if d:
                self.open[d - 1].parent = True
        top = self.open[-1]
        top.convs += 1
        top.least = conv if top.least is None else min(top.least, conv)
        if top.fresh:
            if top.hash is None:
                top.hash = hashlib.sha256(str(conv).encode())
            else:
                top.hash.update(b",%d" % conv)
        # Whether a fresh node is shared with the next range is known only when it is closed.
        if not top.fresh or len(key) // D <= self.after:
            top.ends.append(conv)

    def finish(self) -> None:
        self._close(0, last=True)

    def _close(self, keep: int, last: bool = False) -> None:
        while len(self.open) > keep:
            depth, node = len(self.open) - 1, self.open.pop()
            goes_on = last and depth <= self.after
            if not goes_on and not node.parent:
                node.leaves += 1
            node.saved += (node.convs - node.fresh) * node.size
            shared = goes_on or not node.fresh
            parent = self.open[-1] if depth else None
            for r in node.rows:
                # The parent of a node that is whole: its least id if it is whole too, else its name.
                self.rows[r][2 if shared else 5] = self._node_id(depth) if shared else node.least
            if shared:
                me = self._node_id(depth)
                self.rows.append([SHARED, me, self._node_id(depth - 1) if depth else None, node.least, depth, None, node.convs, node.children, node.leaves, node.saved, None])
                self.rows += [[END, me, None, c, depth, None, None, None, None, None, None] for c in node.ends]
            else:
                if parent is not None:
                    parent.rows.append(len(self.rows))
                self.rows.append([WHOLE, None, None, node.least, depth, None, node.convs, node.children, node.leaves, node.saved, node.hash.hexdigest() if node.hash else NO_ENDS])
            if parent is not None:
                parent.least = node.least if parent.least is None else min(parent.least, node.least)
                parent.convs += node.convs
                parent.leaves += node.leaves
                parent.saved += node.saved
                parent.children += node.fresh


def _nodes(part: int, batches: Iterator[pa.RecordBatch], borders: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    cursors = [Cursor(r) for b in batches for r in b.to_pylist()]
    path = Path(*borders[part])
    for key, conv, sizes, lcp in merge(cursors):
        path.add(key, conv, sizes, lcp)
    path.finish()
    kinds = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
    names = [x.split()[0] for x in _NODES.split(", ")]
    for i in range(0, len(path.rows), OUT):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*path.rows[i : i + OUT]), kinds)], names)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids, which come sorted by node and id; a node may go on over many batches."""
    at, h = None, None
    for b in batches:
        nodes, ids, done = b.column(0).to_pylist(), b.column(1).to_pylist(), []
        for node, conv in zip(nodes, ids):
            if node == at:
                h.update(b",%d" % conv)
                continue
            if at is not None:
                done.append((at, h.hexdigest()))
            at, h = node, hashlib.sha256(b"%d" % conv)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["node_id", "sha"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([h.hexdigest()])], ["node_id", "sha"])


def _reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, and the turns its first sequence shares with the range before and its last with the range after (-1: none there)."""
    for b in batches:
        part, first, last, before, after = (b.column(i).to_pylist() for i in range(5))
        up = [-1 if x is None else shared_turns(x, y) for x, y in zip(before, first)]
        down = [-1 if x is None else shared_turns(x, y) for x, y in zip(after, last)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(up, pa.int32()), pa.array(down, pa.int32())], ["part", "up", "down"])


def trie(seqs: DataFrame, turns_per_part: int = 20_000) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``seqs`` has conv_id (unique, never null) and turns (key, size).  A conversation without turns
    ends at the root; without conversations there is no node.  A range holds about
    ``turns_per_part`` turns.  A task holds one range, and never less than one conversation: 16
    bytes for each of its turns.  The ids of a node that lies in several ranges are hashed by one
    task, as the hash is one chain, but that task streams them.
    """
    spark: SparkSession = seqs.sparkSession
    ws = Workspace(spark, "prefix_trie")
    rows = ws.store(seqs.select("conv_id", "turns.key", "turns.size"), "sequences")
    total = rows.agg(F.sum(F.size("key") + 1)).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, -(-total // turns_per_part)), "key", "conv_id").select(F.spark_partition_id().alias("part"), "conv_id", "key", "size")
    runs = ws.store(dealt.mapInArrow(_runs, _RUNS), "runs")
    # One row a range.
    edge = runs.groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    w = Window.orderBy("part")
    edge = edge.select("part", "first", "last", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"))
    borders = {r.part: (r.up, r.down) for r in edge.mapInArrow(_reaches, "part int, up int, down int").collect()}

    def one_range(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _nodes(key[0].as_py(), batches, borders)

    nodes = ws.store(runs.groupBy("part").applyInArrow(one_range, _NODES), "nodes")
    ws.drop("sequences", "runs")
    parts = nodes.filter(F.col("kind") == SHARED).groupBy("node_id")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shared = parts.agg(F.min("parent_id").alias("parent_id"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), *sums)
    ends = nodes.filter(F.col("kind") == END).select("node_id", "conv_id")
    hashed = ends.repartition("node_id").sortWithinPartitions("node_id", "conv_id").mapInArrow(_hash_ends, "node_id binary, sha string")
    shared = ws.store(shared.join(hashed, "node_id", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS))).drop("sha"), "shared")
    whole = nodes.filter(F.col("kind") == WHOLE)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    named = shared.select(F.col("node_id").alias("p"), F.col("conv_id").alias("parent_conv_id"))
    below = whole.filter("parent_id IS NOT NULL").drop("kind", "node_id", "parent_conv_id").unionByName(shared.drop("node_id"))
    met = below.join(named, F.col("parent_id") == F.col("p"), "left")
    return whole.filter("parent_id IS NULL").select(*columns).unionByName(met.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(branched(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE = """
WITH t AS (
    SELECT conv_id, turn, coalesce(text, '') AS x, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS k
    FROM conversations WHERE conv_id IS NOT NULL
), s AS (
    SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(octet_length(encode(x)) ORDER BY turn NULLS FIRST, k) AS ns FROM t GROUP BY conv_id
), h AS (
    SELECT *, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS UBIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: CAST(i AS UBIGINT))), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), CAST(4294967295 AS UBIGINT)) % 9 AS h
    FROM s
), r AS (
    SELECT h.conv_id, list_concat(coalesce(b.ks, [])[1:h.h], h.ks[h.h + 1:]) AS ks, list_concat(coalesce(b.ns, [])[1:h.h], h.ns[h.h + 1:]) AS ns
    FROM h LEFT JOIN s b ON b.conv_id = h.base
), m AS (
    SELECT conv_id, d, ks[1:d] AS node, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n, len(ks) = d AS ends FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM r)
), n AS (
    SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM m GROUP BY node, d
), c AS (
    SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), u AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c ON c.node = n.node AND c.d = n.d
), a AS (
    SELECT node[1:above] AS node, above AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens
    FROM (SELECT *, unnest(range(d + 1)) AS above FROM u) GROUP BY ALL
)
SELECT u.conv_id, CAST(u.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(u.n_convs AS BIGINT) AS n_convs, CAST(u.n_children AS BIGINT) AS n_children,
    CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, u.ends_sha256
FROM u JOIN a ON a.node = u.node AND a.d = u.d LEFT JOIN u p ON p.node = u.node[1:u.d - 1] AND p.d = u.d - 1
"""
