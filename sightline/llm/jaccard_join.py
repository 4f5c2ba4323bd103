"""N-gram Jaccard join by parity sketches.

A document is the set of its shingles.  A sketch is a long bit vector in which every
shingle toggles one bit, so the Hamming distance of two sketches never exceeds the sets'
symmetric difference.  The threshold bounds that difference for a band of sizes; a sketch
cut into more pieces than the bound has pieces that both documents share unchanged, and
documents meet where the XOR hash of a piece is equal.  Candidates are verified on sets.

Pieces say little that have fewer than two set bits, or only shingles that very many
documents hold (known from a sample; which ones does not affect the result).  A document
with enough other pieces leaves them out, and one that hasn't enough pairs them.  No link
is lost to either: some sharper piece or some pair survives the largest difference.

Copies share one class.  In a group that shares a piece, all are compared with a hub, a
text in many groups that near copies mostly have in common.  Two members that are still
apart can only link if their differences from the hub overlap, which a prefix and position
filter on these differences finds without meeting all pairs, and if the Hamming distance
of the differences' parity sketches allows it; only then are sets loaded.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .rows import keep_chosen
from .shingles import Shingler, distinct, mix, text_chunks
from .workspace import Workspace

#: Bits of one piece of a sketch, as a power of two.
PIECE_BITS = 16
#: Members of one hub that one verification group takes.
HUB_MEMBERS = 500
#: Clashing class numbers that are settled by name: at 64 bits some tens among 5e10 sets.
MAX_CLASHES = 100_000
#: Words of 64 bits in the sketch of a difference from a hub.
SKETCH_WORDS = 8


class Bands:
    """Size bands of ratio threshold ** -2: sizes that can link are in the same band or the next."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.edges = num, den, [1]
        while self.edges[-1] < 1 << 40:
            e = self.edges[-1]
            self.edges.append(max(e + 1, -(-e * den * den // (num * num))))

    def difference(self, n: int, m: int) -> int:
        """The largest symmetric difference of linked sets of these sizes."""
        return (n + m) * (self.den - self.num) // (self.den + self.num)

    def largest(self, n: int) -> int:
        return n * self.den // self.num

    def band(self, n: int) -> int:
        import bisect

        return bisect.bisect_right(self.edges, n) - 1

    @lru_cache(maxsize=100_000)  # noqa: B019
    def groups(self, n: int) -> tuple[tuple[int, int, int, int], ...]:
        """(band, pieces, blocks, own bound) for each band in which a set of size n looks for partners.

        Of the pieces at least blocks + 1 survive the largest difference in the band, so two
        of them are in one block.
        """
        out, own = [], self.band(n)
        for g in (own, own + 1):
            if g > own and self.largest(n) < self.edges[g]:
                continue
            top = self.edges[g + 1] - 1
            if (most := self.difference(top, top)) < 1:
                continue  # linked sets of these sizes are equal, hence one class
            blocks = most // 6 + 1
            out.append((g, most + 1 + blocks, blocks, self.difference(n, min(top, self.largest(n)))))
        return tuple(out)


class Classes:
    """Class numbers of sets: 64 bits of a 128-bit signature, but for the few sets whose 64 bits clash (``names``: signature to number).

    ``bits`` is less than 64 only in tests.
    """

    def __init__(self, bits: int = 64, names: dict[tuple[int, int], int] | None = None):
        self.mask, self.names = (1 << bits) - 1, names or {}

    def signature(self, hashes: np.ndarray) -> tuple[int, int]:
        """Two sums over a set's hashes, as signed numbers."""
        a = int(np.add.reduce(mix(hashes ^ np.uint64(1)), dtype=np.uint64))
        b = int(np.add.reduce(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
        a = int(mix(np.array([(a ^ (len(hashes) * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]) & self.mask
        return tuple(x - (1 << 64) if x >> 63 else x for x in (a, b))

    def number(self, hashes: np.ndarray) -> int:
        pair = self.signature(hashes)
        return self.names.get(pair, pair[0]) if self.names else pair[0]


def clash_names(signed: DataFrame) -> dict[tuple[int, int], int]:
    """Numbers for all but the first of the signatures (ref, check) that have a ref in common; no other set has them."""
    clash = signed.groupBy("ref").agg(F.min("check").alias("c0"), F.max("check").alias("c1")).filter("c0 <> c1").select("ref")
    found = signed.join(clash, "ref", "left_semi").select("ref", "check").distinct().limit(MAX_CLASHES + 1).collect()
    if len(found) > MAX_CLASHES:
        raise RuntimeError(f"more than {MAX_CLASHES} sets with clashing class numbers")
    kept, names = set(), {}
    for ref, check in sorted(found):
        if ref in kept:
            names[ref, check] = int(mix(np.array([ref ^ check ^ 0x2545F4914F6CDD1D], np.int64).view(np.uint64)).view(np.int64)[0])
        kept.add(ref)
    if names:
        taken = signed.join(F.broadcast(signed.sparkSession.createDataFrame([(x,) for x in names.values()], "ref long")), "ref", "left_semi")
        if len(set(names.values())) < len(names) or not taken.isEmpty():
            raise RuntimeError("class numbers clash")
    return names


def sketch_keys(hashes: np.ndarray, bands: Bands, frequent: np.ndarray) -> np.ndarray:
    """The keys under which a set of shingle hashes meets its possible partners."""
    keys = []
    common = np.zeros(len(hashes), bool)
    if len(frequent):
        common = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
    for g, pieces, blocks, bound in bands.groups(len(hashes)):
        v = mix(hashes + np.uint64((g + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        piece = ((v >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
        bit = (piece << np.uint64(PIECE_BITS)) | (v & np.uint64((1 << PIECE_BITS) - 1))
        order = np.argsort(bit)
        bit, rare = bit[order], ~common[order]
        new = np.append(True, bit[1:] != bit[:-1])
        if not new.all():  # bits toggled an even number of times are clear; a bit is common if one of its shingles is
            at = np.flatnonzero(new)
            odd = np.diff(np.append(at, len(bit))) % 2 == 1
            bit, rare = bit[at][odd], np.logical_and.reduceat(rare, at)[odd]
        where = (bit >> np.uint64(PIECE_BITS)).astype(np.int64)
        set_bits = np.bincount(where, minlength=pieces)
        telling = (set_bits >= 2) & (np.bincount(where[rare], minlength=pieces) >= 1)
        base = np.uint64((g << 40) & 0xFFFFFFFFFFFFFFFF)
        codes = mix(bit + (base + np.uint64(1 << 39)))
        sums = np.zeros(pieces, np.uint64)
        if len(where):
            starts = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
            sums[where[starts]] = np.bitwise_xor.reduceat(codes, starts)
        whole = mix(sums ^ mix(np.arange(pieces, dtype=np.uint64) + base))
        keys.append(whole[telling])
        if len(keys[-1]) < bound + 1:
            dull = np.flatnonzero(~telling)
            for block in range(blocks):
                own = whole[dull[dull % blocks == block]]
                i, j = np.triu_indices(len(own), 1)
                keys.append(mix(own[i] * np.uint64(3) + mix(own[j])))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _signature_batches(batches, width: int, bits: int):
    shingler, classes = Shingler(width), Classes(bits)
    for batch in batches:
        n, refs, checks = [], [], []
        for _, texts in text_chunks(batch.column(2)):
            for s in shingler.sequences(texts):
                u = distinct(s)
                ref, check = classes.signature(u)
                n.append(len(u))
                refs.append(ref)
                checks.append(check)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in (n, refs, checks)]], names=["doc_id", "tid", "n", "ref", "check"])


def _shingle_batches(batches, width: int):
    shingler = Shingler(width)
    for batch in batches:
        for _, texts in text_chunks(batch.column(0)):
            sets = [distinct(s) for s in shingler.sequences(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["shingle"])


def frequent_shingles(base: DataFrame, width: int, rows: int, share: float) -> np.ndarray:
    """Shingles in at least ``share`` of about ``rows`` texts drawn by hash: a bounded, sorted table.

    At most the mean number of shingles over ``share``, whatever the input.
    """
    total = max(base.count(), 1)
    drawn = base.select("text").filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < min(1_000_000, 1_000_000 * rows // total))
    counts = drawn.mapInArrow(lambda it: _shingle_batches(it, width), "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    found = counts.filter(F.col("n") >= max(20, int(share * min(rows, total)))).select("shingle").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _key_batches(batches, width: int, num: int, den: int, held):
    shingler, bands, done = Shingler(width), Bands(num, den), set()
    frequent, classes = held.value
    for batch in batches:
        for _, texts in text_chunks(batch.column(0)):
            keys, refs, sizes = [], [], []
            for s in shingler.sequences(texts):
                u = distinct(s)
                ref = classes.number(u)
                if ref in done:  # a copy in this task
                    continue
                done.add(ref)
                own = sketch_keys(u, bands, frequent) if len(u) else u
                if len(own):
                    keys.append(own)
                    refs.append(ref)
                    sizes.append(len(u))
            if keys:
                spans = [len(x) for x in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(refs, np.int64), spans)), pa.array(np.repeat(np.array(sizes, np.int32), spans))],
                    names=["key", "ref", "n"],
                )


def _set_batches(batches, width: int, held):
    shingler, classes = Shingler(width), held.value[1]
    for batch in batches:
        for first, texts in text_chunks(batch.column(1)):
            refs, sets = [], []
            wanted = batch.column(0)[first : first + len(texts)].to_pylist()
            for want, s in zip(wanted, shingler.sequences(texts)):
                u = distinct(s)
                if classes.number(u) == want:
                    refs.append(want)
                    sets.append(u.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(sets, pa.binary())], names=["ref", "items"])


def _by_hub(batches):
    """(hub, hub's set, member, member's set, member's label) of rows that come by hub, the hub itself first."""
    group, base = None, None
    for batch in batches:
        items = batch.column("items")
        columns = [batch.column(x).to_pylist() for x in ("a", "salt", "member", "ref", "label")]
        for k, (hub, salt, member, ref, label) in enumerate(zip(*columns)):
            own = np.frombuffer(items[k].as_buffer(), np.uint64)
            if not member:
                group, base = (hub, salt), own.copy()
            elif group == (hub, salt):
                yield hub, base, ref, own, label


def _verify_batches(batches, num: int, den: int):
    left, right = [], []
    for hub, base, ref, own, _ in _by_hub(batches):
        merged = np.concatenate([base, own])
        merged.sort()
        common = int((merged[1:] == merged[:-1]).sum())
        if common * den >= num * (len(merged) - common):
            left.append(hub)
            right.append(ref)
    yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def difference_sketch(items: np.ndarray) -> np.ndarray:
    """Parity sketch of a difference from a hub: what two of them differ in is the sketch of what the two sets differ in."""
    bit = (mix(items) >> np.uint64(32)) % np.uint64(64 * SKETCH_WORDS)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * SKETCH_WORDS) % 2 == 1
    return np.packbits(odd).view(np.int64)


_DIFFERENCES = [("hub", pa.int64()), ("ref", pa.int64()), ("c", pa.int64()), ("item", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("n", pa.int32()), ("short", pa.bool_())]
_DIFFERENCES += [(f"s{i}", pa.int64()) for i in range(SKETCH_WORDS)]


def _difference_batches(batches, num: int, den: int):
    """Of each member's difference from the hub the first elements: those the hub lacks, then those it has alone, by hash.

    Linked sets x and y differ by at most k, so do their differences from the hub; if these
    share c elements, c >= (|x| + |y| - k) / 2 >= |x| - k, and prefixes of k + 1 meet.  For
    the smaller of two, c >= |y| - k / 2, so of its prefix k / 2 + 1 elements do (``short``).
    """
    bands = Bands(num, den)
    columns = [[] for _ in _DIFFERENCES]
    rows = 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], kind) for c, (_, kind) in zip(columns, _DIFFERENCES)], names=[name for name, _ in _DIFFERENCES])

    for hub, base, ref, own, label in _by_hub(batches):
        added, lost = np.setdiff1d(own, base, assume_unique=True), np.setdiff1d(base, own, assume_unique=True)
        both = np.concatenate([added, lost])
        size, n = len(both), len(own)
        most = bands.difference(n, bands.largest(n))
        first = both[: most + 1]
        at = np.arange(len(first))
        values = [hub, ref, label, first.view(np.int64), at, size, n, at <= most // 2, *difference_sketch(both)]
        for c, v in zip(columns, values):
            c.append(v if isinstance(v, np.ndarray) else np.full(len(first), v))
        rows += len(first)
        if rows > 200_000:
            yield batch()
            columns, rows = [[] for _ in _DIFFERENCES], 0
    yield batch()


def with_hubs(pairs: DataFrame, sets: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """Rows (a, salt, member, ref, label, items) by hub a, the hub first; hubs with many partners are split by salt.

    ``pairs`` (a, b, and cb, the label of b, if there is one) is a written table, and salts
    are written first, so that the join by hub can split a hot one.
    """
    label = F.col("cb") if "cb" in pairs.columns else F.lit(None).cast("long")
    salts = ws.store(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_MEMBERS).cast("int").alias("salts")), f"{name}_salts")
    salted = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    members = salted.select("a", "salt", F.lit(1).alias("member"), F.col("b").alias("ref"), label.alias("label"))
    hubs = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("a").alias("ref"), F.lit(None).cast("long").alias("label"))
    rows = members.unionByName(hubs).join(sets, "ref").select("a", "salt", "member", "ref", "label", "items")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "member")


def verify(pairs: DataFrame, sets: DataFrame, ws: Workspace, name: str, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets (ref, items) link."""
    return with_hubs(pairs, sets, ws, name).mapInArrow(lambda it: _verify_batches(it, num, den), "a long, b long")


def differences(pairs: DataFrame, sets: DataFrame, ws: Workspace, name: str, num: int, den: int) -> DataFrame:
    """(hub, ref, c, item, at, size, n, short, s0, ...): the prefix of each partner's difference from its hub, the difference's size and its sketch."""
    schema = "hub long, ref long, c long, item long, at int, size int, n int, short boolean, " + ", ".join(f"s{i} long" for i in range(SKETCH_WORDS))
    return with_hubs(pairs, sets, ws, name).mapInArrow(lambda it: _difference_batches(it, num, den), schema)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100, sample_rows: int = 8_000, frequent_share: float = 0.005, class_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_id, linked, tid, component.

    Two documents link when den * |A & B| >= num * |A | B| over their shingle sets;
    ``component_id`` is the smallest doc_id reachable by links.  ``class_id`` numbers
    equal sets, ``linked`` tells that the component has more than one row, ``tid`` is a
    hash of the text and ``component`` the component's number (null without shingles).

    A null text is empty; a text without words has no shingles and is linked with
    nothing.  Rows with a null id take part; a component's id is null only if it has no
    other id.  Repeated rows are copies of each other.  An empty table gives an empty
    result.  Other columns of ``docs`` are not read.  Shingles are known by 64-bit hashes;
    sets are equal when 128 bits are, and class numbers of 64 bits that clash are told
    apart (more than ``MAX_CLASHES`` raise an error).  ``class_bits`` is for tests.
    ``sample_rows`` and ``frequent_share`` steer only how much work is done.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard_join")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), *[T.StructField(x, T.LongType()) for x in ("tid", "n", "ref", "check")]])
    tid = F.xxhash64("text", F.col("text").isNull())
    signed = base.select("doc_id", tid.alias("tid"), "text").mapInArrow(lambda it: _signature_batches(it, width, class_bits), schema)
    signed = ws.store(signed, "signatures")
    names = clash_names(signed)
    if names:
        renamed = spark.createDataFrame([(*k, v) for k, v in names.items()], "r long, c long, named long")
        signed = signed.join(F.broadcast(renamed), (F.col("ref") == F.col("r")) & (F.col("check") == F.col("c")), "left").withColumn("ref", F.coalesce("named", "ref")).select("doc_id", "tid", "n", "ref", "check")
    # Bounded by shingles a text over the share, see frequent_shingles, and by MAX_CLASHES.
    held = spark.sparkContext.broadcast((frequent_shingles(base, width, sample_rows, frequent_share), Classes(class_bits, names)))
    emitted = base.select("text").filter("text IS NOT NULL").mapInArrow(lambda it: _key_batches(it, width, num, den, held), "key long, ref long, n int")
    emitted = ws.store(emitted, "emitted")
    shared = emitted.groupBy("key").agg(F.min("ref").alias("r0"), F.max("ref").alias("r1")).filter("r0 <> r1").select("key")
    shared = ws.store(shared, "shared_keys")
    # The join by key is written as it is, so that hot keys can be split; copies in different tasks say the same twice.
    members = ws.store(ws.store(emitted.join(shared, "key"), "met").distinct(), "members")
    ws.drop("shared_keys", "emitted", "met")

    wanted = members.select("ref").distinct()
    first = signed.join(wanted, "ref").groupBy("ref").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("tid"))).alias("r")).select("ref", F.col("r.doc_id").alias("r_id"), F.col("r.tid").alias("r_tid"))
    texts = base.withColumn("tid", tid).join(first, (F.col("tid") == F.col("r_tid")) & F.col("doc_id").eqNullSafe(F.col("r_id")))
    sets = ws.store(texts.select("ref", "text").mapInArrow(lambda it: _set_batches(it, width, held), "ref long, items binary"), "sets")

    # A group's hub is its member in most groups, or what such a member has itself as hub: of
    # near copies most likely what they were copied from, so that their groups have one hub in common.
    degree = ws.store(members.groupBy("ref").agg(F.count(F.lit(1)).alias("degree")), "degree")
    ranked = members.join(degree, "ref")
    own = ranked.groupBy("key").agg(F.max(F.struct("degree", "ref")).alias("h"))
    above = ws.store(members.join(own, "key").groupBy("ref").agg(F.max("h").alias("h")), "above")
    hubs = ws.store(members.join(above, "ref").groupBy("key").agg(F.max("h").alias("h")).select("key", F.col("h.ref").alias("a")), "hubs")
    stars = members.select("key", F.col("ref").alias("b")).join(hubs, "key").filter("a <> b").select("a", "b").distinct()
    stars = ws.store(stars, "stars")
    ws.drop("members", "degree", "above", "hubs")

    def labelled(x: DataFrame, col: str, to: str, label: DataFrame) -> DataFrame:
        return x.join(label.select(F.col("node").alias(col), F.col("component").alias(to)), col, "left").withColumn(to, F.coalesce(to, col))

    links = ws.store(verify(stars, sets, ws, "stars", num, den), "links1")
    found = ws.store(components(links, ws, "comp1_"), "components1")

    # Hubs whose partners aren't all in one component, and of these partners the pairs that may link.
    placed = ws.store(labelled(stars, "b", "cb", found), "placed")
    split = placed.groupBy("a").agg(F.min("cb").alias("c0"), F.max("cb").alias("c1")).filter("c0 <> c1").select("a")
    parted = ws.store(placed.join(split, "a", "left_semi"), "parted")
    apart = ws.store(differences(parted, sets, ws, "parted", num, den), "differences")
    x, y = apart.alias("x"), apart.alias("y")
    most = F.floor((F.col("x.n") + F.col("y.n")) * (den - num) / (den + num))
    need = F.ceil((F.col("x.size") + F.col("y.size") - most) / 2)
    left = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    # The larger difference meets the smaller, whose prefix is half as long.
    larger = (F.col("x.size") > F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.ref") < F.col("y.ref")))
    hamming = reduce(add, [F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(SKETCH_WORDS)])
    near = (F.col("x.c") != F.col("y.c")) & larger & F.col("y.short") & (F.col("x.size") - F.col("y.size") <= most) & (F.abs(F.col("x.n") - F.col("y.n")) <= most) & (left >= need) & (hamming <= most)
    across = x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.item") == F.col("y.item")) & near).select(F.col("x.ref").alias("a"), F.col("y.ref").alias("b")).distinct()
    across = ws.store(across, "across")
    if not across.isEmpty():
        links = ws.store(links.unionByName(verify(across, sets, ws, "last", num, den)), "links2")
        found = ws.store(components(links, ws, "comp2_"), "components2")
    ws.drop("placed", "parted", "differences", "across", "stars", "sets")

    rows = labelled(signed, "ref", "component", found)
    least = rows.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    out = rows.filter("n > 0").join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("ref").alias("class_id"), (F.col("rows") > 1).alias("linked"), "tid", "component")
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("ref").alias("class_id"), F.lit(False).alias("linked"), "tid", F.lit(None).cast("long").alias("component"))
    return out.unionByName(empty)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, but of each component only that with the smallest id (null ids come last).

    Rows without shingles all stay.  Of rows equal in id and text one stays.
    """
    found = Workspace(docs.sparkSession, "keep_one").store(jaccard_components(docs, id_col, text_col, **options).select("doc_id", "tid", "component"), "decided")
    order = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("tid"))
    best = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias("id"), F.col("x.tid").alias("tid"))
    # How often a chosen row occurs: counted by component with the choice known, so that copies combine map-side.
    times = found.filter("component IS NOT NULL").groupBy(F.col("doc_id").alias("d"), F.col("tid").alias("t")).agg(F.count(F.lit(1)).alias("times"))
    chosen = best.join(times, (F.col("tid") == F.col("t")) & F.col("id").eqNullSafe(F.col("d"))).select("id", "tid", "times")
    empty = found.filter("component IS NULL").select(F.col("doc_id").alias("id"), "tid").distinct().withColumn("times", F.lit(1).cast("long"))
    return keep_chosen(docs, chosen.unionByName(empty), id_col, text_col)


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
