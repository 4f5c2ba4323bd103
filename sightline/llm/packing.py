"""Best-fit packing with bound-certified repacking.

Documents become token ids and pieces of at most ``capacity`` ids.  The pieces
shorter than that are dealt to partitions, to all the same mix of lengths, each of which runs best-fit
decreasing and compares its bin count with dual-feasible-function lower bounds.
A partition that reaches its bound is certified and done; the documents of the
others' bins that are not full are exchanged (dealt anew, to fewer partitions)
and packed again, with the least filled bin of each certified partition.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace

#: Token strings that a worker remembers before it starts afresh.
CACHE = 500_000


#: Characters of text that a task holds as separate words at a time, unless one text is longer.
CHUNK = 1 << 20
#: Latin letters, then ASCII punctuation: such a word is one run of letters and one of symbols to the tokenizer.
PLAIN_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")
#: The set-up for which words may be cut so (see :class:`WordEncoder`).
PLAIN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PLAIN_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordEncoder:
    """Ids of single words, remembered, by a tokenizer that drops white space.

    The tokenizer's normalizer and pre-tokenizer take most of its time.  If they are the
    usual lower-casing ones, a word of Latin letters and trailing punctuation goes to the
    tokenizer's model directly, as its two runs; all other words take the whole way.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            setup = json.load(f)
        normalizers = [x["type"] for x in (setup.get("normalizer") or {}).get("normalizers", [])]
        steps = (setup.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.plain = normalizers == PLAIN_NORMALIZERS and steps[0].get("pattern") == {"Regex": PLAIN_PATTERN} and [x["type"] for x in steps] == ["Split", "ByteLevel"] and not steps[1].get("add_prefix_space", True)
        self.cache, self.known, self.marks = cache, {"": b""}, {}
        self.packs = [struct.Struct(f"<{n}I").pack for n in range(63)]
        # Byte-level models spell a byte as the character of its code, or of 256 and up for those without a shape.
        shapeless = [c for c in range(256) if not (33 <= c <= 126 or 161 <= c <= 172 or c >= 174)]
        self.spelling = {c: 256 + i for i, c in enumerate(shapeless)}

    def _run(self, run: str) -> bytes:
        spelled = run if run.isascii() else run.encode().decode("latin-1").translate(self.spelling)
        found = [t.id for t in self.tokenizer.model.tokenize(spelled)]
        return self.packs[len(found)](*found) if len(found) < 63 else np.array(found, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > self.cache:
            self.known, self.marks = {"": b""}, {}
        rest, known, ends, fits = [], self.known, self.marks, PLAIN_WORD.fullmatch
        for w in words - known.keys():
            if self.plain and (m := fits(w)):
                letters, marks = m.groups()
                letters = letters.lower()
                # A run of small letters is a word of its own.
                if (ids := known.get(letters)) is None:
                    ids = known[letters] = self._run(letters)
                if marks:
                    if (end := ends.get(marks)) is None:
                        end = ends[marks] = self._run(marks)
                    known[w] = ids + end
                else:
                    known[w] = ids
            else:
                rest.append(w)
        for i in range(0, len(rest), 5000):
            for w, e in zip(rest[i : i + 5000], self.tokenizer.encode_batch(rest[i : i + 5000], add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        # White space is dropped and never joins two words, so cutting at it changes no id.
        split = [x.replace("\n", " ").split(" ") for x in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def _piece_batches(batches, path: str, capacity: int, end_id: int, cache: int):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder, end = WordEncoder(path, cache), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        texts = batch.column(2)
        at = 0
        while at < len(texts):
            first, some, size = at, [], 0
            while at < len(texts) and size < CHUNK:
                some.append(texts[at].as_py() or "")
                size, at = size + len(some[-1]), at + 1
            rows, numbers, starts, ids = [], [], [], []
            for row, whole in enumerate(encoder.encode(some), first):
                whole += end
                for k, start in enumerate(range(0, len(whole), 4 * capacity)):
                    rows.append(row)
                    numbers.append(k)
                    starts.append(start // 4)
                    ids.append(whole[start : start + 4 * capacity])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(pa.array(rows, pa.int64())) for i in (0, 1)), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "seq", "piece", "start", "length", "ids"],
            )


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE, order: Column | None = None) -> DataFrame:
    """doc_id, seq, piece, start, length, ids (little-endian unsigned 32-bit) of every document, cut at ``capacity`` ids.

    A null or empty text has the end id alone.  ``tokenizer_path`` is a file of
    the ``tokenizers`` library whose pre-tokenizer drops white space; ``cache`` is how
    many words a task remembers.  ``seq`` is the document's place by ``order``, null without.
    """
    seq = F.lit(None) if order is None else order
    base = docs.select(F.col(id_col).alias("doc_id"), seq.cast("long").alias("seq"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType
    schema = T.StructType().add("doc_id", kind).add("seq", "long").add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary")
    return base.mapInArrow(lambda it: _piece_batches(it, tokenizer_path, capacity, end_id, cache), schema)


def stored_order(docs: DataFrame) -> Column | None:
    """The place of a row in the table that ``docs`` reads: number of its file, then row; None if it reads no Spark-written files."""
    if not any("/part-" in f for f in docs.inputFiles()[:1]):
        return None
    file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    return file * (1 << 40) + F.col("_metadata.row_index")


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The best of two families of dual feasible functions over a histogram of sizes."""
    if not len(sizes):
        return 0
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    best = -(-int((sizes * counts).sum()) // capacity)
    order = np.argsort(sizes)
    s, c = sizes[order], counts[order]
    n_up, w_up = np.append(np.cumsum(c[::-1])[::-1], 0), np.append(np.cumsum((s * c)[::-1])[::-1], 0)
    cut = np.unique(np.append(s[s <= capacity // 2], 1))
    # u: sizes over capacity - cut count as a whole bin, those under cut as nothing.
    low, high = np.searchsorted(s, cut), np.searchsorted(s, capacity - cut, side="right")
    best = max(best, int((-(-(n_up[high] * capacity + w_up[low] - w_up[high]) // capacity)).max()))
    for k in range(1, 21):
        whole = (s * (k + 1)) % capacity == 0
        scaled = np.where(whole, s * k, ((s * (k + 1)) // capacity) * capacity)  # in units of capacity * k
        best = max(best, -(-int((scaled * c).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins; ties go by position."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    rooms, used = 0, 0  # bit r: some bin has r free
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
        else:
            room, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            open_at[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, used


_PLAN = "uid long, length long, seq long, part long, bin long, offset long, n_bins long, bound long, open boolean"


def _packer(capacity: int):
    def pack_one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uid", ignore_index=True)
        sizes = frame["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
        bound = lower_bound(*np.unique(sizes, return_counts=True), capacity)
        given = fill < capacity if n > bound else np.arange(n) == fill.argmin()
        return frame.assign(bin=bins, offset=offsets, n_bins=n, bound=bound, open=(given & (fill < capacity))[bins])[[x.split()[0] for x in _PLAN.split(", ")]]

    return pack_one


#: Items of one length that one task may number.
PER_BUCKET = 100_000


def _histogram(items: DataFrame) -> list:
    """(length, count) in order of length, at most one row for every length below a sequence's."""
    return sorted(tuple(r) for r in items.groupBy("length").count().collect())


def deal(pool: DataFrame, histogram: list, parts: int, k: int, ordered: bool = False) -> DataFrame:
    """``pool`` with part: items in order of length are dealt in turn, so all parts get the same mix of lengths.

    ``ordered``: a part is a range of ``seq`` instead.  Items of one length are numbered in buckets of about PER_BUCKET, in an order that ``k`` changes.
    """
    if parts == 1:
        return pool.withColumn("part", F.lit(0).cast("long"))
    if ordered:
        return pool.repartitionByRange(parts, "seq", "uid").withColumn("part", F.spark_partition_id().cast("long"))
    rows, at = [], 0
    for length, n in histogram:
        rows.append((length, at, -(-n // PER_BUCKET)))
        at += n
    # One row for every length below a sequence's.
    of = F.broadcast(pool.sparkSession.createDataFrame(rows, "of_length long, first long, buckets long"))
    marked = pool.withColumn("key", F.xxhash64("uid", F.lit(k))).join(of, F.col("length") == F.col("of_length")).withColumn("bucket", F.pmod("key", "buckets"))
    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy("key", "uid"))
    # Buckets of one length start apart from each other by a hash, lengths where the one before ended.
    start = F.col("first") + F.when(F.col("bucket") > 0, F.pmod(F.xxhash64("length", "bucket"), F.lit(parts))).otherwise(0)
    return marked.select("uid", "length", "seq", F.pmod(start + rank, F.lit(parts)).cast("long").alias("part"))


def plan(items: DataFrame, capacity: int = 4096, per_part: int = 50_000, rounds: int = 8, ordered: bool = False) -> DataFrame:
    """(uid, sequence_id, offset, certified) for items (unique uid, length <= capacity, seq).

    ``ordered``: a packing task gets a range of ``seq``, and its sequences are numbered after
    those of earlier ranges; what an exchange deals anew comes last.

    ``per_part`` bounds the items of one packing task.  A partition whose number of bins
    equals its lower bound is certified: its bins are final, but for the least filled one.
    Partitions with a gap give back all bins that aren't full.  What was given back is
    dealt anew to fewer partitions and packed again, until the bound of the whole is
    reached, an exchange on one partition wins nothing, or ``rounds`` deals were made; the
    plan is whole after each of them.  ``certified`` tells that the item's last partition
    reached its own bound.  No rows give no rows.
    """
    spark = items.sparkSession
    ws = Workspace(spark, "packing_plan")
    full = items.filter(F.col("length") >= capacity).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    items = items if "seq" in items.columns else items.withColumn("seq", F.lit(None).cast("long"))
    pool, final = items.filter(F.col("length") < capacity).select("uid", "length", "seq"), [full]
    histogram = _histogram(pool)
    goal = lower_bound(np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], np.int64), capacity)
    n, closed, old, was_open = sum(r[1] for r in histogram), 0, None, None
    for k in range(rounds):
        parts = max(1, math.ceil(n / per_part))
        packed = ws.store(deal(pool, histogram, parts, k, ordered).groupBy("part").applyInPandas(_packer(capacity), _PLAN), f"round{k}")
        named = packed.withColumn("sequence_id", F.lit(k).cast("long") * (1 << 56) + F.col("part") * (1 << 32) + F.col("bin"))
        tops = packed.groupBy("part").agg(F.max("n_bins").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if was_open is not None and tops >= was_open:  # the exchange won nothing: the plan before stays, another deal may win
            ws.drop(f"round{k}")
            if parts == 1:
                break
            continue
        if old is not None:
            final[-1] = old.filter(~F.col("open"))
        final.append(named)
        stats = packed.filter("open").agg(F.count(F.lit(1)), F.count_distinct("part", "bin")).first()
        closed += tops - stats[1]
        old, n, was_open, pool = named, stats[0], stats[1], packed.filter("open").select("uid", "length", "seq")
        histogram = _histogram(pool)
        if closed + was_open <= goal or was_open < 2:
            break
    out = final[0]
    for x in final[1:]:
        out = out.unionByName(x.select("uid", "sequence_id", "offset", (F.col("n_bins") == F.col("bound")).alias("certified")) if "n_bins" in x.columns else x)
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", per_part: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset, certified for every piece of every document.

    Null and empty texts are documents of the end id alone; texts longer than a
    sequence are cut into full pieces and a rest.  Repeated rows and ids are
    packed as the separate rows they are.  An empty table gives an empty result.
    Other columns of ``docs`` are not read.
    """
    ws = Workspace(docs.sparkSession, "packing")
    cut = ws.store(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col).drop("seq").withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return cut.join(plan(cut.select("uid", "length"), capacity, per_part), "uid")


def digest(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """:func:`pack` with ids_crc32 in place of the ids, which stay in the table of pieces.

    With ``order``, a column of the documents' order, sequences follow it by ranges of ``per_part`` pieces.
    """
    capacity, per_part = options.pop("capacity", 4096), options.pop("per_part", 50_000)
    ws = Workspace(docs.sparkSession, "packing")
    cut = ws.store(pieces(docs, tokenizer_path, capacity, **options).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    narrow = cut.select("uid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    ordered = options.get("order") is not None
    return narrow.join(plan(cut.select("uid", "length", "seq"), capacity, per_part, ordered=ordered), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
