"""Personal data and the terms that give it away: information-theoretic sanitisation.

E-mail addresses, IP addresses, card and phone numbers are found by pattern in every whole
text.  Each distinct value is a protected entity.  The corpus then tells how much a term
discloses of an entity: with probabilities as shares of documents, the pointwise mutual
information PMI(e; t) = log2 p(e, t) / (p(e) p(t)) of an entity and a term that stands near it
is at most IC(e) = -log2 p(e), and what is missing, IC(e) - PMI(e; t) = -log2 p(e | t), is the
doubt that a reader of the term is left with.  A term that leaves too little is removed; one
that leaves little, and discloses more than the entity's own generalisation (domain, network,
issuer, area) would, is replaced by its shape.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

KINDS = ("email", "ip", "card", "phone")
ACTIONS = ("removed", "general")

# The patterns of the four kinds, in forms that look at no character twice.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: A term: letters and digits, three at least.
_TERM = re.compile(r"[^\W_]{3,}")
#: Places of the filter for terms, and words that a task remembers.
PLACES, CACHE = 1 << 22, 200_000
#: Terms that a task counts before it hands its counts on.
HELD = 100_000


def _emails(text: str) -> list[tuple[int, int]]:
    out, left, at = [], 0, text.find("@")
    while at >= 0:
        before = text[left:at]
        start = left + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        left = m.end() if m else at + 1
        at = text.find("@", left)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def find(text: str) -> list[list[tuple[int, int]]]:
    """Of each kind the places (start, end) in order."""
    ip = [m.span() for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    card = [(s, e) for s, e in (m.span() for m in _CARD.finditer(text)) if e - s >= 16 and 16 <= len(d := _digits(text[s:e])) <= 19 and _luhn(d)]
    phone = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15] if "+" in text else []
    return [_emails(text), ip, card, phone]


def spell(kinds, spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, of in zip(kinds, spans) for s, e in of)


def entity(kind: int, value: str) -> tuple[str, str]:
    """The value in its normal form, and what is left of it when generalised."""
    if kind == 0:
        low = value.lower()
        return low, low.partition("@")[2]
    if kind == 1:
        parts = [p.lstrip("0") or "0" for p in value.split(".")]
        return ".".join(parts), ".".join(parts[:2])
    d = _digits(value)
    return d, d[:6] if kind == 2 else d[: max(1, len(d) - 6)]


def _key(x: str) -> bytes:
    return hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest()[:16]


def _outside(text: str, spans) -> list[tuple[int, int]]:
    """The terms of a text that don't touch a span."""
    taken = sorted(x for of in spans for x in of)
    out, i, end = [], 0, 0
    for m in _TERM.finditer(text):
        s, e = m.span()
        while i < len(taken) and taken[i][0] < e:
            end, i = max(end, taken[i][1]), i + 1
        if s >= end:
            out.append((s, e))
    return out


def mentions(text: str, spans, reach: int) -> list[dict]:
    """Each place of an entity: entity, general, window (of words around it), terms (in the window)."""
    if not any(spans):
        return []
    terms, out = _outside(text, spans), []
    starts = [s for s, _ in terms]
    for kind, of in enumerate(spans):
        for s, e in of:
            at, to = bisect_left(starts, s), bisect_left(starts, e)
            near = [text[a:b].lower() for a, b in terms[max(0, at - reach) : at] + terms[to : to + reach]]
            value, general = entity(kind, text[s:e])
            out.append({"entity": _key(f"{kind}:{value}"), "general": _key(f"{kind}:{general}"), "window": _key(" ".join(near)), "terms": list(dict.fromkeys(near))})
    return out


_MENTION = pa.list_(pa.struct([("entity", pa.binary()), ("general", pa.binary()), ("window", pa.binary()), ("terms", pa.list_(pa.string()))]))
_BASE = "key binary, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base_spans string, mentions array<struct<entity:binary,general:binary,window:binary,terms:array<string>>>"


def _base(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Adds to the ids of a batch (all columns but the text, which is the last) what the patterns find."""
    for b in batches:
        rows = []
        for t in b.column(b.num_columns - 1):
            text = t.as_py() or ""
            spans = find(text)
            said = spell(KINDS, spans)
            rows.append((_key(text), *map(len, spans), hashlib.sha256(said.encode()).hexdigest(), said, mentions(text, spans, reach)))
        kinds = [pa.binary(), *[pa.int64()] * 4, pa.string(), pa.string(), _MENTION]
        cols = list(zip(*rows)) if rows else [[]] * len(kinds)
        names = [x.split()[0] for x in _BASE.split(", ")]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(cols, kinds))], [*b.schema.names[:-1], *names])


def _place(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % PLACES).cast("int")


def _filter(terms: DataFrame) -> np.ndarray | None:
    """A filter of fixed size that lets through every one of the terms (column t) and few others; None without terms."""
    # At most PLACES numbers, however many terms there are.
    found = terms.select(_place(F.col("t")).alias("p")).distinct().toArrow().column(0).to_numpy()
    if not len(found):
        return None
    bits = np.zeros(PLACES, bool)
    bits[found] = True
    return np.packbits(bits)


class _Sieve:
    """Whether a word may be one of the terms."""

    def __init__(self, packed: np.ndarray):
        self.bits, self.known = np.unpackbits(packed).tobytes(), {}

    def __call__(self, word: str) -> bool:
        k = self.known.get(word)
        if k is None:
            if len(self.known) >= CACHE:
                self.known = {}
            k = self.known[word] = bool(self.bits[zlib.crc32(word.encode("utf-8", "surrogatepass")) % PLACES])
        return k


def _count(batches: Iterator[pa.RecordBatch], packed: np.ndarray) -> Iterator[pa.RecordBatch]:
    sieve, counts = _Sieve(packed), Counter()

    def told():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["t", "n"])

    for b in batches:
        for t in b.column(0):
            counts.update(filter(sieve, set(_TERM.findall((t.as_py() or "").lower()))))
            if len(counts) >= HELD:
                yield told()
                counts = Counter()
    if counts:
        yield told()


def _places(batches: Iterator[pa.RecordBatch], packed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """key, t, start, stop of the terms that may be flagged, outside what the patterns found."""
    sieve = _Sieve(packed)
    for b in batches:
        rows = []
        for v in b.column(0):
            text = v.as_py() or ""
            if not any(map(sieve, set(_TERM.findall(text.lower())))):
                continue
            key = _key(text)
            for s, e in _outside(text, find(text)):
                word = text[s:e].lower()
                if sieve(word):
                    rows.append((key, word, s, e))
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.string(), pa.int64(), pa.int64()))], ["key", "t", "start", "stop"])


def disclosing_terms(base: DataFrame, texts: DataFrame, support: int, remove_bits: float, general_bits: float) -> DataFrame:
    """t, action: the terms that disclose an entity, by the counts of the whole corpus.

    ``base`` is the table of mentions, ``texts`` has one column.  Counted are documents: with the
    entity, with the term, and with the term in reach of the entity.  ``support`` is how many
    different windows must show the two together; copies of a text show one.
    """
    spark, docs = base.sparkSession, base.count()
    m = base.filter(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    # An entity with fewer windows can't have a term with support.
    often = m.groupBy("entity").agg(F.count_distinct("window").alias("w"), F.count_distinct("row").alias("n_e")).filter(F.col("w") >= support).drop("w")
    general = m.groupBy("general").agg(F.count_distinct("row").alias("n_g"))
    near = m.join(often, "entity").select("entity", "general", "n_e", "row", "window", F.explode("terms").alias("t"))
    pairs = near.groupBy("entity", "general", "n_e", "t").agg(F.count_distinct("row").alias("n_et"), F.count_distinct("window").alias("w")).filter(F.col("w") >= support)
    ws = Workspace(spark, "pii_terms")
    pairs = ws.store(pairs.join(general, "general").drop("w", "general"), "pairs")
    packed = _filter(pairs.select("t"))
    counts = texts.limit(0).select(F.lit("").alias("t"), F.lit(0).cast("long").alias("n"))
    if packed is not None:
        sent = spark.sparkContext.broadcast(packed)
        counts = texts.mapInArrow(lambda it: _count(it, sent.value), "t string, n long")
    known = pairs.join(counts.groupBy("t").agg(F.sum("n").alias("n_t")), "t")
    doubt = -F.log2(F.col("n_et") / F.col("n_t"))
    told = F.log2(F.lit(float(docs)) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    may_tell = -F.log2(F.col("n_g") / F.lit(float(docs)))
    action = F.when(doubt <= remove_bits, ACTIONS[0]).when((doubt <= general_bits) & (told > may_tell), ACTIONS[1])
    decided = known.select("t", action.alias("action")).filter("action IS NOT NULL")
    # Removal, the later in the alphabet, wins where entities differ.
    return ws.store(decided.groupBy("t").agg(F.max("action").alias("action")), "terms")


def _prepared(docs: DataFrame, text_col: str, reach: int, support: int, remove_bits: float, general_bits: float, ids: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(base row by row, extra spans by text): the second has key, spans, for texts that have any."""
    spark = docs.sparkSession
    ws = Workspace(spark, "pii")
    text = F.col(text_col).cast("string")
    picked = docs.select(F.monotonically_increasing_id().alias("row"), *ids, text.alias("__sl_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[:-1])
    base = ws.store(picked.mapInArrow(lambda it: _base(it, reach), f"{fields}, {_BASE}"), "base")
    texts = docs.select(text.alias("__sl_text"))
    terms = disclosing_terms(base, texts, support, remove_bits, general_bits)
    packed = _filter(terms)
    if packed is None:
        return base, base.limit(0).select("key", F.lit("").alias("spans"))
    sent = spark.sparkContext.broadcast(packed)
    hits = texts.mapInArrow(lambda it: _places(it, sent.value), "key binary, t string, start long, stop long").distinct()
    order = F.struct((F.col("action") != ACTIONS[0]).alias("later"), "start", F.concat_ws(":", "action", "start", "stop").alias("said"))
    extra = hits.join(terms, "t").groupBy("key").agg(F.array_sort(F.collect_list(order)).alias("all"))
    return base, ws.store(extra.select("key", F.array_join("all.said", ",").alias("spans")), "extra")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 8, support: int = 3, remove_bits: float = 1.0, general_bits: float = 2.0) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, one row per row of ``docs``.

    ``spans`` lists kind:start:end (code points, end exclusive): email, ip, card, phone, then
    terms ``removed`` and ``general``, each by start.  A term is removed if at least every second
    document with it (``remove_bits`` of doubt) has it within ``reach`` terms of one and the same
    entity, generalised if every fourth (``general_bits``) has.

    Null texts count as empty and have no spans.  Null ids and repeated rows stay rows of their
    own; each counts as a document.  An empty table gives an empty result.  Texts are read whole;
    every pattern passes over a text once, however long it is.
    """
    base, extra = _prepared(docs, text_col, reach, support, remove_bits, general_bits, [F.col(id_col).alias("doc_id")])
    met = base.drop("mentions").join(extra, "key", "left")
    spans = F.concat_ws(",", F.when(F.col("base_spans") != "", F.col("base_spans")), F.col("spans"))
    return met.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


def _shape(word: str) -> str:
    """What a generalised term becomes."""
    return "[number]" if word.isdigit() else "[code]" if any(c.isdigit() for c in word) else "[Name]" if word[:1].isupper() else "[word]"


def _rewrite(text: str, spans: str) -> str:
    places = [(*sorted_span(x),) for x in ",".join(filter(None, (spell(KINDS, find(text)), spans))).split(",") if x]
    out, at = [], 0
    for s, e, kind in sorted(places):
        if s < at:  # two kinds meet: the first stands
            at = max(at, e)
            continue
        out += [text[at:s], "[removed]" if kind == ACTIONS[0] else _shape(text[s:e]) if kind == ACTIONS[1] else f"[{kind}]"]
        at = e
    return "".join(out) + text[at:]


def sorted_span(said: str) -> tuple[int, int, str]:
    kind, s, e = said.split(":")
    return int(s), int(e), kind


def sanitise(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with personal data named by kind, removed terms marked and general ones replaced by their shape; all columns stay, null texts too."""
    opts = {"reach": 8, "support": 3, "remove_bits": 1.0, "general_bits": 2.0} | how
    _, extra = _prepared(docs, text_col, **opts, ids=[])
    text = F.col(text_col)
    key = F.substring(F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)), 1, 16)
    extra = extra.select(F.col("key").alias("__sl_key"), F.col("spans").alias("__sl_spans"))
    met = docs.withColumn("__sl_of", key).join(extra, F.col("__sl_of") == F.col("__sl_key"), "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__sl_spans")
    at = docs.columns.index(text_col)

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [None if t is None else _rewrite(t, s or "") for t, s in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            cols = list(b.columns[:-1])
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    return met.mapInArrow(rewritten, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every whole text of ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
