"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams by language inside tasks and sums them in Spark; the
log-probability matrix is broadcast, and each task scores whole batches of texts as
one sparse product: gather the matrix by n-gram, then add up by document.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
#: Characters that a task turns into n-grams at a time, unless one text is longer.
CHUNK = 2_000_000
_FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)


@dataclass
class Model:
    """langs in order, and for each the log prior and the log probability by bucket (the last bucket is void)."""

    langs: list[str]
    prior: np.ndarray
    matrix: np.ndarray
    orders: tuple[int, ...] = (2, 3)
    bits: int = 16
    learned: dict = field(default_factory=dict)


def _letters() -> np.ndarray:
    """Code point of the Basic Multilingual Plane to its lower-case letter, marks as they are, all else to a space."""
    table = np.full(65536, 32, np.uint32)
    for c in range(65536):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low[0])
        elif unicodedata.category(x)[0] == "M":
            table[c] = c
    table[0] = 0
    return table


def _is_letter() -> np.ndarray:
    """Whether a code point of the Basic Multilingual Plane is a letter (category L)."""
    return np.array([chr(c).isalpha() for c in range(65536)])


def _chunks(texts: list[str]):
    """Slices of the list with about CHUNK characters each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 3
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _ngrams(texts: list[str], table: np.ndarray, orders, bits: int, letter: np.ndarray | None = None):
    """(for each order the buckets by position, document starts, whether each document has a letter by the table ``letter``)."""
    joined = "\0 " + " \0 ".join(t.replace("\0", " ") if "\0" in t else t for t in texts) + " \0"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = c > 65535
    if high.any():
        flat = table[np.where(high, 32, c)]
        odd = np.unique(c[high])
        flat[high & np.isin(c, [x for x in odd.tolist() if chr(x).isalpha()])] = c[high & np.isin(c, [x for x in odd.tolist() if chr(x).isalpha()])]
        c = flat
    else:
        c = table[c]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    ends = np.flatnonzero(c == 0)
    starts = ends[:-1]
    # Of characters beyond the table only letters are left.
    lettered = None if letter is None else np.logical_or.reduceat(letter[np.where(c > 65535, ord("a"), c)], starts) if len(starts) else np.zeros(0, bool)
    void, out = 1 << bits, []
    is_end = c == 0
    for n in orders:
        m = len(c) - n + 1
        h = np.full(m, (n * 0x9E3779B9) & 0xFFFFFFFF, np.uint32)
        bad = is_end[:m].copy()
        for k in range(n):
            h += c[k : k + m] * _FACTORS[k]
            if k:
                bad |= is_end[k : k + m]
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        h >>= np.uint32(32 - bits)
        h[bad] = void
        out.append(h)
    return out, starts, lettered


def _count_batches(batches, orders, bits: int):
    table, index, counts, size = _letters(), {}, None, (1 << bits) + 1
    for batch in batches:
        texts, langs = [x or "" for x in batch.column(0).to_pylist()], batch.column(1).to_pylist()
        for a, b in _chunks(texts):
            which = np.array([index.setdefault(x, len(index)) for x in langs[a:b]], np.int64)
            if counts is None or len(counts) < len(index) * size:
                grown = np.zeros(len(index) * size, np.int64)
                grown[: 0 if counts is None else len(counts)] = 0 if counts is None else counts
                counts = grown
            grams, starts, _ = _ngrams(texts[a:b], table, orders, bits)
            for h in grams:
                spans = np.diff(np.append(starts[starts < len(h)], len(h)))
                counts += np.bincount(np.repeat(which[: len(spans)] * size, spans) + h, minlength=len(counts))
    for lang, i in index.items():
        own = counts[i * size : (i + 1) * size - 1]
        at = np.flatnonzero(own)
        for k in range(0, len(at), 20_000):
            some = at[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(own[some])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", orders=(2, 3), bits: int = 16, alpha: float = 0.5, max_langs: int = 500) -> Model:
    """Learn from every row whose label is not null.  The model has a column a language, ``2 ** bits`` buckets each.

    More than ``max_langs`` distinct labels are an error: the model is held by every task.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang IS NOT NULL")
    sums = rows.mapInArrow(lambda it: _count_batches(it, orders, bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    priors = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(max_langs + 1).collect()}
    if len(priors) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    # One row a language, of at most 2 ** bits counters: the model itself, whatever the input.
    learned = sums.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).toArrow().to_pydict()
    langs = sorted(priors)
    size = 1 << bits
    matrix = np.full((len(langs), size + 1), alpha)
    at = {x: i for i, x in enumerate(learned["lang"])}
    for i, lang in enumerate(langs):
        if lang in at:
            matrix[i, np.array(learned["bucket"][at[lang]], np.int64)] += np.array(learned["n"][at[lang]], np.float64)
    matrix[:, size] = 0
    if langs:
        matrix[:, :size] = np.log(matrix[:, :size] / matrix[:, :size].sum(1, keepdims=True))
    total = sum(priors.values())
    return Model(langs, np.log(np.array([priors[x] / total for x in langs])), matrix, tuple(orders), bits)


def _score_batches(batches, held, column: str):
    model: Model = held.value
    table, letter = _letters(), _is_letter()
    for batch in batches:
        texts = [x or "" for x in batch.column(column).to_pylist()]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for a, b in _chunks(texts) if model.langs else ():
            grams, starts, lettered = _ngrams(texts[a:b], table, model.orders, model.bits, letter)
            logs = np.repeat(model.prior[:, None], b - a, 1)
            for h in grams:
                own = np.minimum(starts, len(h) - 1)
                for i, row in enumerate(model.matrix):
                    logs[i] += np.add.reduceat(row.take(h), own)
            best = logs.argmax(0)
            odds = np.exp(logs - logs.max(0)).sum(0)
            for k in np.flatnonzero(lettered).tolist():
                names[a + k], scores[a + k] = model.langs[best[k]], 1.0 / odds[k]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*batch.schema.names, "__sl_lang", "__sl_score"])


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability.

    ``und`` and 0.0 where the text is null, empty or without a letter (category L; marks
    and digits alone are none), or where the model has learned no language.  Whole texts count, however long.  Ties go to the
    first language in order.  Columns of ``docs`` already named so are replaced.
    """
    docs = docs.drop(pred_col, score_col)
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets, bounded by the model's parameters
    schema = T.StructType([*docs.schema.fields, T.StructField("__sl_lang", T.StringType()), T.StructField("__sl_score", T.DoubleType())])
    out = docs.mapInArrow(lambda it: _score_batches(it, held, text_col), schema)
    return out.withColumnsRenamed({"__sl_lang": pred_col, "__sl_score": score_col})


def held_out(id_col: str = "doc_id"):
    """crc32(id as text) mod 3 is 1; rows without an id are never learned from and count as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    return fit(docs.filter(~held_out(id_col)), text_col, lang_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs.select("doc_id", "text"), learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
