"""Tables with every awkward case, for all operators."""

import re

from pyspark.sql import types as T

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(text):
    return WORD.findall(lower(text or ""))


def shingles(text, k):
    w = words(text)
    if len(w) >= k:
        return frozenset(zip(*[w[i:] for i in range(k)]))
    return frozenset([tuple(w)]) if w else frozenset()


#: The columns of documents, and others that clash with names of results.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
    + [T.StructField(x, T.StringType()) for x in ("kept", "score", "ref", "n", "block", "slot", "uid", "key", "lang_pred", "length", "distance")]
)

PROSE = "The quick brown fox jumps over the lazy dog and runs far away from the old grey wolf that sleeps near the river bank. "
FRENCH = "Le renard brun saute par dessus le chien paresseux et court loin du vieux loup gris qui dort près de la rivière. "


def awkward():
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, PROSE * 6, "en", "a"),
        (2, PROSE * 6, "en", "a"),
        (3, " " + PROSE * 6 + "\n", "en", "b"),
        (4, FRENCH * 6, "fr", "b"),
        (5, "", "en", "a"),
        (6, None, "en", None),
        (7, " \t\n", None, "b"),
        (8, "123 456 !!!", "fr", "a"),
        (9, long, "en", "a"),
        (None, PROSE * 6, None, None),
        (None, "alone with no id at all", "en", "a"),
        (12, "same row", "en", "a"),
        (12, "same row", "en", "a"),
        (13, "x\0y " + FRENCH, "fr", "c"),
        (14, "Ünïcödé 日本語 😀 " + FRENCH * 2, "fr", "c"),
        (15, "one", "en", "c"),
    ]
    return [(i, t, l, s, None if t is None else len(t), *["clash"] * 11) for i, t, l, s in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def simple(spark, pairs):
    """(doc_id, text[, lang, source]) rows."""
    rows = [(p[0], p[1], p[2] if len(p) > 2 else "en", p[3] if len(p) > 3 else "a", None, *["clash"] * 11) for p in pairs]
    return spark.createDataFrame(rows, SCHEMA)
