"""The corpus pipeline: five stages over ``documents``, each reading what the one before kept.

Language identification, exact deduplication, the n-gram Jaccard join, mixing to target
weights and best-fit packing.  All stages but the last return the columns of documents;
the last returns the pieces and their places in training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import exact_dedup, jaccard_join, langid, mixing, packing
from sightline.llm.workspace import Workspace

#: Least posterior of the predicted language.
MIN_LANGUAGE_SCORE = 0.5
#: Pieces of the mixture that are packed together.
PACKED_TOGETHER = 10_000
#: Words that a packing task remembers: fewer than by default, as executors still hold what earlier stages took.
PACKING_WORDS = 200_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents without a letter, or whose language is in doubt, go.

    The model learns from the rows that are not held out; where none has a label, only
    documents without a letter go.
    """
    model = langid.learn(docs)
    scored = langid.predict(docs, model, pred_col="__sl_pred", score_col="__sl_sure")
    letters = F.col("text").rlike(r"\p{L}")
    sure = (F.col("__sl_pred") != langid.UNKNOWN) & (F.col("__sl_sure") >= MIN_LANGUAGE_SCORE) if model.langs else letters
    return scored.filter(sure).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of texts equal but for blanks the longest stays, then the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5 over five-word shingles at a similarity of 0.8: the smallest doc_id of each group stays."""
    return jaccard_join.keep_one(docs, width=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the mixture of sources, weighted by the square root of their size; a source that has run out leaves it to the others.

    The rows are stored in the order of the mixture, which the next stage packs by.
    """
    return mixing.keep_mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces of at most 4096 tokens and their places in as few sequences as it finds.

    Ranges of the stored mixture are packed one by one, so sequences follow its schedule.
    """
    return packing.digest(docs, packing.default_tokenizer(), per_part=PACKED_TOGETHER, cache=PACKING_WORDS, order=packing.stored_order(docs))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = ws.store(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            ws.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The naive Bayes model and the packing have no statement in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
