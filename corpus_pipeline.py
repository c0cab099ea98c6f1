"""Corpus preparation: five stages over the documents table.

Each stage takes what the one before kept, as written and read again, and returns the
columns of documents; the last returns sequences.

All stages read whole texts. Repeated rows are documents of their own until one of their
class of near-duplicates stays; an empty table gives no rows; further columns are kept,
whatever their names, but by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import unused
from framewright.llm.language import identify_languages, train_languages
from framewright.llm.mixing import mixed_documents
from framewright.llm.near_dedup import drop_near_duplicates
from framewright.llm.packing import pack_documents
from framewright.llm.quality import score_quality, train_quality
from framewright.session import materialize


#: Words that a packing worker remembers: the models of the stages before are in memory too.
PACKING_WORDS = 200_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a centroid of some language; null texts and such without a letter go.

    Ties between centroids go to the first; null ids and languages stay as they are.
    """
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    told = identify_languages(docs, train_languages(docs), prefix=prefix)
    return told.where(~F.col(f"{prefix}rejected")).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than bad, as the labels mark them; a score of 0.5 stays.

    Labels without a document, with a null id or without a quality teach nothing; null ids are scored like others.
    """
    score = unused("_score", docs.columns)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("_quality"))
    model = train_quality(docs.select("doc_id", "text").join(labels, "doc_id"), label_column="_quality")
    return score_quality(docs, model, score_column=score).where(F.col(score) >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the least id's; documents without an id stay."""
    return drop_near_duplicates(docs).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null sources are one source, the last.

    A last repetition in part keeps the first words, and ``n_chars`` is its length.
    """
    return mixed_documents(docs, length_column="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths; null and empty texts give their closing id alone."""
    return pack_documents(docs, most_words=PACKING_WORDS)


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Trained models and tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each reads what the one before has written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
