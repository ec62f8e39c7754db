"""The corpus pipeline: each stage applies one operator of ``spendlens.llm`` to all that the stage before it kept.

Every stage but the last returns the columns of ``documents``; texts and ``n_chars`` follow what it removed.  Nulls, empty
texts, repeated rows and empty tables have the results that the operators define.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import mixing, packing, sentence_dedup, simhash, toxicity
from spendlens.llm.queries import vocabulary
from spendlens.llm.scratch import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score (``spendlens.llm.toxicity``) reaches 0.3 go."""
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=4, fold=2)
    return scored.where("score < 0.3").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays (``spendlens.llm.simhash``: 3-word shingles, 3 bits)."""
    return simhash.representatives(docs, shingle=3, radius=3, seed=42)


def drop_repeated_sentences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences in repeated spans go (``spendlens.llm.sentence_dedup``), and documents of which nothing is left."""
    found = sentence_dedup.sentence_dedup(docs).where("n_removed = 0 or trim(text) <> ''")
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(
        F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return found.select(*((changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the capped mix takes them (``spendlens.llm.mixing``: weights 1, 2, 3, three epochs)."""
    return mixing.sample(docs, max_epochs=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-two-fit packing into sequences of at most 1024 tokens (``spendlens.llm.packing``)."""
    return packing.best_two_fit(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("repeated-sentences", drop_repeated_sentences),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The trained classifier, the fingerprints and the tokenizer have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
