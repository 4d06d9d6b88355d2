"""From raw documents to a training order, in five stages.

Each stage takes the documents its predecessor kept and returns documents; the last one
returns the order in which they are read for training.  A null or empty text is rejected by
the first stage, as its language is undetermined; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisweep.llm import decontaminate, langid, mixing, neardup, substring
from lumisweep.llm.common import read, settle
from lumisweep.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this posterior of its best language a document counts as of no language.
LEAST_SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known go on, labelled with the language found."""
    found = langid.identify(docs, vocabulary(), carry=["text", "source", "n_chars"])
    return (found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE))
            .select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies goes on."""
    gone = neardup.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that appeared before are cut; a document of which nothing is left goes."""
    found = substring.without_repeats(docs, carry=["lang", "source"])
    return (found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
            .select("doc_id", F.col("kept").alias("text"), "lang", "source",
                    F.length("kept").cast("long").alias("n_chars")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    gone = (decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
            .where("contaminated").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: what the mix takes of each document, and when."""
    return mixing.in_order(mixing.mix_sources(docs).drop("_nth"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id), ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup), ("benchmark decontamination", decontamination),
    ("mixing sources", mix),
]

#: Trained language models and signatures have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
