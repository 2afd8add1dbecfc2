"""The corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes the documents that the one before has kept, and all but the last return the columns of documents.

Null and wordless texts leave with the language stage, which knows no language for them. Rows with equal or null ids are separate documents
in every stage; of equal texts the row with the smallest id stays, null ids last, then the first in the table. Very long texts
go through whole. Columns beyond those of documents are carried along under their names; an empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.llm import decontaminate, language, near_dedup, pack, suffix_dedup
from procweave.llm.common import settle, table

#: Documents whose best language has a mean probability below this are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.4
ORACLE_SQL = None


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no recognised language; a missing language is filled in."""
    told = language.identify(docs, language.train(docs))
    kept = told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays."""
    return near_dedup.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that an earlier document (or place) holds are cut out of the texts."""
    return suffix_dedup.dedup_texts(docs, keep_first=True).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into bins of 2,048 words."""
    return pack.pack(docs).drop("rid")


STAGES = [
    ("language", keep_language),
    ("near_duplicates", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
