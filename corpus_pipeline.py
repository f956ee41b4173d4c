"""The corpus pipeline: filter, deduplicate, decontaminate, pseudonymise and pack the documents.

Each stage needs the five columns of documents and leaves out any others, whatever their names.  Any value may
be null.  Repeated rows and ids are rows of their own.  An empty table passes as an empty table.  Texts are
read whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.decontaminate import remove_contamination
from quarrylight.llm.ngram_join import drop_near_duplicates
from quarrylight.llm.packing import pack_documents
from quarrylight.llm.quality import KEEP_AT, fit_quality, score_quality
from quarrylight.llm.runtime import ship, written
from quarrylight.llm.surrogates import configured_key, replace_entities

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows a changed text."""
    return docs.select("doc_id", "text", "lang", "source", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject.

    Null and empty texts are scored like others.  Labels without both classes reject nothing.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).where(F.col("quality_score") >= KEEP_AT).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id; of equal ids one, a null id last.

    Texts without words are in no group, so all of them stay.
    """
    return drop_near_duplicates(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that benchmark items hold.

    A text that has no word left goes.  Null and empty texts stay, items without words remove nothing.
    """
    return _counted(remove_contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data and secrets; texts without any stay as they are."""
    return _counted(replace_entities(docs.select(*COLUMNS), configured_key(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place there; a null or empty text is its end id alone."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("deduplicate", deduplicate),
    ("decontaminate", decontaminate),
    ("pseudonymise", pseudonymise),
    ("pack", pack),
]

ORACLE_SQL = None  # the stages' models, keyed surrogates and packing can't be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
