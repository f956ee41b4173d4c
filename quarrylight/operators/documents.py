"""Queries on the comment documents: tags are arrays, enriched with their content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["usuario_id", "conteudo_id", "data", "comentario"]


def enriched(comments: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with title, type and category, comments of unknown contents)."""
    c = catalogue.select("conteudo_id", "titulo", "tipo", "categoria")
    return comments.join(c, "conteudo_id"), comments.join(c, "conteudo_id", "left_anti")


def of_content(documents: DataFrame, content: int) -> DataFrame:
    return documents.where(F.col("conteudo_id") == content).orderBy(F.desc("data"))


def with_tag(documents: DataFrame, tag: str) -> DataFrame:
    return documents.where(F.array_contains("tags", tag))


def rated(documents: DataFrame, low: float, high: float | None = None) -> DataFrame:
    good = F.col("avaliacao") >= low
    return documents.where(good if high is None else good & (F.col("avaliacao") <= high))


def by_category(documents: DataFrame) -> DataFrame:
    return documents.groupBy("categoria").agg(F.count("*").alias("total"), F.round(F.avg("avaliacao").cast("double"), 2).alias("media")).orderBy(F.desc("total"), "categoria")


def tag_frequency(documents: DataFrame, n: int = 10) -> DataFrame:
    return documents.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "tag").limit(n)


def positive_sets(documents: DataFrame, minimum: float = 4) -> DataFrame:
    """(usuario_id, conteudos): what each user rated at least ``minimum``."""
    return documents.where(F.col("avaliacao") >= minimum).groupBy("usuario_id").agg(F.array_sort(F.collect_set("conteudo_id")).alias("conteudos"))
