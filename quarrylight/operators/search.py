"""Vector search and the embedding store."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scalars import cosine_distance, embedding_text, euclidean, negative_dot, norm

METRICS = {"cosine": cosine_distance, "l2": euclidean, "inner": negative_dot}


def top_k(embeddings: DataFrame, query: list[float], k: int, metric: str = "cosine", without: int | None = None) -> DataFrame:
    """The ``k`` nearest contents with their positions; equal distances by id.  Each task keeps its own k."""
    if k <= 0:
        raise ValueError("k must be positive")
    df = embeddings if without is None else embeddings.where(F.col("conteudo_id") != without)
    vector = F.array(*[F.lit(float(x)) for x in query])
    found = df.select("conteudo_id", METRICS[metric]("embedding", vector).alias("distancia")).orderBy("distancia", "conteudo_id").limit(k)
    return with_positions(found, ["distancia", "conteudo_id"])


def with_positions(found: DataFrame, order: list[str]) -> DataFrame:
    """Number a short ranked list."""
    from pyspark.sql import Window as W

    return found.withColumn("posicao", F.row_number().over(W.orderBy(*order)))


def compared_with(embeddings: DataFrame, reference_id: int) -> DataFrame:
    """All three metrics between one content and all others."""
    ref = embeddings.where(F.col("conteudo_id") == reference_id).select(F.col("embedding").alias("ref")).limit(1)
    pairs = embeddings.where(F.col("conteudo_id") != reference_id).crossJoin(F.broadcast(ref))
    return pairs.select("conteudo_id", *[f("embedding", "ref").alias(name) for name, f in (("distancia_cosseno", cosine_distance), ("distancia_l2", euclidean), ("produto_interno_negativo", negative_dot))])


def approximate_top_k(embeddings: DataFrame, query: list[float], k: int, bucket: float = 0.5, tables: int = 8) -> DataFrame:
    """Approximate neighbours by random projections; on unit vectors the Euclidean order is the cosine order."""
    from pyspark.ml.linalg import Vectors

    df = embeddings.select("conteudo_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=11).fit(df)
    return model.approxNearestNeighbors(df, Vectors.dense(query), k, distCol="distancia").select("conteudo_id", "distancia")


def search(embeddings: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], model: str, k: int = 5) -> DataFrame:
    """Semantic search with an embedder of the caller's; warns if the store holds vectors of other models."""
    known = {r["modelo"] for r in embeddings.select("modelo").distinct().limit(16).collect()}
    if known - {model}:
        warnings.warn(f"vectors of other models: {', '.join(sorted(known - {model}))}", stacklevel=2)
    return top_k(embeddings, embed([text])[0], k)


def embedded(df: DataFrame, embed: Callable[[list[str]], list[list[float]]], dimension: int) -> DataFrame:
    """(conteudo_id, embedding) of unit length by batches; a batch that fails gives nulls, a wrong length too.
    A zero vector stays zero."""

    def unit(vector: list[float] | None) -> list[float] | None:
        if vector is None or len(vector) != dimension:
            return None
        size = math.sqrt(sum(x * x for x in vector))
        return [x / size for x in vector] if size else list(vector)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                vectors = embed(batch["texto"].tolist())
            except Exception:
                vectors = [None] * len(batch)
            yield pd.DataFrame({"conteudo_id": batch["conteudo_id"], "embedding": [unit(v) for v in vectors]})

    return df.select("conteudo_id", "texto").mapInPandas(run, f"conteudo_id {df.schema['conteudo_id'].dataType.simpleString()}, embedding array<double>")


def sync_plan(contents: DataFrame, store: DataFrame, model: str) -> DataFrame:
    """(conteudo_id, texto, texto_hash, reusar): reuse a vector of the same model and text."""
    now = contents.select("conteudo_id", embedding_text().alias("texto")).withColumn("texto_hash", F.sha2(F.encode("texto", "UTF-8"), 256))
    had = store.select("conteudo_id", F.col("modelo").alias("m"), F.col("texto_hash").alias("h"))
    return now.join(had, "conteudo_id", "left").select("conteudo_id", "texto", "texto_hash", F.coalesce((F.col("m") == model) & (F.col("h") == F.col("texto_hash")), F.lit(False)).alias("reusar"))


def sync_embeddings(contents: DataFrame, store: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, dimension: int, at) -> tuple[DataFrame, DataFrame]:
    """(the new store, counts of reused, made and failed).  A zero or failed vector takes its stale one along."""
    plan = sync_plan(contents, store, model)
    made = embedded(plan.where("NOT reusar"), embed, dimension)
    good = F.col("embedding").isNotNull() & (norm("embedding") > 0)
    rows = plan.where("NOT reusar").join(made, "conteudo_id", "left").withColumn("bom", F.coalesce(good, F.lit(False)))
    fresh = rows.where("bom").select("conteudo_id", F.col("embedding").cast(store.schema["embedding"].dataType).alias("embedding"), F.lit(model).alias("modelo"), "texto_hash", F.lit(at).cast("timestamp_ntz").alias("gerado_em"))
    stay = store.join(rows.select("conteudo_id"), "conteudo_id", "left_anti")
    counts = plan.where("reusar").agg(F.count("*").alias("reutilizados")).crossJoin(rows.agg(F.count_if("bom").alias("gerados"), F.count_if(~F.col("bom")).alias("falhas")))
    return stay.select("conteudo_id", "embedding", "modelo", "texto_hash", "gerado_em").unionByName(fresh), counts
