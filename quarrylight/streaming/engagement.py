"""Engagement over a stream of interactions: an extension, as the batch engine has no streams of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylight.functions.scalars import COMPLETION, LIKE, SHARE, is_consumption
from quarrylight.operators.engagement import UNCATALOGUED


def windowed_engagement(stream: DataFrame, catalogue: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by window and category.  Events later than ``late`` behind the newest are dropped;
    distinct users are approximate, as exact sets would have to be kept in state."""
    kind = F.col("tipo_interacao")
    rows = stream.withColumn("em", F.col("data_hora").cast("timestamp")).withWatermark("em", late)
    rows = rows.join(catalogue.select("conteudo_id", "categoria"), "conteudo_id", "left").withColumn("categoria", F.coalesce("categoria", F.lit(UNCATALOGUED)))
    out = rows.groupBy(F.window("em", window).alias("janela"), "categoria").agg(
        F.count("*").alias("total_interacoes"), F.approx_count_distinct("usuario_id").alias("usuarios_aprox"), F.count_if(is_consumption(kind)).alias("interacoes_consumo"), F.count_if(kind == COMPLETION).alias("conclusoes"),
        F.count_if(kind == LIKE).alias("curtidas"), F.count_if(kind == SHARE).alias("compartilhamentos"), F.sum("tempo_consumido").alias("tempo_consumido_total"),
    )
    return out.select(F.col("janela.start").alias("inicio"), F.col("janela.end").alias("fim"), "categoria", *out.columns[2:])


def start(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to Parquet, once for all input that is there."""
    return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
