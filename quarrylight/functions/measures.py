"""Measures as named expressions, to be used at any grouping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions.scalars import COMPLETION, LIKE, SHARE, is_consumption, ratio


def engagement_measures() -> list[Column]:
    """Twelve measures of interactions: counts, exact distinct counts, sums and guarded ratios."""
    kind = F.col("tipo_interacao")
    consumed, completed = F.count_if(is_consumption(kind)), F.count_if(kind == COMPLETION)
    rated = F.count("avaliacao_atribuida")
    return [
        F.count("*").alias("total_interacoes"),
        F.count_distinct("usuario_id").alias("usuarios_ativos"),
        F.count_distinct("conteudo_id").alias("conteudos_consumidos"),
        consumed.alias("interacoes_consumo"),
        completed.alias("conclusoes"),
        ratio(completed, consumed).alias("taxa_conclusao"),
        F.round(F.sum("percentual_conclusao").cast("double") / F.count("*"), 2).alias("percentual_conclusao_medio"),
        F.round(F.sum("tempo_consumido").cast("double"), 2).alias("tempo_consumido_total"),
        F.count_if(kind == LIKE).alias("curtidas"),
        F.count_if(kind == SHARE).alias("compartilhamentos"),
        rated.alias("avaliacoes"),
        ratio(F.sum("avaliacao_atribuida"), rated, 2).alias("avaliacao_media"),
    ]


#: Dataset -> metric -> expression over its rows.
METRICS: dict[str, dict[str, Column]] = {}


def metrics() -> dict[str, dict[str, Column]]:
    if not METRICS:
        METRICS.update({
            "engagement_rows": {
                "interacoes": F.count("*"),
                "usuarios_ativos": F.count_distinct("usuario_mascarado"),
                "conclusoes": F.sum("conclusao"),
                "taxa_conclusao": ratio(F.sum("conclusao"), F.sum("consumo")),
                "avaliacao_media": F.round(F.avg("avaliacao_atribuida").cast("double"), 2),
                "tempo_medio": ratio(F.sum("tempo_consumido"), F.count("tempo_consumido"), 2),
                "percentual_medio": ratio(F.sum("percentual_conclusao"), F.count("percentual_conclusao"), 2),
            },
            "recommendation_conversion_rows": {
                "total_recomendacoes": F.sum("recomendacoes"),
                "total_convertidas": F.sum("convertidas"),
                "taxa_conversao": ratio(F.sum("convertidas"), F.sum("recomendacoes")),
                "positivas_pct": ratio(F.sum(F.when(F.col("status") == "Positivo", F.col("recomendacoes")).otherwise(0)) * 100, F.sum("recomendacoes"), 2),
            },
            "action_list": {"conteudos": F.count("*")},
            "quality_evolution": {"metrica_pior": F.min("metrica")},
        })
    return METRICS
