"""Virtual datasets, re-aggregatable metrics, charts and the conversion alert."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions.measures import metrics
from quarrylight.functions.scalars import age_months, day_part, masked, position_band, ratio, rounded


def engagement_rows(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Interactions with the attributes that charts group by."""
    d = dim.select("conteudo_mestre_id", "titulo", "tipo", "categoria", "nivel", "faixa_duracao", "data_publicacao")
    return fact.join(d, "conteudo_mestre_id").select(
        "data_hora", F.to_date(F.trunc("data_hora", "month")).alias("mes"), F.date_format("data_hora", "EEEE").alias("dia_semana"), day_part("data_hora").alias("periodo_do_dia"), masked("usuario_chave").alias("usuario_mascarado"),
        "conteudo_mestre_id", "titulo", "tipo", "categoria", "nivel", "faixa_duracao", "tipo_interacao", F.col("eh_consumo").cast("int").alias("consumo"), F.col("eh_conclusao").cast("int").alias("conclusao"),
        "percentual_conclusao", "tempo_consumido", "avaliacao_atribuida", F.datediff("data", "data_publicacao").alias("dias_desde_publicacao"), "anterior_a_publicacao",
    )


def recommendation_conversion_rows(fact: DataFrame, dim: DataFrame) -> DataFrame:
    d = dim.select("conteudo_mestre_id", "categoria", "tipo")
    rows = fact.where("geracao_vigente").join(d, "conteudo_mestre_id")
    mean = F.sum("pontuacao") / F.count("pontuacao")  # avg would round a decimal to six digits first
    return rows.groupBy(F.to_date(F.trunc("data_geracao", "month")).alias("mes_geracao"), "categoria", "tipo", position_band("posicao").alias("faixa_posicao"), "status").agg(
        F.count("*").alias("recomendacoes"), F.count_if("convertida").alias("convertidas"), F.count_if("concluida").alias("concluidas"), F.round(mean, 2).cast("double").alias("pontuacao_media")
    )


def ratings(interactions: DataFrame, comments: DataFrame) -> DataFrame:
    """All ratings of a content, from interactions and comments."""
    given = interactions.where("avaliacao_atribuida IS NOT NULL").select("conteudo_mestre_id", F.col("avaliacao_atribuida").cast("double").alias("nota"))
    return given.unionByName(comments.select("conteudo_mestre_id", F.col("avaliacao").cast("double").alias("nota")))


def action_list(dim: DataFrame, interactions: DataFrame, comments: DataFrame, ordered: bool = True) -> DataFrame:
    """What to do with each content by its users against the median and its mean rating."""
    used = interactions.groupBy("conteudo_mestre_id").agg(F.count_distinct("usuario_chave").alias("usuarios"), F.count("*").alias("interacoes"), F.max("data_hora").alias("ultima"))
    # the median from counts of counts, so that no task holds a number a content
    sizes = used.groupBy("usuarios").agg(F.count("*").alias("vezes"))
    middle = sizes.agg(F.percentile("usuarios", 0.5, F.col("vezes")).alias("mediana"))  # one row
    rated = ratings(interactions, comments).groupBy("conteudo_mestre_id").agg(rounded(F.avg("nota")).alias("nota_media"), F.count("nota").alias("qtd_notas"))
    base = dim.select("conteudo_mestre_id", "titulo", "tipo", "categoria", "nivel", "data_publicacao").join(used, "conteudo_mestre_id").join(rated, "conteudo_mestre_id", "left").crossJoin(F.broadcast(middle))
    # The five actions and the limits of a mean rating.
    many, mean = F.col("usuarios") > F.col("mediana"), F.col("nota_media")
    action = F.when(many & (mean >= 4), "Promover").when(many & (mean < 3.5), "Revisar conteúdo").when(~many & (mean >= 4), "Divulgar").when(~many & (mean < 3.5), "Reavaliar no catálogo").otherwise("Acompanhar")
    out = base.select("conteudo_mestre_id", "titulo", "tipo", "categoria", "nivel", "usuarios", "interacoes", "nota_media", F.coalesce("qtd_notas", F.lit(0)).alias("qtd_notas"), age_months(F.to_date("ultima"), F.col("data_publicacao")).alias("meses_publicado"), action.alias("classificacao"))
    return out.orderBy(F.desc_nulls_first("usuarios"), F.desc_nulls_first("nota_media")) if ordered else out


def conversion_value(fact: DataFrame) -> DataFrame:
    n, hit = F.count("*"), F.count_if("convertida")
    return fact.where("geracao_vigente").agg(rounded(F.lit(100.0) * hit / F.nullif(n, F.lit(0))).alias("taxa_conversao_pct"))


# --- charts ---


@dataclass(frozen=True)
class Chart:
    title: str
    dataset: str
    dims: tuple[str, ...]
    metrics: tuple[str, ...]
    filters: tuple[tuple[str, str, object], ...] = ()
    lag: str | None = None
    limit: int | None = None


# The charts' datasets, dimensions and metrics.
CHARTS = (
    Chart("Usuários ativos por mês", "engagement_rows", ("mes",), ("usuarios_ativos",), lag="usuarios_ativos"),
    Chart("Taxa de conclusão mensal", "engagement_rows", ("mes",), ("taxa_conclusao",)),
    Chart("Interações por categoria", "engagement_rows", ("categoria",), ("interacoes", "usuarios_ativos")),
    Chart("Conclusão por tipo", "engagement_rows", ("tipo",), ("taxa_conclusao", "conclusoes")),
    Chart("Interações por período do dia", "engagement_rows", ("dia_semana", "periodo_do_dia"), ("interacoes",)),
    Chart("Conversão por faixa de posição", "recommendation_conversion_rows", ("faixa_posicao", "status"), ("taxa_conversao", "total_recomendacoes")),
    Chart("Ações por classificação", "action_list", ("classificacao",), ("conteudos",)),
    Chart("Evolução da qualidade", "quality_evolution", ("id_execucao", "id_regra"), ("metrica_pior",)),
)


def _condition(column: str, operator: str, value: object) -> Column:
    c = F.col(column)
    found = {"IN": lambda: c.isin(*value), "==": lambda: c == value, "range": lambda: (c >= value[0]) & (c < value[1])}
    return found[operator]()


def chart_query(dataset: DataFrame, chart: Chart, filters: tuple[tuple[str, str, object], ...] = ()) -> DataFrame:
    """Metrics by dimensions.  Dashboard filters apply where the dataset has their column; a chart's own must fit it."""
    if missing := {column for column, _, _ in chart.filters} - set(dataset.columns):
        raise ValueError(f"{chart.title}: {chart.dataset} has no {', '.join(sorted(missing))}")
    for column, operator, value in (*chart.filters, *(f for f in filters if f[0] in dataset.columns)):
        dataset = dataset.where(_condition(column, operator, value))
    known = metrics()[chart.dataset]
    out = dataset.groupBy(*chart.dims).agg(*[known[m].alias(m) for m in chart.metrics])
    if chart.lag:
        out = with_previous(out, chart.dims[0], chart.lag)
    return out.orderBy(F.desc(chart.metrics[0])).limit(chart.limit) if chart.limit else out


def with_previous(df: DataFrame, period: str, metric: str) -> DataFrame:
    """A metric beside that of the period before: one row a period."""
    return df.withColumn(f"{metric}_anterior", F.lag(metric, 1).over(W.orderBy(period)))


def empty_charts(datasets: dict[str, DataFrame]) -> list[str]:
    """Charts whose query returns no row."""
    return [c.title for c in CHARTS if c.dataset in datasets and chart_query(datasets[c.dataset], c).isEmpty()]


@dataclass
class Alert:
    """Fires when the conversion falls below the threshold, at most once a grace period."""

    threshold: float = 5.0
    grace: timedelta = timedelta(seconds=86_400)
    last_fired: datetime | None = None
    history: list[tuple[datetime, float | None, bool]] = field(default_factory=list)

    def check(self, fact: DataFrame, now: datetime) -> bool:
        value = conversion_value(fact).first()[0]
        due = self.last_fired is None or now - self.last_fired >= self.grace
        fires = value is not None and value < self.threshold and due
        if fires:
            self.last_fired = now
        self.history.append((now, value, fires))
        return fires


def weighted_ratio(a: str, b: str) -> Column:
    return ratio(F.sum(a), F.sum(b))
