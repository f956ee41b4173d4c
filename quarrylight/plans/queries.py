"""The engine's operators applied to the test tables, each with a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.scalars import candidate_key, capitalised, comma_decimal, in_month, json_list, match_key, month, norm, pseudonym, ratio, salted_pseudonym, trimmed
from quarrylight.operators import bi, documents, engagement, gold, layers, master, quality, recommend, search, validation
from quarrylight.plans.standins import CONSUMED_SQL, KEY, Entities, pseudonym_sql, with_ctes
from quarrylight.session import written
from quarrylight.sources import sinks
from quarrylight.sources.contracts import CATALOGUE, COMMENT, INTERACTION, Contract
from quarrylight.sources.readers import typed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, *ctes: str):
    """Register a function of the entities under its own name."""

    def add(f: Callable[[Entities], DataFrame]) -> Callable[[Entities], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Entities(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_ctes(sql, *ctes)
        return f

    return add


# --- aggregates and the star schema ---

_MEASURES = f"""count(*) AS total_interacoes, count(DISTINCT usuario_id) AS usuarios_ativos, count(DISTINCT conteudo_id) AS conteudos_consumidos, count(*) FILTER (WHERE {CONSUMED_SQL}) AS interacoes_consumo, count(*) FILTER (WHERE tipo_interacao = 'conclusão') AS conclusoes,
round(CAST(count(*) FILTER (WHERE tipo_interacao = 'conclusão') AS DOUBLE) / nullif(count(*) FILTER (WHERE {CONSUMED_SQL}), 0), 4) AS taxa_conclusao, round(CAST(sum(percentual_conclusao) AS DOUBLE) / count(*), 2) AS percentual_conclusao_medio, round(CAST(sum(tempo_consumido) AS DOUBLE), 2) AS tempo_consumido_total,
count(*) FILTER (WHERE tipo_interacao = 'curtida') AS curtidas, count(*) FILTER (WHERE tipo_interacao = 'compartilhamento') AS compartilhamentos, count(avaliacao_atribuida) AS avaliacoes, round(CAST(sum(avaliacao_atribuida) AS DOUBLE) / nullif(count(avaliacao_atribuida), 0), 2) AS avaliacao_media"""


@query(f"SELECT strftime(data_hora, '%Y-%m') AS ano_mes, coalesce(categoria, 'Não catalogado') AS categoria, {_MEASURES} FROM interacao LEFT JOIN catalogo USING (conteudo_id) GROUP BY 1, 2", "interacao", "catalogo")
def engagement_by_bucket_category(e: Entities) -> DataFrame:
    return engagement.engagement_by_month_category(e.interactions, e.catalogue)


@query("SELECT count(*) FILTER (WHERE categoria IS NULL) AS nao_catalogadas, count(*) AS lidas FROM interacao LEFT JOIN catalogo_parcial USING (conteudo_id)", "interacao", "catalogo_parcial")
def engagement_uncatalogued(e: Entities) -> DataFrame:
    return engagement.missing_from_catalogue(e.interactions, e.part_catalogue)


@query(f"SELECT strftime(data_hora, '%Y-%m') AS ano_mes, coalesce(categoria, 'Não catalogado') AS categoria, {_MEASURES} FROM interacao LEFT JOIN catalogo_parcial USING (conteudo_id) GROUP BY 1, 2", "interacao", "catalogo_parcial")
def engagement_part_catalogue(e: Entities) -> DataFrame:
    return engagement.engagement_by_month_category(e.interactions, e.part_catalogue)


_KPI = """SELECT ano_mes, count(*) AS total_interacoes, count(DISTINCT usuario_chave) AS usuarios_ativos, count(DISTINCT conteudo_mestre_id) AS conteudos_consumidos, count(*) FILTER (WHERE eh_consumo) AS interacoes_consumo, count(*) FILTER (WHERE eh_conclusao) AS conclusoes,
round(CAST(count(*) FILTER (WHERE eh_conclusao) AS DOUBLE) / nullif(count(*) FILTER (WHERE eh_consumo), 0), 4) AS taxa_conclusao, round(avg(avaliacao_atribuida), 2) AS avaliacao_media, count(*) FILTER (WHERE anterior_a_publicacao) AS interacoes_com_ressalva FROM fato_interacao GROUP BY ano_mes"""


@query(_KPI, "fato_interacao")
def kpi_monthly(e: Entities) -> DataFrame:
    return gold.kpi_monthly(e.fact_interaction)


@query(f"SELECT ano_mes, usuarios_ativos, lag(usuarios_ativos) OVER (ORDER BY ano_mes) AS usuarios_ativos_anterior FROM ({_KPI})", "fato_interacao")
def kpi_monthly_lag(e: Entities) -> DataFrame:
    return bi.with_previous(gold.kpi_monthly(e.fact_interaction).select("ano_mes", "usuarios_ativos"), "ano_mes", "usuarios_ativos")


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS ano_mes, count(*) AS pedidos, count(DISTINCT o_custkey) AS clientes, count(*) FILTER (WHERE o_orderstatus = 'F') AS fechados,
round(CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / nullif(count(*) FILTER (WHERE o_orderstatus <> 'P'), 0), 4) AS taxa FROM orders GROUP BY 1""")
def orders_kpi_monthly(e: Entities) -> DataFrame:
    done, counted = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") != "P")
    return e.table("orders").groupBy(month("o_orderdate").alias("ano_mes")).agg(F.count("*").alias("pedidos"), F.count_distinct("o_custkey").alias("clientes"), done.alias("fechados"), ratio(done, counted).alias("taxa"))


@query("SELECT * FROM dim_conteudo", "dim_conteudo")
def dim_content(e: Entities) -> DataFrame:
    return e.dim_content


@query("SELECT * FROM dim_usuario", "dim_usuario")
def dim_user(e: Entities) -> DataFrame:
    return e.dim_user


@query("SELECT * FROM consumo", "consumo")
def consumption(e: Entities) -> DataFrame:
    return e.consumption


@query("SELECT * FROM fato_interacao", "fato_interacao")
def fact_interaction(e: Entities) -> DataFrame:
    return e.fact_interaction


@query("SELECT * REPLACE (array_to_string(tags, '|') AS tags) FROM fato_comentario", "fato_comentario")
def fact_comment(e: Entities) -> DataFrame:
    return e.fact_comment.withColumn("tags", F.array_join("tags", "|"))


@query("SELECT * FROM fato_recomendacao", "fato_recomendacao")
def fact_recommendation(e: Entities) -> DataFrame:
    return e.fact_recommendation


@query(
    """SELECT d.conteudo_mestre_id, titulo, tipo, categoria, nivel, faixa_duracao, autor, data_publicacao, coalesce(n_i, 0) AS total_interacoes, coalesce(n_u, 0) AS usuarios, coalesce(n_d, 0) AS conclusoes, round(CAST(n_d AS DOUBLE) / nullif(n_c, 0), 4) AS taxa_conclusao, round(a_i, 2) AS avaliacao_media,
coalesce(n_k, 0) AS comentarios, round(a_k, 2) AS nota_media_comentarios, coalesce(n_r, 0) AS recomendacoes, coalesce(n_v, 0) AS recomendacoes_convertidas, round(CAST(n_v AS DOUBLE) / nullif(n_r, 0), 4) AS taxa_conversao FROM dim_conteudo d
LEFT JOIN (SELECT conteudo_mestre_id, count(*) AS n_i, count(DISTINCT usuario_chave) AS n_u, count(*) FILTER (WHERE eh_consumo) AS n_c, count(*) FILTER (WHERE eh_conclusao) AS n_d, avg(avaliacao_atribuida) AS a_i FROM fato_interacao GROUP BY 1) i USING (conteudo_mestre_id)
LEFT JOIN (SELECT conteudo_mestre_id, count(*) AS n_k, avg(avaliacao) AS a_k FROM fato_comentario GROUP BY 1) c USING (conteudo_mestre_id)
LEFT JOIN (SELECT conteudo_mestre_id, count(*) AS n_r, count(*) FILTER (WHERE convertida) AS n_v FROM fato_recomendacao WHERE geracao_vigente GROUP BY 1) r USING (conteudo_mestre_id)""",
    "dim_conteudo", "fato_interacao", "fato_comentario", "fato_recomendacao",
)
def content_performance(e: Entities) -> DataFrame:
    return gold.content_performance(e.dim_content, e.fact_interaction, e.fact_comment, e.fact_recommendation)


@query(
    """SELECT posicao, status, count(*) AS recomendacoes, count(*) FILTER (WHERE convertida) AS convertidas, round(CAST(count(*) FILTER (WHERE convertida) AS DOUBLE) / count(*), 4) AS taxa_conversao, count(*) FILTER (WHERE convertida_apos_geracao) AS convertidas_apos_geracao,
count(*) FILTER (WHERE concluida) AS concluidas, CAST((2 * CAST(sum(pontuacao) * 100 AS BIGINT) + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS pontuacao_media FROM fato_recomendacao WHERE geracao_vigente GROUP BY 1, 2""",
    "fato_recomendacao",
)
def recommendation_conversion(e: Entities) -> DataFrame:
    return gold.recommendation_conversion(e.fact_recommendation)


@query(
    """SELECT 'usr_' || left(usuario_chave, 4) || '***' || right(usuario_chave, 4) AS usuario_mascarado, total_interacoes, meses_ativos, conteudos_concluidos, CASE WHEN conteudos_concluidos = 0 THEN 'Inativo/Explorador' WHEN conteudos_concluidos BETWEEN 1 AND 5 THEN 'Casual' ELSE 'Engajado' END AS perfil_engajamento FROM dim_usuario""",
    "dim_usuario",
)
def masked_profile(e: Entities) -> DataFrame:
    return gold.masked_profile(e.dim_user)


_ENGAGEMENT_ROWS = """SELECT data_hora, CAST(date_trunc('month', data_hora) AS DATE) AS mes, dayname(data_hora) AS dia_semana, CASE WHEN hour(data_hora) < 6 THEN 'madrugada' WHEN hour(data_hora) < 12 THEN 'manhã' WHEN hour(data_hora) < 18 THEN 'tarde' ELSE 'noite' END AS periodo_do_dia,
'usr_' || left(usuario_chave, 4) || '***' || right(usuario_chave, 4) AS usuario_mascarado, conteudo_mestre_id, titulo, tipo, categoria, nivel, faixa_duracao, tipo_interacao, CAST(eh_consumo AS INTEGER) AS consumo, CAST(eh_conclusao AS INTEGER) AS conclusao, percentual_conclusao, tempo_consumido, avaliacao_atribuida,
CAST(data - data_publicacao AS INTEGER) AS dias_desde_publicacao, anterior_a_publicacao FROM fato_interacao JOIN dim_conteudo USING (conteudo_mestre_id)"""


@query(_ENGAGEMENT_ROWS, "fato_interacao", "dim_conteudo")
def engagement_rows(e: Entities) -> DataFrame:
    return bi.engagement_rows(e.fact_interaction, e.dim_content)


_CONVERSION_ROWS = """SELECT CAST(date_trunc('month', data_geracao) AS DATE) AS mes_geracao, categoria, tipo, CASE WHEN posicao <= 3 THEN '1–3 (topo)' WHEN posicao <= 6 THEN '4–6' ELSE '7–10' END AS faixa_posicao, status, count(*) AS recomendacoes, count(*) FILTER (WHERE convertida) AS convertidas, count(*) FILTER (WHERE concluida) AS concluidas,
CAST((2 * CAST(sum(pontuacao) * 100 AS BIGINT) + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS pontuacao_media FROM fato_recomendacao JOIN dim_conteudo USING (conteudo_mestre_id) WHERE geracao_vigente GROUP BY ALL"""


@query(_CONVERSION_ROWS, "fato_recomendacao", "dim_conteudo")
def recommendation_conversion_rows(e: Entities) -> DataFrame:
    return bi.recommendation_conversion_rows(e.fact_recommendation, e.dim_content)


_NOTES = "SELECT conteudo_mestre_id, CAST(avaliacao_atribuida AS DOUBLE) AS nota FROM fato_interacao WHERE avaliacao_atribuida IS NOT NULL UNION ALL SELECT conteudo_mestre_id, CAST(avaliacao AS DOUBLE) FROM fato_comentario"
_ACTIONS = f"""SELECT conteudo_mestre_id, titulo, tipo, categoria, nivel, usuarios, interacoes, nota_media, coalesce(qtd_notas, 0) AS qtd_notas,
CASE WHEN m > 0 AND dd < 0 THEN m - 1 WHEN m < 0 AND dd > 0 THEN m + 1 ELSE m END AS meses_publicado,
CASE WHEN usuarios > mediana AND nota_media >= 4 THEN 'Promover' WHEN usuarios > mediana AND nota_media < 3.5 THEN 'Revisar conteúdo' WHEN usuarios <= mediana AND nota_media >= 4 THEN 'Divulgar' WHEN usuarios <= mediana AND nota_media < 3.5 THEN 'Reavaliar no catálogo' ELSE 'Acompanhar' END AS classificacao
FROM (SELECT d.*, u.*, n.nota_media, n.qtd_notas, CAST((year(ultima) - year(data_publicacao)) * 12 + month(ultima) - month(data_publicacao) AS INTEGER) AS m, day(ultima) - day(data_publicacao) AS dd
FROM dim_conteudo d JOIN (SELECT conteudo_mestre_id AS u_id, count(DISTINCT usuario_chave) AS usuarios, count(*) AS interacoes, max(data_hora) AS ultima FROM fato_interacao GROUP BY 1) u ON u.u_id = d.conteudo_mestre_id
LEFT JOIN (SELECT conteudo_mestre_id AS n_id, round(avg(nota), 2) AS nota_media, count(nota) AS qtd_notas FROM ({_NOTES}) GROUP BY 1) n ON n.n_id = d.conteudo_mestre_id)
CROSS JOIN (SELECT quantile_cont(usuarios, 0.5) AS mediana FROM (SELECT count(DISTINCT usuario_chave) AS usuarios FROM fato_interacao GROUP BY conteudo_mestre_id))"""


@query(_ACTIONS, "dim_conteudo", "fato_interacao", "fato_comentario")
def action_list(e: Entities) -> DataFrame:
    return bi.action_list(e.dim_content, e.fact_interaction, e.fact_comment)


@query(f"SELECT tipo, round(CAST(sum(tempo_consumido) AS DOUBLE) / count(tempo_consumido), 2) AS tempo_medio, round(CAST(sum(percentual_conclusao) AS DOUBLE) / count(percentual_conclusao), 2) AS percentual_medio FROM ({_ENGAGEMENT_ROWS}) GROUP BY 1", "fato_interacao", "dim_conteudo")
def operational_means(e: Entities) -> DataFrame:
    return bi.chart_query(engagement_rows(e), bi.Chart("", "engagement_rows", ("tipo",), ("tempo_medio", "percentual_medio")))


@query(f"SELECT faixa_posicao, round(100.0 * sum(CASE WHEN status = 'Positivo' THEN recomendacoes ELSE 0 END) / sum(recomendacoes), 2) AS positivas_pct FROM ({_CONVERSION_ROWS}) GROUP BY 1", "fato_recomendacao", "dim_conteudo")
def positive_share(e: Entities) -> DataFrame:
    return bi.chart_query(recommendation_conversion_rows(e), bi.Chart("", "recommendation_conversion_rows", ("faixa_posicao",), ("positivas_pct",)))


@query(_NOTES, "fato_interacao", "fato_comentario")
def union_notes(e: Entities) -> DataFrame:
    return bi.ratings(e.fact_interaction, e.fact_comment)


@query("SELECT round(100.0 * count(*) FILTER (WHERE convertida) / nullif(count(*), 0), 2) AS taxa_conversao_pct FROM fato_recomendacao WHERE geracao_vigente", "fato_recomendacao")
def alert_value(e: Entities) -> DataFrame:
    return bi.conversion_value(e.fact_recommendation)


def _chart(e: Entities, number: int, filters=()) -> DataFrame:
    chart = bi.CHARTS[number]
    rows = {"engagement_rows": engagement_rows, "recommendation_conversion_rows": recommendation_conversion_rows, "action_list": action_list}[chart.dataset](e)
    return bi.chart_query(rows, chart, filters)


@query(f"SELECT mes, usuarios_ativos, lag(usuarios_ativos) OVER (ORDER BY mes) AS usuarios_ativos_anterior FROM (SELECT mes, count(DISTINCT usuario_mascarado) AS usuarios_ativos FROM ({_ENGAGEMENT_ROWS}) GROUP BY 1)", "fato_interacao", "dim_conteudo")
def chart_active_users(e: Entities) -> DataFrame:
    return _chart(e, 0)


@query(f"SELECT mes, round(CAST(sum(conclusao) AS DOUBLE) / nullif(sum(consumo), 0), 4) AS taxa_conclusao FROM ({_ENGAGEMENT_ROWS}) GROUP BY 1", "fato_interacao", "dim_conteudo")
def chart_completion_rate(e: Entities) -> DataFrame:
    return _chart(e, 1)


@query(f"SELECT categoria, count(*) AS interacoes, count(DISTINCT usuario_mascarado) AS usuarios_ativos FROM ({_ENGAGEMENT_ROWS}) WHERE tipo IN ('Curso', 'Vídeo') AND data_hora >= TIMESTAMP '2024-02-01' AND data_hora < TIMESTAMP '2024-06-01' GROUP BY 1", "fato_interacao", "dim_conteudo")
def chart_by_category_filtered(e: Entities) -> DataFrame:
    from datetime import datetime

    return _chart(e, 2, (("tipo", "IN", ("Curso", "Vídeo")), ("data_hora", "range", (datetime(2024, 2, 1), datetime(2024, 6, 1)))))


@query(f"SELECT tipo, round(CAST(sum(conclusao) AS DOUBLE) / nullif(sum(consumo), 0), 4) AS taxa_conclusao, CAST(sum(conclusao) AS BIGINT) AS conclusoes FROM ({_ENGAGEMENT_ROWS}) GROUP BY 1", "fato_interacao", "dim_conteudo")
def chart_completion_by_kind(e: Entities) -> DataFrame:
    return _chart(e, 3)


@query(f"SELECT dia_semana, periodo_do_dia, count(*) AS interacoes FROM ({_ENGAGEMENT_ROWS}) GROUP BY 1, 2", "fato_interacao", "dim_conteudo")
def chart_by_day_part(e: Entities) -> DataFrame:
    return _chart(e, 4)


@query(f"SELECT faixa_posicao, status, round(CAST(sum(convertidas) AS DOUBLE) / nullif(sum(recomendacoes), 0), 4) AS taxa_conversao, CAST(sum(recomendacoes) AS BIGINT) AS total_recomendacoes FROM ({_CONVERSION_ROWS}) GROUP BY 1, 2", "fato_recomendacao", "dim_conteudo")
def chart_conversion_by_position(e: Entities) -> DataFrame:
    return _chart(e, 5)


@query(f"SELECT classificacao, count(*) AS conteudos FROM ({_ACTIONS}) GROUP BY 1", "dim_conteudo", "fato_interacao", "fato_comentario")
def chart_actions(e: Entities) -> DataFrame:
    return _chart(e, 6)


@query("SELECT * FROM (SELECT *, max(data_geracao) OVER () AS ultima FROM recomendacao) WHERE data_geracao = ultima", "recomendacao")
def latest_generation_global(e: Entities) -> DataFrame:
    last = e.recommendations.agg(F.max("data_geracao").alias("ultima"))
    return recommend.latest_run(e.recommendations).crossJoin(F.broadcast(last))


@query("SELECT count(*) AS incoerentes FROM recomendacao r JOIN interacao i USING (usuario_id, conteudo_id) WHERE tipo_interacao = 'conclusão' OR percentual_conclusao >= 100", "recomendacao", "interacao")
def recommended_yet_completed(e: Entities) -> DataFrame:
    i = e.interactions.where((F.col("tipo_interacao") == "conclusão") | (F.col("percentual_conclusao") >= 100)).select("usuario_id", "conteudo_id")
    return e.recommendations.join(i, ["usuario_id", "conteudo_id"]).agg(F.count("*").alias("incoerentes"))


@query("SELECT ano_mes, categoria, CASE WHEN usuarios_ativos % 2 = 0 THEN 'taxa_conclusao' ELSE '' END AS diferem FROM (SELECT strftime(data_hora, '%Y-%m') AS ano_mes, coalesce(categoria, 'Não catalogado') AS categoria, " + _MEASURES + " FROM interacao LEFT JOIN catalogo USING (conteudo_id) GROUP BY 1, 2) WHERE usuarios_ativos % 2 = 0 AND taxa_conclusao IS NOT NULL", "interacao", "catalogo")
def output_differences(e: Entities) -> DataFrame:
    a = engagement_by_bucket_category(e)
    b = a.withColumn("taxa_conclusao", F.when(F.col("usuarios_ativos") % 2 == 0, F.col("taxa_conclusao") + 1e-6).otherwise(F.col("taxa_conclusao") + 1e-12))
    return engagement.differences(a, b, ["ano_mes", "categoria"]).withColumn("diferem", F.array_join("diferem", ","))


# --- validated layer, checks and the quality gate ---

_TEXT_SQL = """(SELECT ordinal, CASE WHEN ordinal % 83 = 0 THEN 'x' WHEN ordinal % 79 = 0 THEN '99999' ELSE CAST(conteudo_id AS VARCHAR) END AS raw_conteudo_id, CAST(usuario_id AS VARCHAR) AS raw_usuario_id, CASE WHEN ordinal % 97 = 0 THEN ' ' WHEN ordinal % 101 = 0 THEN 'outro' ELSE tipo_interacao END AS raw_tipo_interacao,
CASE WHEN ordinal % 89 = 0 THEN '150.00' ELSE CAST(percentual_conclusao AS VARCHAR) END AS raw_percentual_conclusao, CAST(avaliacao_atribuida AS VARCHAR) AS raw_avaliacao_atribuida, date_trunc('hour', data_hora) AS data_hora FROM interacao)"""
_TYPED_SQL = f"(SELECT *, TRY_CAST(raw_conteudo_id AS INTEGER) AS conteudo_id, CAST(raw_usuario_id AS INTEGER) AS usuario_id, raw_tipo_interacao AS tipo_interacao, CAST(raw_percentual_conclusao AS DOUBLE) AS percentual_conclusao, CAST(raw_avaliacao_atribuida AS DOUBLE) AS avaliacao_atribuida FROM {_TEXT_SQL})"


def text_interactions(e: Entities) -> DataFrame:
    """Interactions as read from a file, with planted defects; times cut to the hour so that keys repeat."""
    at = F.col("ordinal")
    text = lambda c: F.col(c).cast("string")
    return e.interactions.select(
        "ordinal",
        text("usuario_id").alias("usuario_id"),
        F.when(at % 83 == 0, "x").when(at % 79 == 0, "99999").otherwise(text("conteudo_id")).alias("conteudo_id"),
        F.when(at % 97 == 0, " ").when(at % 101 == 0, "outro").otherwise(F.col("tipo_interacao")).alias("tipo_interacao"),
        F.date_format(F.date_trunc("hour", "data_hora"), "yyyy-MM-dd'T'HH:mm:ss").alias("data_hora"),
        text("tempo_consumido").alias("tempo_consumido"),
        F.when(at % 89 == 0, "150.00").otherwise(text("percentual_conclusao")).alias("percentual_conclusao"),
        text("avaliacao_atribuida").alias("avaliacao_atribuida"),
        F.lit("interacoes.json").alias("origem"), F.lit("2025/01/01 00:00:00.000").alias("data_ingestao"), F.lit("run-1").alias("id_execucao"),
    )


_AUDIT_COLUMNS = {"origem": "lote", "data_ingestao": "2025/01/01 00:00:00.000", "id_execucao": "run-1"}


def _both(text: DataFrame, contract: Contract) -> DataFrame:
    """Text as read from a file beside its typed form."""
    text = text.withColumns({k: F.lit(v) for k, v in _AUDIT_COLUMNS.items() if k not in text.columns})
    typed_ = [typed(F.col(f.name), f, contract.formats.get(f.name), True).alias(f.name) for f in contract.schema]
    return text.select("ordinal", *[F.col(n).alias(f"raw_{n}") for n in contract.schema.names], *typed_)


def batch_of(e: Entities) -> quality.Batch:
    """All sources as text, with planted defects."""
    c, at = e.catalogue, F.col("conteudo_id")
    catalogue = c.select(
        at.cast("long").alias("ordinal"), *[F.col(n).cast("string").alias(n) for n in c.columns if n not in ("titulo", "nivel")],
        F.when(at % 97 == 0, " ").otherwise(F.col("titulo")).alias("titulo"), F.when(at % 89 == 0, "Expert").otherwise(F.col("nivel")).alias("nivel"),
    )
    comments = e.comments.select(
        "ordinal", *[F.col(n).cast("string").alias(n) for n in ("usuario_id", "conteudo_id", "tags", "data")],
        F.when(F.col("ordinal") % 71 == 0, 7).otherwise(F.col("avaliacao")).cast("string").alias("avaliacao"), F.coalesce("comentario", F.lit("")).alias("comentario"),
    )
    return quality.Batch({"catalogo": _both(catalogue, CATALOGUE), "interacoes": _both(text_interactions(e), INTERACTION), "comentarios": _both(comments, COMMENT)}, e.users)


@query(
    f"""SELECT id_regra, 'interacoes' AS fonte, avaliados, violados, round(100.0 * (avaliados - violados) / avaliados, 3) AS metrica FROM (
SELECT 'QD01' AS id_regra, count(*) AS avaliados, count(*) FILTER (WHERE trim(raw_tipo_interacao) = '') AS violados FROM {_TYPED_SQL}
UNION ALL SELECT 'QD02', count(*), count(*) FILTER (WHERE conteudo_id IS NULL OR tipo_interacao NOT IN ('início', 'visualização', 'curtida', 'compartilhamento', 'conclusão', 'avaliação') OR percentual_conclusao NOT BETWEEN 0 AND 100) FROM {_TYPED_SQL}
UNION ALL SELECT 'QD03', count(*), count(*) FILTER (WHERE vez > 1) FROM (SELECT row_number() OVER (PARTITION BY usuario_id, conteudo_id, tipo_interacao, data_hora ORDER BY ordinal) AS vez FROM {_TYPED_SQL})
UNION ALL SELECT 'QD04', count(*), count(*) FILTER (WHERE c.conteudo_id IS NULL OR u.usuario_id IS NULL) FROM {_TYPED_SQL} t LEFT JOIN catalogo c ON c.conteudo_id = t.conteudo_id LEFT JOIN usuario u ON u.usuario_id = t.usuario_id
UNION ALL SELECT 'QD05', count(*), count(*) FILTER (WHERE (tipo_interacao = 'conclusão') <> (percentual_conclusao = 100) OR (tipo_interacao = 'avaliação' AND avaliacao_atribuida IS NULL)) FROM {_TYPED_SQL}
UNION ALL SELECT 'QD06', count(*), count(*) FILTER (WHERE CAST(data_hora AS DATE) < c.data_publicacao) FROM {_TYPED_SQL} t LEFT JOIN catalogo c ON c.conteudo_id = t.conteudo_id)""",
    "interacao", "catalogo", "usuario",
)
def quality_metrics(e: Entities) -> DataFrame:
    return quality.metric_rows(batch_of(e), "interacoes")


@query(
    """SELECT id_regra, 'catalogo' AS fonte, avaliados, violados, round(100.0 * (avaliados - violados) / avaliados, 3) AS metrica FROM (
SELECT 'QD01' AS id_regra, count(*) AS avaliados, count(*) FILTER (WHERE conteudo_id % 97 = 0) AS violados FROM catalogo
UNION ALL SELECT 'QD02', count(*), count(*) FILTER (WHERE conteudo_id % 89 = 0 OR carga_horaria_min <= 0) FROM catalogo UNION ALL SELECT 'QD03', count(*), count(*) - count(DISTINCT conteudo_id) FROM catalogo)""",
    "catalogo",
)
def quality_catalogue(e: Entities) -> DataFrame:
    return quality.metric_rows(batch_of(e), "catalogo")


_NOTED_SQL = "(SELECT ordinal, usuario_id, conteudo_id, CASE WHEN ordinal % 71 = 0 THEN 7 ELSE avaliacao END AS nota, coalesce(comentario, '') AS texto, tags, data FROM comentario)"


@query(
    f"""SELECT id_regra, 'comentarios' AS fonte, avaliados, violados, round(100.0 * (avaliados - violados) / avaliados, 3) AS metrica FROM (
SELECT 'QD01' AS id_regra, count(*) AS avaliados, count(*) FILTER (WHERE trim(texto) = '' OR tags IS NULL) AS violados FROM {_NOTED_SQL}
UNION ALL SELECT 'QD02', count(*), count(*) FILTER (WHERE nota NOT BETWEEN 1 AND 5) FROM {_NOTED_SQL}
UNION ALL SELECT 'QD03', count(*), count(*) FILTER (WHERE vez > 1) FROM (SELECT row_number() OVER (PARTITION BY usuario_id, conteudo_id, data, texto ORDER BY ordinal) AS vez FROM {_NOTED_SQL})
UNION ALL SELECT 'QD04', count(*), count(*) FILTER (WHERE c.conteudo_id IS NULL OR u.usuario_id IS NULL) FROM {_NOTED_SQL} t LEFT JOIN catalogo c ON c.conteudo_id = t.conteudo_id LEFT JOIN usuario u ON u.usuario_id = t.usuario_id
UNION ALL SELECT 'QD06', count(*), count(*) FILTER (WHERE t.data < c.data_publicacao) FROM {_NOTED_SQL} t LEFT JOIN catalogo c ON c.conteudo_id = t.conteudo_id)""",
    "comentario", "catalogo", "usuario",
)
def quality_comments(e: Entities) -> DataFrame:
    return quality.metric_rows(batch_of(e), "comentarios")


_SPLIT_SQL = f"""(SELECT ordinal, coalesce(regra, CASE WHEN row_number() OVER (PARTITION BY usuario_id, conteudo_id, tipo_interacao, data_hora, CASE WHEN regra IS NULL THEN -1 ELSE ordinal END ORDER BY ordinal) > 1 THEN 'DUPLICIDADE' END) AS regra_violada FROM
(SELECT t.*, CASE WHEN t.conteudo_id IS NULL OR trim(t.tipo_interacao) = '' THEN 'CAMPOS_OBRIGATORIOS' WHEN t.tipo_interacao NOT IN ('início', 'visualização', 'curtida', 'compartilhamento', 'conclusão', 'avaliação') OR percentual_conclusao NOT BETWEEN 0 AND 100 THEN 'VALORES_PERMITIDOS'
WHEN c.conteudo_id IS NULL THEN 'REFERENCIA_CONTEUDO' WHEN u.usuario_id IS NULL THEN 'REFERENCIA_USUARIO' END AS regra FROM {_TYPED_SQL} t LEFT JOIN catalogo c ON c.conteudo_id = t.conteudo_id LEFT JOIN usuario u ON u.usuario_id = t.usuario_id))"""


@query(f"SELECT * FROM {_SPLIT_SQL}", "interacao", "catalogo", "usuario")
def silver_split(e: Entities) -> DataFrame:
    rows = batch_of(e).sources["interacoes"]
    return layers.classify(rows, INTERACTION, e.catalogue, e.users).select("ordinal", "regra_violada")


@query(
    f"""SELECT 'QD07' AS id_regra, count(*) AS avaliados, count(*) - (SELECT count(*) FROM interacao) AS violados, 100.0 * (SELECT count(*) FROM interacao) / count(*) AS metrica FROM {_SPLIT_SQL}
UNION ALL SELECT 'QD08', count(*), count(*) FILTER (WHERE regra_violada IS NOT NULL), round(100.0 * count(*) FILTER (WHERE regra_violada IS NOT NULL) / count(*), 3) FROM {_SPLIT_SQL}""",
    "interacao", "catalogo", "usuario",
)
def quality_volume(e: Entities) -> DataFrame:
    """The gate's rules on counts, from one aggregate over the split."""
    rows = layers.classify(batch_of(e).sources["interacoes"], INTERACTION, e.catalogue, e.users)
    n = rows.agg(F.count_if(F.col("regra_violada").isNull()).alias("silver"), F.count_if(F.col("regra_violada").isNotNull()).alias("quarentena")).first()  # one row
    bronze = e.interactions.count()
    found = [(r.id, *r.counts(bronze, n["silver"], n["quarentena"])) for r in quality.RULES if r.counts]
    return e.spark.createDataFrame([(i, a, b, round(m, 3)) for i, a, b, m in found], "id_regra string, avaliados long, violados long, metrica double")


_RUNS_SQL = "(SELECT 'run-' || CAST(event_id AS VARCHAR) AS id_execucao, CASE WHEN event_type = 'error' THEN 'falha' ELSE 'sucesso' END AS situacao, event_type = 'view' AS simulada, CASE WHEN event_id % 11 <> 0 THEN date_trunc('hour', ts) END AS fim FROM events)"


@query(f"SELECT 'ultima' AS busca, id_execucao, situacao, fim FROM (SELECT * FROM {_RUNS_SQL} WHERE NOT simulada AND fim IS NOT NULL ORDER BY fim DESC, id_execucao DESC LIMIT 1) UNION ALL SELECT 'por id', id_execucao, situacao, fim FROM {_RUNS_SQL} WHERE id_execucao = 'run-7'")
def gate_lookup(e: Entities) -> DataFrame:
    kind = F.col("event_type")
    runs = e.table("events").select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("id_execucao"), F.when(kind == "error", "falha").otherwise("sucesso").alias("situacao"), (kind == "view").alias("simulada"),
        F.when(F.col("event_id") % 11 != 0, F.date_trunc("hour", "ts").cast("timestamp_ntz")).alias("fim"),
    )
    both = quality.gate_run(runs).withColumn("busca", F.lit("ultima")).unionByName(quality.gate_run(runs, "run-7").withColumn("busca", F.lit("por id")))
    return both.select("busca", "id_execucao", "situacao", "fim")


@query(f"SELECT regra_violada, count(*) AS linhas FROM {_SPLIT_SQL} WHERE regra_violada IS NOT NULL GROUP BY 1", "interacao", "catalogo", "usuario")
def quarantine_by_rule(e: Entities) -> DataFrame:
    bad = layers.silver_split(batch_of(e).sources["interacoes"], INTERACTION, e.catalogue, e.users)[1]
    return bad.groupBy("regra_violada").agg(F.count("*").alias("linhas"))


@query(
    f"""SELECT 'usuario_id=' || raw_usuario_id || '|conteudo_id=' || raw_conteudo_id || '|tipo_interacao=' || raw_tipo_interacao || '|data_hora=' || strftime(data_hora, '%Y-%m-%dT%H:%M:%S') AS registro, array_to_string(falhas, '; ') AS mensagem FROM
(SELECT *, list_filter([CASE WHEN conteudo_id IS NULL THEN 'conteudo_id em formato inválido' END, CASE WHEN tipo_interacao NOT IN ('início', 'visualização', 'curtida', 'compartilhamento', 'conclusão', 'avaliação') THEN 'tipo_interacao fora do domínio' END,
CASE WHEN percentual_conclusao NOT BETWEEN 0 AND 100 THEN 'percentual_conclusao fora de 0–100' END], lambda x: x IS NOT NULL) AS falhas FROM {_TYPED_SQL}) WHERE len(falhas) > 0 ORDER BY ordinal LIMIT 5""",
    "interacao",
)
def quality_sample(e: Entities) -> DataFrame:
    return quality.sample_of(batch_of(e), quality.RULES[1], "interacoes")


_HISTORY_SQL = "(SELECT 'run-' || CAST(event_id % 7 AS VARCHAR) AS id_execucao, event_type AS id_regra, CASE WHEN event_type IN ('click', 'view') THEN '>=' ELSE '<=' END AS operador, round(abs(value), 3) AS metrica, event_id % 50 <> 0 AS aprovado FROM events)"
_WORST_SQL = f"(SELECT id_execucao, id_regra, CASE WHEN operador = '>=' THEN min(metrica) ELSE max(metrica) END AS metrica, bool_and(aprovado) AS aprovado FROM {_HISTORY_SQL} GROUP BY id_execucao, id_regra, operador)"


def _history(e: Entities) -> DataFrame:
    kind = F.col("event_type")
    return e.table("events").select(F.concat(F.lit("run-"), (F.col("event_id") % 7).cast("string")).alias("id_execucao"), kind.alias("id_regra"), F.when(kind.isin("click", "view"), ">=").otherwise("<=").alias("operador"), F.round(F.abs("value"), 3).alias("metrica"), (F.col("event_id") % 50 != 0).alias("aprovado"))


@query(f"SELECT * FROM {_WORST_SQL}")
def quality_worst(e: Entities) -> DataFrame:
    return quality.worst_by_rule(_history(e))


@query(f"SELECT id_execucao, id_regra, min(metrica) AS metrica_pior FROM {_WORST_SQL} GROUP BY 1, 2")
def chart_quality(e: Entities) -> DataFrame:
    return bi.chart_query(quality_worst(e), bi.CHARTS[7])


@query(f"SELECT id_execucao, " + ", ".join(f"max(metrica) FILTER (WHERE id_regra = '{r}') AS {r}" for r in ("click", "error", "purchase", "signup", "view")) + f" FROM {_WORST_SQL} GROUP BY 1")
def quality_evolution(e: Entities) -> DataFrame:
    return quality.evolution(quality_worst(e), ["click", "error", "purchase", "signup", "view"])


@query("SELECT event_id, user_id, event_type, props, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS n FROM events) WHERE n = 1")
def dedupe_keep_first(e: Entities) -> DataFrame:
    return layers.keep_first(e.table("events").select("event_id", "user_id", "event_type", "props", "value"), ["user_id", "event_type", "props"], "event_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) > 1 AS repetido, count(*) OVER (PARTITION BY user_id, event_type, props) > 1 AS chave_duplicada FROM events")
def duplicate_flag(e: Entities) -> DataFrame:
    return layers.duplicate_flags(e.table("events"), ["user_id", "event_type", "props"], "event_id").select("event_id", "repetido", "chave_duplicada")


@query("SELECT l_orderkey, l_linenumber, count(*) AS linhas FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL")
def broken_keys(e: Entities) -> DataFrame:
    return validation.broken_keys(e.table("lineitem"), ["l_orderkey", "l_linenumber"])


_CLASS_SQL = f"""(SELECT ordinal, CASE WHEN trim(raw_tipo_interacao) = '' THEN 'incompleto' WHEN len(falhas) > 0 THEN 'invalido' WHEN vezes > 1 THEN 'duplicado' ELSE 'valido' END AS situacao, CASE WHEN trim(raw_tipo_interacao) = '' THEN 'Campos obrigatórios ausentes: tipo_interacao' WHEN len(falhas) > 0 THEN array_to_string(falhas, ' ') WHEN vezes > 1 THEN 'Registro duplicado conforme a regra da fonte.' ELSE '' END AS motivos FROM
(SELECT *, list_filter([CASE WHEN usuario_id <= 0 THEN 'usuario_id inválido.' END, CASE WHEN conteudo_id IS NULL OR conteudo_id <= 0 THEN 'conteudo_id inválido.' END, CASE WHEN raw_tipo_interacao NOT IN ('início', 'visualização', 'curtida', 'compartilhamento', 'conclusão', 'avaliação') THEN 'tipo_interacao inválido.' END, CASE WHEN percentual_conclusao NOT BETWEEN 0 AND 100 THEN 'percentual_conclusao inválido.' END], lambda x: x IS NOT NULL) AS falhas,
count(*) OVER (PARTITION BY raw_usuario_id, raw_conteudo_id, raw_tipo_interacao, data_hora) AS vezes FROM {_TYPED_SQL}))"""


def _classified(e: Entities) -> DataFrame:
    required = ["usuario_id", "conteudo_id", "tipo_interacao", "data_hora", "tempo_consumido", "percentual_conclusao"]
    return validation.classified(text_interactions(e), "interacoes", required, list(INTERACTION.key))


@query(f"SELECT * FROM {_CLASS_SQL}", "interacao")
def classify_rows(e: Entities) -> DataFrame:
    return _classified(e).select("ordinal", "situacao", F.array_join("motivos", " ").alias("motivos"))


@query(f"SELECT count(*) FILTER (WHERE situacao = 'valido') AS valido, count(*) FILTER (WHERE situacao = 'invalido') AS invalido, count(*) FILTER (WHERE situacao = 'incompleto') AS incompleto, count(*) FILTER (WHERE situacao = 'duplicado') AS duplicado FROM {_CLASS_SQL}", "interacao")
def situation_counts(e: Entities) -> DataFrame:
    return validation.situation_counts(_classified(e))


@query("SELECT conteudo_id, 'Curso de ' || lower(titulo) AS titulo, upper(left(tipo, 1)) || lower(substr(tipo, 2)) AS tipo, upper(left(nivel, 1)) || lower(substr(nivel, 2)) AS nivel, CAST(carga_horaria_min AS DOUBLE) AS carga_horaria_min FROM catalogo", "catalogo")
def treated_rows(e: Entities) -> DataFrame:
    raw = e.catalogue.select(F.col("conteudo_id").cast("string").alias("conteudo_id"), F.concat(F.lit("  Curso de "), F.lower("titulo"), F.lit("\t\n")).alias("titulo"), F.upper("tipo").alias("tipo"), F.concat(F.lit(" "), F.lower("nivel")).alias("nivel"), F.col("carga_horaria_min").cast("string").alias("carga_horaria_min"))
    return validation.treated(raw, "catalogo").drop("corrigido")


@query("SELECT p_partkey, p_name LIKE ' %' OR p_name LIKE '% ' AS espacos, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS capitalizado, round_even(CAST(p_retailprice AS DECIMAL(18,4)) / 8, 2) AS arredondado, p_partkey % 2 = 0 AS lista FROM part")
def scalar_functions(e: Entities) -> DataFrame:
    text = F.concat(F.col("p_name"), F.lit(""))
    number = F.bround(comma_decimal(F.replace(F.col("p_retailprice").cast("decimal(18,4)").cast("string"), F.lit("."), F.lit(","))).cast("decimal(18,4)") / 8, 2).cast("double")
    document = F.when(F.col("p_partkey") % 2 == 0, F.lit('["a"]')).otherwise(F.lit('{"a":1}'))
    return e.table("part").select("p_partkey", (trimmed(text) != text).alias("espacos"), capitalised("p_name").alias("capitalizado"), number.alias("arredondado"), json_list(document).alias("lista"))


@query("SELECT CASE event_type WHEN 'error' THEN 'erro' ELSE 'outros' END AS ramo, CASE event_type WHEN 'signup' THEN 'conclusão' ELSE event_type END AS event_type, count(*) AS linhas FROM events GROUP BY ALL")
def routed_and_mapped(e: Entities) -> DataFrame:
    branches = layers.route(e.table("events"), "event_type", {"erro": "error"})
    out = None
    for name, df in branches.items():
        part = layers.mapped_values(df, "event_type", {"signup": "conclusão"}).groupBy("event_type").agg(F.count("*").alias("linhas")).select(F.lit(name).alias("ramo"), "event_type", "linhas")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT tipo_interacao, count(*) AS linhas, count(DISTINCT usuario_id) AS usuarios FROM (SELECT tipo_interacao, usuario_id + copia * (1 + (SELECT max(usuario_id) FROM interacao)) AS usuario_id FROM interacao, (VALUES (0), (1), (2)) AS v(copia)) GROUP BY 1", "interacao")
def volume_replicate(e: Entities) -> DataFrame:
    return layers.replicated(e.interactions, 3).groupBy("tipo_interacao").agg(F.count("*").alias("linhas"), F.count_distinct("usuario_id").alias("usuarios"))


@query("""SELECT count(*) AS linhas, count(*) FILTER (WHERE p = '150.00') AS p150, count(*) FILTER (WHERE p = '80.00') AS p80, count(*) FILTER (WHERE c = '99999') AS c99999 FROM (SELECT CASE WHEN o IN (SELECT ordinal FROM interacao WHERE tipo_interacao = 'conclusão' ORDER BY ordinal LIMIT 2) THEN '80.00' WHEN o IN (20, 21, 22) THEN '150.00' ELSE CAST(q AS VARCHAR) END AS p, CASE WHEN o IN (30, 31) THEN '99999' ELSE '' END AS c
FROM (SELECT ordinal AS o, percentual_conclusao AS q FROM interacao UNION ALL SELECT ordinal, percentual_conclusao FROM interacao WHERE ordinal BETWEEN 40 AND 44))""", "interacao")
def defect_injection(e: Entities) -> DataFrame:
    rows = layers.with_defects(e.interactions, INTERACTION)
    return rows.agg(F.count("*").alias("linhas"), F.count_if(F.col("percentual_conclusao") == "150.00").alias("p150"), F.count_if(F.col("percentual_conclusao") == "80.00").alias("p80"), F.count_if(F.col("conteudo_id") == "99999").alias("c99999"))


# --- master data ---


@query("SELECT conteudo_id, chave, candidato FROM origem", "origem")
def master_match_key(e: Entities) -> DataFrame:
    return e.origins.select("conteudo_id", match_key().alias("chave"), candidate_key().alias("candidato"))


@query("SELECT conteudo_id, titulo, tipo, categoria, nivel, carga_horaria_min, data_publicacao, descricao, autor, array_to_string(fontes, ',') AS fontes FROM origem", "origem")
def master_resolved(e: Entities) -> DataFrame:
    return e.origins.withColumn("fontes", F.array_join("fontes", ","))


@query("SELECT conteudo_id, 'carga_horaria_min' AS atributo, 'entre_fontes' AS nivel_conflito, 'silver_catalogo=' || CAST(carga_horaria_min AS VARCHAR) || ';d1_postgres=' || CAST(carga_horaria_min + 1 AS VARCHAR) AS valores, CAST(carga_horaria_min AS VARCHAR) AS valor_escolhido, 'prioridade da fonte: silver_catalogo > d1_postgres' AS regra_sobrevivencia FROM catalogo WHERE tipo = 'Curso' AND nivel = 'Básico'", "catalogo")
def master_source_conflicts(e: Entities) -> DataFrame:
    found = master.source_conflicts(e.records)
    return found.withColumn("valores", F.array_join(F.transform("valores", lambda x: F.concat(x["fonte"], F.lit("="), x["valor"])), ";"))


@query("SELECT * REPLACE (array_to_string(membros, ',') AS membros) FROM grupo", "grupo")
def master_survivorship(e: Entities) -> DataFrame:
    return master.consolidated(e.origins).withColumn("membros", F.concat_ws(",", F.col("membros").cast("array<string>")))


@query("""SELECT arg_min(conteudo_id, (data_publicacao, conteudo_id)) AS conteudo_id, 'data_publicacao' AS atributo, CAST(min(data_publicacao) AS VARCHAR) AS valor_escolhido FROM origem GROUP BY chave HAVING count(DISTINCT data_publicacao) > 1
UNION ALL SELECT arg_min(conteudo_id, (data_publicacao, conteudo_id)), 'carga_horaria_min', CAST(arg_max(carga_horaria_min, (data_publicacao, conteudo_id)) AS VARCHAR) FROM origem GROUP BY chave HAVING count(DISTINCT carga_horaria_min) > 1
UNION ALL SELECT arg_min(conteudo_id, (data_publicacao, conteudo_id)), 'categoria', arg_max(categoria, (data_publicacao, conteudo_id)) FROM origem GROUP BY chave HAVING count(DISTINCT categoria) > 1""", "origem")
def master_duplicate_conflicts(e: Entities) -> DataFrame:
    return master.duplicate_conflicts(e.origins).select("conteudo_id", "atributo", "valor_escolhido")


@query("""SELECT array_to_string(list_sort(list(DISTINCT conteudo_id)), ',') AS conteudo_ids, arg_min(titulo, (data_publicacao, conteudo_id)) AS titulo, arg_min(autor, (data_publicacao, conteudo_id)) AS autor, 'diferem em ' || array_to_string(list_filter([CASE WHEN count(DISTINCT nivel) > 1 THEN 'nivel' END, CASE WHEN count(DISTINCT descricao) > 1 THEN 'descricao' END], lambda x: x IS NOT NULL), ' e ') AS motivo
FROM origem GROUP BY candidato HAVING count(DISTINCT chave) > 1""", "origem")
def master_candidates(e: Entities) -> DataFrame:
    return master.unmerged_candidates(e.origins).withColumn("conteudo_ids", F.concat_ws(",", F.col("conteudo_ids").cast("array<string>")))


@query("SELECT conteudo_mestre_id, conteudo_id_canonico, titulo, qtd_registros_origem FROM ouro", "ouro")
def master_ids(e: Entities) -> DataFrame:
    return e.golden.select("conteudo_mestre_id", "conteudo_id_canonico", "titulo", "qtd_registros_origem")


@query("""SELECT g.chave, coalesce(min(m.conteudo_mestre_id), 'novo') AS conteudo_mestre_id, greatest(count(DISTINCT m.conteudo_mestre_id) - 1, 0) AS absorvidos FROM grupo g LEFT JOIN (SELECT chave, 'CM-' || lpad(CAST(conteudo_id AS VARCHAR), 6, '0') AS conteudo_mestre_id FROM origem WHERE nivel = 'Básico') m ON m.chave = g.chave GROUP BY g.chave""", "grupo", "origem")
def master_ids_reused(e: Entities) -> DataFrame:
    prior = e.origins.where("nivel = 'Básico'").select(F.lit("silver_catalogo").alias("fonte"), F.col("conteudo_id").alias("id_origem"), F.format_string("CM-%06d", "conteudo_id").alias("conteudo_mestre_id"))
    found = master.with_master_ids(master.consolidated(e.origins), e.origins, prior, 10_000_000)
    return found.select("chave", F.when(F.col("conteudo_mestre_id") > "CM-1000000", "novo").otherwise(F.col("conteudo_mestre_id")).alias("conteudo_mestre_id"), F.size("absorvidos").cast("long").alias("absorvidos"))


_FIRST_RUN = "conteudo_id % 3 <> 0"


@query(
    f"""SELECT g.chave, coalesce(f.id, 'CM-' || lpad(CAST((SELECT count(DISTINCT chave) FROM origem WHERE {_FIRST_RUN}) + row_number() OVER (PARTITION BY f.id IS NULL ORDER BY g.data_publicacao, g.conteudo_id_canonico) AS VARCHAR), 6, '0')) AS conteudo_mestre_id FROM grupo g
LEFT JOIN (SELECT chave, 'CM-' || lpad(CAST(row_number() OVER (ORDER BY min(data_publicacao), arg_min(conteudo_id, (data_publicacao, conteudo_id))) AS VARCHAR), 6, '0') AS id FROM origem WHERE {_FIRST_RUN} GROUP BY chave) f USING (chave)""",
    "grupo", "origem",
)
def master_ids_second_run(e: Entities) -> DataFrame:
    """Contents that came after a first run get numbers beyond its own; all others keep theirs."""
    before = master.resolved(e.records.where(_FIRST_RUN))
    first = written(master.with_master_ids(master.consolidated(before), before), "ouro")
    prior = written(master.correspondence(first, before), "mapa")
    return master.with_master_ids(master.consolidated(e.origins), e.origins, prior).select("chave", "conteudo_mestre_id")


@query("SELECT fonte, id_origem, conteudo_mestre_id, regra FROM mapa", "mapa")
def master_members(e: Entities) -> DataFrame:
    return e.correspondence


# --- load semantics ---


@query("SELECT p_partkey, CASE WHEN p_size >= 25 THEN 'novo' ELSE 'antigo' END AS versao, CASE WHEN p_size < 35 THEN 1 ELSE 2 END AS primeira_vez FROM part")
def upsert(e: Entities) -> DataFrame:
    p = e.table("part")
    old = p.where("p_size < 35").select("p_partkey", F.lit("antigo").alias("versao"), F.lit(1).alias("primeira_vez"))
    new = p.where("p_size >= 25").select("p_partkey", F.lit("novo").alias("versao"), F.lit(2).alias("primeira_vez"))
    return sinks.upsert(old, new, ["p_partkey"], ("primeira_vez",))


@query("SELECT p_partkey, CASE WHEN p_size < 35 THEN 'antigo' ELSE 'novo' END AS versao FROM part")
def insert_ignore(e: Entities) -> DataFrame:
    p = e.table("part")
    old = p.where("p_size < 35").select("p_partkey", F.lit("antigo").alias("versao"))
    return sinks.insert_ignore(old, p.where("p_size >= 25").select("p_partkey", F.lit("novo").alias("versao")), ["p_partkey"])


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def delete_keys(e: Entities) -> DataFrame:
    p = e.table("part").select("p_partkey", "p_name", "p_size")
    return sinks.delete_keys(p.drop("p_size"), p.where("p_size < 10"), ["p_partkey"])


@query("SELECT event_id, user_id, event_type FROM events WHERE strftime(ts, '%Y-%m') = '2024-01'")
def month_prune(e: Entities) -> DataFrame:
    """A month as a range of the stored time, which reaches the files' statistics."""
    return e.table("events").where(in_month("ts", "2024-01")).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def range_pushdown(e: Entities) -> DataFrame:
    return e.table("events").where("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'").select("event_id", "user_id", "value")


# --- joins, sets, counts ---


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def orphans(e: Entities) -> DataFrame:
    return validation.orphans(e.table("customer").select("c_custkey"), e.table("events").select(F.col("user_id").alias("c_custkey")), ["c_custkey"])


@query("SELECT n_nationkey, n_name, count(s_suppkey) AS fornecedores FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def counts_keeping_empty(e: Entities) -> DataFrame:
    s = e.table("supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return e.table("nation").join(s, "n_nationkey", "left").groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("fornecedores"))


@query("SELECT usuario_id, conteudo_id FROM interacao WHERE tipo_interacao = 'curtida' OR avaliacao_atribuida >= 4 UNION SELECT usuario_id, conteudo_id FROM comentario WHERE avaliacao >= 4", "interacao", "comentario")
def liked_pairs(e: Entities) -> DataFrame:
    return recommend.liked_pairs(e.interactions, e.comments.where("avaliacao >= 4"))


@query("SELECT 'eventos' AS tabela, event_type AS grupo, count(*) AS linhas, round(avg(CAST(props->>'$.k' AS INTEGER)), 4) AS media FROM events GROUP BY 2 UNION ALL SELECT 'segmentos', c_mktsegment, count(*), round(avg(c_nationkey), 4) FROM customer GROUP BY 2")
def table_counts(e: Entities) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    a = e.table("events").groupBy(F.col("event_type").alias("grupo")).agg(F.count("*").alias("linhas"), F.round(F.avg(k), 4).alias("media")).select(F.lit("eventos").alias("tabela"), "grupo", "linhas", "media")
    b = e.table("customer").groupBy(F.col("c_mktsegment").alias("grupo")).agg(F.count("*").alias("linhas"), F.round(F.avg("c_nationkey"), 4).alias("media")).select(F.lit("segmentos").alias("tabela"), "grupo", "linhas", "media")
    return a.unionByName(b)


@query("SELECT conv_id, count(*) AS turnos, count(*) FILTER (WHERE role = 'user') AS do_usuario, min(turn) AS primeiro, max(turn) AS ultimo FROM conversations GROUP BY 1")
def conversation_shape(e: Entities) -> DataFrame:
    return e.table("conversations").groupBy("conv_id").agg(F.count("*").alias("turnos"), F.count_if(F.col("role") == "user").alias("do_usuario"), F.min("turn").alias("primeiro"), F.max("turn").alias("ultimo"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey ORDER BY n_nationkey LIMIT 10")
def first_rows(e: Entities) -> DataFrame:
    r = e.table("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return e.table("nation").join(F.broadcast(r), "n_regionkey").select("n_nationkey", "n_name", "r_name").orderBy("n_nationkey").limit(10)


# --- document store ---


@query("SELECT ordinal, usuario_id, conteudo_id FROM comentario WHERE list_contains(lista_tags, 'fr')", "comentario")
def array_contains_tag(e: Entities) -> DataFrame:
    return documents.with_tag(e.documents, "fr").select("ordinal", "usuario_id", "conteudo_id")


@query("SELECT ordinal, avaliacao FROM comentario WHERE avaliacao >= 2 AND avaliacao <= 3", "comentario")
def rating_range(e: Entities) -> DataFrame:
    return documents.rated(e.documents, 2, 3).select("ordinal", "avaliacao")


@query("SELECT ordinal, data FROM comentario WHERE conteudo_id = 7 ORDER BY data DESC", "comentario")
def comments_of_content(e: Entities) -> DataFrame:
    return documents.of_content(e.documents, 7).select("ordinal", "data")


@query("SELECT categoria, count(*) AS total, round(avg(avaliacao), 2) AS media FROM comentario JOIN catalogo USING (conteudo_id) GROUP BY 1", "comentario", "catalogo")
def category_comments(e: Entities) -> DataFrame:
    return documents.by_category(documents.enriched(e.documents, e.catalogue)[0])


@query("SELECT ordinal, conteudo_id FROM comentario WHERE conteudo_id NOT IN (SELECT conteudo_id FROM catalogo_parcial)", "comentario", "catalogo_parcial")
def comments_rejected(e: Entities) -> DataFrame:
    return documents.enriched(e.documents, e.part_catalogue)[1].select("ordinal", "conteudo_id")


@query("SELECT tag, count(*) AS total FROM (SELECT unnest(lista_tags) AS tag FROM comentario) GROUP BY 1 ORDER BY total DESC, tag LIMIT 10", "comentario")
def tag_frequency(e: Entities) -> DataFrame:
    return documents.tag_frequency(e.documents)


@query("SELECT usuario_id, array_to_string(list_sort(list(DISTINCT conteudo_id)), ',') AS conteudos FROM comentario WHERE avaliacao >= 4 GROUP BY 1", "comentario")
def positive_sets(e: Entities) -> DataFrame:
    return documents.positive_sets(e.documents).withColumn("conteudos", F.concat_ws(",", F.col("conteudos").cast("array<string>")))


# --- keys and pseudonyms ---


@query(f"SELECT c_custkey, {pseudonym_sql('c_custkey')} AS usuario_chave, 'usr_' || left(sha256(CAST(c_custkey AS VARCHAR) || 'sal'), 16) AS mascara FROM customer")
def pseudonyms(e: Entities) -> DataFrame:
    return e.table("customer").select("c_custkey", pseudonym("c_custkey", KEY).alias("usuario_chave"), salted_pseudonym("c_custkey", "sal").alias("mascara"))


@query("SELECT DISTINCT usuario_id, 'usr_' || left(sha256(CAST(usuario_id AS VARCHAR) || 'sal'), 16) AS usuario_mascarado FROM interacao WHERE usuario_id IS NOT NULL", "interacao")
def restricted_user_map(e: Entities) -> DataFrame:
    return engagement.masked_users(e.interactions, "sal")[1]


# --- vectors and recommendations ---


@query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1) SELECT CAST(vec_id AS INTEGER) AS conteudo_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS distancia_cosseno, round(list_distance(CAST(embedding AS DOUBLE[]), q), 6) AS distancia_l2, round(-list_inner_product(CAST(embedding AS DOUBLE[]), q), 6) + 0.0 AS produto_interno_negativo FROM embeddings, q WHERE vec_id <> 1")
def vector_metrics(e: Entities) -> DataFrame:
    found = search.compared_with(e.embeddings, 1)
    return found.select("conteudo_id", *[(F.round(c, 6) + 0.0).alias(c) for c in found.columns[1:]])


@query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1), d AS (SELECT CAST(vec_id AS INTEGER) AS conteudo_id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS d FROM embeddings, q WHERE vec_id <> 1) SELECT conteudo_id, round(d, 6) AS distancia, row_number() OVER (ORDER BY d, conteudo_id) AS posicao FROM d ORDER BY d, conteudo_id LIMIT 10")
def vector_topk(e: Entities) -> DataFrame:
    ref = e.embeddings.where("conteudo_id = 1").first()
    found = search.top_k(e.embeddings, list(ref["embedding"]), 10, "cosine", 1)
    return found.select("conteudo_id", F.round("distancia", 6).alias("distancia"), F.col("posicao").cast("long").alias("posicao"))


@query("SELECT label, pos, round(avg(x), 6) AS m FROM (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2")
def vector_profile(e: Entities) -> DataFrame:
    found = recommend.mean_vectors(e.embeddings, ["label"])
    return found.select("label", F.posexplode("vetor").alias("pos", "m")).select("label", F.col("pos").cast("long").alias("pos"), (F.round("m", 6) + 0.0).alias("m"))


_PROFILE = """vis AS (SELECT usuario_id, list(m ORDER BY pos) AS v FROM (SELECT usuario_id, pos, avg(x) AS m FROM (SELECT usuario_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS x FROM interacao JOIN vetor USING (conteudo_id) WHERE tipo_interacao = 'visualização') GROUP BY 1, 2) GROUP BY 1),
liked AS (SELECT usuario_id, conteudo_id FROM interacao WHERE tipo_interacao = 'curtida' OR avaliacao_atribuida >= 4 UNION SELECT usuario_id, conteudo_id FROM comentario WHERE avaliacao >= 4),
cur AS (SELECT usuario_id, list(m ORDER BY pos) AS v FROM (SELECT usuario_id, pos, avg(x) AS m FROM (SELECT usuario_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS x FROM liked JOIN vetor USING (conteudo_id)) GROUP BY 1, 2) GROUP BY 1),
known AS (SELECT DISTINCT usuario_id FROM interacao), done AS (SELECT DISTINCT usuario_id, conteudo_id FROM interacao WHERE tipo_interacao = 'conclusão' OR percentual_conclusao >= 100),
pairs AS (SELECT k.usuario_id, e.conteudo_id, greatest(least(coalesce(list_cosine_similarity(e.embedding, vis.v), 0), 1), 0) AS v, greatest(least(coalesce(list_cosine_similarity(e.embedding, cur.v), 0), 1), 0) AS c, CASE WHEN d.usuario_id IS NULL THEN 1.0 ELSE 0.0 END AS conc
FROM known k CROSS JOIN vetor e LEFT JOIN vis ON vis.usuario_id = k.usuario_id LEFT JOIN cur ON cur.usuario_id = k.usuario_id LEFT JOIN done d ON d.usuario_id = k.usuario_id AND d.conteudo_id = e.conteudo_id),
normed AS (SELECT usuario_id, conteudo_id, conc, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0 END AS v, CASE WHEN max(c) OVER w > min(c) OVER w THEN (c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w) ELSE 0 END AS c FROM pairs WINDOW w AS (PARTITION BY usuario_id)),
scored AS (SELECT usuario_id, conteudo_id, CAST(round((v + c) / 2 * 100 * conc, 2) AS DOUBLE) AS pontuacao, CAST(round(v, 4) AS DOUBLE) AS i_vis, CAST(round(c, 4) AS DOUBLE) AS i_cur, CAST(conc AS DOUBLE) AS i_conc FROM normed),
final AS (SELECT *, CASE WHEN i_conc = 0 OR pontuacao <= 40 THEN 'Negativo' WHEN pontuacao >= 70 THEN 'Positivo' ELSE 'Estável' END AS status FROM scored)"""


def _recommend_sql(body: str) -> str:
    return with_ctes("", "interacao", "comentario", "vetor").rstrip() + f",\n{_PROFILE}\n{body}"


@query(_recommend_sql("SELECT usuario_id, status, count(*) AS conteudos FROM final GROUP BY 1, 2"))
def recommend_scores(e: Entities) -> DataFrame:
    return recommend.status_counts(e.interactions.select("usuario_id").distinct(), e.interactions, e.embeddings, e.comments.where("avaliacao >= 4"))


@query(_recommend_sql("SELECT usuario_id, conteudo_id, pontuacao, i_vis, i_cur, i_conc, status, posicao FROM (SELECT *, CAST(row_number() OVER (PARTITION BY usuario_id ORDER BY pontuacao DESC, conteudo_id) AS INTEGER) AS posicao FROM final WHERE status <> 'Negativo') WHERE posicao <= 10"))
def recommend_topn(e: Entities) -> DataFrame:
    return recommend.best_of_blocks(e.interactions.select("usuario_id").distinct(), e.interactions, e.embeddings, positive_pairs=e.comments.where("avaliacao >= 4"))


@query("""SELECT conteudo_id, trim(regexp_replace(trim(titulo) || '. ' || trim(descricao), '\\s+', ' ', 'g')) AS texto, sha256(trim(regexp_replace(trim(titulo) || '. ' || trim(descricao), '\\s+', ' ', 'g'))) AS texto_hash, tipo IN ('Curso', 'Artigo') AND nivel <> 'Básico' AS reusar FROM catalogo""", "catalogo")
def embedding_sync_plan(e: Entities) -> DataFrame:
    plan = search.sync_plan(e.catalogue, e.catalogue.select("conteudo_id", F.lit("").alias("modelo"), F.lit("").alias("texto_hash")), "m")
    known = plan.join(e.catalogue.where("tipo IN ('Curso', 'Artigo')").select("conteudo_id", "nivel"), "conteudo_id")
    store = known.select("conteudo_id", F.when(F.col("nivel") == "Básico", "outro").otherwise("m").alias("modelo"), "texto_hash")
    return search.sync_plan(e.catalogue, store, "m")


@query("SELECT CAST(vec_id AS INTEGER) AS conteudo_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norma FROM embeddings")
def vector_norms(e: Entities) -> DataFrame:
    return e.embeddings.select("conteudo_id", F.round(norm("embedding"), 6).alias("norma"))


@query("SELECT DISTINCT modelo FROM vetor", "vetor")
def distinct_models(e: Entities) -> DataFrame:
    return e.embeddings.select("modelo").distinct()
