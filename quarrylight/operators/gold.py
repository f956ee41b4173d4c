"""Star schema: dimensions, facts and the views on them.  Users appear by pseudonym only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scalars import COMPLETION, duration_band, engagement_profile, is_consumption, masked, month, pseudonym, ratio

CATALOGUE_SOURCE, RECOMMENDER_SOURCE = "silver_catalogo", "d1_postgres"


def dim_content(golden: DataFrame) -> DataFrame:
    return golden.select(
        "conteudo_mestre_id", "conteudo_id_canonico", "titulo", "tipo", "categoria", "nivel", "carga_horaria_min", duration_band("carga_horaria_min").alias("faixa_duracao"),
        "data_publicacao", F.year("data_publicacao").alias("ano_publicacao"), "autor", "qtd_registros_origem",
    )


def content_map(correspondence: DataFrame, source: str) -> DataFrame:
    return correspondence.where(F.col("fonte") == source).select(F.col("id_origem").alias("conteudo_id"), "conteudo_mestre_id")


def _with_master(df: DataFrame, correspondence: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Inner joins: rows of contents without a master or catalogue entry go."""
    return df.join(content_map(correspondence, CATALOGUE_SOURCE), "conteudo_id").join(catalogue.select("conteudo_id", "data_publicacao"), "conteudo_id")


def fact_interaction(interactions: DataFrame, correspondence: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    date = F.to_date("data_hora")
    return _with_master(interactions, correspondence, catalogue).select(
        pseudonym("usuario_id", key).alias("usuario_chave"), "conteudo_mestre_id", F.col("conteudo_id").alias("conteudo_id_origem"), "tipo_interacao", "data_hora", date.alias("data"), month("data_hora").alias("ano_mes"),
        "tempo_consumido", "percentual_conclusao", "avaliacao_atribuida", is_consumption("tipo_interacao").alias("eh_consumo"), (F.col("tipo_interacao") == COMPLETION).alias("eh_conclusao"),
        (date < F.col("data_publicacao")).alias("anterior_a_publicacao"), "id_execucao",
    )


def fact_comment(comments: DataFrame, correspondence: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """The text itself stays out: a digest identifies the comment."""
    tags = F.from_json("tags", "array<string>")
    return _with_master(comments, correspondence, catalogue).select(
        F.md5(F.encode(F.concat_ws("|", F.col("usuario_id").cast("string"), F.col("conteudo_id").cast("string"), F.col("data").cast("string"), "comentario"), "UTF-8")).alias("comentario_chave"),
        pseudonym("usuario_id", key).alias("usuario_chave"), "conteudo_mestre_id", F.col("conteudo_id").alias("conteudo_id_origem"), "data", month("data").alias("ano_mes"),
        "avaliacao", tags.alias("tags"), F.size(tags).alias("qtd_tags"), (F.col("data") < F.col("data_publicacao")).alias("anterior_a_publicacao"), "id_execucao",
    )


def consumption(interactions: DataFrame, correspondence: DataFrame) -> DataFrame:
    at = F.when(is_consumption("tipo_interacao"), F.col("data_hora"))
    mapped = interactions.join(content_map(correspondence, CATALOGUE_SOURCE), "conteudo_id")
    return mapped.groupBy("usuario_id", "conteudo_mestre_id").agg(F.min(at).alias("primeiro_consumo"), F.max(at).alias("ultimo_consumo"), F.bool_or(F.col("tipo_interacao") == COMPLETION).alias("concluiu"))


def fact_recommendation(recommendations: DataFrame, correspondence: DataFrame, consumed: DataFrame, key: str, source: str | None = None) -> DataFrame:
    """``geracao_vigente``: of the user's latest generation.  Converted: consumed at any time.

    Contents are those of the recommender's catalogue, or of another ``source`` of the correspondence.
    """
    mapped = recommendations.join(content_map(correspondence, source or RECOMMENDER_SOURCE), "conteudo_id")
    latest = mapped.groupBy("usuario_id").agg(F.max("data_geracao").alias("ultima_geracao"))
    no = F.lit(False)
    return mapped.join(latest, "usuario_id").withColumn("vigente", F.col("data_geracao") == F.col("ultima_geracao")).join(consumed, ["usuario_id", "conteudo_mestre_id"], "left").select(
        "recomendacao_id", pseudonym("usuario_id", key).alias("usuario_chave"), "conteudo_mestre_id", F.col("conteudo_id").alias("conteudo_id_origem"), "posicao", "pontuacao", "status", "data_geracao",
        F.col("vigente").alias("geracao_vigente"), F.col("primeiro_consumo").isNotNull().alias("convertida"), F.coalesce(F.col("ultimo_consumo") > F.col("data_geracao"), no).alias("convertida_apos_geracao"), F.coalesce("concluiu", no).alias("concluida"),
    )


def dim_user(users: DataFrame, interactions: DataFrame, key: str) -> DataFrame:
    """Users without interactions stay, with zero counts."""
    i = interactions.select("usuario_id", "data_hora", "conteudo_id", "tipo_interacao", F.lit(1).alias("um"))
    done = F.when(F.col("tipo_interacao") == COMPLETION, F.col("conteudo_id"))
    found = users.select("usuario_id").join(i, "usuario_id", "left").groupBy("usuario_id").agg(
        F.min("data_hora").alias("primeira_interacao"), F.max("data_hora").alias("ultima_interacao"), F.count("um").alias("total_interacoes"),
        F.count_distinct(month("data_hora")).alias("meses_ativos"), F.count_distinct(done).alias("conteudos_concluidos"),
    )
    return found.select(pseudonym("usuario_id", key).alias("usuario_chave"), *found.columns[1:])


def kpi_monthly(fact: DataFrame) -> DataFrame:
    consumed, done = F.count_if("eh_consumo"), F.count_if("eh_conclusao")
    return fact.groupBy("ano_mes").agg(
        F.count("*").alias("total_interacoes"), F.count_distinct("usuario_chave").alias("usuarios_ativos"), F.count_distinct("conteudo_mestre_id").alias("conteudos_consumidos"),
        consumed.alias("interacoes_consumo"), done.alias("conclusoes"), ratio(done, consumed).alias("taxa_conclusao"), F.round(F.avg("avaliacao_atribuida").cast("double"), 2).alias("avaliacao_media"), F.count_if("anterior_a_publicacao").alias("interacoes_com_ressalva"),
    )


def content_performance(dim: DataFrame, interactions: DataFrame, comments: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Each fact is aggregated before it joins the dimension."""
    i = interactions.groupBy("conteudo_mestre_id").agg(F.count("*").alias("n_i"), F.count_distinct("usuario_chave").alias("n_u"), F.count_if("eh_consumo").alias("n_c"), F.count_if("eh_conclusao").alias("n_d"), F.avg("avaliacao_atribuida").cast("double").alias("a_i"))
    c = comments.groupBy("conteudo_mestre_id").agg(F.count("*").alias("n_k"), F.avg("avaliacao").cast("double").alias("a_k"))
    r = recommendations.where("geracao_vigente").groupBy("conteudo_mestre_id").agg(F.count("*").alias("n_r"), F.count_if("convertida").alias("n_v"))
    joined = dim.join(i, "conteudo_mestre_id", "left").join(c, "conteudo_mestre_id", "left").join(r, "conteudo_mestre_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "conteudo_mestre_id", "titulo", "tipo", "categoria", "nivel", "faixa_duracao", "autor", "data_publicacao",
        zero("n_i").alias("total_interacoes"), zero("n_u").alias("usuarios"), zero("n_d").alias("conclusoes"), ratio(F.col("n_d"), F.col("n_c")).alias("taxa_conclusao"), F.round("a_i", 2).alias("avaliacao_media"),
        zero("n_k").alias("comentarios"), F.round("a_k", 2).alias("nota_media_comentarios"), zero("n_r").alias("recomendacoes"), zero("n_v").alias("recomendacoes_convertidas"), ratio(F.col("n_v"), F.col("n_r")).alias("taxa_conversao"),
    )


def recommendation_conversion(fact: DataFrame) -> DataFrame:
    n, hit = F.count("*"), F.count_if("convertida")
    return fact.where("geracao_vigente").groupBy("posicao", "status").agg(
        n.alias("recomendacoes"), hit.alias("convertidas"), ratio(hit, n).alias("taxa_conversao"), F.count_if("convertida_apos_geracao").alias("convertidas_apos_geracao"), F.count_if("concluida").alias("concluidas"), F.round(F.avg("pontuacao").cast("double"), 2).alias("pontuacao_media"),
    )


def masked_profile(dim: DataFrame) -> DataFrame:
    return dim.select(masked("usuario_chave").alias("usuario_mascarado"), "total_interacoes", "meses_ativos", "conteudos_concluidos", engagement_profile("conteudos_concluidos").alias("perfil_engajamento"))


def publication_row(spark, run_id: str, gate_id: str, status: str, counts: dict[str, int]) -> DataFrame:
    row = spark.createDataFrame([(run_id, gate_id, status, counts)], "id_execucao string, id_execucao_qualidade string, status_qualidade string, linhas map<string,bigint>")
    return row.withColumn("data_publicacao", F.current_timestamp())
