"""The generic test tables seen as the engine's entities, as DataFrames and as DuckDB common table expressions.

events are interactions, part the catalogue, customer the users, documents the comments, embeddings the
content vectors; recommendations are drawn from events by arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import gold, master
from quarrylight.session import written
from quarrylight.sources.contracts import KINDS, LEVELS

KEY = "key-of-the-test-tables"
RUN = "run-1"
KIND_OF = {"view": "visualização", "click": "início", "purchase": "conclusão", "signup": "curtida", "error": "compartilhamento"}


@dataclass
class Entities:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def raw_catalogue(self) -> DataFrame:
        p = self.table("part")
        pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col(n) % len(values)).cast("int") + 1)
        return p.select(
            F.col("p_partkey").cast("int").alias("conteudo_id"), F.col("p_name").alias("titulo"), pick(KINDS, "p_size").alias("tipo"), F.col("p_type").alias("categoria"), pick(LEVELS, "p_size").alias("nivel"),
            (F.col("p_size") * 5).cast("int").alias("carga_horaria_min"), F.date_add(F.lit("2023-12-20").cast("date"), (F.col("p_partkey") % 40).cast("int")).alias("data_publicacao"),
            F.concat(F.lit("Sobre "), "p_name").alias("descricao"), F.col("p_brand").alias("autor"), "p_size",
        )

    @cached_property
    def catalogue(self) -> DataFrame:
        return self.raw_catalogue.drop("p_size")

    @cached_property
    def part_catalogue(self) -> DataFrame:
        """A catalogue without the small parts, for what deals with contents that aren't in it."""
        return self.raw_catalogue.where("p_size >= 10").drop("p_size")

    @cached_property
    def interactions(self) -> DataFrame:
        e = self.table("events")
        k = F.get_json_object("props", "$.k").cast("int")
        kind = F.create_map(*[F.lit(x) for pair in KIND_OF.items() for x in pair])[F.col("event_type")]
        return e.select(
            F.col("event_id").alias("ordinal"), F.col("user_id").cast("int").alias("usuario_id"), k.alias("conteudo_id"), kind.alias("tipo_interacao"),
            (F.col("ts") + F.make_dt_interval((F.col("event_id") % 8).cast("int") * 30)).alias("data_hora"), F.round(F.abs("value"), 2).cast("decimal(12,2)").alias("tempo_consumido"),
            F.when(F.col("event_type") == "purchase", 100).otherwise(F.col("event_id") % 100).cast("decimal(5,2)").alias("percentual_conclusao"), F.nullif(k % 6, F.lit(0)).alias("avaliacao_atribuida"), F.lit(RUN).alias("id_execucao"),
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").cast("int").alias("usuario_id"), "c_mktsegment")

    @cached_property
    def comments(self) -> DataFrame:
        d = self.table("documents")
        return d.select(
            F.col("doc_id").alias("ordinal"), (F.col("doc_id") % 150).cast("int").alias("usuario_id"), (F.col("doc_id") % 100).cast("int").alias("conteudo_id"), (1 + F.col("doc_id") % 5).cast("int").alias("avaliacao"),
            F.col("text").alias("comentario"), F.concat(F.lit('["'), "lang", F.lit('","'), "source", F.lit('"]')).alias("tags"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 200).cast("int")).alias("data"), F.lit(RUN).alias("id_execucao"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.comments.withColumn("tags", F.from_json("tags", "array<string>"))

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").cast("int").alias("conteudo_id"), "embedding", F.concat(F.lit("modelo-"), (F.col("label") % 3).cast("string")).alias("modelo"), "label")

    @cached_property
    def origins(self) -> DataFrame:
        """Both sources of the catalogue resolved to one record an id: the second holds courses only and differs on some."""
        return master.resolved(self.records)

    @cached_property
    def records(self) -> DataFrame:
        c = self.catalogue
        second = c.where("tipo = 'Curso'").withColumn("carga_horaria_min", F.when(F.col("nivel") == "Básico", F.col("carga_horaria_min") + 1).otherwise(F.col("carga_horaria_min")))
        return master.tagged({"silver_catalogo": c, "d1_postgres": second})

    @cached_property
    def golden(self) -> DataFrame:
        # a table, as facts and dimensions read it several times
        return written(master.with_master_ids(master.consolidated(self.origins), self.origins), "ouro")

    @cached_property
    def correspondence(self) -> DataFrame:
        rows = master.members(self.golden, self.origins).join(self.golden.select("chave", "conteudo_mestre_id"), "chave")
        return written(rows.select("fonte", "id_origem", "conteudo_mestre_id", "regra"), "mapa")

    @cached_property
    def recommendations(self) -> DataFrame:
        # a first generation of what was shared or completed, a second of what was liked: some users have both
        run = F.when(F.col("tipo_interacao") == "curtida", 2).when(F.col("tipo_interacao").isin("compartilhamento", "conclusão"), 1)
        runs = self.interactions.select("usuario_id", "conteudo_id", run.alias("g")).where("g IS NOT NULL").distinct()
        score = ((F.col("usuario_id") * 13 + F.col("conteudo_id") * 7 + F.col("g")) % 10000 / 100).cast("decimal(5,2)")
        runs = runs.withColumn("pontuacao", score)
        return runs.select(
            (F.col("usuario_id").cast("long") * 1000 + F.col("conteudo_id") * 3 + F.col("g")).alias("recomendacao_id"), "usuario_id", "conteudo_id", (1 + F.col("conteudo_id") % 10).cast("int").alias("posicao"), "pontuacao",
            F.when(F.col("pontuacao") >= 70, "Positivo").when(F.col("pontuacao") <= 40, "Negativo").otherwise("Estável").alias("status"),
            F.when(F.col("g") == 1, F.lit("2024-02-01 00:00:00")).otherwise(F.lit("2024-04-01 00:00:00")).cast("timestamp_ntz").alias("data_geracao"),
        )

    @cached_property
    def fact_interaction(self) -> DataFrame:
        return gold.fact_interaction(self.interactions, self.correspondence, self.catalogue, KEY)

    @cached_property
    def fact_comment(self) -> DataFrame:
        return gold.fact_comment(self.comments, self.correspondence, self.catalogue, KEY)

    @cached_property
    def consumption(self) -> DataFrame:
        return gold.consumption(self.interactions, self.correspondence)

    @cached_property
    def fact_recommendation(self) -> DataFrame:
        return gold.fact_recommendation(self.recommendations, self.correspondence, self.consumption, KEY)

    @cached_property
    def dim_content(self) -> DataFrame:
        return gold.dim_content(self.golden)

    @cached_property
    def dim_user(self) -> DataFrame:
        return gold.dim_user(self.users, self.interactions, KEY)


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _hmac(c: str) -> str:
    """Hex HMAC-SHA256 under KEY, of two digests."""
    raw = KEY.encode().ljust(64, b"\0")
    pad = lambda x: "".join(f"{b ^ x:02X}" for b in raw)
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || encode(CAST({c} AS VARCHAR)))))"


def pseudonym_sql(c: str) -> str:
    return f"left({_hmac(c)}, 16)"


_KIND_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND_OF.items()) + " END"
_AUTHOR = f"regexp_replace({_norm('autor')}, '^((prof|profa|dr|dra|eng|me|ma|msc|phd)( |$))+', '')"
CANDIDATE_SQL = f"concat_ws('|', {_norm('titulo')}, {_norm('tipo')}, {_AUTHOR})"
MATCH_SQL = f"sha256(concat_ws('|', {CANDIDATE_SQL}, {_norm('nivel')}, {_norm('descricao')}))"
CONSUMED_SQL = "tipo_interacao IN ('início', 'visualização', 'conclusão')"

#: Name -> (names it builds on, its query).
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "catalogo": ((), f"""SELECT CAST(p_partkey AS INTEGER) AS conteudo_id, p_name AS titulo, ({_listed(KINDS)})[p_size % 4 + 1] AS tipo, p_type AS categoria, ({_listed(LEVELS)})[p_size % 3 + 1] AS nivel, CAST(p_size * 5 AS INTEGER) AS carga_horaria_min,
        DATE '2023-12-20' + CAST(p_partkey % 40 AS INTEGER) AS data_publicacao, 'Sobre ' || p_name AS descricao, p_brand AS autor FROM part"""),
    "catalogo_parcial": (("catalogo",), "SELECT * FROM catalogo WHERE conteudo_id IN (SELECT p_partkey FROM part WHERE p_size >= 10)"),
    "interacao": ((), f"""SELECT event_id AS ordinal, CAST(user_id AS INTEGER) AS usuario_id, CAST(props->>'$.k' AS INTEGER) AS conteudo_id, {_KIND_CASE} AS tipo_interacao, ts + to_days(CAST(event_id % 8 AS INTEGER) * 30) AS data_hora,
        CAST(round(abs(value), 2) AS DECIMAL(12,2)) AS tempo_consumido, CAST(CASE WHEN event_type = 'purchase' THEN 100 ELSE event_id % 100 END AS DECIMAL(5,2)) AS percentual_conclusao,
        nullif(CAST(props->>'$.k' AS INTEGER) % 6, 0) AS avaliacao_atribuida, '{RUN}' AS id_execucao FROM events"""),
    "usuario": ((), "SELECT CAST(c_custkey AS INTEGER) AS usuario_id, c_mktsegment FROM customer"),
    "comentario": ((), f"""SELECT doc_id AS ordinal, CAST(doc_id % 150 AS INTEGER) AS usuario_id, CAST(doc_id % 100 AS INTEGER) AS conteudo_id, CAST(1 + doc_id % 5 AS INTEGER) AS avaliacao, text AS comentario, '["' || lang || '","' || source || '"]' AS tags, [lang, source] AS lista_tags,
        DATE '2024-01-01' + CAST(doc_id % 200 AS INTEGER) AS data, '{RUN}' AS id_execucao FROM documents"""),
    "vetor": ((), "SELECT CAST(vec_id AS INTEGER) AS conteudo_id, CAST(embedding AS DOUBLE[]) AS embedding, 'modelo-' || CAST(label % 3 AS VARCHAR) AS modelo, label FROM embeddings"),
    "registro": (("catalogo",), """SELECT *, 'silver_catalogo' AS fonte, 0 AS prioridade FROM catalogo UNION ALL
        SELECT * REPLACE (CASE WHEN nivel = 'Básico' THEN carga_horaria_min + 1 ELSE carga_horaria_min END AS carga_horaria_min), 'd1_postgres', 1 FROM catalogo WHERE tipo = 'Curso'"""),
    "origem": (("catalogo",), f"SELECT *, CASE WHEN tipo = 'Curso' THEN ['silver_catalogo', 'd1_postgres'] ELSE ['silver_catalogo'] END AS fontes, {MATCH_SQL} AS chave, {CANDIDATE_SQL} AS candidato FROM catalogo"),
    "grupo": (("origem",), """SELECT chave, arg_min(conteudo_id, (data_publicacao, conteudo_id)) AS conteudo_id_canonico, arg_min(titulo, (data_publicacao, conteudo_id)) AS titulo, arg_min(tipo, (data_publicacao, conteudo_id)) AS tipo, arg_max(categoria, (data_publicacao, conteudo_id)) AS categoria,
        arg_min(nivel, (data_publicacao, conteudo_id)) AS nivel, arg_max(carga_horaria_min, (data_publicacao, conteudo_id)) AS carga_horaria_min, min(data_publicacao) AS data_publicacao, arg_min(descricao, (data_publicacao, conteudo_id)) AS descricao,
        arg_min(autor, (data_publicacao, conteudo_id)) AS autor, list_sort(list(DISTINCT conteudo_id)) AS membros, CAST(sum(len(fontes)) AS BIGINT) AS qtd_registros_origem FROM origem GROUP BY chave"""),
    "ouro": (("grupo",), "SELECT *, 'CM-' || lpad(CAST(row_number() OVER (ORDER BY data_publicacao, conteudo_id_canonico) AS VARCHAR), 6, '0') AS conteudo_mestre_id FROM grupo"),
    "mapa": (("ouro", "origem"), """SELECT fonte, id_origem, conteudo_mestre_id, CASE WHEN len(membros) > 1 THEN 'M2' WHEN len(fontes) > 1 THEN 'M1' ELSE 'UNICO' END AS regra FROM
        (SELECT unnest(o.fontes) AS fonte, o.fontes, o.conteudo_id AS id_origem, g.conteudo_mestre_id, g.membros FROM origem o JOIN ouro g ON o.chave = g.chave)"""),
    "recomendacao": (("interacao",), """SELECT CAST(usuario_id AS BIGINT) * 1000 + conteudo_id * 3 + g AS recomendacao_id, usuario_id, conteudo_id, CAST(1 + conteudo_id % 10 AS INTEGER) AS posicao, pontuacao, CASE WHEN pontuacao >= 70 THEN 'Positivo' WHEN pontuacao <= 40 THEN 'Negativo' ELSE 'Estável' END AS status,
        CASE WHEN g = 1 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-04-01' END AS data_geracao FROM (SELECT usuario_id, conteudo_id, g, CAST(((usuario_id * 13 + conteudo_id * 7 + g) % 10000) / 100.0 AS DECIMAL(5,2)) AS pontuacao FROM
        (SELECT DISTINCT usuario_id, conteudo_id, CASE tipo_interacao WHEN 'curtida' THEN 2 ELSE 1 END AS g FROM interacao WHERE tipo_interacao IN ('curtida', 'compartilhamento', 'conclusão')))"""),
    "fato_interacao": (("interacao", "mapa", "catalogo"), f"""SELECT {pseudonym_sql('i.usuario_id')} AS usuario_chave, m.conteudo_mestre_id, i.conteudo_id AS conteudo_id_origem, tipo_interacao, data_hora, CAST(data_hora AS DATE) AS data, strftime(data_hora, '%Y-%m') AS ano_mes, tempo_consumido, percentual_conclusao, avaliacao_atribuida,
        {CONSUMED_SQL} AS eh_consumo, tipo_interacao = 'conclusão' AS eh_conclusao, CAST(data_hora AS DATE) < c.data_publicacao AS anterior_a_publicacao, i.id_execucao FROM interacao i JOIN mapa m ON m.fonte = 'silver_catalogo' AND m.id_origem = i.conteudo_id JOIN catalogo c ON c.conteudo_id = i.conteudo_id"""),
    "fato_comentario": (("comentario", "mapa", "catalogo"), f"""SELECT md5(concat_ws('|', co.usuario_id, co.conteudo_id, co.data, co.comentario)) AS comentario_chave, {pseudonym_sql('co.usuario_id')} AS usuario_chave, m.conteudo_mestre_id, co.conteudo_id AS conteudo_id_origem, co.data, strftime(co.data, '%Y-%m') AS ano_mes, avaliacao,
        lista_tags AS tags, CAST(len(lista_tags) AS INTEGER) AS qtd_tags, co.data < c.data_publicacao AS anterior_a_publicacao, co.id_execucao FROM comentario co JOIN mapa m ON m.fonte = 'silver_catalogo' AND m.id_origem = co.conteudo_id JOIN catalogo c ON c.conteudo_id = co.conteudo_id"""),
    "consumo": (("interacao", "mapa"), f"""SELECT usuario_id, conteudo_mestre_id, min(data_hora) FILTER (WHERE {CONSUMED_SQL}) AS primeiro_consumo, max(data_hora) FILTER (WHERE {CONSUMED_SQL}) AS ultimo_consumo, bool_or(tipo_interacao = 'conclusão') AS concluiu
        FROM interacao i JOIN mapa m ON m.fonte = 'silver_catalogo' AND m.id_origem = i.conteudo_id GROUP BY 1, 2"""),
    "fato_recomendacao": (("recomendacao", "mapa", "consumo"), f"""SELECT recomendacao_id, {pseudonym_sql('r.usuario_id')} AS usuario_chave, m.conteudo_mestre_id, r.conteudo_id AS conteudo_id_origem, posicao, pontuacao, status, data_geracao, data_geracao = max(data_geracao) OVER (PARTITION BY r.usuario_id) AS geracao_vigente,
        primeiro_consumo IS NOT NULL AS convertida, coalesce(ultimo_consumo > data_geracao, FALSE) AS convertida_apos_geracao, coalesce(concluiu, FALSE) AS concluida FROM recomendacao r JOIN mapa m ON m.fonte = 'd1_postgres' AND m.id_origem = r.conteudo_id
        LEFT JOIN consumo cs ON cs.usuario_id = r.usuario_id AND cs.conteudo_mestre_id = m.conteudo_mestre_id"""),
    "dim_conteudo": (("ouro",), """SELECT conteudo_mestre_id, conteudo_id_canonico, titulo, tipo, categoria, nivel, carga_horaria_min, CASE WHEN carga_horaria_min < 30 THEN 'curta' WHEN carga_horaria_min <= 180 THEN 'média' ELSE 'longa' END AS faixa_duracao,
        data_publicacao, CAST(year(data_publicacao) AS INTEGER) AS ano_publicacao, autor, qtd_registros_origem FROM ouro"""),
    "dim_usuario": (("usuario", "interacao"), f"""SELECT {pseudonym_sql('u.usuario_id')} AS usuario_chave, min(data_hora) AS primeira_interacao, max(data_hora) AS ultima_interacao, count(i.usuario_id) AS total_interacoes, count(DISTINCT strftime(data_hora, '%Y-%m')) AS meses_ativos,
        count(DISTINCT conteudo_id) FILTER (WHERE tipo_interacao = 'conclusão') AS conteudos_concluidos FROM usuario u LEFT JOIN interacao i ON i.usuario_id = u.usuario_id GROUP BY u.usuario_id"""),
}


def with_ctes(body: str, *names: str) -> str:
    """``body`` after the named expressions and those that they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in CTES[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    head = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in order)
    return f"WITH {head}\n{body}" if head else body
