"""Master data: records of one content across sources and duplicates, survivorship and stable identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scalars import candidate_key, match_key, normalised
from quarrylight.operators.ordinals import numbered
from quarrylight.sources.sinks import upsert

ATTRIBUTES = ("titulo", "tipo", "categoria", "nivel", "carga_horaria_min", "data_publicacao", "descricao", "autor")
SOURCES = ("silver_catalogo", "d1_postgres")  # by priority

# Survivorship of each attribute, and how a conflict's record words it.
FIRST, LAST, OLDEST = "valor do registro sobrevivente (igual após normalização)", "registro publicado mais recentemente (versão vigente)", "data mais antiga (primeira publicação do conteúdo)"
SURVIVORSHIP = {"titulo": FIRST, "tipo": FIRST, "autor": FIRST, "nivel": FIRST, "descricao": FIRST, "categoria": LAST, "carga_horaria_min": LAST, "data_publicacao": OLDEST}


def tagged(sources: dict[str, DataFrame]) -> DataFrame:
    """The sources' records in one table, each with its source's name and priority."""
    out = None
    for k, name in enumerate(SOURCES):
        if name in sources:
            part = sources[name].select("conteudo_id", *ATTRIBUTES, F.lit(name).alias("fonte"), F.lit(k).alias("prioridade"))
            out = part if out is None else out.unionByName(part)
    return out


def resolved(records: DataFrame) -> DataFrame:
    """One record an id: each attribute's first non-null value by priority of its source."""
    pick = [F.min_by(a, F.when(F.col(a).isNotNull(), F.col("prioridade"))).alias(a) for a in ATTRIBUTES]
    sources = F.transform(F.array_sort(F.collect_set(F.struct("prioridade", "fonte"))), lambda x: x["fonte"])
    return records.groupBy("conteudo_id").agg(*pick, sources.alias("fontes"))


def _long(records: DataFrame, keep: list[str]) -> DataFrame:
    return records.select(*keep, *[F.col(a).cast("string").alias(a) for a in ATTRIBUTES]).unpivot(keep, list(ATTRIBUTES), "atributo", "valor")


def source_conflicts(records: DataFrame) -> DataFrame:
    """Attributes on which an id's sources differ, with all values and the one chosen."""
    rows = _long(records, ["conteudo_id", "fonte", "prioridade"])
    values = F.transform(F.array_sort(F.collect_list(F.struct("prioridade", "fonte", "valor"))), lambda x: F.struct(x["fonte"].alias("fonte"), x["valor"].alias("valor")))
    found = rows.groupBy("conteudo_id", "atributo").agg(F.count_distinct("valor").alias("n"), values.alias("valores"), F.min_by("valor", F.when(F.col("valor").isNotNull(), F.col("prioridade"))).alias("valor_escolhido"))
    rule = "prioridade da fonte: " + " > ".join(SOURCES)
    return found.where("n > 1").select("conteudo_id", "atributo", F.lit("entre_fontes").alias("nivel_conflito"), "valores", "valor_escolhido", F.lit(rule).alias("regra_sobrevivencia"))


def keyed(origins: DataFrame) -> DataFrame:
    return origins.withColumn("chave", match_key()).withColumn("candidato", candidate_key())


def consolidated(origins: DataFrame) -> DataFrame:
    """One golden record a match key.  Of members by (data_publicacao, conteudo_id) the first survives;
    category and minutes come from the last and the date is the oldest."""
    order = F.struct("data_publicacao", "conteudo_id")
    chosen = {FIRST: lambda a: F.min_by(a, order), LAST: lambda a: F.max_by(a, order), OLDEST: lambda a: F.min(a)}
    return keyed(origins).groupBy("chave").agg(
        F.min_by("conteudo_id", order).alias("conteudo_id_canonico"), *[chosen[SURVIVORSHIP[a]](a).alias(a) for a in ATTRIBUTES],
        F.array_sort(F.collect_set("conteudo_id")).alias("membros"), F.sum(F.size("fontes")).alias("qtd_registros_origem"),
    )


def duplicate_conflicts(origins: DataFrame) -> DataFrame:
    """Attributes on which a match group's members differ, with the surviving value."""
    rows = _long(keyed(origins).withColumn("ordem", F.struct("data_publicacao", "conteudo_id")).select("*"), ["chave", "conteudo_id", "ordem"])
    first, last = F.min_by("valor", "ordem"), F.max_by("valor", "ordem")
    at = F.col("atributo")
    found = rows.groupBy("chave", "atributo").agg(
        F.count_distinct("valor").alias("n"), first.alias("primeiro"), last.alias("ultimo"), F.min("valor").alias("menor"),
        F.min_by("conteudo_id", "ordem").alias("conteudo_id"), F.array_sort(F.collect_list(F.struct("conteudo_id", "valor"))).alias("valores"),
    )
    rule = F.create_map(*[F.lit(x) for pair in SURVIVORSHIP.items() for x in pair])[at]
    kept = F.when(rule == LAST, F.col("ultimo")).when(rule == OLDEST, F.col("menor")).otherwise(F.col("primeiro"))
    return found.where("n > 1").select("conteudo_id", "atributo", F.lit("entre_duplicatas").alias("nivel_conflito"), "valores", kept.alias("valor_escolhido"), rule.alias("regra_sobrevivencia"))


def unmerged_candidates(origins: DataFrame) -> DataFrame:
    """Records alike in title, type and author that match keys keep apart, and what differs."""
    order = F.struct("data_publicacao", "conteudo_id")
    found = keyed(origins).groupBy("candidato").agg(
        F.count_distinct("chave").alias("chaves"), F.array_sort(F.collect_set("conteudo_id")).alias("conteudo_ids"), F.min_by("titulo", order).alias("titulo"), F.min_by("autor", order).alias("autor"),
        (F.count_distinct(normalised("nivel")) > 1).alias("d_nivel"), (F.count_distinct(normalised("descricao")) > 1).alias("d_descricao"),
    )
    why = F.concat(F.lit("diferem em "), F.array_join(F.array_compact(F.array(F.when(F.col("d_nivel"), "nivel"), F.when(F.col("d_descricao"), "descricao"))), " e "))
    return found.where("chaves > 1").select("conteudo_ids", "titulo", "autor", why.alias("motivo"))


def members(golden: DataFrame, origins: DataFrame) -> DataFrame:
    """(fonte, id_origem, chave, regra): M2 in a group of several, else M1 if of several sources, else UNICO."""
    single = F.size("membros") == 1
    rows = golden.select("chave", "membros", F.explode("membros").alias("conteudo_id")).join(origins.select("conteudo_id", "fontes"), "conteudo_id")
    rule = F.when(~single, "M2").when(F.size("fontes") > 1, "M1").otherwise("UNICO")
    return rows.select(F.explode("fontes").alias("fonte"), F.col("conteudo_id").alias("id_origem"), "chave", rule.alias("regra"))


def with_master_ids(golden: DataFrame, origins: DataFrame, prior: DataFrame | None = None, last_number: int = 0) -> DataFrame:
    """Golden records with ``conteudo_mestre_id``: the least one that a member had, else the next number.

    ``absorvidos`` lists other master ids that a group had: masters that have become one.  New numbers go
    by (data_publicacao, conteudo_id_canonico), on from the largest one of ``prior`` and from ``last_number``,
    the persisted end of the sequence, which also knows numbers that ``prior`` no longer holds.
    """
    last = F.lit(last_number).cast("long")
    if prior is None:
        ends = golden.sparkSession.range(1).select(last.alias("fim"))
        known = golden.withColumn("anteriores", F.array().cast("array<string>"))
    else:
        ends = last_numbers(prior).select(F.greatest("ultimo_numero", last).alias("fim"))
        had = members(golden, origins).join(prior.select("fonte", "id_origem", "conteudo_mestre_id"), ["fonte", "id_origem"])
        had = had.groupBy("chave").agg(F.array_sort(F.collect_set("conteudo_mestre_id")).alias("anteriores"))
        known = golden.join(had, "chave", "left").withColumn("anteriores", F.coalesce("anteriores", F.array().cast("array<string>")))
    reused = known.where(F.size("anteriores") > 0).withColumn("conteudo_mestre_id", F.get("anteriores", F.lit(0)))
    fresh = numbered(known.where(F.size("anteriores") == 0), [F.col("data_publicacao"), F.col("conteudo_id_canonico")], "numero")
    fresh = fresh.crossJoin(F.broadcast(ends))  # one row
    fresh = fresh.withColumn("conteudo_mestre_id", F.format_string("CM-%06d", F.col("numero") + F.col("fim"))).drop("numero", "fim")
    return reused.unionByName(fresh).withColumn("absorvidos", F.slice("anteriores", 2, 1 << 30)).drop("anteriores")


def last_numbers(ids: DataFrame) -> DataFrame:
    """One row: the largest number among master ids, 0 without any."""
    number = F.regexp_extract("conteudo_mestre_id", r"(\d+)$", 1).try_cast("long")
    return ids.agg(F.coalesce(F.max(number), F.lit(0).cast("long")).alias("ultimo_numero"))


def conflicts(records: DataFrame, origins: DataFrame) -> DataFrame:
    """Conflicts between sources and between duplicates in one table, their values as JSON."""
    both = [f(df).withColumn("valores", F.to_json("valores")) for f, df in ((source_conflicts, records), (duplicate_conflicts, origins))]
    return both[0].unionByName(both[1])


def golden_table(golden: DataFrame) -> DataFrame:
    """Golden records as they are published: members and absorbed masters as JSON lists."""
    return golden.withColumns({"membros": F.to_json("membros"), "absorvidos": F.to_json("absorvidos")})


def correspondence(golden: DataFrame, origins: DataFrame, prior: DataFrame | None = None, seen_at=None) -> DataFrame:
    """The cross-reference of source ids and masters, upserted on an earlier one: first-seen times stay."""
    stamp = (F.current_timestamp() if seen_at is None else F.lit(seen_at)).cast("timestamp_ntz")
    rows = members(golden, origins).join(golden.select("chave", "conteudo_mestre_id"), "chave").select("fonte", "id_origem", "conteudo_mestre_id", "regra", stamp.alias("primeira_vez_em"), stamp.alias("atualizado_em"))
    return rows if prior is None else upsert(prior, rows, ["fonte", "id_origem"], ("primeira_vez_em",))

