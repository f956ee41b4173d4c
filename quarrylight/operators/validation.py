"""Record checks with reasons, treatment with a count of changes, and integrity assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.functions.scalars import between_numbers, blank, capitalised, iso_date, iso_datetime, positive_id, trimmed
from quarrylight.operators.layers import with_key_stats
from quarrylight.sources.contracts import INTERACTIONS, KINDS, LEVELS, Contract

VALID, INVALID, INCOMPLETE, REPEATED = "valido", "invalido", "incompleto", "duplicado"
SITUATIONS = (VALID, INVALID, INCOMPLETE, REPEATED)


# The wording of reasons below, and the names of situations above.


def checks(source: str) -> list[tuple[str, Column]] | None:
    """(reason, condition that must hold) by source; None for one that isn't known."""
    if source == "catalogo":
        return [
            ("conteudo_id inválido.", positive_id("conteudo_id")), ("tipo inválido.", F.col("tipo").isin(*KINDS)), ("nivel inválido.", F.col("nivel").isin(*LEVELS)),
            ("carga_horaria_min inválida.", between_numbers("carga_horaria_min", 0)), ("data_publicacao inválida.", iso_date("data_publicacao")),
        ]
    if source == "interacoes":
        return [
            ("usuario_id inválido.", positive_id("usuario_id")), ("conteudo_id inválido.", positive_id("conteudo_id")), ("tipo_interacao inválido.", F.col("tipo_interacao").isin(*INTERACTIONS)), ("data_hora inválida.", iso_datetime("data_hora")),
            ("tempo_consumido inválido.", between_numbers("tempo_consumido", 0)), ("percentual_conclusao inválido.", between_numbers("percentual_conclusao", 0, 100)), ("avaliacao_atribuida inválida.", between_numbers("avaliacao_atribuida", 1, 5, True)),
        ]
    if source == "comentarios":
        return [
            ("usuario_id inválido.", positive_id("usuario_id")), ("conteudo_id inválido.", positive_id("conteudo_id")), ("avaliacao inválida.", between_numbers("avaliacao", 1, 5)),
            ("data inválida.", iso_date("data")), ("tags deve ser uma lista.", F.col("tags").cast("string").rlike(r"^\s*\[")),
        ]
    return None


def classified(df: DataFrame, source: str, required: list[str], key: list[str]) -> DataFrame:
    """``situacao`` and ``motivos``.  An incomplete record isn't checked further; of others all reasons are given.
    Every valid record of a repeated key is a duplicate."""
    rules = checks(source)
    if rules is None:
        return df.withColumns({"situacao": F.lit(INVALID), "motivos": F.array(F.lit("Origem não reconhecida."))})
    absent = F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in required]))
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(reason)) for reason, good in rules]))
    df = with_key_stats(df.withColumns({"ausentes": absent, "falhas": failed}), key)
    lacks, fails = F.size("ausentes") > 0, F.size("falhas") > 0
    state = F.when(lacks, INCOMPLETE).when(fails, INVALID).when(F.col("vezes") > 1, REPEATED).otherwise(VALID)
    why = F.when(lacks, F.array(F.concat(F.lit("Campos obrigatórios ausentes: "), F.array_join("ausentes", ", ")))).when(fails, F.col("falhas"))
    why = why.when(F.col("vezes") > 1, F.array(F.lit("Registro duplicado conforme a regra da fonte."))).otherwise(F.array().cast("array<string>"))
    return df.withColumns({"situacao": state, "motivos": why}).drop("ausentes", "falhas", "vezes")


def situation_counts(df: DataFrame) -> DataFrame:
    """One row; situations that don't occur count 0."""
    return df.agg(*[F.count_if(F.col("situacao") == s).alias(s) for s in SITUATIONS])


TYPES = {
    "catalogo": {"conteudo_id": "int", "carga_horaria_min": "double"},
    "interacoes": {"usuario_id": "int", "conteudo_id": "int", "tempo_consumido": "double", "percentual_conclusao": "double", "avaliacao_atribuida": "double"},
    "comentarios": {"usuario_id": "int", "conteudo_id": "int", "avaliacao": "double"},
}
CASES = {"catalogo": {"tipo": capitalised, "nivel": capitalised}, "interacoes": {"tipo_interacao": F.lower}}


def treated(df: DataFrame, source: str) -> DataFrame:
    """Text without blanks at the ends, categories in their case, numbers as numbers; ``corrigido`` marks rows
    of which a value or its type changed."""
    out, changed = {}, F.lit(False)
    for f in df.schema:
        if not isinstance(f.dataType, T.StringType):
            out[f.name] = F.col(f.name)
            continue
        c = trimmed(f.name)
        if f.name in CASES.get(source, {}):
            c = CASES[source][f.name](c)
        kind = TYPES[source].get(f.name)
        out[f.name] = c.try_cast(kind) if kind else c
        changed = changed | (F.col(f.name).isNotNull() if kind else ~F.col(f.name).eqNullSafe(c))
    return df.select(*[c.alias(n) for n, c in out.items()], F.coalesce(changed, F.lit(False)).alias("corrigido"))


def broken_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that repeat or hold a null: a primary key has none."""
    bad = F.count("*").alias("linhas")
    return df.groupBy(*key).agg(bad).where((F.col("linhas") > 1) | F.greatest(*[F.col(k).isNull().cast("int") for k in key], F.lit(0)).cast("boolean"))


def orphans(df: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose non-null key the parent doesn't have: a foreign key has none."""
    known = df.where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    return known.join(parent.select(*key).distinct(), key, "left_anti")


def violating(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a check constraint is false; null passes, as in SQL."""
    return df.where(~condition)


def require_integrity(df: DataFrame, contract: Contract, parents: dict[str, DataFrame] | None = None) -> None:
    if not broken_keys(df, list(contract.key)).isEmpty():
        raise ValueError(f"{contract.name}: keys repeat")
    for column, parent in (parents or {}).items():
        if not orphans(df, parent, [column]).isEmpty():
            raise ValueError(f"{contract.name}: {column} without its parent")
