"""Raw and validated layers: audit columns, ordered rules with quarantine, lookups and keep-first deduplication."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scalars import between_numbers, blank
from quarrylight.sources.contracts import CATALOGUE, COMMENT, CONTRACTS, INTERACTION, INTERACTIONS, KINDS, LEVELS, Contract

# Codes of the rules that send a row to quarantine.
REQUIRED, ALLOWED, NO_CONTENT, NO_USER, DUPLICATE = "CAMPOS_OBRIGATORIOS", "VALORES_PERMITIDOS", "REFERENCIA_CONTEUDO", "REFERENCIA_USUARIO", "DUPLICIDADE"
MESSAGES = {
    REQUIRED: "campo obrigatório ausente",
    ALLOWED: "valor fora do permitido",
    NO_CONTENT: "conteúdo não encontrado",
    NO_USER: "usuário não encontrado",
    DUPLICATE: "registro duplicado",
}


def with_audit(df: DataFrame, origin: str, run_id: str, at: datetime | None = None) -> DataFrame:
    """Origin, one ingestion instant for the whole run, and the run's id."""
    stamp = F.current_timestamp() if at is None else F.lit(at)
    return df.withColumns({"origem": F.lit(origin), "data_ingestao": stamp.cast("timestamp_ntz"), "id_execucao": F.lit(run_id)})


def half_even(c: Column | str, digits: int = 2, precision: int = 5) -> Column:
    """Text or number to a decimal, half-way cases to the even digit."""
    c = F.col(c) if isinstance(c, str) else c
    return F.bround(c.try_cast(f"decimal({precision + 4},{digits + 4})"), digits).cast(f"decimal({precision},{digits})")


def allowed(contract: Contract) -> Column:
    """What a row's values must meet to enter the validated layer."""
    if contract is CATALOGUE:
        return F.col("tipo").isin(*KINDS) & F.col("nivel").isin(*LEVELS) & (F.col("carga_horaria_min") >= 0)
    if contract is INTERACTION:
        return F.col("tipo_interacao").isin(*INTERACTIONS) & (F.col("tempo_consumido") >= 0) & between_numbers("percentual_conclusao", 0, 100) & between_numbers("avaliacao_atribuida", 1, 5, True)
    return between_numbers("avaliacao", 1, 5)


def silver_split(df: DataFrame, contract: Contract, contents: DataFrame | None = None, users: DataFrame | None = None, ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined).  Rules apply in order and the first that fails names the row's rule.

    ``ordinal`` orders rows for keep-first; references are left joins, so Spark broadcasts the small ones.
    """
    checked = classify(df, contract, contents, users, ordinal)
    kept = checked.where("regra_violada IS NULL").select(*df.columns)
    bad = checked.where("regra_violada IS NOT NULL")
    message = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    bad = bad.select(*df.columns, "regra_violada", message[F.col("regra_violada")].alias("mensagem_erro"), F.current_timestamp().alias("data_erro"))
    return kept, bad


def classify(df: DataFrame, contract: Contract, contents: DataFrame | None = None, users: DataFrame | None = None, ordinal: str = "ordinal") -> DataFrame:
    """``df`` with ``regra_violada``: the first rule that a row fails, or null."""
    needed = [f.name for f in contract.columns if not f.nullable]
    rule = F.when(F.greatest(*[blank(c).cast("int") for c in needed], F.lit(0)) == 1, REQUIRED).when(~F.coalesce(allowed(contract), F.lit(False)), ALLOWED)
    if contents is not None:
        df = df.join(contents.select(F.col("conteudo_id"), F.col("conteudo_id").alias("conteudo_ref")).distinct(), "conteudo_id", "left")
        rule = rule.when(F.coalesce("conteudo_ref", F.lit(-1)) < 0, NO_CONTENT)
    if users is not None:
        df = df.join(users.select(F.col("usuario_id"), F.col("usuario_id").alias("usuario_ref")).distinct(), "usuario_id", "left")
        rule = rule.when(F.coalesce("usuario_ref", F.lit(-1)) < 0, NO_USER)
    df = df.withColumn("regra_violada", rule).drop("conteudo_ref", "usuario_ref")
    # only rows that pass all other rules compete for their key
    passed = df.where("regra_violada IS NULL").groupBy(*contract.key).agg(F.min(ordinal).alias("primeiro"))
    df = df.join(passed, list(contract.key), "left").select(*df.columns, "primeiro")
    return df.withColumn("regra_violada", F.coalesce("regra_violada", F.when(F.col(ordinal) > F.col("primeiro"), DUPLICATE))).drop("primeiro")


def with_key_stats(df: DataFrame, key: list[str], ordinal: str | None = None) -> DataFrame:
    """``df`` with ``vezes``, how many rows have its key, and ``primeiro``, the least ordinal among them; null keys are equal.

    Counts are partial before the shuffle and the join can be split, so a key with a large share of all rows
    doesn't meet in one task, as it would in a window.
    """
    stats = [F.count("*").alias("vezes"), *([F.min(ordinal).alias("primeiro")] if ordinal else [])]
    found = df.groupBy(*key).agg(*stats)
    found = found.select(*[F.col(k).alias(f"chave_{k}") for k in key], *found.columns[len(key) :])
    return df.join(found, [F.col(k).eqNullSafe(F.col(f"chave_{k}")) for k in key]).drop(*[f"chave_{k}" for k in key])


def keep_first(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """One row a key, the first by ``ordinal``; null keys are equal.  A partial minimum goes before the shuffle."""
    first = df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), ordinal).alias("r"))
    return first.select("r.*")


def duplicate_flags(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """``repetido``: a row after the first of its key; ``chave_duplicada``: any row of a repeated key."""
    found = with_key_stats(df, key, ordinal)
    return found.withColumns({"repetido": F.col(ordinal) > F.col("primeiro"), "chave_duplicada": F.col("vezes") > 1}).drop("vezes", "primeiro")


def route(df: DataFrame, column: str, branches: dict[str, str], default: str = "outros") -> dict[str, DataFrame]:
    """Rows by the value of a column: branch name -> value, and all others in ``default``."""
    out = {name: df.where(F.col(column) == value) for name, value in branches.items()}
    out[default] = df.where(~F.coalesce(F.col(column).isin(*branches.values()), F.lit(False)))
    return out


def mapped_values(df: DataFrame, column: str, values: dict[str, str]) -> DataFrame:
    """Replace some values of a column, keep all others."""
    return df.replace(values, subset=[column])


def replicated(df: DataFrame, copies: int, user: str = "usuario_id") -> DataFrame:
    """``copies`` times the rows, each copy with users of its own."""
    top = df.agg(F.coalesce(F.max(user), F.lit(0)).alias("top")).first()["top"]
    return df.withColumn("copia", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn(user, (F.col(user) + F.col("copia") * (top + 1)).cast(df.schema[user].dataType)).drop("copia")


def with_defects(df: DataFrame, contract: Contract, ordinal: str = "ordinal") -> DataFrame:
    """A batch with known defects, for tests of the quality gate; text columns as read from a file."""
    at = F.col(ordinal)
    if contract is CATALOGUE:
        return df.withColumn("titulo", F.when(at.isin(10, 11), "").otherwise(F.col("titulo"))).withColumn("nivel", F.when(at == 12, "Expert").otherwise(F.col("nivel")))
    if contract is COMMENT:
        return df.withColumn("avaliacao", F.when(at == 5, "7").otherwise(F.col("avaliacao").cast("string")))
    done = df.where(F.col("tipo_interacao") == "conclusão").orderBy(ordinal).limit(2).select(F.collect_list(ordinal).alias("at"))
    df = df.crossJoin(F.broadcast(done))  # one row
    df = df.withColumn("percentual_conclusao", F.when(F.array_contains("at", at), "80.00").when(at.isin(20, 21, 22), "150.00").otherwise(F.col("percentual_conclusao").cast("string"))).drop("at")
    df = df.withColumn("conteudo_id", F.when(at.isin(30, 31), "99999").otherwise(F.col("conteudo_id").cast("string")))
    return df.unionByName(df.where(at.between(40, 44)))


def contract_named(name: str) -> Contract:
    return CONTRACTS[name]
