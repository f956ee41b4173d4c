"""Monthly engagement by category: the flagship aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.measures import engagement_measures
from quarrylight.functions.scalars import month, salted_pseudonym

# Fixed value: the category of contents that the catalogue lacks.
UNCATALOGUED = "Não catalogado"
COLUMNS = ["usuario_id", "conteudo_id", "tipo_interacao", "data_hora", "tempo_consumido", "percentual_conclusao", "avaliacao_atribuida"]


def categorised(interactions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Interactions with month and category; a content not in the catalogue keeps its rows.

    The catalogue side is two columns; Spark broadcasts it while it is under its size threshold.
    """
    names = catalogue.select("conteudo_id", "categoria")
    joined = interactions.select(*COLUMNS).join(names, "conteudo_id", "left")
    return joined.withColumns({"ano_mes": month("data_hora"), "categoria": F.coalesce("categoria", F.lit(UNCATALOGUED))})


def engagement_by_month_category(interactions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Twelve measures by (ano_mes, categoria).  Counts and sums are partial before the shuffle."""
    return categorised(interactions, catalogue).groupBy("ano_mes", "categoria").agg(*engagement_measures())


def missing_from_catalogue(interactions: DataFrame, catalogue: DataFrame) -> DataFrame:
    return categorised(interactions, catalogue).agg(F.count_if(F.col("categoria") == UNCATALOGUED).alias("nao_catalogadas"), F.count("*").alias("lidas"))


def masked_users(interactions: DataFrame, salt: str) -> tuple[DataFrame, DataFrame]:
    """(interactions with masked users, the restricted table of users and masks)."""
    mask = salted_pseudonym("usuario_id", salt)
    pairs = interactions.select("usuario_id").where("usuario_id IS NOT NULL").distinct()
    return interactions.withColumn("usuario_id", mask), pairs.select("usuario_id", mask.alias("usuario_mascarado"))


def stamped(result: DataFrame, run_id: str, runtime: str) -> DataFrame:
    return result.withColumns({"id_execucao": F.lit(run_id), "runtime": F.lit(runtime)})


def differences(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows and columns in which two results differ: keys on one side, nulls, or numbers by over ``tolerance``."""
    values = [c for c in left.columns if c not in keys]
    l = left.select(*keys, *[F.col(c).cast("string").alias(f"l_{c}") for c in values], F.lit(True).alias("in_l"))
    r = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[F.col(c).cast("string").alias(f"r_{c}") for c in values], F.lit(True).alias("in_r"))
    both = l.join(r, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys], "full_outer")

    def differs(c: str):
        a, b = F.col(f"l_{c}"), F.col(f"r_{c}")
        gap = F.abs(a.try_cast("double") - b.try_cast("double"))
        return ~a.eqNullSafe(b) & ~F.coalesce(gap <= tolerance, F.lit(False))

    one_sided = F.col("in_l").isNull() | F.col("in_r").isNull()
    names = F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in values]))
    found = both.select(*[F.coalesce(k, f"r_{k}").alias(k) for k in keys], F.when(one_sided, F.array(F.lit("*"))).otherwise(names).alias("diferem"))
    return found.where(F.size("diferem") > 0)
