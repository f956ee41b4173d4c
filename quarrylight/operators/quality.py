"""Quality gate: declarative rules, each a set of violation masks, evaluated with one aggregate a source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.functions.scalars import COMPLETION, RATING, any_of, json_list
from quarrylight.operators.layers import with_key_stats
from quarrylight.sources.contracts import CATALOGUE, COMMENT, CONTRACTS, INTERACTION

SAMPLE = 5
PASSED, ALERTED, FAILED = "sucesso", "sucesso_com_ressalvas", "falha"


@dataclass
class Batch:
    """Typed sources with ``raw_`` text columns and an ``ordinal``; known users; counts by source."""

    sources: dict[str, DataFrame]
    users: DataFrame
    bronze: dict[str, int] = field(default_factory=dict)
    quarantine: dict[str, int] = field(default_factory=dict)

    @property
    def catalogue(self) -> DataFrame:
        return self.sources["catalogo"]


Masks = dict[str, Column]


@dataclass(frozen=True)
class Rule:
    id: str
    dimension: str
    formula: str
    sources: tuple[str, ...]
    operator: str  # >= or <=
    limit: float
    severity: str  # critica or alerta
    action: str
    masks: Callable[[Batch, str, DataFrame], tuple[DataFrame, Masks]] | None = None
    counts: Callable[[int, int, int], tuple[int, int, float]] | None = None

    def passes(self, metric: float) -> bool:
        return metric >= self.limit if self.operator == ">=" else metric <= self.limit


# each takes the source's rows, may add columns to them, and names what may be wrong with a row


def completeness(batch: Batch, source: str, df: DataFrame) -> tuple[DataFrame, Masks]:
    empty = lambda c: F.col(f"raw_{c}").isNull() | (F.trim(F.col(f"raw_{c}")) == "")
    return df, {f"{c} vazio": empty(c) for c in CONTRACTS[source].required}


def outside(c: str, low: float, high: float) -> Column:
    return ~F.col(c).between(low, high)


def validity(batch: Batch, source: str, df: DataFrame) -> tuple[DataFrame, Masks]:
    contract = CONTRACTS[source]
    masks: Masks = {f"{f.name} em formato inválido": F.col(f"raw_{f.name}").isNotNull() & F.col(f.name).isNull() for f in contract.schema if not isinstance(f.dataType, T.StringType)}
    masks |= {f"{c} fora do domínio": ~F.col(c).isin(*values) for c, values in contract.domains.items()}
    masks[f"{contract.event_date} posterior à ingestão"] = F.col(contract.event_date).cast("timestamp_ntz") > F.col("data_ingestao")
    if contract is CATALOGUE:
        masks["carga_horaria_min <= 0"] = F.col("carga_horaria_min") <= 0
    elif contract is INTERACTION:
        masks |= {"percentual_conclusao fora de 0–100": outside("percentual_conclusao", 0, 100), "tempo_consumido negativo": F.col("tempo_consumido") < 0, "avaliacao_atribuida fora de 1–5": outside("avaliacao_atribuida", 1, 5)}
    elif contract is COMMENT:
        masks |= {"avaliacao fora de 1–5": outside("avaliacao", 1, 5), "tags não é lista JSON": F.col("tags").isNotNull() & ~json_list("tags")}
    return df, masks


def uniqueness(batch: Batch, source: str, df: DataFrame) -> tuple[DataFrame, Masks]:
    key = CONTRACTS[source].key
    df = with_key_stats(df, list(key), "ordinal")
    return df, {f"chave duplicada ({', '.join(key)})": F.col("ordinal") > F.col("primeiro")}


def references(batch: Batch, source: str, df: DataFrame) -> tuple[DataFrame, Masks]:
    contents = batch.catalogue.select("conteudo_id", F.lit(True).alias("tem_conteudo")).where("conteudo_id IS NOT NULL").distinct()
    users = batch.users.select("usuario_id", F.lit(True).alias("tem_usuario")).distinct()
    df = df.join(contents, "conteudo_id", "left").join(users, "usuario_id", "left")
    return df, {"conteudo_id ausente no catálogo": F.col("tem_conteudo").isNull(), "usuario_id ausente dos usuários": F.col("tem_usuario").isNull()}


def business(batch: Batch, source: str, df: DataFrame) -> tuple[DataFrame, Masks]:
    kind = F.col("tipo_interacao")
    done, whole = F.coalesce(kind == COMPLETION, F.lit(False)), F.coalesce(F.col("percentual_conclusao") == 100, F.lit(False))
    return df, {"conclusão sem percentual 100 ou 100% sem conclusão": done != whole, "avaliação sem nota atribuída": (kind == RATING) & F.col("avaliacao_atribuida").isNull()}


def temporal(batch: Batch, source: str, df: DataFrame) -> tuple[DataFrame, Masks]:
    published = batch.catalogue.groupBy("conteudo_id").agg(F.min_by("data_publicacao", "ordinal").alias("publicado_em"))
    df = df.join(published, "conteudo_id", "left")
    date = CONTRACTS[source].event_date
    return df, {f"{date} anterior à publicação do conteúdo": F.to_date(date) < F.col("publicado_em")}


def volume(bronze: int, silver: int, quarantine: int) -> tuple[int, int, float]:
    lost = abs(bronze - silver - quarantine)
    return bronze, lost, 100 * (1 - lost / bronze) if bronze else 0.0


def quarantine_rate(bronze: int, silver: int, quarantine: int) -> tuple[int, int, float]:
    return bronze, quarantine, 100 * quarantine / bronze if bronze else 100.0


# The rules' ids, dimensions, limits and severities.
ALL, EVENTS = ("catalogo", "interacoes", "comentarios"), ("interacoes", "comentarios")
RULES = (
    Rule("QD01", "completude", "registros sem campo obrigatório vazio / registros", ALL, ">=", 100, "critica", "bloquear", completeness),
    Rule("QD02", "validade", "registros com valores válidos / registros", ALL, ">=", 100, "critica", "bloquear", validity),
    Rule("QD03", "unicidade", "registros de chave nova / registros", ALL, ">=", 100, "critica", "bloquear", uniqueness),
    Rule("QD04", "integridade referencial", "registros com referências existentes / registros", EVENTS, ">=", 100, "critica", "bloquear", references),
    Rule("QD05", "consistência de negócio", "registros coerentes / registros", ("interacoes",), ">=", 100, "critica", "bloquear", business),
    Rule("QD06", "consistência temporal", "eventos a partir da publicação / eventos", EVENTS, ">=", 95, "alerta", "avisar", temporal),
    Rule("QD07", "conservação de volume", "100 × (1 − |bronze − silver − quarentena| / bronze)", ALL, ">=", 100, "critica", "bloquear", None, volume),
    Rule("QD08", "taxa de quarentena", "100 × quarentena / bronze", ALL, "<=", 5, "alerta", "avisar", None, quarantine_rate),
)


def violations(batch: Batch, rule: Rule, source: str) -> DataFrame:
    """Rows with ``violado`` and ``mensagem``, what they violate of a rule."""
    df, masks = rule.masks(batch, source, batch.sources[source])
    texts = F.array_compact(F.array(*[F.when(F.coalesce(m, F.lit(False)), F.lit(name)) for name, m in masks.items()]))
    return df.withColumn("violado", any_of(list(masks.values()))).withColumn("mensagem", F.array_join(texts, "; "))


def metric_rows(batch: Batch, source: str, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """id_regra, fonte, avaliados, violados and metrica of a source's row rules: one pass and one aggregate.

    The metric of an empty source is 100.
    """
    df, flags = batch.sources[source], {}
    for rule in RULES if rules is None else rules:
        if rule.masks and source in rule.sources:
            df, masks = rule.masks(batch, source, df)
            flags[rule.id] = any_of(list(masks.values()))
    counts = df.agg(F.count("*").alias("avaliados"), *[F.count_if(flag).alias(name) for name, flag in flags.items()])
    each = counts.select("avaliados", F.inline(F.array(*[F.struct(F.lit(name).alias("id_regra"), F.col(name).alias("violados")) for name in flags])))
    metric = F.when(F.col("avaliados") == 0, 100.0).otherwise(F.round(100.0 * (F.col("avaliados") - F.col("violados")) / F.greatest("avaliados", F.lit(1)), 3))
    return each.select("id_regra", F.lit(source).alias("fonte"), "avaliados", "violados", metric.alias("metrica"))


def sample_of(batch: Batch, rule: Rule, source: str, rows: int = SAMPLE) -> DataFrame:
    """The first violations in file order."""
    key = [c for c in CONTRACTS[source].key if c != "comentario"]
    named = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"raw_{c}"), F.lit(""))) for c in key])
    return violations(batch, rule, source).where("violado").orderBy("ordinal").limit(rows).select(named.alias("registro"), "mensagem")


@dataclass
class Result:
    rule: str
    source: str
    evaluated: int
    violated: int
    metric: float
    passed: bool
    severity: str
    sample: list[dict]


def run_rules(batch: Batch, rules: tuple[Rule, ...] = RULES) -> list[Result]:
    """All rules of a batch.  One small row comes back for each rule and source, and at most SAMPLE violations."""
    sizes, found = {name: df.count() for name, df in batch.sources.items()}, {}
    for source in batch.sources:
        found |= {(r["id_regra"], source): r for r in metric_rows(batch, source, rules).collect()}
    out = []
    for rule in rules:
        for source in rule.sources:
            if rule.masks:
                r = found[rule.id, source]
                evaluated, violated, metric = r["avaliados"], r["violados"], r["metrica"]
                sample = [x.asDict() for x in sample_of(batch, rule, source).collect()] if violated else []
            else:
                bronze, quarantine = batch.bronze.get(source, 0), batch.quarantine.get(source, 0)
                evaluated, violated, metric = rule.counts(bronze, sizes[source], quarantine)
                sample = [{"registro": source, "mensagem": f"bronze={bronze}, silver={sizes[source]}, quarentena={quarantine}"}] if violated and rule.id == "QD07" else []
            metric = round(metric, 3)
            out.append(Result(rule.id, source, evaluated, violated, metric, rule.passes(metric), rule.severity, sample))
    return out


def gate_run(history: DataFrame, run: str | None = None) -> DataFrame:
    """Of (id_execucao, situacao, simulada, fim, ...) rows, the run of this id, else the one real run that ended last.

    At most one row; of equal ends the larger id's.
    """
    rows = history.where(F.col("id_execucao") == run) if run is not None else history.where(~F.col("simulada") & F.col("fim").isNotNull())
    return rows.orderBy(F.desc("fim"), F.desc("id_execucao")).limit(1)


def status(results: list[Result]) -> str:
    if any(not r.passed and r.severity == "critica" for r in results):
        return FAILED
    return PASSED if all(r.passed for r in results) else ALERTED


class GateClosed(RuntimeError):
    """Publication is blocked: critical rules failed."""


def require_open(results: list[Result]) -> str:
    found = status(results)
    if found == FAILED:
        raise GateClosed(", ".join(sorted({f"{r.rule}/{r.source}" for r in results if not r.passed})))
    return found


def worst_by_rule(history: DataFrame) -> DataFrame:
    """Of (id_execucao, id_regra, operador, metrica, aprovado) rows: each run's worst metric and verdict by rule."""
    ends = history.groupBy("id_execucao", "id_regra", "operador").agg(F.min("metrica").alias("menor"), F.max("metrica").alias("maior"), F.bool_and("aprovado").alias("aprovado"))
    return ends.select("id_execucao", "id_regra", F.when(F.col("operador") == ">=", F.col("menor")).otherwise(F.col("maior")).alias("metrica"), "aprovado")


def evolution(worst: DataFrame, rules: list[str]) -> DataFrame:
    """One row a run, one column a rule."""
    return worst.groupBy("id_execucao").pivot("id_regra", rules).agg(F.first("metrica"))
