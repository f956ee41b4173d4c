"""The batch workflow: raw, validated, gate, master data, Parquet, aggregate, star schema; and its command line."""

from __future__ import annotations

import argparse
import hashlib
import logging
import os
import statistics
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import engagement, gold, layers, master, quality, validation
from quarrylight.sources import sinks
from quarrylight.sources.contracts import CATALOGUE, COMMENT, INTERACTION, Contract
from quarrylight.sources.readers import exists, fs_path, read_json_array, read_text_csv, typed

log = logging.getLogger("quarrylight")
SECTIONS = ("fontes", "saida", "recomendacao")


# --- run helpers ---


def run_id(given: str | None = None) -> str:
    """The argument, else the environment's ID_EXECUCAO, else a new one."""
    return given or os.environ.get("ID_EXECUCAO") or str(uuid.uuid4())


@contextmanager
def stage(name: str, times: dict[str, float] | None = None) -> Iterator[None]:
    began = time.perf_counter()
    log.info("%s: begins", name)
    try:
        yield
    finally:
        took = time.perf_counter() - began
        log.info("%s: %.3f s", name, took)
        if times is not None:
            times[name] = took


def checked_config(config: dict) -> dict:
    """All sections, positive sizes and 0 <= negative < positive <= 100, or an error."""
    if missing := [s for s in SECTIONS if s not in config]:
        raise ValueError(f"sections missing: {', '.join(missing)}")
    r = config["recomendacao"]
    if r.get("top_n", 0) <= 0 or r.get("dimensao", 1) <= 0:
        raise ValueError("sizes must be positive")
    if not 0 <= r.get("limite_negativo", 40) < r.get("limite_positivo", 70) <= 100:
        raise ValueError("0 <= limite_negativo < limite_positivo <= 100 must hold")
    return config


def fingerprint(spark: SparkSession, paths: dict[str, str]) -> str:
    """SHA-256 of the data sets' names and files' bytes, in order; read in blocks through the store's client."""
    digest = hashlib.sha256()
    for name in sorted(paths):
        digest.update(name.encode())
        p, fs = fs_path(spark, paths[name])
        found = sorted((s.getPath().toString() for s in fs.listStatus(p) if s.isFile()), key=str) if fs.getFileStatus(p).isDirectory() else [paths[name]]
        content = spark.read.format("binaryFile").load(found).select("path", F.sha2("content", 256).alias("h"), "length")
        for r in content.orderBy("path").collect():  # one row a file
            digest.update(f"{r['path'].rpartition('/')[2]} {r['length']} {r['h']}".encode())
    return digest.hexdigest()


def timed(action: Callable[[], object], repeats: int = 5) -> dict[str, float]:
    """One run to warm up, then median, least and most of ``repeats``, in seconds."""
    action()
    took = []
    for _ in range(repeats):
        began = time.perf_counter()
        action()
        took.append(time.perf_counter() - began)
    return {"median": statistics.median(took), "min": min(took), "max": max(took)}


def read_fully(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


# --- the layers ---


@dataclass
class Sources:
    catalogue: str  # CSV
    interactions: str  # JSON array
    comments: str  # JSON array
    recommender: DataFrame | None = None  # the recommender's own catalogue: conteudo_id and the catalogue's attributes


def raw_layer(spark: SparkSession, sources: Sources, run: str) -> dict[str, DataFrame]:
    """The sources as text, with audit columns."""
    catalogue = read_text_csv(spark, sources.catalogue)
    out = {"catalogo": layers.with_audit(catalogue, "catalogo.csv", run)}
    for contract, path in ((INTERACTION, sources.interactions), (COMMENT, sources.comments)):
        out[contract.name] = layers.with_audit(read_json_array(spark, path, [f.name for f in contract.columns]), f"{contract.name}.json", run)
    return out


def both_forms(raw: DataFrame, contract: Contract) -> DataFrame:
    """Typed columns, the text that they came from, and an ordinal; audit columns are typed already."""
    names = contract.schema.names
    audit = {"origem", "data_ingestao", "id_execucao"}
    values = [F.col(f.name) if f.name in audit else typed(F.col(f.name), f, contract.formats.get(f.name), True).alias(f.name) for f in contract.schema]
    return raw.select(*values, *[F.col(n).cast("string").alias(f"raw_{n}") for n in names], F.monotonically_increasing_id().alias("ordinal"))


@dataclass
class Outcome:
    run: str
    status: str
    results: list[quality.Result]
    counts: dict[str, int]
    times: dict[str, float] = field(default_factory=dict)


def silver_paths(out: str) -> dict[str, str]:
    return {c.name: f"{out}/silver/{c.name}" for c in (CATALOGUE, INTERACTION, COMMENT)}


def require_validated(spark: SparkSession, out: str, run: str | None = None) -> str:
    """The id of the gate's run that lets ``out`` be published: of this id, else the latest real one.

    Raises where there is none, where it failed or where the validated layer has changed since.
    """
    path = f"{out}/qualidade_execucao"
    found = quality.gate_run(spark.read.parquet(path), run).collect() if exists(spark, path) else []  # one row
    if not found:
        raise quality.GateClosed(f"no run of the gate{f' {run}' if run else ''}")
    r = found[0]
    if r["situacao"] == quality.FAILED:
        raise quality.GateClosed(f"run {r['id_execucao']} failed")
    if missing := [name for name, p in silver_paths(out).items() if not exists(spark, p)]:
        raise quality.GateClosed(f"not validated: {', '.join(missing)}")
    if fingerprint(spark, silver_paths(out)) != r["impressao"]:
        raise quality.GateClosed(f"the validated layer has changed since run {r['id_execucao']}")
    return r["id_execucao"]


def run_workflow(spark: SparkSession, sources: Sources, users: DataFrame, recommendations: DataFrame, out: str, key: str, run: str | None = None, prior: DataFrame | None = None) -> Outcome:
    """All layers in order under one run id.  A closed gate raises and leaves the published tables as they were."""
    if not key:
        raise ValueError("a pseudonymisation key is required")
    run, times, counts = run_id(run), {}, {}
    with stage("raw", times):
        raw = raw_layer(spark, sources, run)
        for name, df in raw.items():
            sinks.overwrite(df, f"{out}/bronze/{name}")
        raw = {name: spark.read.parquet(f"{out}/bronze/{name}") for name in raw}
    with stage("silver", times):
        silver, rejected = {}, {}
        for contract in (CATALOGUE, INTERACTION, COMMENT):
            references = {} if contract is CATALOGUE else {"contents": silver["catalogo"], "users": users}
            kept, bad = layers.silver_split(both_forms(raw[contract.name], contract), contract, **references)
            sinks.overwrite(kept, f"{out}/silver/{contract.name}")
            sinks.overwrite(bad, f"{out}/quarentena/{contract.name}")
            silver[contract.name], rejected[contract.name] = spark.read.parquet(f"{out}/silver/{contract.name}"), spark.read.parquet(f"{out}/quarentena/{contract.name}")
    with stage("quality", times):
        batch = quality.Batch(silver, users, {n: df.count() for n, df in raw.items()}, {n: df.count() for n, df in rejected.items()})
        results = quality.run_rules(batch)
        print_, verdict = fingerprint(spark, silver_paths(out)), quality.status(results)
        ended = spark.createDataFrame([(run, verdict, False, print_)], "id_execucao string, situacao string, simulada boolean, impressao string").withColumn("fim", F.current_timestamp())
        sinks.append(ended, f"{out}/qualidade_execucao")
        sinks.append(spark.createDataFrame([(run, r.rule, r.source, r.evaluated, r.violated, r.metric, r.passed) for r in results], "id_execucao string, id_regra string, fonte string, avaliados long, violados long, metrica double, aprovado boolean"), f"{out}/qualidade")
        status = quality.require_open(results)
    typed_ = {c.name: c.conformed(silver[c.name]) for c in (CATALOGUE, INTERACTION, COMMENT)}
    with stage("master", times):
        for contract in (CATALOGUE, INTERACTION, COMMENT):
            parents = {} if contract is CATALOGUE else {"conteudo_id": typed_["catalogo"], "usuario_id": users}
            validation.require_integrity(typed_[contract.name], contract, parents)
        records = master.tagged({"silver_catalogo": typed_["catalogo"]} | ({} if sources.recommender is None else {"d1_postgres": sources.recommender}))
        origins = master.resolved(records)
        sequence = f"{out}/gold/mestre_sequencia"
        last = spark.read.parquet(sequence).first()["ultimo_numero"] if exists(spark, sequence) else 0  # one row
        golden = master.with_master_ids(master.consolidated(origins), origins, prior, last)
        golden, origins = written(golden, f"{out}/mestre/{run}/ouro"), written(origins, f"{out}/mestre/{run}/origens")
        links = written(master.correspondence(golden, origins, prior), f"{out}/mestre/{run}/correspondencia")
        ends = master.last_numbers(links).select(F.greatest("ultimo_numero", F.lit(last).cast("long")).alias("ultimo_numero"))
    with stage("export", times):
        counts |= export(spark, typed_, f"{out}/parquet")
    with stage("aggregate", times):
        monthly = engagement.stamped(engagement.engagement_by_month_category(typed_["interacoes"], typed_["catalogo"]), run, "spark")
    with stage("gold", times):
        gate = require_validated(spark, out, run)
        consumed = gold.consumption(typed_["interacoes"], links)
        tables = {
            "dim_conteudo": gold.dim_content(golden),
            "dim_usuario": gold.dim_user(users, typed_["interacoes"], key),
            "fato_interacao": gold.fact_interaction(typed_["interacoes"], links, typed_["catalogo"], key),
            "fato_comentario": gold.fact_comment(typed_["comentarios"], links, typed_["catalogo"], key),
            "fato_recomendacao": gold.fact_recommendation(recommendations, links, consumed, key, None if sources.recommender is not None else gold.CATALOGUE_SOURCE),
            "kpi_engajamento_mensal_categoria": monthly,
            "conteudo_correspondencia": links,
            "conteudo_mestre": master.golden_table(golden),
            "conteudo_conflito": master.conflicts(records, origins),
            "mestre_sequencia": ends,
        }
        counts |= sinks.publish_all(spark, tables, f"{out}/gold", minimised)
        sinks.append(gold.publication_row(spark, run, gate, status, counts), f"{out}/publicacao")
    return Outcome(run, status, results, counts, times)


def written(df: DataFrame, path: str) -> DataFrame:
    """A table that several others read: planned and computed once."""
    sinks.overwrite(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def minimised(name: str, df: DataFrame) -> None:
    """Nothing that names a user, and no comment's text, leaves the validated layer."""
    if bad := {"usuario_id", "comentario"} & set(df.columns):
        raise ValueError(f"{name} must not hold {', '.join(sorted(bad))}")


def export(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Publish each table by itself; one that fails doesn't keep the others from going out."""
    counts, failures = {}, []
    for contract in (CATALOGUE, INTERACTION, COMMENT):
        try:
            df = sinks.with_month(tables[contract.name], contract)
            counts[contract.name] = sinks.publish(spark, df, f"{root}/{contract.name}", tables[contract.name].count(), "ano_mes" if contract.partition_by else None)
        except Exception as error:
            log.exception("%s isn't exported", contract.name)
            failures.append(f"{contract.name}: {error}")
    if failures:
        raise RuntimeError("; ".join(failures))
    return counts


def main(arguments: list[str] | None = None) -> int:
    """0: published; 1: the gate is closed; 2: the run failed."""
    parser = argparse.ArgumentParser(prog="quarrylight")
    for name in ("--catalogo", "--interacoes", "--comentarios", "--usuarios", "--recomendacoes", "--saida"):
        parser.add_argument(name, required=True)
    parser.add_argument("--catalogo-recomendador", help="Parquet of the recommender's own catalogue")
    parser.add_argument("--id-execucao")
    parser.add_argument("--chave", default=os.environ.get("CHAVE_PSEUDONIMO", ""))
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("quarrylight").getOrCreate()
    try:
        prior = f"{a.saida}/gold/conteudo_correspondencia"
        before = spark.read.parquet(prior) if exists(spark, prior) else None
        done = run_workflow(spark, Sources(a.catalogo, a.interacoes, a.comentarios, spark.read.parquet(a.catalogo_recomendador) if a.catalogo_recomendador else None), spark.read.parquet(a.usuarios), spark.read.parquet(a.recomendacoes), a.saida, a.chave, a.id_execucao, before)
    except quality.GateClosed as closed:
        log.error("gate closed: %s", closed)
        return 1
    except Exception:
        log.exception("the run failed")
        return 2
    log.info("%s: %s", done.status, done.counts)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

