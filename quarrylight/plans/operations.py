"""Operational helpers: reprocessing of quarantine, counters, sorted output, cluster state, consumers' schemas."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.layers import mapped_values
from quarrylight.sources.readers import list_files, read_text_csv
from quarrylight.sources.sinks import write_delimited

QUARANTINE_COLUMNS = ("regra_violada", "mensagem_erro", "data_erro")

# Corrections of quarantined rows by column.
CORRECTIONS = {"tipo_interacao": {"teste_invalido": "conclusão"}}


def reprocess(spark: SparkSession, folder: str, out: str, handled: tuple[str, ...] = ("interacoes",), separator: str = ";") -> dict[str, int]:
    """Correct quarantined files that are known by name and write them for another run; others are left.

    Returns the rows written of each file, 0 for one that isn't handled.
    """
    counts = {}
    for name in list_files(spark, folder):
        stem = name.rpartition(".")[0]
        if stem not in handled:
            counts[name] = 0
            continue
        df = read_text_csv(spark, f"{folder}/{name}", separator)
        for column, values in CORRECTIONS.items():
            if column in df.columns:
                df = mapped_values(df, column, values)
        df = df.drop(*QUARANTINE_COLUMNS)
        write_delimited(df, f"{out}/{stem}_reprocessado", separator)
        counts[name] = df.count()
    return counts


def observed(df: DataFrame, **counters) -> tuple[DataFrame, Observation]:
    """``df`` with counters that are filled while it is computed, without another pass."""
    found = Observation()
    return df.observe(found, *[c.alias(name) for name, c in counters.items()]), found


def sorted_ignoring_case(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted by lower-case text, then by the text itself so that equal rows stand together."""
    kinds = dict(df.dtypes)
    return df.orderBy(*[F.lower(c) if kinds[c] == "string" else F.col(c) for c in columns], *columns)


def cluster_state(spark: SparkSession) -> dict[str, object]:
    sc = spark.sparkContext
    hosts = sc._jsc.sc().getExecutorMemoryStatus().size()
    return {"application": sc.applicationId, "master": sc.master, "version": sc.version, "parallelism": sc.defaultParallelism, "executors": hosts}


def foreign_tables(sql: str, allowed: str = "gold") -> set[str]:
    """Schemas, other than the allowed one, that a consumer's query names after FROM or JOIN."""
    return {m.lower() for m in re.findall(r"(?i)\b(?:from|join)\s+([a-z_]\w*)\.\w+", sql)} - {allowed}


def show_all(views: dict[str, Callable[[], DataFrame]], rows: int = 5) -> None:
    for title, view in views.items():
        print(f"\n{title}")
        view().show(rows, truncate=60)
