"""Writers and load semantics on plain Parquet, CSV and JSON."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.sources.contracts import PARTITION, Contract
from quarrylight.sources.readers import exists, fs_path

# --- files ---


def write_delimited(df: DataFrame, path: str, separator: str = ",", mode: str = "overwrite", line_end: str = "\n") -> None:
    df.write.mode(mode).options(header=True, sep=separator, quote='"', escape='"', lineSep=line_end, encoding="UTF-8").csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_json_document(df: DataFrame, path: str, name: str | None = "data", buffer: int = 1 << 20) -> None:
    """One ``{"data": [...]}`` document, or a bare array, in ``path``/part-00000.json; replaces what is there.

    Rows pass through the store's client a partition at a time, so neither a task nor the driver holds them all.
    """
    spark = df.sparkSession
    p, fs = fs_path(spark, path)
    fs.delete(p, True)
    target, fs = fs_path(spark, f"{path}/part-00000.json")
    out = fs.create(target, True)
    parts = [f"{{{json.dumps(name)}:[" if name else "["]
    size, first = 0, True
    for r in df.select(F.to_json(F.struct(*df.columns)).alias("value")).toLocalIterator():
        parts.append(r["value"] if first else "," + r["value"])
        size, first = size + len(parts[-1]), False
        if size >= buffer:
            out.write(bytearray("".join(parts).encode()))
            parts, size = [], 0
    out.write(bytearray(("".join(parts) + ("]}" if name else "]")).encode()))
    out.close()


def write_single(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One Parquet file, for small results; what is upstream keeps its own tasks."""
    df.repartition(1).write.mode(mode).option("compression", "snappy").parquet(path)


def with_month(df: DataFrame, contract: Contract) -> DataFrame:
    return df.withColumn(PARTITION, F.date_format(contract.partition_by, "yyyy-MM")) if contract.partition_by else df


def write_partitioned(df: DataFrame, path: str, by: str = PARTITION, mode: str = "errorifexists", files_per_value: int = 0) -> None:
    """Hive partitions.  With ``files_per_value`` rows are dealt to so many files a partition, else to files of about
    the session's advisory size: small partitions share a task and large ones are split."""
    if files_per_value:
        df = df.repartition(by, F.pmod(F.xxhash64(*df.columns), F.lit(files_per_value)))
    else:
        df = df.hint("rebalance", F.col(by))
    df.write.mode(mode).partitionBy(by).option("compression", "snappy").parquet(path)


# --- publication ---


def _move(spark: SparkSession, source: str, target: str) -> None:
    s, fs = fs_path(spark, source)
    t, _ = fs_path(spark, target)
    if not fs.exists(t.getParent()):
        fs.mkdirs(t.getParent())
    if not fs.rename(s, t):
        raise OSError(f"{source} can't be moved to {target}")


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = fs_path(spark, path)
    fs.delete(p, True)


JOURNAL = "_journal.json"


def recover(spark: SparkSession, root: str) -> bool:
    """End a publication that was lost between its renames: all its tables were written and checked."""
    path = f"{root}/{JOURNAL}"
    if not exists(spark, path):
        return False
    journal = json.loads(read_text(spark, path))
    for name in journal["tables"]:
        if exists(spark, f"{journal['stage']}/{name}"):
            if exists(spark, f"{root}/{name}"):
                _move(spark, f"{root}/{name}", f"{journal['old']}/{name}")
            _move(spark, f"{journal['stage']}/{name}", f"{root}/{name}")
    for gone in (path, journal["stage"], journal["old"]):
        if exists(spark, gone):
            _delete(spark, gone)
    return True


def publish_all(spark: SparkSession, tables: dict[str, DataFrame], root: str, check: Callable[[str, DataFrame], None] | None = None, partition: dict[str, str] | None = None) -> dict[str, int]:
    """Write all tables aside, re-read and check each, then swap all in; nothing changes if one fails.

    Returns row counts, also kept in ``_manifest.json``.  The renames come last and are few; if one
    fails those before it are undone.  A journal tells of them: where a driver was lost in between, the
    next publication, or ``recover``, ends them first.
    """
    recover(spark, root)
    stage, old = f"{root}/_stage-{uuid.uuid4().hex}", f"{root}/_old-{uuid.uuid4().hex}"
    counts: dict[str, int] = {}
    try:
        for name, df in tables.items():
            by = (partition or {}).get(name)
            write_partitioned(df, f"{stage}/{name}", by) if by else df.write.option("compression", "snappy").parquet(f"{stage}/{name}")
            again = spark.read.parquet(f"{stage}/{name}")
            want = {f.name: f.dataType for f in df.schema}
            if {f.name: f.dataType for f in again.schema if f.name != by} != {k: v for k, v in want.items() if k != by}:
                raise ValueError(f"{name}: the written schema differs")
            if check:
                check(name, again)
            counts[name] = again.count()
        swapped: list[str] = []
        write_text(spark, f"{root}/{JOURNAL}", json.dumps({"stage": stage, "old": old, "tables": list(tables)}))
        try:
            for name in tables:
                if exists(spark, f"{root}/{name}"):
                    _move(spark, f"{root}/{name}", f"{old}/{name}")
                swapped.append(name)
                _move(spark, f"{stage}/{name}", f"{root}/{name}")
        except Exception:
            for name in swapped:
                if exists(spark, f"{old}/{name}"):
                    if exists(spark, f"{root}/{name}"):
                        _delete(spark, f"{root}/{name}")
                    _move(spark, f"{old}/{name}", f"{root}/{name}")
            raise
    finally:
        _delete(spark, f"{root}/{JOURNAL}")
        _delete(spark, stage)
        if exists(spark, old):
            _delete(spark, old)
    write_text(spark, f"{root}/_manifest.json", json.dumps({"rows": counts}, ensure_ascii=False, sort_keys=True))
    return counts


def publish(spark: SparkSession, df: DataFrame, path: str, rows: int | None = None, by: str | None = None) -> int:
    """Validate-then-swap of one table; ``rows`` is the count that it must have."""
    root, _, name = path.rstrip("/").rpartition("/")

    def check(_: str, again: DataFrame) -> None:
        if rows is not None and again.count() != rows:
            raise ValueError(f"{name}: {again.count()} rows written, {rows} expected")

    return publish_all(spark, {name: df}, root, check, {name: by} if by else None)[name]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through the store's own client."""
    p, fs = fs_path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def schema_differences(spark: SparkSession, found: T.StructType, wanted: T.StructType) -> DataFrame:
    """(coluna, tipo, tipo_esperado) of the columns that differ; null where a side hasn't the column."""
    sides = [{f.name: f.dataType.simpleString() for f in s} for s in (found, wanted)]
    rows = [(n, sides[0].get(n), sides[1].get(n)) for n in sorted({*sides[0], *sides[1]}) if sides[0].get(n) != sides[1].get(n)]
    return spark.createDataFrame(rows, "coluna string, tipo string, tipo_esperado string")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file through the store's own client; Spark's readers skip names that begin with an underscore."""
    p, fs = fs_path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


# --- load semantics: functions of the old table and the new rows ---


def one_of_key(df: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row a key: the first by ``order``, and of equals that of the least hash."""
    place = F.struct(*(order or []), F.xxhash64(*df.columns))
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), place).alias("linha")).select(*[F.col(c) if c in key else F.col(f"linha.{c}").alias(c) for c in df.columns])


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """Old rows and the new rows of unseen keys, one a key, the first by ``order``."""
    unseen = one_of_key(new.join(old.select(*key).distinct(), key, "left_anti").select(*old.columns), key, order)
    return old.unionByName(unseen)


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = (), order: list[Column] | None = None) -> DataFrame:
    """New rows replace old ones of their key, of several the first by ``order``; columns in ``keep`` stay as first written."""
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns], F.lit(True).alias("o_row"))
    n = one_of_key(new.select(*old.columns), key, order).withColumn("n_row", F.lit(True))
    both = n.join(o, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in key], "full_outer")

    def pick(c: str) -> Column:
        if c in keep:
            return F.when(F.col("o_row"), F.col(f"o_{c}")).otherwise(F.col(c))
        return F.when(F.col("n_row"), F.col(c)).otherwise(F.col(f"o_{c}"))

    return both.select(*[pick(c).alias(c) for c in old.columns])


def delete_keys(old: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return old.join(gone.select(*key).distinct(), key, "left_anti")


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(by) if by else w).parquet(path)


def append_row(df: DataFrame, **values) -> DataFrame:
    """A table with one more row; columns not named are null."""
    row = df.sparkSession.createDataFrame([tuple(values.get(c) for c in df.columns)], T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]))
    return df.unionByName(row)


def overwrite(df: DataFrame, path: str) -> None:
    """Full replacement of a table's rows."""
    df.write.mode("overwrite").parquet(path)


def evidence(title: str, values: dict[str, object], samples: dict[str, DataFrame] | None = None, rows: int = 10) -> tuple[str, str]:
    """JSON and Markdown of a run: its figures and the first rows of its results."""
    parts = {name: [r.asDict(True) for r in df.orderBy(df.columns[0]).limit(rows).collect()] for name, df in (samples or {}).items()}
    document = json.dumps({"title": title, **values, "samples": parts}, default=str, ensure_ascii=False, indent=1)
    lines = [f"# {title}", "", "| key | value |", "|-|-|", *(f"| {k} | {v} |" for k, v in values.items())]
    for name, found in parts.items():
        head = list(found[0]) if found else []
        lines += ["", f"## {name}", "", "| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(str(r[c]) for c in head) + " |" for r in found)]
    return document, "\n".join(lines) + "\n"
