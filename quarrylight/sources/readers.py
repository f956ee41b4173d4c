"""Scans: typed and raw CSV, JSON arrays and documents, tables, Parquet, and a catalogue of annotated SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.functions.scalars import comma_decimal
from quarrylight.sources.contracts import COMMENT, INGESTED_FORMAT, INTERACTION, Contract


def fs_path(spark: SparkSession, path: str):
    """A Hadoop path and its file system, whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = fs_path(spark, path)
    return fs.exists(p)


def list_files(spark: SparkSession, folder: str, include: str = r".*\.(csv|json)$", exclude: str = r".*_reprocessado\..*") -> list[str]:
    """File names of a folder, not of those below, by inclusion and exclusion patterns."""
    import re

    p, fs = fs_path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isFile()]
    return sorted(n for n in names if re.fullmatch(include, n) and not re.fullmatch(exclude, n))


def read_text_csv(spark: SparkSession, path: str, separator: str = ",", multi_line: bool = False) -> DataFrame:
    """All columns as text; only the empty string is null.

    ``multi_line`` allows line ends in quotes, and then a file can't be split: one task reads it whole.
    """
    return spark.read.options(header=True, sep=separator, quote='"', escape='"', nullValue="", multiLine=multi_line).csv(path)


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",", formats: dict[str, str] | None = None, multi_line: bool = False) -> DataFrame:
    """Header, quotes and a declared type and mask for each column; what doesn't convert is null."""
    text = read_text_csv(spark, path, separator, multi_line)
    return text.select(*[typed(F.col(f.name), f, (formats or {}).get(f.name), True).alias(f.name) for f in schema])


def typed(c: Column, f: T.StructField, mask: str | None, tolerant: bool) -> Column:
    """Text to a contract type.  Tolerant: null where it doesn't convert.  Strict: an error there."""
    if isinstance(f.dataType, T.StringType):
        return c
    if isinstance(f.dataType, (T.IntegerType, T.LongType)):
        if not tolerant:
            return c.cast(f.dataType)
        number = c.try_cast("double")
        return F.when(number % 1 == 0, number.try_cast(f.dataType))
    if isinstance(f.dataType, (T.DoubleType, T.DecimalType)):
        number = comma_decimal(c)
        return number.try_cast(f.dataType) if tolerant else number.cast(f.dataType)
    mask = mask or (INGESTED_FORMAT if f.name == "data_ingestao" else None)
    if mask:
        value = F.try_to_timestamp(c, F.lit(mask)) if tolerant else F.to_timestamp(c, mask)
    else:
        value = c.try_cast("timestamp") if tolerant else c.cast("timestamp")
    return value.cast(f.dataType)


def read_contract(spark: SparkSession, contract: Contract, path: str, tolerant: bool = False) -> DataFrame:
    """A validated CSV with its contract's types, columns and order."""
    text = contract.conformed(read_text_csv(spark, path, contract.separator))
    return type_contract(text, contract, tolerant)


def type_contract(text: DataFrame, contract: Contract, tolerant: bool = False) -> DataFrame:
    return text.select(*[typed(F.col(f.name), f, contract.formats.get(f.name), tolerant).alias(f.name) for f in contract.schema])


def read_both(spark: SparkSession, contract: Contract, path: str) -> DataFrame:
    """Typed columns beside the text that they came from (``raw_`` and the name), and the row's place."""
    text = contract.conformed(read_text_csv(spark, path, contract.separator))
    return with_raw(text, contract)


def with_raw(text: DataFrame, contract: Contract) -> DataFrame:
    raw = [F.col(n).alias(f"raw_{n}") for n in contract.schema.names]
    values = [typed(F.col(f.name), f, contract.formats.get(f.name), True).alias(f.name) for f in contract.schema]
    return text.select(*values, *raw, F.monotonically_increasing_id().alias("ordinal"))


def read_json_array(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """A JSON array of records as text; nested values stay JSON text and a missing field is null.

    The fields are known, so no pass is spent on inferring them.
    """
    return spark.read.option("multiLine", True).schema(T.StructType([T.StructField(n, T.StringType()) for n in fields])).json(path)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of ``{"data": [...]}``."""
    whole = T.StructType([T.StructField("data", T.ArrayType(schema))])
    return spark.read.option("multiLine", True).schema(whole).json(path).select(F.explode("data").alias("r")).select("r.*")


def read_table(spark: SparkSession, name: str, columns: list[str], jdbc: dict[str, str] | None = None) -> DataFrame:
    """Some columns of a table: by JDBC if options are given, else of Spark's catalogue."""
    df = spark.read.format("jdbc").options(**jdbc, dbtable=name).load() if jdbc else spark.table(name)
    return df.select(*columns)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet scan with projection and a predicate that reach the files: partition pruning and pushed filters.
    A known schema saves the job that would infer it."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def read_month(spark: SparkSession, path: str, month: str, columns: list[str], schema: T.StructType | None = None) -> DataFrame:
    return read_parquet(spark, path, columns, F.col("ano_mes") == month, schema)


def read_csv_prefix(spark: SparkSession, path: str, separator: str, column: str, prefix: str, columns: list[str]) -> DataFrame:
    """Rows of a CSV whose column begins with some text."""
    return read_text_csv(spark, path, separator).where(F.col(column).startswith(prefix)).select(*columns)


def count_rows(spark: SparkSession, path: str, kind: str = "csv", separator: str = ",") -> int:
    """Rows of a file, 0 if there is none."""
    if not exists(spark, path):
        return 0
    if kind == "json":
        return spark.read.option("multiLine", True).schema("nothing string").json(path).count()
    if kind == "document":
        sizes = spark.read.option("multiLine", True).schema("data array<string>").json(path).select(F.size(F.coalesce("data", F.array())).alias("n"))
        return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return spark.read.parquet(path).count() if kind == "parquet" else read_text_csv(spark, path, separator).count()


def read_sources(spark: SparkSession, config: dict[str, str]) -> dict[str, DataFrame]:
    """The three raw sources named in a configuration: a CSV catalogue and two JSON arrays."""
    out = {"catalogo": read_text_csv(spark, config["catalogo"])}
    for contract in (INTERACTION, COMMENT):
        out[contract.name] = read_json_array(spark, config[contract.name], [f.name for f in contract.columns])
    return out


def read_evidence(spark: SparkSession, pattern: str) -> DataFrame:
    """Run evidence (JSON) by input rows and runtime."""
    return spark.read.option("multiLine", True).json(pattern)


def parse_annotated_sql(script: str) -> dict[str, dict[str, str]]:
    """Queries of a script where ``-- @consulta: name`` begins each and other ``-- @key: value`` lines describe it."""
    out: dict[str, dict[str, str]] = {}
    current: dict[str, str] | None = None
    key = None
    for line in script.splitlines():
        text = line.strip()
        if text.startswith("-- @consulta:"):
            current, key = {"sql": ""}, None
            out[text.split(":", 1)[1].strip()] = current
        elif current is None:
            continue
        elif text.startswith("-- @") and ":" in text:
            key, _, value = text[4:].partition(":")
            key = key.strip()
            current[key] = value.strip()
        elif text.startswith("--") and key:
            current[key] = f"{current[key]} {text[2:].strip()}".strip()
        elif not text.startswith("--"):
            current["sql"] += line + "\n"
    for query in out.values():
        query["sql"] = query["sql"].strip().rstrip(";")
    return out
