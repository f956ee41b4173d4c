"""Registered queries that write tables, files and documents to the shared folder and read them again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.functions.scalars import month
from quarrylight.plans.queries import _TYPED_SQL, query, text_interactions
from quarrylight.plans.standins import Entities
from quarrylight.session import new_path
from quarrylight.sources import readers, sinks
from quarrylight.sources.contracts import CATALOGUE, INTERACTION

_BARE = T.StructType(list(CATALOGUE.columns))
_NAMES = ", ".join(f.name for f in CATALOGUE.columns)


@query(f"SELECT {_NAMES} FROM catalogo", "catalogo")
def csv_round_trip(e: Entities) -> DataFrame:
    path = new_path(e.spark, "csv")
    sinks.write_delimited(e.catalogue.select(*_BARE.names), path)
    return readers.read_typed_csv(e.spark, path, _BARE, formats=CATALOGUE.formats)


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, 'a, ' || chr(10) || '\"' || p_name || '\"' AS texto FROM part")
def csv_line_ends(e: Entities) -> DataFrame:
    path = new_path(e.spark, "csv")
    text = F.concat(F.lit('a, \n"'), "p_name", F.lit('"'))
    sinks.write_delimited(e.table("part").select("p_partkey", text.alias("texto")), path, line_end="\r\n")
    return readers.read_text_csv(e.spark, path, multi_line=True)


@query(f"SELECT count(*) AS linhas, count(conteudo_id) AS com_conteudo, count(raw_conteudo_id) AS com_texto, count(avaliacao_atribuida) AS com_nota FROM {_TYPED_SQL}", "interacao")
def csv_both_forms(e: Entities) -> DataFrame:
    path = new_path(e.spark, "csv")
    sinks.write_delimited(text_interactions(e).drop("ordinal"), path, INTERACTION.separator)
    rows = readers.read_both(e.spark, INTERACTION, path)
    return rows.agg(F.count("*").alias("linhas"), F.count("conteudo_id").alias("com_conteudo"), F.count("raw_conteudo_id").alias("com_texto"), F.count("avaliacao_atribuida").alias("com_nota"))


@query(f"SELECT usuario_id, conteudo_id, percentual_conclusao, avaliacao_atribuida FROM {_TYPED_SQL} WHERE conteudo_id IS NOT NULL", "interacao")
def csv_strict(e: Entities) -> DataFrame:
    path = new_path(e.spark, "csv")
    sinks.write_delimited(text_interactions(e).where("conteudo_id <> 'x'"), path, INTERACTION.separator)
    return readers.read_contract(e.spark, INTERACTION, path).select("usuario_id", "conteudo_id", "percentual_conclusao", "avaliacao_atribuida")


@query("SELECT CAST(conteudo_id AS VARCHAR) AS conteudo_id, titulo FROM catalogo WHERE starts_with(nivel, 'B')", "catalogo")
def csv_prefix(e: Entities) -> DataFrame:
    path = new_path(e.spark, "csv")
    sinks.write_delimited(e.catalogue, path, "|")
    return readers.read_csv_prefix(e.spark, path, "|", "nivel", "B", ["conteudo_id", "titulo"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, '[\"' || n_name || '\"]' AS nomes, CAST(NULL AS VARCHAR) AS ausente FROM nation")
def json_array(e: Entities) -> DataFrame:
    path = new_path(e.spark, "json")
    sinks.write_json_document(e.table("nation").select("n_nationkey", "n_name", F.array("n_name").alias("nomes")), path, None)
    return readers.read_json_array(e.spark, path, ["n_nationkey", "n_name", "nomes", "ausente"])


@query("SELECT conteudo_id, titulo, data_publicacao FROM catalogo", "catalogo")
def json_document(e: Entities) -> DataFrame:
    path = new_path(e.spark, "json")
    rows = e.catalogue.select("conteudo_id", "titulo", "data_publicacao")
    sinks.write_json_document(rows, path)
    return readers.read_json_document(e.spark, path, rows.schema)


@query("SELECT c_custkey, c_mktsegment FROM customer")
def json_lines(e: Entities) -> DataFrame:
    path, rows = new_path(e.spark, "json"), e.table("customer").select("c_custkey", "c_mktsegment")
    sinks.write_json_lines(rows, path)
    return e.spark.read.schema(rows.schema).json(path)


@query("SELECT r_regionkey, r_name FROM region")
def table_scan(e: Entities) -> DataFrame:
    e.table("region").createOrReplaceTempView("quarrylight_region")
    return readers.read_table(e.spark, "quarrylight_region", ["r_regionkey", "r_name"])


@query("SELECT usuario_id, conteudo_id, tipo_interacao FROM interacao WHERE strftime(data_hora, '%Y-%m') = '2024-03'", "interacao")
def partition_prune(e: Entities) -> DataFrame:
    """Published by month, read by month: other partitions' files aren't opened."""
    path = new_path(e.spark, "meses")
    rows = e.interactions.select("usuario_id", "conteudo_id", "tipo_interacao", month("data_hora").alias("ano_mes"))
    sinks.publish(e.spark, rows, f"{path}/interacoes", by="ano_mes")
    return readers.read_month(e.spark, f"{path}/interacoes", "2024-03", ["usuario_id", "conteudo_id", "tipo_interacao"], rows.schema)


@query("SELECT tipo_interacao, count(*) AS linhas FROM interacao GROUP BY 1", "interacao")
def single_file(e: Entities) -> DataFrame:
    path = new_path(e.spark, "unico")
    sinks.write_single(e.interactions.groupBy("tipo_interacao").agg(F.count("*").alias("linhas")), path)
    return readers.read_parquet(e.spark, path, ["tipo_interacao", "linhas"])


@query("SELECT * FROM (SELECT 'csv' AS forma, count(*) AS linhas FROM nation UNION ALL SELECT 'json', count(*) FROM nation UNION ALL SELECT 'document', count(*) FROM nation UNION ALL SELECT 'parquet', count(*) FROM nation UNION ALL SELECT 'ausente', 0)")
def row_counts(e: Entities) -> DataFrame:
    path, nation = new_path(e.spark, "contagem"), e.table("nation")
    sinks.write_delimited(nation, f"{path}/csv")
    sinks.write_json_document(nation, f"{path}/json", None)
    sinks.write_json_document(nation, f"{path}/document")
    sinks.overwrite(nation, f"{path}/parquet")
    found = [(kind, readers.count_rows(e.spark, f"{path}/{kind}", kind)) for kind in ("csv", "json", "document", "parquet")]
    return e.spark.createDataFrame([*found, ("ausente", readers.count_rows(e.spark, f"{path}/nada"))], "forma string, linhas long")


@query("SELECT 'catalogo' AS fonte, count(*) AS linhas, 9 AS colunas FROM catalogo UNION ALL SELECT 'interacoes', count(*), 7 FROM interacao UNION ALL SELECT 'comentarios', count(*), 6 FROM region", "catalogo", "interacao")
def source_files(e: Entities) -> DataFrame:
    path = new_path(e.spark, "fontes")
    config = {name: f"{path}/{name}" for name in ("catalogo", "interacoes", "comentarios")}
    sinks.write_delimited(e.catalogue, config["catalogo"])
    sinks.write_json_document(e.interactions, config["interacoes"], None)
    sinks.write_json_document(e.table("region"), config["comentarios"], None)
    found = [(name, df.count(), len(df.columns)) for name, df in readers.read_sources(e.spark, config).items()]
    return e.spark.createDataFrame(found, "fonte string, linhas long, colunas int")


@query("SELECT * FROM (VALUES (1000, 'direct', 1.5), (1000, 'spark', 40.0), (100000, 'spark', 32.0)) AS v(registros, runtime, segundos)")
def evidence_scan(e: Entities) -> DataFrame:
    path = new_path(e.spark, "evidencias")
    for k, (rows, runtime, seconds) in enumerate(((1000, "direct", 1.5), (1000, "spark", 40.0), (100000, "spark", 32.0))):
        sinks.write_text(e.spark, f"{path}/execucao_{k}.json", json.dumps({"registros": rows, "runtime": runtime, "segundos": seconds}, indent=1))
    return readers.read_evidence(e.spark, f"{path}/execucao_*.json").select("registros", "runtime", "segundos")


@query("SELECT * FROM (VALUES ('q1', 'Um título longo', 'SELECT 1'), ('q2', NULL, 'SELECT 2')) AS v(nome, titulo, sql)")
def annotated_queries(e: Entities) -> DataFrame:
    script = "-- @consulta: q1\n-- @titulo: Um título\n-- longo\nSELECT 1;\n\n-- @consulta: q2\nSELECT 2;\n"
    rows = [(name, q.get("titulo"), q["sql"]) for name, q in readers.parse_annotated_sql(script).items()]
    return e.spark.createDataFrame(rows, "nome string, titulo string, sql string")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 99, 'fim'")
def appended_rows(e: Entities) -> DataFrame:
    path, rows = new_path(e.spark, "acrescimos"), e.table("nation").select("n_nationkey", "n_name")
    sinks.overwrite(e.table("nation").limit(0).select("n_nationkey", "n_name"), path)
    for _ in range(2):
        sinks.append(rows, path)
    return sinks.append_row(e.spark.read.schema(rows.schema).parquet(path), n_nationkey=99, n_name="fim")


@query("SELECT * FROM (VALUES ('a', 'int', 'bigint'), ('b', 'string', NULL), ('c', NULL, 'date')) AS v(coluna, tipo, tipo_esperado)")
def schema_differences(e: Entities) -> DataFrame:
    parse = T.StructType.fromDDL
    return sinks.schema_differences(e.spark, parse("a int, b string, d double"), parse("a bigint, c date, d double"))
