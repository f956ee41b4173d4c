import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight import session
from quarrylight.sources import readers, sinks
from quarrylight.sources.contracts import CATALOGUE, INTERACTION

ROW = "1,Um,Curso,Dados,Básico,30,2024-01-05,Texto,Ana,catalogo.csv,2024/02/01 10:00:00.000,r1"


def csv(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_contract_strict_and_tolerant(spark, tmp_path):
    head = ",".join(CATALOGUE.schema.names)
    good = readers.read_contract(spark, CATALOGUE, csv(tmp_path, "a.csv", [head + ",extra", ROW + ",x"]))
    assert good.columns == CATALOGUE.schema.names and good.first()["carga_horaria_min"] == 30
    bad = csv(tmp_path, "b.csv", [head, ROW.replace("1,Um", "7.0,Um").replace(",30,", ",3x,").replace("2024-01-05", "05/01/2024")])
    r = readers.read_contract(spark, CATALOGUE, bad, tolerant=True).first()
    assert (r["conteudo_id"], r["carga_horaria_min"], r["data_publicacao"]) == (7, None, None)
    with pytest.raises(Exception):
        readers.read_contract(spark, CATALOGUE, bad).collect()
    with pytest.raises(ValueError, match="titulo"):
        readers.read_contract(spark, CATALOGUE, csv(tmp_path, "c.csv", [head.replace("titulo,", ""), ROW]))


def test_decimal_comma_and_quotes(spark, tmp_path):
    head = ";".join(INTERACTION.schema.names)
    line = '1;2;início;2024-01-05T10:00:00;"1,5";50;;o;2024/02/01 10:00:00.000;r'
    r = readers.read_contract(spark, INTERACTION, csv(tmp_path, "i.csv", [head, line]), tolerant=True).first()
    assert r["tempo_consumido"] == 1.5 and r["avaliacao_atribuida"] is None


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1, "tags": ["x"]}, {"b": "y"}]))
    rows = readers.read_json_array(spark, str(tmp_path / "a.json"), ["a", "tags", "missing"]).collect()
    assert rows[0].asDict() == {"a": "1", "tags": '["x"]', "missing": None}
    (tmp_path / "d.json").write_text(json.dumps({"data": [{"a": "1"}, {"a": "2"}]}))
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    assert readers.read_json_document(spark, str(tmp_path / "d.json"), schema).count() == 2
    assert readers.count_rows(spark, str(tmp_path / "d.json"), "document") == 2
    assert readers.count_rows(spark, str(tmp_path / "none.csv")) == 0
    sinks.write_json_document(spark.range(3), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert len(json.loads(text)["data"]) == 3


def test_files_and_annotated_sql(spark, tmp_path):
    for n in ("a.csv", "b.json", "b_reprocessado.json", "c.txt"):
        (tmp_path / n).write_text("x")
    assert readers.list_files(spark, str(tmp_path)) == ["a.csv", "b.json"]
    found = readers.parse_annotated_sql("-- @consulta: q1\n-- @titulo: Um\n-- mais\nSELECT 1;\n\n-- @consulta: q2\nSELECT 2\nFROM t;\n")
    assert found["q1"] == {"sql": "SELECT 1", "titulo": "Um mais"} and found["q2"]["sql"] == "SELECT 2\nFROM t"


def test_partitions_prune(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), F.concat(F.lit("2024-0"), (F.col("id") % 4 + 1).cast("string")).alias("ano_mes"))
    sinks.write_partitioned(df, str(tmp_path / "p"))
    found = readers.read_month(spark, str(tmp_path / "p"), "2024-02", ["id"])
    assert found.count() == 25
    assert "PartitionFilters: [isnotnull(ano_mes" in found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    with pytest.raises(Exception):
        sinks.write_partitioned(df, str(tmp_path / "p"))


def test_publication_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "gold")
    assert sinks.publish_all(spark, {"a": spark.range(3), "b": spark.range(2)}, root) == {"a": 3, "b": 2}

    def check(name, df):
        if name == "b":
            raise ValueError("no")

    with pytest.raises(ValueError):
        sinks.publish_all(spark, {"a": spark.range(9), "b": spark.range(9)}, root, check)
    assert spark.read.parquet(f"{root}/a").count() == 3 and spark.read.parquet(f"{root}/b").count() == 2
    assert sorted(p.name for p in (tmp_path / "gold").iterdir() if not p.name.startswith(".")) == ["_manifest.json", "a", "b"]
    with pytest.raises(ValueError):
        sinks.publish(spark, spark.range(5), f"{root}/a", rows=4)
    assert sinks.publish(spark, spark.range(5), f"{root}/a", rows=5) == 5


def test_a_lost_publication_is_ended(spark, tmp_path):
    root = str(tmp_path / "gold")
    sinks.publish_all(spark, {"a": spark.range(3), "b": spark.range(2)}, root)
    stage, old = f"{root}/_stage-x", f"{root}/_old-x"
    spark.range(7).write.parquet(f"{stage}/b")  # a is swapped already, b isn't
    sinks.overwrite(spark.range(5), f"{root}/a")
    sinks.overwrite(spark.range(3), f"{old}/a")
    sinks.write_text(spark, f"{root}/{sinks.JOURNAL}", json.dumps({"stage": stage, "old": old, "tables": ["a", "b"]}))
    assert sinks.recover(spark, root) and not sinks.recover(spark, root)
    assert spark.read.parquet(f"{root}/a").count() == 5 and spark.read.parquet(f"{root}/b").count() == 7
    assert sorted(p.name for p in (tmp_path / "gold").iterdir() if not p.name.startswith(".")) == ["_manifest.json", "a", "b"]


def test_equal_new_keys(spark):
    old = spark.createDataFrame([(1, "a", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 1), (1, "x", 9), (1, "y", 8)], "k int, v string, n int")
    for parts in (1, 5):
        assert sorted(map(tuple, sinks.upsert(old, new.repartition(parts), ["k"], order=[F.col("n")]).collect())) == [(1, "y", 8), (2, "d", 1)]
        assert sorted(map(tuple, sinks.insert_ignore(old, new.repartition(parts), ["k"], order=[-F.col("n")]).collect())) == [(1, "a", 1), (2, "c", 2)]


def test_shared_folder_on_a_cluster(spark):
    from quarrylight import session

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Cluster)


def test_row_numbers_outlive_lost_executors(spark, tmp_path):
    for k in range(4):  # files of more than the cost of opening one
        spark.range(k * 2_000_000, (k + 1) * 2_000_000, 1, 1).write.mode("append").option("compression", "uncompressed").parquet(str(tmp_path / "t"))
    key, was = "spark.sql.leafNodeDefaultParallelism", spark.conf.get(session.SPLITS, None)
    spark.conf.unset(session.SPLITS)
    try:
        spark.conf.set(key, "8")
        table = spark.read.parquet(str(tmp_path / "t"))
        numbered = lambda: table.select("id", F.monotonically_increasing_id().alias("row"))
        first = session.written(numbered(), "numbered")
        spark.conf.set(key, "2")  # as when executors are lost
        assert first.exceptAll(numbered()).isEmpty()
        spark.conf.unset(session.SPLITS)
        assert not first.exceptAll(numbered()).isEmpty()
    finally:
        spark.conf.unset(key)
        spark.conf.unset(session.SPLITS) if was is None else spark.conf.set(session.SPLITS, was)


def test_load_semantics(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, first int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, first int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sinks.upsert(old, new, ["k"], ("first",))) == [(1, "a", 1), (2, "c", 1), (3, "d", 2)]
    assert rows(sinks.upsert(sinks.upsert(old, new, ["k"]), new, ["k"])) == rows(sinks.upsert(old, new, ["k"]))
    assert rows(sinks.insert_ignore(old, new, ["k"])) == [(1, "a", 1), (2, "b", 1), (3, "d", 2)]
    assert rows(sinks.delete_keys(old, new, ["k"])) == [(1, "a", 1)]
    assert rows(sinks.append_row(old, k=9, v="z"))[-1] == (9, "z", None)
    document, text = sinks.evidence("T", {"n": 1}, {"t": old})
    assert json.loads(document)["samples"]["t"][0]["v"] == "a" and "| k | v | first |" in text
