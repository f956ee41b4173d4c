from pyspark.sql import functions as F

from quarrylight.plans import operations as O
from quarrylight.sources.readers import read_text_csv


def test_reprocess(spark, tmp_path):
    (tmp_path / "interacoes.csv").write_text("usuario_id;tipo_interacao;regra_violada;mensagem_erro;data_erro\n1;teste_invalido;VALORES_PERMITIDOS;m;d\n2;outro;VALORES_PERMITIDOS;m;d\n")
    (tmp_path / "catalogo.csv").write_text("a\n1\n")
    (tmp_path / "x_reprocessado.csv").write_text("a\n1\n")
    assert O.reprocess(spark, str(tmp_path), str(tmp_path / "out")) == {"interacoes.csv": 2, "catalogo.csv": 0}
    found = read_text_csv(spark, str(tmp_path / "out" / "interacoes_reprocessado"), ";")
    assert found.columns == ["usuario_id", "tipo_interacao"] and {r[1] for r in found.collect()} == {"conclusão", "outro"}


def test_counters_order_and_state(spark):
    df, found = O.observed(spark.range(10), pares=F.count_if(F.col("id") % 2 == 0))
    assert df.count() == 10 and found.get == {"pares": 5}
    rows = spark.createDataFrame([("b",), ("B",), ("a",), ("b",)], "s string")
    assert [r["s"] for r in O.sorted_ignoring_case(rows, ["s"]).collect()] == ["a", "B", "b", "b"]
    assert O.cluster_state(spark)["executors"] >= 1
    assert O.foreign_tables("SELECT * FROM gold.a JOIN silver.b USING (k)") == {"silver"} and not O.foreign_tables("SELECT 1 FROM gold.a")
    O.show_all({"linhas": lambda: rows})
