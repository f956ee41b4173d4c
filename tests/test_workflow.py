import json
from datetime import date, datetime

import pytest

from quarrylight.operators import quality
from quarrylight.plans import workflow
from quarrylight.streaming import engagement as streaming

KINDS = ["início", "visualização", "conclusão", "curtida", "compartilhamento", "avaliação"]


@pytest.fixture
def inputs(tmp_path):
    head = "conteudo_id,titulo,tipo,categoria,nivel,carga_horaria_min,data_publicacao,descricao,autor"
    lines = [f'{i},"Título {i}",Curso,Cat{i % 3},Básico,{20 + i},2024-01-0{1 + i % 9},Texto,Ana' for i in range(1, 13)]
    (tmp_path / "catalogo.csv").write_text("\n".join([head, *lines]) + "\n", encoding="utf-8")
    acts = []
    for i in range(60):
        kind = KINDS[i % 6]
        acts.append({"usuario_id": 1 + i % 5, "conteudo_id": 1 + i % 12, "tipo_interacao": kind, "data_hora": f"2024-0{2 + i % 3}-10T{i % 24:02d}:{i:02d}:00", "tempo_consumido": 1.5, "percentual_conclusao": "100.00" if kind == "conclusão" else "50.00", "avaliacao_atribuida": 4 if kind == "avaliação" else None})
    acts.append(dict(acts[0]))  # a duplicate, to quarantine
    (tmp_path / "interacoes.json").write_text(json.dumps(acts, ensure_ascii=False), encoding="utf-8")
    notes = [{"usuario_id": 1 + i % 5, "conteudo_id": 1 + i % 12, "avaliacao": 1 + i % 5, "comentario": f"c{i}", "tags": ["a", f"t{i % 3}"], "data": "2024-03-01"} for i in range(20)]
    (tmp_path / "comentarios.json").write_text(json.dumps(notes), encoding="utf-8")
    return tmp_path


def run(spark, folder, out="out", **options):
    users = spark.createDataFrame([(i,) for i in range(1, 8)], "usuario_id int")
    recs = spark.createDataFrame([(1, 1, 1, 1, 80.0, "Positivo", datetime(2024, 1, 1)), (2, 2, 5, 2, 50.0, "Estável", datetime(2024, 1, 1))], "recomendacao_id long, usuario_id int, conteudo_id int, posicao int, pontuacao double, status string, data_geracao timestamp_ntz")
    sources = workflow.Sources(*(str(folder / n) for n in ("catalogo.csv", "interacoes.json", "comentarios.json")), options.pop("recommender", None))
    return workflow.run_workflow(spark, sources, users, recs, str(folder / out), options.pop("key", "k"), **options)


def test_whole_workflow(spark, inputs):
    done = run(spark, inputs, run="r1")
    assert done.status in (quality.PASSED, quality.ALERTED) and done.run == "r1"
    assert done.counts["fato_interacao"] == 60 and done.counts["fato_comentario"] == 20 and done.counts["dim_usuario"] == 7
    gold = str(inputs / "out" / "gold")
    fact = spark.read.parquet(f"{gold}/fato_interacao")
    assert "usuario_id" not in fact.columns
    monthly = spark.read.parquet(f"{gold}/kpi_engajamento_mensal_categoria")
    assert monthly.groupBy().sum("total_interacoes").first()[0] == 60
    before = {r["id_origem"]: r["conteudo_mestre_id"] for r in spark.read.parquet(f"{gold}/conteudo_correspondencia").collect()}
    again = run(spark, inputs, run="r2", prior=spark.read.parquet(f"{gold}/conteudo_correspondencia"))
    assert again.counts["dim_conteudo"] == done.counts["dim_conteudo"]
    assert before == {r["id_origem"]: r["conteudo_mestre_id"] for r in spark.read.parquet(f"{gold}/conteudo_correspondencia").collect()}
    assert spark.read.parquet(str(inputs / "out" / "publicacao")).count() == 2
    assert spark.read.parquet(str(inputs / "out" / "parquet" / "interacoes")).where("ano_mes = '2024-03'").count() == 20


def master_ids(spark, inputs):
    return {(r["fonte"], r["id_origem"]): r["conteudo_mestre_id"] for r in spark.read.parquet(str(inputs / "out" / "gold" / "conteudo_correspondencia")).collect()}


def test_master_data_over_runs(spark, inputs):
    """A new, a merged and a vanished content; numbers are never used twice; both sources' conflicts are published."""
    gold = inputs / "out" / "gold"
    second = spark.createDataFrame([(1, "Título 1", "Curso", "Cat1", "Básico", 99, date(2024, 1, 2), "Texto", "Ana")], "conteudo_id int, titulo string, tipo string, categoria string, nivel string, carga_horaria_min int, data_publicacao date, descricao string, autor string")
    run(spark, inputs, run="r1", recommender=second)
    first = master_ids(spark, inputs)
    assert len(set(first.values())) == 12 and first["silver_catalogo", 1] == first["d1_postgres", 1]
    found = spark.read.parquet(str(gold / "conteudo_conflito")).collect()
    assert [(r["conteudo_id"], r["atributo"], r["nivel_conflito"], r["valor_escolhido"]) for r in found] == [(1, "carga_horaria_min", "entre_fontes", "21")]
    assert {r["id_origem"]: r["regra"] for r in spark.read.parquet(str(gold / "conteudo_correspondencia")).collect()} == {k: "M1" if k == 1 else "UNICO" for k in range(1, 13)}
    assert spark.read.parquet(str(gold / "conteudo_mestre")).count() == 12

    lines = (inputs / "catalogo.csv").read_text(encoding="utf-8").splitlines()
    head, *rows = lines
    last = max(first.values())
    gone = next(k for (f, k), v in first.items() if v == last and f == "silver_catalogo")  # the last number's content becomes another's duplicate
    rows = [r if not r.startswith(f"{gone},") else r.replace(f"Título {gone}", "TÍTULO 2") for r in rows] + ['13,"Novo",Curso,Cat1,Básico,30,2024-01-05,Texto,Ana']
    (inputs / "catalogo.csv").write_text("\n".join([head, *rows]) + "\n", encoding="utf-8")
    run(spark, inputs, run="r2", prior=spark.read.parquet(str(gold / "conteudo_correspondencia")))
    then = master_ids(spark, inputs)
    assert then["silver_catalogo", gone] == then["silver_catalogo", 2] == min(first["silver_catalogo", 2], last)
    assert then["silver_catalogo", 13] not in first.values() and {k: v for k, v in then.items() if k[1] not in (gone, 2, 13)} == {k: v for k, v in first.items() if k[1] not in (gone, 2)}
    with_14 = "\n".join([head, *[r for r in rows if not r.startswith("13,")], '14,"Mais um",Curso,Cat1,Básico,30,2024-01-05,Texto,Ana']) + "\n"
    (inputs / "catalogo.csv").write_text(with_14, encoding="utf-8")
    run(spark, inputs, run="r3", prior=spark.read.parquet(str(gold / "conteudo_correspondencia")))
    end = master_ids(spark, inputs)
    assert end["silver_catalogo", 14] not in {*first.values(), *then.values()} and end["silver_catalogo", 13] == then["silver_catalogo", 13]


def test_a_changed_layer_closes_the_gate(spark, inputs):
    out = str(inputs / "out")
    with pytest.raises(quality.GateClosed, match="no run"):
        workflow.require_validated(spark, out)
    run(spark, inputs, run="r1")
    assert workflow.require_validated(spark, out) == workflow.require_validated(spark, out, "r1") == "r1"
    with pytest.raises(quality.GateClosed, match="no run of the gate r9"):
        workflow.require_validated(spark, out, "r9")
    spark.read.parquet(f"{out}/silver/catalogo").limit(3).write.mode("append").parquet(f"{out}/silver/catalogo")
    with pytest.raises(quality.GateClosed, match="changed"):
        workflow.require_validated(spark, out)


def test_closed_gate_publishes_nothing(spark, inputs):
    text = (inputs / "interacoes.json").read_text(encoding="utf-8").replace('"percentual_conclusao": "100.00"', '"percentual_conclusao": "80.00"')
    (inputs / "interacoes.json").write_text(text, encoding="utf-8")
    with pytest.raises(quality.GateClosed, match="QD05"):
        run(spark, inputs)
    assert not (inputs / "out" / "gold").exists()
    with pytest.raises(ValueError):
        run(spark, inputs, key="")


def test_helpers(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("ID_EXECUCAO", "env")
    assert workflow.run_id("a") == "a" and workflow.run_id() == "env"
    config = {"fontes": {}, "saida": {}, "recomendacao": {"top_n": 10, "limite_negativo": 40, "limite_positivo": 70}}
    assert workflow.checked_config(config) is config
    for broken in ({**config, "recomendacao": {"top_n": 0}}, {**config, "recomendacao": {"top_n": 1, "limite_negativo": 80}}, {"fontes": {}}):
        with pytest.raises(ValueError):
            workflow.checked_config(broken)
    (tmp_path / "a").write_text("1")
    first = workflow.fingerprint(spark, {"a": str(tmp_path / "a")})
    assert first == workflow.fingerprint(spark, {"a": str(tmp_path / "a")})
    (tmp_path / "a").write_text("2")
    assert first != workflow.fingerprint(spark, {"a": str(tmp_path / "a")})
    assert set(workflow.timed(lambda: None, 2)) == {"median", "min", "max"}


def test_stream_equals_batch(spark, tmp_path):
    schema = "usuario_id int, conteudo_id int, tipo_interacao string, data_hora timestamp_ntz, tempo_consumido double"
    rows = [(i % 3, i % 2, "início" if i % 2 else "conclusão", datetime(2024, 1, 1 + i % 5, i % 24), 1.0) for i in range(50)] + [(1, 1, "início", datetime(2024, 3, 1), 1.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    catalogue = spark.createDataFrame([(1, "A")], "conteudo_id int, categoria string")
    result = streaming.windowed_engagement(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), catalogue)
    q = streaming.start(result, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.groupBy().sum("total_interacoes").first()[0] == 50  # the last window stays open
    assert {r["categoria"] for r in found.collect()} == {"A", "Não catalogado"}
