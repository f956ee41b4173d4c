from datetime import date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import bi, documents, layers, master, ordinals, quality, recommend, search, validation
from quarrylight.sources.contracts import CATALOGUE, INTERACTION

INTERACTION_COLUMNS = "ordinal long, usuario_id int, conteudo_id int, tipo_interacao string, data_hora timestamp_ntz, tempo_consumido double, percentual_conclusao double, avaliacao_atribuida double"
T0 = datetime(2024, 1, 5, 10)


def interactions(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], INTERACTION_COLUMNS)


def test_silver_rules_in_order_and_keep_first(spark):
    df = interactions(spark, [
        (1, 1, "início", T0, 1.0, 10.0, None), (1, 1, "início", T0, 9.0, 20.0, 3.0), (None, 1, "início", T0, 1.0, 10.0, None), (1, 1, "outro", T0, 1.0, 10.0, None),
        (1, 9, "início", T0, 1.0, 10.0, None), (8, 1, "início", T0, 1.0, 10.0, None), (1, 1, "curtida", T0, 1.0, 101.0, None), (1, 1, "avaliação", T0, 1.0, 10.0, 6.0),
    ])
    contents, users = spark.createDataFrame([(1,), (1,)], "conteudo_id int"), spark.createDataFrame([(1,)], "usuario_id int")
    rules = {r["ordinal"]: r["regra_violada"] for r in layers.classify(df, INTERACTION, contents, users).collect()}
    assert rules == {0: None, 1: layers.DUPLICATE, 2: layers.REQUIRED, 3: layers.ALLOWED, 4: layers.NO_CONTENT, 5: layers.NO_USER, 6: layers.ALLOWED, 7: layers.ALLOWED}
    kept, bad = layers.silver_split(df, INTERACTION, contents, users)
    assert kept.count() == 1 and bad.count() == 7 and bad.where("mensagem_erro IS NULL").isEmpty()


def test_a_rejected_first_row_doesnt_hide_a_good_one(spark):
    df = interactions(spark, [(1, 1, "início", T0, -1.0, 10.0, None), (1, 1, "início", T0, 1.0, 10.0, None)])
    assert [r["ordinal"] for r in layers.silver_split(df, INTERACTION)[0].collect()] == [1]


def test_rounding_routing_replication(spark):
    df = spark.createDataFrame([("2.675",), ("0.125",), ("x",)], "v string")
    assert [str(r[0]) for r in df.select(layers.half_even("v")).collect()] == ["2.68", "0.12", "None"]
    parts = layers.route(spark.createDataFrame([("a",), ("b",), (None,)], "f string"), "f", {"first": "a"})
    assert (parts["first"].count(), parts["outros"].count()) == (1, 2)
    grown = layers.replicated(spark.createDataFrame([(1,), (3,)], "usuario_id int"), 3)
    assert sorted(r[0] for r in grown.collect()) == [1, 3, 5, 7, 9, 11]


CATALOGUE_ROWS = [(i, f"T{i}", "Curso", "Dados", "Básico", 30, date(2024, 1, 1), "d", "a", "o", T0, "r") for i in range(20)]


def catalogue_text(spark):
    schema = ", ".join(f"{n} string" for n in CATALOGUE.schema.names)
    rows = [tuple(x.strftime("%Y/%m/%d %H:%M:%S.000") if isinstance(x, datetime) else str(x) for x in r) for r in CATALOGUE_ROWS]
    return spark.createDataFrame(rows, schema).coalesce(1).withColumn("ordinal", F.monotonically_increasing_id())


def batch(spark, text):
    from quarrylight.sources.readers import typed

    names = CATALOGUE.schema.names
    values = [typed(F.col(f.name), f, CATALOGUE.formats.get(f.name), True).alias(f.name) for f in CATALOGUE.schema]
    df = text.select("ordinal", *[F.col(n).alias(f"raw_{n}") for n in names], *values)
    return quality.Batch({"catalogo": df}, spark.createDataFrame([(1,)], "usuario_id int"), {"catalogo": 20}, {"catalogo": 0})


def rules_for_catalogue():
    return tuple(r for r in quality.RULES if "catalogo" in r.sources)


def only_catalogue(rules):
    from dataclasses import replace

    return tuple(replace(r, sources=("catalogo",)) for r in rules)


def test_gate(spark):
    clean = quality.run_rules(batch(spark, catalogue_text(spark)), only_catalogue(rules_for_catalogue()))
    assert quality.status(clean) == quality.PASSED and quality.require_open(clean) == quality.PASSED
    broken = quality.run_rules(batch(spark, layers.with_defects(catalogue_text(spark), CATALOGUE)), only_catalogue(rules_for_catalogue()))
    failed = {r.rule: (r.violated, r.metric) for r in broken if not r.passed}
    assert failed == {"QD01": (2, 90.0), "QD02": (1, 95.0)}
    assert next(r for r in broken if r.rule == "QD02").sample == [{"registro": "conteudo_id=12", "mensagem": "nivel fora do domínio"}]
    with pytest.raises(quality.GateClosed):
        quality.require_open(broken)
    empty = quality.run_rules(batch(spark, catalogue_text(spark).limit(0)), only_catalogue(rules_for_catalogue())[:3])
    assert [r.metric for r in empty] == [100.0] * 3
    assert quality.volume(0, 0, 0)[2] == 0.0 and quality.quarantine_rate(0, 0, 0)[2] == 100.0 and quality.quarantine_rate(1080, 0, 80)[2] == pytest.approx(7.407, abs=1e-3)


MASTER_ROWS = [
    (77, "Análise de Dados", "Curso", "Dados", "Básico", 60, date(2024, 3, 1), "Texto", "Dr. Ana Sá"),
    (124, "analise de  dados", "curso", "Ciência", "basico", 89, date(2024, 5, 1), "texto!", "ana sa"),
    (5, "Análise de Dados", "Curso", "Dados", "Avançado", 10, date(2024, 1, 1), "Texto", "Ana Sá"),
    (6, "Outro", "Curso", "Dados", "Básico", 10, date(2024, 1, 2), "Texto", "Bia"),
]
MASTER_SCHEMA = "conteudo_id int, titulo string, tipo string, categoria string, nivel string, carga_horaria_min int, data_publicacao date, descricao string, autor string"


def test_master_data(spark):
    silver = spark.createDataFrame(MASTER_ROWS, MASTER_SCHEMA)
    d1 = spark.createDataFrame([(6, None, "Curso", "Dados", "Básico", 12, date(2024, 1, 2), "Texto", "Bia")], MASTER_SCHEMA)
    records = master.tagged({"silver_catalogo": silver, "d1_postgres": d1})
    conflict = master.source_conflicts(records).collect()
    assert [(r["conteudo_id"], r["atributo"], r["valor_escolhido"]) for r in conflict] == [(6, "carga_horaria_min", "10")]
    origins = master.resolved(records)
    golden = {r["conteudo_id_canonico"]: r for r in master.with_master_ids(master.consolidated(origins), origins).collect()}
    assert sorted(golden) == [5, 6, 77]
    r = golden[77]
    assert (r["titulo"], r["categoria"], r["carga_horaria_min"], r["data_publicacao"], r["membros"]) == ("Análise de Dados", "Ciência", 89, date(2024, 3, 1), [77, 124])
    assert {k: v["conteudo_mestre_id"] for k, v in golden.items()} == {5: "CM-000001", 6: "CM-000002", 77: "CM-000003"}
    assert {(r["id_origem"], r["fonte"]): r["regra"] for r in master.members(master.consolidated(origins), origins).collect()} == {(77, "silver_catalogo"): "M2", (124, "silver_catalogo"): "M2", (5, "silver_catalogo"): "UNICO", (6, "silver_catalogo"): "M1", (6, "d1_postgres"): "M1"}
    candidate = master.unmerged_candidates(origins).collect()
    assert [(r["conteudo_ids"], r["motivo"]) for r in candidate] == [([5, 77, 124], "diferem em nivel")]


def test_master_ids_are_stable_and_fuse(spark):
    origins = master.resolved(master.tagged({"silver_catalogo": spark.createDataFrame(MASTER_ROWS, MASTER_SCHEMA)}))
    prior = spark.createDataFrame([("silver_catalogo", 77, "CM-000009"), ("silver_catalogo", 124, "CM-000004")], "fonte string, id_origem int, conteudo_mestre_id string")
    found = {r["conteudo_id_canonico"]: (r["conteudo_mestre_id"], r["absorvidos"]) for r in master.with_master_ids(master.consolidated(origins), origins, prior, 9).collect()}
    assert found == {77: ("CM-000004", ["CM-000009"]), 5: ("CM-000010", []), 6: ("CM-000011", [])}


def test_numbered_is_consecutive(spark):
    df = ordinals.numbered(spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v")), [F.col("v")])
    assert all(r["numero"] == r["v"] + 1 for r in df.collect())


def test_numbered_keeps_all_rows_when_ranges_are_merged(spark, small_ranges):
    """Rows and sizes must see the same ranges, though wide rows fill more partitions than their keys alone."""
    rows = spark.range(0, 2000, 1, 7).select((F.col("id") * 37 % 2000).alias("v"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide"))
    found = ordinals.numbered(rows, [F.col("v")]).collect()
    assert len(found) == 2000
    assert all(r["numero"] == r["v"] + 1 for r in found)


@pytest.mark.parametrize("score,done,want", [(100, 1, "Positivo"), (70, 1, "Positivo"), (69.99, 1, "Estável"), (40.01, 1, "Estável"), (40, 1, "Negativo"), (0, 1, "Negativo"), (90, 0, "Negativo")])
def test_status(spark, score, done, want):
    assert spark.range(1).select(recommend.status(F.lit(float(score)), F.lit(float(done)), 40, 70)).first()[0] == want


def test_recommender_on_known_vectors(spark):
    e = lambda *on: [1.0 / len(on) ** 0.5 if i in on else 0.0 for i in range(8)]
    vectors = spark.createDataFrame([(1, e(1)), (2, e(1, 2)), (3, e(5))], "conteudo_id int, embedding array<double>")
    acts = interactions(spark, [(7, 1, "visualização", T0, 1.0, 10.0, None), (7, 3, "conclusão", T0, 1.0, 100.0, None), (7, 2, "curtida", T0, 1.0, 10.0, None)])
    users = spark.createDataFrame([(7,)], "usuario_id int")
    views = ("visualização",)
    pairs = recommend.similarities(users, acts, vectors, views=(*views, "conclusão"))
    r = {x["conteudo_id"]: x for x in recommend.scored(pairs, normalise=False).collect()}
    assert r[1]["i_vis"] == pytest.approx(0.7071) and r[1]["i_cur"] == pytest.approx(0.7071) and r[1]["pontuacao"] == pytest.approx(70.71) and r[1]["status"] == "Positivo"
    assert r[2]["i_vis"] == pytest.approx(0.5) and r[2]["i_cur"] == pytest.approx(1.0) and r[2]["pontuacao"] == pytest.approx(75.0)
    assert r[3]["i_conc"] == 0 and r[3]["pontuacao"] == 0 and r[3]["status"] == "Negativo"


def test_min_max_and_top_n(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.3), (1, 0.5), (2, 0.4), (2, 0.4)], "usuario_id int, v double")
    assert sorted((r[0], round(r[1], 9)) for r in df.select("usuario_id", recommend.min_max("v")).collect()) == [(1, 0.0), (1, 0.5), (1, 1.0), (2, 0.0), (2, 0.0)]
    rows = spark.createDataFrame([(1, 1, 80.0, "Positivo"), (1, 2, 70.0, "Positivo"), (1, 3, 90.0, "Positivo"), (1, 4, 80.0, "Positivo"), (1, 5, 99.0, "Negativo")], "usuario_id int, conteudo_id int, pontuacao double, status string")
    assert [r["conteudo_id"] for r in recommend.top_n(rows, 2).orderBy("posicao").collect()] == [3, 1]


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_blocks_equal_the_plain_recommender(spark, block_bytes):
    import random

    r = random.Random(3)
    vectors = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(6)] if i else [0.0] * 6) for i in range(40)], "conteudo_id int, embedding array<double>")
    kinds = ["visualização", "curtida", "conclusão", "início"]
    acts = interactions(spark, [(r.randrange(6), r.randrange(45), r.choice(kinds), T0, 1.0, 10.0, r.choice([None, 5.0])) for _ in range(80)])
    users = spark.createDataFrame([(i,) for i in range(8)], "usuario_id int")
    plain = recommend.top_n(recommend.scored(recommend.similarities(users, acts, vectors)), 7)
    key = lambda df: sorted((x["usuario_id"], x["posicao"], x["conteudo_id"], round(x["pontuacao"], 2), x["status"]) for x in df.collect())
    found = recommend.best_of_blocks(users, acts, vectors, 7, block_bytes=block_bytes)
    assert key(found) == key(plain) and set(found.columns) == set(plain.columns)
    counts = recommend.scored(recommend.similarities(users, acts, vectors)).groupBy("usuario_id", "status").count()
    assert {tuple(x) for x in recommend.status_counts(users, acts, vectors, block_bytes=block_bytes).collect()} == {tuple(x) for x in counts.collect()}
    assert recommend.generate(users, acts, vectors, T0, 3).groupBy("usuario_id").count().where("count > 3").isEmpty()


def test_latest_global_run(spark):
    rows = spark.createDataFrame([(1, 1, datetime(2024, 1, 1)), (2, 1, datetime(2024, 2, 1))], "usuario_id int, posicao int, data_geracao timestamp_ntz")
    assert recommend.for_user(rows, 1).count() == 0 and recommend.for_user(rows, 2).count() == 1


def test_embedding_sync(spark):
    contents = spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (3, "zero", "x"), (4, "e", "f")], "conteudo_id int, titulo string, descricao string")
    store = spark.createDataFrame([(3, [1.0, 1.0], "m", "old", T0), (4, [1.0, 0.0], "other", "old", T0)], "conteudo_id int, embedding array<double>, modelo string, texto_hash string, gerado_em timestamp_ntz")

    def embed(texts):
        return [[0.0, 0.0] if "zero" in t else [1.0, 2.0] for t in texts]

    made, counts = search.sync_embeddings(contents, store, embed, "m", 2, T0)
    assert sorted(r["conteudo_id"] for r in made.collect()) == [1, 2, 4]
    assert counts.first().asDict() == {"reutilizados": 0, "gerados": 3, "falhas": 1}
    again, counts = search.sync_embeddings(contents, made, embed, "m", 2, T0)
    assert counts.first().asDict() == {"reutilizados": 3, "gerados": 0, "falhas": 1}

    def broken(texts):
        raise RuntimeError

    failed, counts = search.sync_embeddings(contents, store, broken, "m", 2, T0)
    assert failed.count() == 0 and counts.first()["falhas"] == 4
    with pytest.raises(ValueError):
        search.top_k(made, [1.0, 0.0], 0)
    with pytest.warns(UserWarning):
        assert search.search(made.withColumn("modelo", F.lit("n")), "q", embed, "m", 2).count() == 2
    assert search.approximate_top_k(made, [1.0, 2.0], 1).count() == 1


def test_document_queries(spark):
    catalogue = spark.createDataFrame([(1, "SQL", "Curso", "Banco de Dados"), (2, "Py", "Curso", "Código")], "conteudo_id int, titulo string, tipo string, categoria string")
    rows = [(10, 1, 5, "x", ["sql", "bom"], date(2024, 1, 2)), (11, 1, 2, "y", ["sql"], date(2024, 1, 3)), (10, 2, 4, "z", ["py"], date(2024, 1, 4)), (10, 99, 4, "o", ["py"], date(2024, 1, 4))]
    comments = spark.createDataFrame(rows, "usuario_id int, conteudo_id int, avaliacao int, comentario string, tags array<string>, data date")
    docs, rejected = documents.enriched(comments, catalogue)
    assert rejected.count() == 1 and documents.with_tag(docs, "sql").count() == 2 and documents.rated(docs, 4).count() == 2 and documents.rated(docs, 1, 2).count() == 1
    r = documents.by_category(docs).where("categoria = 'Banco de Dados'").first()
    assert (r["total"], r["media"]) == (2, 3.5)
    assert {x["usuario_id"]: x["conteudos"] for x in documents.positive_sets(docs).collect()} == {10: [1, 2]}
    assert documents.of_content(docs, 1).first()["comentario"] == "y" and documents.tag_frequency(docs).first()["tag"] == "sql"


def test_classification_and_treatment(spark):
    rows = [("1", "Um", "Curso", "Básico", "30", "2024-01-05"), ("2", " ", "Curso", "Básico", "30", "2024-01-05"), ("0", "a", "X", "Y", "-1", "z"), ("3", "a", "Curso", "Básico", "1", "2024-1-1"), ("3", "b", "Curso", "Básico", "1", "2024-1-1")]
    df = spark.createDataFrame(rows, "conteudo_id string, titulo string, tipo string, nivel string, carga_horaria_min string, data_publicacao string")
    found = validation.classified(df, "catalogo", ["conteudo_id", "titulo"], ["conteudo_id"])
    got = sorted((r["conteudo_id"], r["situacao"], len(r["motivos"])) for r in found.collect())
    assert got == [("0", "invalido", 5), ("1", "valido", 0), ("2", "incompleto", 1), ("3", "duplicado", 1), ("3", "duplicado", 1)]
    assert validation.situation_counts(found).first().asDict() == {"valido": 1, "invalido": 1, "incompleto": 1, "duplicado": 2}
    assert validation.classified(df, "x", [], []).first()["situacao"] == "invalido"
    r = validation.treated(spark.createDataFrame([(" a ", "CURSO", "7")], "titulo string, tipo string, conteudo_id string"), "catalogo").first()
    assert (r["titulo"], r["tipo"], r["conteudo_id"], r["corrigido"]) == ("a", "Curso", 7, True)
    assert not validation.broken_keys(df, ["conteudo_id"]).isEmpty() and validation.violating(df, F.col("titulo") != " ").count() == 1


# Sums of ratings from 1 to 5 whose mean over 200 lies halfway between two hundredths.
HALFWAY = [s for s in range(200, 1001) if s % 2]


def test_action_list_rounds_means_as_its_sql(spark):
    low = F.floor(F.col("soma") / 200)
    rows = spark.createDataFrame([(f"CM-{s:06d}", s) for s in HALFWAY], "conteudo_mestre_id string, soma int")
    given = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(200)))).select(
        "conteudo_mestre_id", F.lit("u").alias("usuario_chave"), F.lit(T0).cast("timestamp_ntz").alias("data_hora"), (low + (F.col("i") <= F.col("soma") % 200).cast("int")).cast("int").alias("avaliacao_atribuida"),
    )
    dim = rows.select("conteudo_mestre_id", *[F.lit("x").alias(c) for c in ("titulo", "tipo", "categoria", "nivel")], F.lit(T0.date()).alias("data_publicacao"))
    comments = spark.createDataFrame([], "conteudo_mestre_id string, avaliacao int")
    found = {r["conteudo_mestre_id"]: r["nota_media"] for r in bi.action_list(dim, given, comments).collect()}
    want = duckdb.connect().execute("SELECT 'CM-' || lpad(CAST(s AS VARCHAR), 6, '0'), round(s / 200.0, 2) FROM range(200, 1001) t(s) WHERE s % 2 = 1").fetchall()
    assert found == dict(want)


def test_conversion_rows_round_means_once(spark):
    """30,001 hundredths over 20,001 rows: 0.01499975, which six digits make 0.015."""
    facts = spark.range(20_001).select(
        F.lit("CM-000001").alias("conteudo_mestre_id"), F.lit(True).alias("geracao_vigente"), F.lit(T0).cast("timestamp_ntz").alias("data_geracao"), F.lit(1).alias("posicao"), F.lit("Negativo").alias("status"),
        F.when(F.col("id") < 10_001, 0.01).otherwise(0.02).cast("decimal(5,2)").alias("pontuacao"), F.lit(True).alias("convertida"), F.lit(False).alias("concluida"),
    )
    dim = spark.createDataFrame([("CM-000001", "c", "Curso")], "conteudo_mestre_id string, categoria string, tipo string")
    row = bi.recommendation_conversion_rows(facts, dim).first()
    assert (row["recomendacoes"], row["pontuacao_media"]) == (20_001, 0.01)


def test_conversion_value_rounds_as_its_sql(spark):
    """41 of 4,000 are 1.025 %, a double that lies below it."""
    facts = spark.range(4000).select(F.lit(True).alias("geracao_vigente"), (F.col("id") < 41).alias("convertida"))
    want = duckdb.connect().execute("SELECT round(100.0 * count(*) FILTER (WHERE i < 41) / nullif(count(*), 0), 2) FROM range(4000) t(i)").fetchall()[0][0]
    assert bi.conversion_value(facts).first()[0] == want == 1.02
    assert bi.conversion_value(facts.where("NOT geracao_vigente")).first()[0] is None


def test_alert_and_metrics(spark):
    facts = spark.createDataFrame([(True, i < 3) for i in range(100)], "geracao_vigente boolean, convertida boolean")
    alert = bi.Alert()
    now = datetime(2024, 1, 1)
    assert [alert.check(facts, now), alert.check(facts, now + timedelta(hours=1)), alert.check(facts, now + timedelta(days=1))] == [True, False, True]
    rows = spark.createDataFrame([("2024-01", 1), ("2024-02", 3)], "m string, v int")
    assert [r["v_anterior"] for r in bi.with_previous(rows, "m", "v").orderBy("m").collect()] == [None, 1]
