"""The pipeline against plain versions of its stages, and the registered queries."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarrylight.llm import surrogates
from quarrylight.llm.textbytes import words_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"


def test_names():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "deduplicate", "decontaminate", "pseudonymise", "pack"]
    assert set(entry.oracle_sql()) <= set(names)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in seen["quality"] for d in clean) >= 0.95 * len(clean)
    grams = {}
    for d, t in seen["quality"].items():
        w = words_of(t)
        grams[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in grams}
    ids = sorted(grams)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) - 1e-9]
    for _ in near:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert set(seen["deduplicate"]) == set(root.values())
    windows = set()
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = words_of(r["text"])
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    held = lambda t: any(tuple(words_of(t)[k : k + 10]) in windows for k in range(len(words_of(t))))
    dirty = {d for d, t in seen["deduplicate"].items() if held(t)}
    assert dirty and not any(held(t) for t in seen["decontaminate"].values())
    assert all(seen["decontaminate"][d] == t for d, t in seen["deduplicate"].items() if d not in dirty)
    for d, t in seen["decontaminate"].items():
        new = seen["pseudonymise"][d]
        found = surrogates.detect(t)
        assert (new == t) == (not found) and not any(t[a:b] in new for a, b, _, _ in found)
    pieces = corpus_pipeline.pack(spark, docs, DIR).collect()
    fill = defaultdict(int)
    for r in pieces:
        fill[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in pieces} == set(seen["pseudonymise"]) and max(fill.values()) <= 2048
    whole = corpus_pipeline.run(spark, DIR)
    assert whole.agg(F.count("*"), F.sum("length")).first() == (len(pieces), sum(r["length"] for r in pieces))


LABELS, ITEMS = "doc_id long, quality int, toxic int", "item_id long, text string"
BASE = ["doc_id", "text", "lang", "source", "n_chars"]


def folder(spark, path, docs, labels, items):
    """Tables of a folder; documents as files, as the stages get them."""
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_on_odd_tables(spark, tmp_path, odd_docs):
    d = folder(spark, tmp_path, odd_docs, [(1, 1, 0), (1, 1, 0), (2, 1, 0), (5, 0, 0), (6, None, 0), (7, 0, 1), (None, 1, 0), (404, 0, 0)], [(1, "the lazy dog and runs far away from here today"), (2, None), (None, ""), (3, "Released under the MIT License.")])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = sorted(map(str, docs.select(*BASE).collect()))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, d)
    assert kept.columns == BASE and set(map(str, kept.collect())) <= set(rows)
    left = stages["deduplicate"](spark, docs, d)
    assert left.columns == BASE
    # of near copies the first by id stays, and every text without words
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([1, 3, 4, 5, 7, 8, 9, -3, None])
    cut = stages["decontaminate"](spark, docs, d)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    assert cut.columns == BASE and cut.where("doc_id = 1").count() == 2 and "lazy dog" not in got[1][0] and got[1][1] == len(got[1][0])
    assert 9 not in got and got[3] == (None, None) and got[4] == ("", 0) and got[5][1] == len(got[5][0])
    new = stages["pseudonymise"](spark, docs, d)
    assert new.columns == BASE and sorted(r["text"] or "" for r in new.collect()) == sorted(r["text"] or "" for r in docs.collect())
    packed = stages["pack"](spark, docs, d)
    assert packed.where("piece = 0").count() == docs.count()


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(k, 0, 0) for k in range(9)], [(k, None, None) for k in range(9)]])
def test_quality_without_both_classes(spark, tmp_path, odd_docs, labels):
    d = folder(spark, tmp_path, odd_docs, labels, [])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, d).collect()
    assert len(kept) == docs.count()  # nothing tells good from bad


def test_empty_tables(spark, tmp_path, no_docs):
    d = folder(spark, tmp_path, no_docs, [], [])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        assert out.count() == 0 and (name == "pack" or out.columns == BASE)
    assert corpus_pipeline.run(spark, d).count() == 0
