"""Recommendations from mean embeddings of what users saw and liked; all users in one job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions.scalars import COMPLETION, LIKE, clamped, cosine_distance
from quarrylight.session import ship, written

# What counts as a view, and the names of statuses.
VIEWS = ("visualização",)
POSITIVE, STABLE, NEGATIVE = "Positivo", "Estável", "Negativo"


def mean_vectors(df: DataFrame, key: list[str], vector: str = "embedding") -> DataFrame:
    """Element-wise mean of the vectors of a key: partial sums by element, put together in order."""
    parts = df.select(*key, F.posexplode(vector).alias("pos", "x")).groupBy(*key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vetor"))


def liked_pairs(interactions: DataFrame, positive: DataFrame | None = None, minimum: float = 4) -> DataFrame:
    """Distinct (usuario_id, conteudo_id) liked, rated at least ``minimum``, or positive in the comments."""
    liked = interactions.where((F.col("tipo_interacao") == LIKE) | (F.col("avaliacao_atribuida") >= minimum)).select("usuario_id", "conteudo_id")
    return (liked if positive is None else liked.unionByName(positive.select("usuario_id", "conteudo_id"))).distinct()


def profiles(interactions: DataFrame, embeddings: DataFrame, positive: DataFrame | None = None, minimum: float = 4, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """(usuario_id, vis, cur): what a user saw, repeats weigh, and what they liked, once each."""
    e = embeddings.select("conteudo_id", "embedding")
    seen = mean_vectors(interactions.where(F.col("tipo_interacao").isin(*views)).select("usuario_id", "conteudo_id").join(e, "conteudo_id"), ["usuario_id"])
    liked = mean_vectors(liked_pairs(interactions, positive, minimum).join(e, "conteudo_id"), ["usuario_id"])
    return seen.select("usuario_id", F.col("vetor").alias("vis")).join(liked.select("usuario_id", F.col("vetor").alias("cur")), "usuario_id", "full_outer")


def similarities(users: DataFrame, interactions: DataFrame, embeddings: DataFrame, positive: DataFrame | None = None, minimum: float = 4, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """Every user with every content: similarities and whether not completed.  For few users; ``over_blocks`` is for all."""
    known = users.select("usuario_id").distinct().join(profiles(interactions, embeddings, positive, minimum, views), "usuario_id", "left")
    done = interactions.where((F.col("tipo_interacao") == COMPLETION) | (F.col("percentual_conclusao") >= 100)).select("usuario_id", "conteudo_id", F.lit(True).alias("feito")).distinct()
    pairs = known.crossJoin(embeddings.select("conteudo_id", "embedding"))
    like = lambda p: F.coalesce(1 - cosine_distance("embedding", p), F.lit(0.0))
    pairs = pairs.select("usuario_id", "conteudo_id", like("vis").alias("similaridade_vis"), like("cur").alias("similaridade_cur"))
    return pairs.join(done, ["usuario_id", "conteudo_id"], "left").select("usuario_id", "conteudo_id", "similaridade_vis", "similaridade_cur", F.col("feito").isNull().alias("nao_concluido"))


def min_max(c: str, key: str = "usuario_id") -> Column:
    """To 0..1 within a user over all candidates; constant values give 0."""
    w = W.partitionBy(key)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0)


def status(score: Column, done: Column, negative: float, positive: float) -> Column:
    return F.when((done == 0) | (score <= negative), NEGATIVE).when(score >= positive, POSITIVE).otherwise(STABLE)


def scored(candidates: DataFrame, negative: float = 40, positive: float = 70, normalise: bool = True) -> DataFrame:
    """Indices, score and status.  The score uses unrounded indices; stored ones have four digits."""
    df = candidates.withColumns({"v": clamped("similaridade_vis"), "c": clamped("similaridade_cur"), "i_conc": F.col("nao_concluido").cast("double")})
    if normalise:
        df = df.withColumns({"v": min_max("v"), "c": min_max("c")})
    score = F.round((F.col("v") + F.col("c")) / 2 * 100 * F.col("i_conc"), 2)
    df = df.withColumn("pontuacao", score)
    return df.select("usuario_id", "conteudo_id", "pontuacao", F.round("v", 4).alias("i_vis"), F.round("c", 4).alias("i_cur"), "i_conc", status(F.col("pontuacao"), F.col("i_conc"), negative, positive).alias("status"))


def top_n(results: DataFrame, n: int = 10) -> DataFrame:
    """The best ``n`` a user that aren't negative; ties by content id."""
    place = F.row_number().over(W.partitionBy("usuario_id").orderBy(F.desc("pontuacao"), "conteudo_id"))
    return results.where(F.col("status") != NEGATIVE).withColumn("posicao", place).where(F.col("posicao") <= n)


BLOCK_BYTES = 32 << 20  # of content vectors that a task holds at a time


def content_blocks(embeddings: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of the contents, in blocks of bounded size; a zero vector stays zero."""
    ids, rows = [], []

    def block() -> tuple[np.ndarray, np.ndarray]:
        x = np.array(rows, np.float64)
        size = np.sqrt((x * x).sum(1, keepdims=True))
        return np.array(ids), x / np.where(size > 0, size, 1.0)

    for r in embeddings.select("conteudo_id", "embedding").toLocalIterator():
        ids.append(r["conteudo_id"])
        rows.append(r["embedding"])
        if len(rows) * len(rows[0]) * 8 >= block_bytes:
            yield block()
            ids, rows = [], []
    if rows:
        yield block()


def _likeness(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Clamped cosines of the users' profiles with a block; 0 without a profile."""
    out = np.zeros((len(column), len(vectors)))
    have = np.flatnonzero(np.asarray(column.is_valid()))
    if len(have):
        x = np.asarray(column.drop_null().flatten(), np.float64).reshape(len(have), -1)
        size = np.sqrt((x * x).sum(1, keepdims=True))
        out[have] = np.clip(x / np.where(size > 0, size, 1.0) @ vectors.T, 0.0, 1.0)
    return out


def _widen(batch: pa.RecordBatch, ids: np.ndarray, vectors: np.ndarray, n: int, negative: float, positive: float) -> pa.RecordBatch:
    """Users' ranges of similarities, over one more block."""
    both = [_likeness(batch.column(c), vectors) for c in (1, 2)]
    low = np.minimum(np.asarray(batch.column(4).flatten()).reshape(-1, 2), np.stack([x.min(1) for x in both], 1))
    high = np.maximum(np.asarray(batch.column(5).flatten()).reshape(-1, 2), np.stack([x.max(1) for x in both], 1))
    ends = pa.array(np.arange(0, 2 * len(batch) + 1, 2, dtype=np.int32))
    pair = lambda x: pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([*batch.columns[:4], pair(low), pair(high), *batch.columns[6:]], names=batch.schema.names)


def _score(batch: pa.RecordBatch, ids: np.ndarray, vectors: np.ndarray, n: int, negative: float, positive: float) -> pa.RecordBatch:
    """Users' best contents and numbers of contents by status, over one more block."""
    low, high = (np.asarray(batch.column(c).flatten()).reshape(-1, 2) for c in (4, 5))
    width = high - low
    v, c = ((_likeness(batch.column(k + 1), vectors) - low[:, k : k + 1]) / np.where(width[:, k : k + 1] > 0, width[:, k : k + 1], 1.0) * (width[:, k : k + 1] > 0) for k in (0, 1))
    score = np.floor((v + c) / 2 * 100 * 100 + 0.5 + 1e-9) / 100
    kept, counts = [], np.asarray(batch.column(7).flatten()).reshape(-1, 3).copy()
    for r, (done, old) in enumerate(zip(batch.column(3), batch.column(6))):
        open_ = ~np.isin(ids, np.array(done.as_py(), ids.dtype))
        good = np.flatnonzero((score[r] > negative) & open_)
        high_ = int((score[r, good] >= positive).sum())
        counts[r] += (high_, len(good) - high_, len(ids) - len(good))
        top = good[np.lexsort((ids[good], -score[r, good]))[:n]]
        new = [{"pontuacao": float(score[r, k]), "conteudo_id": int(ids[k]), "i_vis": float(v[r, k]), "i_cur": float(c[r, k])} for k in top]
        kept.append(sorted([*old.as_py(), *new], key=lambda x: (-x["pontuacao"], x["conteudo_id"]))[:n])
    ends = pa.array(np.arange(0, 3 * len(batch) + 1, 3, dtype=np.int32))
    return pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(kept, batch.schema.field(6).type), pa.ListArray.from_arrays(ends, pa.array(counts.ravel()))], names=batch.schema.names)


def over_blocks(users: DataFrame, interactions: DataFrame, embeddings: DataFrame, n: int = 10, positive_pairs: DataFrame | None = None, negative: float = 40, positive: float = 70, minimum: float = 4, views: tuple[str, ...] = VIEWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row a user: ``melhores``, the best ``n`` contents, and ``contagem``, how many are positive, stable and negative.

    Users' rows pass over the blocks of contents twice: for the ranges that scores are scaled by, and
    for the scores.  What is kept of a user doesn't grow with the contents.  Each further block is a pass of its
    own over the written rows, so that driver and tasks hold two blocks at most.
    """
    done = interactions.where((F.col("tipo_interacao") == COMPLETION) | (F.col("percentual_conclusao") >= 100)).groupBy("usuario_id").agg(F.collect_set("conteudo_id").alias("feitos"))
    state = users.select("usuario_id").distinct().join(profiles(interactions, embeddings, positive_pairs, minimum, views), "usuario_id", "left").join(done, "usuario_id", "left")
    lows, highs = F.array(F.lit(2.0), F.lit(2.0)), F.array(F.lit(-1.0), F.lit(-1.0))
    none = F.array().cast("array<struct<pontuacao:double,conteudo_id:int,i_vis:double,i_cur:double>>")
    state = state.select(
        "usuario_id", "vis", "cur", F.coalesce("feitos", F.array().cast("array<int>")).alias("feitos"), lows.alias("menor"), highs.alias("maior"), none.alias("melhores"),
        F.array(*[F.lit(0).cast("long")] * 3).alias("contagem"),
    )
    spark, schema, held = users.sparkSession, state.schema, []
    ship(spark)
    for step in (_widen, _score):
        for k, block in enumerate(content_blocks(embeddings, block_bytes)):
            if k:
                state = written(state, "recomendador")
                while held:
                    held.pop().destroy()
            held.append(spark.sparkContext.broadcast(block))  # block_bytes of vectors

            def run(batches: Iterator[pa.RecordBatch], shared=held[-1], step=step) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for at in range(0, len(batch), 512):
                        yield step(batch.slice(at, 512), *shared.value, n, negative, positive)

            state = state.mapInArrow(run, schema)
    return state.select("usuario_id", "melhores", "contagem")


def best_of_blocks(users: DataFrame, interactions: DataFrame, embeddings: DataFrame, n: int = 10, positive_pairs: DataFrame | None = None, negative: float = 40, positive: float = 70, minimum: float = 4, views: tuple[str, ...] = VIEWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What ``top_n(scored(similarities(...)))`` gives, without a row for each user and content."""
    state = over_blocks(users, interactions, embeddings, n, positive_pairs, negative, positive, minimum, views, block_bytes)
    rows = state.select("usuario_id", F.posexplode("melhores").alias("at", "m"))
    return rows.select(
        "usuario_id", F.col("m.conteudo_id").alias("conteudo_id"), F.col("m.pontuacao").alias("pontuacao"), F.round("m.i_vis", 4).alias("i_vis"), F.round("m.i_cur", 4).alias("i_cur"), F.lit(1.0).alias("i_conc"),
        status(F.col("m.pontuacao"), F.lit(1.0), negative, positive).alias("status"), (F.col("at") + 1).cast("int").alias("posicao"),
    )


def status_counts(users: DataFrame, interactions: DataFrame, embeddings: DataFrame, positive_pairs: DataFrame | None = None, negative: float = 40, positive: float = 70, minimum: float = 4, views: tuple[str, ...] = VIEWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(usuario_id, status, conteudos) of ``scored(similarities(...))``, without a row for each user and content."""
    state = over_blocks(users, interactions, embeddings, 0, positive_pairs, negative, positive, minimum, views, block_bytes)
    named = F.map_from_arrays(F.array(*map(F.lit, (POSITIVE, STABLE, NEGATIVE))), "contagem")
    return state.select("usuario_id", F.explode(named).alias("status", "conteudos")).where("conteudos > 0")


def generate(users: DataFrame, interactions: DataFrame, embeddings: DataFrame, at, n: int = 10, positive_pairs: DataFrame | None = None, negative: float = 40, positive: float = 70) -> DataFrame:
    """Recommendations of all users with one generation time."""
    return best_of_blocks(users, interactions, embeddings, n, positive_pairs, negative, positive).withColumn("data_geracao", F.lit(at).cast("timestamp_ntz"))


def latest_run(recommendations: DataFrame) -> DataFrame:
    """Rows of the latest generation of all users; a user without one there has none."""
    last = recommendations.agg(F.max("data_geracao").alias("ultima"))
    return recommendations.crossJoin(F.broadcast(last)).where(F.col("data_geracao") == F.col("ultima")).drop("ultima")


def for_user(recommendations: DataFrame, user: int) -> DataFrame:
    return latest_run(recommendations).where(F.col("usuario_id") == user).orderBy("posicao")
