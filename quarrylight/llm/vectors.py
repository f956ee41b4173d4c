"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its DESCRIBED nearest reference points, nearest first, and stands in the
inverted lists of the first LISTED of them.  Vectors that meet in a list are candidates if they share
at least SHARED described points or if one is nearest to the list's point, and verified by their cosine
in double precision.  A pair that meets in more than one list is counted in the list of its least common
listed point.  Reference points keep apart, so that a large group of near copies has one or few of them
and meets there.  A vector whose nearest point is nearest for all that can link with it stands in that
list only.  Identical vectors of a label are one node of the index.  A long list is cut in blocks and each
pair of blocks is a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.components import connected_components, local_roots
from quarrylight.llm.runtime import written

THRESHOLD = 0.98
DESCRIBED, LISTED, SHARED = 12, 6, 2
MAX_PIVOTS = 16_384  # reference points at most; about 4 sqrt(n), a sample of the rows
APART = 0.9  # cosine that two sampled reference points stay below
BLOCK = 1024

def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def points_apart(points: np.ndarray) -> np.ndarray:
    """The points without those too close to an earlier one that stays."""
    left, keep = np.ones(len(points), bool), []
    for k in range(len(points)):
        if left[k]:
            keep.append(k)
            left &= points @ points[k] < APART
    return points[keep]


def lists_of(near: np.ndarray, threshold: float) -> np.ndarray:
    """In how many lists a vector stands, by its cosines with its nearest points, nearest first.

    One, where no vector within the threshold can be as near to another point: the plane between two
    points is then farther off than the longest chord of a link.  Their distance is at most the sum of
    the vector's distances to both, and of all other points the second one comes closest to that plane.
    """
    lists = np.full(len(near), min(LISTED, near.shape[1]), np.int32)
    if near.shape[1] > 1:
        chord = lambda cosine: np.sqrt(np.maximum(2 - 2 * cosine, 0))
        a, b = near[:, 0], near[:, 1]
        lists[(b < threshold) & (a - b > chord(threshold) * (chord(a) + chord(b)) + 1e-9)] = 1
    return lists


def reference_points(dim: int, sampled: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Sampled rows of this length, or fixed random directions where the sample has none."""
    found = sampled.get(dim)
    if found is not None:
        return found
    return _unit(np.random.default_rng(dim).standard_normal((max(n, DESCRIBED), dim)))


def usable(vector: str) -> F.Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def link_table(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of (row, label, vector) rows: (row, node) and, by node, weight, links and edges."""
    nodes = rows.groupBy("label", "vector").agg(F.min("row").alias("node"), F.count("*").alias("weight"))
    nodes = written(nodes, "nodes")
    label_type = nodes.schema["label"].dataType.simpleString()
    members = rows.join(nodes.select("label", "vector", "node"), ["label", "vector"]).select("row", "node")
    n = nodes.count()
    n_pivots = int(min(MAX_PIVOTS, max(64, 4 * n**0.5)))
    share = min(1.0, 1.2 * n_pivots / max(n, 1))
    chance = F.pmod(F.xxhash64("vector", F.lit(3)), F.lit(1_000_000_000))
    sample = nodes.where(chance < int(1_000_000_000 * share)).select("vector").distinct().orderBy(chance, "vector").limit(2 * MAX_PIVOTS).toArrow()
    by_dim: dict[int, list[np.ndarray]] = {}
    for v in sample["vector"].to_pylist():
        by_dim.setdefault(len(v), []).append(np.array(v, np.float64))
    sampled = {dim: points_apart(_unit(np.stack(sorted(x, key=lambda v: v.tolist()))[:MAX_PIVOTS])) for dim, x in by_dim.items() if len(x) >= DESCRIBED}
    shared = rows.sparkSession.sparkContext.broadcast(sampled)  # 2 * MAX_PIVOTS vectors at most

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(3))
            for dim in np.unique(dims):
                mine = batch.take(pa.array(np.flatnonzero(dims == dim)))
                points = reference_points(int(dim), shared.value, n_pivots)
                for k in range(0, len(mine), 2048):
                    part = mine.slice(k, 2048)
                    near = -(_unit(_matrix(part.column(4), int(dim))) @ points.T)
                    top = np.argpartition(near, DESCRIBED - 1, axis=1)[:, :DESCRIBED] if near.shape[1] > DESCRIBED else np.tile(np.arange(near.shape[1]), (len(part), 1))
                    order = np.lexsort((top, np.take_along_axis(near, top, 1)), axis=1)
                    top = np.take_along_axis(top, order, 1).astype(np.int32)
                    lists = lists_of(-np.take_along_axis(near, top, 1), threshold)
                    pivots = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, top.shape[1], dtype=np.int32)), pa.array(top.ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns, pivots, pa.array(lists)], names=["node", "weight", "label", "dim", "vector", "pivots", "lists"])

    described = nodes.select("node", "weight", "label", F.size("vector").alias("dim"), "vector").mapInArrow(describe, f"node long, weight long, label {label_type}, dim int, vector array<double>, pivots array<int>, lists int")
    described = written(described, "described")
    listed = described.select("node", "label", "dim", F.explode(F.slice("pivots", F.lit(1), F.col("lists"))).alias("pivot"))
    sizes = listed.groupBy("label", "dim", "pivot").agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(sizes, "lists")
    placed = described.withColumn("pivot", F.explode(F.slice("pivots", F.lit(1), F.col("lists")))).join(sizes, ["label", "dim", "pivot"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("label", "dim", "pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "weight", "vector", "pivots", "lists")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("node")
        dim, pivot, i, j = (group[c][0].as_py() for c in ("dim", "pivot", "i", "j"))
        node, weight, own = (np.asarray(group[c]) for c in ("node", "weight", "own"))
        x = _unit(_matrix(group["vector"].chunk(0), dim))
        pivots = np.asarray(group["pivots"].chunk(0).flatten()).reshape(len(node), -1)
        names, code, count = np.unique(pivots, return_inverse=True, return_counts=True)
        code, names = (np.cumsum(count > 1) - 1)[code.reshape(pivots.shape)], names[count > 1]  # points that some vectors share
        at, place = np.nonzero(np.isin(pivots, names))
        has, first = np.zeros((len(node), len(names)), np.float32), np.zeros((len(node), len(names)), np.float32)
        has[at, code[at, place]] = 1
        own_list = place < np.asarray(group["lists"])[at]
        first[at[own_list], code[at, place][own_list]] = 1
        nearest = pivots[:, 0] == pivot
        below = first[:, names < pivot]  # listed points that would take the pair
        links, ends = np.zeros(len(node), np.int64), []
        for k in range(0, len(node), 256):
            rows = slice(k, k + 256)
            near = ((has[rows] @ has.T >= SHARED) | nearest[rows, None] | nearest) & (below[rows] @ below.T == 0)
            near &= (np.arange(len(node))[rows, None] < np.arange(len(node))) & ((i == j) | (own[rows, None] != own))
            a, b = np.nonzero(near)
            sure = (x[rows] @ x.T)[a, b] >= threshold
            a, b = a[sure] + k, b[sure]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            ends.append((a, b))
        root = local_roots(len(node), np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends]))
        some = links > 0
        return pa.table({"node": node[some], "links": links[some], "root": node[root[some]]})

    linked = placed.groupBy("label", "dim", "pivot", "i", "j").applyInArrow(compare, "node long, links long, root long")
    return members, written(linked, "linked")


def near_duplicate_vectors(frame: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each row of ``frame``: id, n_links, component_id and kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label,
    link with nothing.  Identical vectors of a label link; lengths that differ don't.  Labels may be of any
    type that can be compared.  Of points that are equally near the one of least number comes first.  Equal ids
    are rows of their own, a component bears its least id; a null id is its own component unless linked, and
    an empty table gives no rows.  Finite components of any size are compared, the largest scaled to 1.
    """
    rows = frame.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = written(rows.withColumn("ok", usable("vector") & F.col("label").isNotNull()), "vectors")
    members, linked = link_table(rows.where("ok").select("row", "label", "vector"), threshold)
    members = written(members, "members")
    weights = members.groupBy("node").agg(F.count("*").alias("weight"))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    about = weights.join(links, "node", "left").join(roots, "node", "left").select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    own = rows.select("row", "id").join(members, "row", "left").join(about, "node", "left").withColumn("root", F.coalesce("root", "row"))
    own = written(own.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root"), "own")
    least = own.groupBy("root").agg(F.min("id").alias("component_id"))
    out = own.join(least, "root").select(F.col("id").alias(id_column), "n_links", "component_id")
    return out.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
"""
