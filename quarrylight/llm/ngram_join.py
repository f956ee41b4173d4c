"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Texts with the same words are one class.  Bands and rows are chosen for the target recall at the
threshold; classes that share a band hash meet in its bucket, and buckets of the same members count
once.  In a bucket, pairs are first held against each other by their signatures, one byte of each
MinHash value: pairs whose estimate lies SLACK standard errors below the threshold part, so that texts
with a common part, such as a page frame, don't chain to large groups.  What stays connected is a group,
and every pair inside a group is verified on the full n-gram sets, so the result also holds
links that banding alone would have missed.  Large buckets and groups are cut in blocks and each pair
of blocks is a task; tasks return a spanning forest and link counts, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.components import connected_components, local_roots
from quarrylight.llm.runtime import written
from quarrylight.llm.textbytes import TextSlice, find_words, mix, span_hashes, text_slices

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
ROWS = 8
SLACK = 5.0
BUCKET_TEXTS = 4096
BLOCK_TEXTS, BLOCK_GRAMS = 1024, 500_000

_STEP = np.uint64(0xD6E8FEB86659FD93)


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` values that two sets at the threshold share at least one of, with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def gram_hashes(piece: TextSlice, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """N-gram hashes of all rows, where each row's begin, and two hashes of each row's words.

    A text of fewer words than ``n``, but not none, is one n-gram; repeated n-grams repeat here.
    """
    words = find_words(piece)
    h = span_hashes(piece.data, words.starts, words.ends)
    sizes = np.diff(words.first)
    counts = np.where(sizes > 0, np.maximum(sizes - n + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(words.first[:-1] - first[:-1], counts) + np.arange(first[-1])
    stop = np.repeat(words.first[1:], counts)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    grams = np.zeros(first[-1], np.uint64)
    for k in range(n):
        grams = grams * _STEP + np.where(at + k < stop, padded[at + k], np.uint64(k + 1))
    grams = mix(grams)
    sums = np.zeros((2, len(piece)), np.uint64)
    some = sizes > 0
    if some.any():
        place = (np.arange(len(h)) - np.repeat(words.first[:-1], sizes)).astype(np.uint64)
        for k in range(2):
            sums[k, some] = np.add.reduceat(mix(h ^ mix(place * np.uint64(2) + np.uint64(k))), words.first[:-1][some])
    return grams, first, sizes, sums


def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)


def band_hashes(grams: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each text with n-grams and band."""
    return signatures(grams, first, bands, rows)[0]


def signatures(grams: np.ndarray, first: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text with n-grams, a hash for each band and the low byte of each MinHash value."""
    starts = first[:-1][np.diff(first) > 0]
    low, high = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    times, plus = _multipliers(bands * rows)
    out, marks = np.zeros((len(starts), bands), np.uint64), np.zeros((len(starts), bands * rows), np.uint8)
    value = np.empty(len(grams), np.uint32)
    for k in range(bands * rows):
        np.multiply(low if k % 2 else high, times[k], out=value)
        value ^= plus[k]
        least = np.minimum.reduceat(value, starts)
        marks[:, k] = (mix(least.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
        b = k // rows
        out[:, b] = out[:, b] * _STEP + least
        if k % rows == rows - 1:
            out[:, b] = mix(out[:, b] + np.uint64(b))
    return out, marks


def equal_marks(threshold: float, marks: int) -> int:
    """So many of ``marks`` values are equal for two sets at the threshold, less SLACK standard errors."""
    return max(1, math.floor(marks * threshold - SLACK * math.sqrt(marks * threshold * (1 - threshold))))


def alike_roots(marks: np.ndarray, least: int) -> np.ndarray:
    """A member of each row's group: rows of one group are chained by ``least`` equal values."""
    root, open_ = np.arange(len(marks)), np.arange(len(marks))
    left = marks
    while len(open_):
        lead = open_[0]
        open_, left, ahead = open_[1:], left[1:], [lead]
        while ahead and len(open_):
            near = np.count_nonzero(left == marks[ahead.pop()], axis=1) >= least
            if near.any():
                new = open_[near]
                root[new] = lead
                ahead.extend(new.tolist())
                open_, left = open_[~near], left[~near]
    return root


def intersections(own: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of two lists of sorted distinct sets."""
    sets = own + other
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sizes.sum() else np.zeros(0, np.uint64)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    keep = count[code] > 1
    code, row = np.unique(code[keep], return_inverse=True)[1], row[keep]
    out = np.zeros((len(own), len(other)), np.float32)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    width = max(256, min(4096, (4 << 20) // max(1, len(sets))))
    for begin in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, (begin, begin + width))
        has = np.zeros((len(sets), min(width, int(code[-1]) + 1 - begin)), np.float32)
        has[row[a:b], code[a:b] - begin] = 1
        out += has[: len(own)] @ has[len(own) :].T
    return out.astype(np.int64)


def similar_pairs(own: list[np.ndarray], other: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    both = intersections(own, other)
    union = np.array([len(s) for s in own])[:, None] + np.array([len(s) for s in other]) - both
    return np.nonzero(both >= threshold * union - 1e-9)


def find_links(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, id_column: str = "doc_id") -> DataFrame:
    """(row, id, node, root, n_links) of each row: its class, the class's group of linked texts, its links.

    ``row`` is the row's monotonically_increasing_id in ``docs``, whose plan must read the same rows in
    the same partitions each time, as a table scan does.  A text without words links with nothing.
    """
    bands = bands_for(threshold, recall, rows)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col("text").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch.column(2)):
                grams, first, sizes, sums = gram_hashes(piece, n)
                some = sizes > 0
                hashes, marks = signatures(grams, first, bands, rows)
                hashes = hashes.view(np.int64)
                mark_ends = np.concatenate([[0], np.cumsum(some * (bands * rows))]).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                own = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_pydict({"row": own.column(0), "id": own.column(1), "n_words": pa.array(sizes.astype(np.int64)), "k1": pa.array(sums[0].view(np.int64)), "k2": pa.array(sums[1].view(np.int64)), "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.ravel())), "marks": pa.Array.from_buffers(pa.binary(), len(piece), [None, pa.py_buffer(mark_ends), pa.py_buffer(marks.tobytes())])})

    signed = written(texts.mapInArrow(sign, f"row long, id {id_type}, n_words long, k1 long, k2 long, bands array<long>, marks binary"), "signed")
    classes = signed.where("n_words > 0").groupBy("k1", "k2", "n_words").agg(F.min(F.struct("row", "bands", "marks")).alias("first"), F.count("*").alias("weight"))
    classes = written(classes.select("k1", "k2", F.col("first.row").alias("node"), "n_words", "weight", F.col("first.bands").alias("bands"), F.col("first.marks").alias("marks")), "classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    who = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), who(1).alias("x"), who(2).alias("y")).where("n > 1")
    buckets = written(buckets.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", "n"), "buckets")
    total = buckets.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = max(1, -(-total // (8 * BUCKET_TEXTS)))
    met = banded.join(buckets.withColumn("blocks", F.ceil(F.col("n") / BUCKET_TEXTS).cast("int")).drop("n"), "band").join(classes.select("node", "marks"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a block meets all others of its bucket, and alone only where there are none
    met = met.withColumn("own", own).withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: (k != F.col("own")) | (F.col("blocks") == 1))))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("band"), F.lit(parts))).otherwise(F.col("band"))
    met = met.select((F.col("blocks") == 1).alias("small"), task.alias("task"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", "node", "marks")
    least_marks = equal_marks(threshold, bands * rows)

    def part(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        band, node = np.asarray(group["band"]), np.asarray(group["node"])
        order = np.lexsort((node, band))
        marks = np.frombuffer(b"".join(group["marks"].to_pylist()), np.uint8).reshape(len(node), -1)
        band, node, root = band[order], node[order], np.arange(len(node))
        bounds = np.concatenate([[0], np.flatnonzero(band[1:] != band[:-1]) + 1, [len(band)]])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            root[a:b] = a + alike_roots(marks[order[a:b]], least_marks)
        some = root != np.arange(len(root))
        return pa.table({"a": node[root[some]], "b": node[some]})

    edges = met.groupBy("small", "task", "i", "j").applyInArrow(part, "a long, b long")
    groups = written(connected_components(edges), "groups")

    sizes = groups.join(classes.select("node", "n_words", "weight"), "node")
    sizes = written(sizes, "members")
    total = sizes.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    parts = max(1, -(-total // BLOCK_GRAMS))
    about = sizes.groupBy("root").agg(F.count("*").alias("m"), F.sum("n_words").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_TEXTS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    placed = sizes.join(about.select("root", blocks.alias("blocks")), "root").select(F.col("node").alias("row"), "root", "weight", "blocks")
    # the same plan at every size: texts of groups are a share of the corpus and never broadcast
    placed = texts.select("row", "text").join(placed.hint("merge"), "row")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch.column(1)):
                grams, first, _, _ = gram_hashes(piece, n)
                sets = [np.unique(grams[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                own = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_pydict({"node": own.column(0), "root": own.column(2), "weight": own.column(3), "blocks": own.column(4), "grams": pa.array(sets, pa.binary())})

    sets = placed.mapInArrow(shingle, "node long, root long, weight long, blocks int, grams binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sets = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # small groups share a task with others; a large one has a task for each pair of blocks
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(parts))).otherwise(F.col("root"))
    sets = sets.select((F.col("blocks") == 1).alias("small"), task.alias("task"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "root", "own", "node", "weight", "grams")

    def verify(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("root", "ascending"), ("own", "ascending"), ("node", "ascending")])
        root, own, node, weight = (np.asarray(group[c]) for c in ("root", "own", "node", "weight"))
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["grams"]]
        links, near = np.zeros(len(node), np.int64), np.arange(len(node))
        bounds = np.concatenate([[0], np.flatnonzero(root[1:] != root[:-1]) + 1, [len(root)]])
        same = group["i"][0].as_py() == group["j"][0].as_py()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            cut = b if same else a + int((own[a:b] == own[a]).sum())
            left, right = np.arange(a, cut), np.arange(a if same else cut, b)
            x, y = similar_pairs([raw[k] for k in left], [raw[k] for k in right], threshold)
            x, y = left[x], right[y]
            if same:
                x, y = x[x < y], y[x < y]
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            near[a:b] = a + local_roots(b - a, x - a, y - a)
        some = links > 0
        return pa.table({"node": node[some], "links": links[some], "near": node[near[some]]})

    found = sets.groupBy("small", "task", "i", "j").applyInArrow(verify, "node long, links long, near long")
    found = written(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("near").alias("b")))
    nodes = classes.select("k1", "k2", "n_words", "node", "weight").join(links, "node", "left").join(roots, "node", "left")
    nodes = nodes.select("k1", "k2", "n_words", "node", F.coalesce("root", "node").alias("root"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows_ = signed.select("row", "id", "n_words", "k1", "k2").join(nodes, ["k1", "k2", "n_words"], "left")
    return written(rows_.select("row", "id", F.coalesce("node", "row").alias("node"), F.coalesce("root", "row").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "joined")


def _first_of_groups(found: DataFrame) -> DataFrame:
    return found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))


def near_duplicate_texts(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """id, class_id (the least id of the linked group), n_links (rows linked directly) and kept, for each row.

    Null and empty texts link with nothing.  Rows with equal ids are rows of their own; of a group the
    row that comes first by id is kept.  A null id comes last and, alone, is its own class, with a null id.
    """
    found = find_links(docs, id_column=id_column, **options)
    out = found.join(written(_first_of_groups(found), "firsts"), "root")  # written, so that the join can split a large group
    return out.select(F.col("id").alias(id_column), F.col("first.id").alias("class_id"), "n_links", (F.col("row") == F.col("first.row")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each group left, the first by id."""
    found = find_links(docs, id_column=id_column, **options)
    kept = _first_of_groups(found).select(F.col("first.row").alias("the_row"))
    return docs.withColumn("the_row", F.monotonically_increasing_id()).join(kept.hint("merge"), "the_row", "left_semi").select(*[f"`{c}`" for c in docs.columns])


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, array_to_string(w[i:i + {NGRAM - 1}], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {NGRAM - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
both_in AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.rid <> b.rid GROUP BY 1, 2),
link AS (SELECT a, b FROM both_in JOIN n x ON a = x.rid JOIN n y ON b = y.rid WHERE k >= {THRESHOLD} * (x.n + y.n - k) - 1e-9),
reach(a, b) AS (SELECT rid, rid FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS rid, min(x.doc_id) AS class_id FROM reach JOIN d x ON reach.b = x.rid GROUP BY a),
links AS (SELECT a AS rid, count(*) AS n FROM link GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, doc_id = class_id AS kept FROM d JOIN comp USING (rid) LEFT JOIN links USING (rid)
"""
