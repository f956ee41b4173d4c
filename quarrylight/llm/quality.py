"""Quality classifier by co-training two views of a document.

The text view sees how a text is written, the metadata view its lang, source and n_chars columns.  Each
is a logistic model on binned features.  Both start from labelled rows; over rounds each view scores all
unlabelled documents and hands the other some of those that it is sure of, with its guess as their label.
The views are then calibrated on labelled rows kept apart and combined, and all documents are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.runtime import crc32_mod, written
from quarrylight.llm.textbytes import TextSlice, find_words, span_hashes, text_slices
from quarrylight.llm.toxicity import fit_logistic

TRAIN_ROWS = 12_000  # labelled documents fitted on, about
GIVEN_ROWS = 600  # documents that a view hands on in a round, drawn from all those it is sure of
ROUNDS = 4
SURE_AT = 0.95
BINS = 12
KEEP_AT = 0.2
HASHED = 64

TEXT_FEATURES = 17
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[33, 35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]] = True


def _by_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)


def text_features(piece: TextSlice) -> np.ndarray:
    """How each text of a slice is written; all zero for an empty one."""
    data, offsets = piece.data, piece.offsets
    words = find_words(piece)
    n = np.diff(words.first).astype(np.float64)
    size = np.diff(offsets).astype(np.float64)
    upper, lower = _by_row((data >= 65) & (data <= 90), offsets), _by_row((data >= 97) & (data <= 122), offsets)
    digit, symbol = _by_row((data >= 48) & (data <= 57), offsets), _by_row(_SYMBOL[data], offsets)
    stop, lines = _by_row((data == 46) | (data == 44), offsets), _by_row(data == 10, offsets)
    wide, pipes, shouts = _by_row(data >= 128, offsets), _by_row(data == 124, offsets), _by_row(data == 33, offsets)
    space = _by_row(data == 32, offsets)
    h = span_hashes(data, words.starts, words.ends)
    row, length = words.rows(), words.ends - words.starts
    count = lambda mask: np.bincount(row[mask], minlength=len(piece)).astype(np.float64)
    again, pair = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=len(piece)).astype(np.float64)
    two = h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1]
    two, r2 = two[row[1:] == row[:-1]], row[1:][row[1:] == row[:-1]]
    order = np.lexsort((two, r2))
    new = np.ones(len(two), bool)
    new[1:] = (two[order][1:] != two[order][:-1]) | (r2[order][1:] != r2[order][:-1])
    pairs = np.bincount(r2[order][new], minlength=len(piece)).astype(np.float64)
    some, bytes_, letters = np.maximum(n, 1), np.maximum(size, 1), np.maximum(upper + lower, 1)
    return np.stack([
        np.log1p(n), _by_row(np.ones(len(data), bool), offsets) / some, upper / letters, digit / bytes_, symbol / bytes_, stop / some,
        lines / some, count(again) / some, distinct / some, pairs / some, count(length <= 3) / some, wide / bytes_, pipes / some, shouts / some,
        (symbol - pipes - shouts) / some, np.log1p(count(length >= 24)), space / some,
    ], 1)


def meta_features(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Codes of lang and source, and the logarithm of n_chars; nulls have codes of their own."""
    from zlib import crc32

    code = lambda a: np.array([HASHED if x is None else crc32(str(x).encode()) % HASHED for x in a.to_pylist()], float)
    chars = pc.fill_null(n_chars.cast(pa.float64()), -1.0).to_numpy(zero_copy_only=False)
    return np.stack([code(lang), code(source), np.log1p(np.maximum(chars, 0)) * (chars >= 0) - (chars < 0)], 1)


@dataclass
class View:
    """Logistic weights on quantile bins of numbers and on codes."""

    edges: list[np.ndarray]  # of a code column: empty
    weights: np.ndarray

    @staticmethod
    def bins_of(x: np.ndarray, codes: int) -> list[np.ndarray]:
        return [np.zeros(0) if k < codes else np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]

    def design(self, x: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(x), 1))]
        for k, edge in enumerate(self.edges):
            code = np.digitize(x[:, k], edge) if len(edge) else np.zeros(len(x), int)
            width = len(edge) + 1
            if not len(edge) and k < 2 and len(self.edges) == 3:
                code, width = x[:, k].astype(int), HASHED + 1
            one = np.zeros((len(x), width))
            one[np.arange(len(x)), code] = 1
            parts.append(one)
        return np.concatenate(parts, 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.weights, -12, 12)


@dataclass
class Model:
    text: View
    meta: View
    combine: np.ndarray
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by both views, by the text and by the metadata."""
        p = lambda z: 1 / (1 + np.exp(-z))
        a, b = self.text.logit(text), self.meta.logit(meta)
        return p(np.stack([np.ones(len(a)), a, b], 1) @ self.combine), p(a), p(b)


#: Of a round, a view's name, the views and how many good and bad ones are wanted: features of both views and guesses.
Pool = Callable[[int, str, dict[str, View], int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def surest(p: np.ndarray) -> np.ndarray:
    """Guesses: 1 good, 0 bad, -1 unsure."""
    return np.where(p >= SURE_AT, 1, np.where(p <= 1 - SURE_AT, 0, -1))


def pool_of(text: np.ndarray, meta: np.ndarray) -> Pool:
    """A pool in memory."""

    def choose(turn: int, name: str, views: dict[str, View], good: int, bad: int):
        guess = surest(1 / (1 + np.exp(-views[name].logit(text if name == "text" else meta))))
        order = np.random.default_rng([turn, name == "text"]).permutation(len(text))
        rows = np.concatenate([order[guess[order] == label][:n] for label, n in ((1, good), (0, bad))])
        return text[rows], meta[rows], guess[rows]

    return choose


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Pool | None = None, rounds: int = ROUNDS) -> Model:
    """y: 1 good, 0 bad, -1 unlabelled; unlabelled rows are the pool where none is given.

    A quarter of the labelled rows is kept for calibration.
    """
    known = y >= 0
    if pool is None:
        pool = pool_of(text[~known], meta[~known])
    views = {"text": View(View.bins_of(text, 0), np.zeros(0)), "meta": View([np.zeros(0), np.zeros(0), *View.bins_of(meta[:, 2:], 0)], np.zeros(0))}
    rows, y = {"text": text[known], "meta": meta[known]}, y[known]
    if not len(y) or y.min() == y.max():  # nothing to tell apart: keep all
        for name, x in (("text", text), ("meta", meta)):
            views[name].weights = np.zeros(views[name].design(x[:1]).shape[1])
        return Model(views["text"], views["meta"], np.array([2.0, 0.0, 0.0]), 1.0)
    fit, held = np.arange(len(y)) % 4 > 0, np.arange(len(y)) % 4 == 0
    if y[fit].min() == y[fit].max() or y[held].min() == y[held].max():
        fit = held = np.ones(len(y), bool)
    x = {name: [views[name].design(rows[name][fit])] for name in views}
    labels = {name: [y[fit]] for name in views}
    share = y[fit].mean()
    good = int(GIVEN_ROWS * share) + 1
    for turn in range(rounds + 1):
        for name, view in views.items():
            view.weights = fit_logistic(np.concatenate(x[name]), np.concatenate(labels[name]), 0.5, 15)
        if turn == rounds:
            break
        found = {name: pool(turn, name, views, good, max(1, GIVEN_ROWS - good)) for name in views}
        for name, other in (("text", "meta"), ("meta", "text")):
            x[other].append(views[other].design(found[name][other == "meta"]))
            labels[other].append(found[name][2])
    z = np.stack([np.ones(held.sum()), *(views[name].logit(rows[name][held]) for name in ("text", "meta"))], 1)
    return Model(views["text"], views["meta"], fit_logistic(z, y[held].astype(float), 1e-2), float(share))


def _featured(docs: DataFrame) -> DataFrame:
    """(doc_id, place, x): the features of both views as one array, and a hash that orders rows."""
    place = F.xxhash64("doc_id", "text", F.lit(23))
    rows = docs.select("text", "lang", "source", "n_chars", "doc_id", place.alias("place"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = meta_features(batch.column(1), batch.column(2), batch.column(3))
            for piece in text_slices(batch.column(0)):
                both = np.concatenate([text_features(piece), meta[piece.first : piece.first + len(piece)]], 1).astype(np.float32)
                ends = pa.array(np.arange(0, both.size + 1, both.shape[1], dtype=np.int32))
                own = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays([own.column(4), own.column(5), pa.ListArray.from_arrays(ends, pa.array(both.ravel()))], names=["doc_id", "place", "x"])

    return rows.mapInArrow(featured, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, place long, x array<float>")


def _matrix(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten(), np.float64).reshape(-1, TEXT_FEATURES + 3)
    return x[:, :TEXT_FEATURES], x[:, TEXT_FEATURES:]


def fit_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``train_rows`` labelled documents and, a round and view, GIVEN_ROWS of all unlabelled ones.

    The features of all documents are written once, and each round reads them.  Rows are chosen by hashes of
    doc_id and text, so that the same tables give the same model.  Of several labels of a doc_id the least
    holds; repeated doc_ids give each of their texts; without both labels every document is kept.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(target).cast("int").alias("y"))
    both = written(_featured(docs).join(known, "doc_id", "left").select("place", "x", "y"), "features")
    n_known = both.where("y IS NOT NULL").count()
    share = int(1_000_000 * min(1.0, train_rows / max(1, n_known)))
    found = both.where(F.col("y").isNotNull() & (F.pmod("place", F.lit(1_000_000)) < share)).toArrow()  # about train_rows rows of 20 numbers
    if not found.num_rows:
        return co_train(np.zeros((1, TEXT_FEATURES)), np.zeros((1, 3)), np.array([-1]))
    open_ = both.where("y IS NULL").select("place", "x")

    def choose(turn: int, name: str, views: dict[str, View], good: int, bad: int):
        shared = docs.sparkSession.sparkContext.broadcast(views[name])

        def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                guesses = surest(1 / (1 + np.exp(-shared.value.logit(_matrix(batch.column(1))[name == "meta"]))))
                some = np.flatnonzero(guesses >= 0)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(some)).columns, pa.array(guesses[some].astype(np.int32))], names=["place", "x", "y"])

        sure = open_.mapInArrow(guess, "place long, x array<float>, y int")
        order = [F.xxhash64("place", F.lit(turn)), F.col("place"), F.col("x")]
        parts = [sure.where(F.col("y") == label).orderBy(*order).limit(n).toArrow() for label, n in ((1, good), (0, bad))]  # GIVEN_ROWS rows
        shared.destroy()
        rows = pa.concat_tables(parts)
        return *_matrix(rows["x"]), np.asarray(rows["y"]).astype(int)

    text, meta = _matrix(found["x"])
    order = np.lexsort((*text.T, *meta.T, np.asarray(found["place"])))  # the same model whatever the order of rows
    return co_train(text[order], meta[order], np.asarray(found["y"])[order], choose)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with quality_score, text_score and meta_score.

    Each row is scored by its own columns: repeated rows and ids give equal scores, null texts score as empty
    ones, null lang, source and n_chars have codes of their own, an empty table gives no rows.  Columns may bear
    any names but the three that are added; text, lang, source and n_chars must be there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(docs.columns)]
    at = [docs.columns.index(c) for c in ("text", "lang", "source", "n_chars")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = meta_features(*(batch.column(k) for k in at[1:]))
            for piece in text_slices(batch.column(at[0])):
                values = shared.value.score(text_features(piece), meta[piece.first : piece.first + len(piece)])
                own = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, values)], names=[*batch.schema.names, "a", "b", "c"])

    schema = ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)), "a double, b double, c double"])
    found = docs.select(*columns).mapInArrow(score, schema)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("a").alias("quality_score"), F.col("b").alias("text_score"), F.col("c").alias("meta_score"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns only from labelled rows whose crc32 of doc_id, modulo 3, is not 1, so that the rest can measure it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rest = crc32_mod("doc_id", 3)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(rest != 1))
    found = score_quality(docs, model)
    return found.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), "text_score", "meta_score", (F.col("quality_score") >= KEEP_AT).alias("kept"))
