"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1 drawn from its code point.  A trigram binds the vectors of
its letters, the first rotated by two places, the second by one, by componentwise product.  A document
bundles the trigrams of its words (with a blank at either end) by their sum; a language prototype is
the sum of unit document vectors.  A document's language is the prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.runtime import crc32_mod
from quarrylight.llm.textbytes import text_slices

DIMENSION = 1024
TRAIN_ROWS = 20_000  # documents fitted on, about; fewer if the table has fewer
LEAST_ROWS = 50  # of each language, about, however many languages there are; all where there are fewer
SHARPNESS = 25.0  # of the cosines in the score
BLANK = 0

_letter_table: np.ndarray | None = None


def letters_table() -> np.ndarray:
    """For each code point its lower-case letter, or BLANK."""
    global _letter_table
    if _letter_table is None:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letter_table = table
    return _letter_table


class TrigramVectors:
    """Vectors of trigrams, made when first seen and kept up to a bound."""

    LIMIT = 40_000

    def __init__(self, dimension: int):
        self.dimension = dimension
        self.letters: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros((0, self.dimension), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 100_000:
                self.letters.clear()
            self.letters[code] = np.random.default_rng([7, code]).integers(0, 2, self.dimension, dtype=np.int8) * np.int8(2) - np.int8(1)
        return self.letters[code]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """One row for each of some sorted, distinct trigram keys."""
        slot = np.searchsorted(self.keys, keys)
        known = slot < len(self.keys)
        known[known] = self.keys[slot[known]] == keys[known]
        if not known.all():
            if len(self.keys) + (~known).sum() > self.LIMIT:
                self._clear()
                known[:] = False
            new = keys[~known]
            a, b, c = (new >> np.uint64(42)).tolist(), ((new >> np.uint64(21)) & np.uint64(0x1FFFFF)).tolist(), (new & np.uint64(0x1FFFFF)).tolist()
            made = np.stack([np.roll(self.letter(x), 2) * np.roll(self.letter(y), 1) * self.letter(z) for x, y, z in zip(a, b, c)])
            order = np.argsort(np.concatenate([self.keys, new]))
            self.keys, self.rows = np.concatenate([self.keys, new])[order], np.concatenate([self.rows, made])[order]
            slot = np.searchsorted(self.keys, keys)
        return self.rows[slot]


_vectors: dict[int, TrigramVectors] = {}


def bundle(texts: list[str], dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Document vectors, and whether a document has a letter."""
    vectors = _vectors.setdefault(dimension, TrigramVectors(dimension))
    joined = "\n".join(x.replace("\n", " ") for x in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    ends = np.flatnonzero(codes == 10)
    low = letters_table()[np.minimum(codes, 0x10FFFF)]
    row = np.zeros(len(codes), np.int32)
    row[ends[:-1] + 1] = 1
    row = np.cumsum(row, dtype=np.int32)
    has = np.zeros(len(texts), bool)
    has[row[low > 0]] = True
    # runs of blanks count as one; a trigram has its middle letter inside a word
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] > 0) | (low[:-1] > 0) | (row[1:] != row[:-1])
    low, row = low[keep].astype(np.uint64), row[keep]
    low, row = np.concatenate([[np.uint64(0)], low]), np.concatenate([row[:1], row])
    mid = np.flatnonzero(low[1:-1] > 0) + 1 if len(low) > 2 else np.zeros(0, np.int64)
    key = (low[mid - 1] << np.uint64(42)) | (low[mid] << np.uint64(21)) | low[mid + 1]
    out = np.zeros((len(texts), dimension), np.float32)
    if not len(key):
        return out, has
    distinct, inverse = np.unique(key, return_inverse=True)
    of_row = row[mid]
    for begin in range(0, len(distinct), 4096):
        part = distinct[begin : begin + 4096]
        mine = slice(None) if len(distinct) <= 4096 else (inverse >= begin) & (inverse < begin + 4096)
        flat = of_row[mine].astype(np.int64) * len(part) + (inverse[mine] - begin)
        counts = np.bincount(flat, minlength=len(texts) * len(part)).reshape(len(texts), len(part)).astype(np.float32)
        out += counts @ vectors.of(part).astype(np.float32)
    return out, has


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True)), 1e-12)


def fit_prototypes(docs: DataFrame, train_rows: int = TRAIN_ROWS, dimension: int = DIMENSION) -> tuple[list[str], np.ndarray]:
    """Prototypes of the non-null ``lang`` values.

    Fitted on a sample of about ``train_rows`` rows, chosen by a hash of doc_id and text; all rows if
    there are no more.  Languages share the rows evenly, and all rows of one that has less than its share
    are used.  Each task adds up one vector for each language and the sums are added.
    """
    labelled = docs.where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    room, left = train_rows, len(sizes)
    share = F.lit(1_000_000)
    for lang, n in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        own = max(room / left, LEAST_ROWS)
        if n > own:
            share = F.when(F.col("lang") == lang, F.lit(int(1_000_000 * own / n))).otherwise(share)
        room, left = room - min(n, own), left - 1
    labelled = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for piece in text_slices(batch.column(0), 1 << 19, 1024):
                vectors, has = bundle([piece.text(i) for i in range(len(piece))], dimension)
                own = langs[piece.first : piece.first + len(piece)]
                for lang in set(own):
                    total = _unit(vectors[(own == lang) & has]).sum(0)
                    sums[lang] = sums.get(lang, 0) + total
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "total": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))})

    sums = labelled.select("text", "lang").mapInArrow(add, "lang string, total array<double>")
    places = sums.select("lang", F.posexplode("total").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = places.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).orderBy("lang").collect()  # one row for each language
    return [r["lang"] for r in rows], _unit(np.array([[x["x"] for x in r["v"]] for r in rows]).reshape(len(rows), dimension))


def predict_language(docs: DataFrame, langs: list[str], prototypes: np.ndarray, keep: list[str]) -> DataFrame:
    """Add lang_pred and score to the ``keep`` columns.  ``und`` and 0 for a text that is null or has no letter."""
    dimension = prototypes.shape[1] if len(langs) else DIMENSION
    fields = [docs.schema[c] for c in keep]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("the_text"))
    shared = docs.sparkSession.sparkContext.broadcast((langs, prototypes.astype(np.float32)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for piece in text_slices(texts, 1 << 19, 1024):
                vectors, has = bundle([piece.text(i) for i in range(len(piece))], dimension)
                own = batch.slice(piece.first, len(piece))
                if names:
                    cosine = _unit(vectors) @ table.T
                    weight = np.exp(SHARPNESS * (cosine - cosine.max(1, keepdims=True)))
                    best = cosine.argmax(1)
                    score = np.where(has, 1 / weight.sum(1), 0.0)
                    lang = [names[b] if h else "und" for b, h in zip(best, has)]
                else:
                    score, lang = np.zeros(len(piece)), ["und"] * len(piece)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(lang, pa.string()), pa.array(score.astype(np.float64))], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    schema = ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "lang_pred string", "score double"])
    found = rows.mapInArrow(predict, schema)
    return found.select(*[F.col(f"k{i}").alias(f.name) for i, f in enumerate(fields)], "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns only from rows whose crc32 of doc_id, modulo 5, is not 0.  A null doc_id is neither learned from nor held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rest = crc32_mod("doc_id", 5)
    langs, prototypes = fit_prototypes(docs.where(rest != 0))
    found = predict_language(docs.select("doc_id", "text"), langs, prototypes, ["doc_id"])
    return found.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
