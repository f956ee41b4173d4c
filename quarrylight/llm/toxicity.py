"""Toxic spans by a linear-chain conditional random field.

Documents carry a label, tokens don't.  Words and their beginnings are binned by how far more often they stand in
toxic documents than in others.  A token's features are the bins of its word and of its best beginning, and
how strong its neighbours are; the field weighs them and the transitions between the states clean and
toxic.  It is fitted in two phases with forward-backward expectations: first on seed labels, the
strongest words of toxic documents; then tokens are labelled anew at each step by the field itself, given
that a clean document has no toxic token and a toxic one at least one, wherever it stands.  Marginals
are computed for all tokens of a slice at once: texts are cut in chunks, the chunks' transfer matrices
chained, and each chunk then filled from its boundary messages.  A logistic fit turns a document's
marginals in its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.ngram_join import band_hashes, gram_hashes
from quarrylight.llm.runtime import crc32_mod, written
from quarrylight.llm.textbytes import TextSlice, Words, find_words, mix, span_hashes, text_slices

TRAIN_ROWS = 16_000  # labelled documents fitted on, about, half of them toxic where there are as many
FIELD_ROWS = 1_500  # of the quarter of those that gives no word evidence, documents that the field is fitted on
COPY_GRAMS, COPY_ROWS = 5, 4  # copies of a class have COPY_ROWS equal least hashes of their COPY_GRAMS-grams
PREDICT_AT = 0.7
SPAN_AT = 0.5
CHUNK = 64

EDGES = np.array([-2.0, -1.0, 0.7, 1.5, 2.2, 3.0, 3.6, 4.2, 5.0, 6.0])  # of a word's log odds against those of all documents
NEUTRAL = 2
TOXIC_BIN = 7
SURE = 4.0  # standard errors that evidence must have
PREFIXES = (3, 4, 5, 6, 7, 8, 10)
WIDTHS = (len(EDGES) + 1, len(EDGES) + 1, 3, 3)  # values of a token's features
SEED_STEPS, LABEL_STEPS = 30, 30


def word_features(piece: TextSlice, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of all words, then of their beginnings of PREFIXES bytes: inflected forms share a stem."""
    yield span_hashes(piece.data, starts, ends)
    for n in PREFIXES:
        yield mix(span_hashes(piece.data, starts, np.minimum(ends, starts + n)) + np.uint64(n))


@dataclass
class Field:
    keys: np.ndarray  # sorted word hashes
    bins: np.ndarray
    emission: np.ndarray  # weight of the toxic state for each value of each feature
    transition: np.ndarray  # log weights, from a row's state to a column's
    calibration: np.ndarray

    def token_features(self, piece: TextSlice, words: Words) -> np.ndarray:
        """Of each token: its word's bin, the strongest bin of its beginnings, and the strength of the tokens beside it."""
        own = np.full(len(words.starts), NEUTRAL, np.uint8)
        stem = own.copy()
        if len(self.keys):
            for k, keys in enumerate(word_features(piece, words.starts, words.ends)):
                slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                bins = np.where(self.keys[slot] == keys, self.bins[slot], NEUTRAL).astype(np.uint8)
                if k == 0:
                    own = bins
                else:
                    stem = np.maximum(stem, bins)
        best, row = np.maximum(own, stem), words.rows()
        level = (best > NEUTRAL).astype(np.uint8) + (best >= TOXIC_BIN)
        before, after = np.zeros_like(level), np.zeros_like(level)
        same = row[1:] == row[:-1]
        before[1:], after[:-1] = level[:-1] * same, level[1:] * same
        return np.stack([own, stem, before, after], 1)

    def token_scores(self, features: np.ndarray) -> np.ndarray:
        return self.emission[features + _OFFSETS].sum(1)


_OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])


def _messages(scores: np.ndarray, first: np.ndarray, transition: np.ndarray):
    """Forward messages before each token, backward messages after it and norms, in chunk layout; and that layout."""
    sizes = np.diff(first)
    chunks = -(-sizes // CHUNK)
    total, of_doc = int(chunks.sum()), np.repeat(np.arange(len(sizes)), chunks)
    number = np.arange(total) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = first[:-1][of_doc] + number * CHUNK
    length = np.minimum(sizes[of_doc] - number * CHUNK, CHUNK)
    place = begin[:, None] + np.arange(CHUNK)
    valid = np.arange(CHUNK) < length[:, None]
    e1 = np.exp(scores[np.minimum(place, max(len(scores) - 1, 0))]) if len(scores) else np.ones((0, CHUNK))
    t = np.exp(transition)
    product = np.tile(np.eye(2), (total, 1, 1))
    for j in range(CHUNK):
        live = valid[:, j]
        a0 = product[:, :, 0] * t[0, 0] + product[:, :, 1] * t[1, 0]
        a1 = (product[:, :, 0] * t[0, 1] + product[:, :, 1] * t[1, 1]) * e1[:, j, None]
        scale = 1 / (a0 + a1).max(1)[:, None]
        product[:, :, 0] = np.where(live[:, None], a0 * scale, product[:, :, 0])
        product[:, :, 1] = np.where(live[:, None], a1 * scale, product[:, :, 1])
    ahead, behind = np.zeros((total, 2)), np.ones((total, 2))
    ahead[:, 0] = 1.0  # a text begins in the clean state
    starts = np.cumsum(chunks) - chunks
    for k in range(1, int(chunks.max()) if len(chunks) else 0):
        at = starts[chunks > k] + k
        x = np.einsum("ni,nij->nj", ahead[at - 1], product[at - 1])
        ahead[at] = x / x.sum(1, keepdims=True)
        at = (starts + chunks - 1)[chunks > k] - k
        x = np.einsum("nij,nj->ni", product[at + 1], behind[at + 1])
        behind[at] = x / x.sum(1, keepdims=True)
    before, after, norm = np.empty((total, CHUNK, 2)), np.empty((total, CHUNK, 2)), np.empty((total, CHUNK))
    f, b = ahead, behind
    for j in range(CHUNK):
        before[:, j] = f
        x = np.stack([f[:, 0] * t[0, 0] + f[:, 1] * t[1, 0], (f[:, 0] * t[0, 1] + f[:, 1] * t[1, 1]) * e1[:, j]], 1)
        norm[:, j] = x.sum(1)
        f = x / norm[:, j, None]
    for j in range(CHUNK - 1, -1, -1):
        after[:, j] = b
        x = np.stack([t[0, 0] * b[:, 0] + t[0, 1] * e1[:, j] * b[:, 1], t[1, 0] * b[:, 0] + t[1, 1] * e1[:, j] * b[:, 1]], 1)
        b = np.where(valid[:, j, None], x / x.sum(1, keepdims=True), b)
    return before, after, e1, t, valid, norm


def marginals(scores: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Probability of the toxic state for each token, by their scores; row r has the tokens first[r] to first[r + 1]."""
    if not len(scores):
        return np.zeros(0)
    before, after, e1, t, valid, _ = _messages(scores, first, transition)
    clean = (before[..., 0] * t[0, 0] + before[..., 1] * t[1, 0]) * after[..., 0]
    toxic = (before[..., 0] * t[0, 1] + before[..., 1] * t[1, 1]) * e1 * after[..., 1]
    return (toxic / (clean + toxic))[valid]


def _expected(scores, first, transition):
    """Of each token, the probabilities of its pairs of states; of each document, the log of all paths against the clean one."""
    before, after, e1, t, valid, norm = _messages(scores, first, transition)
    pair = np.empty((*before.shape, 2))
    pair[..., 0] = before * t[:, 0] * after[..., None, 0]
    pair[..., 1] = before * t[:, 1] * (e1 * after[..., 1])[..., None]
    pair = pair[valid]
    pair /= pair.sum((1, 2), keepdims=True)
    logs = np.concatenate([[0.0], np.cumsum(np.log(norm[valid]))])
    return pair, logs[first[1:]] - logs[first[:-1]]


def fit_field(features: np.ndarray, first: np.ndarray, y: np.ndarray, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights by Adam steps, on seed labels and then on labels that follow from the documents' and the field.

    With the clean path's weight 1, a document is clean with probability 1 / Z.  Its tokens' expected labels,
    given that it is toxic, are their marginals over 1 - 1 / Z; given that it is clean, 0.
    """
    row = np.repeat(np.arange(len(y)), np.diff(first))
    width = int(sum(WIDTHS))
    places = features + _OFFSETS
    seed = ((features[:, :2].max(1) >= TOXIC_BIN) & (y[row] == 1)).astype(np.float64)
    prior = np.zeros(len(seed))
    prior[1:] = seed[:-1] * (row[1:] == row[:-1])
    seeds = np.stack([(1 - prior) * seed, prior * (1 - seed), prior * seed], 1)  # pairs clean-toxic, toxic-clean, toxic-toxic
    x = np.zeros(width + 3)
    x[: WIDTHS[0]] = np.linspace(-3, 3, WIDTHS[0])
    x[width] = -2.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, SEED_STEPS + LABEL_STEPS + 1):
        transition = np.array([[0.0, x[width]], [x[width + 1], x[width + 2]]])
        pair, logs = _expected(x[places].sum(1), first, transition)
        model = np.stack([pair[:, 0, 1], pair[:, 1, 0], pair[:, 1, 1]], 1)
        if k <= SEED_STEPS:
            more = seeds - model
        else:  # the expected labels less the marginals
            toxic = np.maximum(-np.expm1(-np.maximum(logs, 0)), 1e-6)
            more = model * np.where(y == 1, 1 / toxic - 1, -1.0)[row, None]
        tokens = more[:, 0] + more[:, 2]
        grad = np.concatenate([sum(np.bincount(places[:, c], tokens, minlength=width) for c in range(places.shape[1])), more.sum(0)]) / max(1, len(y)) - decay * x
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        x = x + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return x[:width], np.array([[0.0, x[width]], [x[width + 1], x[width + 2]]])


def _features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each document: 1, the logit of its largest marginal, and the logarithms of one and the tokens expected to
    be toxic among those likelier so than not, and of one and all its tokens."""
    rows, sizes = len(first) - 1, np.diff(first)
    total, top = np.zeros(rows), np.full(rows, 1e-4)
    some = sizes > 0
    if some.any():
        total[some], top[some] = np.add.reduceat(np.where(p >= SPAN_AT, p, 0.0), first[:-1][some]), np.maximum.reduceat(p, first[:-1][some])
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(rows), np.log(top / (1 - top)), np.log1p(total), np.log1p(sizes)], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton steps on the regularised likelihood; classes weigh as they occur."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w))
        w = w + np.linalg.solve(hess, x.T @ (y - p) - decay * w)
    return w


def _sample(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """About ``rows`` labelled texts, as many toxic as others where there are enough; by a hash of doc_id."""
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    half = rows // 2
    share = F.lit(0)
    for y, n in sizes.items():
        room = max(half, rows - sum(v for k, v in sizes.items() if k != y))
        share = F.when(F.col("y") == y, F.lit(int(1_000_000 * min(1.0, room / n)))).otherwise(share)
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < share)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")  # about ``rows`` rows


def fit_toxicity(docs: DataFrame, labels: DataFrame, target: str = "toxic", train_rows: int = TRAIN_ROWS, field_rows: int = FIELD_ROWS) -> Field:
    """Fit on about ``train_rows`` labelled documents; three quarters give word evidence, ``field_rows`` of the rest the weights.

    Rows are chosen by a hash of doc_id, so that the same rows give the same field.  A doc_id with several
    labels counts as toxic if one of them says so; a repeated doc_id gives each of its texts.  Copies and near
    copies of a class count once: texts of equal COPY_ROWS least hashes of word 5-grams, of which that of the
    least hash stays.  Without labels of both classes the field only knows that stronger words are more toxic.
    """
    part = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(4))
    rows = _sample(docs, labels, target, train_rows).select("text", F.col("y").cast("int").alias("y"), (part == 0).alias("field"))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for piece in text_slices(batch.column(0)):
                grams, first, _, _ = gram_hashes(piece, COPY_GRAMS)
                own = np.zeros(len(piece), np.uint64)
                own[np.diff(first) > 0] = band_hashes(grams, first, 1, COPY_ROWS)[:, 0]
                keys.append(own.view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(keys))], names=["text", "y", "field", "copies"])

    texts = rows.mapInArrow(grouped, "text string, y int, field boolean, copies long")
    one = texts.groupBy("y", "copies").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "field")).alias("one"))
    texts = written(one.select("one.text", "y", "one.field"), "toxicity")
    totals = {r["y"]: r["n"] for r in texts.where(~F.col("field")).groupBy("y").agg(F.count("*").alias("n")).collect()}

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for piece in text_slices(batch.column(0)):
                words, found = find_words(piece), []
                row = words.rows()
                for keys in word_features(piece, words.starts, words.ends):
                    order = np.lexsort((keys, row))
                    k, r = keys[order], row[order]
                    new = np.ones(len(k), bool)
                    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
                    found.append((k[new], y[piece.first + r[new]]))
                keys, toxic = np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found]) == 1
                distinct, inverse = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_pydict({"word": pa.array(distinct.view(np.int64)), "bad": pa.array(np.bincount(inverse, toxic, len(distinct)).astype(np.int64)), "good": pa.array(np.bincount(inverse, ~toxic, len(distinct)).astype(np.int64))})

    counts = texts.where(~F.col("field")).mapInArrow(tallied, "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    both, bad, good = F.col("bad") + F.col("good"), F.col("bad"), F.col("good")
    # signed root of the likelihood ratio against the share of toxic documents
    ratio = F.when(bad > 0, bad * F.log(bad / (both * max(share, 1e-9)))).otherwise(0.0) + F.when(good > 0, good * F.log(good / (both * max(1 - share, 1e-9)))).otherwise(0.0)
    z = F.sqrt(2 * F.greatest(ratio, F.lit(0.0))) * F.when(bad > both * share, 1).otherwise(-1)
    odds = F.log((bad + 0.5) / (good + 0.5)) - float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    strong = counts.select("word", z.alias("sure"), odds.alias("z")).where((F.abs("sure") >= SURE) & ((F.col("z") >= EDGES[2]) | (F.col("z") < EDGES[1])))
    lexicon = strong.toPandas()  # words that the sampled rows repeat, a few each
    keys = lexicon["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    field = Field(keys[order], np.digitize(lexicon["z"].to_numpy(float), EDGES).astype(np.uint8)[order], np.zeros(0), np.zeros((2, 2)), np.zeros(4))
    held = texts.where("field").orderBy(F.xxhash64("text"), "text", "y").limit(field_rows).select("text", "y").toArrow()  # field_rows rows at most
    y = held["y"].to_numpy().astype(np.int64)
    parts = [(field.token_features(piece, words), words.first) for piece in text_slices(held["text"]) for words in [find_words(piece)]]
    features = np.concatenate([b for b, _ in parts]) if parts else np.zeros((0, len(WIDTHS)), np.uint8)
    sizes = np.concatenate([np.diff(f) for _, f in parts]) if parts else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if not len(features) or y.min() == y.max():
        flat = [np.linspace(-3, 3, w) if k < 2 else np.zeros(w) for k, w in enumerate(WIDTHS)]
        field.emission, field.transition, field.calibration = np.concatenate(flat), np.array([[0.0, -3.0], [-1.0, 0.0]]), np.array([-3.0, 0.5, 0.0, 0.0])
        return field
    field.emission, field.transition = fit_field(features, first, y)
    field.calibration = fit_logistic(_features(marginals(field.token_scores(features), first, field.transition), first), y)
    return field


def score_slice(piece: TextSlice, field: Field) -> tuple[np.ndarray, list[list[dict]]]:
    """Document scores and, for each document, its spans of toxic words as character offsets."""
    words = find_words(piece)
    p = marginals(field.token_scores(field.token_features(piece, words)), words.first, field.transition)
    score = 1 / (1 + np.exp(-np.clip(_features(p, words.first) @ field.calibration, -30, 30)))
    spans: list[list[dict]] = [[] for _ in range(len(piece))]
    row = words.rows()
    hot = p >= SPAN_AT
    if hot.any():
        begins, ends = hot.copy(), hot.copy()
        cut = row[1:] != row[:-1]
        begins[1:] &= ~hot[:-1] | cut
        ends[:-1] &= ~hot[1:] | cut
        chars = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
        for a, b in zip(np.flatnonzero(begins), np.flatnonzero(ends)):
            base = chars[piece.offsets[row[a]]]
            spans[row[a]].append({"start": int(chars[words.starts[a]] - base), "end": int(chars[words.ends[b]] - base), "weight": float(p[a : b + 1].max())})
    return score, spans


SPANS = "array<struct<start:int,end:int,weight:double>>"


def score_toxicity(docs: DataFrame, field: Field, keep: list[str]) -> DataFrame:
    """Add score, predicted and spans to the ``keep`` columns, which may bear any names.

    Each row is scored by its text alone: repeated rows and ids give equal rows, null texts score as empty
    ones, an empty table gives none, and a score of PREDICT_AT itself is predicted toxic.
    """
    fields = [docs.schema[c] for c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("the_text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch.column(batch.num_columns - 1)):
                value, spans = score_slice(piece, shared.value)
                own = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(value), pa.array(spans, kind)], names=[*batch.schema.names[:-1], "score", "spans"])

    schema = ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "score double", f"spans {SPANS}"])
    found = rows.mapInArrow(score, schema)
    return found.select(*[F.col(f"k{i}").alias(f.name) for i, f in enumerate(fields)], "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "spans")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns only from labelled rows whose crc32 of doc_id, modulo 3, is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rest = crc32_mod("doc_id", 3)
    field = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(rest != 1))
    found = score_toxicity(docs, field, ["doc_id"])
    return found.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))
