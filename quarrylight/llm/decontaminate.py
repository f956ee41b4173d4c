"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of one task.  Its words are numbered by the phrase vocabulary; a word
that no test phrase holds can't be part of an occurrence, so it only ends a run, and runs shorter than
the shortest phrase are left out of the index.  The rest is suffix-sorted, its Burrows-Wheeler
transform kept in a wavelet tree with word-wise popcount ranks, and every 16th text position sampled.
All windows of the test items are searched backward at once; occurrences are located by stepping to
the next sampled position, and their spans are merged over the words of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.runtime import written
from quarrylight.llm.textbytes import TextSlice, find_words, span_hashes, text_slices

WINDOW = 10
SAMPLE = 16
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20  # test items are read and searched in blocks of about so much text


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of an integer string by prefix doubling; only groups still tied are sorted again."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n, np.int64)

    def regroup(places: np.ndarray, begins: np.ndarray) -> np.ndarray:
        # a suffix's rank is the place where its group begins
        return np.maximum.accumulate(np.where(begins, places, 0))

    sorted_text = text[order]
    begins = np.ones(n, bool)
    begins[1:] = sorted_text[1:] != sorted_text[:-1]
    rank[order] = regroup(np.arange(n), begins)
    step = 1
    tied = np.flatnonzero(~(begins & np.append(begins[1:], True)))
    while len(tied):
        suffix = order[tied]
        after = suffix + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        own = rank[suffix]
        again = np.lexsort((second, own))
        suffix, own, second = suffix[again], own[again], second[again]
        order[tied] = suffix
        begins = np.ones(len(tied), bool)
        begins[1:] = (own[1:] != own[:-1]) | (second[1:] != second[:-1])
        rank[suffix] = regroup(tied, begins)
        alone = begins & np.append(begins[1:], True)
        tied = tied[~alone]
        step *= 2
    return order


class RankBits:
    """Bits with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)
        self.ones = int(ones.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        low = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Symbols by bit level, high bit first, zeros before ones at each level."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.depth = max(1, int(top).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            bits = ((symbols >> level) & 1).astype(np.uint8)
            self.levels.append(RankBits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before place ``i``."""
        begin, at = np.zeros_like(i), i
        for k, bits in enumerate(self.levels):
            one = ((symbol >> (self.depth - 1 - k)) & 1).astype(bool)
            b1, a1 = bits.rank1(begin), bits.rank1(at)
            begin = np.where(one, self.zeros[k] + b1, begin - b1)
            at = np.where(one, self.zeros[k] + a1, at - a1)
        return at - begin

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and how often it stands before."""
        begin, at, symbol = np.zeros_like(i), i, np.zeros_like(i)
        for k, bits in enumerate(self.levels):
            one = bits.get(at)
            symbol = symbol * 2 + one
            b1, a1 = bits.rank1(begin), bits.rank1(at)
            begin = np.where(one, self.zeros[k] + b1, begin - b1)
            at = np.where(one, self.zeros[k] + a1, at - a1)
        return symbol, at - begin


class FMIndex:
    """Index of an integer string of symbols 0 to top.  Inside, symbols are one higher and a unique 0 ends the string."""

    def __init__(self, text: np.ndarray, top: int):
        text, top = np.append(text + 1, 0), top + 1
        self.n = len(text)
        order = suffix_array(text)
        last = text[order - 1]
        self.tree = WaveletTree(last, top)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        sampled = order % SAMPLE == 0
        self.marks = RankBits(sampled.astype(np.uint8))
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases, rows padded at the front: the suffixes low to high begin with each."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for k in range(phrases.shape[1]):
            live = np.flatnonzero((k < lengths) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, phrases.shape[1] - 1 - k].astype(np.int64) + 1
            low[live] = self.less[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.less[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, stepping back to sampled ones."""
        out, steps, at, live = np.zeros(len(rows), np.int64), 0, rows.astype(np.int64), np.arange(len(rows))
        while len(live):
            hit = self.marks.get(at)
            out[live[hit]] = self.samples[self.marks.rank1(at[hit])] + steps
            live, at = live[~hit], at[~hit]
            if len(live):
                symbol, rank = self.tree.access_rank(at)
                at = self.less[symbol] + rank
            steps += 1
        return out


@dataclass
class Phrases:
    """Windows of a block of test items."""

    keys: np.ndarray  # sorted hashes of the vocabulary; symbol = place + 1
    rows: np.ndarray  # windows by distinct content, padded at the front
    lengths: np.ndarray
    names: list[str]  # of the items
    first: np.ndarray  # window w stands in the items items[first[w] : first[w + 1]]
    items: np.ndarray


def phrases_of(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
    pieces = list(text_slices(pa.array([text or "" for _, text in items], pa.large_string()), 1 << 62))
    if not pieces:
        return Phrases(np.zeros(0, np.uint64), np.zeros((0, window), np.int32), np.zeros(0, np.int64), [], np.zeros(1, np.int64), np.zeros(0, np.int64))
    words = find_words(pieces[0])
    keys, symbol = np.unique(span_hashes(pieces[0].data, words.starts, words.ends), return_inverse=True)
    symbol = np.append(symbol + 1, 0).astype(np.int32)
    sizes = np.diff(words.first)
    counts = np.where(sizes > 0, np.maximum(sizes - window + 1, 1), 0)
    begin = np.repeat(words.first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    lengths = np.minimum(np.repeat(sizes, counts), window)
    rows = np.zeros((len(begin), window), np.int32)
    for k in range(window):
        place = begin + k - (window - lengths)
        rows[:, k] = symbol[np.where(place >= begin, place, len(symbol) - 1)]
    _, one, which = np.unique(rows.view(np.dtype((np.void, 4 * window))).ravel(), return_index=True, return_inverse=True)
    names = sorted({name for name, _ in items if name is not None})
    code = {name: k for k, name in enumerate(names)}
    of_item = np.repeat(np.array([-1 if name is None else code[name] for name, _ in items], np.int64), counts)
    held = np.unique(which[of_item >= 0] * max(1, len(names)) + of_item[of_item >= 0])
    window_of, item = np.divmod(held, max(1, len(names)))
    return Phrases(keys, rows[one], lengths[one], names, np.searchsorted(window_of, np.arange(len(one) + 1)), item)


@dataclass
class Hits:
    """Of a slice: its words, which of them lie in an occurrence, and (row, window) pairs."""

    words: object
    hit: np.ndarray
    pairs: np.ndarray


def search_shard(piece: TextSlice, phrases: Phrases) -> Hits:
    words = find_words(piece)
    n = len(words.starts)
    hit = np.zeros(n, bool)
    if not n or not len(phrases.lengths):
        return Hits(words, hit, np.zeros((0, 2), np.int64))
    h = span_hashes(piece.data, words.starts, words.ends)
    slot = np.minimum(np.searchsorted(phrases.keys, h), len(phrases.keys) - 1)
    symbol = np.where(phrases.keys[slot] == h, slot + 1, 0)
    row = words.rows()
    inside = symbol > 0
    begins, ends = inside.copy(), inside.copy()
    cut = row[1:] != row[:-1]
    begins[1:] &= ~inside[:-1] | cut
    ends[:-1] &= ~inside[1:] | cut
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = ends - begins >= phrases.lengths.min()
    begins, ends = begins[long], ends[long]
    if not len(begins):
        return Hits(words, hit, np.zeros((0, 2), np.int64))
    # the kept runs, each followed by a 0
    sizes = ends - begins + 1
    place = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    text = symbol[np.minimum(place, n - 1)]
    text[np.cumsum(sizes) - 1] = 0
    index = FMIndex(text, len(phrases.keys))
    low, high = index.search(phrases.rows, phrases.lengths)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    suffixes = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    at = place[index.locate(suffixes)]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + phrases.lengths[which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    return Hits(words, hit, np.unique(np.stack([row[at], which], 1), axis=0))


def removal_spans(piece: TextSlice, hit: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, first byte, end byte) of the merged spans of hit words, in order."""
    words = find_words(piece)
    row = words.rows()
    begins, ends = hit.copy(), hit.copy()
    cut = row[1:] != row[:-1]
    begins[1:] &= ~hit[:-1] | cut
    ends[:-1] &= ~hit[1:] | cut
    for a, b in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(ends).tolist()):
        yield int(row[a]), int(words.starts[a]), int(words.ends[b])


def _item_blocks(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[str | None, str | None]]]:
    block, used = [], 0
    for name, text in benchmark.select(F.col(id_column).cast("string"), F.col(text_column)).toLocalIterator():
        block.append((name, text))
        used += len(text or "") + 16
        if used >= BLOCK_BYTES:
            yield block
            block, used = [], 0
    if block:
        yield block


def _search_batch(batch: pa.RecordBatch, text_at: int, phrases: Phrases | None, first_block: bool) -> Iterator[pa.RecordBatch]:
    """Search the shards of a batch and add what they hit to the_hits and the_items; without phrases only count words."""
    names = batch.schema.names
    for piece in text_slices(batch.column(text_at), SHARD_BYTES):
        own = batch.slice(piece.first, len(piece))
        columns = list(own.columns)
        if phrases is None:
            counts = np.diff(find_words(piece).first)
        else:
            hits = search_shard(piece, phrases)
            counts, row = np.diff(hits.words.first), hits.words.rows()
            flat = (np.arange(len(row)) - np.repeat(hits.words.first[:-1], counts))[hits.hit]
            by_row = np.concatenate([[0], np.cumsum(np.bincount(row[hits.hit], minlength=len(piece)))])
            items: list[set[str]] = [set() for _ in range(len(piece))]
            for r, w in hits.pairs.tolist():
                items[r].update(phrases.names[k] for k in phrases.items[phrases.first[w] : phrases.first[w + 1]])
            new_hits: pa.Array = pa.ListArray.from_arrays(pa.array(by_row.astype(np.int32)), pa.array(flat.astype(np.int32)))
            if not first_block:
                old_hits, old_items = own.column(names.index("the_hits")), own.column(names.index("the_items"))
                new_hits = pa.array([sorted({*a, *b}) for a, b in zip(old_hits.to_pylist(), new_hits.to_pylist())], pa.list_(pa.int32()))
                items = [{*a, *b} for a, b in zip(old_items.to_pylist(), items)]
            columns[names.index("the_hits")] = new_hits
            columns[names.index("the_items")] = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
        columns[names.index("the_words")] = pa.array(counts.astype(np.int64))
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _cut(batch: pa.RecordBatch, at: int, hits_at: int) -> pa.RecordBatch:
    """Texts of column ``at`` without their spans of hit words; a text that keeps no word loses its row."""
    texts, hits = batch.column(at), batch.column(hits_at)
    changed = np.flatnonzero(np.asarray(pc.list_value_length(hits)) > 0)
    if not len(changed):
        return batch
    new, left = texts.to_pylist(), np.ones(len(texts), bool)
    for k in changed.tolist():
        raw = new[k].encode("utf-8", "replace")
        data = np.frombuffer(raw, np.uint8)
        piece = TextSlice(0, data, np.array([0, len(data)]))
        hit = np.zeros(len(find_words(piece).starts), bool)
        hit[hits[k].as_py()] = True
        parts, last = [], 0
        for _, a, b in removal_spans(piece, hit):
            parts.append(raw[last:a])
            last = b
        new[k] = b"".join([*parts, raw[last:]]).decode("utf-8", "replace")
        left[k] = not hit.all()
    return batch.set_column(at, batch.schema.field(at), pa.array(new, texts.type)).filter(pa.array(left))


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, keep: list[str], item_id: str, item_text: str, cut: bool) -> DataFrame:
    """The columns k0, k1 ... of ``keep`` with the_words, the_hits and the_items.

    The last block of items is searched in one pass that carries ``keep``; each block before it in a pass of its
    own, of which only the rows that hit are written.  One block is held at a time, by driver and tasks.
    """
    spark = docs.sparkSession
    at = keep.index("text") if "text" in keep else len(keep)
    plain = docs.select(F.monotonically_increasing_id().alias("the_row"), F.lit(0).cast("long").alias("the_words"), F.array().cast("array<int>").alias("the_hits"), F.array().cast("array<string>").alias("the_items"), F.col("text").alias("the_text"))
    earlier: DataFrame | None = None

    def hits_of(shared) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for out in _search_batch(batch, 4, shared.value, True):
                    yield out.filter(pc.greater(pc.list_value_length(out.column(2)), 0)).select(["the_row", "the_hits", "the_items"])

        return written(plain.mapInArrow(search, "the_row long, the_hits array<int>, the_items array<string>"), "hits")

    last: Phrases | None = None
    for block in _item_blocks(benchmark, item_id, item_text):
        if last is not None:
            shared = spark.sparkContext.broadcast(last)  # BLOCK_BYTES of items, about
            found = hits_of(shared)
            shared.destroy()
            earlier = found if earlier is None else earlier.unionByName(found)
        last = phrases_of(block, window)
    shared = None if last is None else spark.sparkContext.broadcast(last)  # the same

    columns = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    columns += [] if "text" in keep else [F.col("text").alias("the_text")]
    rows = docs.select(*columns, F.lit(0).cast("long").alias("the_words"), F.monotonically_increasing_id().alias("the_row"))
    none = [F.array().cast("array<int>"), F.array().cast("array<string>")]
    if earlier is None:
        rows = rows.drop("the_row").select("*", none[0].alias("the_hits"), none[1].alias("the_items"))
    else:
        merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        earlier = earlier.groupBy("the_row").agg(merged("the_hits"), merged("the_items"))
        rows = rows.join(earlier, "the_row", "left").drop("the_row").withColumns({c: F.coalesce(c, n) for c, n in zip(("the_hits", "the_items"), none)})
    names, first = rows.columns, earlier is None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in _search_batch(batch, at, None if shared is None else shared.value, first):
                yield _cut(out, at, names.index("the_hits")) if cut else out

    return rows.mapInArrow(search, rows.schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add n_words, n_hit, items (array of item ids, as strings) and hit_words (places of hit words) to ``docs``.

    ``keep`` names the columns of ``docs`` to carry; ``text`` must be one of ``docs``.  The benchmark is
    read in blocks of BLOCK_BYTES, one pass over the shards for each; driver and tasks hold one at a time.
    With more than one, ``docs``' plan must read the same rows in the same partitions each time, as a table
    scan does.
    Every row of ``docs`` gives one row: copies and equal ids are searched alike.  A null or empty text
    has no words.  Items without words have no windows; an item with a null id hits words but isn't named.
    """
    keep = docs.columns if keep is None else keep
    found = _passes(docs, benchmark, window, keep, item_id, item_text, False)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("the_words").alias("n_words"), F.size("the_hits").cast("long").alias("n_hit"), F.col("the_items").alias("items"), F.col("the_hits").alias("hit_words"))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the merged spans of test passages; a text that has no word left is dropped.

    Texts without an occurrence, null and empty ones stay as they are.
    """
    found = _passes(docs, benchmark, window, docs.columns, item_id, item_text, True)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"]))
