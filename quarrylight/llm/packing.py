"""Best-fit sequence packing by a grouping genetic algorithm.

A document longer than a sequence is cut in full pieces, which are sequences of their own, and a rest.
All other pieces are dealt to islands of about ISLAND_SIZE pieces.  A chromosome of an island is its
grouping of pieces in bins.  Crossover injects whole well-filled bins of one parent in the other,
removes the bins that hold a piece twice and best-fits the pieces so displaced, longest first.  Between
epochs the best bins of an island migrate to the next one as patterns of lengths, which its own pieces
of equal lengths can fill.  Bins that stay badly filled are dealt anew and packed once more, so that
islands don't each leave a bin half empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.llm import tokens
from quarrylight.llm.runtime import written
from quarrylight.llm.textbytes import text_slices

ISLAND_SIZE = 12_000
POPULATION = 4
GENERATIONS = 16
ELITES = 256  # patterns that an island sends on
WELL_FILLED = 0.97

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
PACKED_SCHEMA = PIECE_SCHEMA + ", island int, bin long"


def cut_pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece; ``part`` and ``place`` name it uniquely."""
    path = tokenizer or tokens.default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            for piece in text_slices(batch.column(1)):
                ids, first = tokens.with_end(*tokens.encoder(path).encode(piece), end_id)
                sizes = np.diff(first)
                counts = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), counts)
                number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = number * capacity
                length = np.minimum(sizes[row] - start, capacity)
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip((first[row] + start).tolist(), length.tolist())]
                own = batch.column(0).slice(piece.first, len(piece))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": own.take(pa.array(row)), "piece": pa.array(number.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()),
                    "part": batch.column(2).slice(piece.first, len(piece)).take(pa.array(row)), "place": pa.array(place + np.arange(len(row))),
                })
                place += len(row)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part"))
    return rows.mapInArrow(cut, PIECE_SCHEMA)


class _BestFit:
    """Bins by free room.  ``rooms`` is a bit set of the rooms that some bin has."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.bins = capacity, 0, {}

    def put(self, room: int, name: int) -> None:
        if room:
            self.bins.setdefault(room, []).append(name)
            self.rooms |= 1 << room

    def take(self, length: int) -> tuple[int, int] | None:
        """The bin with the least room that holds ``length``, and the room it then has."""
        fits = self.rooms >> length
        if not fits:
            return None
        room = length + (fits & -fits).bit_length() - 1
        stack = self.bins[room]
        name = stack.pop()
        if not stack:
            self.rooms ^= 1 << room
        return name, room - length


def best_fit(lengths: np.ndarray, capacity: int, items: np.ndarray, bins: np.ndarray, fill: list[int]) -> None:
    """Put ``items``, in this order, in open bins or new ones.  bins and fill change in place."""
    state = _BestFit(capacity)
    for name, used in enumerate(fill):
        if used:
            state.put(capacity - used, name)
    sizes, chosen = lengths[items].tolist(), []
    for size in sizes:
        found = state.take(size)
        if found is None:
            found = len(fill), capacity - size
            fill.append(0)
        name, room = found
        fill[name] += size
        state.put(room, name)
        chosen.append(name)
    bins[items] = chosen


def _compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1]


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones: those leave a bin that can be emptied."""
    fill = np.bincount(bins, lengths) / capacity
    return -len(fill), float((fill**2).mean())


def _rebuild(lengths: np.ndarray, capacity: int, base: np.ndarray, injected: np.ndarray) -> np.ndarray:
    """Inject the bins of ``injected`` (-1: not injected) in ``base``; best-fit what loses its bin."""
    mine = injected >= 0
    touched = np.zeros(base.max() + 1, bool)
    touched[base[mine]] = True
    stay = ~touched[base] & ~mine
    bins = np.full(len(base), -1)
    bins[mine] = injected[mine]
    top = injected.max() + 1
    bins[stay] = base[stay] + top
    placed = bins >= 0
    fill = np.bincount(bins[placed], lengths[placed], minlength=1).astype(np.int64).tolist()
    left = np.flatnonzero(~placed)
    best_fit(lengths, capacity, left[np.argsort(-lengths[left], kind="stable")], bins, fill)
    return _compact(bins)


def crossover(lengths: np.ndarray, capacity: int, base: np.ndarray, donor: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(donor, lengths)
    good = np.flatnonzero(fill >= WELL_FILLED * capacity)
    if not len(good):
        return base
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, len(good) // 2), replace=False)] = True
    return _rebuild(lengths, capacity, base, np.where(chosen[donor], donor, -1))


def immigrate(lengths: np.ndarray, capacity: int, base: np.ndarray, patterns: list[list[int]]) -> np.ndarray:
    """Fill the patterns that this island's own pieces can make."""
    free: dict[int, list[int]] = {}
    for item in np.argsort(-lengths, kind="stable").tolist():
        free.setdefault(int(lengths[item]), []).append(item)
    injected, number = np.full(len(lengths), -1), 0
    for pattern in patterns:
        taken = []
        for size in pattern:
            if not free.get(size):
                break
            taken.append(free[size].pop())
        if len(taken) == len(pattern):
            injected[taken] = number
            number += 1
        else:
            for item in taken:
                free[int(lengths[item])].append(item)
    return _rebuild(lengths, capacity, base, injected) if number else base


def evolve(lengths: np.ndarray, capacity: int, seed: int, known: np.ndarray | None = None, patterns: list[list[int]] = ()) -> np.ndarray:
    """The best grouping found for one island."""
    rng = np.random.default_rng(seed)
    if not len(lengths):
        return np.zeros(0, np.int64)
    least = -(-int(lengths.sum()) // capacity)
    people = [] if known is None else [_compact(known)]
    if known is not None and len(patterns):
        people.append(immigrate(lengths, capacity, people[0], patterns))
    while len(people) < POPULATION:
        noise = 1 + (0.08 * len(people)) * rng.standard_normal(len(lengths))
        bins = np.full(len(lengths), -1)
        best_fit(lengths, capacity, np.argsort(-(lengths * noise), kind="stable"), bins, [])
        people.append(_compact(bins))
    scored = sorted(((fitness(lengths, x, capacity), k, x) for k, x in enumerate(people)), key=lambda y: (y[0], -y[1]), reverse=True)
    for turn in range(GENERATIONS):
        if -scored[0][0][0] <= least:
            break
        a, b = rng.choice(len(scored), 2, replace=False)
        child = crossover(lengths, capacity, scored[min(a, b)][2], scored[max(a, b)][2], rng)
        scored.append((fitness(lengths, child, capacity), POPULATION + turn, child))
        scored = sorted(scored, key=lambda y: (y[0], -y[1]), reverse=True)[:POPULATION]
    return scored[0][2]


def _ordered(group: pa.Table) -> pa.Table:
    return group.sort_by([("part", "ascending"), ("place", "ascending")])


def pack_pieces(pieces: DataFrame, capacity: int, island_size: int = ISLAND_SIZE, epochs: int = 2) -> DataFrame:
    """Add island and bin to pieces shorter than ``capacity``."""
    n = pieces.count()
    islands = max(1, -(-n // island_size))
    state = pieces.withColumn("island", F.pmod(F.xxhash64("part", "place"), F.lit(islands)).cast("int")).withColumn("bin", F.lit(0).cast("long"))

    def settle(group: pa.Table) -> pa.Table:
        group = _ordered(group)
        bins = evolve(group["length"].to_numpy(), capacity, group["island"][0].as_py())
        return group.set_column(group.schema.get_field_index("bin"), "bin", pa.array(bins.astype(np.int64)))

    def visit(group: pa.Table, visitors: pa.Table) -> pa.Table:
        if not len(group):
            return group
        group = _ordered(group)
        patterns = sorted(visitors["pattern"].to_pylist(), reverse=True)
        bins = evolve(group["length"].to_numpy(), capacity, group["island"][0].as_py() + 1, group["bin"].to_numpy(), patterns)
        return group.set_column(group.schema.get_field_index("bin"), "bin", pa.array(bins.astype(np.int64)))

    state = written(state.groupBy("island").applyInArrow(settle, PACKED_SCHEMA), "packed")
    for _ in range(epochs - 1 if islands > 1 else 0):
        filled = state.groupBy("island", "bin").agg(F.sum("length").alias("used"), F.sort_array(F.collect_list("length"), asc=False).alias("pattern"))
        rank = F.row_number().over(W.partitionBy("island").orderBy(F.desc("used"), "bin"))
        elites = filled.where(F.col("used") >= WELL_FILLED * capacity).withColumn("rank", rank).where(F.col("rank") <= ELITES)
        elites = elites.select(F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "pattern")
        state = written(state.groupBy("island").cogroup(elites.groupBy("island")).applyInArrow(visit, PACKED_SCHEMA), "packed")
    return state


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, island_size: int = ISLAND_SIZE) -> DataFrame:
    """Pack all documents: one row for each piece with its sequence and offset there.

    Null and empty texts are the end id alone.  Equal doc_ids and copies are packed row by row; a
    null doc_id stays null.  An empty table gives no rows.
    """
    pieces = written(cut_pieces(docs, capacity, end_id, tokenizer), "pieces")
    full = pieces.where(F.col("length") == capacity)
    first = pack_pieces(pieces.where(F.col("length") < capacity), capacity, island_size)
    by_bin = W.partitionBy("island", "bin")
    first = first.withColumn("used", F.sum("length").over(by_bin))
    done = first.where(F.col("used") >= WELL_FILLED * capacity).drop("used")
    again = pack_pieces(first.where(F.col("used") < WELL_FILLED * capacity).drop("used", "island", "bin"), capacity, island_size, 1)

    def named(df: DataFrame, stage: int) -> DataFrame:
        # two low bits name the stage, so that numbers of the three kinds never meet
        number = F.shiftleft(F.col("island").cast("long"), 33) + F.col("bin")
        at = F.sum("length").over(by_bin.orderBy("part", "place")) - F.col("length")
        return df.withColumn("sequence_id", F.shiftleft(number, 2) + stage).withColumn("offset", at)

    whole = F.shiftleft(F.shiftleft(F.col("part").cast("long"), 33) + F.col("place"), 2)
    out = full.withColumn("sequence_id", whole).withColumn("offset", F.lit(0).cast("long"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return out.select(columns).unionByName(named(done, 1).select(columns)).unionByName(named(again, 2).select(columns))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
