"""Token-ID output in a Simple-8b container.

Ids are packed in 64-bit words: four selector bits name how many ids share the other sixty bits.
Blocks hold up to BLOCK ids and start on a word of their own, so the word offset of each block lets
a reader decode any block alone and all words of a segment at once.  An id of more than sixty bits is
escaped: its word has selector ESCAPE and the index of the raw value in the segment's escape list.

A segment is one row of the written table: shard, segment, n_docs, n_ids and a payload of

    magic "QS8B", version, n_docs, n_ids, n_blocks, n_words, n_escapes  (little-endian)
    doc ids (int64), doc null flags (uint8), doc lengths (int64),
    block word offsets (uint32), words (uint64), escapes (uint64)

Shards are ranges of doc_id in ascending order; so are the documents of a segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.llm import tokens
from quarrylight.llm.runtime import shared_dir
from quarrylight.llm.textbytes import text_slices

# Simple-8b selectors: how many ids a word holds, and of how many bits.  Selector 1 is the escape.
COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 1
BLOCK = 1024
MAGIC, VERSION = b"QS8B", 1
HEAD = struct.Struct("<4sIQQQQQ")


_SHORT_WIDTH = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    if not len(values) or values.max() < 1 << 16:
        return _SHORT_WIDTH[values]
    out = np.zeros(values.shape, np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        high = values >> np.uint64(shift)
        take = high > 0
        out[take] += shift
        values = np.where(take, high, values)
    return out + (values > 0).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word offset of each block (one more at the end) and the escaped values."""
    ids = np.ascontiguousarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    flat = np.zeros((blocks + 1) * BLOCK, np.uint64)
    flat[: len(ids)] = ids
    width = np.zeros((blocks, BLOCK + 240), np.uint8)
    width[:, :BLOCK] = _widths(flat[: blocks * BLOCK]).reshape(blocks, BLOCK)
    best = np.where(width[:, :BLOCK] > 60, np.uint8(ESCAPE), np.uint8(15))
    peak = {1: width}

    def widest(count: int, a: int, b: int) -> np.ndarray:
        """Largest width among ``count`` = a + b ids from each place on."""
        out = peak[a].copy()
        np.maximum(out[:, :-a], peak[b][:, a:], out=out[:, :-a])
        peak[count] = out
        return out[:, :BLOCK]

    for count, a, b in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 3, 2), (6, 3, 3), (7, 4, 3), (8, 4, 4), (10, 5, 5), (12, 6, 6), (15, 8, 7), (20, 10, 10), (30, 15, 15), (60, 30, 30), (120, 60, 60), (240, 120, 120)):
        most = widest(count, a, b)
        selector = np.flatnonzero(COUNTS == count)
        if len(selector):
            fits = most <= BITS[selector[0]]
            if not fits.any() and count > 3:
                break
            best[fits] = selector[0]
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = len(ids) - (blocks - 1) * BLOCK
    at, live = np.zeros(blocks, np.int64), np.arange(blocks)
    block_of, place, chosen = [], [], []
    while len(live):
        p = at[live]
        s = best[live, p]
        block_of.append(live)
        place.append(p)
        chosen.append(s)
        p = p + COUNTS[s]
        at[live] = p
        live = live[p < lengths[live]]
    block_of, place, chosen = map(np.concatenate, (block_of, place, chosen))
    order = np.argsort(block_of, kind="stable")
    block_of, place, chosen = block_of[order], place[order], chosen[order]
    words = chosen.astype(np.uint64) << np.uint64(60)
    start = block_of * BLOCK + place
    for s in range(16):
        mine = np.flatnonzero(chosen == s)
        if not len(mine) or s in (0, ESCAPE):
            continue
        c, bits = int(COUNTS[s]), int(BITS[s])
        # past the end of a block the ids of the next one would follow: they count as zero
        room = BLOCK - place[mine]
        for j in range(c):
            words[mine] |= np.where(j < room, flat[start[mine] + j], np.uint64(0)) << np.uint64(j * bits)
    mine = np.flatnonzero(chosen == ESCAPE)
    words[mine] |= np.arange(len(mine), dtype=np.uint64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(block_of, minlength=blocks))]).astype(np.uint32)
    return words, offsets, flat[start[mine]]


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n_ids: int) -> np.ndarray:
    """All ids of the blocks, every word at once."""
    out = np.zeros(n_ids, np.uint64)
    if not n_ids:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    ends = np.cumsum(counts)
    base = np.concatenate([[0], ends])[offsets[:-1].astype(np.int64)]
    start = ends - counts - base[block] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n_ids)
    for s in range(1, 16):
        mine = np.flatnonzero(selector == s)
        if not len(mine):
            continue
        if s == ESCAPE:
            out[start[mine]] = escapes[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        bits = int(BITS[s])
        low = np.uint64((1 << bits) - 1)
        for j in range(int(COUNTS[s])):
            to = start[mine] + j
            fits = to < stop[mine]
            out[to[fits]] = (words[mine[fits]] >> np.uint64(j * bits)) & low
    return out


def write_segment(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, escapes = pack(ids)
    head = HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), len(offsets) - 1, len(words), len(escapes))
    parts = (doc_ids.astype("<i8"), nulls.astype("u1"), lengths.astype("<i8"), offsets.astype("<u4"), words.astype("<u8"), escapes.astype("<u8"))
    return head + b"".join(x.tobytes() for x in parts)


def read_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Doc ids, null flags, lengths and all ids."""
    magic, version, n_docs, n_ids, n_blocks, n_words, n_escapes = HEAD.unpack_from(payload)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token segment")
    at, out = HEAD.size, []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<i8", n_docs), ("<u4", n_blocks + 1), ("<u8", n_words), ("<u8", n_escapes)):
        out.append(np.frombuffer(payload, kind, n, at))
        at += out[-1].nbytes
    doc_ids, nulls, lengths, offsets, words, escapes = out
    return doc_ids, nulls.astype(bool), lengths, unpack(words, offsets, escapes, n_ids)


SEGMENT_SCHEMA = "shard int, segment int, n_docs long, n_ids long, payload binary"


def encode_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Tokenise ``docs`` in ascending id order to segment rows.

    Null and empty texts become the end id alone.  Rows with equal ids keep all their copies, in the
    order of their texts; a null id sorts first.  Ranges are cut by id, text hash and row position,
    so neither a repeated id nor copies of a text meet in one task.  An empty table gives no segment.
    """
    path = tokenizer or tokens.default_path()
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.monotonically_increasing_id().alias("at"))
    order = [F.col("id"), F.xxhash64("text"), F.col("at")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("shard"), "id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = 0
        for batch in batches:
            shard, ids = batch.column(0), batch.column(1)
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for piece in text_slices(batch.column(2)):
                enc, first = tokens.with_end(*tokens.encoder(path).encode(piece), end_id)
                own = slice(piece.first, piece.first + len(piece))
                payload = write_segment(ids[own], nulls[own], np.diff(first), enc)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard[0].as_py()], pa.int32()), "segment": pa.array([segment], pa.int32()), "n_docs": [len(piece)], "n_ids": [len(enc)], "payload": pa.array([payload], pa.binary())})
                segment += 1

    return ranged.mapInArrow(encode, SEGMENT_SCHEMA)


def write_documents(docs: DataFrame, path: str, **options) -> None:
    encode_documents(docs, **options).write.option("compression", "uncompressed").parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of a written path; the ids too if asked for.

    Starts come from a running sum over shards and segments: one row for about 2 MB of text.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inner = segments.select("shard", "segment", "n_ids").withColumn("start", F.sum("n_ids").over(W.partitionBy("shard").orderBy("segment")) - F.col("n_ids"))
    starts = inner.join(shards, "shard").select("shard", "segment", (F.col("start") + F.col("shard_start")).alias("start"))
    schema = "shard int, segment int, doc_id long, place long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, payload in zip(batch.column(0), batch.column(1), batch.column(4)):
                doc_ids, nulls, lengths, ids = read_segment(payload.as_py())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").view(np.uint8)) if len(ids) else memoryview(b"")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                out = {"shard": pa.array(np.full(len(ends), shard.as_py(), np.int32)), "segment": pa.array(np.full(len(ends), segment.as_py(), np.int32)), "doc_id": pa.array(doc_ids, mask=nulls), "place": pa.array(ends - lengths), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)

    found = segments.mapInArrow(decode, schema)
    extra = ["ids"] if with_ids else []
    return found.join(starts, ["shard", "segment"]).select("doc_id", (F.col("start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *extra)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_documents(spark, path)
