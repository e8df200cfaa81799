"""Token ids in a binary format of patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id (and, where many rows have one, of their texts'
beginnings), encoded, and written as *segments* in
ascending order of doc_id. A segment is one self-contained byte string:

    header   magic, ids a block, documents, ids, blocks          (4s + 4 x u64)
    tables   ends of the documents (u64), block starts (u64), block minima (u32),
             widths (u8), numbers of exceptions (u16)
    blocks   ids minus the block's minimum, packed at the width that holds
             ``PERCENTILE`` % of them; then its exception list: positions (u16)
             and full differences (u32)

The block-start table gives random access: a block is decoded from its own bytes.
Segments are rows of a Parquet dataset, so Spark's commit protocol writes them on any
file system: a lost executor leaves no half-written segment.

Scale: one range shuffle of the documents. A task holds one segment (``SEGMENT`` ids
and the document that crosses it). Positions over the whole table come from one
number a task, summed over tasks.

Null text is empty (end id alone). Null ids sort first; rows of equal id stand in
ascending order of text. Empty table: no segments, empty result. Other columns are
not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .tokens import encoder, vocabulary

BLOCK, PERCENTILE, SEGMENT, END_ID = 1024, 95, 2_000_000, 0
#: Of a text, what tells rows of one id apart when ranges are dealt.
RANGE_CHARS = 64
MAGIC, HEADER = b"PFR1", struct.Struct("<4s4Q")
SEGMENT_SCHEMA = "part int, base long, doc_ids array<long>, n_tokens long, payload binary"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack_bits(v: np.ndarray, width: int) -> np.ndarray:
    """(k, BLOCK) values below 2**width -> (k, 32 * width) words; value 32 i + lane of
    a block lies in the words of its lane."""
    k = len(v)
    v = v.reshape(k, BLOCK // 32, 32)
    out = np.zeros((k, width, 32), np.uint32)
    for i in range(BLOCK // 32):
        word, shift = divmod(i * width, 32)
        out[:, word] |= v[:, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= v[:, i] >> np.uint32(32 - shift)
    return out.reshape(k, 32 * width)


def unpack_bits(words: np.ndarray, width: int) -> np.ndarray:
    k = len(words)
    words = words.reshape(k, width, 32)
    out = np.empty((k, BLOCK // 32, 32), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(BLOCK // 32):
        word, shift = divmod(i * width, 32)
        x = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            x = x | words[:, word + 1] << np.uint32(32 - shift)
        out[:, i] = x & mask
    return out.reshape(k, BLOCK)


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def write_segment(documents: list[bytes]) -> bytes:
    """Documents' ids (little-endian u32 each) as one segment."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    ends = np.cumsum([len(d) // 4 for d in documents], dtype=np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    v = np.concatenate([ids, np.repeat(ids[-1:], blocks * BLOCK - n)]).reshape(blocks, BLOCK)
    low = v.min(axis=1) if blocks else np.zeros(0, np.uint32)
    v = v - low[:, None]
    rank = -(-BLOCK * PERCENTILE // 100) - 1
    widths = bit_length(np.partition(v, rank, axis=1)[:, rank]) if blocks else np.zeros(0, np.int64)
    over = bit_length(v) > widths[:, None] if blocks else np.zeros((0, BLOCK), bool)
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        if w:
            words = pack_bits(v[own] & np.uint32((1 << int(w)) - 1), int(w))
            for i, x in zip(own, words, strict=True):
                packed[i] = x.tobytes()
    row, at = np.nonzero(over)
    misses = np.bincount(row, minlength=blocks)
    first = np.append(0, np.cumsum(misses))
    at, value = at.astype("<u2"), v[over].astype("<u4")
    body = [packed[i] + at[first[i] : first[i + 1]].tobytes() + value[first[i] : first[i + 1]].tobytes() for i in range(blocks)]
    starts = np.cumsum([0, *map(len, body)], dtype=np.uint64)[:-1]
    head = HEADER.pack(MAGIC, BLOCK, len(documents), n, blocks)
    return b"".join([head, ends.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), low.astype("<u4").tobytes(), widths.astype("u1").tobytes(), misses.astype("<u2").tobytes(), *body])


class Segment:
    """Reader of one segment's bytes."""

    def __init__(self, data: bytes):
        magic, block, docs, self.n, self.blocks = HEADER.unpack_from(data)
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a segment of this format")
        at = HEADER.size

        def column(kind: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, count, at)
            at += x.nbytes
            return x

        self.ends = column("<u8", docs)
        self.starts, self.low = column("<u8", self.blocks), column("<u4", self.blocks)
        self.widths, self.misses = column("u1", self.blocks), column("<u2", self.blocks)
        self.data, self.body = data, at

    def block(self, i: int) -> np.ndarray:
        """Ids of one block, from its own bytes."""
        return self.some(np.array([i]))[0][: min(BLOCK, self.n - i * BLOCK)]

    def some(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), BLOCK), np.uint32)
        for w in np.unique(self.widths[which]):
            own = np.flatnonzero(self.widths[which] == w)
            if w:
                words = np.stack([np.frombuffer(self.data, "<u4", 32 * int(w), self.body + int(self.starts[which[j]])) for j in own])
                out[own] = unpack_bits(words, int(w))
        for j in np.flatnonzero(self.misses[which]):
            i = which[j]
            k, at = int(self.misses[i]), self.body + int(self.starts[i]) + 128 * int(self.widths[i])
            out[j, np.frombuffer(self.data, "<u2", k, at)] = np.frombuffer(self.data, "<u4", k, at + 2 * k)
        return out + self.low[which][:, None]

    def ids(self) -> np.ndarray:
        return self.some(np.arange(self.blocks)).reshape(-1)[: self.n]


def write_tokens(documents: DataFrame, vocabulary_path: str, end_id: int = END_ID) -> DataFrame:
    """Encode all documents into segments; returns the written dataset."""

    def run(batches):
        words = encoder(vocabulary_path)
        end = np.array([end_id], "<u4").tobytes()
        part, base = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[bytes] = []
        tokens = 0

        def flush():
            nonlocal ids, held, tokens, base
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([base], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([tokens], pa.int64()), pa.array([write_segment(held)], pa.binary())],
                names=["part", "base", "doc_ids", "n_tokens", "payload"],
            )
            base += tokens
            ids, held, tokens = [], [], 0
            return row

        for batch in batches:
            for at in range(0, len(batch), 2048):
                some = batch.slice(at, 2048)
                doc_ids, texts = some.column(0).to_pylist(), some.column(1).to_pylist()
                for doc_id, x in zip(doc_ids, words.encode([t or "" for t in texts]), strict=True):
                    ids.append(doc_id)
                    held.append(x + end)
                    tokens += len(held[-1]) // 4
                    if tokens >= SEGMENT:
                        yield flush()
        if held:
            yield flush()

    rows = documents.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    return materialize(rows.mapInArrow(run, SEGMENT_SCHEMA), "segments")


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start over the whole table, number and crc32 of ids of every document."""

    def run(batches):
        for batch in batches:
            for before, base, doc_ids, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                s = Segment(payload)
                raw, ends = s.ids().astype("<u4").tobytes(), s.ends.astype(np.int64)
                starts = np.append(0, ends[:-1])
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + before + base), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    # One row a writing task, summed in order of the ranges.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("own").over(order), F.lit(0)).alias("before"))
    rows = segments.join(F.broadcast(before), "part").select("before", "base", "doc_ids", "payload")
    return rows.mapInArrow(run, SCHEMA)


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))
