"""Cost-balanced packing of documents into training sequences.

Every piece of a document costs ``linear * n + quadratic * n * n`` (attention within
a piece). A task streams its documents in chunks of ``chunk_sequences`` sequences
and packs a chunk in descending order of length: each document goes to the sequence
of lowest cost among those with enough tokens left; where none has, the document is
cut at the capacity of the sequence of lowest cost with any left. Documents longer
than a sequence fill whole sequences first. The document at a chunk's end is cut
there and its rest opens the next chunk, so only a task's last sequence has padding.

Scale: one scan, no shuffle; a task holds one chunk's ids. Sequence ids are the task's
partition in the high bits and a running number in the low 32, so they never meet.

Null text is empty (its document is the end id alone). Null ids and repeated rows are
packed row by row. An empty table gives no piece. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import give_back, table
from .tokens import MAX_CHUNKS, encoder, vocabulary

SEQUENCE, END_ID, CHUNK_SEQUENCES = 2048, 1, 512
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def assign(lengths: list[int], capacity: int, bins: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pack items into ``bins`` sequences whose capacities hold them all: pieces as
    (item, start within the item, length, sequence, offset in the sequence)."""
    out = []
    left = np.full(bins, capacity, np.int64)
    cost = np.zeros(bins)
    used = 0  # sequences below this number are filled by whole cuts of long items
    rest = []
    for i, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            out.append((i, at, capacity, used, 0))
            left[used] = 0
            used += 1
            at += capacity
        if n > at:
            rest.append((n - at, i, at))
    left, cost = left[used:], cost[used:]
    for n, i, at in sorted(rest, key=lambda x: (-x[0], x[1])):
        while n:
            fits = left >= n
            open_ = fits if fits.any() else left > 0
            b = int(np.where(open_, cost, np.inf).argmin())
            take = min(n, int(left[b]))
            out.append((i, at, take, used + b, capacity - int(left[b])))
            left[b] -= take
            cost[b] += linear * take + quadratic * take * take
            at, n = at + take, n - take
    return out


def pack(documents: DataFrame, vocabulary_path: str, end_id: int = END_ID, capacity: int = SEQUENCE, chunk_sequences: int = CHUNK_SEQUENCES, with_ids: bool = False, remember: int = MAX_CHUNKS) -> DataFrame:
    """Pieces of all documents; with_ids adds each piece's ids as little-endian
    unsigned 32-bit integers (column ``ids``). A worker remembers up to ``remember``
    chunks of text and their ids, within a task only if that is below the default: less
    memory for more time, which changes no result."""

    def run(batches):
        words = encoder(vocabulary_path)
        words.limit = remember
        end = np.array([end_id], "<u4").tobytes()
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int | None, int, bytes, int]] = []  # id, start, ids, tokens of the document
        tokens = 0

        def flush(last: bool):
            nonlocal held, tokens, made
            bins = -(-tokens // capacity) if last else tokens // capacity
            keep = None
            if not last and (over := tokens - bins * capacity):
                doc_id, start, ids, n = held[-1]
                cut = len(ids) // 4 - over
                held[-1], keep = (doc_id, start, ids[: 4 * cut], n), (doc_id, start + cut, ids[4 * cut :], n)
            rows = []
            for i, at, n, seq, offset in assign([len(x[2]) // 4 for x in held], capacity, bins):
                doc_id, start, ids, total = held[i]
                own = ids[4 * at : 4 * (at + n)]
                rows.append((doc_id, start + at, n, zlib.crc32(own), total, base + made + seq, offset, *((own,) if with_ids else ())))
            made += bins
            held, tokens = ([keep], len(keep[2]) // 4) if keep else ([], 0)
            columns = list(zip(*rows, strict=True)) if rows else [()] * (len(_COLUMNS) + with_ids)
            arrays = [pa.array(c, pa.int64()) for c in columns[: len(_COLUMNS)]] + [pa.array(c, pa.binary()) for c in columns[len(_COLUMNS) :]]
            return pa.RecordBatch.from_arrays(arrays, names=[*_COLUMNS, *(["ids"] if with_ids else [])])

        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                doc_ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for doc_id, ids in zip(doc_ids, words.encode([t or "" for t in texts]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    held.append((doc_id, 0, ids, n))
                    tokens += n
                    # The last document alone may pass the mark, so cutting it is enough.
                    if tokens >= chunk_sequences * capacity:
                        yield flush(False)
        while tokens:
            yield flush(tokens < capacity * chunk_sequences)
        if remember < MAX_CHUNKS:
            words.forget()
        give_back()

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
