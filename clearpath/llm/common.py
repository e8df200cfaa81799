"""Scratch tables and small helpers that the operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_own_roots: dict[str, str] = {}
_made: ContextVar[list[str] | None] = ContextVar("scratch tables of the innermost scope", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it
    is set; otherwise, in local mode only, a temporary folder of this application."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/") + "/clearpath"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="clearpath-")
    return _own_roots[app]


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return a scan of it.

    This cuts the lineage: a lost executor costs a re-read of committed files, and
    what reads the table later sees columns pruned and filters pushed down. Within
    ``scratch_tables`` the table goes at the end of the scope, unless it is to be kept."""
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = _made.get()
    if made is not None and not keep:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_tables(spark: SparkSession):
    """Scratch tables made inside, and by no other caller, are deleted at the end: write
    every result that rests on them before."""
    made: list[str] = []
    outer = _made.set(made)
    try:
        yield
    finally:
        _made.reset(outer)
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: Column | str) -> Column:
    """Names a text, for decisions and samples that are about rows rather than ids."""
    return F.md5(F.coalesce(text, F.lit("")))


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores more as no column of that name takes."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def hash_sample(rows: DataFrame, key: str, by: str, limit: int) -> DataFrame:
    """``rows`` with the ``limit`` smallest ``key`` (lower-case hex of a uniform hash, no
    two alike) of each value of ``by``; null is no value. A share of the keys that holds
    a little more than ``limit`` rows, by the rows counted, is taken before the ranks, so
    the ranking tasks get no more than that however many tasks read the table. The counts
    are broadcast: ``by`` has few values (labels, languages that one model knows)."""
    count = rows.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    place = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 2.0**32
    some = rows.join(F.broadcast(count), F.col(by) == F.col("_by")).filter(place < (limit + 8 * limit**0.5 + 50) / F.col("_n"))
    order = Window.partitionBy("_by").orderBy(key)
    return some.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit).drop("_by", "_n", "_rank")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: int) -> int:
    """crc32 of an id as decimal text; folds of the labelled operators use it."""
    return zlib.crc32(str(doc_id).encode())


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def joined_bytes(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one UTF-8 byte array, each followed by ``pad`` zero bytes, and
    the start of each. Windows of up to ``pad + 1`` bytes never hold two texts' letters."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(p) + pad for p in parts), np.int64, len(parts))
    starts = np.zeros(len(parts), np.int64)
    np.cumsum(sizes[:-1], out=starts[1:])
    end = b"\0" * pad
    return np.frombuffer(end.join(parts) + end, np.uint8), starts


def give_back() -> None:
    """Return what a task has freed to the system. Workers live on between stages, and
    allocators would keep it for them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(texts: list[str], limit: int = 4_000_000):
    """Cut a batch into runs of rows whose texts have about ``limit`` characters, so
    that array work on a batch of very long texts stays within memory."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
