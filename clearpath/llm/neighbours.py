"""Approximate nearest neighbours by cross-polytope hashing.

The nearness is the largest inner product. Vectors get one more coordinate that makes
all lengths equal (the longest vector's; a query's is zero), and are padded to a power
of two, so that nearness is an angle. Each of ``tables`` hashes a vector by two
pseudo-rotations (each three rounds of random signs and a fast Hadamard transform): its
*cell* is the pair of signed axes nearest to it, one of 4 * padded dimension**2. A query
scores a cell by the sum of its products with the cell's two axes, and probes the cells
in that order down to a limit, set so that they hold a share of all vectors. The limit
is a quantile over ``SAMPLE`` cells drawn by their sizes; every vector is indexed. The share
is not a formula: it is fitted before the probe. ``TRIALS`` queries are answered by brute
force, which is one scan, and the share is the least at which ``RECALL`` of their true
neighbours lie in a probed cell; so it grows where the data are harder or more. A share of 1
probes every cell and is exact. The vectors of the probed cells are
reranked exactly, in double precision, on the original components.

Scale: cells, in order and cut by the sizes counted before, make *regions* of vectors
with ``REGION`` components, so a cell with a third of all vectors spreads over many tasks
and small ones share one. A vector goes to one region a table, a query once to each region that holds
probed cells, whatever their number; within a region only probed cells are reranked.
Queries of a region are dealt into groups of ``QUERIES``. The driver sees the
longest vector's length, the dimension, the sizes of cells, and the trial queries with
their neighbours: a fixed number.

Vectors that are null, zero, empty or hold null or non-finite components take no part;
only vectors of the table's largest dimension do. Null ids take no part. Rows that
repeat an id are one candidate each; a query is not its own neighbour under its id.
Equal scores go to the smaller id. Fewer than ``k`` candidates: all those found. Empty
table: empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

K, QUERY_EVERY = 20, 20
TABLES, SAMPLE = 4, 4096
#: Components of the vectors of a region (32 MB as doubles), and queries that meet them at a time.
REGION, QUERIES = 1 << 22, 4096
#: Queries that brute force answers to fit the share, the recall they shall reach, and the
#: least number of vectors that a table's probes reach.
TRIALS, RECALL, LEAST = 128, 0.96, 384
SCHEMA = "query_id long, rank int, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, of unit scale."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def axes(x: np.ndarray, t: int) -> np.ndarray:
    """Nearness of the rows to the 2n signed axes of table t."""
    signs = np.random.default_rng([20150909, t])
    for _ in range(3):
        x = hadamard(x * signs.choice([-1.0, 1.0], x.shape[1]))
    return np.concatenate([x, -x], axis=1)


def lifted(x: np.ndarray, longest: float, queries: bool) -> np.ndarray:
    """Rows of equal length whose angles follow inner products, padded to 2**i."""
    n = x.shape[1] + 1
    out = np.zeros((len(x), 1 << (n - 1).bit_length()))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    out[:, : n - 1] = x / (np.where(norm > 0, norm, 1) if queries else longest)
    if not queries:
        out[:, n - 1] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / longest) ** 2))
    return out


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows; equal vectors give equal scores."""
    return (x * y).sum(axis=1)


def best(query_ids, queries, vec_ids, vectors, k: int) -> pd.DataFrame:
    """Each query's k best of these vectors, its own id left out, ties to smaller ids."""
    s = queries @ vectors.T
    s[query_ids[:, None] == vec_ids[None, :]] = -np.inf
    if s.shape[1] > k:
        kth = np.partition(s, -k, axis=1)[:, -k]
        near = s >= (kth - 1e-9 * (1 + np.abs(kth)))[:, None]  # all that rounding could place among the k
    else:
        near = np.ones(s.shape, bool)
    i, j = np.nonzero(near & np.isfinite(s))
    score = exact(queries[i], vectors[j])
    order = np.lexsort((vec_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    keep = rank < k
    return pd.DataFrame({"query_id": query_ids[i[keep]], "vec_id": vec_ids[j[keep]], "score": score[keep]})


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v of the vectors that take part."""
    v = rows.filter("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return v.filter((F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0))


def cell_axes(x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearness of the rows to the axes of the two rotations of table t."""
    return axes(x, 2 * t), axes(x, 2 * t + 1)


def cells(x: np.ndarray, t: int) -> np.ndarray:
    first, second = cell_axes(x, t)
    return first.argmax(axis=1) * first.shape[1] + second.argmax(axis=1)


class Index:
    """Sizes of all cells, the regions they lie in, and where queries stop probing."""

    def __init__(self, sizes: np.ndarray, longest: float, group: int, share: float | None = None):
        self.longest, self.side, self.share = longest, int(round(sizes.shape[1] ** 0.5)), share
        self.n = int(sizes[0].sum())
        after = np.cumsum(sizes, axis=1)
        self.first = ((after - sizes) // group).astype(np.int32)
        self.last = (np.maximum(after - 1, after - sizes) // group).astype(np.int32)
        rnd = np.random.default_rng(1)
        self.sample = [np.searchsorted(a, rnd.integers(0, a[-1], SAMPLE), "right").astype(np.int32) if a[-1] else np.zeros(1, np.int32) for a in after]

    def fit(self, queries: np.ndarray, near: list[np.ndarray], recall: float, least: int) -> None:
        """The least share at which so many of the queries' neighbours (cells by table) are probed."""
        needed = []
        if not len(queries):
            self.share = 1.0
            return
        x, tables = lifted(queries, self.longest, True), len(self.sample)
        scores = [cell_axes(x, t) for t in range(tables)]
        for q, cells_ in enumerate(near):
            best = np.ones(len(cells_))
            for t in range(tables):
                one, two = scores[t][0][q], scores[t][1][q]
                drawn = np.sort(one[self.sample[t] // self.side] + two[self.sample[t] % self.side])
                own = one[cells_[:, t] // self.side] + two[cells_[:, t] % self.side]
                above = len(drawn) - np.searchsorted(drawn, own - 1e-12)  # drawn cells probed before this one is, or with it
                best = np.minimum(best, (above + 1) / len(drawn))
            needed.append(best)
        every = np.sort(np.concatenate(needed)) if needed else np.zeros(0)
        share = every[min(len(every) - 1, int(np.ceil(recall * len(every))))] if len(every) else 1.0
        self.share = float(min(1.0, max(share, least / max(self.n, 1))))

    def limits(self, one: np.ndarray, two: np.ndarray, t: int) -> np.ndarray:
        """The score down to which each query probes table t."""
        if self.share >= 1:
            return np.full(len(one), -np.inf)
        score = one[:, self.sample[t] // self.side] + two[:, self.sample[t] % self.side]
        k = max(1, min(score.shape[1], int(np.ceil(self.share * score.shape[1]))))
        return np.partition(score, -k, axis=1)[:, -k]

    def probed(self, one: np.ndarray, two: np.ndarray, limit: float, t: int) -> np.ndarray:
        """Regions of table t that hold the cells a query probes."""
        order = np.argsort(two)
        count = len(two) - np.searchsorted(two[order], limit - one)  # second axes to probe with each first axis
        total = int(count.sum())
        place = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        cell = np.repeat(np.arange(len(one)), count) * self.side + order[len(two) - 1 - place]
        first, last = self.first[t, cell], self.last[t, cell]
        wide = np.flatnonzero(last > first)
        return np.unique(np.concatenate([first, *(np.arange(first[i], last[i] + 1) for i in wide)]))


def near_in_region(queries: pd.DataFrame, found: pd.DataFrame, t: int, longest: float, k: int) -> pd.DataFrame:
    """Each query's k best among the vectors of the cells that it probes."""
    q, q_ids = np.stack(queries["v"].to_numpy()).astype(np.float64), queries["vec_id"].to_numpy()
    found = found.sort_values("cell", kind="stable")
    v, v_ids, cell = np.stack(found["v"].to_numpy()).astype(np.float64), found["vec_id"].to_numpy(), found["cell"].to_numpy()
    own, start = np.unique(cell, return_index=True)
    size = np.diff(np.append(start, len(cell)))
    one, two = cell_axes(lifted(q, longest, True), t)
    limit, out = queries["limit"].to_numpy(), []
    for i in range(len(q)):
        mine = np.flatnonzero(one[i, own // one.shape[1]] + two[i, own % one.shape[1]] >= limit[i])
        n = size[mine]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[mine], n)
        if len(at):
            out.append(best(q_ids[i : i + 1], q[i : i + 1], v_ids[at], v[at], k))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def trials(stored: DataFrame, asked: DataFrame, k: int, count: int = TRIALS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Some queries, drawn by hash, and the cells of the k true neighbours of each: one scan
    in which a task keeps its k best, and a merge of those."""
    drawn = asked.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(count).toPandas()
    if not len(drawn):
        return np.zeros((0, 1)), []
    q, q_ids = np.stack(drawn["v"].to_numpy()).astype(np.float64), drawn["vec_id"].to_numpy()
    tables = len(stored.select("cells").first()[0])

    def scan(batches):
        kept = pd.DataFrame({"i": [], "score": [], "vec_id": [], "cells": []})
        for batch in batches:
            if not len(batch):
                continue
            s = q @ np.stack(batch["v"].to_numpy()).astype(np.float64).T
            s[q_ids[:, None] == batch["vec_id"].to_numpy()[None, :]] = -np.inf
            near = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            i = np.repeat(np.arange(len(q)), near.shape[1])
            j = near.ravel()
            new = pd.DataFrame({"i": i, "score": s[i, j], "vec_id": batch["vec_id"].to_numpy()[j], "cells": batch["cells"].to_numpy()[j]})
            kept = pd.concat([kept, new[np.isfinite(new["score"])]]) if len(kept) else new[np.isfinite(new["score"])]
            kept = kept.sort_values("score", ascending=False, kind="stable").groupby("i").head(k)
        yield kept.astype({"i": "int64", "score": "float64", "vec_id": "int64"})

    best = stored.mapInPandas(scan, "i long, score double, vec_id long, cells array<int>")
    order = Window.partitionBy("i").orderBy(F.desc("score"), "vec_id")
    near = best.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).select("i", "cells").toPandas()
    rows = {i: np.stack(x["cells"].to_numpy()) for i, x in near.groupby("i")}
    return q, [rows.get(i, np.zeros((0, tables), np.int32)) for i in range(len(q))]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, tables: int = TABLES, share: float | None = None, recall: float = RECALL, least: int = LEAST, region: int = REGION, group: int = QUERIES) -> DataFrame:
    """``vectors`` and ``queries``: vec_id, embedding. query_id, rank, vec_id, score. A
    ``share`` is fitted to ``recall`` unless it is given; 1 is exact."""
    rows = materialize(usable(vectors), "vectors")
    dim, longest = rows.select(F.size("v").alias("d"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("s")).groupBy("d").agg(F.max("s").alias("s")).orderBy(F.desc("d")).select("d", F.sqrt("s")).first() or (1, 1.0)
    asked = usable(queries).filter(F.size("v") == dim)
    rows = rows.filter(F.size("v") == dim)
    kind = rows.schema["v"].dataType.simpleString()

    def hashed(batches):
        for batch in batches:
            if len(batch):
                x = lifted(np.stack(batch["v"].to_numpy()).astype(np.float64), longest, False)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "v": batch["v"], "cells": list(np.stack([cells(x, t) for t in range(tables)], axis=1).astype(np.int32))})

    stored = materialize(rows.mapInPandas(hashed, f"vec_id long, v {kind}, cells array<int>"), "cells")
    side = 2 << int(dim).bit_length()
    sizes = np.zeros((tables, side * side), np.int64)
    counted = stored.select(F.posexplode("cells").alias("t", "cell")).groupBy("t", "cell").count().toPandas()  # a fixed number of cells
    sizes[counted["t"], counted["cell"]] = counted["count"]
    index = Index(sizes, longest, max(1, region // dim), share)
    if share is None:
        index.fit(*trials(stored, asked, k), recall, least)
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def placed(batches):
        for batch in batches:
            index, h = shared.value, batch["h"].to_numpy()
            for t in range(tables):
                cell = np.array([c[t] for c in batch["cells"]], np.int64)
                first = index.first[t, cell]
                yield pd.DataFrame({"t": t, "region": first + h % (index.last[t, cell] - first + 1), "cell": cell, "limit": 0.0, "vec_id": batch["vec_id"], "v": batch["v"], "is_query": False})

    def probing(batches):
        for batch in batches:
            if not len(batch):
                continue
            index, v = shared.value, batch["v"].to_numpy()
            x = lifted(np.stack(v).astype(np.float64), longest, True)
            for t in range(tables):
                one, two = cell_axes(x, t)
                limit = index.limits(one, two, t)
                regions = [index.probed(one[i], two[i], limit[i], t) for i in range(len(x))]
                i = np.repeat(np.arange(len(x)), list(map(len, regions)))
                yield pd.DataFrame({"t": t, "region": np.concatenate(regions), "cell": 0, "limit": limit[i], "vec_id": batch["vec_id"].to_numpy()[i], "v": v[i], "is_query": True})

    row = f"t int, region int, cell int, limit double, vec_id long, v {kind}, is_query boolean"
    h = F.abs(F.xxhash64("vec_id", "v") % 1_000_003)
    left = stored.select("vec_id", "v", "cells", h.alias("h")).mapInPandas(placed, row)
    right = materialize(asked.mapInPandas(probing, row), "probes")
    parts = right.groupBy("t", "region").agg(F.ceil(F.count("*") / group).cast("int").alias("parts"))
    deal = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = left.join(parts, ["t", "region"]).withColumn("part", deal).drop("parts")
    right = right.join(parts, ["t", "region"]).withColumn("part", (F.abs(F.xxhash64("vec_id") % 1_000_003) % F.col("parts")).cast("int")).drop("parts")

    def rerank(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        q, c = group[group["is_query"]], group[~group["is_query"]]
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return near_in_region(q, c, int(key[0]), longest, k)

    found = left.unionByName(right).groupBy("t", "region", "part").applyInPandas(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter(f"vec_id % {QUERY_EVERY} = 0"))
