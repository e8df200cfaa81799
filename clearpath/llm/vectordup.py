"""Near-duplicate embeddings: product quantisation over coarse inverted lists.

Two vectors of one label are linked if their cosine, in double precision, is ``least``
(0.93) or more. On unit vectors that is a distance of at most r = sqrt(2 - 2 * least).

1. Rows equal in label and vector are one *node* with a weight; copies are never paired.
2. A bounded sample gives a coarse codebook of unit centroids and, for the residuals
   from them, a codebook of 256 words for each subspace of 4 dimensions. Every node is
   indexed: it has a list (its nearest centroid), residual codes, and the distance
   between it and what its codes say (its error).
3. Probes suffice by geometry, not by luck: with u in list a and v in list b,
   u.(a - b) + v.(b - a) = (u - v).(a - b) <= r |a - b| if they are linked, so one of the
   two terms is at most r |a - b| / 2. A node probes each list b for which its own term is,
   so at least one node of each linked pair probes the other's list. A pair that both
   probe is taken from one side only.
4. Within a probed list the distance of the query to a vector's codes is looked up from a
   table of products by subspace and word (asymmetric: the query is not quantised). By the
   triangle inequality a linked vector lies within r + its error; only those are candidates.
5. Candidates get the exact cosine. A task counts links by weight, and from its links
   keeps a star for each part that they join; those give the components.

So no link is lost whatever the data; the codes decide how much work is saved.

Scale: lists of a label, in order of their centroids, make *regions* of about ``REGION``
components; a large one is dealt into blocks, its queries into groups. A task holds a block
and a group and returns a count for each node and at most a link for each, so links of a
group of near copies, which are quadratic, are counted and never emitted. A query goes
once to each block of a region that it probes. Nothing about rows visits the driver but the sample.

Defined cases: null labels, and vectors that are null, empty, zero or hold null or non-finite
components, link with nothing. Vectors of different lengths are never linked (each length
is compared by itself). Copies, and rows that repeat an id, are rows of their own and
count each; a component is named by the smallest id it holds. Null ids take part in
linking but name a component only if all its ids are null. Other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import connected_components
from .whitening import finite

LEAST = 0.93
#: Vectors from which the codebooks are learnt, rounds of learning, and most lists.
SAMPLE, ROUNDS, LISTS = 20_000, 8, 4096
#: Dimensions of a subspace and words of its codebook.
PART, WORDS = 4, 256
#: Components of a block's vectors, queries that meet it at a time, and pairs compared at a time.
REGION, QUERIES, PAIRS = 1 << 19, 2048, 1 << 16


def nearest_word(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(axis=1)[None, :] - 2 * x @ words.T).argmin(axis=1)


def learnt(x: np.ndarray, k: int, unit: bool, seed: int) -> np.ndarray:
    """k means of the rows of x (at most as many as there are different rows)."""
    rnd = np.random.default_rng(seed)
    different = np.unique(x, axis=0)
    words = different[rnd.permutation(len(different))[:k]]
    for _ in range(ROUNDS):
        own = (x @ words.T).argmax(axis=1) if unit else nearest_word(x, words)
        count = np.bincount(own, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, own, x)
        if unit:
            size = np.linalg.norm(sums, axis=1)
            words = np.where((size > 1e-9)[:, None], sums / np.maximum(size, 1e-9)[:, None], words)
        else:
            words = np.where((count > 0)[:, None], sums / np.maximum(count, 1)[:, None], words)
    return words


class Codebook:
    """Centroids, the words of each subspace, and how far queries of a list must probe."""

    def __init__(self, sample: np.ndarray, lists: int, least: float):
        self.least, self.reach = least, float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-7
        centroids = learnt(sample, lists, True, 1)
        self.centroids = centroids[np.argsort(centroids @ centroids.mean(axis=0))]
        apart = np.sqrt(np.maximum(0, 2 - 2 * np.clip(self.centroids @ self.centroids.T, -1, 1)))
        self.margin = self.reach * apart / 2 + 1e-7
        rest = sample - self.centroids[(sample @ self.centroids.T).argmax(axis=1)]
        self.words = [learnt(rest[:, at : at + PART], WORDS, False, 2) for at in range(0, sample.shape[1], PART)]

    def lists(self, near: np.ndarray) -> np.ndarray:
        return near.argmax(axis=1)

    def probes(self, near: np.ndarray, own: np.ndarray) -> np.ndarray:
        """By row and list: whether a vector of list ``own``, with ``near`` its products with
        the centroids, must look there."""
        return near[np.arange(len(own)), own][:, None] - near <= self.margin[own]

    def codes(self, u: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, error, and squared length of what the codes say."""
        rest, said = u - self.centroids[own], self.centroids[own]
        codes = np.empty((len(u), len(self.words)), np.uint8)
        for m, words in enumerate(self.words):
            span = slice(m * PART, m * PART + PART)
            codes[:, m] = nearest_word(rest[:, span], words)
            said[:, span] += words[codes[:, m]]
        return codes, np.linalg.norm(u - said, axis=1), (said**2).sum(axis=1)

    def tables(self, u: np.ndarray) -> list[np.ndarray]:
        """By subspace: products of its words (rows) with the queries (columns)."""
        return [words @ u[:, m * PART : m * PART + PART].T for m, words in enumerate(self.words)]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever their size."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def padded(vectors, d: int) -> np.ndarray:
    out = np.zeros((len(vectors), d))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of paired rows; equal pairs give equal values, in either order."""
    return (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def parts(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches by the links (i, j)."""
    low = np.arange(n)
    while True:
        both = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, both)
        np.minimum.at(new, j, both)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def linked(book: Codebook, q: dict, v: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (i, j) of queries with vectors of one block, and whether the vector does not
    probe the query's list, so that the pair is found from this side only."""
    near_q, near_v = q["u"] @ book.centroids.T, v["u"] @ book.centroids.T
    probes = book.probes(near_q, q["list"])
    tables = book.tables(q["u"])
    limit = (1 + v["said"] - (book.reach + v["error"]) ** 2) / 2 - 1e-7  # the least product of a query with what the codes say
    found_i, found_j = [], []
    order = np.argsort(v["list"], kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(v["list"][order])) + 1):
        at = v["list"][own[0]]
        asks = np.flatnonzero(probes[:, at])
        if not len(asks):
            continue
        for some in np.array_split(own, -(-len(own) * len(asks) // (8 * PAIRS))):
            codes = v["codes"][some]
            product = np.broadcast_to(near_q[asks, at], (len(some), len(asks))).copy()
            for m, t in enumerate(tables):
                product += t[:, asks][codes[:, m]]
            j, i = np.nonzero(product >= limit[some][:, None])
            i, j = asks[i], some[j]
            other = q["node"][i] != v["node"][j]
            i, j = i[other], j[other]
            for a in range(0, len(i), PAIRS):
                x, y = i[a : a + PAIRS], j[a : a + PAIRS]
                keep = cosines(q["u"][x], v["u"][y]) >= book.least
                found_i.append(x[keep])
                found_j.append(y[keep])
    none = [np.zeros(0, np.int64)]
    i, j = np.concatenate(found_i or none), np.concatenate(found_j or none)
    alone = near_v[j, v["list"][j]] - near_v[j, q["list"][i]] > book.margin[v["list"][j], q["list"][i]]
    return i, j, alone


def link_counts(vectors: DataFrame, least: float = LEAST, region: int = REGION, queries: int = QUERIES, lists: int | None = None) -> DataFrame:
    """``vectors``: vec_id, label, embedding. vec_id, n_links, component_id and kept of every row."""
    label = vectors.schema["label"].dataType.simpleString()
    rows = vectors.select("vec_id", "label", F.when(F.col("label").isNotNull() & finite("embedding"), F.col("embedding").cast("array<double>")).alias("v"))
    rows = rows.withColumn("v", F.when(F.exists("v", lambda x: x != 0), F.col("v")))

    def keyed(batches):
        for batch in batches:
            values = [None if v is None else np.asarray(v, np.float64) + 0.0 for v in batch["v"]]
            named = [None if v is None else hashlib.blake2b(repr((name, len(v))).encode() + v.tobytes(), digest_size=16).digest() for name, v in zip(batch["label"].tolist(), values, strict=True)]
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "label": batch["label"], "v": values, "node": named})

    signed = materialize(rows.mapInPandas(keyed, f"vec_id long, label {label}, v array<double>, node binary"), "vectors")
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    nodes = materialize(nodes.withColumn("size", F.size("v")), "nodes")
    n, d = nodes.agg(F.count("*"), F.max("size")).first()
    if not n:
        return signed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    d = -(-d // PART) * PART
    share = min(1.0, (SAMPLE + 8 * SAMPLE**0.5 + 50) / n)  # a node is named by a hash, so its name draws the sample
    drawn = nodes.filter(F.conv(F.substring(F.hex("node"), 1, 8), 16, 10).cast("double") / 2.0**32 < share).orderBy("node").limit(SAMPLE).select("v").toPandas()
    book = Codebook(unit(padded(drawn["v"].tolist(), d)), lists or min(LISTS, max(16, 1 << int(np.ceil(np.log2(n) / 2)))), least)
    shared, k = vectors.sparkSession.sparkContext.broadcast(book), len(book.centroids)

    # Lists of a label make as many regions as its vectors fill.
    most = max(1, region // d)
    wide = nodes.groupBy("label", "size").agg(F.ceil(F.count("*") / most).cast("int").alias("regions"))
    names = ["label", "size"]

    def encoded(batches):
        for batch in batches:
            if not len(batch):
                continue
            u, own_book = unit(padded(batch["v"].tolist(), d)), shared.value
            near = u @ own_book.centroids.T
            own = own_book.lists(near)
            codes, error, said = own_book.codes(u, own)
            many = np.minimum(batch["regions"].to_numpy(), k)
            probes = own_book.probes(near, own)
            asked = [np.unique(np.flatnonzero(p) * m // k).astype(np.int32) for p, m in zip(probes, many, strict=True)]
            yield pd.DataFrame({
                "node": batch["node"], "label": batch["label"], "size": batch["size"], "weight": batch["weight"], "v": batch["v"], "list": own.astype(np.int32), "codes": [c.tobytes() for c in codes],
                "error": error, "said": said, "region": (own * many // k).astype(np.int32), "asked": asked,
            })

    stored = nodes.join(wide, names).select("node", *names, "weight", "v", "regions").mapInPandas(encoded, f"node binary, label {label}, size int, weight long, v array<double>, list int, codes binary, error double, said double, region int, asked array<int>")
    stored = materialize(stored, "codes")
    asking = stored.withColumn("region", F.explode("asked")).drop("asked")
    blocks = stored.groupBy(*names, "region").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    groups = asking.groupBy(*names, "region").agg(F.ceil(F.count("*") / queries).cast("int").alias("groups"))
    deal = blocks.join(groups, [*names, "region"])
    hashed = lambda n: (F.abs(F.xxhash64("node") % 1_000_003) % F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = [*names, "region", "block", "group"]
    fields = ["node", "weight", "v", "list", "codes", "error", "said"]
    held = stored.join(deal, [*names, "region"]).withColumns({"block": hashed("blocks"), "group": each("groups")}).select(*place, *fields, F.lit(False).alias("asks"))
    asked = asking.join(deal, [*names, "region"]).withColumns({"group": hashed("groups"), "block": each("blocks")}).select(*place, "node", "weight", "v", "list", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"), F.lit(0.0).alias("said"), F.lit(True).alias("asks"))

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        q, v = rows[rows["asks"]], rows[~rows["asks"]]
        if not len(q) or not len(v):
            return pd.DataFrame({"node": pd.Series([], dtype=object), "links": pd.Series([], dtype=np.int64), "other": pd.Series([], dtype=object)})
        side = lambda s: {"node": np.array(s["node"].tolist(), object), "u": unit(padded(s["v"].tolist(), d)), "list": s["list"].to_numpy(), "weight": s["weight"].to_numpy()}
        a, b = side(q), side(v) | {"error": v["error"].to_numpy(), "said": v["said"].to_numpy(), "codes": np.frombuffer(b"".join(v["codes"]), np.uint8).reshape(len(v), -1)}
        i, j, alone = linked(shared.value, a, b)
        name, at = np.unique(np.array([x.hex() for x in (*a["node"], *b["node"])]), return_inverse=True)
        i_at, j_at = at[i], at[len(q) + j]
        count = np.bincount(i_at, b["weight"][j], len(name)) + np.bincount(j_at[alone], a["weight"][i[alone]], len(name))
        low = parts(i_at, j_at, len(name))
        keep = np.flatnonzero((count > 0) | (low != np.arange(len(name))))
        raw = [bytes.fromhex(x) for x in name]
        return pd.DataFrame({"node": [raw[x] for x in keep], "links": count[keep].astype(np.int64), "other": [raw[low[x]] for x in keep]})

    found = materialize(held.unionByName(asked).groupBy(*place).applyInPandas(compared, "node binary, links long, other binary"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    root = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    own = nodes.select("node", "rep", "weight").join(links, "node", "left").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = own.groupBy("root").agg(F.min("rep").alias("component_id"))
    about = own.join(least_id, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = signed.select("vec_id", "node").join(about, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(table(spark, sf_dir, "embeddings"))
