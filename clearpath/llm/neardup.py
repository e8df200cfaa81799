"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

1. Each whole text becomes a set of shingles of so many words; rows with equal sets share a
   *node* (128 bits of the set), so copies are grouped once and never paired.
2. A node has 192 minima in bands (of 6 at 85 %, of 5 at 80 %) and an *odd sketch*: the parities of its
   (place, minimum) samples folded into 1024 bits. The population count of two
   sketches' XOR estimates how many samples differ.
3. Nodes that share a band key are candidates. The *centre* of a bucket is its most
   connected node; a node joins the cluster of the centre with which it shares most
   buckets, if their sketches agree roughly. Members are compared exactly with
   their centre. Members that are not linked to it are compared exactly with the
   whole cluster, in blocks: products of 0/1 matrices, of which only links that join
   parts leave the block. So a group of copies makes one comparison a member.
4. In buckets of several clusters, nodes of different ones are compared if their
   sketches allow the similarity; nodes of one cluster are never paired there.
5. Links (100 * intersection >= percent * union, on full sets) give components.

A pair at the limit shares no band with probability 3e-7, and fails the sketch test
at five standard deviations. Nothing is capped, and no table of links, components or
fingerprints visits the driver.

Null or empty text, or no word: an empty set, linked with nothing, its own component.
Equal ids in several rows: every row is a document; its component is the smallest id
among rows that it reaches. Null id: takes part in linking; never a component's id
unless all ids of the component are null (component null, kept true). Extra columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialize, scratch_tables, slices, table, text_key, unused
from .components import connected_components
from .shingles import SKETCH_LONGS, band_rows, bands, intersections, minhash, odd_sketch, set_key, shingle_sets, sketch_limit

SIZE, PERCENT = 3, 85
#: What a stage that drops copies calls one: five words and 80 % find a block put in or
#: cut off, three words and 85 % find scattered changes.
DROP_MEASURES = ((3, 85), (5, 80))
#: Sketches that agree with a centre at least to this similarity make one cluster.
ROUGH = 0.55
BLOCK_ROWS, BLOCK_SHINGLES = 256, 400_000
#: Characters of text that a worker takes at a time.
SLICE = 300_000


def signatures(documents: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, a key of the text, n_shingles, node (null for empty sets), band keys and
    sketch of each row."""
    rows = band_rows(percent / 100)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, z in slices(texts, SLICE):
                sets = shingle_sets(texts[a:z], size)
                nodes, keys, sketches = [], [], []
                for s in sets:
                    m = minhash(s) if len(s) else None
                    nodes.append(set_key(s) if len(s) else None)
                    keys.append(None if m is None else bands(m, rows))
                    sketches.append(None if m is None else odd_sketch(m))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, z - a), batch.column(2).slice(a, z - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "n_shingles", "node", "bands", "sketch"],
                )
        give_back()

    return documents.select("doc_id", "text", text_key("text")).mapInArrow(run, "doc_id long, text_key string, n_shingles long, node binary, bands array<long>, sketch array<long>")


def differing(a: str, b: str) -> F.Column:
    """Bits in which two sketch columns differ."""
    total = F.lit(0)
    for i in range(SKETCH_LONGS):
        total = total + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return total


def _shingles(size: int):
    def run(batches):
        for batch in batches:
            node, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, z in slices(texts, SLICE):
                sets = shingle_sets(texts[a:z], size)
                keep = [(n, s.tobytes()) for n, s in zip(node[a:z], sets, strict=True) if len(s) and set_key(s) == n]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.binary()), pa.array([k[1] for k in keep], pa.binary())], names=["node", "shingles"])
        give_back()

    return run


def _jaccard(batches):
    for batch in batches:
        a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
        inter, union = [], []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            inter.append(both)
            union.append(len(p) + len(q) - both)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "both", "either"])


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact sizes of intersection and union for pairs (a, b) of nodes. Where many pairs
    have one b, its set goes to a group of BLOCK_ROWS of them at a time."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts")).filter("parts > 1")
    dealt = pairs.select("a", "b").join(many, "b", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.abs(F.xxhash64("a") % 1_000_003) % F.col("parts")).cast("int"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).join(many, "b", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    rows = dealt.join(x, "a").join(y, ["b", "part"]).select("a", "b", "x", "y")
    return rows.mapInArrow(_jaccard, "a binary, b binary, both long, either long")


def forest(left: list, right: list, linked: np.ndarray) -> list[tuple]:
    """Links of a block that join parts not joined before: at most one a row."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = root(left[i]), root(right[j])
        if a != b:
            parent[a] = b
            out.append((left[i], right[j]))
    return out


def blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``members`` (cluster, node, n_shingles, linked): links between members that are
    not linked to their centre and all members of their cluster. Slim rows are dealt
    into blocks; sets join them only then, by node."""
    odd_only = lambda x: F.sum(F.when(~F.col("linked"), x).otherwise(0))
    size = members.groupBy("cluster").agg(
        odd_only(F.lit(1)).alias("odd"), odd_only(F.col("n_shingles")).alias("odd_size"), F.count("*").alias("all"), F.sum("n_shingles").alias("all_size"),
    ).filter("odd > 0")
    parts = lambda n, s: F.greatest(F.ceil(F.col(n) / BLOCK_ROWS), F.ceil(F.col(s) / BLOCK_SHINGLES)).cast("int")
    size = size.select("cluster", parts("odd", "odd_size").alias("odd_parts"), parts("all", "all_size").alias("all_parts"))
    m = members.join(size, "cluster").withColumn("h", F.abs(F.xxhash64("node") % 1_000_003))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    odd = m.filter("not linked").select("cluster", (F.col("h") % F.col("odd_parts")).cast("int").alias("i"), span("all_parts").alias("j"), "node", F.lit(True).alias("is_odd"))
    every = m.select("cluster", span("odd_parts").alias("i"), (F.col("h") % F.col("all_parts")).cast("int").alias("j"), "node", F.lit(False).alias("is_odd"))

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["is_odd"]], rows[~rows["is_odd"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        x, y = ([np.frombuffer(s, np.uint64) for s in side["shingles"]] for side in (left, right))
        both = intersections(x, y)
        either = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - both
        links = forest(left["node"].tolist(), right["node"].tolist(), 100 * both >= percent * either)
        return pd.DataFrame(links, columns=["a", "b"])

    return odd.unionByName(every).join(sets, "node").groupBy("cluster", "i", "j").applyInPandas(block, "a binary, b binary")


def candidate_buckets(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Band keys that several nodes share: (key, node) rows and (key, size) rows."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    size = materialize(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "bucket-sizes")
    return materialize(keys.join(size, "key").select("key", "node", "size"), "buckets"), size


def links(documents: DataFrame, nodes: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """Exact links (a, b) between nodes that give their components. ``nodes``: node,
    rep (an id of one of its rows), n_shingles, bands, sketch."""
    bucket, _ = candidate_buckets(nodes)
    sketch = nodes.select("node", "sketch", "n_shingles")
    popular = materialize(bucket.groupBy("node").agg(F.sum("size").alias("popularity")).join(sketch, "node"), "popular")

    centre = bucket.join(popular.select("node", "popularity"), "node").groupBy("key").agg(F.max(F.struct("popularity", "node"))["node"].alias("centre"))
    shared = bucket.join(centre, "key").groupBy("node", "centre").agg(F.count("*").alias("shared"))
    c = popular.select(F.col("node").alias("centre"), F.col("sketch").alias("centre_sketch"), "popularity")
    near = shared.join(popular.select("node", "sketch"), "node").join(c, "centre").filter(differing("sketch", "centre_sketch") <= sketch_limit(ROUGH, 0))
    best = near.groupBy("node").agg(F.max(F.struct("shared", "popularity", "centre"))["centre"].alias("cluster"))
    # A node without a near centre is a cluster of its own.
    clusters = materialize(popular.select("node", "sketch", "n_shingles").join(best, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")), "clusters")

    # Pairs of different clusters: within a bucket its clusters are paired first, so
    # members of one cluster never meet here, and most buckets have one cluster only.
    limit = sketch_limit(percent / 100, 5)
    placed = bucket.select("key", "node").join(clusters.select("node", "cluster"), "node")
    mixed = placed.groupBy("key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).filter("low <> high").select("key")
    placed = materialize(placed.join(mixed, "key"), "mixed-buckets")
    kinds = placed.select("key", "cluster").distinct()
    both = kinds.withColumnRenamed("cluster", "a_cluster").join(kinds.withColumnRenamed("cluster", "b_cluster"), "key").filter("a_cluster < b_cluster")
    about = clusters.select("node", "sketch", "n_shingles")
    side = lambda p: placed.join(about, "node").select("key", F.col("cluster").alias(f"{p}_cluster"), *(F.col(x).alias(f"{p}_{x}") for x in ("node", "sketch", "n_shingles")))
    alike = 100 * F.least("a_n_shingles", "b_n_shingles") >= percent * F.greatest("a_n_shingles", "b_n_shingles")
    apart = both.join(side("a"), ["key", "a_cluster"]).join(side("b"), ["key", "b_cluster"]).filter(alike & (differing("a_sketch", "b_sketch") <= limit))
    apart = materialize(apart.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), "apart")
    star = clusters.filter("node <> cluster").select(F.col("node").alias("a"), F.col("cluster").alias("b"))

    # Whole sets of the nodes in question, from their representatives' whole texts.
    asked = star.unionByName(apart)
    asked = asked.select(F.col("a").alias("node")).unionByName(asked.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "rep"), "node")
    texts = documents.select("doc_id", "text", text_key("text").alias("key")).join(asked, F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("key") == F.col("rep.text_key"))).select("node", "text")
    sets = materialize(texts.mapInArrow(_shingles(size), "node binary, shingles binary").dropDuplicates(["node"]), "sets")

    # Each kind of link is a plan of its own: Spark looks at a whole plan again after each of
    # its shuffles, so one plan of all of them costs the driver several times their sum.
    exact = lambda pairs: compare(pairs, sets).withColumn("linked", 100 * F.col("both") >= percent * F.col("either")).select("a", "b", "linked")
    stars = materialize(exact(star), "stars")
    members = stars.select(F.col("b").alias("cluster"), F.col("a").alias("node"), "linked")
    centres = materialize(members.groupBy("cluster").agg(F.bool_and("linked").alias("done")).filter("not done").select("cluster"), "centres")
    open_ = members.unionByName(centres.select("cluster", F.col("cluster").alias("node"), F.lit(True).alias("linked"))).join(centres, "cluster", "left_semi")
    open_ = materialize(open_.join(nodes.select("node", "n_shingles"), "node"), "open")
    across, within = materialize(exact(apart).filter("linked").select("a", "b"), "across"), materialize(blocks(open_, sets, percent), "within")
    return stars.filter("linked").select("a", "b").unionByName(across).unionByName(within)


def without(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """``rows`` (doc_id, text_key) that are not in ``gone`` (_gone_id, _gone_key)."""
    if gone is None:
        return rows
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("text_key") == F.col("_gone_key")), "left_anti")


def decisions(documents: DataFrame, percent: int, size: int, gone: DataFrame | None = None) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept and first (the component's row
    that sorts first by id, nulls last, and text) of every row of ``documents`` that is
    not ``gone``. Those leave after their signatures are made: slim rows meet then."""
    signed = materialize(without(signatures(documents, size, percent), gone), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = materialize(signed.filter("node is not null").groupBy("node").agg(F.min(row).alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")), "nodes")
    root = connected_components(links(documents, nodes, percent, size))
    own = nodes.select("node", "rep").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = own.groupBy("root").agg(F.min("rep").alias("first"))
    component = own.join(least, "root").select("node", "first")
    out = signed.select("doc_id", "text_key", "n_shingles", "node").join(component, "node", "left")
    out = out.select("doc_id", "text_key", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), "first")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(documents: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``documents``."""
    return decisions(documents, percent, size).drop("text_key", "first")


def drop_near_duplicates(documents: DataFrame, measures: tuple[tuple[int, int], ...] = DROP_MEASURES) -> DataFrame:
    """One document of each group of near-duplicates, with its own columns: the first by
    id (nulls last) and text. The ``measures`` (words of a shingle, percent) are taken one
    after the other, each on what the ones before left; the scratch tables of one go
    before the next. A decision is about an id and a text (null ids too), so another text
    under the same id has its own, and of rows equal in id and text one stays. Empty texts
    are no copies, unless they have one id. Extra columns may have any name: internal ones
    get names that are not taken."""
    spark, gone = documents.sparkSession, None
    for size, percent in measures:
        with scratch_tables(spark):
            rows = decisions(documents, percent, size, gone).filter("first is not null and not (doc_id <=> first.doc_id and text_key = first.text_key)")
            rows = rows.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
            gone = materialize(rows if gone is None else rows.unionByName(gone), "gone", keep=True)
    # The anti-join leaves rows by id and text, so the last step needs no shuffle of its own.
    key, none, gone_id, gone_key = unused(documents.columns, "_text_key", "_no_text", "_gone_id", "_gone_key")
    rows = documents.withColumns({key: text_key("text"), none: F.col("text").isNull()})
    gone = gone.toDF(gone_id, gone_key)
    left = rows.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left_anti")
    return left.dropDuplicates(["doc_id", key, none]).select(*documents.columns)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
