"""Mixing sources to target weights, in DataFrame and SQL functions only.

A source with the share p of all tokens gets the weight p**t / sum(p**t). The
exponent t is the smallest in [0, 1] for which the entropy of the weights is at most
``entropy_share`` of the largest possible (log of the number of sources) and no
source is repeated more than ``max_repetition`` times; both are monotone in t, so it
is bisected. t = 1 keeps the corpus as it is, 0 makes all sources equal.

The budget of tokens is given, or (``budget=None``) the least with which every
document appears: the largest source once, smaller ones (T_max / T)**(1 - t) times.
Each source's stream is a row of epochs, each a fresh permutation of its documents by
a hash; its first ``quota`` tokens are spread evenly over blocks of ``block_tokens``,
and every block is a permutation of its own.

Scale: positions in a stream are prefix sums over hash buckets, then within a bucket,
so a source with a third of all rows is dealt over all tasks; the number of buckets
follows the number of rows, and a bucket in which one id has many rows is cut further. The table of sources is never gathered: a bisection pass
is one aggregate over it that yields the sums for the fifteen midpoints of four steps.

Tokens: words (runs without white space) and one end mark, so at least 1, also for
null or empty text. Null source: a source of its own. Null ids and repeated rows are
placed row by row. Empty table: empty result. Other columns go along as they are
(internal columns start with ``_mix_``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, unused

SEED, BLOCK_TOKENS, ENTROPY_SHARE, MAX_REPETITION = "mix-1", 1_000_000, 0.95, 4.0
BUCKET_ROWS, PASSES, STEPS = 4096, 10, 4
#: First letters of buckets that are summed first.
HEAD = 3


def tokens(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def exponent(sources: DataFrame, total: int, largest: int, smallest: int, count: int, budget: int | None, entropy_share: float = ENTROPY_SHARE, max_repetition: float = MAX_REPETITION) -> float:
    """``sources`` has a column _mix_t (tokens). The exponent, rounded to 1e-6."""
    limit = entropy_share * math.log(count)
    p = F.col("_mix_t") / F.lit(float(total))

    def fits(t: float, z: float, a: float) -> bool:
        entropy = math.log(z) - t * a / z
        repeats = (largest / smallest) ** (1 - t) if budget is None else (smallest / total) ** (t - 1) / z * budget / total
        return entropy <= limit + 1e-12 and repeats <= max_repetition * (1 + 1e-12)

    low, high = 0.0, 1.0
    parts = 1 << STEPS
    for k in range(PASSES):
        points = [low + (high - low) * i / parts for i in range(0 if k == 0 else 1, parts)]
        # The points are rows, not constants of an aggregate each: every pass is the same small plan.
        power = F.pow(p, F.col("_mix_e"))
        at = sources.withColumn("_mix_e", F.explode(F.lit(points)))
        sums = {t: (z, a) for t, z, a in at.groupBy("_mix_e").agg(F.sum(power), F.sum(power * F.log(p))).collect()}  # a row a point
        ok = [fits(t, *sums[t]) for t in points]
        first = next((i for i, x in enumerate(ok) if x), len(points))
        if k == 0 and first == 0:
            return 0.0
        low, high = points[first - 1] if first else low, points[first] if first < len(points) else high
    return round(high, 6)


def mix(documents: DataFrame, source: str = "source", id_column: str = "doc_id", n_tokens: str | None = None, budget: int | None = None, entropy_share: float = ENTROPY_SHARE, max_repetition: float = MAX_REPETITION, block_tokens: int = BLOCK_TOKENS, seed: str = SEED) -> DataFrame:
    """Rows of ``documents``, as often as their source's weight asks, with _mix_block,
    _mix_position (in the block), _mix_epoch and _mix_n (tokens)."""
    rows = documents.withColumns({
        "_mix_n": F.col(n_tokens) if n_tokens else tokens("text"),
        "_mix_source": F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source))),
        "_mix_id": F.coalesce(F.col(id_column).cast("string"), F.lit("")),
    })
    sources = materialize(rows.groupBy("_mix_source").agg(F.sum("_mix_n").alias("_mix_t"), F.count("*").alias("_mix_rows")), "mix-sources")
    total, largest, smallest, count, n_rows = sources.agg(F.sum("_mix_t"), F.max("_mix_t"), F.min("_mix_t"), F.count("*"), F.sum("_mix_rows")).first()
    t = exponent(sources, total, largest, smallest, count, budget, entropy_share, max_repetition) if count else 1.0
    if budget is None:
        quota = F.col("_mix_t") * F.pow(F.lit(float(largest or 1)) / F.col("_mix_t"), F.lit(1 - t))
    else:
        z = sources.agg(F.sum(F.pow(F.col("_mix_t") / F.lit(float(total)), F.lit(t)))).first()[0] if count else 1.0
        quota = F.pow(F.col("_mix_t") / F.lit(float(total or 1)), F.lit(t)) / F.lit(z) * F.lit(float(budget))
    sources = materialize(sources.withColumn("_mix_q", F.floor(quota + 0.5).cast("long")), "mix-quotas")
    blocks = max(1, -(-(sources.agg(F.sum("_mix_q")).first()[0] or 0) // block_tokens))
    digits = max(0, math.ceil(math.log((n_rows or 1) / BUCKET_ROWS, 16))) if n_rows else 0

    # The few columns of a source go to its rows; each row becomes one row an epoch.
    own = rows.join(sources.select("_mix_source", "_mix_t", "_mix_q"), "_mix_source").filter("_mix_q > 0")
    own = own.withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_mix_q") - 1) / F.col("_mix_t")).cast("long"))))
    own = own.withColumn("_mix_h", F.md5(F.concat_ws("|", F.lit(seed), "_mix_epoch", "_mix_id"))).withColumn("_mix_bucket", F.substring("_mix_h", 1, digits))
    own = _split(own, digits)
    stream, key = ["_mix_source", "_mix_epoch"], ["_mix_source", "_mix_epoch", "_mix_bucket"]
    # Sums before a bucket: of the heads before its head, and of the buckets before it in its head.
    head = F.substring("_mix_bucket", 1, HEAD).alias("_mix_head")
    sums = own.groupBy(key).agg(F.sum("_mix_n").alias("_mix_sum")).select("*", head)
    earlier = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = sums.groupBy(*stream, "_mix_head").agg(F.sum("_mix_sum").alias("_mix_sum")).select(*stream, "_mix_head", earlier("_mix_sum", *stream, "_mix_head").alias("_mix_heads"))
    sums = sums.join(heads, [*stream, "_mix_head"]).select(*key, (F.col("_mix_heads") + earlier("_mix_sum", *stream, "_mix_head", "_mix_bucket")).alias("_mix_before"))
    inside = Window.partitionBy(key).orderBy("_mix_h", F.col(id_column), "_mix_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = own.withColumn("_mix_cum", F.sum("_mix_n").over(inside)).join(sums, key)
    x = F.col("_mix_epoch") * F.col("_mix_t") + F.col("_mix_before") + F.col("_mix_cum") - F.col("_mix_n")
    placed = placed.withColumn("_mix_x", x).filter("_mix_x < _mix_q")
    placed = placed.withColumn("_mix_block", F.floor(F.col("_mix_x").cast("double") * F.lit(float(blocks)) / F.col("_mix_q").cast("double")).cast("long"))
    order = Window.partitionBy("_mix_block").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.lit("block"), "_mix_epoch", "_mix_id")), F.col(id_column), "_mix_epoch", "_mix_n")
    return placed.withColumn("_mix_position", F.row_number().over(order).cast("long") - 1).drop("_mix_source", "_mix_id", "_mix_t", "_mix_q", "_mix_h", "_mix_bucket", "_mix_cum", "_mix_before", "_mix_x", "_mix_row")


def _split(own: DataFrame, digits: int) -> DataFrame:
    """Buckets in which one id has many rows (null ids are one), cut along the order within:
    the other ids of the bucket are buckets of their own, and the id's rows go by length and,
    as rows of one id and length may change places, by a number of the row."""
    if not digits:
        return own
    stream = ["_mix_source", "_mix_epoch"]
    many = own.groupBy(*stream, "_mix_h").agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("_mix_parts")).filter("_mix_parts > 8")
    cut = many.select(*stream, F.substring("_mix_h", 1, digits).alias("_mix_bucket"), F.lit(True).alias("_mix_cut")).distinct()
    row = F.col("_mix_row") if "_mix_row" in own.columns else F.xxhash64(*own.columns)
    rows = own.join(cut, [*stream, "_mix_bucket"], "left").join(many, [*stream, "_mix_h"], "left")
    fine = F.concat_ws("|", "_mix_h", F.lpad(F.col("_mix_n").cast("string"), 19, "0"), F.lpad(F.pmod(row, F.col("_mix_parts").cast("long")).cast("string"), 9, "0"))
    return rows.withColumn("_mix_bucket", F.when(F.col("_mix_parts").isNotNull(), fine).when(F.col("_mix_cut"), F.col("_mix_h")).otherwise(F.col("_mix_bucket"))).drop("_mix_cut", "_mix_parts")


def mixture(documents: DataFrame, **options) -> DataFrame:
    """block, position, doc_id, source, epoch and n_tokens of the mixed stream."""
    slim = materialize(documents.select("doc_id", "source", tokens("text").alias("n_tokens"), F.monotonically_increasing_id().alias("_mix_row")), "mix-rows")
    return mix(slim, n_tokens="n_tokens", **options).select(F.col("_mix_block").alias("block"), F.col("_mix_position").alias("position"), "doc_id", "source", F.col("_mix_epoch").alias("epoch"), "n_tokens")


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents themselves, as often as the mixed stream has them, in its order
    within each output partition. The stream is planned on slim rows; texts are shuffled
    once, by a key of the row, so every partition is a random share of each block. Rows
    of equal id, source and length are told apart by their rank. Extra columns may have any
    name: internal ones get names that are not taken."""
    named = unused(documents.columns, "_mix_key", "_mix_rank", "_mix_plan", "_mix_at", "_mix_block", "_mix_position")
    key, rank, plan_key, plan_rank, block, position = named
    made = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("source", F.lit("-")), tokens("text").cast("string"))
    keyed = documents.withColumn(key, made)
    ranked = lambda d, *order: d.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    slim = materialize(ranked(keyed.select("doc_id", "source", tokens("text").alias("_mix_length"), key), "doc_id").withColumn("_mix_row", F.monotonically_increasing_id()), "mix-rows")
    plan = mix(slim, n_tokens="_mix_length", **options).select(F.col(key).alias(plan_key), F.col(rank).alias(plan_rank), F.col("_mix_block").alias(block), F.col("_mix_position").alias(position))
    rows = ranked(keyed, "text")
    # The rank is compared besides the key, not as a part of it: texts keep the partitioning that ranked them.
    out = rows.join(plan, (F.col(key) == F.col(plan_key)) & (F.col(rank) <= F.col(plan_rank)) & (F.col(rank) >= F.col(plan_rank)))
    return out.sortWithinPartitions(block, position).select(*documents.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS s, coalesce(doc_id::VARCHAR, '') AS i,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT + 1 AS n FROM documents),
src AS (SELECT s, sum(n)::BIGINT AS t FROM r GROUP BY s),
one AS (SELECT list(t::DOUBLE / (SELECT sum(t) FROM src)::DOUBLE) AS p, max(t) AS big, min(t) AS small, count(*) AS k FROM src),
bis AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (
    SELECT step, lo, hi, mid,
      ln(z) - mid * a / z <= {ENTROPY_SHARE} * ln(k) + 1e-12 AND pow(big::DOUBLE / small, 1 - mid) <= {MAX_REPETITION} * (1 + 1e-12) AS ok
    FROM (
      SELECT step, lo, hi, mid, big, small, k, list_sum([pow(x, mid) for x in p]) AS z, list_sum([pow(x, mid) * ln(x) for x in p]) AS a
      FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid FROM bis WHERE step < 40), one))),
tau AS (
  SELECT CASE WHEN ln(k) <= {ENTROPY_SHARE} * ln(k) + 1e-12 AND big::DOUBLE / small <= {MAX_REPETITION} * (1 + 1e-12) THEN 0.0
    ELSE round((SELECT hi FROM bis WHERE step = 40), 6) END AS e, big FROM one),
q AS (SELECT s, t, floor(t * pow(big::DOUBLE / t, 1 - e) + 0.5)::BIGINT AS q FROM src, tau),
b AS (SELECT greatest(1, ceil(sum(q) / {BLOCK_TOKENS}.0))::DOUBLE AS blocks FROM q),
e AS (SELECT r.*, t, q, unnest(range(0, (q - 1) // t + 1)) AS epoch FROM r JOIN q USING (s)),
c AS (
  SELECT *, epoch * t + sum(n) OVER (PARTITION BY s, epoch ORDER BY md5('{SEED}|' || epoch || '|' || i), doc_id, n ROWS UNBOUNDED PRECEDING) - n AS x FROM e),
p AS (SELECT *, floor(x::DOUBLE * blocks / q::DOUBLE)::BIGINT AS block FROM c, b WHERE x < q)
SELECT block, row_number() OVER (PARTITION BY block ORDER BY md5('{SEED}|block|' || epoch || '|' || i), doc_id, epoch, n) - 1 AS position,
  doc_id, source, epoch, n AS n_tokens
FROM p
"""
