"""Baselines and attestations as JSON lines, written and read by Spark.

An attestation store is append-only; a rewrite or prune is a new snapshot beside the old
one, so a lost task never leaves half a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASELINE = "version int, standards array<string>, hash string, rule_id string, path string, message string"
ATTESTATION = "criterion_id string, rule_ids array<string>, by string, reason string, evidence_source string, attested_at string, scope string, verdict string"
_TIME = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"


def write_baseline(findings: DataFrame, standards: list[str], folder: str) -> None:
    """One line a distinct finding hash (findings: hash, rule_id, path, message)."""
    rows = findings.dropDuplicates(["hash"]).select(F.lit(1).alias("version"), F.array(*map(F.lit, standards)).alias("standards"), "hash", "rule_id", "path", "message")
    rows.write.mode("overwrite").json(folder)


def read_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BASELINE).json(folder)


def valid(attestations: DataFrame) -> DataFrame:
    """``attestations`` with problem: null for what may be stored."""
    problem = (
        F.when(F.trim(F.coalesce("criterion_id", F.lit(""))) == "", "no criterion").when(F.trim(F.coalesce("by", F.lit(""))) == "", "no author").when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no reason")
        .when(~F.coalesce(F.col("attested_at").rlike(_TIME), F.lit(False)) | F.substring("attested_at", 1, 10).try_cast("date").isNull(), "no time").when(~F.coalesce("verdict", F.lit("pass")).isin("pass", "fail", "n/a", "partial", "pending"), "no such verdict")
    )
    return attestations.withColumn("problem", problem)


def append_attestations(attestations: DataFrame, folder: str) -> None:
    """Valid rows are added to the store; others are left out."""
    valid(attestations).filter("problem is null").drop("problem").write.mode("append").json(folder)


def read_attestations(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ATTESTATION).json(folder)


def prune_attestations(store: DataFrame, criteria: DataFrame, folder: str) -> None:
    """A snapshot without rows on criteria that no standard has any more; of rows equal in
    criterion, author and scope the latest stays."""
    known = store.join(criteria.select("criterion_id").distinct(), "criterion_id", "left_semi")
    latest = known.groupBy("criterion_id", "by", "scope").agg(F.max_by(F.struct(*store.columns), "attested_at").alias("a")).select("a.*")
    latest.write.mode("errorifexists").json(folder)
