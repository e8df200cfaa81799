"""Language identification by nearest centroids.

A text is a TF-IDF vector of hashed byte trigrams (letters lower-cased, everything
that is not a letter one space), log-damped and of unit length. Every language has
up to ``clusters`` centroids from spherical k-means. A text gets the language of the
centroid with the largest cosine; one whose cosine stays under that language's limit
is too far from everything learned and is rejected. The limit is ``REJECT_SHARE`` of the
cosine that all but ``LOWEST`` of the language's texts reach that its centroids were not
fitted on. Short texts share few trigrams with any centroid, so the limit falls with the
root of a text's length below ``FULL_LENGTH`` letters.

Document frequencies come from every learnable row. The centroids are fitted on at most
``sample_per_lang`` distinct texts of each language, the limit on as many others (those
with the smallest md5, by turns), the documented bound of this operator's training set;
a language's vectors are clustered in one task, the languages in parallel. Scoring is
one scan, no shuffle.

Null text or text without a letter: ``und``, score 0, rejected. Null lang rows are
never learned from. Null ids: never learned from and reported as held out = null.
Repeated rows are scored one by one; ties between centroids go to the language that
sorts first. With no learnable row every prediction is ``und``. Other columns are
not read.
"""

from __future__ import annotations

import regex
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, joined_bytes, slices, table, text_key

DIMS = 1 << 14
#: Rows whose dense vectors are made at a time.
ROWS = 64
CLUSTERS, ROUNDS, SAMPLE_PER_LANG = 4, 8, 400
#: A text is rejected under this share of the cosine that all but LOWEST of other texts reach.
REJECT_SHARE, LOWEST = 0.5, 0.001
FULL_LENGTH = 400
UNDETERMINED = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"

_NOT_LETTERS = regex.compile(r"\P{L}+")


def letters(text: str | None) -> str:
    """Lower-cased letters with single spaces in between and around; empty without a letter."""
    kept = _NOT_LETTERS.sub(" ", text or "").strip().lower()
    return f" {kept} " if kept else ""


def gram_counts(texts: list[str]) -> np.ndarray:
    """rows x DIMS counts of hashed trigrams."""
    b, starts = joined_bytes(texts, 2)
    out = np.zeros((len(texts), DIMS), np.float32)
    n = len(b) - 2
    if n <= 0:
        return out
    code = b[:n].astype(np.uint32) | b[1 : n + 1].astype(np.uint32) << np.uint32(8) | b[2 : n + 2].astype(np.uint32) << np.uint32(16)
    code = code * np.uint32(2654435761) >> np.uint32(32 - DIMS.bit_length() + 1)
    ends = np.append(starts[1:], len(b)) - 2
    for i in range(len(texts)):
        own = code[starts[i] : max(starts[i], ends[i] - 2)]
        if len(own):
            out[i] = np.bincount(own, minlength=DIMS)
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(gram_counts(texts)) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def lengthened(texts: list[str]) -> np.ndarray:
    """What of a full text's cosine a text of its length is expected to have."""
    return np.minimum(1.0, np.fromiter(map(len, texts), float, len(texts)) / FULL_LENGTH) ** 0.5


def cluster(x: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; at most k unit centroids."""
    seeds, nearest = [0], x @ x[0]
    while len(seeds) < min(k, len(x)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-6:
            break
        seeds.append(far)
        nearest = np.maximum(nearest, x @ x[far])
    centres = x[seeds].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) for j in range(len(centres))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres.astype(np.float32)


class Model:
    """Centroids (rows), their languages, idf and the rejection limit of each row."""

    def __init__(self, langs: list[str], centres: np.ndarray, limits: np.ndarray, idf: np.ndarray):
        self.langs, self.centres, self.limits, self.idf = langs, centres, limits, idf

    def predict(self, raw: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        texts = [letters(t) for t in raw]
        langs, score, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.langs:
            return langs, score, rejected
        for a, z in slices(texts, 1_000_000):
            for at in range(a, z, ROWS):
                to = min(at + ROWS, z)
                cosine = vectors(texts[at:to], self.idf) @ self.centres.T
                best, short = cosine.argmax(axis=1), lengthened(texts[at:to])
                for i, j in enumerate(best):
                    if texts[at + i]:
                        c = float(np.clip(cosine[i, j], 0, 1))
                        langs[at + i], score[at + i], rejected[at + i] = self.langs[j], c, c < self.limits[j] * float(short[i])
        return langs, score, rejected


def _frequencies(batches):
    df, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        texts = [letters(t) for t in batch["text"]]
        n += len(texts)
        for a, z in slices(texts, 1_000_000):
            for at in range(a, z, ROWS):
                df += (gram_counts(texts[at : min(at + ROWS, z)]) > 0).sum(axis=0)
    at = np.flatnonzero(df)
    yield pd.DataFrame({"gram": np.append(at, -1).astype(np.int32), "n": np.append(df[at], n)})


def fit(learnable: DataFrame, clusters: int = CLUSTERS, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """``learnable``: doc_id, text, lang of the rows that may be learned from."""
    rows = learnable.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", text_key("text").alias("text_key"))
    counts = rows.select("text").mapInPandas(_frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # DIMS + 1 rows at most
    total = int(counts.loc[counts["gram"] < 0, "n"].sum())
    df = np.zeros(DIMS)
    seen = counts[counts["gram"] >= 0]
    df[seen["gram"]] = seen["n"]
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    keys = rows.select("lang", "text_key").distinct()
    chosen = hash_sample(keys, "text_key", "lang", 2 * sample_per_lang)  # bounded for each language
    sample = rows.join(F.broadcast(chosen), ["lang", "text_key"]).groupBy("lang", "text_key").agg(F.min("text").alias("text"))

    def centroids(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in map(letters, own.sort_values("text_key")["text"]) if t]
        if not texts:
            return pd.DataFrame({"lang": pd.Series([], dtype=object), "centre": pd.Series([], dtype=object), "low": pd.Series([], dtype=float)})
        x, other = vectors(texts[::2], idf), texts[1::2] or texts
        centres = cluster(x, clusters)
        near = (vectors(other, idf) @ centres.T).max(axis=1) / lengthened(other)
        return pd.DataFrame({"lang": key[0], "centre": [c.tobytes() for c in centres], "low": float(np.quantile(near, LOWEST))})

    got = sample.groupBy("lang").applyInPandas(centroids, "lang string, centre binary, low double").toPandas()  # clusters rows a language
    got = got.assign(at=range(len(got))).sort_values(["lang", "at"])
    centres = np.stack([np.frombuffer(c, np.float32) for c in got["centre"]]) if len(got) else np.zeros((0, DIMS), np.float32)
    return Model(got["lang"].tolist(), centres, REJECT_SHARE * got["low"].to_numpy(float), idf)


def fold(documents: DataFrame) -> DataFrame:
    """``documents`` with held_out: crc32 of the id as text leaves 1 modulo 3."""
    return documents.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 3 == 1)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        for batch in batches:
            lang, score, rejected = shared.value.predict(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": lang, "score": score, "rejected": rejected})

    return documents.select("doc_id", "held_out", "text").mapInPandas(label, SCHEMA)


def language_id(documents: DataFrame) -> DataFrame:
    rows = fold(documents.select("doc_id", "text", "lang"))
    return identify(rows, fit(rows.filter("not held_out")))


def filter_language(documents: DataFrame) -> DataFrame:
    """Documents whose language is recognised, lang set to the one found."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(fold(documents.select("doc_id", "text", "lang")).filter("not held_out")))

    @F.pandas_udf("string")
    def found(text: pd.Series) -> pd.Series:
        lang, _, rejected = shared.value.predict(text.tolist())
        return pd.Series([None if r else x for x, r in zip(lang, rejected, strict=True)], dtype=object)

    columns = documents.columns
    return documents.withColumn("lang", found("text")).filter("lang is not null").select(*columns)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
