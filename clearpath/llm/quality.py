"""Quality rules: hashed n-gram log-likelihood ratio behind a few text rules.

Byte n-grams of every whole text are hashed into ``buckets`` counters. Two
multinomials are estimated: *raw* over all documents, and *target* over trusted
documents (``labels.quality = 1``, all of them). A document's score is the mean of ``log p_target(g) - log p_raw(g)`` over
its n-grams; it passes at ``threshold``. Unless that is given, it lies below the median
score of the trusted documents by ``SPREADS`` times the median's distance from their
lowest hundredth.

Scale: three scans of the documents. Trusted ids meet texts in a shuffle of one scan, and
scores (an id and a number) in another, whatever their number, so shuffles grow with the
input. Else one row per bucket and scan task is shuffled; the driver holds the two tables
of ``buckets`` numbers.

Null or empty text: no word, so the text rules fail it (score 0). Null or repeated
doc_id: each row is scored by itself. An empty table gives an empty result. Extra
columns of the input are not read. Without trusted documents the two multinomials
are equal and only the text rules decide.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, joined_bytes, slices, table

GRAM, BUCKETS = 4, 1 << 16
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: How far below the trusted documents' median the threshold lies, in distances of their lowest hundredth.
SPREADS = 8.0
#: Pseudo-count with which the raw multinomial smooths the target.
SMOOTHING = 2000.0

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")


def repeat_words(words: list[str]) -> int:
    """Words covered by 3-word windows that occur at least twice, first included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = defaultdict(count().__next__)
    w = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    pairs = np.unique(w[:-2] * len(ids) + w[1:-1], return_inverse=True)[1]
    _, window, seen = np.unique(pairs * len(ids) + w[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(seen[window] > 1)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def text_rules(text: str) -> tuple[int, int, int, int, int]:
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
    symbols = len(text) - len(text.translate(_SYMBOLS))
    return len(words), sum(map(len, words)), symbols, dup, repeat_words(words)


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, whether one starts there, starts of texts."""
    b, starts = joined_bytes(texts, GRAM - 1)
    n = len(b) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool), starts
    code = b[:n].astype(np.uint32)
    for k in range(1, GRAM):
        code |= b[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    code *= np.uint32(2654435761)
    ends = np.append(starts[1:], len(b)) - (GRAM - 1)
    inside = np.ones(n, bool)
    for k in range(GRAM - 1):
        at = ends - 1 - k
        inside[at[(at >= starts) & (at < n)]] = False
        at = ends + k
        inside[at[at < n]] = False
    return code >> np.uint32(32 - BUCKETS.bit_length() + 1), inside, starts


def _count(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts = batch["text"].fillna("").tolist()
        trusted = batch["trusted"].to_numpy(bool)
        for a, z in slices(texts, 300_000):
            code, inside, starts = gram_buckets(texts[a:z])
            raw += np.bincount(code[inside], minlength=BUCKETS)
            if trusted[a:z].any():
                own = np.repeat(trusted[a:z], np.diff(np.append(starts, len(code) + GRAM - 1)))[: len(code)]
                target += np.bincount(code[inside & own], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pd.DataFrame({"bucket": at.astype(np.int32), "raw": raw[at], "target": target[at]})


def ratio_table(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p_target - log p_raw for each bucket."""
    p_raw = (raw + 1.0) / (raw.sum() + len(raw))
    p_target = (target + smoothing * p_raw) / (target.sum() + smoothing)
    return np.log(p_target / p_raw)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()


def marked_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """text and trusted of all documents. Rows without an id are dealt by their texts."""
    trusted = trusted_ids(labels).select("doc_id", F.lit(0).cast("long").alias("deal"), F.lit(True).alias("trusted"))
    rows = documents.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("deal"))
    return rows.join(trusted.hint("merge"), ["doc_id", "deal"], "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))


def fit_ratio(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """Count n-grams of all documents, and of the trusted ones among them."""
    seen = marked_documents(documents, labels)
    counts = seen.mapInPandas(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    got = counts.toPandas()  # one row a bucket: fixed size
    raw[got["bucket"]], target[got["bucket"]] = got["raw"], got["target"]
    return ratio_table(raw, target)


def trusted_scores(documents: DataFrame, labels: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Scores of the trusted documents that have a text. Scores meet trusted ids, not texts."""
    shared = documents.sparkSession.sparkContext.broadcast(ratios)

    def score(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "llr": np.round(mean_ratio(batch["text"].tolist(), shared.value), 9)})

    scores = documents.select("doc_id", "text").filter("doc_id is not null and text <> ''").mapInPandas(score, "doc_id long, llr double")
    return scores.join(trusted_ids(labels).hint("merge"), "doc_id", "left_semi").select("llr")


def fit_threshold(documents: DataFrame, labels: DataFrame, ratios: np.ndarray, spreads: float = SPREADS) -> float:
    """The threshold that the trusted documents' scores give; without any, all pass."""
    own = trusted_scores(documents, labels, ratios)
    low, middle = own.agg(F.percentile_approx("llr", [0.01, 0.5], 1_000_000)).first()[0] or (-np.inf, -np.inf)
    return float(middle - spreads * (middle - low)) if np.isfinite(middle) else -np.inf


def mean_ratio(texts: list[str], table_: np.ndarray) -> np.ndarray:
    """Mean of the table over each text's n-grams; 0 for texts without any."""
    out = np.zeros(len(texts))
    for a, z in slices(texts, 300_000):
        code, inside, starts = gram_buckets(texts[a:z])
        if len(code):
            value = np.append(np.where(inside, table_[code], 0.0), np.zeros(GRAM - 1))
            total = np.add.reduceat(value, starts)
            n = np.add.reduceat(np.append(inside, np.zeros(GRAM - 1, bool)).astype(np.int64), starts)
            out[a:z] = total / np.maximum(n, 1)
    return out


def verdicts(texts: list[str], ratios: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the five counts, base_failed, score and kept of each text."""
    llr = np.round(mean_ratio(texts, ratios), 9)
    rules = np.array([text_rules(t) for t in texts], np.int64).reshape(-1, 5)
    failed = (rules[:, 0] < MIN_WORDS) | (100 * rules[:, 4] > MAX_REPEAT_PERCENT * rules[:, 0])
    return rules, failed, llr, ~failed & (llr >= threshold)


def quality_rules(documents: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """Rules, score and verdict for every document."""
    ratios = fit_ratio(documents, labels)
    limit = fit_threshold(documents, labels, ratios) if threshold is None else threshold
    shared = documents.sparkSession.sparkContext.broadcast(ratios)

    def score(batches):
        for batch in batches:
            rules, failed, llr, kept = verdicts(batch["text"].fillna("").tolist(), shared.value, limit)
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            yield pd.DataFrame({"doc_id": batch["doc_id"], **{c: rules[:, i] for i, c in enumerate(names)}, "base_failed": failed, "llr": llr, "kept": kept})

    return documents.select("doc_id", "text").mapInPandas(score, SCHEMA)


def filter_quality(documents: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """The documents that pass, with their own columns. Rules and ratio are computed
    on the rows themselves, so equal or null ids need no join back."""
    ratios = fit_ratio(documents, labels)
    limit = fit_threshold(documents, labels, ratios) if threshold is None else threshold
    shared = documents.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf("boolean")
    def passes(text: pd.Series) -> pd.Series:
        return pd.Series(verdicts(text.fillna("").tolist(), shared.value, limit)[3])

    return documents.filter(passes("text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
