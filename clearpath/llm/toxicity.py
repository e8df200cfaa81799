"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel of two strings counts their common subsequences of four characters, each
occurrence weighted ``DECAY`` for every character skipped, within spans of ``SPAN``
characters, over the root of each string's own sum; so an insult with gaps or inserted
characters, or cut in two by a space, still meets itself. Training items are sentences:
one of more than ``WINDOW`` characters is all its windows of that many characters, and
scores as the highest of them; a document scores as its most toxic sentence. Nystroem
features of an item are its whitened kernel values to landmark items, and a linear
machine with squared hinge loss separates toxic items from others. Since the kernel is a
product of explicit subsequence counts, the trained machine folds into one weight a
subsequence, and scoring a text is table look-ups and sums.

Labels are of documents (multiple instances): in a toxic one at least one sentence is
toxic, in a clean one none, and a label may be wrong. A first machine, linear in
contiguous subsequences, weighs each by its standard score between toxic and clean
documents. Then ``rounds`` times: the ``witnesses`` highest sentences of each document,
the first one always, are its items (and one any sentence of each clean document), with
the document's label; toxic ones also with a character put in somewhere; landmarks are
drawn from the items, and the machine is trained anew. A logistic with both labels of
equal weight turns the value into a probability; it is fitted on a quarter of the sample
that the machine has not seen.

Training set (documented bound): at most ``max_docs`` distinct texts of each label, those
of the smallest md5, in a learnable fold; equal texts with both labels are toxic. The
driver sees a number a subsequence, and the items. Scoring is one scan, no shuffle.

Null or empty text, or one of fewer than four characters: the score of the machine's
bias. Very long texts are scored whole, in pieces that share no sentence. Null doc_id:
held_out null, never learned from. Repeated rows are scored one by one. Without toxic or
without clean labels every score is 0. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, materialize, slices, table, text_key

DECAY, SPAN, WINDOW, BITS = 0.6, 7, 16, 20
LANDMARKS, ROUNDS, WITNESSES, PENALTY, SPOILED = 256, 3, 2, 1e-4, 1
MAX_DOCS = 3000
#: Standard score that a subsequence needs to count in the first machine.
SIGNIFICANT = 2.0
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_CLASSES, _HASH = 64, 2654435761
_MARK = _CLASSES - 1
_CLASS = np.empty(1 << 16, np.int32)
_CLASS[:] = 37 + np.arange(1 << 16) % 26
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("0") : ord("9") + 1] = np.arange(27, 37)
_CLASS[ord(" ")] = _MARK  # white space, and a sentence's beginning
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")
_END = re.compile(r"(?<=[.!?;])\s+|\n\s*")
_WHITE = re.compile(r"\s+")
#: Where the four characters may stand behind the first one's place, and the weight.
PATTERNS = [(a, b, c, DECAY ** (c - 3)) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]


def sentences(text: str) -> str:
    """Lower-cased sentences, a line each, behind a space each and with single spaces;
    runs of single characters ("a b c d") stand joined in lines of their own besides."""
    text = text.lower()
    joined = ["".join(m.split()) for m in _SPACED.findall(text)]
    lines = [_WHITE.sub(" ", x).strip() for x in [*_END.split(text), *joined]]
    return "".join(f" {x}\n" for x in lines if x)


def coded(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of character classes (0 behind an item's end), and lengths."""
    size = np.fromiter(map(len, items), np.int64, len(items))
    flat = np.frombuffer("".join(items).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(items), SPAN + int(size.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = _CLASS[np.minimum(flat, 0xFFFF)]
    return out, size


def norms(size: np.ndarray) -> np.ndarray:
    """Root of the sum of squared weights of all occurrences in items of these sizes."""
    total = sum(w * w * np.maximum(0, size - c) for *_, c, w in PATTERNS)
    return np.sqrt(np.maximum(total, 1e-12))


def numbered(x: np.ndarray, a: int, b: int, c: int) -> np.ndarray:
    """Number below 2**BITS of the subsequence at every place of classes (last axis)."""
    n = x.shape[-1] - c
    code = ((x[..., :n] * _CLASSES + x[..., a : a + n]) * _CLASSES + x[..., b : b + n]) * _CLASSES + x[..., c:]
    return (code.astype(np.uint32) * np.uint32(_HASH)) >> np.uint32(32 - BITS)


def subsequences(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, subsequence, weight) of all occurrences, weights over the item's norm."""
    x, size = coded(items)
    rows, codes, weights = [], [], []
    for a, b, c, w in PATTERNS:
        i, j = np.nonzero(x[:, c:])
        codes.append(numbered(x, a, b, c)[i, j].astype(np.int64))
        rows.append(i)
        weights.append(np.full(len(i), w) / norms(size)[i])
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)


class Windows:
    """All windows of the sentences of some texts, as flat arrays."""

    def __init__(self, texts: list[str]):
        lines = [sentences(t) for t in texts]
        self.text = "".join(lines)
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.x = _CLASS[np.minimum(points, 0xFFFF)]
        stop = points == 10
        self.stop = np.flatnonzero(stop)  # one a sentence
        self.start = np.append(0, self.stop[:-1] + 1)[: len(self.stop)]
        self.owner = np.repeat(np.arange(len(texts)), [x.count("\n") for x in lines])
        self.number = np.cumsum(stop) - stop  # of the sentence at each place; its end is its own

    def values(self, weights: np.ndarray, patterns=PATTERNS) -> np.ndarray:
        """For each place the value of the window that begins there, -inf where none does."""
        n = len(self.x)
        out = np.full(n, -np.inf)
        if not n:
            return out
        size = np.minimum((self.stop - self.start)[self.number], WINDOW)
        total = np.zeros(n)
        place = np.arange(n)
        # The hash of four classes is a sum of a term for each, so the terms are made once.
        terms = [self.x.astype(np.uint32) * np.uint32(_HASH * _CLASSES**k & 0xFFFFFFFF) for k in (3, 2, 1, 0)]
        for c in sorted({p[2] for p in patterns}):
            if n <= c:
                continue
            ends, found = terms[0][: n - c] + terms[3][c:], np.zeros(n - c)
            for a, b, _, _ in (p for p in patterns if p[2] == c):
                found += weights[(ends + terms[1][a : n - c + a] + terms[2][b : n - c + b]) >> np.uint32(32 - BITS)]
            found *= DECAY ** (c - 3)
            found[self.stop[self.number[: n - c]] <= place[: n - c] + c] = 0  # not within the sentence
            found = np.concatenate([[0], np.cumsum(found), np.zeros(c)])
            found[n - c + 1 :] = found[n - c]
            total += found[np.clip(place + size - c, place, n)] - found[:n]
        begins = (place + size <= self.stop[self.number]) & (size > 0)
        out[begins] = total[begins] / norms(np.arange(WINDOW + 1))[size[begins]]
        return out

    def best(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each sentence's highest value and the first place where it stands."""
        if not len(self.stop):
            return np.zeros(0), np.zeros(0, np.int64)
        high = np.maximum.reduceat(values, self.start)
        at = np.flatnonzero(values == high[self.number])
        return high, at[np.searchsorted(self.number[at], np.arange(len(high)))]

    def item(self, at: int) -> str:
        return self.text[at : min(at + WINDOW, int(self.stop[self.number[at]]))]


def item_values(items: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Value of the folded machine for each item as a whole."""
    row, code, w = subsequences(items)
    return np.bincount(row, w * weights[code], minlength=len(items)) + bias


def pieces(text: str, limit: int = 1_000_000):
    """A very long text cut at line feeds, or else behind a space, into parts of about
    ``limit`` characters."""
    at = 0
    while len(text) - at > limit:
        cut = max(text.rfind("\n", at + limit // 2, at + limit), text.rfind(" ", at + limit // 2, at + limit))
        cut = cut + 1 if cut >= 0 else at + limit
        yield text[at:cut]
        at = cut
    yield text[at:]


def document_values(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The highest window's value of each text; the bias where it has none."""
    parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
    out = np.full(len(texts), -np.inf)
    for a, z in slices([p for _, p in parts], 100_000):
        some = Windows([p for _, p in parts[a:z]])
        high, _ = some.best(some.values(weights))
        np.maximum.at(out, np.array([i for i, _ in parts[a:z]], np.int64)[some.owner], high)
    return np.where(np.isfinite(out), out, 0.0) + bias


def landmark_features(items: list[str], marks: list[str]) -> np.ndarray:
    """Kernel values of items (rows) to landmarks."""
    m_row, m_code, m_weight = subsequences(marks)
    order = np.argsort(m_code, kind="stable")
    m_row, m_code, m_weight = m_row[order], m_code[order], m_weight[order]
    out = []
    for at in range(0, len(items), 2000):
        some = items[at : at + 2000]
        row, code, weight = subsequences(some)
        first, last = np.searchsorted(m_code, code), np.searchsorted(m_code, code, "right")
        n = last - first
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)  # all pairs of equal numbers
        cell = np.repeat(row, n) * len(marks) + m_row[k]
        out.append(np.bincount(cell, np.repeat(weight, n) * m_weight[k], minlength=len(some) * len(marks)).reshape(-1, len(marks)))
    return np.concatenate(out) if out else np.zeros((0, len(marks)))


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Newton steps on the primal of the linear machine; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    v = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], penalty)
    shrink[-1] = 1e-9
    for _ in range(30):
        inside = y * (x @ v) < 1
        a, w = x[inside], weight[inside]
        new = np.linalg.solve((a * w[:, None]).T @ a + np.diag(shrink), (a * w[:, None]).T @ y[inside])
        if np.allclose(new, v, atol=1e-7):
            break
        v = new
    return v


def spoiled(items: list[str], times: int) -> list[str]:
    """Items with a character put in somewhere."""
    rnd, out = np.random.default_rng(7), []
    for w in items * times:
        at = int(rnd.integers(1, max(2, len(w))))
        out.append(w[:at] + "x.-_1*q"[int(rnd.integers(7))] + w[at:])
    return out


def train(positive: list[str], negative: list[str], landmarks: int = LANDMARKS) -> tuple[np.ndarray, float]:
    """Weights of all subsequences, and the bias."""
    rnd = np.random.default_rng(7)
    own = positive + spoiled(positive, SPOILED)
    marks = [positive[i] for i in rnd.permutation(len(positive))[: landmarks * 2 // 3]] + [negative[i] for i in rnd.permutation(len(negative))[: landmarks // 3]]
    marks = [m for m in dict.fromkeys(marks) if len(m) >= 4]
    k = landmark_features(marks, marks)
    value, vector = np.linalg.eigh(k)
    keep = value > 1e-8 * value.max()
    white = vector[:, keep] / np.sqrt(value[keep])
    items = own + negative
    y = np.array([1.0] * len(own) + [-1.0] * len(negative))
    weight = np.where(y > 0, 0.5 / len(own), 0.5 / len(negative))
    v = squared_hinge(landmark_features(items, marks) @ white, y, weight)
    beta = white @ v[:-1]
    row, code, w = subsequences(marks)
    return np.bincount(code, beta[row] * w, minlength=1 << BITS), float(v[-1])


def platt(value: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic that fits labels to values, both labels of equal weight."""
    x = np.stack([value, np.ones(len(value))], axis=1)
    weight = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    target = np.where(toxic, 0.98, 0.02)
    v = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (target - p)) - 1e-6 * v)
        v = v + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(v[0]), float(v[1])


def _contiguous(batches):
    """Numbers of documents that hold each contiguous subsequence, by label."""
    n = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
            seen = []
            for part in pieces(text):
                some = Windows([part])
                if len(some.x) > 3:
                    place = np.arange(len(some.x) - 3)
                    seen.append(np.unique(numbered(some.x, 1, 2, 3)[some.stop[some.number[: len(place)]] > place + 3]))
            if seen:
                n[int(toxic), np.unique(np.concatenate(seen))] += 1
    at = np.flatnonzero(n.sum(axis=0))
    yield pd.DataFrame({"code": at, "toxic": n[1, at], "clean": n[0, at]})


def first_machine(sample: DataFrame, toxic: int, clean: int) -> np.ndarray:
    """Standard scores of the contiguous subsequences that tell toxic from clean documents."""
    n = sample.mapInPandas(_contiguous, "code int, toxic long, clean long").groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()  # 2**BITS rows at most
    p1, p0, p = (n["toxic"] + 0.5) / (toxic + 1), (n["clean"] + 0.5) / (clean + 1), (n["toxic"] + n["clean"] + 1) / (toxic + clean + 2)
    z = (p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / toxic + 1 / clean))
    out = np.zeros(1 << BITS)
    out[n["code"]] = np.where(np.abs(z) > SIGNIFICANT, z, 0)
    return out


class Machine:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights.astype(np.float32), bias, slope, offset

    def probabilities(self, texts: list[str]) -> np.ndarray:
        value = document_values(texts, self.weights, self.bias)
        return np.round(1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -30, 30))), 9)


def _witnesses(weights: np.ndarray, patterns: list, witnesses: int):
    """Highest sentences of each document and, of clean ones, any one (kind 1)."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, toxic, text in zip(batch["text_key"], batch["toxic"], batch["text"], strict=True):
                found: dict[str, float] = {}
                for part in pieces(text):
                    some = Windows([part])
                    high, at = some.best(some.values(weights, patterns))
                    for i in np.argsort(-high, kind="stable")[:witnesses]:
                        item = some.item(at[i])
                        found[item] = max(found.get(item, -np.inf), float(high[i]))
                    if len(at) and not toxic:
                        i = int(key[:8], 16) % len(at)
                        begin = int(some.start[i])
                        rows.append((key, toxic, 1, 0.0, some.item(begin)))
                rows += [(key, toxic, 0, value, item) for item, value in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:witnesses]]
            yield pd.DataFrame(rows, columns=["text_key", "toxic", "kind", "value", "item"])

    return run


def fit(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, rounds: int = ROUNDS, witnesses: int = WITNESSES, landmarks: int = LANDMARKS) -> Machine | None:
    """``documents``: doc_id, text of rows that may be learned from."""
    ids = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = documents.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", text_key("text"))
    keys = materialize(texts.select("doc_id", "text_key").join(ids, "doc_id").groupBy("text_key").agg(F.max("toxic").alias("toxic")), "toxic-keys")
    chosen = hash_sample(keys, "text_key", "toxic", max_docs)  # at most 2 * max_docs rows
    sample = materialize(texts.join(F.broadcast(chosen), "text_key").groupBy("text_key", "toxic").agg(F.min("text").alias("text")), "toxic-sample")
    unseen = F.substring("text_key", 9, 1).isin(*"0123")
    counts = {(r["u"], r["toxic"]): r["count"] for r in sample.groupBy(unseen.alias("u"), "toxic").count().collect()}
    n = {y: counts.get((False, y), 0) for y in (0, 1)}
    if not n[0] or not n[1]:
        return None
    # Where the quarter lacks a label, the whole sample has to do.
    apart = sample.filter(unseen) if counts.get((True, 0)) and counts.get((True, 1)) else sample
    sample = sample.filter(~unseen)
    weights, bias, patterns = first_machine(sample, n[1], n[0]).astype(np.float32), 0.0, [p for p in PATTERNS if p[2] == 3]
    for round_ in range(rounds):
        got = sample.mapInPandas(_witnesses(weights, patterns, witnesses), "text_key string, toxic int, kind int, value double, item string").toPandas()  # bounded by max_docs
        got = got[got["item"].str.len() >= 4].sort_values(["text_key", "kind", "value", "item"], ascending=[True, True, False, True])
        first = ~got.duplicated(["text_key", "kind"])
        toxic = (got["toxic"] == 1) & (first | (got["value"] + bias > 0))
        positive, negative = list(dict.fromkeys(got.loc[toxic, "item"])), list(dict.fromkeys(got.loc[got["toxic"] == 0, "item"]))
        if not positive or not negative:
            return None
        (weights, bias), patterns = train(positive, negative, landmarks), PATTERNS
        weights = weights.astype(np.float32)

    def measured(batches):
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "value": document_values(batch["text"].tolist(), weights, bias)})

    got = apart.mapInPandas(measured, "toxic int, value double").toPandas()  # a number for each of the sample
    return Machine(weights, bias, *platt(got["value"].to_numpy(), got["toxic"].to_numpy() == 1))


def score_toxicity(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = documents.select("doc_id", "text").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    shared = documents.sparkSession.sparkContext.broadcast(fit(rows.filter("not held_out"), labels, max_docs))

    def run(batches):
        for batch in batches:
            texts, machine = [t or "" for t in batch.column(2).to_pylist()], shared.value
            p = machine.probabilities(texts) if machine else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
