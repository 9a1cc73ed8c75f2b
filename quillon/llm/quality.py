"""Document quality by pairwise ranking (Bradley-Terry).

A document's score is linear in features of its text; that of two documents, one labelled good and one bad, the good one
is better has the logistic probability of the difference. The weights maximise that likelihood over PAIRS preference
pairs, with a small ridge. The threshold is a quantile of the training scores, at which the pairs' classes part best;
there the published score is CUT, so that `score >= CUT` is the decision.

Labels come from a bounded sample: about MAX_LABELS of each class, chosen by hash (no more are held by the driver); only
features of these documents are collected. Features are shares and ratios over the whole text, and ramps of them between
quantiles of the sample. Empty and null texts have the features of no text and get a score too. With labels of one class
only, or none, every score is CUT. A document with contradicting labels counts as bad; repeated rows count once in the
fit and give repeated results; a score equal to CUT is predicted 1; other columns are not read; empty tables give empty
results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, doc_texts, hash_share

MAX_LABELS, PAIRS, CUT, RIDGE = 3000, 40_000, 0.3, 1e-3
KNOTS = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)
_SYMBOLS = re.compile(rb"[#$%&*!|@^~<>=+\\{}\[\]]")
_UPPER, _DIGITS, _ENDS, _MARKED = re.compile(rb"[A-Z]"), re.compile(rb"[0-9]"), re.compile(rb"[.!?]"), re.compile(rb"[^\w\s.,;:'\"()-]{2,}", re.ASCII)


def features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    size, n = max(1, len(raw)), max(1, len(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ascii_only = re.sub(rb"[\x80-\xff]+", b"", raw)
    return [
        math.log1p(len(words)),
        len(_SYMBOLS.findall(raw)) / size,
        len(_UPPER.findall(raw)) / size,
        len(_DIGITS.findall(raw)) / size,
        len(_ENDS.findall(raw)) / n,
        len(_MARKED.findall(ascii_only)) / n,
        raw.count(b"|") / n,
        raw.count(b"\n") / n,
        len(counts) / n,
        len(counts) / n**0.85,
        max(counts.values(), default=0) / n,
        repeated / n,
        size / n,
        1 - len(set(lines)) / max(1, len(lines)),
        max(map(len, words), default=0) / 20,
    ]


class Ranker:
    """Ramps of standardised features, weights and the score's cut; see the module."""

    def __init__(self, good: np.ndarray, bad: np.ndarray, seed: int = 7):
        self.known = len(good) > 0 and len(bad) > 0
        if not self.known:
            return
        # both classes count alike, however many labels each has
        both = np.concatenate([np.quantile(x, np.linspace(0, 1, 401), axis=0) for x in (good, bad)])
        self.knots = np.quantile(both, KNOTS, axis=0)
        g, b = self._expand(good), self._expand(bad)
        self.mean, self.scale = np.concatenate([g, b]).mean(0), np.concatenate([g, b]).std(0) + 1e-9
        g, b = (g - self.mean) / self.scale, (b - self.mean) / self.scale
        rng = np.random.default_rng(seed)
        diff = g[rng.integers(0, len(g), PAIRS)] - b[rng.integers(0, len(b), PAIRS)]
        self.weights = np.zeros(g.shape[1])
        for _ in range(12):  # Newton steps of the logistic loss
            p = 1 / (1 + np.exp(-np.clip(diff @ self.weights, -30, 30)))
            slope = diff.T @ (p - 1) / PAIRS + RIDGE * self.weights
            curve = (diff * (p * (1 - p))[:, None]).T @ diff / PAIRS + RIDGE * np.eye(len(slope))
            self.weights -= np.linalg.solve(curve, slope)
        sg, sb = g @ self.weights, b @ self.weights
        scores = np.concatenate([sg, sb])
        options = np.quantile(scores, np.linspace(0.001, 0.999, 999))
        merit = np.array([(sg >= t).mean() + (sb < t).mean() for t in options])
        best = options[merit >= merit.max() - 1e-12]
        self.cut, self.spread = float(best[(len(best) - 1) // 2]), float(scores.std() / 3 + 1e-9)

    def _expand(self, x: np.ndarray) -> np.ndarray:
        out = [x]
        for lo, hi in zip(self.knots, self.knots[1:], strict=False):
            out.append(np.clip((x - lo) / np.maximum(hi - lo, 1e-6), 0, 1))
        top = self.knots[-1]
        return np.concatenate([np.clip(x, self.knots[0], top), *out[1:]], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), CUT)
        z = ((self._expand(x) - self.mean) / self.scale @ self.weights - self.cut) / self.spread
        return 1 / (1 + np.exp(-np.clip(z + math.log(CUT / (1 - CUT)), -500, 500)))


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))], ["label", "x"])

    return arrow_map(docs, run, "label int, x array<double>")


def fit(documents: DataFrame, labels: DataFrame, train: Column, label_col: str = "quality", max_labels: int = MAX_LABELS) -> Ranker:
    """train: a condition on doc_id that says which labels may be used."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(train & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    chosen = F.lit(False)
    for label, n in counts.items():
        chosen = chosen | ((F.col("label") == label) & hash_share(F.col("doc_id"), min(1.0, max_labels / n)))
    # about 2 * max_labels rows whatever the input
    sample = known.where(chosen).groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = doc_texts(documents).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text").distinct()
    rows = _features(texts.select("label", "text")).collect()
    part = [np.array([r["x"] for r in rows if r["label"] == k], float) for k in (1, 0)]
    return Ranker(*(x[np.lexsort(x.T)] if len(x) else x for x in part))


def score(documents: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, score, predicted of every row."""
    docs = doc_texts(documents)
    sent = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            s = sent.value.score(np.array([features(t) for t in texts], float)) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return arrow_map(docs, run, "doc_id long, score double, predicted int")
