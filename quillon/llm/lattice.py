"""Text probability by all segmentations into subwords.

The pieces are those of an existing vocabulary, all of them, with a byte each for what it lacks. A word's probability is
the sum over all ways to write it as pieces, by a forward recursion in log space. A piece weighs by its vocabulary score:
published scores that are merge ranks fall with the rank r, so such a piece weighs 1/(r + SHIFT); weights sum to 1. Each
step of a text is a word or its end; the end has its share of the training tokens (add-one), words have the rest. As each
word begins with a space and no piece has one inside, a step's outcomes sum to 1, and `score` is the log10 of the text's
marginal probability.

`fitted_score` is a second score whose weights are learnt from the corpus: ROUNDS of expectation maximisation over the
words that training documents have once (they stand for what is unknown; a backward recursion tells how often each piece
is expected), and two further edges for a whole word. One has the word's own share of training tokens; these edges have
together as much weight as words that occur more than once have (Good-Turing), less a little for unknown words. The other
has the word's share of the document's words before it; these have AGAIN of each step's weight. Its outcomes sum to at
most 1 as well.

The counts of words are gathered from all documents. The KNOWN most frequent words of at most KNOWN_BYTES, with their
scores, are sent to the executors (that bounds what is sent); each document's other words meet the word table in a join.

`base` is the add-one unigram score of the words. A null text counts as empty and has the end alone. Repeated rows give
repeated results; other columns are not read; without training text every known count is 0, and no score is infinite.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, discard, materialize

SHIFT, ROUNDS, AGAIN, KNOWN, KNOWN_BYTES, FLUSH = 2.7, 2, 0.15, 100_000, 64, 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NONE = -1e30


class Pieces:
    """A vocabulary's pieces as bytes, with log weights; found by the hash of a substring and its length."""

    def __init__(self, model: bytes):
        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        start: dict[bytes, float] = {bytes([b]): 1 / (p.get_piece_size() + SHIFT) for b in range(256)}
        for i in range(p.get_piece_size()):
            if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i)):
                raw = p.id_to_piece(i).replace("▁", " ").encode().translate(_LOWER)
                if raw and b" " not in raw[1:]:
                    start[raw] = max(start.get(raw, 0.0), 1 / (SHIFT - min(0.0, p.get_score(i))))
        self.pieces = sorted(start)
        weights = np.array([start[x] for x in self.pieces])
        self.log = np.log(weights / weights.sum())
        self.longest = max(map(len, self.pieces))
        self.tables = []
        for n in range(1, self.longest + 1):
            at = np.array([i for i, x in enumerate(self.pieces) if len(x) == n], np.int64)
            h = np.array([_hash(self.pieces[i]) for i in at], np.uint64)
            order = np.argsort(h)
            self.tables.append((h[order], at[order]))

    def edges(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Words as rows of bytes with a leading space, their lengths, and for each place the edges that end there:
        (word, start, piece)."""
        size = np.array([len(w) + 1 for w in words])
        width = int(size.max())
        text = np.zeros((len(words), width), np.uint64)
        flat = np.frombuffer(b"".join(b" " + w for w in words), np.uint8)
        inside = np.arange(width)[None] < size[:, None]
        text[inside] = flat
        ends = []
        hashed = [None] * (self.longest + 1)
        for n in range(1, min(self.longest, width) + 1):
            with np.errstate(over="ignore"):
                part = text[:, n - 1 :] + np.uint64(1)
                hashed[n] = part if n == 1 else (hashed[n - 1][:, : width - n + 1] * _ODD + part)
        for end in range(1, width + 1):
            rows, starts, found = [], [], []
            alive = np.flatnonzero(size >= end)
            for n in range(1, min(self.longest, end) + 1):
                keys, at = self.tables[n - 1]
                if len(keys):
                    h = hashed[n][alive, end - n]
                    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = keys[place] == h
                    rows.append(alive[hit])
                    starts.append(np.full(int(hit.sum()), end - n))
                    found.append(at[place[hit]])
            ends.append(tuple(map(np.concatenate, (rows, starts, found))))
        return text, size, ends

    def forward(self, size: np.ndarray, ends: list, log: np.ndarray) -> np.ndarray:
        """Log probabilities of all prefixes; sums are kept in scale by each word's largest term so far."""
        alpha = np.full((len(size), int(size.max()) + 1), _NONE)
        alpha[:, 0] = 0
        for end, (w, s, p) in enumerate(ends, 1):
            term = alpha[w, s] + log[p]
            top = np.full(len(size), _NONE)
            np.maximum.at(top, w, term)
            total = np.bincount(w, np.exp(term - top[w]), len(size))
            some = total > 0
            alpha[some, end] = top[some] + np.log(total[some])
        return alpha

    def scores(self, words: list[bytes], *logs: np.ndarray) -> np.ndarray:
        """A row for each set of weights: the words' log probabilities."""
        _, size, ends = self.edges(words)
        return np.stack([self.forward(size, ends, log)[np.arange(len(words)), size] for log in logs])

    def expected(self, words: list[bytes], counts: np.ndarray, log: np.ndarray) -> np.ndarray:
        """How often each piece is expected in so many of each word."""
        _, size, ends = self.edges(words)
        alpha = self.forward(size, ends, log)
        beta = np.full(alpha.shape, _NONE)
        beta[np.arange(len(words)), size] = 0
        whole = alpha[np.arange(len(words)), size]
        out = np.zeros(len(log))
        for end in range(len(ends), 0, -1):
            w, s, p = ends[end - 1]
            live = beta[w, end] > _NONE / 2
            w, s, p = w[live], s[live], p[live]
            through = log[p] + beta[w, end]
            out += np.bincount(p, counts[w] * np.exp(alpha[w, s] + through - whole[w]), len(log))
            beta[w, s] = np.logaddexp(beta[w, s], through)
        return out


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_pieces: dict[int, Pieces] = {}


def _hash(raw: bytes) -> int:
    h = 0
    for c in raw:
        h = (h * int(_ODD) + c + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _load(model: bytes) -> Pieces:
    if hash(model) not in _pieces:
        _pieces[hash(model)] = Pieces(model)
    return _pieces[hash(model)]


def _grouped(words: list[bytes]) -> Iterator[np.ndarray]:
    """Places of words of like length, in groups that fit in memory; a very long word comes alone."""
    order = np.argsort([len(w) for w in words], kind="stable")
    at = 0
    while at < len(order):
        n = max(1, min(len(order) - at, 2000))
        while n > 1 and len(words[order[at + n - 1]]) * n > 40_000:
            n //= 2
        yield order[at : at + n]
        at += n


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (occurrences in training documents; 0 for words of others only). docs: text, train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        seen: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            words = list(counts) + [w for w in seen if w not in counts]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([counts[w] for w in words], pa.int64())], ["word", "c"])
            counts.clear()
            seen.clear()
            return out

        for batch in batches:
            for text, train in zip(batch.column("text").to_pylist(), batch.column("train").to_pylist(), strict=True):
                words = (text or "").encode().lower().split()
                if train:
                    counts.update(words)
                else:
                    seen.update(words)
            if len(counts) + len(seen) > FLUSH:
                yield flush()
        yield flush()

    return arrow_map(docs.select("text", "train"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(documents: DataFrame, train: Column, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score, fitted_score of every row. train: a condition
    on doc_id."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("train", train)
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    counts = materialize(word_counts(docs), "words")
    ends = docs.where("train").count()
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    n_all, v_all = row["n"] + ends, row["v"] + (ends > 0)
    pieces = Pieces(sent.value)
    end_share = (ends + 1) / (n_all + 2)
    whole_share = (1 - (row["once"] + 1) / (row["n"] + 2) if row["n"] else 0.0) * (1 - end_share)
    plain = log = pieces.log
    for _ in range(ROUNDS if row["n"] else 0):
        log = _expectation(counts, sent, log, pieces.log)
    base_log = math.log10(n_all + 1 * (v_all + 1))
    sent_logs = spark.sparkContext.broadcast((plain, log))
    n_words, rest_share = max(1, row["n"]), 1 - end_share - whole_share

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _load(sent.value)
        for batch in batches:
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy(zero_copy_only=False)
            by_pieces = np.empty((2, len(words)))
            for at in _grouped(words):
                by_pieces[:, at] = model.scores([words[i] for i in at], *sent_logs.value)
            with np.errstate(divide="ignore"):
                fitted = np.logaddexp(np.log(rest_share) + by_pieces[1], np.where(c > 0, np.log(whole_share * c / n_words), -np.inf))
            scores = (np.log10(c + 1.0) - base_log, (math.log(1 - end_share) + by_pieces[0]) / math.log(10), fitted / math.log(10))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), *(pa.array(x, pa.float64()) for x in scores)], ["word", "c", "base", "lp", "fp"])

    words = materialize(arrow_map(counts, weigh, "word binary, c long, base double, lp double, fp double", rows=10_000), "weights")
    top = words.where(f"c > 1 and octet_length(word) <= {KNOWN_BYTES}").orderBy(F.desc("c"), "word").limit(KNOWN).collect()
    known = spark.sparkContext.broadcast({bytes(r["word"]): (r["base"], r["lp"], r["fp"]) for r in top})
    del top
    # a step's weight is dealt to the document's own words before it and to all words
    near, rest = AGAIN * (1 - end_share), math.log10(1 - AGAIN)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, line = known.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, is_train in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "train")), strict=True):
                steps = (text or "").encode().lower().split()
                found, uid, base, lp, fp, n = Counter(steps), part << 40 | line, 0.0, 0.0, 0.0, 0
                again: dict[bytes, list[float]] = {}
                if len(found) < len(steps):
                    seen: dict[bytes, int] = {}
                    for i, w in enumerate(steps):
                        k = seen[w] = seen.get(w, 0) + 1
                        if k > 1:
                            again.setdefault(w, []).append((k - 1) / i)
                line += 1
                for w, k in found.items():
                    if (x := table.get(w)) is not None:
                        base += k * x[0]
                        lp += k * x[1]
                        fp += x[2] + rest
                        if k > 1:
                            p = 10 ** (x[2] + rest)
                            fp += sum(math.log10(p + near * share) for share in again[w])
                        n += k
                    else:
                        rows.append((uid, None, None, None, None, None, None, None, w, k, again.get(w)))
                rows.append((uid, doc_id, is_train, len(steps) + 1, n, base, lp, fp, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *(pa.float64(),) * 3, pa.binary(), pa.int64(), pa.list_(pa.float64()))
    names = ["uid", "doc_id", "train", "n_tokens", "n", "base", "lp", "fp", "word", "k", "again"]
    parts = arrow_map(docs, add_up, "uid long, doc_id long, train boolean, n_tokens long, n long, base double, lp double, fp double, word binary, k long, again array<double>")
    parts = materialize(parts, "parts")
    times = lambda c: F.sum(F.col("k") * words[c])
    repeats = F.aggregate(F.coalesce("again", F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + F.log10(F.pow(F.lit(10.0), F.col("fp") + rest) + near * x))
    rare = parts.where("word is not null").select("uid", "word", "k", "again").join(words, "word").groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("n2"), times("base").alias("base2"), times("lp").alias("lp2"), F.sum(F.col("fp") + rest + repeats).alias("fp2")
    )
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    full = parts.where("word is null").drop("word", "k", "again").join(rare, "uid", "left")
    end = F.lit(math.log10(end_share))
    out = full.select(
        "doc_id", "train", "n_tokens", (F.col("n") + none("n2") + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + none("base2") + F.lit(math.log10(ends + 1) - base_log)).alias("base_score"), (F.col("lp") + none("lp2") + end).alias("score"), (F.col("fp") + none("fp2") + end).alias("fitted_score"),
    )
    discard(counts)
    sent_logs.destroy()
    known.destroy()
    return out


def _expectation(counts: DataFrame, sent, log: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """One round: expected counts of the pieces over the words that training documents have once, with a little of the prior."""
    sent_log = counts.sparkSession.sparkContext.broadcast(log)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = _load(sent.value), None
        for batch in batches:
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy(zero_copy_only=False).astype(float)
            for at in _grouped(words):
                part = model.expected([words[i] for i in at], c[at], sent_log.value)
                total = part if total is None else total + part
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.float64())], ["piece", "x"])

    rows = arrow_map(counts.where("c = 1"), run, "piece int, x double", rows=10_000).groupBy("piece").agg(F.sum("x").alias("x")).collect()
    found = np.zeros(len(log))
    for r in rows:
        found[r["piece"]] = r["x"]
    found += np.exp(prior) * max(1.0, 1e-4 * found.sum())
    return np.log(found / found.sum())
