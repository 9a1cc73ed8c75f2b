"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes weighted by distance.

Terms are words in lower case and the beginnings of words (PREFIXES letters), so that inflected and compounded words have
something in common. The vocabulary is the terms that are most surely (by the likelihood ratio, at least MIN_RATIO) in
MIN_LIFT times as large a share of the toxic examples as of the others, MAX_TERMS at most; all other words of a text count as one further term, so that a
vector tells how large a part of a text the vocabulary's terms are. A weight is the term's share of the words, times
ln((1 + N) / (1 + df)) + 1 with the document frequencies of all documents; vectors have length 1.

Examples lie in blocks of BLOCK, neighbours by their heaviest term; a term has for each block its largest weight, and its
postings in order of the blocks. A search takes the blocks by falling upper bound (query weights times block maxima) and
ends where the next bound is below the k-th best cosine; so what it finds is exact. All examples as near as the
last one vote as well, so that ties are not cut.

A neighbour at angle a votes with its class's weight (labelled rows of the class for each example of it) over a power of
a + SOFT. The share of toxic votes becomes a probability by isotonic regression over the examples, each scored by the
others; the number of neighbours and the power are those of NEAREST and POWERS that do best there (by squared error). The
neighbours are the evidence. `predicted` is 1 from CUT.

Labels come from a bounded sample: about MAX_LABELS of each class, by hash; of examples that share their two least
hashes of word triples (copies, mostly) one stays. With labels of one class only, or none, every score is that class's share (0
without labels). A document with contradicting labels counts as toxic. Null and empty texts have the vector without any
vocabulary term and get a score; repeated rows give repeated results; texts are read whole; other columns are not read;
an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, discard, doc_texts, hash_share, materialize

MAX_LABELS, MAX_TERMS, MIN_RATIO, MIN_LIFT, MIN_EXAMPLES = 4000, 4000, 12.0, 3, 3
PREFIXES, NEAREST, POWERS, BLOCK, SOFT, CUT, EVIDENCE = range(4, 9), (3, 5, 9, 15), (1, 2, 3), 32, 0.02, 0.7, 5
_WORD = re.compile(r"\w+")
#: In tables of counts the term of all documents; no word has a space.
_ALL = " "

Vector = tuple[tuple[int, ...], tuple[float, ...]]


def counted(text: str | None) -> Counter[str]:
    return Counter(_WORD.findall((text or "").lower()))


def terms(word: str) -> Iterator[str]:
    """A word's terms: the word, marked as whole, and its beginnings."""
    yield word + "$"
    for n in PREFIXES:
        if len(word) < n:
            break
        yield word[:n]


def sketch(text: str | None) -> int:
    """Of the checksums of three words in a row the two least ones, as one number: copies share it, near ones mostly."""
    words = [w.encode() for w in _WORD.findall((text or "").lower())]
    least = sorted({zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))})[:2]
    return zlib.crc32(repr(least).encode())


class Vocabulary:
    """Term -> number; weights of the terms, the last one of all other words."""

    def __init__(self, names: list[str], df: Mapping[str, int], n: int):
        self.number = {t: i for i, t in enumerate(names)}
        self.weight = np.log((1 + n) / (1 + np.array([*(df.get(t, 0) for t in names), n]))) + 1
        # most words are told apart from the vocabulary by how they begin
        self.starts = {t[: PREFIXES[0]] for t in names}

    def hits(self, counts: Counter[str]) -> tuple[Counter[int], int]:
        """How often each term is there, and how many words have no term."""
        found: Counter[int] = Counter()
        other, first, number, starts = 0, PREFIXES[0], self.number, self.starts
        for w, k in counts.items():
            if w[:first] in starts or (len(w) < first and w + "$" in starts):
                own = [i for t in terms(w) if (i := number.get(t)) is not None]
                if own:
                    for i in own:
                        found[i] += k
                    continue
            other += k
        return found, other

    def vector(self, counts: Counter[str]) -> Vector:
        """Term numbers, ascending, and weights of length 1."""
        found, other = self.hits(counts)
        if not found:
            return (len(self.number),), (1.0,)
        at = sorted(found)
        tf = np.array([found[i] for i in at] + [other], float)
        at.append(len(self.number))
        w = tf * self.weight[at]
        if not other:
            at, w = at[:-1], w[:-1]
        return tuple(at), tuple((w / np.sqrt(w @ w)).tolist())


class BlockMaxIndex:
    """Labelled vectors by term and block; see the module. ids ascending break ties in the evidence."""

    def __init__(self, ids: list[int], vectors: list[Vector], size: int, block: int = BLOCK):
        heaviest = [(v[0][int(np.argmax(v[1]))], round(max(v[1]), 6), i) for v, i in zip(vectors, ids, strict=True)]
        # those where no vocabulary term outweighs the rest are neighbours by their heaviest one besides
        second = [max(((w, t) for t, w in zip(*v, strict=True) if t != size - 1), default=(0.0, -1)) for v in vectors]
        order = sorted(range(len(ids)), key=lambda k: (heaviest[k][0], second[k][1], heaviest[k][1], ids[k]))
        self.order = np.array(order, np.int64)
        self.n, self.block = len(ids), block
        self.blocks = -(-self.n // block)
        posted: dict[int, list[tuple[int, float]]] = {}
        for place, k in enumerate(order):
            for t, w in zip(*vectors[k], strict=True):
                posted.setdefault(t, []).append((place, w))
        self.postings = {}
        for t, p in posted.items():
            places, weights = np.array([x[0] for x in p], np.int32), np.array([x[1] for x in p])
            there, starts = np.unique(places // block, return_index=True)
            self.postings[t] = (places // block, places % block, weights, there, np.append(starts, len(p)), np.maximum.reduceat(weights, starts))

    def search(self, query: Vector, k: int, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """Of the k nearest, and all as near as the last of them: numbers and cosines; and how many blocks were looked at.
        Only examples that share a term with the query are near it. The blocks with the highest bounds come first, as many
        as before at each turn; those beyond the last turn are never looked at."""
        lists = [(w, self.postings[t]) for t, w in zip(*query, strict=True) if t in self.postings]
        bound = np.zeros(self.blocks)
        for w, (*_, there, _, top) in lists:
            bound[there] += w * top
        turn = np.argsort(-bound, kind="stable")
        turn = turn[: np.count_nonzero(bound > 0)]
        found, scores, least, looked, at_once = [], [], 0.0, 0, 8
        held = np.empty(0)
        while looked < len(turn):
            chosen = turn[looked : looked + at_once]
            if len(held) >= k:
                chosen = chosen[bound[chosen] >= least - 1e-9]
            if not len(chosen):
                break
            looked += len(chosen)
            got, score = self._sums(lists, chosen)
            number = self.order[got]
            if leave_out >= 0:
                got, score, number = got[number != leave_out], score[number != leave_out], number[number != leave_out]
            found.append(number)
            scores.append(score)
            held = np.concatenate([held, score])
            if len(held) >= k:
                held = np.partition(held, len(held) - k)[len(held) - k :]
                least = held[0]
            if len(chosen) < at_once:
                break
            at_once = 2 * looked
        if not found:
            return np.empty(0, np.int64), np.empty(0), looked
        number, score = np.concatenate(found), np.minimum(np.concatenate(scores), 1.0)
        near = score >= (least if len(held) >= k else 0.0) - 1e-9
        return number[near], score[near], looked

    def _sums(self, lists: list, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in these blocks with a term of the query, and their cosines."""
        row = np.full(self.blocks, -1)
        row[chosen] = np.arange(len(chosen))
        sums = np.zeros((len(chosen), self.block))
        flat = sums.reshape(-1)
        for w, (block, at, weights, there, starts, _) in lists:
            if 16 * len(chosen) < len(there):  # few of the list's blocks: their stretches
                j = np.searchsorted(there, chosen)
                for b, i in zip(chosen.tolist(), j.tolist(), strict=True):
                    if i < len(there) and there[i] == b:
                        lo, hi = starts[i], starts[i + 1]
                        sums[row[b], at[lo:hi]] += w * weights[lo:hi]
            else:
                r = row[block]
                mine = np.flatnonzero(r >= 0)
                flat[r[mine] * self.block + at[mine]] += w * weights[mine]
        got = np.flatnonzero(flat > 0)
        return chosen[got // self.block] * self.block + got % self.block, flat[got]


def _first(number: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest, and all as near as the last of them."""
    if len(score) <= k:
        return number, score
    near = score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-9
    return number[near], score[near]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps that fit y best, as points (mean x of a step, its height) to interpolate between."""
    at, which = np.unique(x, return_inverse=True)
    w = np.bincount(which, weight)
    pools: list[tuple[float, float, float]] = []
    for wx, wy, n in zip(at * w, np.bincount(which, weight * y), w, strict=True):
        while pools and pools[-1][1] * n >= wy * pools[-1][2]:  # the step before is no lower: they are one
            px, py, pn = pools.pop()
            wx, wy, n = wx + px, wy + py, n + pn
        pools.append((wx, wy, n))
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


class Judge:
    """Examples, their index and the calibration of their votes."""

    def __init__(self, vocabulary: Vocabulary, examples: Iterable[tuple[int, int, Vector]], class_rows: Mapping[int, int], nearest: Sequence[int] = NEAREST):
        rows = sorted(examples, key=lambda r: r[0])
        self.vocabulary, self.nearest, self.power = vocabulary, max(nearest), 1
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.int64)
        total = sum(class_rows.values())
        self.share = class_rows.get(1, 0) / total if total else 0.0
        self.known = len(set(self.labels.tolist())) == 2
        if not self.known:
            return
        n = np.bincount(self.labels, minlength=2)
        self.class_weight = np.array([class_rows.get(c, 0) / n[c] for c in (0, 1)])
        self.index = BlockMaxIndex(self.ids.tolist(), [r[2] for r in rows], len(vocabulary.weight))
        self.alone: Vector = ((len(vocabulary.number),), (1.0,))
        self.of_rest = self.index.search(self.alone, self.nearest)  # what every text without a vocabulary term is nearest to
        weight, truth = self.class_weight[self.labels], self.labels.astype(float)
        options = [(k, power) for k in nearest for power in POWERS]
        votes = np.array([self._votes(r[2], i, options) for i, r in enumerate(rows)])
        best = np.inf
        for column, (k, power) in enumerate(options):
            steps = isotonic(votes[:, column], truth, weight)
            error = float((weight * (np.interp(votes[:, column], *steps) - truth) ** 2).sum())
            if error < best - 1e-9:
                best, self.nearest, self.power, self.steps = error, k, power, steps
        self.of_rest = (*_first(*self.of_rest[:2], self.nearest), self.of_rest[2])

    def _votes(self, query: Vector, own: int, options: list[tuple[int, int]]) -> list[float]:
        """The votes on an example by the others, for each number of neighbours and power."""
        number, score, _ = self.of_rest if query == self.alone else self.index.search(query, self.nearest, own)
        if query == self.alone and len(number) > self.nearest:
            # all that are like it are as near: what is left of their votes without its own, whatever the options
            each = np.bincount(self.labels[number], minlength=2) - np.eye(2, dtype=int)[self.labels[own]]
            return [float(each[1] * self.class_weight[1] / (each @ self.class_weight))] * len(options)
        if query == self.alone:
            number, score, _ = self.index.search(query, self.nearest, own)
        found = {k: _first(number, score, k) for k in {k for k, _ in options}}
        return [self._share(*found[k], power) for k, power in options]

    def _share(self, number: np.ndarray, score: np.ndarray, power: int) -> float:
        if not len(number):
            return self.share
        label = self.labels[number]
        votes = self.class_weight[label] / (np.arccos(np.clip(score, -1, 1)) + SOFT) ** power
        return float(votes[label == 1].sum() / votes.sum())

    def judged(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score and evidence (doc_id, label, cosine) of a text."""
        if not self.known:
            return self.share, []
        query = self.vocabulary.vector(counted(text))
        if query == self.alone and hasattr(self, "rest"):
            return self.rest
        number, score, _ = self.of_rest if query == self.alone else self.index.search(query, self.nearest)
        best = np.lexsort((number, -np.round(score, 9)))[:EVIDENCE]
        out = float(np.interp(self._share(number, score, self.power), *self.steps)), [(int(self.ids[number[i]]), int(self.labels[number[i]]), float(score[i])) for i in best]
        if query == self.alone:
            self.rest = out
        return out


def _sampled(documents: DataFrame, labels: DataFrame, train: Column, label_col: str, max_labels: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, label, text, sketch of the examples (written), and the labelled rows of each class."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(train & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    chosen = F.lit(False)
    for label, n in counts.items():
        chosen = chosen | ((F.col("label") == label) & hash_share(F.col("doc_id"), min(1.0, max_labels / n)))
    texts = doc_texts(documents).join(F.broadcast(known.where(chosen)), "doc_id").select("doc_id", "label", "text")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = pa.array([sketch(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "label", "text")), s], ["doc_id", "label", "text", "sketch"])

    every = materialize(arrow_map(texts, sketched, "doc_id long, label int, text string, sketch long"), "examples")
    first = every.groupBy("label", "sketch").agg(F.min("doc_id").alias("doc_id"))
    # of repeated rows of one doc_id the least text
    kept = every.join(F.broadcast(first), ["label", "sketch", "doc_id"]).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    out = materialize(kept, "examples")
    discard(every)
    return out, counts


def _telling(examples: DataFrame, max_terms: int, min_ratio: float) -> list[str]:
    """The terms that part the classes best, by the likelihood ratio of a term and the label."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, int]] = Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                found.update((t, label) for t in {t for w in counted(text) for t in terms(w)})
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array(found.values(), pa.int64())], ["term", "label", "n"])

    sizes = {r[0]: r[1] for r in examples.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return []
    counts = arrow_map(examples.select("text", "label"), spread, "term string, label int, n long").groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("n"))
    part = lambda seen, of: f"if({seen} > 0, {seen} * ln({seen} / ({of})), 0)"
    there, not_there = f"n / {n0 + n1}", f"(1 - n / {n0 + n1})"
    ratio = " + ".join([part("a", f"{n1} * {there}"), part("(n - a)", f"{n0} * {there}"), part(f"({n1} - a)", f"{n1} * {not_there}"), part(f"({n0} - n + a)", f"{n0} * {not_there}")])
    best = counts.where(f"n >= {MIN_EXAMPLES} and a * {n0} > {MIN_LIFT} * (n - a) * {n1}").select("term", F.expr(f"round(2 * ({ratio}), 6)").alias("ratio")).where(f"ratio >= {min_ratio}")
    return [r[0] for r in best.orderBy(F.desc("ratio"), "term").limit(max_terms).collect()]


def _frequencies(docs: DataFrame, names: list[str]) -> tuple[dict[str, int], int]:
    """In how many documents each term is, and how many there are; a table of at most MAX_TERMS rows is collected."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(names, {}, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        n = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total.update(sent.value.hits(counted(text))[0].keys())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([-1, *total], pa.int32()), pa.array([n, *total.values()], pa.int64())], ["term", "n"])

    found = {r[0]: r[1] for r in arrow_map(docs.select("text"), run, "term int, n long").groupBy("term").agg(F.sum("n")).collect()}
    return {t: found.get(i, 0) for i, t in enumerate(names)}, found.get(-1, 0)


def fit(documents: DataFrame, labels: DataFrame, train: Column, label_col: str = "toxic", max_labels: int = MAX_LABELS, max_terms: int = MAX_TERMS, min_ratio: float = MIN_RATIO) -> Judge:
    """train: a condition on doc_id that says which labels may be used."""
    examples, class_rows = _sampled(documents, labels, train, label_col, max_labels)
    names = _telling(examples, max_terms, min_ratio)
    vocabulary = Vocabulary(names, *_frequencies(doc_texts(documents), names))
    sent = examples.sparkSession.sparkContext.broadcast(vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.vector(counted(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([v[0] for v in found], pa.list_(pa.int32())), pa.array([v[1] for v in found], pa.list_(pa.float64()))], ["doc_id", "label", "at", "w"])

    rows = arrow_map(examples, vectors, "doc_id long, label int, at array<int>, w array<double>").collect()
    discard(examples)
    return Judge(vocabulary, [(r["doc_id"], r["label"], (tuple(r["at"]), tuple(r["w"]))) for r in rows], class_rows)


def score(documents: DataFrame, judge: Judge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, evidence (doc_id, label, cosine of the nearest examples) of every row."""
    docs = doc_texts(documents, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(judge)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.judged(t) for t in batch.column("text").to_pylist()]
            seen = [[{"doc_id": d, "label": y, "cosine": c} for d, y, c in near] for _, near in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= CUT) for s, _ in found], pa.int32()), pa.array(seen, evidence)], ["doc_id", "score", "predicted", "evidence"])

    return arrow_map(docs, run, "doc_id long, score double, predicted int, evidence array<struct<doc_id long, label int, cosine double>>")
