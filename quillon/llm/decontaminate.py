"""Benchmark decontamination: BM25 with block-max bounds over an inverted index of the test items.

The index holds the items; each training document is cut into overlapping passages, and every passage is a query. Items
are grouped by length (to the next power of two, WINDOW words at least); a length's window is twice as long as that and
moves by half its length, so that an item that was copied whole lies whole in one passage, and a long item makes no short
one's passages longer. Weights are BM25 (k1, b) of a term in an item, by document frequencies and the mean length of all
items, divided by the item's own total: a passage that holds all of an item's terms scores 1, and THRESHOLD is the same
for all items. What an item matches doesn't depend on which items share its index.

An item's terms are split into those that may be left out (together below THRESHOLD) and the essential rest. Items are
indexed in blocks; a term's entry for a block is its largest essential weight there. Only passages with an essential term
are looked at; those whose sum of entries plus the block's largest left-out total stays below THRESHOLD can't hold a
match and are skipped without scoring; the items of the other blocks are scored in full. All items at or above THRESHOLD
are retrieved, none but these. A match is confirmed if the passage has at least OVERLAP of the word triples of the item's
question and of its answer: what stands before and after its last sentence border (or two thirds of its words).

Which terms are left out first (the most frequent of a sample of SAMPLE documents) changes the time and no result.

Words are in lower case, parted by white space and ASCII punctuation. Items and texts that are null or have no word match
nothing. Equal items are found separately; repeated documents give repeated results; other columns are not read. An empty
table of items or documents gives an empty result. The items are read twice by the driver, in order, first for their
frequencies, then to be indexed in groups of at most GROUP items and GROUP_BYTES of text (or one longer item), each sent
to the executors by itself, so that what is sent is bounded.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, doc_texts, hash_share

K1, B, THRESHOLD, OVERLAP = 1.2, 0.75, 0.55, 0.5
BLOCK, GROUP, GROUP_BYTES, WINDOW = 8, 20_000, 16 << 20, 64
#: ASCII bytes that part words, and those that an item's terms left out may fall short of THRESHOLD by.
_PARTS = bytes(c if chr(c).isalnum() or chr(c) == "_" or c > 127 else 32 for c in range(256))
SLACK, SAMPLE, SAMPLE_BYTES = 0.1, 1000, 1 << 16
_BORDER = re.compile(r"[.!?\n]+\s*")


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PARTS).split()


def triples(found: list[bytes]) -> set[tuple[bytes, ...]]:
    k = min(3, len(found))
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)} if found else set()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's words before and after its last inner sentence border."""
    borders = [m.end() for m in _BORDER.finditer(text) if words(text[: m.end()]) and words(text[m.end() :])]
    if borders:
        return words(text[: borders[-1]]), words(text[borders[-1] :])
    found = words(text)
    cut = max(1, 2 * len(found) // 3)
    return found[:cut], found[cut:]


class Statistics:
    """Of all items: how many, how often each word, and their mean length."""

    def __init__(self, texts: Iterable[list[bytes]]):
        self.df: Counter[bytes] = Counter()
        self.n = self.words = 0
        for t in texts:
            self.n += 1
            self.words += len(t)
            self.df.update(set(t))

    def weights(self, t: list[bytes]) -> dict[bytes, float]:
        """An item's terms with BM25 weights that sum to 1."""
        norm = K1 * (1 - B + B * len(t) * self.n / (self.words or 1))
        raw = {w: math.log(1 + (self.n - self.df[w] + 0.5) / (self.df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in sorted(Counter(t).items())}
        total = sum(raw.values())
        return {w: x / total for w, x in raw.items()}


def _length_class(t: list[bytes]) -> int:
    return 1 << (max(WINDOW, len(t)) - 1).bit_length()


class BlockMaxIndex:
    """Items of one length class. stats: of all items; seen: which words are frequent in documents."""

    def __init__(self, items: list[tuple[int, str]], stats: Statistics | None = None, seen: Counter | None = None):
        self.ids = [i for i, _ in items]
        texts = [words(t) for _, t in items]
        stats = stats or Statistics(texts)
        self.window = 2 * max(map(_length_class, texts), default=WINDOW)
        self.parts = [tuple(map(triples, question_answer(t or ""))) for _, t in items]
        self.weights = [stats.weights(t) for t in texts]
        df = Counter(w for t in texts for w in set(t))
        seen = seen or df
        best: dict[bytes, dict[int, float]] = defaultdict(dict)
        for i, weights in enumerate(self.weights):
            left, block = 0.0, i // BLOCK
            for w, x in sorted(weights.items(), key=lambda p: (-seen[p[0]], p[0])):  # frequent terms first
                if left + x < THRESHOLD - SLACK:
                    left += x
                    continue
                left = max(left, THRESHOLD)  # from here on all are essential
                best[w][block] = max(x, best[w].get(block, 0.0))
        # a bound for each block: the largest total of an item's terms that have no entry for the block
        self.left_out = np.zeros(-(-len(items) // BLOCK))
        for i, weights in enumerate(self.weights):
            block = i // BLOCK
            self.left_out[block] = max(self.left_out[block], sum(x for w, x in weights.items() if block not in best.get(w, ())))
        self.entries = {w: tuple(found.items()) for w, found in best.items() if found}
        self.vocabulary = set(df)

    def search(self, passage: list[bytes], blocks: set[int]) -> list[tuple[int, float]]:
        terms = self.vocabulary.intersection(passage)
        out = []
        for b in blocks:
            for i in range(b * BLOCK, min(len(self.ids), (b + 1) * BLOCK)):
                weights = self.weights[i]
                score = sum(x for w, x in weights.items() if w in terms)
                if weights and score >= THRESHOLD - 1e-9:
                    out.append((i, score))
        return out

    def matches(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """Of a document: item place -> best (score, question overlap, answer overlap) of a confirmed passage."""
        found = words(text)
        entries = self.entries
        hits = [(place, w) for place, w in enumerate(found) if w in entries]
        if not hits:
            return {}
        step = self.window // 2
        last = max(0, -(-(len(found) - self.window) // step))  # the last passage's number
        sums: dict[tuple[int, int], float] = defaultdict(float)
        seen: set[tuple[int, bytes]] = set()
        for place, w in hits:
            top = min(last, place // step)
            for p in (top, top - 1) if top and place < (top + 1) * step else (top,):
                if (p, w) not in seen:
                    seen.add((p, w))
                    for block, x in entries[w]:
                        sums[p, block] += x
        wanted: dict[int, set[int]] = defaultdict(set)
        for (p, block), x in sums.items():
            if x + self.left_out[block] >= THRESHOLD - 1e-9:
                wanted[p].add(block)
        out: dict[int, tuple[float, float, float]] = {}
        for p, blocks in wanted.items():
            passage = found[p * step : p * step + self.window]
            retrieved = self.search(passage, blocks)
            if retrieved:
                have = triples(passage) if len(passage) > 2 else set()
                have |= {(w,) for w in passage} | set(zip(passage, passage[1:], strict=False))
                for i, score in retrieved:
                    q, a = (len(part & have) / len(part) if part else 1.0 for part in self.parts[i])
                    if min(q, a) >= OVERLAP and (score, q, a) > out.get(i, (0.0, 0.0, 0.0)):
                        out[i] = (score, q, a)
        return out


def find(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: each confirmed match of a document and an item."""
    docs = doc_texts(documents, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    spark = docs.sparkSession
    stats = Statistics(t for r in items.select("text").toLocalIterator() if (t := words(r[0])))
    if not stats.n:
        return spark.createDataFrame([], schema)
    frequent = _frequent(docs, stats)

    def one(group: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(BlockMaxIndex(group, stats, frequent))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                rows = [(d, index.ids[i], *found) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for i, found in index.matches(text).items()]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(columns)], names)

        return arrow_map(docs, run, schema)

    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    return reduce(DataFrame.union, map(one, _groups(items)))


def _groups(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in order, in bounded groups of one length class."""
    held: dict[int, list[tuple[int, str]]] = {}
    sizes: Counter[int] = Counter()
    for r in items.orderBy("id", "text").toLocalIterator():
        found = words(r["text"])
        if found:
            k = _length_class(found)
            if len(held.get(k, ())) >= GROUP or sizes[k] + len(r["text"]) > GROUP_BYTES and k in held:
                yield held.pop(k)
                sizes[k] = 0
            held.setdefault(k, []).append((r["id"], r["text"]))
            sizes[k] += len(r["text"])
    yield from held.values()


def _frequent(docs: DataFrame, stats: Statistics) -> Counter[bytes]:
    """How often the items' words are in about SAMPLE distinct texts."""
    total = docs.count()
    # copies of a chosen text count once
    sample = docs.where(hash_share(F.col("text"), min(1.0, SAMPLE / max(1, total))) & (F.octet_length("text") <= SAMPLE_BYTES)).select("text").distinct()
    out: Counter[bytes] = Counter()
    for r in sample.toLocalIterator():
        out.update(w for w in words(r[0]) if w in stats.df)
    return out
