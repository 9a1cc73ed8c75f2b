"""Periodic runs of words: every lag of a document is compared at once, and true stretches are measured.

A document is an array of word numbers. For each lag q up to n / MIN_EXPONENT the array is compared with itself q places
further on; a stretch of k equal places is a run of k + q words with period q. Lags are compared in blocks, as a matrix of
at most CELLS cells, so that short documents cost a few array operations and long ones bounded memory besides their words.
A stretch that a smaller lag has found with the same borders has that smaller period (it is at least three periods long,
so the smaller divides the larger), and is left out; whatever else is long enough is a run with its smallest period.

Documents of more than LONG_BYTES are dealt out: each is turned into word numbers once, ranges of its lags become rows of
their own, spread over all tasks, and what the ranges find meets again under the document. Shorter ones stay in the task
that reads them, without a shuffle.

Null and empty texts have no words and no runs; equal rows give equal results, each its own; texts of any length are taken
whole; a null doc_id counts as empty text in its checksum; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, doc_texts, materialize

MIN_EXPONENT, MIN_LENGTH = 3, 24
CELLS, LONG_BYTES, RANGE_LAGS = 1 << 20, 1 << 16, 1024

Run = tuple[int, int, int]
_DIGEST = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int32)


def stretches(ids: np.ndarray, lags: range, min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> Iterator[Run]:
    """(first word, word after the last, lag) of what repeats at these lags and is long enough, by lag."""
    n = len(ids)
    lags = range(max(1, lags.start), min(lags.stop, n // exponent + 1)) if n >= min_length else range(0)
    if not lags:
        return
    # at each lag this many equal places in a row make a run
    padded = np.concatenate([ids, np.full(lags.stop, -1, np.int32)])
    at_once = max(1, CELLS // n)
    for lo in range(lags.start, lags.stop, at_once):
        hi = min(lags.stop, lo + at_once)
        shifted = np.lib.stride_tricks.sliding_window_view(padded[lo : hi - 1 + n], n)
        same = shifted == ids
        q = np.arange(lo, hi)
        need = np.maximum(min_length - q, (exponent - 1) * q)
        for k in np.flatnonzero(same.sum(1, dtype=np.int32) >= need):
            row = np.zeros(n + 2, np.int8)
            row[1:-1] = same[k]
            turns = np.flatnonzero(np.diff(row))
            starts, ends = turns[::2], turns[1::2]
            for i in np.flatnonzero(ends - starts >= need[k]):
                yield int(starts[i]), int(ends[i]) + lo + int(k), lo + int(k)


def primitive(found: Iterator[Run]) -> list[Run]:
    """Of stretches with the same borders the one with the smallest lag; (start, length, period) by start, then period."""
    best: dict[tuple[int, int], int] = {}
    for start, end, q in found:
        if q < best.get((start, end), q + 1):
            best[start, end] = q
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def runs(words: list[bytes]) -> list[Run]:
    """(start, length, period) of all runs of a list of words."""
    ids = numbered(words)
    return primitive(stretches(ids, range(1, len(ids))))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of the documents, by checksum, repeat a stretch from some word on until they end."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """What is left when of each run only the first period stays."""
    keep = np.ones(len(words), bool)
    for start, length, q in found:
        keep[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)] if found else words


def _digest(doc_id: int | None, words: list[bytes], found: list[Run]) -> tuple:
    best: tuple = (None,) * 4
    if found:
        start, length, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (start, length, q, 1000 * length // q)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(words), len(found), *best, sha("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()), sha(b" ".join(collapsed(words, found))))


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _DIGEST.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name.endswith("256") else pa.int64()) for name, c in zip(names, columns, strict=True)], names)


def _words(batch: pa.RecordBatch, plant: bool) -> Iterator[tuple[int | None, list[bytes]]]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        words = (text.as_py() or "").encode().split()
        yield doc_id, planted(words, doc_id) if plant else words


def periodic_runs(documents: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text", long_bytes: int = LONG_BYTES, range_lags: int = RANGE_LAGS) -> DataFrame:
    """doc_id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every row. With
    `plant`, a tenth of the documents repeat a stretch (a stated fault, to be found)."""
    docs = doc_texts(documents, id_col, text_col)
    long = F.octet_length("text") > long_bytes

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table([_digest(doc_id, words, runs(words)) for doc_id, words in _words(batch, plant)])

    short = arrow_map(docs.where(~F.coalesce(long, F.lit(False))), whole, _DIGEST)
    return short.unionByName(_long_runs(docs.where(long).withColumn("key", F.xxhash64("doc_id", "text")), plant, range_lags))


def _long_runs(docs: DataFrame, plant: bool, range_lags: int) -> DataFrame:
    """The same for long documents (key, doc_id, text): equal rows share a key and what is found under it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, (_, words) in zip(batch.column("key").to_pylist(), _words(batch, plant), strict=True):
                ids = numbered(words).tobytes()
                for lo in range(1, len(words) // MIN_EXPONENT + 1, range_lags):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([lo], pa.int32()), pa.array([ids], pa.binary())], ["key", "lo", "ids"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, lo, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "ids")), strict=True):
                # all that a lag finds goes on, as the smaller lag with the same borders may be in another range
                got = list(stretches(np.frombuffer(ids, np.int32), range(lo, lo + range_lags)))
                columns = list(zip(*got, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(got), pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], ["key", "start", "end", "period"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found, (doc_id, words) in zip(batch.column("found").to_pylist(), _words(batch, plant), strict=True):
                rows.append(_digest(doc_id, words, sorted(((r["start"], r["end"] - r["start"], r["period"]) for r in found or []), key=lambda r: (r[0], r[2]))))
            yield _table(rows)

    docs = docs.select("key", "doc_id", "text")
    dealt = arrow_map(docs.dropDuplicates(["key"]), deal, "key long, lo int, ids binary", rows=16)
    found = arrow_map(dealt.repartition("key", "lo"), scan, "key long, start long, end long, period long", rows=16)
    least = found.groupBy("key", "start", "end").agg(F.min("period").alias("period"))
    found = materialize(least.groupBy("key").agg(F.collect_list(F.struct("start", "end", "period")).alias("found")), "runs")
    return arrow_map(docs.join(found, "key", "left").select("doc_id", "text", "found"), finish, _DIGEST, rows=16)
