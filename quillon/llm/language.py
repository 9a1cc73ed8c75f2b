"""Language identification by prediction by partial matching.

For each language the training bytes give a tree of contexts of 0 to 3 bytes. The probability of a byte follows the
longest context that was seen with it, after an escape for each longer one (method C: a context seen n times with q
different bytes gives count/(n+q), and q/(n+q) to the escape); below all contexts each of 256 bytes is as likely. With
frozen statistics a byte's code length depends on its context alone: for each order a table has the lengths of all bytes
seen after all contexts in any language, and another the escapes of these contexts. A byte not in the table pays the
escape and is looked up in the next shorter order. The shortest code wins; the score is the languages' posterior.

Training reads a bounded sample: of distinct texts, chosen by hash, about max_docs whole ones a language and max_bytes
(together at most MAX_TOTAL), none longer than a quarter of max_bytes; that bounds the tables that are sent. Everything in
the sample counts; no context and no byte value is left out.

A text that is null or has no letter is `und` with score 0. Without any training language every text is `und`. Texts of
any length count whole; ties go to the language first in order; other columns are not read; empty tables give empty
results and repeated rows repeated ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import arrow_map, doc_texts, hash_share

MAX_DOCS, MAX_BYTES, MAX_TOTAL = 400, 4_000_000, 32_000_000
ORDER, UNKNOWN = 3, "und"
_START = b"\n" * ORDER
_LETTER = regex.compile(r"\p{L}")
_SLICE, _SLOTS = 1 << 18, 21


def sample_by_language(docs: DataFrame, train: Column, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> dict[str, list[bytes]]:
    """About max_docs distinct whole texts a language and about max_bytes, chosen by a hash of the text."""
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()
    if not sizes:
        return {}
    max_bytes = min(max_bytes, MAX_TOTAL // len(sizes))
    chosen = F.lit(False)
    for row in sizes:
        share = min(1.0, max_docs / row["n"], max_bytes / max(1, row["b"]))
        chosen = chosen | ((F.col("lang") == row["lang"]) & hash_share(F.col("text"), share))
    texts: dict[str, list[bytes]] = {row["lang"]: [] for row in sizes}
    # copies of a chosen text are one
    for row in known.where(chosen & (F.octet_length("text") <= max(4096, max_bytes // 4))).select("lang", "text").distinct().toLocalIterator():
        texts[row["lang"]].append(row["text"].encode())
    return texts


class _Table:
    """Rows of a matrix by code: most are found in a slot of the code's hash, the others by search."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray):
        self.codes, self.rows = codes, rows
        self.bits = min(_SLOTS, max(4, 3 + int(len(codes)).bit_length()))
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.slot[self._hash(codes)] = np.arange(len(codes), dtype=np.int32)

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        return codes.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the codes, and whether they are there at all."""
        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = self.slot[self._hash(codes)]
        found = self.codes[at] == codes
        rest = np.flatnonzero(~found)
        if len(rest):
            place = np.minimum(np.searchsorted(self.codes, codes[rest]), len(self.codes) - 1).astype(np.int32)
            at[rest], found[rest] = place, self.codes[place] == codes[rest]
        return at, found


class Ppm:
    """Tables of code lengths for all languages. A code is the last bytes as a number, the one predicted lowest."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        if not self.languages:
            return
        joined = [np.frombuffer(b"".join(_START + t for t in sorted(texts[x])) or _START, np.uint8).astype(np.int64) for x in self.languages]
        self.seen: list[_Table] = []
        self.escapes: list[_Table] = []
        for k in range(ORDER + 1):
            counted = [np.unique(self._codes(data, k), return_counts=True) for data in joined]
            codes = np.unique(np.concatenate([c for c, _ in counted]))
            contexts = np.unique(codes >> 8)
            lengths = self._lengths(codes & ((1 << 8 * k) - 1), k - 1)
            escapes = np.zeros((len(contexts), len(self.languages)))
            for i, (own, n) in enumerate(counted):
                if len(own):
                    at = np.searchsorted(contexts, own >> 8)
                    total, different = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
                    some = total > 0
                    escapes[some, i] = -np.log2(different[some] / (total + different)[some])
                    lengths[:, i] += escapes[np.searchsorted(contexts, codes >> 8), i]
                    lengths[np.searchsorted(codes, own), i] = -np.log2(n / (total + different)[at])
            self.escapes.append(_Table(contexts.astype(np.uint32), escapes.astype(np.float32)))
            self.seen.append(_Table(codes.astype(np.uint32), lengths.astype(np.float32)))

    @staticmethod
    def _codes(data: np.ndarray, k: int) -> np.ndarray:
        """Of each byte after the start, with k bytes before it."""
        code = np.zeros(max(0, len(data) - ORDER), np.int64)
        for j in range(k + 1):
            code |= data[ORDER - j : len(data) - j] << 8 * j
        return code

    def _lengths(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Bits of each code's lowest byte in each language."""
        if k < 0:
            return np.full((len(codes), len(self.languages)), 8.0, np.float32)
        at, found = self.seen[k].find(codes)
        out = self.seen[k].rows[at] if len(self.seen[k].rows) else np.zeros((len(codes), len(self.languages)), np.float32)
        rest = np.flatnonzero(~found)
        if len(rest):
            out[rest] = self._lengths(codes[rest] & ((1 << 8 * k) - 1), k - 1)
            at, found = self.escapes[k].find(codes[rest] >> 8)
            out[rest[found]] += self.escapes[k].rows[at[found]]
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        if not texts:
            return out
        data = np.frombuffer(b"".join(_START + t for t in texts), np.uint8)
        ends = np.cumsum([len(t) + ORDER for t in texts])
        owner_starts = ends - np.array([len(t) for t in texts])
        for a in range(ORDER, len(data), _SLICE):
            b = min(len(data), a + _SLICE)
            code = np.zeros(b - a, np.uint32)
            for j in range(ORDER + 1):
                code |= data[a - j : b - j].astype(np.uint32) << np.uint32(8 * j)
            bits = self._lengths(code, ORDER)
            first, last = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b - 1, "right")
            for i in range(first, last + 1):
                lo, hi = max(a, owner_starts[i]), min(b, ends[i])
                if lo < hi:
                    out[i] += bits[lo - a : hi - a].sum(0, dtype=np.float64)
        return out


def identify(docs: DataFrame, model: Ppm | None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id (or the columns `keep`, with the text among them), lang_pred, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = sent.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            real = [i for i, t in enumerate(texts) if t and ppm and ppm.languages and _LETTER.search(t)]
            if real:
                bits = ppm.lengths([texts[i].encode() for i in real])
                best = bits.argmin(1)
                sure = 1 / np.exp2(np.clip(bits.min(1)[:, None] - bits, -1000, 0)).sum(1)
                for i, k, s in zip(real, best, sure, strict=True):
                    lang[i], score[i] = ppm.languages[k], float(s)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*out, "lang_pred", "score"])

    rows, text, out = (docs.select(*keep), text_col, list(keep)) if keep else (doc_texts(docs, id_col, text_col), "text", ["doc_id"])
    return arrow_map(rows, run, T.StructType([*(rows.schema[c] for c in out), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
