"""Repeated passages by sliding spans of sentences.

Sentences end at . ! ? ; : or a line break. A run of sentences is long enough with MIN_SENTENCES sentences and MIN_WORDS
words, or with LONG_WORDS words in whatever sentences. Spans are the shortest such runs from each sentence on and the
shortest ones up to each sentence, and the whole text if it is shorter; their words are hashed, in lower case, with single
spaces. Whatever run repeats, each of its sentences is in a span inside the run, the last ones too. All spans of all
documents meet by hash; of equal ones the first, by doc_id and place, stays, and every sentence that another one covers is
removed. Spans that overlap an earlier copy of themselves in one document count as repeated too. The part of a passage
that lies in a sentence which begins or ends outside it stays.

A hash is counted, in part where its spans are, before it is joined: only hashes that occur twice are. A hash with more
than a HOT-th of all spans is sent to the spans, of which there are HOT at most, so that a line which a third of all
documents hold is never gathered; the others are joined by a shuffle.

Null and empty texts have no sentence and stay as they are. Rows with equal doc_id and text count as one document; a row
without a doc_id comes after all others. Other columns are not read; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, doc_texts, materialize, maybe_among

MIN_SENTENCES, MIN_WORDS, LONG_WORDS, HOT = 2, 16, 32, 1000
_SENTENCE = re.compile(r"[^.!?;:\n]*[.!?;:\n]+|[^.!?;:\n]+\Z")


def sentences(text: str | None) -> list[str]:
    """A text's sentences with what ends them; joined they are the text."""
    return _SENTENCE.findall(text or "")


def spans(text: str | None, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(hash, first sentence, end) of each span; sentences without a word belong to no count."""
    found = [(i, s.lower().encode().split()) for i, s in enumerate(sentences(text))]
    found = [(i, w) for i, w in found if w]
    out, end, held = [], 0, 0

    def add(k: int, end: int) -> None:
        joined = b" ".join(x for _, ws in found[k:end] for x in ws)
        out.append((xxhash.xxh3_64_intdigest(joined) - (1 << 63), found[k][0], found[end - 1][0] + 1))

    def short(k: int) -> bool:
        return (held < min_words or end - k < min_sentences) and held < max(min_words, LONG_WORDS)

    for k, (_, w) in enumerate(found):
        before = end
        while end < len(found) and short(k):
            held += len(found[end][1])
            end += 1
        if k:  # the shortest runs up to the ends that no span from a sentence on reaches
            for e in range(before + 1, len(found) + 1 if short(k) else end):
                add(k - 1, e)
        if short(k):
            if not k and found:
                add(0, len(found))
            break
        add(k, end)
        held -= len(w)
    return out


def _doc_key() -> Column:
    return F.xxhash64("doc_id", "text")


def repeated(documents: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_key and the places (first, end) of the sentences that a later copy of a span covers."""
    docs = doc_texts(documents).withColumn("doc_key", _doc_key())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[int | None]] = [[], [], [], [], []]
            for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("doc_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for h, a, b in spans(text, min_sentences, min_words):
                    for c, x in zip(columns, (h, (1 << 63) - 1 if doc_id is None else doc_id, key, a, b), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["h", "doc_id", "doc_key", "a", "b"])

    found = materialize(arrow_map(docs, run, "h long, doc_id long, doc_key long, a int, b int"), "spans")
    firsts = found.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "doc_key", "a")).alias("first")).where("n > 1")
    firsts = materialize(firsts.select("h", "n", "first"), "firsts")
    # at most HOT hashes can have more than a HOT-th of all spans; they are sent to the spans, the others are shuffled
    often = max(HOT, found.count() // HOT)
    hot, cold = F.broadcast(firsts.where(F.col("n") > often).drop("n")), firsts.where(F.col("n") <= often).drop("n")
    rest = maybe_among(found.join(hot.select("h"), "h", "left_anti"), cold.select("h"), "h").where("maybe").drop("maybe")
    later = found.join(hot, "h").unionByName(rest.join(cold, "h")).where("struct(doc_id, doc_key, a) <> first")
    return later.select("doc_key", "a", "b")


def remove_repeated(documents: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed (array of first:end code points), text without the repeated sentences."""
    places = repeated(documents, min_sentences, min_words).groupBy("doc_key").agg(F.collect_set(F.struct("a", "b")).alias("places"))
    places = materialize(places, "places")
    docs = doc_texts(documents).withColumn("doc_key", _doc_key())
    marked = maybe_among(docs, places.select("doc_key"), "doc_key")
    struck = marked.where("maybe").join(places, "doc_key", "left")
    struck = struck.select("doc_id", "text", F.transform("places", lambda x: x["a"]).alias("a"), F.transform("places", lambda x: x["b"]).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, ranges, texts = [], [], [], []
            for text, first, end in zip(*(batch.column(c).to_pylist() for c in ("text", "a", "b")), strict=True):
                each = sentences(text)
                out = bytearray(len(each))
                for a, b in zip(first or (), end or (), strict=True):
                    out[a:b] = b"\1" * (b - a)
                at, found = 0, []
                for s, x in zip(each, out, strict=True):
                    if x:
                        if found and found[-1][1] == at:
                            found[-1][1] = at + len(s)
                        else:
                            found.append([at, at + len(s)])
                    at += len(s)
                n.append(len(each))
                gone.append(sum(out))
                ranges.append([f"{a}:{b}" for a, b in found])
                texts.append(None if text is None else "".join(s for s, x in zip(each, out, strict=True) if not x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(ranges, pa.list_(pa.string())), pa.array(texts, pa.string())], ["doc_id", "n_sentences", "n_removed", "removed", "text"])

    schema = "doc_id long, n_sentences long, n_removed long, removed array<string>, text string"
    rest = marked.where("not maybe")
    rest = rest.select("doc_id", "text", F.array().cast("array<int>").alias("a"), F.array().cast("array<int>").alias("b"))
    return arrow_map(struck.union(rest), run, schema)
