"""Byte-level BPE by longest matches with backtracking.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton finds the longest vocabulary entry at each
place. A piece is then tokenised from the left: a token is taken if it may stand after the one before, else the next
shorter prefix is tried, and a place from which no token fits is marked and left. Two tokens may stand together if
encoding their bytes yields just them; that is decided by walking their splits, and remembered. The result is what the
merges by rank would give, in time linear in the piece.

Nulls count as empty texts; an empty text has no ids. Texts of any length are encoded whole. Repeated rows give repeated
results, empty tables empty ones, and other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import arrow_map, doc_texts

#: Entries after which a worker forgets what it hasn't used since as many were new before: of pieces of at most PIECE_CHARS
#: characters, and of pairs of tokens. About 30 MB and 20 MB at most.
PIECES_KEPT, PIECE_CHARS, PAIRS_KEPT = 75_000, 32, 100_000
NO_TOKEN = -1


class Bpe:
    """A vocabulary of ranks, in which every single byte must occur."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length = [len(t) for t in self.bytes_of]
        self.prefix = [NO_TOKEN] * size
        for token, rank in ranks.items():
            for k in range(len(token) - 1, 0, -1):
                if (shorter := ranks.get(token[:k])) is not None:
                    self.prefix[rank] = shorter
                    break
        self.merged: dict[int, int] = {}
        self.left, self.right = list(range(size)), list(range(size))
        self._pairs: dict[int, bool] = {}
        self._old_pairs: dict[int, bool] = {}
        self._learn_splits()
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pattern = regex.compile(pattern)
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._old_pieces: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, raw: bytes, pattern: str) -> Bpe:
        return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}, pattern)

    def _learn_splits(self) -> None:
        """For each token in rank order, the two tokens from whose merge it comes."""
        for rank, token in enumerate(self.bytes_of):
            first = self.prefix[rank] if token else NO_TOKEN
            while first != NO_TOKEN:
                second = self.ranks.get(token[self.length[first] :])
                if second is not None and first < rank and second < rank and self._stand_together(first, second):
                    self.left[rank], self.right[rank] = first, second
                    self.merged[first << 32 | second] = rank
                    break
                first = self.prefix[first]

    def _stand_together(self, first: int, second: int) -> bool:
        """Whether no merge across the border between two tokens comes before those that make them."""
        limit = 1 << 62
        while True:
            if self.merged.get(first << 32 | second, limit) < limit:
                return False
            if first > second:
                limit, first = first, self.right[first]
                if first == limit:
                    limit, second, whole = second + 1, self.left[second], second
                    if second == whole:
                        return True
            else:
                limit, whole, second = second + 1, second, self.left[second]
                if second == whole:
                    limit, whole, first = first, first, self.right[first]
                    if first == whole:
                        return True

    def compatible(self, first: int, second: int) -> bool:
        key = first << 32 | second
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) >= PAIRS_KEPT:
                self._old_pairs, self._pairs = self._pairs, {}
            if (known := self._old_pairs.get(key)) is None:
                known = self._stand_together(first, second)
            self._pairs[key] = known
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if not piece:
            return ()
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        length, prefix, n = self.length, self.prefix, len(piece)
        longest = [NO_TOKEN] * n
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length[rank] + 1] = rank  # ends only grow, so the last is the longest
        usable = bytearray(b"\1") * (n + 1)
        tokens: list[int] = []
        place, token = 0, longest[0]
        while place < n:
            last = tokens[-1] if tokens else NO_TOKEN
            while token != NO_TOKEN:
                end = place + length[token]
                if usable[end] and (last == NO_TOKEN or self.compatible(last, token)):
                    break
                token = prefix[token]
            if token != NO_TOKEN:
                tokens.append(token)
                place = end
                token = longest[place] if place < n else NO_TOKEN
            else:
                usable[place] = 0
                token = tokens.pop()
                place -= length[token]
        return tuple(tokens)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        pieces, old, extend = self._pieces, self._old_pieces, out.extend
        for piece in self.pattern.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = old.get(piece)
                if ids is None:
                    ids = self.encode_piece(piece.encode())
                if len(piece) <= PIECE_CHARS:
                    if len(pieces) >= PIECES_KEPT:
                        self._old_pieces = old = pieces
                        self._pieces = pieces = {}
                    pieces[piece] = ids
            extend(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_models: dict[tuple[int, str], Bpe] = {}


def _model(raw: bytes, pattern: str) -> Bpe:
    """One model for each worker and vocabulary."""
    key = (hash(raw), pattern)
    if key not in _models:
        _models[key] = Bpe.from_file(raw, pattern)
    return _models[key]


def encode_decode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit), decoded (binary), from one pass over the texts.

    vocabulary: path of a file of base64 tokens and ranks, read on the driver and sent once to each executor.
    """
    spark: SparkSession = df.sparkSession
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value, pattern)
        for batch in batches:
            n, packed, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                ids = model.encode(text or "")
                n.append(len(ids))
                packed.append(np.array(ids, "<u4").tobytes())
                decoded.append(model.decode(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return arrow_map(doc_texts(df, id_col, text_col), run, "doc_id long, n_tokens long, ids binary, decoded binary")


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text: the texts of packed ids; bytes that are not UTF-8 become U+FFFD, null ids an empty text."""
    with open(vocabulary, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value, "(?s).+")
        for batch in batches:
            texts = [model.decode(np.frombuffer(x or b"", "<u4").tolist()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as binary) ids"), run, "doc_id long, text string")
