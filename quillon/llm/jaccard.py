"""Near-duplicate texts by the Jaccard similarity of their word shingles, under several global token orders.

Two sets of n and m tokens whose similarity is t or more share, under any one order of all tokens, one of the first
n - ceil(t n) + 1 tokens of the one with one of the other's; and of prefixes that are SHARE-ths of the sets longer, they
share max(n, m) / SHARE tokens. Three orders are used, and a pair must pass all of them before it is compared in full:

1. By the tokens' hashes: a set too few of whose prefix tokens occur in another set's prefix has no partner.
2. Among the sets left, rarest tokens first, by exact counts: prefix tokens that two sets have put both into a bucket.
   A set most of whose tokens are its own has no such token, and no bucket holds a common passage's sets together.
3. By a second hash: the prefixes of a pair from one bucket, under this order and the first, must meet as well.

Counts are exact and take no table that one process holds: each task hands in its distinct tokens in lots, packed, to the
shard of their hash, and the shards answer lots. A token costs a shard one entry a lot, however many sets have it.

Equal sets are one class from the start. Within a bucket each set is first compared with one centre; what that links
needs no further comparison, so that a group of thousands of copies costs about one comparison each. Then sets of one
bucket that are not in one group yet are compared in pairs. No partner is left out. Last, the links of each document are
counted: as links never leave a group, all pairs of a group are compared, block against block of at most about BLOCK
sets, and only counts leave a comparison of blocks.

Words are lower-cased (A-Z) runs of `[^\\x20\\x09-\\x0D]`. With fewer words than a shingle has, all words make one token;
a text without words (or null) is empty and links with nothing. Tokens are 64-bit hashes; sets are told apart by 64-bit
hashes of all their tokens. A row without a doc_id gets its set's size and no component, and is no other's link. Repeated
rows give repeated results; rows of one doc_id with different texts have each its own class; empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, components, discard, doc_texts, materialize, runs, with_keys

WORDS, PERCENT, SHARE = 5, 75, 10
#: Tokens and sets of a lot, shards for each shuffle partition, members that meet a centre at once, sets of a block.
LOT, LOT_SETS, SHARDS, MEET, BLOCK = 1_000_000, 1 << 15, 4, 256, 1024
_CHUNK = 1 << 20
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    np.uint64,
)
#: Seed of the second hash order.
_SECOND = np.uint64(0x1F83D9ABFB41BD6B)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD[0])
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_powers = np.empty(0, np.uint64)


def _power(n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2^64."""
    global _powers
    if n > len(_powers):
        out = np.full(2 * n, _ODD[1], np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n > _CHUNK:  # for one monstrous word; not kept
            return out
        _powers = out
    return _powers


def _word_hashes(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first places of the words; a word ends at white space and at each of the borders."""
    inside = np.flatnonzero(~_SPACE[data])
    if not len(inside):
        return np.empty(0, np.uint64), inside
    new = np.ones(len(inside), bool)
    new[1:] = np.diff(inside) != 1
    ends = np.zeros(len(data) + 1, bool)
    ends[borders] = True
    first = np.flatnonzero(new | ends[inside])
    sizes = np.diff(first, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    total = np.add.reduceat(_BYTE[data[inside]] * _power(int(sizes.max()))[place], first)
    return _mix(total + sizes.astype(np.uint64) * _ODD[2]), inside[first]


def _windows(each: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    total = np.zeros(len(each) - k + 1, np.uint64)
    for i in range(k):
        total += each[i : len(each) - k + 1 + i] * _ODD[i % 8] ^ np.uint64(i + 1)
    return _mix(total + np.uint64(k))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    if not len(texts):
        return
    texts = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    hashes, places, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(raw):  # in chunks that end at white space
        end = min(len(raw), at + _CHUNK)
        while end < len(raw) and not _SPACE[raw[end]]:
            found = np.flatnonzero(_SPACE[raw[end : end + _CHUNK]])
            end = end + int(found[0]) if len(found) else min(len(raw), end + _CHUNK)
        borders = ends[np.searchsorted(ends, at) : np.searchsorted(ends, end, "right")] - at
        h, p = _word_hashes(raw[at:end], borders)
        hashes.append(h)
        places.append(p + at)
        at = end
    each, first = np.concatenate(hashes), np.searchsorted(np.concatenate(places), ends)
    long = _windows(each, words) if len(each) >= words else each[:0]
    for lo, hi in zip(first.tolist(), first[1:].tolist(), strict=False):
        if hi - lo >= words:
            yield _distinct(long[lo : hi - words + 1])
        else:
            yield _windows(each[lo:hi], hi - lo) if hi > lo else each[:0]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return next(sets(pa.array([text], pa.string()), words))


def _key(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _need(n: int, percent: int) -> int:
    """Tokens that a set of n must share with any partner."""
    return -(-percent * n // 100)


def _wide(n: int, percent: int) -> int:
    return n - _need(n, percent) + 1 + n // SHARE


def _least(n: int) -> int:
    """How many tokens of a wide prefix must be shared."""
    return max(1, n // SHARE)


def _by_shard(tokens: np.ndarray, shards: int) -> tuple[list[int], list[np.ndarray]]:
    """The shards that have some of the tokens, and the tokens' places for each."""
    shard = (tokens % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    present, starts = np.unique(shard[order], return_index=True)
    return present.tolist(), np.split(order, starts[1:]) if len(present) else []


def _batch(schema: pa.Schema, **columns: list) -> pa.RecordBatch:
    """A batch with nulls in the columns that aren't given."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


_SIGNED = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_hash", "n", "key", "lot", "at", "local", "shard")] + [("entries", pa.binary())])


class _Lot:
    """A task's documents until their wide prefixes hold LOT tokens, or they are LOT_SETS different ones."""

    def __init__(self, number: int):
        self.number, self.rows, self.at, self.prefixes, self.size = number, [], {}, [], 0

    def add(self, row: tuple[int | None, int], tokens: np.ndarray, percent: int) -> None:
        key = _key(tokens)
        if key not in self.at:
            self.at[key] = len(self.at)
            self.prefixes.append(tokens[: _wide(len(tokens), percent)] if len(tokens) else tokens)
            self.size += len(self.prefixes[-1])
        self.rows.append((*row, len(tokens), key, self.at[key]))

    def hand_in(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The documents with how many of their tokens are another's here, and the distinct tokens by shard with the owner's
        place, or -1 where the lot knows already that the token has several."""
        if not self.rows:
            return
        tokens = np.concatenate(self.prefixes)
        owner = np.repeat(np.arange(len(self.prefixes), dtype=np.int32), [len(p) for p in self.prefixes])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        several = ~new
        several[:-1] |= ~new[1:]
        local = np.bincount(owner[several], minlength=len(self.prefixes))
        doc_id, text_hash, n, key, at = (list(x) for x in zip(*self.rows, strict=True))
        yield _batch(_SIGNED, doc_id=doc_id, text_hash=text_hash, n=n, key=key, lot=[self.number] * len(at), at=at, local=[int(local[i]) for i in at])
        tokens, owner = tokens[new], np.where(several[new], -1, owner[new]).astype(np.int16)
        shard, places = _by_shard(tokens, shards)
        # 48 bits within a shard: a rare false meeting only keeps a set for the next order
        low, high = tokens.astype(np.uint32), (tokens >> np.uint64(32)).astype(np.uint16)
        packed = [low[p].tobytes() + high[p].tobytes() + owner[p].tobytes() for p in places]
        yield _batch(_SIGNED, lot=[self.number] * len(shard), shard=shard, entries=packed)


def _shards(df: DataFrame) -> int:
    return SHARDS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _concat(table: pa.Table, column: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed arrays as one, and the length of each."""
    parts = [np.frombuffer(x, dtype) for x in table.column(column).to_pylist()]
    return np.concatenate(parts), np.array([len(p) for p in parts])


def signatures(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each document (doc_id, text_hash, n, key, lot, at, local), and rows (lot, shard, entries) of the lots."""
    shards = _shards(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = _Lot(TaskContext.get().partitionId() << 24)
        for batch in batches:
            for *row, tokens in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), sets(batch.column("text"), words), strict=True):
                lot.add(row, tokens, percent)
                if lot.size >= LOT or len(lot.at) >= LOT_SETS:
                    yield from lot.hand_in(shards)
                    lot = _Lot(lot.number + 1)
        yield from lot.hand_in(shards)

    return arrow_map(docs, run, "doc_id long, text_hash long, n long, key long, lot long, at long, local long, shard long, entries binary")


def met(signed: DataFrame) -> DataFrame:
    """lot, at, hits: how many prefix tokens of a lot's set occur in other lots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, "shard"):
            entries = table.column("entries").to_pylist()
            sizes = np.array([len(e) // 8 for e in entries])
            each = [(np.frombuffer(e, "<u4", n), np.frombuffer(e, "<u2", n, 4 * n), np.frombuffer(e, "<i2", n, 6 * n)) for e, n in zip(entries, sizes.tolist(), strict=True)]
            low, high, owner = (np.concatenate(x) for x in zip(*each, strict=True))
            tokens, owner = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), owner.astype(np.int64)
            lots, lot = np.unique(table.column("lot").to_numpy(), return_inverse=True)
            order = np.argsort(tokens, kind="stable")
            same = tokens[order[1:]] == tokens[order[:-1]]
            hit = np.zeros(len(tokens), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            hit &= owner >= 0
            lot, owner = np.repeat(lot, sizes)[hit], owner[hit].astype(np.uint16)
            order = np.argsort(lot, kind="stable")
            present, starts = np.unique(lot[order], return_index=True)
            packed = [x.tobytes() for x in np.split(owner[order], starts[1:])] if len(present) else []
            yield pa.RecordBatch.from_arrays([pa.array(lots[present]), pa.array(packed, pa.binary())], ["lot", "owners"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lot,), table in runs(batches, "lot"):
            hits = np.bincount(_concat(table, "owners", "<u2")[0])
            at = np.flatnonzero(hits)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lot)), pa.array(at), pa.array(hits[at])], ["lot", "at", "hits"])

    lots = signed.where("shard is not null").select("shard", "lot", "entries")
    answers = arrow_map(lots.repartition("shard").sortWithinPartitions("shard"), run, "lot long, owners binary")
    return arrow_map(answers.repartition("lot").sortWithinPartitions("lot"), add_up, "lot long, at long, hits long")


def with_partners(signed: DataFrame) -> DataFrame:
    """Keys of the sets that the first order leaves."""
    rows = signed.where("key is not null and n > 0").select("lot", "at", "key", "n", "local").distinct()
    enough = f"local + coalesce(hits, 0) >= greatest(1, n div {SHARE})"
    return rows.join(met(signed), ["lot", "at"], "left").where(enough).select("key").distinct()


_ASKED = pa.schema([(c, pa.int64()) for c in ("doc_id", "key", "n", "lot", "shard")] + [("tokens", pa.binary()), ("counts", pa.binary())])


def whole_sets(docs: DataFrame, owners: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows (doc_id, key, n, lot, tokens) of the owners' sets, and rows (lot, shard, tokens, counts) of their lots."""
    shards = _shards(docs)

    def hand_in(number: int, held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        shard, places = _by_shard(tokens, shards)
        counts = np.minimum(counts, 65_535).astype(np.uint16)
        return _batch(_ASKED, lot=[number] * len(shard), shard=shard, tokens=[tokens[p].tobytes() for p in places], counts=[counts[p].tobytes() for p in places])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            rows = []
            for doc_id, key, tokens in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), sets(batch.column("text"), words), strict=True):
                if _key(tokens) == key:  # else another text under a repeated doc_id
                    rows.append((doc_id, key, len(tokens), number, tokens.tobytes()))
                    held.append(tokens)
                    size += len(tokens)
                if size >= LOT // 4:
                    yield hand_in(number, held)
                    number, held, size = number + 1, [], 0
            if rows:
                columns = zip(*rows, strict=True)
                yield _batch(_ASKED, **dict(zip(("doc_id", "key", "n", "lot", "tokens"), map(list, columns), strict=True)))
        if held:
            yield hand_in(number, held)

    texts = with_keys(docs, owners.select("doc_id").distinct(), "doc_id").join(owners.select("doc_id", "key"), "doc_id")
    return arrow_map(texts.select("doc_id", "key", "text").distinct(), run, "doc_id long, key long, n long, lot long, shard long, tokens binary, counts binary")


def counted(asked: DataFrame) -> DataFrame:
    """lot, tokens, counts: the tokens of a lot that several sets have, and how many of all sets (65,535 at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, "shard"):
            (tokens, sizes), (n, _) = _concat(table, "tokens", "<u8"), _concat(table, "counts", "<u2")
            _, at = np.unique(tokens, return_inverse=True)
            total = np.minimum(np.bincount(at, n), 65_535).astype(np.uint16)[at]
            out: list[tuple] = []
            for lot, hi, size in zip(table.column("lot").to_pylist(), np.cumsum(sizes), sizes, strict=True):
                part = slice(hi - size, hi)
                several = total[part] > 1
                if several.any():
                    out.append((lot, tokens[part][several].tobytes(), total[part][several].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*out, strict=True)), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["lot", "tokens", "counts"])

    lots = asked.where("shard is not null").select("shard", "lot", "tokens", "counts")
    return arrow_map(lots.repartition("shard").sortWithinPartitions("shard"), run, "lot long, tokens binary, counts binary")


def _marks(tokens: np.ndarray, percent: int) -> bytes:
    """The wide prefix under the first order and the prefix under the second, as 32-bit hashes."""
    n = len(tokens)
    second = np.sort(_mix(tokens ^ _SECOND))[: n - _need(n, percent) + 1]
    return np.concatenate([tokens[: _wide(n, percent)], second]).astype(np.uint32).tobytes()


def rare_prefixes(asked: DataFrame, percent: int = PERCENT) -> DataFrame:
    """id (doc_id, key, n), tokens (of the prefix by rarity, those that another set has), alone (how
    many tokens come before these, as no other set has them), marks, central (how many sets a
    token of it is in on the average, negative), whole (all tokens): sets with such tokens."""
    answers = counted(asked).selectExpr("lot", "cast(null as long) doc_id", "cast(null as long) key", "cast(null as long) n", "tokens", "counts")
    own = asked.where("key is not null").selectExpr("lot", "doc_id", "key", "n", "tokens", "cast(null as binary) counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, "lot"):
            rows = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "key", "n", "tokens", "counts")), strict=True))
            known = [(np.frombuffer(t, "<u8"), np.frombuffer(c, "<u2")) for *_, t, c in rows if c is not None]
            if not known:
                continue
            shared, counts = (np.concatenate(x) for x in zip(*known, strict=True))
            order = np.argsort(shared)
            shared, counts = shared[order], counts[order]
            out: list[tuple] = []
            for doc_id, key, n, packed, c in rows:
                if c is not None:
                    continue
                tokens = np.frombuffer(packed, "<u8")
                at = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
                held = np.where(shared[at] == tokens, counts[at], 1)
                alone = int((held == 1).sum())  # these come first in the prefix
                more = n - _need(n, percent) + 1 - alone
                if more > 0:
                    several = np.flatnonzero(held > 1)
                    first = several[np.lexsort((tokens[several], held[several]))[:more]]
                    out.append((doc_id, key, n, tokens[first].view(np.int64), alone, _marks(tokens, percent), -round(float(held.mean()), 3), packed))
            if out:
                doc_id, key, n, tokens, alone, marks, central, whole = (list(x) for x in zip(*out, strict=True))
                ids = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (doc_id, key, n)], ["doc_id", "key", "n"])
                columns = [pa.array(tokens, pa.list_(pa.int64())), pa.array(alone, pa.int64()), pa.array(marks, pa.binary()), pa.array(central, pa.float64()), pa.array(whole, pa.binary())]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["id", "tokens", "alone", "marks", "central", "whole"])

    by_lot = own.union(answers.select(own.columns)).repartition("lot").sortWithinPartitions("lot")
    return arrow_map(by_lot, run, "id struct<doc_id:long,key:long,n:long>, tokens array<long>, alone long, marks binary, central double, whole binary")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _prefixes_meet(a: dict, x: bytes, b: dict, y: bytes, percent: int) -> bool:
    """Whether the prefixes of two sets, under the first order and the second, share what linked sets' must."""
    n, m = a["n"], b["n"]
    s, t = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
    i, j = _wide(n, percent), _wide(m, percent)
    first = len(np.intersect1d(s[:i], t[:j]))
    return first >= max(_least(n), _least(m)) and len(np.intersect1d(s[i:], t[j:])) > 0


def _linked(a: dict, x: bytes, b: dict, y: bytes, percent: int) -> bool:
    n, m = a["n"], b["n"]
    common = _common(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"))
    return 100 * common >= percent * (n + m - common)


def compare(pairs: DataFrame, bodies: DataFrame, test: Callable[[dict, bytes, dict, bytes, int], bool], percent: int) -> DataFrame:
    """Of pairs (a, b) those that pass a test of their bodies (id, body). Each b is sent to its pair; an a once for MEET
    of its pairs, so that neither a set with thousands of partners nor these are gathered in one task."""
    many = pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {MEET}) as int)").alias("of")).where("of > 1")
    dealt = pairs.join(many, "a", "left").selectExpr("a", "b", "cast(pmod(xxhash64(b), coalesce(of, 1)) as int) part")
    members = dealt.join(bodies.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "body")
    centres = dealt.select("a", "part").distinct().join(bodies.withColumnRenamed("id", "a"), "a")
    both = members.union(centres.select("a", "part", F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a, _), table in runs(batches, "a", "part"):
            bs, bodies_of = table.column("b").to_pylist(), table.column("body").to_pylist()
            own = [body for b, body in zip(bs, bodies_of, strict=True) if b is None]
            good = [b is not None and test(a, own[0], b, body, percent) for b, body in zip(bs, bodies_of, strict=True)] if own else [False] * len(bs)
            yield from table.select(["a", "b"]).filter(pa.array(good, pa.bool_())).combine_chunks().to_batches()

    return arrow_map(both.repartition("a", "part").sortWithinPartitions("a", "part"), run, pairs.select("a", "b").schema)


def verify(pairs: DataFrame, prefixes: DataFrame, whole: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of candidate pairs (a, b) those that link: the prefixes of the other orders first, whole sets for what these leave."""
    pairs = materialize(pairs, "pairs")
    near = materialize(compare(pairs, prefixes.select("id", F.col("marks").alias("body")), _prefixes_meet, percent), "near")
    links = materialize(compare(near, whole.select("id", F.col("tokens").alias("body")), _linked, percent), "links")
    discard(pairs, near)
    return links


def _can_link(a: str, i: str, b: str, j: str, percent: int) -> str:
    """Of two sets whose first shared token has places i and j, whether enough can follow."""
    return f"{100 + percent} * least({a}.n - {i}, {b}.n - {j}) >= {percent} * ({a}.n + {b}.n)"


def _count_links(left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]] | None, percent: int) -> dict[int, int]:
    """How many documents each set links with, of two blocks (key, copies, tokens), or of one if right is None."""
    left = sorted(left, key=lambda x: len(x[2]))
    other = left if right is None else sorted(right, key=lambda x: len(x[2]))
    all_sets = left if right is None else left + other
    ids = np.unique(np.concatenate([x[2] for x in all_sets]), return_inverse=True)[1].reshape(-1)
    ends = np.cumsum([0] + [len(x[2]) for x in all_sets])
    first = 0 if right is None else len(left)
    starts, sizes = ends[first:], np.diff(ends[first:])
    copies, links = np.array([x[1] for x in other], np.int64), np.zeros(len(all_sets), np.int64)
    mark = np.zeros(len(ids), np.int32)
    for i, (_, own, tokens) in enumerate(left):
        n = len(tokens)
        lo = max(int(np.searchsorted(sizes, -(-percent * n // 100))), i + 1 if right is None else 0)
        hi = int(np.searchsorted(sizes, 100 * n // percent, "right"))
        if lo < hi:
            mine = ids[ends[i] : ends[i + 1]]
            mark[mine] = 1
            common = np.add.reduceat(mark[ids[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo])
            mark[mine] = 0
            found = 100 * common.astype(np.int64) >= percent * (n + sizes[lo:hi] - common)
            links[i] += copies[lo:hi][found].sum()
            links[first + lo : first + hi][found] += own
    return {x[0]: int(c) for x, c in zip(all_sets, links, strict=True) if c}


def degrees(groups: DataFrame, copies: DataFrame, whole: DataFrame, percent: int = PERCENT) -> DataFrame:
    """key and n_links, how many documents have another set that links with it. groups: id, component; copies: key, how
    many documents have it; whole: id, tokens."""
    large = groups.groupBy("component").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("of")).where("of > 1")
    members = groups.join(large, "component", "left").selectExpr("id", "id.key key", "component", "coalesce(of, 1) of", "cast(pmod(xxhash64(id.key), coalesce(of, 1)) as int) block")
    full = members.join(copies, "key").join(whole, "id").withColumn("with", F.explode(F.expr("sequence(0, of - 1)")))
    met_blocks = full.selectExpr("component", "least(block, `with`) lo", "greatest(block, `with`) hi", "block", "key", "copies", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi), table in runs(batches, "component", "lo", "hi"):
            held: dict[int, list] = {}
            for block, key, n, tokens in zip(*(table.column(c).to_pylist() for c in ("block", "key", "copies", "tokens")), strict=True):
                held.setdefault(block, []).append((key, n, np.frombuffer(tokens, "<u8")))
            if lo == hi or len(held) > 1:
                parts = list(held.values())
                links = _count_links(parts[0], parts[1] if lo < hi else None, percent)
                yield pa.RecordBatch.from_arrays([pa.array(links, pa.int64()), pa.array(links.values(), pa.int64())], ["key", "n_links"])

    dealt = met_blocks.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    return arrow_map(dealt, run, "key long, n_links long").groupBy("key").agg(F.sum("n_links").alias("n_links"))


def linked_sets(asked: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All comparisons that components need: (id, component) of sets with a link, and whole sets (id, tokens)."""
    prefixes = materialize(rare_prefixes(asked, percent), "prefixes")
    whole = prefixes.select("id", F.col("whole").alias("tokens"))
    posted = prefixes.select(F.posexplode("tokens").alias("place", "token"), "id", "central", "alone").withColumn("place", F.col("place") + F.col("alone"))
    # map-side: a bucket's centre and size need no sight of the bucket. The centre is the set whose tokens most sets have:
    # of a text and its altered copies the text itself, with which they all link, though not with each other
    centres = posted.groupBy("token").agg(F.count("*").alias("of"), F.min(F.struct("central", "id", "place")).alias("c")).where("of > 1")
    posted = posted.select("token", "id", "place").join(centres.selectExpr("token", "c.id c", "c.place c_place"), "token")
    posted = materialize(posted, "posted")
    stars = posted.where(f"id <> c and {_can_link('id', 'place', 'c', 'c_place', percent)}").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()
    links = verify(stars, prefixes, whole, percent)
    groups = components(links)

    label = groups.select(F.col("node").alias("id"), F.col("component").alias("label"))
    placed = posted.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    placed = placed.join(label.withColumnsRenamed({"id": "c", "label": "main"}), "c", "left").withColumn("main", F.coalesce("main", "c"))
    placed = materialize(placed, "placed")
    others = placed.where("label <> main").selectExpr("token", "id o_id", "label o_label", "place o_place")
    # sets of the centre's group meet each of the others, and these each other once
    crossed = others.join(placed, "token").where(f"label <> o_label and id <> c and (label = main or o_id < id) and {_can_link('id', 'place', 'o_id', 'o_place', percent)}")
    more = verify(crossed.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct(), prefixes, whole, percent)
    if more.limit(1).count():
        discard(groups)
        groups = components(links.union(more))
    discard(posted, placed, links, more)
    return groups.withColumnRenamed("node", "id"), whole


def near_duplicates(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row, and n_links: with how many other documents it links, copies too;
    also text_hash (xxhash64 of the text), and kept: whether the row is its group's first. That is, of the rows with the
    smallest doc_id and, of these, with the set that carries the component, those with the smallest text_hash; repeated
    rows agree in all of this. Rows that are in no group are kept."""
    if not 200 <= percent * SHARE <= 100 * SHARE:
        raise ValueError("the wide prefixes need a similarity of two SHARE-ths at least")
    docs = doc_texts(documents, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    signed = materialize(signatures(docs, words, percent), "signed")
    rows = materialize(signed.where("key is not null").select("doc_id", "text_hash", "n", "key"), "rows")
    owners = rows.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.countDistinct("doc_id").alias("copies"))
    owners = materialize(owners.select("key", "first.doc_id", F.col("first.text_hash").alias("first_hash"), "copies"), "owners")
    left = materialize(owners.join(with_partners(signed), "key").select("doc_id", "key"), "left")
    discard(signed)
    asked = materialize(whole_sets(docs, left, words), "sets")
    groups, whole = linked_sets(asked, percent)
    discard(asked)
    degree = materialize(degrees(groups, owners.select("key", "copies"), whole, percent), "degrees")
    linked = groups.selectExpr("id.key", "component.doc_id component_id", "component.key = id.key is_first")
    classes = owners.join(linked, "key", "left").join(degree, "key", "left")
    none = F.lit(0).cast("long")
    classes = classes.select(
        "key", F.coalesce("component_id", "doc_id").alias("component_id"), (F.col("copies") + F.coalesce("n_links", none)).alias("n_links"),
        F.when(F.coalesce("is_first", F.lit(True)), F.struct("doc_id", F.col("first_hash").alias("text_hash"))).alias("first"),
    )
    classes = materialize(classes, "classes")
    discard(owners, left, groups, degree, whole)
    known: Column = F.col("doc_id").isNotNull()
    first = ~known | F.coalesce(F.struct("doc_id", "text_hash") == F.col("first"), F.lit(False))
    found = rows.where("n > 0").join(classes, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(known, F.col("component_id")).alias("component_id"),
        (F.coalesce("n_links", none) - known.cast("long")).alias("n_links"), "text_hash", first.alias("kept"),
    )
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), none.alias("n_links"), "text_hash", F.lit(True).alias("kept"))
    return found.union(empty)
