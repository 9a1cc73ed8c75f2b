"""Near-duplicate vectors by product quantisation.

For each vector length a coarse codebook assigns each vector to one of about sqrt(n) inverted lists (MAX_LISTS at most);
what is left of it (the residual) is cut into PARTS subvectors, each coded by its nearest of 256 centroids. A query looks
into its PROBES nearest lists; the distance to an entry is the sum of table look-ups of the query's parts against the
entry's codes, and what may be near by it, with the coding error allowed for, is compared by exact cosine in double
precision: the dot product of the vectors over the product of their norms. A cosine of just the limit links.

The codebooks are learnt from a bounded sample, chosen by hash: of the WIDTHS most frequent lengths at most SAMPLE vectors
and SAMPLE_BYTES in all. Vectors of any other length are one list each and compared exactly. Every vector is indexed and
every one is a query. Only vectors of equal label and length meet. Equal vectors of a label are one entry that stands for
all of them. The entries and queries of a long list are dealt to blocks by its size, and each block of queries meets each
of entries by itself, so that no task holds a whole list.
A block returns for each vector how many others it links with, and of the links only a forest that keeps them connected:
rows grow with the vectors, not with the pairs. A link that only one of its two ends finds counts for both.

A vector that is null, zero or holds a null or a component that isn't finite, and one without label, links with nothing.
Vectors of repeated ids count as separate vectors; a null id gets its class and is never kept. Empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import arrow_map, components, discard, hash_share, materialize, runs

COSINE, MAX_LISTS, PROBES, PARTS, BLOCK = 0.98, 4096, 16, 8, 4000
WIDTHS, SAMPLE, SAMPLE_BYTES = 8, 20_000, 64 << 20


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


class Codebooks:
    def __init__(self, sample: np.ndarray, lists: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.width = sample.shape[1]
        self.coarse = _means(sample, lists, 12, rng)
        rest = sample - self.coarse[self.nearest(sample, 1)[:, 0]]
        self.cuts = np.array_split(np.arange(self.width), min(PARTS, self.width))
        self.fine = [_means(rest[:, c], 256, 8, rng) for c in self.cuts]

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        order = np.argsort(-(x @ self.coarse.T - (self.coarse**2).sum(1) / 2), 1, kind="stable")
        return order[:, : min(k, len(self.coarse))]

    def probes(self, x: np.ndarray, reach: float) -> np.ndarray:
        """The PROBES nearest lists of unit vectors, -1 for those too far to hold an entry within reach: such an entry is
        no farther from its own centre than from the query's."""
        lists = self.nearest(x, PROBES)
        d = np.sqrt(((x[:, None] - self.coarse[lists]) ** 2).sum(2))
        return np.where(d <= d[:, :1] + 2 * reach, lists, -1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far each vector is from what its codes say."""
        rest = x - self.coarse[lists]
        codes = np.stack([(rest[:, c] @ f.T - (f**2).sum(1) / 2).argmax(1) for c, f in zip(self.cuts, self.fine, strict=True)], 1).astype(np.uint8)
        error = np.sqrt(sum(((rest[:, c] - f[codes[:, i]]) ** 2).sum(1) for i, (c, f) in enumerate(zip(self.cuts, self.fine, strict=True))))
        return codes, error

    def about(self, queries: np.ndarray, where: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to what the codes of a list's entries say, by table look-ups."""
        rest = queries - self.coarse[where]
        tables = [((rest[:, c][:, None] - f[None]) ** 2).sum(2) for c, f in zip(self.cuts, self.fine, strict=True)]
        return sum(t[:, codes[:, i]] for i, t in enumerate(tables))


class _Forest:
    """Joins of places, of which it keeps those that connect what wasn't."""

    def __init__(self, n: int):
        self.parent, self.joined = np.arange(n), []

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:  # pairs already under one parent need no look
            apart = self.parent[a] != self.parent[b]
            a, b = a[apart], b[apart]
            for i, j in zip(a[:1000].tolist(), b[:1000].tolist(), strict=True):
                x, y = self._root(i), self._root(j)
                if x != y:
                    self.parent[max(x, y)] = min(x, y)
                    self.joined.append((i, j))
            a, b = a[1000:], b[1000:]
            if not len(a):
                return
            while (up := self.parent[self.parent] != self.parent).any():
                self.parent[up] = self.parent[self.parent[up]]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows by powers of two, so that no square overflows or vanishes; cosines stay what they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def codebooks(kinds: DataFrame) -> dict[int, Codebooks]:
    """Of the WIDTHS most frequent lengths; kinds: key, v, width."""
    common = kinds.groupBy("width").count().orderBy(F.desc("count"), "width").limit(WIDTHS).collect()
    out = {}
    for row in common:
        rows = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * row["width"]))) // len(common) or 1
        chosen = kinds.where((F.col("width") == row["width"]) & hash_share(F.col("key"), min(1.0, rows / row["count"])))
        sample = chosen.select("key", "v").orderBy("key").limit(2 * rows).collect()
        if sample:
            x = _units(_scaled(np.array([r["v"] for r in sample], float)))
            out[row["width"]] = Codebooks(x, max(1, min(MAX_LISTS, round(row["count"] ** 0.5))))
    return out


_DEALT = pa.schema(
    [("label", pa.string()), ("width", pa.int32()), ("list", pa.int32()), ("entry", pa.bool_()), ("key", pa.int64()), ("n", pa.int64())]
    + [(c, pa.binary()) for c in ("v", "code", "lists")]
)
_DEALT_SQL = "label string, width int, list int, entry boolean, key long, n long, v binary, code binary, lists binary"


def near_vectors(table: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    usable = F.expr(f"coalesce(v is not null and label is not null and size(v) > 0 and {finite} and exists(v, x -> x <> 0), false)")
    # adding zero makes -0.0 and 0.0 one
    rows = rows.withColumns({"width": F.size("v"), "v": F.expr("transform(v, x -> x + 0D)"), "ok": usable})
    rows = rows.withColumn("key", F.when(F.col("ok"), F.xxhash64("label", F.col("v").cast("string"), F.reverse("v").cast("string"))))
    single = isinstance(table.schema[vector_col].dataType, T.ArrayType) and table.schema[vector_col].dataType.elementType == T.FloatType()
    packed = "<f4" if single else "<f8"  # floats are sent as they are
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6  # the distance of unit vectors at that cosine
    kinds = materialize(
        rows.where("ok").groupBy("key").agg(F.count("*").alias("n"), F.first("v").alias("v"), F.first("label").alias("label"), F.first("width").alias("width"), F.min("vec_id").alias("least")),
        "kinds",
    )
    sent = table.sparkSession.sparkContext.broadcast(codebooks(kinds))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for width in np.unique(batch.column("width").to_numpy()).tolist():
                part = batch.filter(pa.array(batch.column("width").to_numpy() == width))
                raw = np.array(part.column("v").to_pylist(), float)
                raw = raw if single else _scaled(raw)
                books = sent.value.get(width)
                if books:
                    x = _units(raw)
                    lists = books.probes(x, reach).astype("<i4")
                    codes, error = books.encode(x, lists[:, 0])
                else:
                    lists, codes, error = np.zeros((len(raw), 1), "<i4"), np.zeros((len(raw), 0), np.uint8), np.zeros(len(raw))
                for i, (key, label, n) in enumerate(zip(*(part.column(c).to_pylist() for c in ("key", "label", "n")), strict=True)):
                    v, own = raw[i].astype(packed).tobytes(), lists[i].tobytes()
                    out.append((label, width, int(lists[i, 0]), True, key, n, v, codes[i].tobytes() + np.float64(error[i]).tobytes(), own))
                    out += [(label, width, p, False, key, n, v, None, own[:4]) for p in lists[i].tolist() if p >= 0]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _DEALT, strict=True)], schema=_DEALT)

    dealt = arrow_map(kinds.select("key", "label", "width", "n", "v"), deal, _DEALT_SQL)
    place = ["label", "width", "list"]
    sizes = dealt.groupBy(*place).agg(F.count(F.when(F.col("entry"), 1)).alias("e"), F.count(F.when(~F.col("entry"), 1)).alias("q"))
    long = sizes.where(f"e > {BLOCK} or q > {BLOCK * 8}").selectExpr(*place, f"cast(ceil(e / {BLOCK}) as int) es", f"cast(ceil(q / {BLOCK * 8}) as int) qs")
    long = materialize(long, "long")
    # an entry goes to its block's row of blocks of queries, a query to its column
    blocks = dealt.join(long, place, "left").withColumns({"es": F.expr("coalesce(greatest(es, 1), 1)"), "qs": F.expr("coalesce(greatest(qs, 1), 1)")})
    blocks = blocks.withColumn("own", F.expr("cast(pmod(xxhash64(key), if(entry, es, qs)) as int)"))
    blocks = blocks.withColumn("other", F.explode(F.expr("sequence(0, if(entry, qs, es) - 1)"))).withColumn("block", F.expr("if(entry, own * qs + other, other * qs + own)"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, width, where, _), table in runs(batches, *place, "block"):
            entry = table.column("entry").to_numpy()
            if entry.all() or not entry.any():
                continue
            books = sent.value.get(width)
            keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
            x = np.frombuffer(b"".join(table.column("v").to_pylist()), packed).reshape(len(keys), width).astype(float)
            norm, lists = np.sqrt((x**2).sum(1)), [np.frombuffer(b, "<i4") for b in table.column("lists").to_pylist()]
            es, qs = np.flatnonzero(entry), np.flatnonzero(~entry)
            code = [table.column("code")[i].as_py() for i in es.tolist()]
            codes = np.frombuffer(b"".join(c[:-8] for c in code), np.uint8).reshape(len(es), -1)
            error = np.frombuffer(b"".join(c[-8:] for c in code), np.float64)
            looks, own = np.stack([lists[i] for i in es.tolist()]), np.array([lists[i][0] for i in qs.tolist()])
            links, forest = np.zeros(len(keys), np.int64), _Forest(len(keys))
            for at in range(0, len(qs), 64):
                some = qs[at : at + 64]
                if books:
                    # the triangle inequality: an entry is no nearer than its codes are, less the coding error
                    q, e = np.nonzero(np.sqrt(books.about(x[some] / norm[some, None], where, codes)) - error[None] <= reach)
                else:
                    q, e = np.divmod(np.arange(len(some) * len(es)), len(es))
                for lo in range(0, len(q), 1 << 16):
                    a, b = q[lo : lo + (1 << 16)], e[lo : lo + (1 << 16)]
                    a, b, a_own = some[a], es[b], own[at + a]
                    look = looks[np.searchsorted(es, b)]
                    real = (np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= cosine) & (keys[a] != keys[b])
                    a, b, one_way = a[real], b[real], ~(look[real] == a_own[real, None]).any(1)
                    np.add.at(links, a, n[b])
                    np.add.at(links, b[one_way], n[a[one_way]])  # b doesn't find a by itself
                    forest.join(a, b)
            some = np.flatnonzero(links)
            a, b = (np.array(c, np.int64) for c in zip(*forest.joined, strict=True)) if forest.joined else (some[:0], some[:0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([keys[some], keys[a]])), pa.array(np.concatenate([keys[some], keys[b]])), pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)]))],
                ["a", "b", "links"],
            )

    dealt_out = blocks.select(*place, "block", "entry", "key", "n", "v", "code", "lists").repartition(*place, "block").sortWithinPartitions(*place, "block")
    met = materialize(arrow_map(dealt_out, meet, "a long, b long, links long"), "met")
    groups = components(met.where("a <> b"))
    degree = met.where("a = b").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    placed = kinds.select("key", "n", "least").join(groups.withColumnRenamed("node", "key"), "key", "left").join(degree, "key", "left").withColumn("component", F.coalesce("component", "key"))
    placed = materialize(placed, "placed")
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    links = (F.col("n") - 1 + F.coalesce("links", F.lit(0).cast("long"))).alias("n_links")
    done = materialize(placed.join(smallest, "component").select("key", links, "component_id"), "done")
    discard(kinds, long, met, groups, placed)
    sent.destroy()
    known = rows.where("ok").join(done, "key").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    lone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return known.union(lone)
