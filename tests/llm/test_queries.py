"""Each corpus query as it is registered, over whole small tables: against SQL, or against its contract in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers as P
import pytest
import tiktoken

from quillon.llm import bpe
from quillon.llm.queries import ORACLES, QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "pages", "labels", "benchmark")


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, rel = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    assert sorted(map(str, df.select(columns).collect())) == sorted(str(r) for r in spark.createDataFrame(rel.select(*columns).fetchall(), df.select(columns).schema).collect())


def test_bpe(spark):
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Bpe.from_file(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN).ranks, special_tokens={})
    want = {}
    for r in read(spark, "documents"):
        ids = ref.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:4] for r in QUERIES["op1_bpe"](spark, SF).collect()} == want


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(d := re.sub("[ -]", "", s)) <= 19 and luhn(d)), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    got = {r["doc_id"]: r for r in QUERIES["op3_pii"](spark, SF).collect()}
    docs = read(spark, "documents")
    assert len(got) == len(docs)
    for r in docs:
        found = [(m.start(), list(kinds).index(k), f"{k}:{m.start()}:{m.end()}") for k, (p, ok) in kinds.items() for m in re.finditer(p, r["text"] or "") if ok(m[0])]
        own = got[r["doc_id"]]
        assert [own[f"n_{k}"] for k in kinds] == [sum(f[1] == i for f in found) for i in range(4)]
        base = [f[2] for f in sorted(found)]
        assert own["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(own["spans"].split(",")) | {""}


def test_quality(spark):
    labels = {r["doc_id"]: r["quality"] for r in read(spark, "labels", LARGER)}
    got = QUERIES["op4_quality"](spark, LARGER).collect()
    assert len(got) == 1000
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    held = [r["predicted"] == labels[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(held) >= 0.95 * len(held) > 0


def test_language(spark):
    docs = {r["doc_id"]: r for r in read(spark, "documents", LARGER)}
    got = QUERIES["op7_language_id"](spark, LARGER).collect()
    assert len(got) == len(docs)
    for r in got:
        text = docs[r["doc_id"]]["text"]
        assert r["held_out"] == (remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text or ""))
    held = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(held) >= 0.97 * len(held) > 0


def test_pages(spark):
    pages = {r["page_id"]: r for r in read(spark, "pages")}
    got = QUERIES["op6_html_extraction"](spark, SF).collect()
    assert {r["page_id"] for r in got} == set(pages) and len(got) == len(pages)
    for r in got:
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
        assert all(b == " ".join(b.split()) and b for b in r["text"].split("\n")) or not r["text"]


def test_spans(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in read(spark, "documents")}
    got = QUERIES["op8_repeated_spans"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r["n_removed"] <= r["n_sentences"]
        if not r["n_removed"]:
            assert r["text_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest() and r["n_chars"] == len(docs[r["doc_id"]])


def test_lm_scoring(spark):
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    docs = {r["doc_id"]: [*words(r["text"]), None] for r in read(spark, "documents")}
    c = Counter(w for i, d in docs.items() if remainder(i, 7) != 2 for w in d)
    n, v = sum(c.values()), len(c)
    for r in QUERIES["op10_lm_scoring"](spark, SF).collect():
        d = docs[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(r["doc_id"], 7) == 2, len(d), sum(w in c for w in d), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in d)) < 1e-6 * max(1, len(d))
        assert math.isfinite(r["score"]) and r["score"] <= 0


def test_lm_scores_of_held_out_texts_are_near_the_base(spark):
    held = [r for r in QUERIES["op10_lm_scoring"](spark, LARGER).collect() if r["held_out"]]
    per_token = lambda c: sum(r[c] for r in held) / sum(r["n_tokens"] for r in held)
    assert all(r["score"] is not None and math.isfinite(r["score"]) for r in held)
    assert per_token("score") > 1.15 * per_token("base_score")
