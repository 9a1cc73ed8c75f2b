"""Spelling variants: words one edit apart, by an even-partition pigeonhole join, and the frequent form of each.

Words are maximal runs of Latin letters, A-Z in lower case; a word counts that is long and frequent enough. Each word of
length l is cut into two segments (l div 2 letters and the rest), and both are indexed under l. A word probes the index of
its own length with its own segments, and the index of the length below with the two substrings that a deletion on the
other side leaves: its first l div 2 letters, and its last ones, one place further to the right. One edit spoils one of
two segments at most, so that any two words one edit apart meet under a key. Candidates are verified by their distance,
and pairs that meet twice count once.

A segment that many words share would make a large bucket. Where a bucket holds more than `bucket` words, its words' other
segment is cut in two by the same rule and both halves join the key, one at a time; this goes on until the bucket is small
or but one letter is unknown, so that no pair is lost, and what a word is compared with stays bounded by the alphabet.

Keys are 64-bit hashes; as whole words are verified, two keys that fall together cost time and change nothing. All of it is
joins and groups of Spark: words and keys are shuffled, texts are not. Counts are of all texts, in whole.

Null and empty texts, and an empty table, give no word. Repeated rows count as often as they are there; a null doc_id is
written as nothing before the colon. Equal counts are broken by code-point order; other columns, whatever their names, are
not read; a text's length doesn't matter, as its words are counted where it is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, doc_texts, materialize

WORD, MIN_LENGTH, MIN_COUNT, RATIO = r"[A-Za-zÀ-ÿ]+", 6, 5, 5
#: A bucket with more words is split further.
BUCKET = 48


def typed_words(documents: DataFrame, slips: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, one row for each occurrence. With `slips`, a run loses a letter where that number divides the checksum of
    `<doc_id>:<run>`: the letter at checksum modulo length."""
    found = F.expr(f"translate(text, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')")
    runs = doc_texts(documents, id_col, text_col).select("doc_id", F.explode(F.regexp_extract_all(found, F.lit(WORD), F.lit(0))).alias("word"))
    if slips is None:
        return runs.select("word")
    runs = runs.withColumn("h", F.expr("crc32(cast(concat(coalesce(cast(doc_id as string), ''), ':', word) as binary))"))
    less = "concat(substring(word, 1, cast(h % char_length(word) as int)), substring(word, cast(h % char_length(word) as int) + 2))"
    return runs.select(F.expr(f"if(h % {int(slips)} = 0, {less}, word)").alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    return words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _halves(word: str, left: str) -> str:
    """Of a string whose first `left` letters are the one segment of an own word: the two ways to know one segment of it.
    A longer word's unknown part has one letter more than an own one's."""
    known_left = f"named_struct('j', 0, 'known', substring({word}, 1, {left}), 'rest', substring({word}, {left} + 1), 'm', m - {left})"
    known_right = f"named_struct('j', 1, 'known', right({word}, m - {left}), 'rest', substring({word}, 1, {left} + if(own, 0, 1)), 'm', {left})"
    return f"array({known_left}, {known_right})"


def _segments(words: DataFrame) -> DataFrame:
    """key, own, m, rest, word, n: each word's two segments under its own length, and two substrings under the length below.
    m is the length of an own word's rest."""
    roles = words.select("word", "n", F.explode(F.array(F.lit(True), F.lit(False))).alias("own")).withColumn("m", F.expr("char_length(word) - if(own, 0, 1)"))
    cut = roles.select("*", F.explode(F.expr(_halves("word", "m div 2"))).alias("s"))
    return cut.select(F.xxhash64("m", "s.j", "s.known").alias("key"), "own", F.col("s.m").cast("int").alias("m"), "s.rest", "word", "n")


def _finer(rows: DataFrame) -> DataFrame:
    """The same words under keys that know half of the rest besides."""
    cut = rows.select("*", F.explode(F.expr(_halves("rest", "m div 2"))).alias("s"))
    return cut.select(F.xxhash64("key", "s.j", "s.known").alias("key"), "own", F.col("s.m").cast("int").alias("m"), "s.rest", "word", "n")


def _verified(rows: DataFrame) -> DataFrame:
    """a, a_n, b, b_n of the words in a bucket that are one edit apart; a is the own one, of two own ones the smaller."""
    a = rows.where("own").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = rows.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("own").alias("b_own"))
    return a.join(b, "key").where("(not b_own or a < b) and levenshtein(a, b, 1) = 1").select("a", "a_n", "b", "b_n")


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, a_n, b, b_n: every pair of words (word, n) that one inserted, deleted or replaced letter parts, once."""
    rows = materialize(_segments(words), "segments")
    found = []
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.count_if("own").alias("owns"), F.max("m").alias("m"))
        # a key without an own word, or with one word, joins nothing
        large = materialize(sizes.where(f"owns > 0 and size > {bucket} and m > 1").select("key"), "large")
        if not large.limit(1).count():
            found.append(materialize(_verified(rows), "near"))
            discard(large, rows)
            break
        found.append(materialize(_verified(rows.join(large, "key", "left_anti")), "near"))
        finer = materialize(_finer(rows.join(large, "key", "left_semi")), "segments")
        discard(large, rows)
        rows = finer
    return reduce(DataFrame.union, found).distinct()


def grouped(words: DataFrame, ratio: int = RATIO, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (word, n); see the module."""
    words = materialize(words, "words")
    pairs = near_words(words, bucket)
    both = pairs.union(pairs.select("b", "b_n", "a", "a_n"))
    # least of (-n, word): the most frequent, of equally frequent ones the first
    near = both.groupBy(F.col("a").alias("word"), F.col("a_n").alias("n")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    is_form = F.col("best.less") * -1 >= ratio * F.col("n")
    near = materialize(near.select("word", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(near.where("form is not null").select("word", F.col("form").alias("root")))
    whole = words.join(near, "word", "left").join(roots, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def _roots(up: DataFrame) -> DataFrame:
    """word, root: where the links (word, root) lead. A form is `ratio` times as frequent, so that chains are short and end;
    each round doubles what they have gone."""
    up = materialize(up, "roots")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not up.join(further, "root", "left_semi").limit(1).count():
            return up
        longer = materialize(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(up)
        up = longer


def spelling_variants(documents: DataFrame, slips: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    return grouped(vocabulary(typed_words(documents, slips, id_col, text_col), min_length, min_count), ratio)
