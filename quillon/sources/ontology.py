"""OBO ontology text as tables (S1-S4, F1-F4), file catalogues and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import quoted
from quillon.sources import images

SCOPES = ("EXACT", "RELATED", "NARROW", "BROAD")


def stanzas(texts: DataFrame, col: str = "value") -> DataFrame:
    """n, kind, body: a file's stanzas in order; what stands before the first one has kind ''."""
    parts = texts.select(F.posexplode(F.split(F.col(col), r"(?m)^(?=\[[^\]\n]+\]\s*$)")).alias("n", "part"))
    head = r"^\[([^\]\n]+)\]"
    return parts.select("n", F.regexp_extract("part", head, 1).alias("kind"), F.regexp_replace("part", head, "").alias("body"))


def fields(parts: DataFrame) -> DataFrame:
    """n, kind, line, key, value: repeated keys stay in order; blank lines, comments and lines without a colon don't."""
    lines = parts.select("n", "kind", F.posexplode(F.split("body", "\n")).alias("line", "raw"))
    lines = lines.where("trim(raw) <> '' and not startswith(ltrim(raw), '!') and contains(raw, ': ')")
    pair = F.split("raw", ": ", 2)
    return lines.select("n", "kind", "line", F.trim(pair[0]).alias("key"), F.trim(pair[1]).alias("value"))


def header(parts: DataFrame) -> DataFrame:
    """format_version, data_version, license of the text before the first stanza (S4); null where a line is missing."""
    top = parts.where("kind = ''").select(F.col("body").alias("h"))
    value = lambda key: F.nullif(F.regexp_extract("h", rf"(?m)^{key}:\s*(\S+)", 1), F.lit(""))
    licence = F.nullif(F.regexp_extract("h", r"(?m)^property_value:\s*(?:terms:license|http://purl\.org/dc/(?:terms|elements/1\.1)/(?:license|rights))\s+\"?([^\s\"]+)", 1), F.lit(""))
    return top.select(value("format-version").alias("format_version"), value("data-version").alias("data_version"), licence.alias("license"))


def problems(parts: DataFrame, found: DataFrame, expected_terms: int | None = None) -> DataFrame:
    """problem, n of a file (S3, X32): header lines that are missing, repeated or missing ids, terms without a name,
    synonyms without a quoted text or with an unknown scope, and a number of terms other than expected."""
    h, t, s = header(parts), terms(found), synonyms(found)
    one = lambda name, n: F.struct(F.lit(name).alias("problem"), n.cast("long").alias("n"))
    top = h.agg(F.array(one("no data version", F.count_if(F.col("data_version").isNull())), one("no license", F.count_if(F.col("license").isNull()))).alias("a"))
    body = t.agg(F.array(one("no id", F.count_if(F.col("id").isNull())), one("no name", F.count_if(F.col("name").isNull())), one("repeated id", F.count("id") - F.count_distinct("id")), one("number of terms", F.abs(F.count("*") - F.lit(expected_terms)) if expected_terms is not None else F.lit(0))).alias("a"))
    syn = s.agg(F.array(one("unquoted synonym", F.count_if(F.col("value").isNull())), one("unknown scope", F.count_if(F.col("scope").isNull()))).alias("a"))
    return top.union(body).union(syn).select(F.explode("a").alias("e")).select("e.*")


def terms(found: DataFrame) -> DataFrame:
    """id, name, namespace, definition, its xrefs (F4), obsolete of the Term stanzas."""
    one = lambda key: F.first(F.when(F.col("key") == key, F.col("value")), True)
    t = found.where("kind = 'Term'").groupBy("n").agg(one("id").alias("id"), one("name").alias("name"), one("namespace").alias("namespace"), one("def").alias("def"), one("is_obsolete").alias("o"))
    return t.select("id", "name", "namespace", quoted(F.col("def"))[0].alias("definition"), _xrefs(quoted(F.col("def"))[1]).alias("definition_xrefs"), F.coalesce(F.col("o") == "true", F.lit(False)).alias("obsolete"))


def _xrefs(rest: Column) -> Column:
    """What stands in a tail's brackets."""
    return F.filter(F.split(F.regexp_extract(rest, r"\[([^\]]*)\]", 1), r",\s*"), lambda x: x != "")


def synonyms(found: DataFrame) -> DataFrame:
    """id, line, value, scope, type, xrefs, raw of each synonym (F3); a scope outside SCOPES is null, which problems()
    counts."""
    ids = found.where("kind = 'Term' and key = 'id'").select("n", F.col("value").alias("id"))
    value, rest = quoted(F.col("value"))
    scope = F.regexp_extract(rest, r"^([A-Z]+)", 1)
    kind = F.nullif(F.regexp_extract(rest, r"^[A-Z]+\s+([^\s\[]+)", 1), F.lit(""))
    rows = found.where("kind = 'Term' and key = 'synonym'").join(ids, "n")
    return rows.select("id", "line", value.alias("value"), F.when(scope.isin(*SCOPES), scope).alias("scope"), kind.alias("type"), _xrefs(rest).alias("xrefs"), F.col("value").alias("raw"))


def edges(found: DataFrame) -> DataFrame:
    """parent, child, relation from is_a and part_of."""
    ids = found.where("kind = 'Term' and key = 'id'").select("n", F.col("value").alias("child"))
    target = F.regexp_extract("value", r"(GO:[0-9]{7})", 1)
    rel = found.where("kind = 'Term' and (key = 'is_a' or (key = 'relationship' and startswith(value, 'part_of ')))").select("n", target.alias("parent"), F.when(F.col("key") == "is_a", "is_a").otherwise("part_of").alias("relation"))
    return rel.join(ids, "n").select("parent", "child", "relation").distinct()


def redirects(found: DataFrame) -> DataFrame:
    """id, kind, target: an alternate id leads to its term, an obsolete term to its replacements."""
    ids = found.where("kind = 'Term' and key = 'id'").select("n", F.col("value").alias("id"))
    links = found.where("kind = 'Term' and key in ('alt_id', 'replaced_by', 'consider')").select("n", "key", "value").join(ids, "n")
    alt = F.col("key") == "alt_id"
    return links.select(F.when(alt, F.col("value")).otherwise(F.col("id")).alias("id"), F.col("key").alias("kind"), F.when(alt, F.col("id")).otherwise(F.col("value")).alias("target"))


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    return fields(stanzas(spark.read.text(path, wholetext=True)))


def from_text(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stanzas and fields of whole OBO texts."""
    parts = stanzas(texts)
    return parts, fields(parts)


def fold_paths(root: str, fold: int) -> dict[str, str]:
    """Places of a fold's tables."""
    if fold not in (1, 2, 3):
        raise ValueError("folds are 1, 2 and 3")
    return {name: f"{root}/fold{fold}/{name}" for name in ("images", "masks", "types")}


def annotations(lines: DataFrame, vocabulary: list[str], excluded: list[str] = ()) -> DataFrame:
    """path, label of lines `path label` (S11); excluded labels are left out, a label outside the vocabulary is an error."""
    p = F.split(F.trim("value"), r"\s+(?=\S+$)")
    rows = lines.where("trim(value) <> ''").select(p[0].alias("path"), F.get(p, F.lit(1)).alias("label"))
    rows = rows.where(F.col("label").isNull() | ~F.col("label").isin(list(excluded)))
    if rows.where(F.col("label").isNull() | ~F.col("label").isin(list(vocabulary))).limit(1).count():
        raise ValueError("a label is not in the vocabulary")
    return rows


def sidecars(lines: DataFrame) -> DataFrame:
    """name, sha256 of lines `digest  name` (F23); others are null."""
    ok = F.col("value").rlike(r"^[0-9a-f]{64}\s+\S")
    return lines.where("trim(value) <> ''").select(F.when(ok, F.regexp_extract("value", r"^\S+\s+(.*\S)\s*$", 1)).alias("name"), F.when(ok, F.regexp_extract("value", r"^(\S+)", 1)).alias("sha256"))


#: First bytes of the image formats that are taken in.
MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "tiff": "49492A00", "tiff_be": "4D4D002A", "bmp": "424D"}


#: The sides and the number of pixels that an image may have.
SIDES, PIXELS = (64, 4096), 32_000_000


def image_stills(files: DataFrame, registry: DataFrame | None = None, most: int = 64 << 20, sides: tuple[int, int] = SIDES, pixels: int = PIXELS) -> DataFrame:
    """id, kind, path, bytes, width, height of new images (S15): recognised by their first bytes, not empty and of at most
    `most` bytes, both sides within `sides` and at most `pixels` pixels by their headers (an image that tells no size is out);
    the id is what their digest begins with. Equal files come in once, and not again if the registry (id) has them.
    files (path, length, content)."""
    kind = F.coalesce(*(F.when(F.startswith(F.hex(F.substring("content", 1, 8)), F.lit(m)), F.lit(k.partition("_")[0])) for k, m in MAGIC.items()))
    known = files.where(F.col("length").between(1, most)).withColumn("kind", kind).where("kind is not null")
    rows = known.select(F.substring(F.sha2("content", 256), 1, 12).alias("id"), "kind", "path", F.col("length").alias("bytes"), images.size(F.col("content")).alias("size"))
    rows = rows.select("id", "kind", "path", "bytes", "size.width", "size.height")
    rows = rows.where(F.col("width").between(*sides) & F.col("height").between(*sides) & (F.col("width") * F.col("height") <= pixels))
    rows = rows.groupBy("id").agg(F.min(F.struct("path", "kind", "bytes", "width", "height")).alias("f")).select("id", "f.kind", "f.path", "f.bytes", "f.width", "f.height")
    return rows if registry is None else rows.join(registry.select("id"), "id", "left_anti")


def file_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines `cls cx cy w h` (S10): the five numbers, and whether the line is malformed."""
    parts = F.split(F.trim("value"), r"\s+")
    number = lambda i: F.expr(f"try_cast(get(p, {i}) as double)")
    read = spark.read.text(path).where("trim(value) <> ''").select(parts.alias("p"))
    read = read.select(F.size("p").alias("n"), *(number(i).alias(c) for i, c in enumerate(("cls", "cx", "cy", "w", "h"))))
    return read.select("cls", "cx", "cy", "w", "h", ((F.col("n") != 5) | F.expr("cls is null or cx is null or cy is null or w is null or h is null")).alias("malformed"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema."""
    return spark.read.schema(schema).json(path)
