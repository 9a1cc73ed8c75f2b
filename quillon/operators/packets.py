"""Packets of findings and evidence, responses that must be grounded in them, and the notes made of both.

All are tables: findings (case_id, finding_id, label, qualifier, count, confidence), context (case_id, evidence_id, go_id,
name, definition, mode, rank), claims (case_id, seq, claim_id, text, finding_ids, evidence_ids), responses (case_id,
abstained, abstention_reason). A check returns the rows that break a rule, with the rule's name.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.blocks import running_sums

MENTION = r"(?i)GO:[0-9]+"


def violations(df: DataFrame, key: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """The keys of rows and the rules they break; a rule that is neither true nor false for a row is not broken."""
    each = F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()))
    return df.select(*key, F.explode(F.array_compact(each)).alias("rule"))


def repeated(df: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1").select(*key, F.lit(rule).alias("rule"))


def packet_findings(state: DataFrame) -> DataFrame:
    """The findings that go into a packet (P9): rejected ones don't, a missing qualifier is `observed`."""
    fields = ["case_id", "finding_id", "label", "count", "confidence"]
    return state.where("coalesce(review_state, '') <> 'rejected'").select(*fields, F.coalesce("qualifier", F.lit("observed")).alias("qualifier"))


def finding_violations(findings: DataFrame, labels: Sequence[str], qualifiers: Sequence[str] = ("observed", "uncertain", "possible")) -> DataFrame:
    """case_id, id, rule (P10)."""
    f = findings.withColumn("id", F.col("finding_id"))
    rules = {
        "finding id": F.col("id").isNull() | ~F.col("id").rlike(r"^F[0-9]+$"), "label": F.col("label").isNull() | ~F.col("label").isin(list(labels)),
        "qualifier": ~F.coalesce("qualifier", F.lit("observed")).isin(list(qualifiers)), "confidence": ~F.col("confidence").between(0, 1), "count": F.col("count") < 0,
    }
    return violations(f, ["case_id", "id"], rules).unionByName(repeated(f, ["case_id", "id"], "repeated finding"))


def context_violations(context: DataFrame, modes: Sequence[str] = ("symbolic", "vector", "hybrid")) -> DataFrame:
    """case_id, id, rule (P10)."""
    c = context.withColumn("id", F.col("evidence_id"))
    empty = lambda n: F.coalesce(F.trim(n), F.lit("")) == ""
    rules = {
        "evidence id": F.col("id").isNull() | ~F.col("id").rlike(r"^E[0-9]+$"), "go id": F.col("go_id").isNull() | ~F.col("go_id").rlike(r"^GO:[0-9]{7}$"),
        "name": empty("name"), "definition": empty("definition"), "mode": F.col("mode").isNull() | ~F.col("mode").isin(list(modes)), "rank": F.col("rank").isNull() | (F.col("rank") < 1),
    }
    return violations(c, ["case_id", "id"], rules).unionByName(repeated(c, ["case_id", "id"], "repeated evidence"))


def response_violations(responses: DataFrame, claims: DataFrame, findings: DataFrame, context: DataFrame) -> DataFrame:
    """case_id, id (of the claim, or null), rule (A7, F19): what keeps a response from becoming a note."""
    n = claims.groupBy("case_id").agg(F.count("*").alias("n"))
    whole = responses.join(n, "case_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "id": F.lit(None).cast("string")})
    rules = {
        "abstained with claims": F.col("abstained") & (F.col("n") > 0), "abstained without reason": F.col("abstained") & (F.coalesce(F.trim("abstention_reason"), F.lit("")) == ""),
        "no claim": ~F.col("abstained") & (F.col("n") == 0), "abstained missing": F.col("abstained").isNull(),
    }
    out = [violations(whole, ["case_id", "id"], rules)]
    made = claims.join(responses.where("not abstained").select("case_id"), "case_id", "left_semi").withColumn("id", F.col("claim_id"))
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    out.append(violations(made, ["case_id", "id"], {"claim id": empty("id"), "text": empty("text"), "no evidence": none("evidence_ids"), "no finding": none("finding_ids")}))
    out.append(repeated(made, ["case_id", "id"], "repeated claim"))
    key = ["case_id", "x"]
    for rule, cited, known in (
        ("unknown evidence", F.col("evidence_ids"), context.select("case_id", F.col("evidence_id").alias("x"))),
        ("unknown finding", F.col("finding_ids"), findings.select("case_id", F.col("finding_id").alias("x"))),
        ("unsupported mention", F.regexp_extract_all("text", F.lit(MENTION), F.lit(0)), context.select("case_id", F.col("go_id").alias("x"))),
    ):
        named = made.select("case_id", "id", F.explode(F.array_distinct(cited)).alias("x"))
        out.append(named.join(known.distinct(), key, "left_anti").select("case_id", "id", F.lit(rule).alias("rule")).distinct())
    return reduce(DataFrame.unionByName, out)


def scored_cases(cases: DataFrame, responses: DataFrame, claims: DataFrame, findings: DataFrame, context: DataFrame) -> DataFrame:
    """case_id, valid, abstained, finding_recall, go_recall, missing and forbidden things, passed.
    cases (case_id, expect_abstention, required_labels, required_go, forbidden_labels, forbidden_texts)."""
    bad = response_violations(responses, claims, findings, context).select("case_id").distinct().withColumn("bad", F.lit(True))
    label = claims.select("case_id", F.explode("finding_ids").alias("finding_id")).join(findings.select("case_id", "finding_id", "label"), ["case_id", "finding_id"])
    go = claims.select("case_id", F.explode("evidence_ids").alias("evidence_id")).join(context.select("case_id", "evidence_id", "go_id"), ["case_id", "evidence_id"])
    told = claims.groupBy("case_id").agg(F.lower(F.expr("listagg(text, ' ') within group (order by seq)")).alias("told"))
    every = cases.join(responses.select("case_id", "abstained"), "case_id", "left").join(bad, "case_id", "left").join(told, "case_id", "left")
    every = every.join(label.groupBy("case_id").agg(F.collect_set("label").alias("labels")), "case_id", "left").join(go.groupBy("case_id").agg(F.collect_set("go_id").alias("gos")), "case_id", "left")
    nothing = F.array().cast("array<string>")
    every = every.withColumns({c: F.coalesce(c, nothing) for c in ("labels", "gos", "required_labels", "required_go", "forbidden_labels", "forbidden_texts")})
    every = every.withColumns({
        "missing_labels": F.array_sort(F.array_except("required_labels", "labels")), "missing_go": F.array_sort(F.array_except("required_go", "gos")),
        "forbidden_cited": F.array_sort(F.array_intersect("forbidden_labels", "labels")),
        "forbidden_found": F.array_sort(F.array_distinct(F.filter(F.transform("forbidden_texts", F.lower), lambda s: F.contains(F.coalesce("told", F.lit("")), s)))),
        "valid": F.col("bad").isNull() & F.col("abstained").isNotNull(),
    })
    share = lambda need, missing: F.round(F.when(F.size(need) == 0, 1.0).otherwise(1 - F.size(missing) / F.size(F.array_distinct(need))), 6)
    clean = reduce(lambda a, b: a & b, (F.size(c) == 0 for c in ("missing_labels", "missing_go", "forbidden_cited", "forbidden_found")))
    passed = F.col("valid") & F.when(F.col("expect_abstention"), F.col("abstained")).otherwise(~F.col("abstained") & clean)
    return every.select(
        "case_id", "valid", "abstained", share("required_labels", "missing_labels").alias("finding_recall"), share("required_go", "missing_go").alias("go_recall"),
        "missing_labels", "missing_go", "forbidden_cited", "forbidden_found", F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def suite(scored: DataFrame) -> DataFrame:
    """total, passed, all_passed."""
    return scored.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all_passed"))


def corpus_membership(context: DataFrame, terms: DataFrame) -> DataFrame:
    """case_id, evidence_id, problem of evidence that the sealed terms don't hold as it says (A10)."""
    t = terms.select(F.col("id").alias("go_id"), F.col("name").alias("t_name"), F.col("definition").alias("t_def"), "obsolete")
    problem = F.when(F.col("obsolete").isNull(), "unknown").when(F.col("obsolete"), "obsolete").when(F.col("name") != F.col("t_name"), "name").when(~F.contains("t_def", F.col("definition")), "definition")
    return context.join(t, "go_id", "left").select("case_id", "evidence_id", problem.alias("problem")).where("problem is not null")


#: Fixed value: the last line of every note, as users of such notes know it.
ASSIST_WARNING = "Diagnostic-assist only: this note was generated locally from supplied findings and retrieved context. Every statement must be reviewed and signed off by a qualified human; nothing here makes an autonomous clinical call."


def notes(responses: DataFrame, claims: DataFrame, findings: DataFrame, context: DataFrame, limitations: DataFrame | None = None, warning: str = ASSIST_WARNING) -> DataFrame:
    """case_id, note (K11): a title; the claims in order, each with the labels and evidence it names itself, or the reason
    if abstained; the case's limitations (case_id, limitations array), if it has any; the warning.

    A claim is a row of `claims`: its place (seq) tells it from others of the same claim_id. Of repeated findings or
    evidence of one id the greatest counts. What a claim names and the case doesn't have is left out; a null reason is
    written as null.
    """
    row = ["case_id", "seq"]
    named = lambda ids, one: claims.select(*row, F.posexplode(ids).alias("p", one))
    joined = lambda df, text, out: df.groupBy(*row).agg(F.expr(f"listagg({text}, ', ') within group (order by p)").alias(out))
    known = findings.groupBy("case_id", "finding_id").agg(F.max("label").alias("label"))
    shown = context.groupBy("case_id", "evidence_id").agg(F.max("go_id").alias("go_id"))
    labels = joined(named("finding_ids", "finding_id").join(known, ["case_id", "finding_id"]), "label", "labels")
    cites = joined(named("evidence_ids", "evidence_id").join(shown, ["case_id", "evidence_id"]), "concat(evidence_id, ' (', go_id, ')')", "cites")
    lines = claims.join(labels, row, "left").join(cites, row, "left")
    line = F.format_string("- [%s] %s\n  findings: %s; evidence: %s", "claim_id", "text", F.coalesce("labels", F.lit("")), F.coalesce("cites", F.lit("")))
    body = lines.select(*row, line.alias("line")).groupBy("case_id").agg(F.expr("listagg(line, '\n') within group (order by seq)").alias("body"))
    every = responses.join(body, "case_id", "left")
    every = every.join(limitations, "case_id", "left") if limitations is not None else every.withColumn("limitations", F.lit(None).cast("array<string>"))
    said = F.when(F.col("abstained"), F.format_string("ABSTAINED: no supported finding to report.\nReason: %s", "abstention_reason")).otherwise(F.col("body"))
    limits = F.when(F.size("limitations") > 0, F.concat(F.lit("\nLimitations: "), F.array_join("limitations", "; ")))
    title = F.format_string("Case %s \u2014 synthesis review note\n", F.col("case_id").cast("string"))
    return every.select("case_id", F.concat(F.concat_ws("\n", title, said, limits, F.lit(f"\n{warning}")), F.lit("\n")).alias("note"))


def canonical_json(columns: Sequence[str]) -> Column:
    """One text for equal rows (F10, X26): fields in order of their names, nulls left out."""
    return F.to_json(F.struct(*sorted(columns)))


def digest(columns: Sequence[str]) -> Column:
    return F.sha2(F.concat(canonical_json(columns), F.lit("\n")), 256)


def stale(signed: DataFrame, packets: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Keys whose packet is no longer what was signed (T8). signed (key, digest)."""
    now = packets.select(key, digest(fields).alias("now"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("digest"), "changed")
    return signed.join(now, key, "left").select(key, problem.alias("problem")).where("problem is not null")


def parsed(raw: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON text is an object of the schema with something in it, and those whose text isn't."""
    read = raw.withColumn("_o", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    names = [f.split()[0] for f in schema.split(",")]
    ok = F.col("_o").isNotNull() & F.expr(f"coalesce({', '.join(f'cast(_o.{n} as string)' for n in names)}) is not null") & F.trim(column).startswith("{")
    return read.where(ok).select(*raw.columns, "_o.*"), raw.where(~F.coalesce(read_ok(column, schema, names), F.lit(False)))


def read_ok(column: str, schema: str, names: Sequence[str]) -> Column:
    some = F.lit(False)
    for n in names:
        some = some | F.from_json(column, schema)[n].isNotNull()
    return F.trim(column).startswith("{") & some


def requests(findings: DataFrame, context: DataFrame) -> DataFrame:
    """case_id, payload (X27): a case's findings and evidence as one JSON object, in order of their numbers."""
    part = lambda df, key, name: df.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(F.regexp_extract(key, "[0-9]+", 0).cast("long").alias("n"), F.struct(*[c for c in df.columns if c != "case_id"]).alias("o")))).alias(name))
    both = part(findings, "finding_id", "f").join(part(context, "evidence_id", "e"), "case_id", "full")
    items = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: x["o"])
    return both.select("case_id", F.to_json(F.struct(F.col("case_id"), items("e").alias("context"), items("f").alias("findings"))).alias("payload"))


def bundle(ids: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """key, bundle (K12): one JSON object of what there is of each part; a part that is missing is left out."""
    out = ids.select(key).distinct()
    for name, df in sorted(parts.items()):
        rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.to_json(F.struct(*sorted(c for c in df.columns if c != key))))).alias(name))
        out = out.join(rows, key, "left")
    return out.select(key, F.to_json(F.struct(*sorted(parts))).alias("bundle"))


def broken_bundle(reviews: DataFrame, packet: DataFrame, findings: DataFrame) -> DataFrame:
    """part, id of reviews and packet findings that are of no finding."""
    known = findings.select("case_id", "finding_id")
    off = lambda df, name: df.join(known, ["case_id", "finding_id"], "left_anti").select(F.lit(name).alias("part"), "case_id", "finding_id")
    return off(reviews, "review").unionByName(off(packet, "packet"))


def blinded(runs: DataFrame, seed: str) -> DataFrame:
    """case_id, reviewer_label, note (K13): each case's runs under letters in an order that its hash gives."""
    order = F.row_number().over(Window.partitionBy("case_id").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col("case_id").cast("string"), "run"), 256)))
    return runs.withColumn("n", order).select("case_id", F.chr(F.lit(64) + F.col("n")).alias("reviewer_label"), "note")


def confirm_unreviewed(findings: DataFrame, log: DataFrame, start: int) -> DataFrame:
    """Records that confirm each finding without any review (T6), numbered on from `start`; append them to the log."""
    new = findings.join(log.select("finding_id").distinct(), "finding_id", "left_anti").select("finding_id").distinct()
    numbered = running_sums(new, [F.col("finding_id")], {"before": F.lit(1)})
    return numbered.select((F.col("before") + 1 + start).cast("long").alias("seq"), "finding_id", F.lit("confirm").alias("action"))
