"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod 97 for IBANs, ranges for addresses and
digit counts), and words before a span change its score. Four kinds have fixed rules and are kept whenever these hold
(the base). Further kinds (iban, ssn, tel) are kept if their score reaches KEEP_AT: a valid IBAN (as long as its country's
are) does so by itself, the two others only with a fitting word in the CONTEXT characters before them.

Places are code points, ends exclusive; matches of one kind don't overlap, and a match that fails its check is dropped
without another try. A null text counts as empty; an empty text has no spans. Expressions are written so that time is
linear in the text and no match recurses, however long the text is. Repeated rows give repeated results, empty tables
empty ones, and other columns are passed through; a column with the name of the added one is replaced by it, after the
text was read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT, KEEP_AT = 40, 0.6
#: Digits that fill an address part: 0 to 255 with leading zeros.
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LOCAL = "[A-Za-z0-9._%+-]"
#: Lengths of IBANs by country, those of the registry and the known ones outside it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE GG IE IM JE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI BL CF CG CM DJ FR GA GF GP GQ GR IT KM MC MF MG MQ MR NC PF PM RE SM TD TF WF YT", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
#: kind: (a cheap test that a text may hold one, the expression). Possessive forms match what greedy ones would.
BASE = {
    "email": ("@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){13}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
ADDED = {
    "iban": (r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]", rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "tel": (r"[0-9]{3}(?:\)?[\x20.-]|\))[0-9]{3}[\x20.-][0-9]{4}", r"(?<![0-9+])(?<![0-9][\x20.-])(?<![0-9]\()(?<![0-9][\x20.-]\()(?:1[\x20.-])?(?:\([0-9]{3}\)[\x20.-]?|\(?[0-9]{3}\)?[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
}
#: kind: (score without context, what a context word adds, context words)
SCORES = {
    "email": (0.9, 0.1, "mail|contact|write|send"),
    "ip": (0.7, 0.2, "ip|host|server|address|addr"),
    "card": (0.8, 0.2, "card|visa|master|amex|credit|debit|pay"),
    "phone": (0.7, 0.2, "call|phone|tel|mobile|fax|dial"),
    "iban": (0.8, 0.2, "iban|account|bank|konto|cuenta|compte"),
    "ssn": (0.3, 0.5, "ssn|social|security"),
    "tel": (0.3, 0.4, "call|phone|tel|mobile|fax|dial"),
}
KINDS = [*BASE, *ADDED]
_BLOCK = 256
_NONE = "cast(array() as array<struct<start:long,kind_no:int,end:long,kind:string,score:double,base:boolean>>)"


def _digits(hit: str) -> str:
    return f"regexp_replace({hit}, '[^0-9]', '')"


def _valid(kind: str, hit: str) -> str:
    if kind == "ip":
        return f"{hit} rlike r'\\A{_BYTE}(?:\\.{_BYTE}){{3}}\\z'"
    if kind == "card":
        return f"length({_digits(hit)}) between 14 and 19 and luhn_check({_digits(hit)})"
    if kind == "phone":
        return f"length({_digits(hit)}) between 10 and 15"
    if kind == "iban":
        turned = f"regexp_replace({hit}, ' ', '')"
        turned = f"concat(substring({turned}, 5), substring({turned}, 1, 4))"
        value = "case when c between '0' and '9' then (a * 10 + ascii(c) - 48) % 97 else (a * 100 + ascii(c) - 55) % 97 end"
        return f"length({hit}) - length(regexp_replace({hit}, '[A-Z0-9]', '')) between 15 and 34 and aggregate(split({turned}, ''), 0, (a, c) -> case when c = '' then a else {value} end) = 1"
    if kind == "ssn":
        return f"not {hit} rlike '^(000|666|9)|-00-|-0000$'"
    return "true"


def _spans(kind: str, text: str) -> str:
    """An array of one kind's spans. Gaps and matches alternate over the whole text; places are their running lengths,
    summed block by block so that a text with very many matches stays cheap."""
    test, pattern = (BASE | ADDED)[kind]
    both = f"r'(?s)(.*?)({pattern}|\\z)'"
    pairs = f"zip_with(regexp_extract_all({text}, {both}, 1), regexp_extract_all({text}, {both}, 2), (g, h) -> named_struct('n', length(g), 'm', length(h), 'h', h, 'before', right(g, {CONTEXT})))"
    blocks = f"transform(sequence(0, (size(p) - 1) div {_BLOCK}), b -> slice(p, b * {_BLOCK} + 1, {_BLOCK}))"
    total = "aggregate(q, 0L, (a, x) -> a + x.n + x.m)"
    firsts = f"aggregate(transform(bs, q -> {total}), array(0L), (a, x) -> array_append(a, element_at(a, -1) + x))"
    place = "aggregate(bs[i], named_struct('at', os[i], 'out', cast(array() as array<long>)), (a, x) -> named_struct('at', a.at + x.n + x.m, 'out', array_append(a.out, a.at + x.n)), a -> a.out)"
    placed = f"flatten(transform(sequence(0, size(bs) - 1), i -> zip_with(bs[i], {place}, (x, s) -> named_struct('s', s, 'x', x))))"
    # a bound variable for each intermediate result
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    alone, more, words = SCORES[kind]
    score = f"{alone}D + case when lower(z.x.before) rlike '\\\\b({words})' then {more}D else 0D end"
    kept = f"length(z.x.h) > 0 and {_valid(kind, 'z.x.h')}" + ("" if kind in BASE else f" and {score} >= {KEEP_AT}D")
    made = f"named_struct('start', z.s, 'kind_no', {KINDS.index(kind)}, 'end', z.s + z.x.m, 'kind', '{kind}', 'score', {score}, 'base', {'true' if kind in BASE else 'false'})"
    found = let("p", pairs, let("bs", blocks, let("os", firsts, f"transform(filter({placed}, z -> {kept}), z -> {made})")))
    return f"case when {text} rlike r'{test}' then {found} else {_NONE} end"


def _all_spans(text_col: str) -> str:
    text = f"coalesce(cast(`{text_col}` as string), '')"
    return f"array_sort(concat({', '.join(_spans(k, text) for k in KINDS)}))"


def find(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `pii`: array of (start, kind_no, end, kind, score, base), sorted by start and then kind."""
    return df.withColumn("pii", F.expr(_all_spans(text_col)))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redact(df: DataFrame, text_col: str = "text", out_col: str = "redacted") -> DataFrame:
    """Adds the text with each span replaced by its kind in brackets; of overlapping spans the first counts and the rest
    of a later one goes too. A null text stays null; a text without spans stays as it is."""
    text = f"cast(`{text_col}` as string)"
    step = f"named_struct('at', greatest(a.at, x.end), 'out', case when x.start >= a.at then concat(a.out, array(substring({text}, cast(a.at + 1 as int), cast(x.start - a.at as int)), concat('[', upper(x.kind), ']'))) else a.out end)"
    whole = f"aggregate(p, named_struct('at', 0L, 'out', cast(array() as array<string>)), (a, x) -> {step}, a -> concat(array_join(a.out, ''), substring({text}, cast(a.at + 1 as int))))"
    # a bound variable, so that the spans are found once
    redacted = f"element_at(transform(array({_all_spans(text_col)}), p -> case when size(p) = 0 then {text} else {whole} end), 1)"
    return df.withColumn(out_col, F.expr(redacted))
