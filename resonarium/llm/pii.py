"""Personal data: regular expressions propose spans, checksums confirm, context adjusts the score.

Only SQL functions: one pass over the texts, no shuffle and no Python workers.
The places of matches follow from the pieces between them, whose lengths are
prefix-summed in blocks, so the cost stays near linear in the matches of a
text. Patterns are written so that the regular-expression engine neither
recurses nor rescans on long runs: repeats are possessive, and a run that
failed at its start isn't tried again from its middle.

Kinds: email; ip (four parts up to 255); card (14 to 19 digits, Luhn); phone
(10 to 15 digits after a plus sign); iban (mod 97, added by this method).
Defined results: a null text is empty; matches that fail are dropped without a
retry; matches of one kind don't overlap, of different kinds they may; repeated
rows and null ids give rows like any other; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Characters of an account number by country (ISO 13616).
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG YE", 25: "AO CV GW LY MZ PT ST", 26: "IR IS TR", 27: "BF BI BJ CF CG CM DJ EG FR GA GQ GR HN IT KM MC MG MR SM TD", 28: "AL AZ BY CI CY DO GT HU LB MA ML NE NI PL SN SV TG",
    29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account(size: int) -> str:
    """Pattern of the account numbers of `size` characters, in groups of four with a blank before each or not."""
    fours, rest = divmod(size - 4, 4)
    tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
    return rf"(?:{LENGTHS[size].replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}{tail}"


PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(map(_account, sorted(LENGTHS))) + r")(?![A-Za-z0-9])",
}
#: A text without a match of this has none of the kind; quicker to tell.
NEEDS = {"email": lambda t: t.contains("@"), "phone": lambda t: t.contains("+")}
#: Score of a confirmed span, and what a context word within REACH characters adds.
SCORE = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT_SCORE, REACH = 0.1, 40
CONTEXT = {
    "email": r"(?i)mail|contact|@",
    "ip": r"(?i)\bip\b|address|host|server",
    "card": r"(?i)card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel|call|mobile|fax",
    "iban": r"(?i)iban|bank|account|konto|compte|cuenta",
}
BLOCK = 256


def with_ends(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Adds _e_<kind>: where each match ends, by running sums in blocks.

    Each step is a projection of its own, and each array used inside a lambda is
    also used outside of one, so the optimizer keeps it as a column and the
    lambda does not compute it again for every element.
    """
    zero = F.lit(0).cast("long")
    last = lambda k: F.greatest(F.lit(0), F.floor((F.size(f"_n_{k}") - 1) / BLOCK).cast("int"))

    def step(name: str, how) -> DataFrame:
        return rows.select("*", *(F.when(F.size(f"_m_{k}") > 0, how(k)).alias(f"{name}{k}") for k in kinds))

    rows = step("_n_", lambda k: F.zip_with(F.col(f"_m_{k}"), F.slice(f"_p_{k}", F.lit(1), F.size(f"_m_{k}")), lambda x, p: (F.length(x) + F.length(p)).cast("long")))
    rows = step("_b_", lambda k: F.transform(F.sequence(F.lit(0), last(k)), lambda b: F.slice(f"_n_{k}", b * BLOCK + 1, BLOCK)))
    rows = step("_s_", lambda k: F.transform(F.col(f"_b_{k}"), lambda x: F.aggregate(x, zero, lambda s, v: s + v)))
    rows = step("_t_", lambda k: F.transform(F.sequence(F.lit(0), F.size(f"_s_{k}") - 1), lambda b: F.aggregate(F.slice(f"_s_{k}", F.lit(1), b), zero, lambda s, v: s + v)))
    inner = lambda x, base: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.aggregate(F.slice(x, F.lit(1), i), base, lambda s, v: s + v))
    return step("_e_", lambda k: F.flatten(F.zip_with(f"_b_{k}", f"_t_{k}", inner)))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn's check."""

    def step(s: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return s + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), step) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number without blanks leaves 1 modulo 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(r: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97).cast("int")

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return m.rlike("^" + r"\.".join([part] * 4) + "$")
    if kind == "card":
        d = digits(m)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    return F.lit(True)


def spans_of(kind: str) -> Column:
    """Spans of a kind from the columns of its matches and of the pieces between them."""
    m, rest = F.col(f"_m_{kind}"), F.col(f"_p_{kind}")
    near = F.transform(rest, lambda p: F.struct(F.substring(p, 1, REACH).alias("after"), F.substring(p, -REACH, REACH).alias("before")))
    rows = F.arrays_zip(m.alias("m"), F.col(f"_e_{kind}").alias("e"), F.slice(near, F.lit(1), F.size(m)).alias("l"), F.slice(near, F.lit(2), F.size(m)).alias("r"))

    def span(x: Column) -> Column:
        around = F.concat(x["l"]["before"], F.lit(" "), x["r"]["after"]).rlike(CONTEXT[kind])
        return F.struct(
            (x["e"] - F.length(x["m"])).alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            x["e"].alias("end"),
            F.lit(kind).alias("kind"),
            x["m"].alias("text"),
            (F.lit(SCORE[kind]) + F.when(around, CONTEXT_SCORE).otherwise(0.0)).alias("score"),
        )

    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,text:string,score:double>>")
    return F.when(F.size(m) > 0, F.transform(F.filter(rows, lambda x: valid(kind, x["m"])), span)).otherwise(none)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Rows (id, spans): arrays of (start, rank, end, kind, text, score) in order of start, then kind."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")
    none = F.array().cast("array<string>")

    def matches(kind: str) -> Column:
        got = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        return F.when(NEEDS[kind](text), got).otherwise(none) if kind in NEEDS else got

    rows = rows.select("id", "_text", *(matches(k).alias(f"_m_{k}") for k in kinds))
    rows = rows.select("id", *(f"_m_{k}" for k in kinds), *(F.when(F.size(f"_m_{k}") > 0, F.split(text, PATTERNS[k], -1)).alias(f"_p_{k}") for k in kinds))
    rows = with_ends(rows, kinds)
    return rows.select("id", F.array_sort(F.concat(*map(spans_of, kinds))).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """Rows (id, text): every span of at least `least_score` replaced by its kind in angle brackets; of overlapping spans the first counts."""
    found = find(docs.select(F.struct(id_col, text_col).alias("_row"), F.col(text_col).alias("_body")), "_row", "_body")
    text = F.coalesce(F.col(f"id.{text_col}"), F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda s, x: F.when(x["start"] < s["at"], s).otherwise(
        F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.concat(F.lit("<"), x["kind"], F.lit(">")))).alias("out"))
    )
    done = F.aggregate(F.filter("spans", lambda x: x["score"] >= least_score), start, step)
    rows = found.select("id", done.alias("d"), text.alias("t"))
    return rows.select(F.col(f"id.{id_col}").alias("id"), F.concat(F.array_join("d.out", ""), F.substring("t", (F.col("d.at") + 1).cast("int"), F.length("t"))).alias("text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    scores = F.array_join(F.transform("spans", lambda x: F.round(x["score"], 2).cast("string")), ",")  # one for each of spans
    return found.select(F.col("id").alias("doc_id"), *map(count, BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), scores.alias("scores"))


def _sql() -> str:
    """The same over DuckDB: pieces and matches by the plain patterns, account numbers by word boundaries.

    Its engine has no look-behind. A boundary there takes an underline for a
    letter, so these are put out of the way first; context is put in lower case
    before it is searched.
    """
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b(?:" + "|".join(map(_account, sorted(LENGTHS))) + r")\b",
    }
    words = {k: v.removeprefix("(?i)") for k, v in CONTEXT.items()}
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = ", ".join(f"('{k}', {i}, '{plain[k]}', '{words[k]}', {SCORE[k]}e0)" for i, k in enumerate(KINDS))
    counts = ", ".join(f"COUNT(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS t FROM documents),
p AS (SELECT * FROM (VALUES {kinds}) v(kind, rank, pattern, words, base)),
y AS (SELECT r, kind, rank, words, base, regexp_extract_all(CASE kind WHEN 'iban' THEN translate(t, '_', '-') ELSE t END, pattern) AS found, string_split_regex(CASE kind WHEN 'iban' THEN translate(t, '_', '-') ELSE t END, pattern) AS rest FROM d, p),
u AS (SELECT r, kind, rank, words, base, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS m, unnest(rest[1:len(found)]) AS before, unnest(rest[2:len(found) + 1]) AS after FROM y WHERE len(found) > 0),
x AS (SELECT *, SUM(length(m) + length(before)) OVER (PARTITION BY r, rank ORDER BY i)::BIGINT AS stop, regexp_replace(m, '[^0-9]', '', 'g') AS n,
  regexp_matches(translate(right(before, {REACH}) || ' ' || left(after, {REACH}), '{upper}', '{upper.lower()}'), words) AS near FROM u),
c AS (SELECT *, CASE kind WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda s: length(ltrim(s, '0')) > 3 OR COALESCE(TRY_CAST(NULLIF(right(ltrim(s, '0'), 4), '') AS INT), 0) > 255)) = 0
  WHEN 'card' THEN length(n) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(n)), lambda k: CASE WHEN k % 2 = 0 THEN n[length(n) - k]::INT WHEN n[length(n) - k]::INT > 4 THEN 2 * n[length(n) - k]::INT - 9 ELSE 2 * n[length(n) - k]::INT END)) % 10 = 0
  WHEN 'phone' THEN length(n) BETWEEN 10 AND 15
  WHEN 'iban' THEN list_reduce([0] || list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda s: CASE WHEN s BETWEEN '0' AND '9' THEN ascii(s) - 48 ELSE ascii(s) - 55 END), lambda a, b: CASE WHEN b < 10 THEN (a * 10 + b) % 97 ELSE (a * 100 + b) % 97 END) = 1
  ELSE TRUE END AS ok FROM x),
s AS (SELECT r, kind, rank, stop - length(m) AS start, kind || ':' || (stop - length(m)) || ':' || stop AS span, round(base + CASE WHEN near THEN {CONTEXT_SCORE}e0 ELSE 0 END, 2)::VARCHAR AS score FROM c WHERE ok),
b AS (SELECT r, {counts}, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans, string_agg(score, ',' ORDER BY start, rank) AS scores FROM s GROUP BY r)
SELECT doc_id, {', '.join(f'COALESCE(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans, COALESCE(scores, '') AS scores FROM d LEFT JOIN b USING (r)
"""


OP8_SQL = _sql()
