"""Secrets in texts: fixed patterns, and strings that look drawn at random to a character Markov model.

Only SQL functions: one pass over the texts, no shuffle of them and no Python
workers. Two first-order Markov models of characters are counted from labelled
strings: random ones and ordinary identifiers. A run of 16 or more characters
that keys are written in is a secret where the logarithm of its likelihood as a
random string over that as an identifier, summed over its steps, reaches
LEAST_RATIO and it has a letter (numbers are left to the search for personal data). The steps' logarithms are whole thousandths, so a sum is exact and
the same in any order and engine.

Kinds: assign (a value given to a word such as password or token), access
(AKIA keys), hex (24 and more), and random, which the models add. Spans of one
kind don't overlap, those of different kinds may: a key of hexadecimal digits is
hex as well as random. `redact` takes the union of all.

Samples: `labelled` takes the documents whose ids have the least digests, SAMPLE
of them at most, as one may fit a classifier on a bounded sample. Their base
spans are random strings, their shorter words outside of these are identifiers,
and for each identifier one string is drawn (its SHA-256 in base 64 and its MD5
in hexadecimal), so that the models can be fitted where no secret is known. All
other steps read every whole text.

Defined results: a null text is empty; matches that fail are dropped without a
retry; repeated rows and null ids give rows like any other (null ids are not
sampled, and rows of one id are sampled together); no samples at all give no
random spans; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonarium.llm.pii import with_ends

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_LENGTH = 16
_RUN = "[A-Za-z0-9+/_=-]"
PATTERNS = {
    "assign": ASSIGN,
    "access": "AKIA[A-Z0-9]{16,}+",
    "hex": "(?<![0-9a-f])[0-9a-f]{24,}+",
    "random": f"(?<!{_RUN}){_RUN}{{{LEAST_LENGTH},}}+",
}
#: Texts without it have none of the kind; quicker to tell.
NEEDS = {"access": "AKIA"}
#: Documents to learn from, at most.
SAMPLE = 500
#: Ordinary words have this many characters at least (and less than LEAST_LENGTH at most).
LEAST_WORD = 3
#: Codes of the characters '+' to 'z'.
LOW, SYMBOLS = 43, 80
#: Added to the count of each character; a step's probability is drawn to that of its character alone as by WEIGHT further steps.
ADDED, WEIGHT = 0.5, 20.0
#: Logarithms beyond as many thousandths are cut, so that no single step decides.
MOST_STEP = 3000
#: Thousandths of a logarithm of likelihoods: random strings must be e**12 times as likely.
LEAST_RATIO = 12_000
#: Thousandths a step, at least: a long run of ordinary words must not pass by its length.
LEAST_MEAN = 500


def sampled(docs: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Rows of the `sample` ids with the least digests; finding these reads the ids only."""
    key = F.md5(F.col(id_col).cast("string").cast("binary"))
    last = docs.where(F.col(id_col).isNotNull()).select(key.alias("key")).orderBy("key").limit(sample).agg(F.max("key").alias("key")).first()["key"]
    return docs.where(key <= F.lit(last)) if last is not None else docs.limit(0)


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Distinct rows (string, random): what `train` learns from."""
    texts = sampled(docs, id_col, sample).select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    every = lambda pattern, group=0: F.regexp_extract_all("t", F.lit(pattern), F.lit(group))
    known = F.concat(F.filter(every(ASSIGN, 2), lambda v: F.length(v) >= 6), every(PATTERNS["access"]), every(PATTERNS["hex"]))
    rest = F.col("t")
    for k in BASE:
        rest = F.regexp_replace(rest, PATTERNS[k], " ")
    words = F.filter(F.regexp_extract_all(rest, F.lit(f"{_RUN}+"), F.lit(0)), lambda w: F.length(w).between(LEAST_WORD, LEAST_LENGTH - 1))
    rows = texts.select(F.inline(F.concat(*(F.transform(a, lambda s: F.struct(s.alias("string"), F.lit(r).alias("random"))) for a, r in ((F.array_distinct(known), True), (F.array_distinct(words), False))))))
    rows = rows.distinct()
    word, no = F.col("string"), ~F.col("random")
    drawn = F.array(F.struct(F.base64(F.unhex(F.sha2(word, 256))).alias("string"), F.lit(True).alias("random")), F.struct(F.md5(word.cast("binary")).alias("string"), F.lit(True).alias("random")))
    own = F.array(F.struct("string", "random"))
    rows = rows.select(F.inline(F.when(no, F.concat(own, drawn)).otherwise(own))).distinct()
    return rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "string")  # few bytes, but much work on each


def steps(string: Column) -> Column:
    """Numbers of the steps from character to character, from 1 to SYMBOLS squared; null where a character is none of ours."""
    chars = F.filter(F.split(string, ""), lambda c: c != "")
    code = lambda c: F.ascii(c) - LOW
    known = lambda c: code(c).between(0, SYMBOLS - 1)
    pair = lambda a, b: F.when(known(a) & known(b), code(a) * SYMBOLS + code(b) + 1)
    return F.zip_with(chars, F.slice(chars, 2, F.size(chars)), pair)


def train(samples: DataFrame) -> list[int]:
    """The ratio of the two models' probabilities of each step, as thousandths of a logarithm.

    samples: rows (string, random). The result has SYMBOLS squared numbers however
    many samples there are; all are 0 without samples of either kind.
    """
    seen = samples.where("random IS NOT NULL").select("random", F.explode(steps(F.col("string"))).alias("step")).where("step IS NOT NULL")
    counts = [[0] * SYMBOLS**2, [0] * SYMBOLS**2]  # identifiers, random strings
    for row in seen.groupBy("step", "random").count().collect():  # at most two rows a step
        counts[row["random"]][row["step"] - 1] = row["count"]
    if not all(map(any, counts)):
        return [0] * SYMBOLS**2
    probability = []
    for c in counts:
        leaving = [sum(c[k : k + SYMBOLS]) for k in range(0, SYMBOLS**2, SYMBOLS)]
        alone = [(sum(c[k::SYMBOLS]) + ADDED) / (sum(c) + ADDED * SYMBOLS) for k in range(SYMBOLS)]  # of a character, whatever comes before it
        probability.append([(c[k] + WEIGHT * alone[k % SYMBOLS]) / (leaving[k // SYMBOLS] + WEIGHT) for k in range(SYMBOLS**2)])
    return [max(-MOST_STEP, min(MOST_STEP, round(1000 * math.log(r / o)))) for o, r in zip(*probability)]


def likelihood_ratio(string: Column, model: list[int]) -> Column:
    """Thousandths of the logarithm of how much likelier a string is as a random one."""
    table = F.from_json(F.lit(str(model)), "array<int>")
    step = lambda s, i: s + F.when(i.isNull(), 0).otherwise(F.element_at(table, i))
    return F.aggregate(steps(string), F.lit(0).cast("long"), step)


def valid(kind: str, m: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    if kind == "random":
        return m["m"].rlike("[A-Za-z]") & (m["ratio"] >= LEAST_RATIO) & (m["ratio"] >= LEAST_MEAN * (F.length(m["m"]) - 1))
    return F.lit(True)


def spans_of(kind: str, model: list[int]) -> Column:
    rows = F.arrays_zip(F.col(f"_m_{kind}").alias("m"), F.col(f"_e_{kind}").alias("e"))
    score = F.lit(1.0)
    if kind == "random":
        rows = F.transform(rows, lambda x: F.struct(x["m"].alias("m"), x["e"].alias("e"), likelihood_ratio(x["m"], model).alias("ratio")))
        rows = F.filter(rows, lambda x: valid(kind, x))
    else:
        rows = F.filter(rows, lambda x: valid(kind, x["m"]))

    def span(x: Column) -> Column:
        weight = x["ratio"] / F.lit(1000.0) if kind == "random" else score
        return F.struct((x["e"] - F.length(x["m"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["e"].alias("end"), F.lit(kind).alias("kind"), x["m"].alias("text"), weight.alias("score"))

    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,text:string,score:double>>")
    return F.when(F.size(f"_m_{kind}") > 0, F.transform(rows, span)).otherwise(none)


def find(docs: DataFrame, model: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, spans): arrays of (start, rank, end, kind, text, score) in order of start, then kind.

    The score of a base span is 1, that of a random one its logarithm of likelihoods.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text, none = F.col("_text"), F.array().cast("array<string>")

    def matches(kind: str) -> Column:
        got = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        return F.when(text.contains(NEEDS[kind]), got).otherwise(none) if kind in NEEDS else got

    rows = rows.select("id", "_text", *(matches(k).alias(f"_m_{k}") for k in KINDS))
    rows = rows.select("id", *(f"_m_{k}" for k in KINDS), *(F.when(F.size(f"_m_{k}") > 0, F.split(text, PATTERNS[k], -1)).alias(f"_p_{k}") for k in KINDS))
    rows = with_ends(rows, KINDS)
    return rows.select("id", F.array_sort(F.concat(*(spans_of(k, model) for k in KINDS))).alias("spans"))


def redact(docs: DataFrame, model: list[int], id_col: str = "doc_id", text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """Rows (id, text): what any span covers replaced by one mark for each run of overlapping spans."""
    found = find(docs.select(F.struct(id_col, text_col).alias("_row"), F.col(text_col).alias("_body")), model, "_row", "_body")
    text = F.coalesce(F.col(f"id.{text_col}"), F.lit(""))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        piece = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(piece, F.lit(mark))).alias("out")))

    rows = found.select("id", F.aggregate("spans", begin, step).alias("d"), text.alias("t"))
    return rows.select(F.col(f"id.{id_col}").alias("id"), F.concat(F.array_join("d.out", ""), F.substring("t", (F.col("d.at") + 1).cast("int"), F.length("t"))).alias("text"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, train(labelled(docs)))
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    return found.select(F.col("id").alias("doc_id"), *map(count, BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS t FROM documents),
p AS (SELECT unnest(['assign', 'access', 'hex', 'random']) AS kind, unnest([0, 1, 2, 3]) AS rank),
a AS (SELECT '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS assign),
t AS (SELECT t FROM d WHERE doc_id IS NOT NULL AND md5(doc_id::VARCHAR) <= (SELECT MAX(k) FROM (SELECT md5(doc_id::VARCHAR) AS k FROM documents WHERE doc_id IS NOT NULL ORDER BY k LIMIT 500))),
w AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(t, (FROM a), ' ', 'g'), 'AKIA[A-Z0-9]{16,}', ' ', 'g'), '[0-9a-f]{24,}', ' ', 'g'), '[A-Za-z0-9+/_=-]+')) AS w FROM t) WHERE length(w) BETWEEN 3 AND 15),
s AS (SELECT w AS s, FALSE AS random FROM w UNION
  SELECT base64(unhex(sha256(w))), TRUE FROM w UNION SELECT md5(w), TRUE FROM w UNION
  SELECT s, TRUE FROM (SELECT unnest(regexp_extract_all(t, (FROM a), 1)) AS s FROM t) WHERE length(s) >= 6 UNION
  SELECT unnest(regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}')), TRUE FROM t UNION SELECT unnest(regexp_extract_all(t, '[0-9a-f]{24,}')), TRUE FROM t),
e AS (SELECT random, ascii(s[i]) - 43 AS c, ascii(s[i + 1]) - 43 AS n FROM (SELECT random, s, unnest(range(1, length(s))) AS i FROM s)),
n AS (SELECT c, n, SUM(random::INT) AS r, SUM((NOT random)::INT) AS o FROM e WHERE c BETWEEN 0 AND 79 AND n BETWEEN 0 AND 79 GROUP BY c, n),
g AS (SELECT a.c, b.n FROM (SELECT unnest(range(80)) AS c) a, (SELECT unnest(range(80)) AS n) b),
j AS (SELECT c, n, COALESCE(r, 0)::DOUBLE AS r, COALESCE(o, 0)::DOUBLE AS o FROM g LEFT JOIN n USING (c, n)),
f AS (SELECT c, n, r, o, SUM(r) OVER q AS rs, SUM(o) OVER q AS os, (SUM(r) OVER z + 0.5) / (SUM(r) OVER () + 40) AS ra, (SUM(o) OVER z + 0.5) / (SUM(o) OVER () + 40) AS oa FROM j WINDOW q AS (PARTITION BY c), z AS (PARTITION BY n)),
m AS (SELECT c, n, GREATEST(-3000, LEAST(3000, round(1000 * ln(((r + 20 * ra) / (rs + 20)) / ((o + 20 * oa) / (os + 20))))::INT)) AS v FROM f),
y AS (SELECT r, rank, kind, t, CASE kind WHEN 'assign' THEN (FROM a) WHEN 'access' THEN 'AKIA[A-Z0-9]{16,}' WHEN 'hex' THEN '[0-9a-f]{24,}' ELSE '[A-Za-z0-9+/_=-]{16,}' END AS q FROM d, p),
z AS (SELECT r, rank, kind, q, regexp_extract_all(t, q) AS found, string_split_regex(t, q) AS rest FROM y),
u AS (SELECT r, rank, kind, q, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS m, unnest(rest[1:len(found)]) AS b FROM z WHERE len(found) > 0),
x AS (SELECT r, rank, kind, q, m, SUM(length(m) + length(b)) OVER (PARTITION BY r, rank ORDER BY i)::BIGINT AS stop FROM u),
c AS (SELECT DISTINCT m AS s FROM x WHERE kind = 'random'),
l AS (SELECT s, SUM(v) AS ratio FROM (SELECT s, ascii(s[i]) - 43 AS c, ascii(s[i + 1]) - 43 AS n FROM (SELECT s, unnest(range(1, length(s))) AS i FROM c)) JOIN m USING (c, n) GROUP BY s),
k AS (SELECT x.r, rank, kind, kind || ':' || (stop - length(x.m)) || ':' || stop AS span, stop - length(x.m) AS start FROM x LEFT JOIN l ON x.m = l.s
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(x.m, q, 1)) >= 6 WHEN 'random' THEN regexp_matches(x.m, '[A-Za-z]') AND ratio >= 12000 AND ratio >= 500 * (length(x.m) - 1) ELSE TRUE END),
b AS (SELECT r, COUNT(*) FILTER (rank = 0) AS n_assign, COUNT(*) FILTER (rank = 1) AS n_access, COUNT(*) FILTER (rank = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM k GROUP BY r)
SELECT doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM d LEFT JOIN b USING (r)
"""
