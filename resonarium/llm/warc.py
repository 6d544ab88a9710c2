"""WARC not-modified revisits: as-of join to the latest earlier full response.

Records of one canonical URL are cut into `SLICES` slices of time, at quantiles
of all records' times, so that an outlier does not put the others into one; a time
that many records share is cut by record id as well. Within a slice a window finds the latest earlier response; across slices a second
window runs over one row a slice. So a URL that holds a third of all records is
spread over many tasks, and bodies take part only in the last join, by record.

A revisit is checked against the response it falls on: entity tags (weak
comparison) if both have one, else last-modified dates if both have one, else
payload digests if both have one. Its permitted header fields replace those of
the response.

Defined results (status): `resolved`; `unverified` where no validator is on
both sides (resolved all the same); `mismatch` where the validator differs
(no body); `unresolved` where no earlier response exists or the URL or time is
null. Earlier means a smaller time, or an equal time and a smaller record id, null
first; a response without an id is found like any other and gives its body.
Repeated records give repeated rows; of responses alike in time and id the one
of the greatest digest counts, and of those alike in digest too the least body;
further columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICES = 1024
#: Parts of a time that many records share.
TIES = 256
#: Header fields that a not-modified answer may update (RFC 9110, 15.4.5, with last-modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query fields that only track a visitor.
TRACKING = "^(utm_[^=]*|gclid|fbclid|ref|sessionid|phpsessid)(=|$)"
_HEAD = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"


def canonical(url: Column) -> Column:
    """host/path?query: scheme, user, www, default port, fragment and tracking fields gone, host in lower case, query fields sorted."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(u, _HEAD + "(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(u, _HEAD + "[^/?]*([^?]*)", 1), "/+$", "")
    fields = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING)))
    query = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise("")
    return F.when(u.rlike(_HEAD), F.concat(host, path, query)).otherwise(u)


def weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def time_cuts(records: DataFrame, slices: int) -> list[int]:
    """Quantiles of the times: as many numbers as slices, whatever the records."""
    at = [k / slices for k in range(1, slices)]
    return (records.agg(F.percentile_approx("ts", at, 10 * slices).alias("cuts")).first()["cuts"] or []) if at else []


def _numbers(values: list[int]) -> Column:
    """Whole numbers as one constant; a thousand literals would take the planner seconds and the driver memory."""
    return F.from_json(F.lit(json.dumps(values)), "array<long>")


def sliced(df: DataFrame, cuts: list[int]) -> DataFrame:
    """df with slice: how many of the ascending `cuts` are at most ts, by halving.

    Slices follow the order of (ts, record_id). A time that fills several cuts is
    the first of its slice and is cut on by the quantiles of its record ids.
    """
    shared = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    ids = None
    if shared:
        at = [k / TIES for k in range(1, TIES)]
        ids = df.where(F.col("ts").isin(shared)).agg(F.percentile_approx("record_id", at, 10 * TIES).alias("cuts")).first()["cuts"]
    known, steps = _numbers(cuts), F.array(*(F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)))
    place = F.aggregate(steps, F.lit(0), lambda s, k: s + F.when(F.get(known, s + k - 1) <= F.col("ts"), k).otherwise(0)) if cuts else F.lit(0)
    df = df.withColumn("slice", F.coalesce(place, F.lit(0)))
    if ids:
        below = F.size(F.filter(_numbers(ids), lambda c: c <= F.col("record_id")))
        part = F.when(F.col("ts").isin(shared), F.when(F.col("record_id").isNull(), 0).otherwise(below)).otherwise(TIES)
        df = df.withColumn("slice", F.col("slice") * (TIES + 1) + part)
    return df


def resolve(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """Resolves the revisits among `records`.

    records: record_id long, kind ('response' or 'revisit'), url, ts long, headers
    map<string,string> with names in lower case, digest string, body string.
    Returns (record_id, url_key, target_id, status, headers, body) for each revisit.
    """
    seen = records.select("record_id", "kind", "ts", "digest", "headers", canonical(F.col("url")).alias("url_key"))
    seen = sliced(seen, time_cuts(records, slices))
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    told = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "digest", "headers"))
    timed = seen.where(usable).withColumn("full", told)
    lasts = timed.where("kind = 'response'").groupBy("url_key", "slice").agg(F.max_by("full", F.struct("ts", "record_id", "digest")).alias("last"))
    # one row a slice that has any record: the response before it
    slots = timed.groupBy("url_key", "slice").agg(F.lit(1).alias("one")).join(lasts, ["url_key", "slice"], "left")
    earlier = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("url_key", "slice", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    inside = Window.partitionBy("url_key", "slice").orderBy("ts", "record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    near = timed.withColumn("near", F.last("full", ignorenulls=True).over(inside)).where("kind = 'revisit'")
    met = near.join(carried, ["url_key", "slice"]).withColumn("found", F.coalesce("near", "carried"))
    lost = seen.where(~usable & (F.col("kind") == "revisit")).withColumn("found", F.lit(None).cast(met.schema["found"].dataType))
    columns = ["record_id", "url_key", "digest", "headers", "found"]
    rows = met.select(*columns).unionByName(lost.select(*columns))
    old, new = F.col("found.headers"), F.col("headers")
    pairs = [(weak(new["etag"]), weak(old["etag"])), (new["last-modified"], old["last-modified"]), (F.col("digest"), F.col("found.digest"))]
    checked = F.lit("unverified")
    for a, b in reversed(pairs):
        checked = F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "resolved").otherwise("mismatch")).otherwise(checked)
    status = F.when(F.col("found").isNull(), "unresolved").otherwise(checked)
    update = F.map_filter(F.coalesce(new, F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(update, k)), update)
    rows = rows.withColumn("status", status).withColumn("good", F.col("status").isin("resolved", "unverified"))
    # a body is found by all that tells its response from others; rows that take none have keys of their own, so that they are not all dealt to one task
    whose = lambda url, r, none: F.struct(url.alias("url"), F.coalesce(r("ts"), F.lit(0)).alias("ts"), r("record_id").isNull().alias("anonymous"), F.coalesce(r("record_id"), F.lit(0)).alias("id"), r("digest").isNull().alias("plain"), F.coalesce(r("digest"), F.lit("")).alias("digest"), F.lit(none).alias("none"))
    url = F.coalesce("url_key", F.lit(""))
    own = whose(url, lambda c: F.lit(None).cast("long") if c == "ts" else F.col(c), True)
    rows = rows.select("record_id", "url_key", F.col("found.record_id").alias("target_id"), "status", F.when(F.col("good"), merged).alias("headers"), F.when(F.col("good"), whose(url, lambda c: F.col(f"found.{c}"), False)).otherwise(own).alias("_key"))
    bodies = records.where("kind = 'response' AND url IS NOT NULL AND ts IS NOT NULL").select(whose(canonical(F.col("url")), F.col, False).alias("_key"), "body")
    bodies = bodies.groupBy("_key").agg(F.min("body").alias("body"))
    return rows.join(bodies, "_key", "left").drop("_key")


#: Time from a page's capture to its later revisit, and from an early revisit to the capture.
LATER, BEFORE = 5_000, 1_000_000_000


def captures(pages: DataFrame) -> DataFrame:
    """Records as a crawler would keep them, made of `pages`.

    Each page is a full response at time page_id. By page_id modulo 3 a later
    not-modified answer follows that names its entity tag (0) or its digest only
    (1), or one stands before everything else (2). Rows with a null page_id give
    no record.
    """
    kept = pages.where(F.col("page_id").isNotNull())
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    full_headers = F.create_map(
        F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("date"), F.col("page_id").cast("string"), F.lit("cache-control"), F.lit("max-age=60")
    )
    full = kept.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", F.col("page_id").alias("ts"), full_headers.alias("headers"), digest.alias("digest"), F.coalesce("html", F.lit("")).alias("body"))
    case = F.pmod(F.col("page_id"), F.lit(3))
    ts = F.when(case == 2, F.col("page_id") - BEFORE).otherwise(F.col("page_id") + LATER)
    plain = F.create_map(F.lit("date"), ts.cast("string"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-length"), F.lit("0"))
    headers = F.when(case == 1, plain).otherwise(F.map_concat(plain, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag))))
    again = kept.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"), ts.alias("ts"), headers.alias("headers"), digest.alias("digest"), F.lit(None).cast("string").alias("body"))
    return full.unionByName(again)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";")
    return found.select("record_id", "url_key", "target_id", "status", lines.alias("headers"), F.sha2("body", 256).alias("body_sha256"), F.length("body").cast("long").alias("body_chars"))


OP10_SQL = r"""
WITH p AS (SELECT page_id, url, COALESCE(html, '') AS html, sha256(COALESCE(html, '')) AS digest FROM pages WHERE page_id IS NOT NULL),
u AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u0 FROM p),
v AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(u0, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|ref|sessionid|phpsessid)(=|$)'))) AS f FROM u),
c AS (SELECT *, CASE WHEN regexp_matches(u0, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//') THEN
  regexp_replace(regexp_replace(lower(regexp_extract(u0, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)$', ''), '^www[0-9]*\.', '')
  || regexp_replace(regexp_extract(u0, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*([^?]*)', 1), '/+$', '')
  || CASE WHEN len(f) > 0 THEN '?' || array_to_string(f, '&') ELSE '' END ELSE u0 END AS url_key FROM v),
r AS (SELECT *, CASE WHEN page_id % 3 = 2 THEN page_id - 1000000000 ELSE page_id + 5000 END AS ts FROM c),
m AS (SELECT r.*, (SELECT max(x.page_id) FROM c x WHERE x.url_key = r.url_key AND x.page_id < r.ts) AS target FROM r),
j AS (SELECT m.*, t.digest AS t_digest, t.html AS t_html,
  CASE WHEN target IS NULL THEN 'unresolved' WHEN CASE WHEN m.page_id % 3 = 1 THEN m.digest = t.digest ELSE substr(m.digest, 1, 16) = substr(t.digest, 1, 16) END THEN 'resolved' ELSE 'mismatch' END AS status
  FROM m LEFT JOIN p t ON t.page_id = m.target)
SELECT page_id * 2 + 1 AS record_id, url_key, target * 2 AS target_id, status,
  CASE WHEN status = 'resolved' THEN 'cache-control=max-age=600;content-length=' || strlen(t_html)::VARCHAR || ';content-type=text/html;date=' || ts::VARCHAR || ';etag='
    || CASE WHEN page_id % 3 = 1 THEN '' ELSE 'W/' END || '"' || substr(t_digest, 1, 16) || '"' END AS headers,
  CASE WHEN status = 'resolved' THEN t_digest END AS body_sha256, CASE WHEN status = 'resolved' THEN length(t_html) END::BIGINT AS body_chars
FROM j
"""
