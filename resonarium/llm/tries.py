"""Prefix tries of conversations: which openings are shared, by how many, and what sharing them saves.

A conversation is the sequence of its turns (role, text), of which only digests
and lengths travel. Equal sequences are added up first. Sequences are dealt by
the digest of their first turn, and each bucket's tries are built from pointer
dictionaries inside applyInPandas, with totals taken from the leaves upwards in
a loop (children are made after their parents, so going through the nodes
backwards is a postorder; nothing recurses).

An opening that holds too many turns for one task is taken out before: its
stem, the turns that all its sequences go on with, becomes rows of its own, and
the sequences are dealt again by the turn after the stem. That is repeated until
every subtrie fits. A stem is the common beginning of a group's least and
greatest sequence, so a chain of any length takes one round. What the subtries
and deeper stems add up to goes back up to the stems by sums.

Members that end at a node are listed in order of id for their digest: ids are
gathered in ranges of SPAN, and one task reads a node's ranges one after the
other, holding one at a time.

Limits: the digests and lengths of one conversation (40 bytes a turn) must fit a
task. Turns are the same where 128 bits of the SHA-256 of role and text are.

Defined results: rows without a conv_id belong to no conversation; null role or
text is empty; turns are ordered by number, null first, and those of one number
by the digest of role and text; repeated rows are turns of their own; an empty
table has no nodes, not even a root; further columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonarium.session import Scratch, ship

#: Hexadecimal digits of a digest.
DIGITS = 32
#: Ids in a range, at most.
SPAN = 4096
#: Turns of a subtrie, at most: a share of all turns for each task, but never more than the second nor less than the first.
FEWEST, MOST = 500, 200_000
#: Stems up to which their table is broadcast; beyond, it goes to each of SALTS shares of the sequences.
BROADCAST_STEMS, SALTS = 10_000, 64
NOBODY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def digest(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, DIGITS)


def sequences(conversations: DataFrame, home: Column) -> DataFrame:
    """Rows (home, conv_id, turns): turns are structs (turn, digest, size) in order. home: what conversations are dealt by."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn"), digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    rows = conversations.where("conv_id IS NOT NULL").select(home.alias("home"), "conv_id", turn.alias("turn"))
    return rows.repartition("home").groupBy("home", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def plain(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turns) of the conversations as they are."""
    return sequences(conversations, F.col("conv_id")).select("conv_id", "turns")


def grafted(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Rows (conv_id, turns): each conversation's first h turns replaced by those of its family's first, h = crc32(conv_id) mod `most`.

    The family's first is conv_id - conv_id % family; where it is missing or
    shorter there is less to put in, but the h turns go all the same.
    """
    rows = sequences(conversations, F.col("conv_id") - F.col("conv_id") % family)
    first = F.max(F.when(F.col("conv_id") == F.col("home"), F.col("turns"))).alias("first")
    rows = rows.groupBy("home").agg(F.collect_list(F.struct("conv_id", "turns")).alias("members"), first)  # fewer than 2 x family
    rows = rows.select("first", F.inline("members"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    given = F.when(F.col("first").isNotNull(), F.slice("first", F.lit(1), h)).otherwise(F.slice("turns", F.lit(1), F.lit(0)))
    return rows.select("conv_id", F.concat(given, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def members(paths: DataFrame) -> DataFrame:
    """Rows (end, n, least, sha): of each whole sequence its number of conversations, the least id, and the digest of all ids."""
    ranges = paths.groupBy("end", F.floor(F.col("conv_id") / SPAN).alias("range")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    ranges = ranges.select("end", "range", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("least"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def read(frames):
        import pandas as pd

        now, out = None, []

        def done():
            out.append((now, n, least, state.hexdigest()))

        for frame in frames:
            for end, count, low, ids in zip(frame["end"], frame["n"], frame["least"], frame["ids"]):
                if end != now:
                    if now is not None:
                        done()
                    now, n, least, state = end, 0, low, hashlib.sha256()
                else:
                    state.update(b",")
                n += count
                state.update(ids.encode())
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["end", "n", "least", "sha"])
                out.clear()
        if now is not None:
            done()
        yield pd.DataFrame(out, columns=["end", "n", "least", "sha"])

    return ranges.repartition("end").sortWithinPartitions("end", "range").mapInPandas(read, "end string, n long, least long, sha string")


def build(frame):
    """Nodes of the subtries of a bucket's sequences, tops marked with what they hang on."""
    import pandas as pd

    children, depth, size, count, least, sha, parent, hung, over = [], [], [], [], [], [], [], [], []

    def node(at_depth, bytes_in, above, on=None, over_id=None) -> int:
        for a, x in zip((children, depth, size, count, least, sha, parent, hung, over), ({}, at_depth, bytes_in, 0, None, NOBODY, above, on, over_id)):
            a.append(x)
        return len(depth) - 1

    tops: dict = {}
    for key, first, path, sizes, n, low, ends, on, over_id in frame[["key", "depth", "path", "sizes", "n", "least", "sha", "parent_key", "parent_id"]].itertuples(index=False):
        at = tops.get(key)
        if at is None:
            at = tops[key] = node(first, int(sizes[first - 1]), -1, on, over_id)
        for k in range(first, len(path) + 1):
            if k > first:
                below = children[at].get(path[k - 1])
                if below is None:
                    below = children[at][path[k - 1]] = node(k, int(sizes[k - 1]), at)
                at = below
            count[at] += n
            least[at] = low if least[at] is None else min(least[at], low)
        sha[at] = ends
    leaves, saved = [0] * len(depth), [0] * len(depth)
    for i in reversed(range(len(depth))):
        leaves[i] = leaves[i] or 1
        saved[i] += (count[i] - 1) * size[i]
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    above = [least[p] if p >= 0 else o for p, o in zip(parent, over)]
    return pd.DataFrame({"conv_id": least, "depth": depth, "parent_conv_id": above, "n_convs": count, "n_children": list(map(len, children)), "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": sha, "hangs_on": hung})


def stems(frames):
    """Each stem's nodes, from the totals of what hangs on its last."""
    import numpy as np
    import pandas as pd

    for frame in frames:
        for r in frame.itertuples(index=False):
            sizes, n = np.asarray(r.sizes, np.int64), len(r.sizes)
            saved = r.saved + np.cumsum(sizes[::-1] * (r.n - 1))[::-1]
            one = np.ones(n, np.int64)
            below = one.copy()
            below[-1] = r.children
            yield pd.DataFrame(
                {"conv_id": one * r.least, "depth": np.arange(r.depth, r.depth + n), "parent_conv_id": [r.parent_id] + [r.least] * (n - 1), "n_convs": one * r.n, "n_children": below, "n_leaves": one * r.leaves, "saved_tokens": saved, "ends_sha256": [NOBODY] * (n - 1) + [r.sha]}
            )


def attach(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows joined with a saved table by key, of which a hot one may hold most rows."""
    if table.count() <= BROADCAST_STEMS:
        return rows.join(F.broadcast(table), "key", "left")
    salt = F.pmod(F.hash("end"), F.lit(SALTS))
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(copies, ["key", "salt"], "left").drop("salt")


def trie(turns: DataFrame, fewest: int = FEWEST, most: int = MOST) -> DataFrame:
    """Rows of NODE for every distinct beginning of the conversations' turns; turns: as from plain or grafted.

    fewest, most: bounds for the number of turns that one subtrie may hold.
    """
    spark = turns.sparkSession
    ship(spark)
    scratch = Scratch(spark, "tries")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    paths = turns.select("conv_id", F.transform("turns", lambda t: t["digest"]).alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    paths = scratch.save(paths.select("*", digest(F.array_join("path", "")).alias("end")))
    every = scratch.save(paths.select("end", "path", "sizes").distinct().join(members(paths), "end"))
    whole = every.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum(F.size("path")).alias("turns"), F.max(F.when(F.size("path") == 0, F.col("sha"))).alias("sha")).first()
    if whole["n"] is None:
        return spark.createDataFrame([], NODE)
    limit = min(most, max(fewest, whole["turns"] // (4 * parts)))
    beginning = lambda d: digest(F.array_join(F.slice("path", F.lit(1), d), ""))
    rows = every.where(F.size("path") > 0).select("*", F.lit(1).cast("long").alias("depth"), F.lit("").alias("parent_key"), F.lit(whole["least"]).cast("long").alias("parent_id"))
    rows = rows.withColumn("key", beginning(F.lit(1)))
    fits, levels = [], []
    while True:
        weight = F.sum(F.size("path") - F.col("depth") + 1)
        large = scratch.save(rows.groupBy("key").agg(weight.alias("weight")).where(F.col("weight") > limit).select("key", F.lit(True).alias("large")))
        if not large.count():
            fits.append(rows)
            break
        marked = attach(rows, large)
        fits.append(marked.where("large IS NULL").drop("large"))
        hot = marked.where("large").drop("large")
        ends = lambda f: f(F.struct("path", "sizes", "sha"))
        held = hot.groupBy("key", "parent_key", "parent_id", "depth").agg(ends(F.min).alias("lo"), F.max("path").alias("hi"), F.sum("n").alias("n"), F.min("least").alias("least"))
        alike = F.zip_with("lo.path", F.slice("hi", F.lit(1), F.size("lo.path")), lambda a, b: F.coalesce(a == b, F.lit(False)))
        differ = F.array_position(alike, F.lit(False))
        held = held.withColumn("last", F.when(differ > 0, differ - 1).otherwise(F.size("lo.path")).cast("long"))
        span = (F.col("last") - F.col("depth") + 1).cast("int")
        sha = F.when(F.size("lo.path") == F.col("last"), F.col("lo.sha")).otherwise(F.lit(NOBODY))
        held = scratch.save(held.select("key", "parent_key", "parent_id", "depth", "last", F.slice("lo.sizes", F.col("depth").cast("int"), span).alias("sizes"), "n", "least", sha.alias("sha")))
        levels.append(held)
        on = held.select("key", "last", F.col("least").alias("over"))
        rows = attach(hot, on).where(F.size("path") > F.col("last"))
        rows = rows.select(*every.columns, (F.col("last") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("over").alias("parent_id"), beginning((F.col("last") + 1).cast("int")).alias("key"))
        rows = scratch.save(rows)
    small = fits[0]
    for more in fits[1:]:
        small = small.unionByName(more)
    buckets = max(parts, -(-whole["turns"] // MOST))
    small = small.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    nodes = scratch.save(small.groupBy("bucket").applyInPandas(build, NODE + ", hangs_on string"))
    up = nodes.where("hangs_on IS NOT NULL").groupBy(F.col("hangs_on").alias("key")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    up = scratch.save(up)
    out = nodes.drop("hangs_on")
    for held in reversed(levels):
        done = held.join(up, "key", "left").na.fill({"children": 0, "leaves": 1, "saved": 0})
        done = scratch.save(done)
        out = out.unionByName(done.mapInPandas(stems, NODE))
        stem = F.col("saved") + (F.col("n") - 1) * F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)
        above = done.select(F.col("parent_key").alias("key"), F.lit(1).cast("long").alias("children"), "leaves", stem.alias("saved"))
        up = scratch.save(up.unionByName(above).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved"))))
    top = up.where("key = ''").first() or {"children": 0, "leaves": 1, "saved": 0}
    root = [(whole["least"], 0, None, whole["n"], top["children"], top["leaves"], top["saved"], whole["sha"] or NOBODY)]
    return out.unionByName(spark.createDataFrame(root, NODE))


def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(grafted(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP11_SQL = r"""
WITH v AS (SELECT conv_id, turn, sha256(octet_length(encode(COALESCE(role, '')))::VARCHAR || ':' || COALESCE(role, '') || COALESCE(text, ''))[1:32] AS d, octet_length(encode(COALESCE(text, ''))) AS b FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list({'d': d, 'b': b} ORDER BY turn NULLS FIRST, d) AS own FROM v GROUP BY conv_id),
c AS (SELECT conv_id, own, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS crc FROM s),
h AS (SELECT conv_id, own, xor(crc, 4294967295) % 9 AS h FROM c),
r AS (SELECT h.conv_id, list_concat(COALESCE(f.own, [])[1:h], h.own[h + 1:]) AS turns FROM h LEFT JOIN s f ON f.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, depth, len(turns) AS whole, md5(array_to_string(list_transform(turns[1:depth], lambda t: t.d), '')) AS id, md5(array_to_string(list_transform(turns[1:depth - 1], lambda t: t.d), '')) AS above, COALESCE(turns[depth].b, 0) AS b
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r)),
n AS (SELECT depth, id, MIN(above) AS above, MIN(b) AS b, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, sha256(COALESCE(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = whole), '')) AS ends_sha256 FROM p GROUP BY depth, id),
k AS (SELECT above, depth - 1 AS depth, COUNT(*) AS n_children FROM n WHERE depth > 0 GROUP BY above, depth),
m AS (SELECT n.*, COALESCE(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.above = n.id AND k.depth = n.depth),
t AS (SELECT p.depth, p.id, SUM((n_children = 0)::INT) AS n_leaves, SUM((n_convs - 1) * m.b) AS saved_tokens FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.depth, p.id)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN t USING (depth, id) LEFT JOIN n u ON u.id = m.above AND u.depth = m.depth - 1
"""
