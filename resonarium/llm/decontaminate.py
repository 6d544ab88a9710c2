"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each shard (a run of whole documents)
stores, for every term of its texts, the sorted positions where it stands. It is
written once and may be searched many times. A search takes the terms' counts
over all shards, orders each phrase's terms from the rarest, and in every shard
intersects their position lists, each adjusted by its offset in the phrase.
Queries go to all shards in slices of bounded size, so a benchmark of any size
is broadcast piece by piece.

Words are runs of [0-9a-z] and of all characters beyond ASCII, after A-Z are
lower-cased. Defined results: a null text has no words; a null item_id is
searched and counted but named by the empty string; repeated items count once
each by id; rows of equal doc_id stay apart; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonarium.llm import kernels as K
from resonarium.session import Scratch, ship

SHARD_BYTES = 2_000_000
WINDOW = 13
#: Bytes of benchmark text searched for in one pass over the index, at most; larger benchmarks take several passes.
#: What is sent to tasks holds 13 terms of 8 bytes for each window, some 35 MB for this many bytes.
SLICE_BYTES = 1_000_000

BETWEEN = np.ones(256, bool)
BETWEEN[0x30:0x3A] = BETWEEN[0x61:0x7B] = False
BETWEEN[0x80:] = False


def terms_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Term fingerprints of all words of a text column, and the index of each text's first."""
    data, offsets = K.buffers(column)
    data = K.lower_ascii(data)
    starts, ends, first = K.word_bounds(data, offsets, BETWEEN)
    return K.word_codes(data, starts, ends), first


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHARD_BYTES) -> DataFrame:
    """Index shards: rows (ids, first, terms, counts, positions).

    first: where each document begins in the shard's positions; terms: sorted
    distinct term fingerprints with their counts; positions: for each term in
    turn its ascending positions, packed. Write the result before it is searched.
    """
    ship(docs.sparkSession)

    def run(batches):
        for b in K.batch_slices(batches, "text", size):
            codes, first = terms_of(b.column(1))
            order = np.argsort(codes, kind="stable").astype(np.uint32)
            terms, counts = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([first.astype(np.uint32).tobytes()], pa.binary()), pa.array([terms.tobytes()], pa.binary()), pa.array([counts.astype(np.uint32).tobytes()], pa.binary()), pa.array([order.tobytes()], pa.binary())],
                names=["ids", "first", "terms", "counts", "positions"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "ids array<long>, first binary, terms binary, counts binary, positions binary")


class Shard:
    def __init__(self, ids, first, terms, counts, positions):
        self.ids = ids
        self.first = np.frombuffer(first, np.uint32).astype(np.int64)
        self.terms = np.frombuffer(terms, np.uint64)
        self.counts = np.frombuffer(counts, np.uint32).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.counts)])
        self.positions = np.frombuffer(positions, np.uint32).astype(np.int64)
        self.n = len(self.positions)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of terms in this shard, -1 where it lacks them."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        k = np.searchsorted(self.terms, terms)
        k[k == len(self.terms)] = 0
        return np.where(self.terms[k] == terms, k, -1)

    def lists(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all terms `which`, one list after another, and for each the index into `which`."""
        sizes = self.counts[which]
        owner = np.repeat(np.arange(len(which)), sizes)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.positions[self.at[which][owner] + inner], owner

    def keyed(self) -> np.ndarray:
        """All postings as one ascending array of term number and position."""
        if not hasattr(self, "_keyed"):
            self._keyed = np.repeat(np.arange(len(self.terms)), self.counts) * np.int64(2**32) + self.positions
        return self._keyed

    def holds(self, which: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether term which[i] stands at positions[i]."""
        keys, x = self.keyed(), which * np.int64(2**32) + positions
        k = np.searchsorted(keys, x)
        k[k == len(keys)] = 0
        return (positions >= 0) & (keys[k] == x)

    def doc(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, side="right") - 1


def shards_of(batches):
    for b in batches:
        for r in range(b.num_rows):
            yield Shard(b.column(0)[r].as_py(), *(b.column(k)[r].as_py() for k in range(1, 5)))


INDEX_COLUMNS = ["ids", "first", "terms", "counts", "positions"]


def term_counts(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Occurrences of each of `terms` over the whole index; as many numbers come back as terms were asked for."""
    asked = np.unique(terms)

    def run(batches):
        total = np.zeros(len(asked), np.int64)
        for b in batches:
            for r in range(b.num_rows):
                have, n = np.frombuffer(b.column(0)[r].as_py(), np.uint64), np.frombuffer(b.column(1)[r].as_py(), np.uint32)
                _, i, j = np.intersect1d(asked, have, assume_unique=True, return_indices=True)
                total[i] += n[j]
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], names=["k", "n"])

    rows = index.select("terms", "counts").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return {int(asked[r["k"]]): r["n"] for r in rows.toLocalIterator()}


@dataclass
class Phrases:
    """Phrases of one length: terms (phrases x length), the item of each, and terms' offsets from the rarest on."""

    terms: np.ndarray
    items: np.ndarray
    order: np.ndarray


def plan(codes: list[np.ndarray], window: int, counts: dict[int, int] | None) -> list[Phrases]:
    """Distinct windows of all items, grouped by length; items shorter than a window are one phrase."""
    groups: dict[int, dict[bytes, set[int]]] = {}
    for k, c in enumerate(codes):
        size = min(window, len(c))
        for i in range(len(c) - size + 1 if size else 0):
            groups.setdefault(size, {}).setdefault(c[i : i + size].tobytes(), set()).add(k)
    out = []
    for size, found in sorted(groups.items()):
        rows = [(np.frombuffer(x, np.uint64), k) for x, ks in found.items() for k in sorted(ks)]
        terms = np.stack([x for x, _ in rows])
        freq = np.array([[counts.get(int(t), 0) for t in x] for x in terms]) if counts is not None else np.zeros(terms.shape)
        out.append(Phrases(terms, np.array([k for _, k in rows]), np.argsort(freq, axis=1, kind="stable")))
    return out


def phrase_starts(shard: Shard, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Every occurrence in a shard: phrase number and position of its first word."""
    size = p.terms.shape[1]
    which = shard.find(p.terms.ravel()).reshape(p.terms.shape)
    alive = np.flatnonzero((which >= 0).all(1))
    if not len(alive):
        return alive, alive
    rare = p.order[alive, 0]
    at, owner = shard.lists(which[alive, rare])
    phrase, start = alive[owner], at - rare[owner]
    for step in range(1, size):
        if not len(phrase):
            break
        offset = p.order[phrase, step]
        ok = shard.holds(which[phrase, offset], start + offset)
        phrase, start = phrase[ok], start[ok]
    ok = (start >= 0) & (shard.doc(start) == shard.doc(start + size - 1))
    return phrase[ok], start[ok]


def near_matches(shard: Shard, terms: np.ndarray, span: int) -> np.ndarray:
    """Positions of the first of `terms` round which all others stand within `span` words of the same document."""
    which = shard.find(terms)
    if not len(which) or (which < 0).any():
        return np.zeros(0, np.int64)
    at, _ = shard.lists(which[:1])
    for k in which[1:]:
        other, _ = shard.lists(np.array([k]))
        i = np.searchsorted(other, at - span)
        doc = shard.doc(at)
        low = np.maximum(at - span, shard.first[doc])
        i = np.searchsorted(other, low)
        nearest = other[np.minimum(i, len(other) - 1)]
        at = at[(i < len(other)) & (nearest <= at + span) & (nearest < shard.first[doc + 1])]
    return at


def proximity(index: DataFrame, queries: list[str], span: int) -> DataFrame:
    """Rows (query, id, position): where all words of a query stand within `span` words of its rarest.

    The rarest word is that of fewest occurrences in the whole index, of equal
    ones the first in the query, so matches don't depend on the shards.
    """
    codes = [terms_of(pa.array([q]))[0] for q in queries]
    counts = term_counts(index, np.concatenate(codes)) if codes else {}
    codes = [np.array(sorted(dict.fromkeys(c.tolist()), key=lambda t: counts.get(t, 0)), np.uint64) for c in codes]

    def run(batches):
        for s in shards_of(batches):
            for k, c in enumerate(codes):
                at = near_matches(s, c, span)
                if len(at):
                    doc = s.doc(at)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int32()), pa.array([s.ids[d] for d in doc], pa.int64()), pa.array(at - s.first[doc])], names=["query", "id", "position"])

    return index.select(*INDEX_COLUMNS).mapInArrow(run, "query int, id long, position long")


def phrases(index: DataFrame, queries: list[str]) -> DataFrame:
    """Rows (query, id, position): exact occurrences of whole queries (word for word)."""
    codes = [terms_of(pa.array([q]))[0] for q in queries]
    counts = term_counts(index, np.concatenate(codes)) if codes else {}
    groups = plan(codes, max([1, *map(len, codes)]), counts)

    def run(batches):
        for s in shards_of(batches):
            for p in groups:
                k, at = phrase_starts(s, p)
                if len(at):
                    doc = s.doc(at)
                    yield pa.RecordBatch.from_arrays([pa.array(p.items[k], pa.int32()), pa.array([s.ids[d] for d in doc], pa.int64()), pa.array(at - s.first[doc])], names=["query", "id", "position"])

    return index.select(*INDEX_COLUMNS).mapInArrow(run, "query int, id long, position long")


def benchmark_slices(bench: DataFrame, id_col: str, text_col: str, size: int):
    """Yields lists of (item id as text, terms), each of texts of at most `size` bytes."""
    now, used = [], 0
    for r in bench.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        text = r["text"] or ""
        if now and used + len(text) > size:
            yield now
            now, used = [], 0
        now.append((r["id"] or "", terms_of(pa.array([text]))[0]))
        used += len(text)
    yield now


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows (id, n_words, n_hit, n_items, items_sha256, contaminated, items), one for each row of docs.

    A word is hit if it lies in an occurrence of any window of any item. With a
    benchmark of several slices the hits of a document are united over them.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "index")
    index = scratch.save(build_index(docs, id_col, text_col).withColumn("shard", F.monotonically_increasing_id()))
    found = []
    for items in benchmark_slices(bench, item_id, item_text, slice_bytes):
        codes = [c for _, c in items]
        counts = term_counts(index, np.concatenate([np.zeros(0, np.uint64), *codes]))
        found.append(search(index, [k for k, _ in items], plan(codes, window, counts)))
    if len(found) == 1:
        merged = found[0].drop("shard")
    else:
        united = found[0]
        for more in found[1:]:
            united = united.unionByName(more)
        merged = (
            united.groupBy("shard", "row")
            .agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
            .drop("shard")
        )
    n_hit = F.aggregate("ranges", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(r["s"], s["end"]))).alias("n"), F.greatest(s["end"], r["e"]).alias("end")))["n"]
    out = merged.withColumn("ranges", F.array_sort("hits")).withColumn("items", F.array_sort("items")).withColumn("n_hit", n_hit)
    return out.select(
        "id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items"
    )


def search(index: DataFrame, names: list[str], groups: list[Phrases]) -> DataFrame:
    """Rows (shard, row, id, n_words, hits, items): merged ranges of hit words and the items that occur."""
    names_at = np.array(names, object)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                s = Shard(b.column(1)[r].as_py(), *(b.column(k)[r].as_py() for k in range(2, 6)))
                n = len(s.ids)
                hits, items = [[] for _ in range(n)], [[] for _ in range(n)]
                got = [(p.items[k], at, np.full(len(at), p.terms.shape[1])) for p in groups for k, at in [phrase_starts(s, p)] if len(at)]
                if got:
                    item, at, size = (np.concatenate(x) for x in zip(*got))
                    doc = s.doc(at)
                    for d, k in np.unique(np.stack([doc, item], 1), axis=0):
                        items[d].append(names_at[k])
                    mark = np.zeros(s.n + 1, np.int64)
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + size, -1)
                    hit = np.cumsum(mark[:-1]) > 0
                    step = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
                    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                    cuts = s.first[(s.first > 0) & (s.first < s.n)]
                    cuts = np.unique(cuts[hit[cuts] & hit[cuts - 1]])  # ranges that touch across two documents
                    begin, end = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([end, cuts]))
                    for x, y, d in zip(begin.tolist(), end.tolist(), s.doc(begin).tolist()):
                        hits[d].append({"s": x - int(s.first[d]), "e": y - int(s.first[d])})
                shard = b.column(0)[r].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(s.ids, pa.int64()), pa.array(np.diff(s.first)), pa.array(hits, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))],
                    names=["shard", "row", "id", "n_words", "hits", "items"],
                )

    return index.select("shard", *INDEX_COLUMNS).mapInArrow(run, "shard long, row int, id long, n_words long, hits array<struct<s:long,e:long>>, items array<string>")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("items").withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
s AS (SELECT *, LEAST(13, len(w)) AS size FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id::VARCHAR AS item, size, array_to_string(w[i.i:i.i + size - 1], ' ') AS k FROM s, unnest(range(1, len(w) - size + 2)) i(i)),
n AS (SELECT doc_id, z.size AS size, i.i AS i, array_to_string(w[i.i:i.i + z.size - 1], ' ') AS k FROM d JOIN (SELECT DISTINCT size FROM q) z ON len(w) >= z.size, unnest(range(1, len(w) - z.size + 2)) i(i)),
m AS (SELECT n.doc_id, n.i, n.size, q.item FROM n JOIN q ON q.k = n.k AND q.size = n.size),
h AS (SELECT doc_id, COUNT(DISTINCT p.p) AS n_hit FROM m, unnest(range(i, i + size)) p(p) GROUP BY doc_id),
t AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, COALESCE(h.n_hit, 0)::BIGINT AS n_hit, COALESCE(t.n_items, 0)::BIGINT AS n_items, sha256(COALESCE(t.items, '')) AS items_sha256,
  COALESCE(h.n_hit, 0) > 0 AND 20 * COALESCE(h.n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
