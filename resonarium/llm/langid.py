"""Language ID by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams (n = 1 to 3 over
letters in lower case, words bounded by one blank) in all labelled training
texts. A document's own most frequent n-grams are compared with each profile:
an n-gram adds the difference of its two ranks, or the profile's length where
the profile lacks it. The language of least distance wins.

Every whole text is read, for training and for prediction. Profiles hold
`profile` entries for each language, so what reaches the driver is bounded by
the number of labels alone. Defined results: `und` with score 0 where the text
is null or has no letter, or nothing could be learned; equal distances go to
the language that comes first by code point; the score is 1 - distance /
(profile x n-grams of the document); rows with a null doc_id are never trained
on and are not held out; repeated rows give repeated rows; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resonarium.llm import kernels as K
from resonarium.session import ship

PROFILE = 400
SLICE_BYTES = 500_000
_TABLES: dict[str, np.ndarray] = {}
UNI, BI = np.int64(0x1FFFFF), np.int64(0x1FFFFE)  # above all code points: mark the shorter n-grams


def letter_table() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    if "low" not in _TABLES:
        low = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                x = s.lower()
                low[c] = ord(x) if len(x) == 1 else c
        _TABLES["low"] = low
    return _TABLES["low"]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cps = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return cps, heads[offsets]


class Sequence:
    """Letters of many texts as small numbers, each word between zeros; text numbers alongside."""

    def __init__(self, column):
        cps, offsets = code_points(*K.buffers(column))
        low = letter_table()[cps]
        at = np.flatnonzero(low)
        self.texts = len(offsets) - 1
        doc = np.searchsorted(offsets, at, side="right") - 1
        self.has_letter = np.zeros(self.texts, bool)
        self.has_letter[doc] = True
        self.alphabet, symbol = np.unique(low[at], return_inverse=True)
        if not len(at):
            self.seq, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
        new_word = new_doc | np.concatenate([[True], at[1:] != at[:-1] + 1])
        place = np.arange(len(at)) + np.cumsum(new_word) + np.cumsum(new_doc) - 1
        self.seq = np.zeros(place[-1] + 2, np.int64)
        self.seq[place] = symbol + 1
        self.doc = np.zeros(len(self.seq), np.int64)
        # a text's part runs from the blank before its first word to the blank after its last
        begin = place[new_doc] - 1
        self.doc = np.repeat(doc[new_doc], np.diff(np.concatenate([begin, [len(self.seq)]])))

    def bits(self) -> int:
        return max(1, int(len(self.alphabet)).bit_length())

    def grams(self, group: np.ndarray) -> np.ndarray:
        """Sortable numbers of all n-grams, with group[text] in the high bits."""
        s, d, b = self.seq, self.doc, self.bits()
        g = group[d] << np.int64(3 * b + 2)
        uni = (g + (s << np.int64(2 * b)))[s > 0]
        if len(s) < 2:
            return uni
        same = d[1:] == d[:-1]
        two = (s[:-1] << np.int64(2 * b)) + (s[1:] << np.int64(b))
        bi = (g[:-1] + (np.int64(1) << np.int64(3 * b)) + two)[same]
        tri = (g[:-2] + (np.int64(2) << np.int64(3 * b)) + two[:-1] + s[2:])[same[:-1] & same[1:] & (s[1:-1] > 0)]
        return np.concatenate([uni, bi, tri])

    def named(self, gram: np.ndarray) -> np.ndarray:
        """Group-free n-gram numbers as code points, which are alike in all batches."""
        b = self.bits()
        letters = np.concatenate([[0], self.alphabet]).astype(np.int64)
        m = np.int64((1 << b) - 1)
        kind = gram >> np.int64(3 * b) & np.int64(3)
        x, y, z = (letters[gram >> np.int64(k * b) & m] for k in (2, 1, 0))
        third = np.where(kind == 2, z, np.where(kind == 1, BI, UNI))
        return (x << np.int64(42)) + (np.where(kind == 0, 0, y) << np.int64(21)) + third


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = np.sort(grams)
    head = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[head], np.diff(np.concatenate([head, [len(grams)]]))


def fits(batch, column: int):
    """Halves a batch until text numbers and n-grams fit into 62 bits together."""
    s = Sequence(batch.column(column))
    if batch.num_rows > 1 and 3 * s.bits() + 2 + int(batch.num_rows).bit_length() > 62:
        half = batch.num_rows // 2
        yield from fits(batch.slice(0, half), column)
        yield from fits(batch.slice(half), column)
    else:
        yield batch, s


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE) -> dict[str, list[int]]:
    """Each label's n-grams from the most frequent on, equal counts by code points."""
    ship(docs.sparkSession)

    def run(batches):
        total: dict[str, dict] = {}

        def rows():
            for lang, parts in total.items():
                grams, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                uniq, inverse = np.unique(grams, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(uniq)), pa.array(uniq), pa.array(np.bincount(inverse, counts).astype(np.int64))], names=["lang", "gram", "n"])

        held = 0
        for whole in K.batch_slices(batches, "text", SLICE_BYTES):
            for b, s in fits(whole, 0):
                labels = b.column(1).dictionary_encode()
                names = labels.dictionary.to_pylist()
                grams, counts = counted(s.grams(labels.indices.to_numpy(zero_copy_only=False).astype(np.int64)))
                shift = np.int64(3 * s.bits() + 2)
                group = grams >> shift
                plain = s.named(grams & ((np.int64(1) << shift) - np.int64(1)))
                for k in np.unique(group):
                    total.setdefault(names[k], []).append((plain[group == k], counts[group == k]))
                held += len(grams)
                if held > 1_000_000:
                    yield from rows()
                    total, held = {}, 0
        yield from rows()

    texts = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = texts.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= profile)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in ranked.select("lang", "gram", "rank").collect():
        out.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {k: [g for _, g in sorted(v)] for k, v in sorted(out.items())}


def predict(docs: DataFrame, learned: dict[str, list[int]], text_col: str = "text", profile: int = PROFILE, names_out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score added, under names that docs must not have yet."""
    ship(docs.sparkSession)
    names = sorted(learned)
    known = np.unique(np.array([g for v in learned.values() for g in v], np.int64))
    rank = np.full((len(names), len(known)), -1, np.int64)
    for k, name in enumerate(names):
        grams = np.array(learned[name], np.int64)
        rank[k, np.searchsorted(known, grams)] = np.arange(len(grams))
    schema = docs.select(F.col(text_col).alias("text"), "*").schema

    def judged(s: Sequence) -> tuple[list[str], np.ndarray]:
        label, score = np.zeros(s.texts, np.int64), np.zeros(s.texts)
        grams, counts = counted(s.grams(np.arange(s.texts, dtype=np.int64)))
        if not len(grams) or not names:
            return ["und"] * s.texts, score
        shift = np.int64(3 * s.bits() + 2)
        doc = grams >> shift
        order = np.argsort((doc << np.int64(40)) - np.minimum(counts, 2**39), kind="stable")
        doc = doc[order]
        head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        place = np.arange(len(doc)) - np.repeat(head, np.diff(np.concatenate([head, [len(doc)]])))
        top = place < profile
        doc, place, grams = doc[top], place[top], grams[order][top]
        plain = s.named(grams & ((np.int64(1) << shift) - np.int64(1)))
        k = np.searchsorted(known, plain)
        k[k == len(known)] = 0
        hit = known[k] == plain
        head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        size = np.diff(np.concatenate([head, [len(doc)]]))
        far = np.empty((len(names), len(head)), np.int64)
        for i in range(len(names)):
            r = rank[i][k]
            far[i] = np.add.reduceat(np.where(hit & (r >= 0), np.abs(r - place), profile), head)
        best = far.argmin(0)
        label[doc[head]] = best
        score[doc[head]] = np.clip(1 - far[best, np.arange(len(head))] / (size * profile), 0, 1)
        return [names[x] if y else "und" for x, y in zip(label.tolist(), s.has_letter.tolist())], score

    def run(batches):
        for whole in K.batch_slices(batches, "text", SLICE_BYTES):
            for b, s in fits(whole, 0):
                label, score = judged(s)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(label, pa.string()), pa.array(score)], names=[*b.schema.names[1:], "lang_pred", "score"])

    rows = docs.select(F.col(text_col).alias("text"), *(docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)))
    out = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(schema.fields[1:])) + ", lang_pred string, score double"
    return rows.mapInArrow(run, out).toDF(*docs.columns, *names_out)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """The fixed quarter that is never trained on; false for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE) -> DataFrame:
    """Rows (id, held_out, lang_pred, score): learned on what is not held out, predicted for all."""
    train = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col))
    learned = profiles(train, text_col, lang_col, profile)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("body"))
    return without_body(rows, learned, profile)


def without_body(rows: DataFrame, learned: dict[str, list[int]], profile: int) -> DataFrame:
    return predict(rows, learned, "body", profile).drop("body")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
