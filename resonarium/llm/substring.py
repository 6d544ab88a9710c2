"""Substring dedup: difference-cover anchors find long matches, windows decide.

Positions p of a text with p mod 13 in {0, 1, 3, 9} are cover positions: for any
two alignments exactly one of 13 successive shifts puts both on a cover
position. So two equal windows of `window` words share an anchor of
window - 12 words that begins at a cover position of either. Only anchors
are exchanged at first (4 of 13 positions); the matches are then extended:
windows that hold a repeated anchor are compared whole.

A window repeats if its word sequence also starts earlier (smaller id, or the
same row at an earlier word). Every word of a repeating window is removed.

Defined results: a null text has no words; a null id comes after all others;
rows of equal id are not earlier than one another, so each keeps its first
occurrence; texts shorter than a window lose nothing; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonarium.llm import kernels as K
from resonarium.llm.blocks import BLOCK_BYTES, Block, among, answered, ask, each_block, make_blocks, parts_for, unpack
from resonarium.session import Scratch

PERIOD, COVER = 13, (0, 1, 3, 9)
IN_COVER = np.isin(np.arange(PERIOD), COVER)


class Parsed:
    """Words of a block and the fingerprints of its windows and anchors."""

    def __init__(self, block: Block, window: int):
        self.block, self.window = block, window
        self.starts, self.ends, self.first = K.word_bounds(block.data, block.offsets)
        self.codes = K.word_codes(block.data, self.starts, self.ends)
        self.n = len(self.codes)
        self.row = np.repeat(np.arange(len(block.keys)), np.diff(self.first))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the cover positions with room for an anchor, and the anchors' fingerprints."""
        size = self.window - PERIOD + 1
        ok = K.within(self.first, size, self.n)
        at = np.flatnonzero(ok)
        at = at[IN_COVER[(at - self.first[self.row[at]]) % PERIOD]]
        return at, K.window_codes(self.codes, size)[at]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(K.within(self.first, self.window, self.n))
        return at, K.window_codes(self.codes, self.window)[at]

    def candidates(self, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows that hold an anchor which another block has too, or this one twice."""
        at, fps = self.anchors()
        uniq, inverse, count = np.unique(fps, return_inverse=True, return_counts=True)
        hot = (count > 1) | among(uniq, elsewhere)
        mark = np.zeros(self.n + PERIOD + 1, np.int32)
        mark[at[hot[inverse]]] = 1
        sums = np.concatenate([[0], np.cumsum(mark)])
        at, fps = self.windows()
        held = sums[at + PERIOD] > sums[at]
        return at[held], fps[held]


def anchors_asked(window: int):
    def entries(batches):
        for number, block, _ in each_block(batches):
            yield number, [np.unique(Parsed(block, window).anchors()[1])]

    return entries


def windows_asked(window: int):
    def entries(batches):
        for number, block, more in each_block(batches):
            p = Parsed(block, window)
            at, fps = p.candidates(unpack(more[0]))
            uniq, first = np.unique(fps, return_index=True)  # the first is the one of least id, as texts are in that order
            yield number, [uniq, block.keys[p.row[at[first]]]]

    return entries


def shared(fps: np.ndarray, values, owners: np.ndarray) -> np.ndarray:
    same = fps[1:] == fps[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(fps) else np.zeros(0, bool)


def later(fps: np.ndarray, values: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Entries whose fingerprint has a smaller id somewhere."""
    if not len(fps):
        return np.zeros(0, bool)
    head = np.concatenate([[True], fps[1:] != fps[:-1]])
    least = np.minimum.reduceat(values, np.flatnonzero(head))
    return values > least[np.cumsum(head) - 1]


def removed_words(block: Block, window: int, elsewhere: np.ndarray) -> tuple[Parsed, np.ndarray]:
    """Which words of a block go. elsewhere: windows that start under a smaller id in another block."""
    p = Parsed(block, window)
    at, fps = p.windows()
    gone = among(fps, elsewhere)
    order = np.lexsort((np.arange(len(fps)), fps))
    if len(order):
        f, row, key = fps[order], p.row[at[order]], block.keys[p.row[at[order]]]
        head = np.concatenate([[True], f[1:] != f[:-1]])
        least = key[np.flatnonzero(head)][np.cumsum(head) - 1]
        again = np.concatenate([[False], (f[1:] == f[:-1]) & (row[1:] == row[:-1])])
        gone[order] |= (key > least) | again
    return p, K.spread(at[gone], window, p.n)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, block_bytes: int = BLOCK_BYTES, with_text: bool = True) -> DataFrame:
    """Rows (id, n_words, n_removed, kept_sha256[, text]) for every row of docs; text: kept words joined by one space."""
    if window < PERIOD + 1:
        raise ValueError(f"a window has {PERIOD + 1} words at least")
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "substring")
    blocks = scratch.save_by(make_blocks(docs, id_col, text_col, block_bytes), "block")
    parts = parts_for(blocks, F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))  # a word of five letters and a blank sends 8 bytes at most with one of its windows
    repeated = scratch.save(ask(anchors_asked(window), blocks, shared, parts))
    earlier = scratch.save(ask(windows_asked(window), answered(blocks, repeated), later, parts))
    scratch.drop(repeated)

    def run(batches):
        for _, block, more in each_block(batches):
            p, gone = removed_words(block, window, unpack(more[0]))
            n, out = np.diff(p.first), []
            n_gone = np.diff(np.concatenate([[0], np.cumsum(gone)])[p.first]) if p.n else n * 0
            for i in range(len(n)):
                words = block.text(i).split()
                if n_gone[i]:
                    words = compress(words, (~gone[p.first[i] : p.first[i + 1]]).tolist())
                out.append(b" ".join(words))
            cols = [pa.array(block.ids, pa.int64()), pa.array(n, pa.int64()), pa.array(n_gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in out])]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array([x.decode() for x in out])], [*names, "text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return answered(blocks, earlier).mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).withColumnRenamed("id", "doc_id")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
n AS (SELECT doc_id, i.i AS i, array_to_string(w[i.i:i.i + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) i(i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM n),
g AS (SELECT DISTINCT doc_id, i + j.range AS p FROM r CROSS JOIN range(20) j WHERE nth > 1),
t AS (SELECT d.doc_id, p.p AS p, w[p.p] AS word FROM d, unnest(range(1, len(w) + 1)) p(p)),
k AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.p) AS kept, COUNT(*) AS n FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.p = t.p WHERE g.p IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - COALESCE(k.n, 0))::BIGINT AS n_removed, sha256(COALESCE(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
