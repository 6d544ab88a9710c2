"""Line dedup: fuzzy lines by MinHash, exact Jaccard, distributed components.

Lines are compared trimmed of blanks and in lower case. Equal lines are one
line from the start. Similarity is the Jaccard measure of the sets of
five-character shingles, and the same shingles make the sketch: one hash of
each shingle deals them to 192 bins, the least of a bin is its MinHash, and an
empty bin borrows that of another bin chosen by a fixed rule, which both lines
of a pair follow. Six MinHashes make a band; lines that agree in one of 32
bands are candidates. At similarity s a band agrees with probability s**6, so
at 0.8 a pair is missed with probability 6e-5. Candidates are confirmed by
their exact similarity, links are closed by star contraction, and of each
component only the first line stays (smallest doc_id, null last, then line
number).

The texts are read once, into blocks: the distinct lines of a run of documents,
written to the shared folder. Of the blocks that hold a line one answers for it
and asks which of its bands different lines share; only those become rows, and a
band that a third of all lines have costs one entry a block. Each candidate is first confirmed against one likely
partner: the most frequent line of a bucket or the next in order of size. After
that all pairs of a bucket that lie in different components are compared,
whatever its size. Those of a bucket of at most `few` lines become rows; a pair
is spared the exact measure only where the numbers of shingles rule a link out,
or where more of 192 bits, one of each MinHash, differ than happens to a pair at
the threshold with probability 1e-9. Larger buckets are dealt over cells of
about `cell` lines and CELL_CHARS characters a side, whose exact measures come
from shingle counts of the whole cell at once; only a forest of a cell's links
leaves it, so a family of n lines gives rows in proportion to n.

Defined results: blank lines stay; a null text is one blank line; a line of
fewer than five characters is a single shingle; rows alike in id and text are
one document and get the same result; further columns are ignored. Lines are
told apart by 64-bit XXH3: n distinct lines hold two that are taken for one
with probability n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resonarium.llm import kernels as K
from resonarium.llm.blocks import LAST, ask, parts_for, widest
from resonarium.llm.graph import components
from resonarium.session import Scratch, ship

SIMILARITY, SHINGLE, CELL = 0.8, 5, 2048
#: Lines of a bucket whose pairs become rows; characters of a side of a cell.
FEW_LINES, CELL_CHARS = 24, 1_000_000
#: Pairs of lines that share a shingle: counted one by one up to so many a shingle (fewer in small cells), by matrix product beyond, in so many columns, pairs or rows at once.
LISTED, COLUMNS, LISTED_AT_ONCE, ROWS = 1 << 14, 1024, 1 << 20, 256
WIDTH, BANDS = 6, 32
BINS = WIDTH * BANDS
#: Lines of fewer shingles borrow so many MinHashes that their bits are few independent ones; FEW_APART of them may differ.
FEW, FEW_APART = 64, 84
SLICE_BYTES = 2_000_000
#: Distinct lines and characters that are sketched at once, and characters that are hashed at once, whose arrays stay in a core's cache.
SKETCH_LINES, SKETCH_CHARS, HASHED_CHARS = 1 << 18, 1 << 21, 1 << 17
#: Characters of pairs that are confirmed at once.
CONFIRMED_CHARS = 1 << 18
#: Up to so many filled bins, a line's empty bins are filled by order of the filled ones, beyond turn by turn.
SPARSE = 64
#: An empty bin; MinHashes have 44 bits.
NONE = np.int64(1 << 44)
#: Bytes of a band's key that are kept.
KEY_BYTES = 5

_RNG = np.random.Generator(np.random.PCG64(20240311))
_ODD = _RNG.integers(0, 2**63, SHINGLE + WIDTH + BINS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE, BAND, BORROW = _ODD[:SHINGLE], _ODD[SHINGLE : SHINGLE + WIDTH], _ODD[SHINGLE + WIDTH :]


def normal(line: str) -> str:
    return line.strip(" ").lower()


def scattered(h: np.ndarray) -> np.ndarray:
    """Spreads the high bits of a sum over all bits, twice."""
    return K.mixed(K.mixed(h))


def code_points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lines one after another, each padded to a shingle at least, and their offsets."""
    sizes = np.array([max(SHINGLE, len(x)) for x in lines], np.int64)
    text = "".join(x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def across_lines(offsets: np.ndarray) -> np.ndarray:
    """Positions from which a shingle would reach into the next line."""
    return (offsets[1:-1, None] - np.arange(1, SHINGLE)).ravel()


def least_of_bins(lines: list[str], counted: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The least hash of each bin (lines x BINS, NONE where a bin is empty) and, if counted, numbers of distinct shingles."""
    cps, offsets = code_points(lines)
    x = cps.astype(np.uint64)
    n = len(x) - SHINGLE + 1
    h, one = x[:n] * PLACE[0], np.empty(n, np.uint64)
    for k in range(1, SHINGLE):
        h += np.multiply(x[k : k + n], PLACE[k], out=one)
    h = scattered(h)
    h >>= np.uint64(20)
    owner = np.repeat(np.arange(len(lines)), np.diff(offsets))[:n]
    place = (np.multiply(h, np.uint64(BINS), out=one) >> np.uint64(44)).astype(np.int64)
    place += owner * BINS
    h = h.view(np.int64)
    h[across_lines(offsets)] = NONE
    out = np.full(len(lines) * BINS, NONE, np.int64)
    np.minimum.at(out, place, h)
    if not counted:
        return out.reshape(-1, BINS), None
    keys = np.sort(((owner << 44) | h)[h != NONE])
    return out.reshape(-1, BINS), np.bincount(keys[np.concatenate([[True], keys[1:] != keys[:-1]])] >> 44, minlength=len(lines))


def minima(lines: list[str], counted: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """MinHashes (lines x BINS, all filled) and, if counted, numbers of distinct shingles."""
    each = [least_of_bins(part, counted) for part in slices(lines, HASHED_CHARS)]
    return filled(np.concatenate([x for x, _ in each])), np.concatenate([n for _, n in each]) if counted else None


def asked(turn: int) -> np.ndarray:
    """The bin that each empty bin asks in a turn, from 1."""
    return (K.mixed(BORROW * np.uint64(turn)) % np.uint64(BINS)).astype(np.int64)


@cache
def lenders() -> tuple[np.ndarray, np.ndarray]:
    """For each bin all bins in the order in which it asks them first, one bin after the other, and the place of bin b in the order of bin c, at [b, c]."""
    rows = np.arange(BINS)
    first = np.zeros((BINS, BINS), np.int64)
    turn = 0
    while not first.all():
        pick = asked(turn := turn + 1)
        first[rows, pick] = np.where(first[rows, pick] == 0, turn, first[rows, pick])
    order = first.argsort(axis=1)
    place = np.empty((BINS, BINS), np.uint8)
    place[order, rows[:, None]] = rows
    return order.ravel(), place


def filled(own: np.ndarray) -> np.ndarray:
    """Each empty bin with the MinHash of the first of its line's bins, in an order of its own, that is not empty."""
    order, place = lenders()
    out, empty = own.copy(), own == NONE
    values, n = own.ravel(), BINS - empty.sum(1)
    by_n = np.argsort(n, kind="stable")
    cuts = np.searchsorted(n[by_n], np.arange(1, SPARSE + 2))
    for k in range(1, SPARSE + 1):  # lines of k filled bins: the one that comes first in the order of each bin
        some = by_n[cuts[k - 1] : cuts[k]]
        if len(some):
            has = np.nonzero(~empty[some])[1].reshape(-1, k)
            least = place[has[:, 0]]
            for c in range(1, k):
                np.minimum(least, place[has[:, c]], out=least)
            lent = values.take(order.take(least + np.arange(BINS) * BINS) + some[:, None] * BINS)
            out[some] = np.where(empty[some], lent, own[some])
    empty &= (n > SPARSE)[:, None]
    at, turn, flat = np.flatnonzero(empty), 0, out.ravel()
    col = at % BINS
    line = at - col
    while len(at):
        got = values.take(line + asked(turn := turn + 1).take(col))
        hit, left = np.flatnonzero(got != NONE), np.flatnonzero(got == NONE)
        flat[at.take(hit)] = got.take(hit)
        at, col, line = at.take(left), col.take(left), line.take(left)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """lines x BANDS keys, of KEY_BYTES bytes each."""
    of_band = least.view(np.uint64).reshape(len(least), BANDS, WIDTH)
    keys = of_band[:, :, 0] * BAND[0]
    for k in range(1, WIDTH):
        keys += of_band[:, :, k] * BAND[k]
    keys += np.arange(BANDS, dtype=np.uint64)
    return scattered(keys) >> np.uint64(64 - 8 * KEY_BYTES)


def slices(lines: list[str], chars: int) -> Iterator[list[str]]:
    """lines by what is sketched at once: of so many characters, if one alone has not more."""
    i = 0
    while i < len(lines):
        j, used = i, 0
        while j < len(lines) and j - i < SKETCH_LINES and (j == i or used + len(lines[j]) <= chars):
            used += len(lines[j])
            j += 1
        yield lines[i:j]
        i = j


def sketched(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """runs (lines) and bits (lines x 3)."""
    runs, bits = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
    for part in slices(lines, SKETCH_CHARS):
        least, n = minima(part)
        runs.append(n)
        bits.append(np.packbits((least & 1).astype(np.uint8), axis=1).view(np.int64))
    return np.concatenate(runs), np.concatenate(bits)


def banded(lines: list[str]) -> np.ndarray:
    """Band keys, lines x BANDS."""
    return np.concatenate([np.zeros((0, BANDS), np.uint64), *(band_keys(minima(part, counted=False)[0]) for part in slices(lines, SKETCH_CHARS))])


BLOCK = "block long, ids array<long>, docs binary, counts binary, lines binary, h binary, payload binary"


def doc_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def line_blocks(docs: DataFrame, id_col: str, text_col: str, size: int = SLICE_BYTES) -> DataFrame:
    """Rows of BLOCK: for each document its id, key and number of lines, for each line its hash (0 where blank), and the distinct lines with their hashes."""
    ship(docs.sparkSession)

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId() << 32, 0
        for b in K.batch_slices(batches, "text", size):
            place: dict[str, int] = {}
            numbers, counts = [], []
            for text in b.column(1).to_pylist():
                each = [normal(x) for x in (text or "").split("\n")]
                numbers.extend([place.setdefault(x, len(place)) if x else -1 for x in each])
                counts.append(len(each))
            lines = list(place)
            h = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) or 1 for x in lines] + [0], np.uint64)
            body = "\n".join(lines).encode("utf-8", "surrogatepass")
            cells = [task + n, b.column(0).to_pylist(), b.column(2).to_numpy(zero_copy_only=False).tobytes(), np.array(counts, np.int32).tobytes(), h[np.array(numbers, np.int64)].tobytes(), h[:-1].tobytes()]
            cells.append(len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True))
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=["block", "ids", "docs", "counts", "lines", "h", "payload"])
            n += 1

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), doc_key(id_col, text_col).alias("doc")).mapInArrow(run, BLOCK)


def rows_of(batches):
    for b in batches:
        for r in range(b.num_rows):
            yield [b.column(k)[r].as_py() for k in range(b.num_columns)]


def lines_of(payload: bytes) -> list[str]:
    """The distinct lines of a block."""
    size = int.from_bytes(payload[:8], "little")
    return pa.decompress(payload[8:], decompressed_size=size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\n") if size else []


def homed(lines: DataFrame) -> DataFrame:
    """Rows (block, own): the lines that a block answers for, with how often they occur in all. lines: h, times, home."""
    return lines.groupBy(F.col("home").alias("block")).agg(F.collect_list(F.struct("h", "times")).alias("own"))  # of one block's lines


def own_lines(h: bytes, own: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a block's own lines, and how often they occur."""
    of_block = np.frombuffer(h, np.int64)
    order = np.argsort(of_block)
    return order[np.searchsorted(of_block[order], np.asarray(own.values.field(0)))], np.asarray(own.values.field(1))


def shared_bands(blocks: DataFrame, parts: int) -> DataFrame:
    """Rows (block, answer, vals): band keys that different lines have, and the numbers of the block's own lines that have them, above one other bit."""

    def entries(batches):
        for b in batches:
            for r in range(b.num_rows):
                lines = lines_of(b.column(2)[r].as_py())
                mine, _ = own_lines(b.column(1)[r].as_py(), b.column(3)[r])
                keys = banded([lines[k] for k in mine.tolist()]).ravel()
                line = np.repeat(mine, BANDS)
                order = np.argsort(keys)
                keys, line = keys[order], line[order]
                head = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
                at = np.flatnonzero(head)
                several = np.diff(np.concatenate([at, [len(keys)]])) > 1  # then the block itself has different lines of this key
                yield b.column(0)[r].as_py(), [keys[at], (line[at] << 1) | several], [keys[~head], line[~head] << 1]

    def verdict(keys, values, owners):
        if not len(keys):
            return np.zeros(0, bool)
        head = np.concatenate([[True], keys[1:] != keys[:-1]])
        at, run = np.flatnonzero(head), np.cumsum(head) - 1
        return ((np.bincount(run) > 1) | (np.maximum.reduceat(values & 1, at) > 0))[run]

    return ask(entries, blocks.select("block", "h", "payload", "own"), verdict, parts, KEY_BYTES, small=True)


MEMBER = "h long, times long, runs int, lo long, mid long, hi long, norm string, keys array<long>"


def members(blocks: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows of MEMBER: each line that shares a band with another line, with the keys of these bands."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                h, told = b.column(0)[r].as_py(), b.column(3)[r].as_py()
                lines, (mine, times) = lines_of(b.column(1)[r].as_py()), own_lines(h, b.column(2)[r])
                often = np.zeros(len(lines), np.int64)
                often[mine] = times
                keys = np.concatenate([np.frombuffer(x["answer"], np.int64) for x in told])
                line = np.concatenate([widest(x["vals"], len(x["answer"]) // 8) for x in told]) >> 1
                order = np.argsort(line, kind="stable")
                wanted, at = np.unique(line[order], return_index=True)
                texts = [lines[k] for k in wanted.tolist()]
                runs, bits = sketched(texts)
                held = pa.ListArray.from_arrays(pa.array(np.append(at, len(line)), pa.int32()), pa.array(keys[order]))
                cols = [pa.array(np.frombuffer(h, np.int64)[wanted]), pa.array(often[wanted]), pa.array(runs.astype(np.int32)), *(pa.array(bits[:, k]) for k in range(3)), pa.array(texts, pa.string()), held]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "times", "runs", "lo", "mid", "hi", "norm", "keys"])

    told = shared.groupBy("block").agg(F.collect_list(F.struct("answer", "vals")).alias("told"))
    return blocks.select("block", "h", "payload", "own").join(told, "block").select("h", "payload", "own", "told").mapInArrow(run, MEMBER)


def most_apart(similarity: float) -> int:
    """Number of bits that a pair of this similarity exceeds in differing with probability 1e-9 at most."""
    p, left = (1 - similarity) / 2, 1.0
    for m in range(BINS):
        left -= comb(BINS, m) * p**m * (1 - p) ** (BINS - m)
        if left <= 1e-9:
            return m
    return BINS


def buckets(member: DataFrame) -> DataFrame:
    """Rows (key, h, chief, prev): each line in each of its buckets, the bucket's most frequent line, and the next smaller line of it."""
    rows = member.select(F.explode("keys").alias("key"), "h", "runs", "times")
    order = Window.partitionBy("key").orderBy("runs", "h")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("key", "h", F.max(F.struct("times", "h")).over(whole)["h"].alias("chief"), F.lag("h").over(order).alias("prev"))


SKETCH = ["h", "runs", "lo", "mid", "hi"]


def bits_apart(a: str, b: str) -> Column:
    lo, mid, hi = (F.bit_count(F.col(c + a).bitwiseXOR(F.col(c + b))) for c in ("lo", "mid", "hi"))
    return lo + mid + hi


def may_reach(similarity: float, a: str, b: str) -> Column:
    """Whether the counts of shingles and the bits of sides a and b allow for the similarity."""
    apart = bits_apart(a, b)
    least, most = F.least(f"runs{a}", f"runs{b}"), F.greatest(f"runs{a}", f"runs{b}")
    return (least >= similarity * most) & (apart <= F.when(least < FEW, max(FEW_APART, most_apart(similarity))).otherwise(most_apart(similarity)))


def likely(rows: DataFrame, member: DataFrame, similarity: float) -> DataFrame:
    """One pair (a, b) for each line of a bucket: of its buckets' chiefs and its neighbours the one with most bits alike."""
    found = rows.select("h", F.explode(F.array("chief", "prev")).alias("o")).where("o is not null and o != h").distinct()
    sketch = member.select(*SKETCH)
    found = found.join(sketch.select(F.col("h").alias("o"), *(F.col(c).alias(f"{c}_o") for c in SKETCH[1:])), "o").join(sketch, "h").where(may_reach(similarity, "", "_o"))
    best = found.groupBy("h").agg(F.max_by("o", F.struct(-bits_apart("", "_o"), "o")).alias("o"))
    return best.select(F.least("h", "o").alias("a"), F.greatest("h", "o").alias("b")).distinct()


def divided(member: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, h, held, root, main) of the buckets whose lines lie in several components: how many lines the bucket holds, and its largest component. roots: node, root."""
    named = member.select("h", "keys").join(roots.withColumnRenamed("node", "h"), "h", "left")
    rows = named.select(F.explode("keys").alias("key"), "h", F.coalesce("root", "h").alias("root"))
    bucket, component = Window.partitionBy("key"), Window.partitionBy("key", "root")
    rows = rows.withColumns({"held": F.count("*").over(bucket), "low": F.min("root").over(bucket), "high": F.max("root").over(bucket)}).where("low != high")
    rows = rows.withColumn("n", F.count("*").over(component))
    return rows.select("key", "h", "held", "root", F.max(F.struct("n", "root")).over(bucket)["root"].alias("main"))


def across(mixed: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b, ra, rb) of lines of one small bucket and two components (ra, rb their roots)."""
    side = lambda n: [F.col(c).alias(f"{c}_{n}") for c in ("h", "runs", "lo", "mid", "hi", "root")]
    left = mixed.select("key", "main", *side("a"))
    right = mixed.where("root != main").select("key", *side("b"))
    both = left.join(right, "key").where("root_a != root_b and (root_a = main or h_a < h_b)")
    both = both.where(may_reach(similarity, "_a", "_b"))
    first = F.col("h_a") < F.col("h_b")
    turned = lambda c: [F.when(first, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")), F.when(first, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))]
    (a, b), (ra, rb) = turned("h"), turned("root")
    return both.select(a.alias("a"), b.alias("b"), ra.alias("ra"), rb.alias("rb")).distinct()


def shingle_codes(lines: list[str], among: int) -> tuple[np.ndarray, np.ndarray, int]:
    """All shingles of the lines: the line of each and its code, and a bound of the codes, of which `among` fit into 63 bits."""
    cps, offsets = code_points(lines)
    seen = np.zeros(int(cps.max(initial=0)) + 1, np.int64)
    seen[cps] = 1
    letters = int(seen.sum())
    symbol = (np.cumsum(seen) - 1)[cps]
    size = len(symbol) - SHINGLE + 1
    code, most = symbol[:size], letters
    for k in range(1, SHINGLE):
        if most * letters * among >= 2**63:  # many letters: number the heads anew
            known, code = np.unique(code, return_inverse=True)
            most = len(known)
        code, most = code * letters + symbol[k : k + size], most * letters
    inside = np.ones(size, bool)
    inside[across_lines(offsets)] = False
    return np.repeat(np.arange(len(lines)), np.diff(offsets))[:size][inside], code[inside], most


def once(x: np.ndarray) -> np.ndarray:
    """The different values of x in order."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def close(left: list[str], right: list[str], similarity: float) -> np.ndarray:
    """Which pairs of lines have at least this Jaccard measure, by their exact sets of shingles."""
    place: dict[str, int] = {}
    sides = [np.array([place.setdefault(x, len(place)) for x in side], np.int64) for side in (left, right)]
    of_line, code, wide = shingle_codes(list(place), max(len(place), len(left)))
    sets = once(of_line * wide + code)
    of_line = sets // wide
    shingle = sets - of_line * wide
    cuts = np.searchsorted(of_line, np.arange(len(place) + 1))
    sizes = np.diff(cuts)
    both = []
    for side in sides:  # shingles of each pair's line, under the number of the pair
        n = sizes[side]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both.append(np.repeat(np.arange(len(side)), n) * wide + shingle[np.repeat(cuts[side], n) + inner])
    both = np.sort(np.concatenate(both))
    alike = np.bincount(both[:-1][both[1:] == both[:-1]] // wide, minlength=len(left))
    return alike >= similarity * (sizes[sides[0]] + sizes[sides[1]] - alike)


def close_sides(left: list[str], right: list[str], similarity: float) -> Iterator[np.ndarray]:
    """Which of all left x right pairs have at least this Jaccard measure: what `close` says, counted shingle by shingle. Masks of ROWS lines of the left."""
    n = len(left) + len(right)
    line, code, _ = shingle_codes(left + right, n)
    sets = once(code * n + line)
    code = sets // n
    line = sets - code * n
    sizes = np.bincount(line, minlength=n)
    shingle = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]]))
    wide = int(shingle[-1]) + 1
    first = line < len(left)
    lines, kinds, counts = [line[first], line[~first] - len(left)], [shingle[first], shingle[~first]], []
    for kind in kinds:
        counts.append(np.bincount(kind, minlength=wide))
    begin = [np.cumsum(n) - n for n in counts]
    work = counts[0] * counts[1]
    alike = np.zeros((len(left), len(right)), np.int32)
    dense = np.flatnonzero(work > min(LISTED, 16 + alike.size // 256))  # one by one costs a few hundred times what a product costs for a pair
    column = np.full(wide, -1)
    column[dense] = np.arange(len(dense))
    for i in range(0, len(dense), COLUMNS):
        n, held = min(COLUMNS, len(dense) - i), []
        for k in range(2):
            col = column[kinds[k]] - i
            ok = (col >= 0) & (col < n) & (column[kinds[k]] >= 0)
            m = np.zeros((alike.shape[k], n), np.float32)
            m[lines[k][ok], col[ok]] = 1
            held.append(m)
        alike += (held[0] @ held[1].T).astype(np.int32)
    sparse = np.flatnonzero((column[kinds[0]] < 0) & (counts[1][kinds[0]] > 0))  # entries of the left whose shingle the right has
    partners = counts[1][kinds[0][sparse]]
    upto = np.cumsum(partners)
    i = 0
    while i < len(sparse):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + LISTED_AT_ONCE, side="right")))
        n = partners[i:j]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = lines[1][np.repeat(begin[1][kinds[0][sparse[i:j]]], n) + inner]
        alike += np.bincount(np.repeat(lines[0][sparse[i:j]], n) * len(right) + other, minlength=alike.size).reshape(alike.shape).astype(np.int32)
        i = j
    for i in range(0, len(left), ROWS):
        part = alike[i : i + ROWS]
        yield part >= similarity * (sizes[i : i + len(part), None] + sizes[None, len(left) :] - part)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes as the edges (a, b), one fewer for each component than it has nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(low, label[x], least)
        np.minimum.at(low, label[y], least)
        while True:
            deeper = low[low]
            if (deeper == low).all():
                break
            low = deeper
        low = low[label]
        if (low == label).all():
            moved = label != np.arange(len(nodes))
            return nodes[moved], nodes[label[moved]]
        label = low


def cells(mixed: DataFrame, texts: DataFrame, cell: int) -> DataFrame:
    """Rows (key, l, r, far, h, root, outer, norm): a large bucket's lines dealt over the cells (l, r) in which they meet.

    All lines of a bucket are dealt into the left parts l, those outside of the
    largest component (far) into right parts r of their own, mostly one, and
    meet all lines of their bucket; of two outer lines the one of the lesser
    right part is on the left. So a line of the largest component is copied for
    each right part only, however many lines its bucket holds.
    """
    sized = mixed.select("key", "h", "root", (F.col("root") != F.col("main")).alias("outer")).join(texts, "h")
    parts = lambda n, chars: F.greatest(F.ceil(F.col(n) / cell), F.ceil(F.col(chars) / CELL_CHARS)).cast("int")
    long = F.char_length("norm")
    sums = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum(long).alias("c"), F.count_if("outer").alias("no"), F.sum(F.when(F.col("outer"), long).otherwise(0)).alias("co"))
    sums = sums.select("key", parts("n", "c").alias("lefts"), parts("no", "co").alias("rights"))
    dealt = sized.join(sums, "key").withColumn("own", F.pmod(F.xxhash64("h"), "lefts").cast("int")).withColumn("at", F.pmod(F.xxhash64("h", F.lit(1)), "rights").cast("int"))
    rest = ["h", "root", "outer", "norm"]
    left = dealt.select("key", F.col("own").alias("l"), F.explode(F.sequence(F.when(F.col("outer"), F.col("at")).otherwise(0), F.col("rights") - 1)).alias("r"), F.lit(False).alias("far"), *rest)
    right = dealt.where("outer").select("key", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("l"), F.col("at").alias("r"), F.lit(True).alias("far"), *rest)
    return left.union(right)


def links_of_cells(dealt: DataFrame, similarity: float) -> DataFrame:
    """Rows (ra, rb): roots that links of the cells join, as a forest of each cell."""

    def run(table: pa.Table) -> pa.Table:
        far = np.asarray(table.column("far"))
        norm, root = table.column("norm"), np.asarray(table.column("root"))
        left, right = np.flatnonzero(~far), np.flatnonzero(far)
        a = b = np.zeros(0, np.int64)
        if len(left) and len(right):
            ra, rb = root[left], root[right]
            for k, yes in enumerate(close_sides(norm.take(pa.array(left)).to_pylist(), norm.take(pa.array(right)).to_pylist(), similarity)):
                rows = ra[k * ROWS : k * ROWS + len(yes)]
                x, y = np.nonzero(yes & (rows[:, None] != rb[None, :]))
                a, b = forest(np.concatenate([a, rows[x]]), np.concatenate([b, rb[y]]))
        return pa.table({"ra": pa.array(a, pa.int64()), "rb": pa.array(b, pa.int64())})

    n = 4 * int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = dealt.repartition(n, "key", "l", "r")  # else all cells of a bucket stay in the task that the join by key has put them in
    return spread.groupBy("key", "l", "r").applyInArrow(run, "ra long, rb long")


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: float, keep: list[str] = ("a", "b")) -> DataFrame:
    """Pairs of at least `similarity` by the Jaccard measure of all their shingles. texts: h, norm."""
    sized = lambda n: texts.select(F.col("h").alias(n), F.col("norm").alias(f"t{n}"))
    both = pairs.join(sized("a"), "a").join(sized("b"), "b").select("ta", "tb", *keep)

    def run(batches):
        for b in batches:
            left, right = b.column(0).to_pylist(), b.column(1).to_pylist()
            sizes = np.cumsum([len(x) + len(y) for x, y in zip(left, right)])
            i = 0
            while i < len(left):
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + CONFIRMED_CHARS, side="right")))
                yes = close(left[i:j], right[i:j], similarity)
                if yes.any():
                    got = b.slice(i, j - i).filter(pa.array(yes))
                    yield pa.RecordBatch.from_arrays(got.columns[2:], names=list(keep))
                i = j

    return both.mapInArrow(run, ", ".join(f"{c} long" for c in keep))


def joined(member: DataFrame, scratch: Scratch, similarity: float, cell: int, few: int) -> DataFrame:
    """Rows (node, root) of the components of all confirmed pairs. member: as MEMBER, saved by h."""
    texts = member.select("h", "norm")
    first = likely(buckets(member), member, similarity)
    roots = scratch.save(components(confirmed(first, texts, similarity), scratch))
    mixed = scratch.save(divided(member, roots))
    small = mixed.where(F.col("held") <= few).join(member.select(*SKETCH), "h")
    found = confirmed(across(small, similarity), texts, similarity, ["ra", "rb"])
    found = found.union(links_of_cells(cells(mixed.where(F.col("held") > few), texts, cell), similarity))
    upper = components(found, scratch, "ra", "rb")
    ids = roots.union(upper.join(roots.select("node"), "node", "left_anti"))  # lines that only the second step links
    moved = ids.join(upper.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return moved.select("node", F.coalesce("top", "root").alias("root"))


def places(blocks: DataFrame) -> DataFrame:
    """Rows (block, h, n, place): each line of a block with its count and first place there; place: (null id, id, doc, no)."""

    def run(batches):
        for block, ids, docs, counts, lines in rows_of(batches):
            h, counts = np.frombuffer(lines, np.int64), np.frombuffer(counts, np.int32)
            doc = np.repeat(np.arange(len(counts)), counts)
            no = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
            keys = np.array([LAST if x is None else x for x in ids], np.int64)[doc]
            null = np.array([x is None for x in ids], bool)[doc]
            name = np.frombuffer(docs, np.int64)[doc]
            order = np.lexsort((no, name, keys, null, h))
            order = order[h[order] != 0]
            if not len(order):
                continue
            s = h[order]
            head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            n, at = np.diff(np.concatenate([head, [len(s)]])), order[head]
            cols = [np.full(len(at), block), s[head], n, null[at], keys[at], name[at], no[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["block", "h", "n", "x", "id", "doc", "no"])

    rows = blocks.select("block", "ids", "docs", "counts", "lines").mapInArrow(run, "block long, h long, n long, x boolean, id long, doc long, no long")
    return rows.select("block", "h", "n", F.struct("x", "id", "doc", "no").alias("place"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, cell: int = CELL, few: int = FEW_LINES) -> DataFrame:
    """Rows (id, doc, n_lines, gone), one for each row of docs: the numbers of the lines that go; doc: xxhash64 of id and text."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "lines")
    blocks = scratch.save_by(line_blocks(docs, id_col, text_col), "block")
    found = scratch.save_by(places(blocks), "h", deal=True)
    lines = scratch.save_by(found.groupBy("h").agg(F.sum("n").alias("times"), F.min("block").alias("home")), "h")
    owned = blocks.select("block", "h", "payload").join(scratch.save_by(homed(lines), "block"), "block")
    shared = shared_bands(owned, parts_for(blocks, F.octet_length("h").cast("long") * BANDS))
    member = scratch.save_by(members(owned, shared), "h", deal=True)
    roots = joined(member, scratch, similarity, cell, few).withColumnRenamed("node", "h")
    # lines that occur twice or are linked: all places of their component but the first go
    known = lines.where("times > 1").select("h").join(roots, "h", "full").select("h", F.coalesce("root", "h").alias("root"))
    seats = scratch.save(found.select("block", "h", "place").join(known, "h"))
    least = seats.groupBy("root").agg(F.min("place").alias("first"))
    verdict = seats.select("block", "h", "root").join(least, "root").groupBy("block").agg(F.collect_list(F.struct("h", "first.id", "first.doc", "first.no")).alias("doomed"))  # of one block's lines

    def run(batches):
        for ids, docs, counts, lines, told in rows_of(batches):
            h, counts, name = np.frombuffer(lines, np.int64), np.frombuffer(counts, np.int32), np.frombuffer(docs, np.int64)
            doc = np.repeat(np.arange(len(counts)), counts)
            no = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
            gone = np.zeros(len(h), bool)
            if told:
                t = np.array(sorted((r["h"], r["id"], r["doc"], r["no"]) for r in told), np.int64)
                at = np.searchsorted(t[:, 0], h)
                at[at == len(t)] = 0
                keys = np.array([LAST if x is None else x for x in ids], np.int64)
                first = t[at]
                gone = (first[:, 0] == h) & ~((first[:, 1] == keys[doc]) & (first[:, 2] == name[doc]) & (first[:, 3] == no))
            cuts = np.searchsorted(doc[gone], np.arange(len(counts) + 1))
            offsets = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(name), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(no[gone].astype(np.int32)))], names=["id", "doc", "n_lines", "gone"]
            )

    rows = blocks.select("block", "ids", "docs", "counts", "lines").join(verdict, "block", "left")
    return rows.select("ids", "docs", "counts", "lines", "doomed").mapInArrow(run, "id long, doc long, n_lines long, gone array<int>")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with their texts rid of the lines that go; texts that lose all lines become empty, nulls stay null."""
    own = [f"c{k}" for k in range(len(docs.columns))]  # names that clash with none of ours
    named = docs.toDF(*own).select("*", doc_key(own[docs.columns.index(id_col)], text := own[docs.columns.index(text_col)]).alias("doc"))
    found = removed(docs, id_col, text_col, **how).where(F.size("gone") > 0).select("doc", "gone").dropDuplicates(["doc"])
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    rows = named.join(found, "doc", "left")
    return rows.select(*(F.when(F.col("gone").isNotNull(), kept).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in own)).toDF(*docs.columns)


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.transform("gone", lambda x: x.cast("string")), ",").alias("removed_lines"))
