"""Blocks of texts, and distributed questions about sets of fingerprints.

A block is a compressed run of documents written once to the shared folder, so
its content stays the same however often a task is run again. A question sends
each block's distinct fingerprints, packed by bucket, to the tasks of those
buckets, and the answer comes back by block: a fingerprint that a third of all
rows hold costs one entry a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonarium.llm import kernels as K
from resonarium.session import ship

#: Bytes of text in a block, at most, unless one text alone has more.
BLOCK_BYTES = 4_000_000
LAST = np.iinfo(np.int64).max  # stands for a null id, which comes after all others


class Block:
    """Decoded texts in order of id."""

    def __init__(self, ids, lengths, payload: bytes):
        self.ids = ids
        self.keys = np.array([LAST if x is None else x for x in ids], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))])
        self.raw = pa.decompress(payload, decompressed_size=int(self.offsets[-1]), codec="zstd", asbytes=True) if self.offsets[-1] else b""
        self.data = np.frombuffer(self.raw, np.uint8)

    def text(self, i: int) -> bytes:
        return self.raw[self.offsets[i] : self.offsets[i + 1]]


SCHEMA = "block long, ids array<long>, lengths array<long>, payload binary"


def make_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, ids, lengths, payload). Null texts are empty. Write the result before it is used twice."""
    ship(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId() << 32, 0
        for b in K.batch_slices(batches, "text", size):
            data, offsets = K.buffers(b.column(1))
            ids = b.column(0).to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            raw = data.tobytes()
            payload = pa.compress(b"".join(raw[offsets[i] : offsets[i + 1]] for i in order), codec="zstd", asbytes=True)
            lengths = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array([task + n]), pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([[int(lengths[i]) for i in order]], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["block", "ids", "lengths", "payload"],
            )
            n += 1

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def each_block(batches) -> Iterator[tuple[int, Block, list]]:
    """Yields (block number, block, further columns) of rows that begin with the columns of SCHEMA."""
    for b in batches:
        for r in range(b.num_rows):
            row = [b.column(k)[r] for k in range(b.num_columns)]
            yield row[0].as_py(), Block(row[1].as_py(), row[2].as_py(), row[3].as_py()), row[4:]


#: Bytes of fingerprints in a bucket, about, of which one task holds all.
BUCKET_BYTES = 8_000_000


def parts_for(blocks: DataFrame, fingerprint_bytes: Column) -> int:
    """Number of buckets for a question; fingerprint_bytes: how many bytes a block may send."""
    total = blocks.agg(F.sum(fingerprint_bytes).cast("long")).first()[0] or 0
    return max(4 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))


def ask(entries: Callable, blocks: DataFrame, verdict: Callable, parts: int, width: int = 8, small: bool = False) -> DataFrame:
    """Rows (block, answer[, vals]): packed fingerprints of the block for which `verdict` holds, with their values.

    entries(batches) yields each block's number with its distinct fingerprints
    and, if the question needs one, a column of int64 of the same length, and
    may add a second such pair that needs no verdict and comes back as it is.
    verdict(fingerprints, values, owners) gets all entries of a bucket in order
    of fingerprint and gives a mask. Buckets are as many as `parts`; one holds
    the share 1/parts of all blocks' distinct fingerprints. width: how many low
    bytes of a fingerprint are sent; the others are zero. small: values are sent in
    as few bytes as the largest of a bucket needs, instead of being compressed.
    """
    names = ["bucket", "block", "fps", "vals", "sure"]
    packed, unpacked = (narrowed, widest) if small else (deflated, inflated)

    def send(batches):
        for number, found, *sure in entries(batches):
            fps = found[0]
            bucket = (K.mixed(fps) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)  # short numbers are sorted by radix
            order = np.argsort(bucket, kind="stable")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=parts))])
            keep = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
            narrow = fps[order].view(np.uint8).reshape(-1, 8)[:, :width]
            cols = [[narrow[cuts[k] : cuts[k + 1]].tobytes() for k in keep]]
            if len(found) == 2:
                values = found[1][order]
                cols.append([packed(values[cuts[k] : cuts[k + 1]]) for k in keep])
            else:
                cols.append([None] * len(keep))
            flags = [False] * len(keep)
            if sure and len(sure[0][0]):
                keep, flags = [*keep, number % parts], [*flags, True]
                cols[0].append(sure[0][0].view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
                cols[1].append(packed(sure[0][1]))
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([number] * len(keep), pa.int64()), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(flags)], names=names)

    def reply(table: pa.Table) -> pa.Table:
        sure = table.filter(table.column("sure"))
        table = table.filter(pa.compute.invert(table.column("sure")))
        numbers = np.asarray(table.column("block"))
        each = [widened(x, width) for x in table.column("fps").to_pylist()]
        sizes = np.array([len(x) for x in each], np.int64)
        fps = np.concatenate([np.zeros(0, np.uint64), *each])
        vals = table.column("vals").to_pylist()
        values = np.concatenate([unpacked(x, n) for x, n in zip(vals, sizes.tolist())]) if vals and vals[0] is not None else None
        owner = np.repeat(np.arange(len(each)), sizes)
        order = np.argsort(fps)
        fps, owner = fps[order], owner[order]
        values = None if values is None else values[order]
        yes = verdict(fps, values, owner)
        fps, owner, values = fps[yes], owner[yes], None if values is None else values[yes]
        order = np.argsort(owner, kind="stable")
        fps, cuts = fps[order], np.searchsorted(owner[order], np.arange(len(each) + 1))
        keep = np.flatnonzero(cuts[1:] > cuts[:-1])
        cols = [numbers[keep].tolist() + sure.column("block").to_pylist(), [fps[cuts[k] : cuts[k + 1]].tobytes() for k in keep] + [widened(x, width).tobytes() for x in sure.column("fps").to_pylist()]]
        if values is None:
            cols.append([None] * len(cols[0]))
        else:
            values = values[order]
            cols.append([packed(values[cuts[k] : cuts[k + 1]]) for k in keep] + sure.column("vals").to_pylist())
        return pa.table({"block": pa.array(cols[0], pa.int64()), "answer": pa.array(cols[1], pa.binary()), "vals": pa.array(cols[2], pa.binary())})

    sent = blocks.mapInArrow(send, "bucket int, block long, fps binary, vals binary, sure boolean")
    return sent.groupBy("bucket").applyInArrow(reply, "block long, answer binary, vals binary")


def deflated(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)  # values of one block lie close together


def inflated(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd", asbytes=True), np.int64)


def narrowed(values: np.ndarray) -> bytes:
    """int64 values in as few low bytes as all of them need; the first byte is their number."""
    width = 8 if len(values) and values.min() < 0 else max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widest(packed: bytes, n: int) -> np.ndarray:
    """What `narrowed` was given."""
    return widened(packed[1:], packed[0]).view(np.int64)


def widened(packed: bytes, width: int) -> np.ndarray:
    """Fingerprints of which the low `width` bytes are given."""
    out = np.zeros((len(packed) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def answered(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks (saved by block) with the list of their answers, one for each bucket that has any."""
    return blocks.join(answers.groupBy("block").agg(F.collect_list("answer").alias("answers")), "block", "left")


def unpack(answers) -> np.ndarray:
    """Sorted fingerprints of an `answers` cell."""
    got = answers.as_py() if answers is not None else None
    return np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in got])) if got else np.zeros(0, np.uint64)


def among(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x
