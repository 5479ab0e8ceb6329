"""Blocks of texts that look up their distinct words elsewhere.

Some operators need, for each word (or word pair) of a text, something that only the whole corpus can tell. Moving
every occurrence through a shuffle would cost many times the input. Instead

1. each task cuts its rows into blocks of bounded size, takes each block's distinct keys, and sends them, dealt by
   ranges of the key's hash, one row for each block and range;
2. each range resolves the keys of all blocks together and answers each block with one row;
3. the block itself, packed, meets its answers and is finished there.

A key leaves a block once, however frequent it is, so no range is hot. There are ``FAN_OUT`` ranges at most, so a block
sends and gets a bounded number of rows, however large the input. What a task resolves at a time are buckets: a range is
one bucket, or as many even parts as it takes for a bucket to fit the task's memory. Rows are cut by these parts only
where their range is resolved; they are sorted there, and their answers are put together again, without a shuffle.

Blocks are made twice, for 1 and for 3. They are named by a hash of their content, and a block that doesn't get an
answer for each of its keys is an error, so that rows read in another order the second time can never give wrong
results: ``docs`` should be a table that is read, or a checkpoint. How Spark splits the files of a table depends on the
cores it has got so far unless ``spark.sql.files.minPartitionNum`` is set; ``plan`` sets it where it isn't, so that
executors that come or go between the two reads change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet.llm import tokens

BLOCK_BYTES = 16 << 20  #: bytes of text in a block, but for a longer single text
BUCKET_BYTES = 8 << 20  #: bytes of text for each bucket
LEAST_BUCKETS = 12
FAN_OUT = 1024  #: rows that a block sends at most
MOST_PARTITIONS = 8192
PACKED = "block long, bucket int, body binary"
ITSELF = -1  #: stands as bucket of the packed block
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


@dataclass(frozen=True)
class Plan:
    blocks: int
    ranges: int
    within: int = 1  #: buckets of a range

    @classmethod
    def of(cls, blocks: int, buckets: int) -> Plan:
        within = -(-buckets // FAN_OUT)
        return cls(blocks, -(-buckets // within), within)

    @property
    def buckets(self) -> int:
        return self.ranges * self.within

    @property
    def block_partitions(self) -> int:
        return min(2 * self.blocks, MOST_PARTITIONS)


def plan(docs: DataFrame, text: str) -> Plan:
    """Numbers of blocks and buckets for these texts."""
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long")), F.lit(0))).first()[0]
    return Plan.of(max(1, -(-size // BLOCK_BYTES)), max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)))


def cut(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a task as named blocks."""
    task = TaskContext.get()
    seed = task.partitionId() if task else 0
    held: list[pa.RecordBatch] = []
    size = serial = 0

    def block() -> tuple[int, pa.RecordBatch]:
        nonlocal serial
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        name = xxhash.xxh64(seed=seed)
        name.update(serial.to_bytes(8, "little"))
        data, at = tokens.text_bytes(whole[column])
        name.update(at.tobytes())
        name.update(np.ascontiguousarray(data))
        serial += 1
        return int(np.uint64(name.intdigest()).astype(np.int64)), whole

    for batch in batches:
        for part in tokens.slices(batch, column, BLOCK_BYTES):
            more = int(tokens.text_bytes(part[column])[1][-1])
            if held and size + more > BLOCK_BYTES:
                yield block()
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield block()


def each(batches: Iterator[pa.RecordBatch], column: str, work: Callable[[int, pa.RecordBatch], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """``work(name, block)`` for every block of a task, if it isn't None; one block at a time is in memory."""
    for name, block in cut(batches, column):
        out = work(name, block)
        del block
        if out is not None:
            yield out
        del out
        tokens.give_back()


def pack(docs: DataFrame, text: str) -> DataFrame:
    """The blocks themselves, to be joined by their answers."""

    def packed(name: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(rows)
        return rows_of([(name, ITSELF, out.getvalue().to_pybytes())], PACKED)

    return tokens.mapped(docs, lambda batches: each(batches, text, packed), PACKED)


def rows_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of the columns of a schema such as ``PACKED``."""
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, KINDS[t]) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key (64 bits): even ranges of its upper half."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def runs(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Each bucket that some of the sorted keys fall into, and where its run is among them."""
    of = bucket_of(keys, buckets)
    starts = np.flatnonzero(np.diff(of, prepend=np.uint64(buckets))) if len(of) else np.zeros(0, int)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=False):
        yield int(of[a]), slice(a, b)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys, sorted. ``np.unique`` without further results hashes them first, which takes many times as long."""
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))] if len(keys) else keys


def counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    every = joined(keys, np.uint64)
    order = np.argsort(every)
    every = every[order]
    starts = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return every[starts], np.add.reduceat(joined(counts, np.uint64).astype(np.uint64, copy=False)[order], starts)


def squeeze(numbers: np.ndarray) -> bytes:
    """Compress whole numbers by their bytes of equal weight: small ones, and gaps of sorted ones, take little."""
    planes = np.ascontiguousarray(numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def gaps(keys: np.ndarray) -> bytes:
    """Sorted keys, compressed."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def from_gaps(body: bytes) -> np.ndarray:
    return np.cumsum(expand(body), dtype=np.uint64)


def fits(right: bool) -> None:
    if not right:
        raise RuntimeError("a block and its answers don't fit: the input was read in another order")


def joined(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    """The arrays in a row, of which there may be none."""
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def within(sorted_keys: np.ndarray, of_range: int, p: Plan) -> np.ndarray:
    """Where each bucket of a range begins among its sorted keys, and where the last one ends."""
    first = of_range * p.within
    edges = np.searchsorted(bucket_of(sorted_keys, p.buckets), np.arange(first, first + p.within).astype(np.uint64))
    return np.append(edges, len(sorted_keys))


def answer(asked: DataFrame, p: Plan, split: Callable[[dict, Plan], list[dict]], resolve: Callable[[list[dict]], list[tuple]], totals: str = "") -> DataFrame:
    """``resolve(rows of a bucket, by block)`` for every bucket; one bucket at a time is in memory.

    ``asked`` has a row for each block and range that it has keys of, the range in column ``bucket``; so has the answer, of
    the columns of ``PACKED`` and long ones that are summed (``totals``). ``split`` cuts a row into those of its buckets,
    where a range has several.
    """
    schema = PACKED + totals
    columns = [c.split()[0] for c in schema.split(", ")]
    names = ", ".join(f"{c} {t}" for c, t in asked.dtypes).replace("bigint", "long")

    def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = split(row, p)
                if parts:
                    yield rows_of([tuple(x[c] for c in batch.schema.names) for x in parts], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(batches, "bucket"):
            yield rows_of(resolve(rows), schema)
            del rows
            tokens.give_back()

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(batches, "block", "range"):
            one = (rows[0]["block"], rows[0]["range"], frame([x["body"] for x in rows]))
            yield rows_of([(*one, *(sum(x[c] for x in rows) for c in columns[3:]))], schema)

    met = asked.repartition(p.ranges, "bucket")
    if p.within == 1:
        return tokens.mapped(met.sortWithinPartitions("bucket", "block"), run, schema)
    made = tokens.mapped(tokens.mapped(met, cut_rows, asked.schema).sortWithinPartitions("bucket", "block"), run, schema)
    of_range = made.withColumn("range", F.floor(F.col("bucket") / p.within).cast("int"))
    return tokens.mapped(of_range.sortWithinPartitions("block", "bucket"), put_together, schema)


def _together(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[list[dict]]:
    """Rows that stand together and are equal in these columns."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[c] != held[0][c] for c in by):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def frame(bodies: list[bytes]) -> bytes:
    """Several bodies as one."""
    return b"".join([len(bodies).to_bytes(8, "little"), np.array([len(b) for b in bodies], "<i8").tobytes(), *bodies])


def unframe(body: bytes) -> list[bytes]:
    n = int.from_bytes(body[:8], "little")
    sizes = np.frombuffer(body, "<i8", n, 8)
    stops = 8 + 8 * n + np.cumsum(sizes)
    return [body[a:b] for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True)]


def finish(
    docs: DataFrame,
    answers: DataFrame,
    text: str,
    p: Plan,
    solve: Callable[[pa.RecordBatch, list[bytes]], Iterator[pa.RecordBatch]],
    schema: T.StructType,
) -> DataFrame:
    """``solve(block, answers in the order of the buckets)`` for every block; one block at a time is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows, got = None, None, []

        def solved() -> Iterator[pa.RecordBatch]:
            if name is not None:
                fits(rows is not None)
                yield from solve(rows, got)
                tokens.give_back()

        for batch in batches:
            for block, bucket, body in zip(*(batch.column(i) for i in range(3)), strict=True):
                if block.as_py() != name:
                    yield from solved()
                    name, rows, got = block.as_py(), None, []
                if bucket.as_py() == ITSELF:
                    rows = pa.ipc.open_stream(body.as_buffer()).read_all().combine_chunks().to_batches()[0]
                else:
                    got += unframe(body.as_py()) if p.within > 1 else [body.as_py()]
        yield from solved()

    both = pack(docs, text).unionByName(answers.select("block", "bucket", "body"))
    return tokens.mapped(both.repartition(p.block_partitions, "block").sortWithinPartitions("block", "bucket"), run, schema)
