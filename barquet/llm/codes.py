"""Compression of vectors to codes: each part of a vector becomes the number of the nearest entry of its codebook.

Components are taken as whole numbers, so every distance, mean and sum is exact and no order of the rows matters. A
round of training is one pass over the vectors: tasks find the nearest entries and send, for each codebook entry, the sums
of the parts that it is nearest to; the new codebooks, whose size is fixed, go back to the tasks.

The nearest entry is searched in a vantage-point tree over the entries of a part position. A node holds one entry;
the others are the nearer and the farther half by their distance from it, each with the least and the largest of
these distances. By the triangle inequality a half can only hold an entry as near as the best so far if the part's own
distance from the vantage point is within that best of the half's range. Square roots are rounded so that a half is never left out
wrongly, halves that may hold an equally near entry are visited too, and what is visited is compared by whole squared
distances, ties to the lower number. All parts of a batch go through the tree together, as sets of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet.session import scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LABELS = 10_000  #: distinct labels at most whose sums are broadcast
SALTS = 64  #: shares that rows of a label are dealt into beyond that
SAFE = 1 << 27  #: components below this keep squared distances of parts of up to 64 components within 64 bits
ROUNDING = 1e-15  #: share by which square roots are moved to the safe side
LARGEST = 1 << 600  #: squared distances from here on count as without bound in the tree
CHUNK = 16384  #: rows of a batch that are in arrays at a time


def finite(vector: Column) -> Column:
    """The components as doubles; null unless all are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: x.cast("double")))


@dataclass
class Node:
    """An entry of a codebook, and the halves of the others by distance from it: (least, largest distance, node), rounded apart."""

    entry: int
    halves: list[tuple[float, float, Node]]


def _squared(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    off = rows - entry
    return (off * off).sum(axis=1)


def _root(squared: np.ndarray, up: bool) -> np.ndarray:
    """Square roots as floats that are never too large, or never too small, by more than a rounding error of a later sum."""
    margin = 1 + (ROUNDING if up else -ROUNDING)
    if squared.dtype == object:
        return np.array([(isqrt(x) + up) * margin if x < LARGEST else (np.inf if up else LARGEST**0.5 * margin) for x in squared.tolist()], np.float64)
    return np.sqrt(squared.astype(np.float64)) * margin


def tree(entries: np.ndarray, numbers: list[int] | None = None) -> Node:
    """The vantage-point tree over these entries; equal entries may stand in either half."""
    numbers = list(range(len(entries))) if numbers is None else numbers
    vantage, rest = numbers[0], numbers[1:]
    if not rest:
        return Node(vantage, [])
    far = _squared(entries[rest], entries[vantage])
    order = sorted(range(len(rest)), key=lambda k: (far[k], rest[k]))
    middle = (len(order) + 1) // 2
    halves = []
    for half in (order[:middle], order[middle:]):
        if half:
            bounds = far[half]
            halves.append((float(_root(bounds, False).min()), float(_root(bounds, True).max()), tree(entries, [rest[k] for k in half])))
    return Node(vantage, halves)


def nearest(rows: np.ndarray, entries: np.ndarray, root: Node | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its nearest entry, ties to the lower one, and the squared distance."""
    if rows.dtype != entries.dtype:  # whole numbers beyond 64 bits on one side
        rows, entries = rows.astype(object), entries.astype(object)
    best = np.full(len(rows), -1, np.int64)
    least = np.zeros(len(rows), rows.dtype)
    reach = np.full(len(rows), np.inf)  # no less than the distance of the best

    def visit(node: Node, at: np.ndarray) -> None:
        d = _squared(rows[at], entries[node.entry])
        better = (best[at] < 0) | (d < least[at]) | ((d == least[at]) & (node.entry < best[at]))
        won = at[better]
        best[won], least[won] = node.entry, d[better]
        reach[won] = _root(d[better], True)
        if not node.halves:
            return
        low, high = _root(d, False), _root(d, True)
        # the half whose range is nearer first, so that the other is often out of reach by then
        gaps = [np.maximum(np.maximum(low - b, a - high), 0.0) for a, b, _ in node.halves]
        first = np.zeros(len(at), np.int64) if len(gaps) == 1 else (gaps[1] < gaps[0]).astype(np.int64)
        for turn in range(len(gaps)):
            for k, (_, _, child) in enumerate(node.halves):
                asked = ((first + turn) % len(gaps) == k) & (gaps[k] <= reach[at])
                if asked.any():
                    visit(child, at[asked])

    if len(rows):
        visit(root or tree(entries), np.arange(len(rows)))
    return best, least


def _numbers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: 64-bit numbers, or Python's where these don't suffice."""
    with np.errstate(over="ignore"):
        scaled = np.floor(flat.astype(np.float64) * scale)
    if not len(scaled) or np.abs(scaled).max() < SAFE:
        return scaled.astype(np.int64)
    each = [int(y) if np.isfinite(y) else int(x) * scale for x, y in zip(flat.tolist(), scaled.tolist(), strict=True)]
    out = np.empty(len(each), object)
    out[:] = each
    return out


def _vectors(batch: pa.RecordBatch, width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a batch, which of them have a vector of this width, and those vectors."""
    for a in range(0, len(batch), CHUNK):
        part = batch.slice(a, CHUNK)
        lists = part["__vector"]
        usable = (lists.value_lengths().fill_null(-1).to_numpy() == width) if len(part) else np.zeros(0, bool)
        flat = lists.filter(pa.array(usable)).flatten().to_numpy()
        yield part, usable, _numbers(flat, scale).reshape(int(usable.sum()), width)


def _parts(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
    width = vectors.shape[1] // parts
    return [np.ascontiguousarray(vectors[:, k * width : (k + 1) * width]) for k in range(parts)]


@dataclass(frozen=True)
class Codebooks:
    """Entries (whole numbers) by part and number."""

    books: tuple[tuple[tuple[int, ...], ...], ...]
    scale: int = SCALE

    @property
    def width(self) -> int:
        return sum(len(b[0]) for b in self.books)

    def arrays(self) -> list[np.ndarray]:
        small = all(abs(x) < SAFE for b in self.books for e in b for x in e)
        return [np.array(b, np.int64 if small else object).reshape(len(b), -1) for b in self.books]

    def sha256(self) -> str:
        """Of all components in decimal: by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(str(x) for b in self.books for e in b for x in e).encode()).hexdigest()


def _sums(books: Codebooks):
    """Number and componentwise sums of the parts that each entry is nearest to, one row for each entry and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = books.arrays()
        trees = [tree(b) for b in arrays]
        counts = [np.zeros(len(b), np.int64) for b in arrays]
        sums = [np.zeros(b.shape, object) for b in arrays]
        for batch in batches:
            for _, _, vectors in _vectors(batch, books.width, books.scale):
                for k, rows in enumerate(_parts(vectors, len(arrays))):
                    own, _ = nearest(rows, arrays[k], trees[k])
                    counts[k] += np.bincount(own, minlength=len(arrays[k]))
                    for entry in np.unique(own).tolist():
                        sums[k][entry] = sums[k][entry] + rows[own == entry].sum(axis=0).astype(object)
        used = [(k, e) for k, c in enumerate(counts) for e in np.flatnonzero(c).tolist()]
        text = [[str(x) for x in sums[k][e]] for k, e in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([int(counts[k][e]) for k, e in used], pa.int64()), pa.array(text, pa.list_(pa.string()))], ["part", "entry", "n", "sums"]
        )

    return run


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks for ``rows`` (``id``, ``vector``): the vectors of the smallest ids, then ``rounds`` of assigning every
    part to its nearest entry and moving each entry to the componentwise floor of the mean of its parts.

    None if there is no vector. The driver holds the codebooks, whose size ``entries`` and the vectors' width fix.
    """
    first = rows.select("id", finite(F.col("vector")).alias("v")).where("v is not null and id is not null").orderBy("id", "v").limit(entries).collect()
    width = len(first[0].v) if first else 0
    if not first or width % parts:
        return None
    seeds = [r.v for r in first if len(r.v) == width]
    step = width // parts
    start = _numbers(np.array(seeds, np.float64).ravel(), scale).reshape(len(seeds), width).tolist()
    books = Codebooks(tuple(tuple(tuple(int(x) for x in v[k * step : (k + 1) * step]) for v in start) for k in range(parts)), scale)
    source = rows.select(finite(F.col("vector")).alias("__vector")).where("__vector is not null")
    for _ in range(rounds if step else 0):
        told = source.mapInArrow(_sums(books), "part int, entry int, n long, sums array<string>")
        total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(step)]
        found = {(r.part, r.entry): r for r in told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect()}
        moved = lambda k, e, old: tuple(int(found[k, e][f"s{i}"]) // found[k, e].n for i in range(step)) if (k, e) in found else old  # noqa: E731, B023
        books = Codebooks(tuple(tuple(moved(k, e, old) for e, old in enumerate(book)) for k, book in enumerate(books.books)), scale)
    return books


def encode(rows: DataFrame, books: Codebooks | None) -> DataFrame:
    """The columns of ``rows`` but ``vector``, and ``code`` (entries in order of the parts, two hex digits each) and
    ``error`` (long: squared distances from the entries, summed). Rows without a vector that fits have neither."""
    keep = [c for c in rows.columns if c not in ("vector", "code", "error")]
    source = rows.select(*(F.col(f"`{c}`") for c in keep), finite(F.col("vector")).alias("__vector"))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if books is None:
        return source.drop("__vector").withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = books.arrays()
        trees = [tree(b) for b in arrays]
        for batch in batches:
            for part, usable, vectors in _vectors(batch, books.width, books.scale):
                found = [nearest(x, arrays[k], trees[k]) for k, x in enumerate(_parts(vectors, len(arrays)))]
                digits = np.stack([own for own, _ in found], axis=1) if found else np.zeros((len(vectors), 0), np.int64)
                error = sum(d for _, d in found)
                code, off = np.full(len(part), None, object), np.full(len(part), None, object)
                code[usable] = [bytes(x).hex() for x in digits.astype(np.uint8).tolist()]
                off[usable] = [int(x) if x < 1 << 63 else None for x in error.tolist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(code, pa.string()), pa.array(off, pa.int64())], schema.names)

    return source.mapInArrow(run, schema)


def with_group_sums(rows: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of equal ``group``, nulls together.

    Sums are made before the shuffle. A bounded number of groups is broadcast; beyond it the rows of a group are dealt
    into shares, each of which meets the group's sum, so that no task gets all rows of a large group.
    """
    sums = rows.groupBy(group).agg(F.sum(value).alias(out)).withColumnRenamed(group, "__group")
    if sums.count() <= LABELS:
        return rows.join(F.broadcast(sums), F.col(group).eqNullSafe(F.col("__group")), "left").drop("__group")
    salted = rows.withColumn("__salt", F.floor(F.rand(1) * SALTS).cast("int"))
    spread = sums.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__salt") == F.col("__share")), "left").drop("__group", "__salt", "__share")


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every row whose vector is one of finite numbers.

    Defined cases: vectors that are null or hold null, NaN or infinite components are left out; vectors of another length
    than that of the smallest id, or all if that doesn't divide into the parts, have no code and error; rows with a null
    id are coded but not started from; of equal ids the vectors are started from in their own order; with fewer rows than
    ``entries`` the codebooks are as small; repeated rows count each time; an error beyond a long is null.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each part")
    fine = finite(F.col(f"`{vector}`")).isNotNull()
    usable = rows.where(fine).select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").alias("label"))
    books = train(usable, parts, entries, rounds, scale)
    spark = rows.sparkSession
    place = scratch(spark)
    encode(usable, books).write.parquet(place)
    coded = spark.read.parquet(place)
    told = F.lit(books.sha256() if books else None).cast("string")
    return with_group_sums(coded, "label", "error", "label_error").select(F.col("id").alias(vec_id), "code", "error", "label_error", told.alias("codebooks_sha256"))
