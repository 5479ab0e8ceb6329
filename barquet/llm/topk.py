"""Exact top-k search by inner product with sequential access only (no-random-access aggregation).

The inner product of a query is a sum over dimensions, and each dimension is a list of the candidates sorted by
their component: read from the top for a positive query component, from the bottom for a negative one, the entries'
shares of the score only fall. Rounds read all lists to the same growing depth. What a candidate has been seen with
gives its lower bound, together with the lists' far ends for the rest; the lists' current ends for the rest give
its upper bound. The k-th score or lower bound so far (of this block or of blocks before it) is the bar: as soon as few
candidates, and no unseen ones, have an upper bound that reaches it, their final scores are resolved and the best
are kept. Blocks are short, so that a bar is there soon, but a task's first block is read to the end, and the bounds exclude
little before the eighth: tables of two blocks are read nearly whole (the test has the shares).

The depth of a round is the same for all queries, so a block's lists are read once for all queries: the entries read so
far, with the bounds in the place of those that aren't, are a matrix for each end of the lists, and the bounds of all
pairs come from products with them.

Rows are packed into chunks, and every query block meets every candidate group in one task of bounded memory, which
streams the chunks: nothing is broadcast, and no key is hot. Each task sends k rows a query on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096  #: vectors of a packed row
LISTED = 1024  #: candidates of a block of lists
QUERIES = 65536  #: queries of a query block, at about
GROUP = 16384  #: candidates of a group at least, at about
MOST_GROUPS = 64
BATCH = 256  #: queries whose bounds are kept at a time
DEPTHS = (0.6, 0.75, 1.0)  #: share of each list that has been read after each round
RESOLVED = 64  #: final scores of a query are resolved once at most so many candidates are left
NONE = -np.inf  #: the bar of a query that has none yet
LONG = (-(1 << 63), (1 << 63) - 1)


def quantized(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, no further than a long goes; null for a vector that is null or has a null or
    non-finite component."""
    wide = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(fine, wide)


CHUNKS = "role int, part long, n int, dim int, ids binary, vectors binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (role, id, tag, vector) to chunks of one role and dimension."""
    task = TaskContext.get()
    serial = task.partitionId() if task else 0
    waiting: dict[tuple[int, int], list] = {}

    def chunk(role: int, dim: int, rows: list) -> pa.RecordBatch:
        nonlocal serial
        ids, vectors = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        top = _largest(vectors)
        small = vectors.astype(np.int8 if top < 128 else np.int16 if top < 32768 else np.int64)
        serial += 1
        values = (role, serial, len(ids), dim, np.ascontiguousarray(ids.T).tobytes(), bytes([small.itemsize]) + small.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["role", "part", "n", "dim", "ids", "vectors"])

    for batch in batches:
        roles, lists = batch["role"].to_numpy(), batch["vector"]
        ids = np.stack([batch["id"].to_numpy(), batch["tag"].to_numpy()], axis=1)
        dims, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        at = np.cumsum(dims) - dims
        for role, dim in {(int(r), int(d)) for r, d in zip(roles, dims, strict=True)}:
            rows = np.flatnonzero((roles == role) & (dims == dim))
            for a in range(0, len(rows), CHUNK):
                part = rows[a : a + CHUNK]
                held = waiting.setdefault((role, dim), [])
                held.append((ids[part], flat[at[part][:, None] + np.arange(dim)]))
                if sum(len(h[0]) for h in held) >= CHUNK:
                    yield chunk(role, dim, waiting.pop((role, dim)))
    for (role, dim), held in waiting.items():
        yield chunk(role, dim, held)


def _unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, tags and vectors of a chunk."""
    kind = {1: np.int8, 2: np.int16, 8: np.int64}[vectors[0]]
    n = len(ids) // 16
    return *np.frombuffer(ids, np.int64).reshape(2, n), np.frombuffer(vectors, kind, n * dim, 1).reshape(n, dim).astype(np.int64)


def _largest(vectors: np.ndarray) -> int:
    """The largest absolute value."""
    return max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))


class Lists:
    """Candidates as sorted lists, one for each dimension, which are only read from their ends inwards."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)
        self.known: dict[tuple, np.ndarray] = {}
        self.asked = self.entries = 0  #: entries of the lists for all queries so far, and how many of them were read

    def read(self, depth: int, upper: bool, kind: type) -> np.ndarray:
        """After reading ``depth`` entries from the top of each list, and from the bottom: for each candidate what has
        been read, and the largest share (``upper``; else the smallest) that the rest can have."""
        key = (depth, upper, kind)
        if key not in self.known:
            n, dim = self.vectors.shape
            column = np.arange(dim)
            near, far = (max(n - depth - 1, 0), min(depth, n - 1)), (0, n - 1)
            ends = near if upper else far
            made = np.empty((n, 2 * dim), kind)
            made[:, :dim], made[:, dim:] = self.sorted[ends[0]], self.sorted[ends[1]]
            made[self.order[n - depth :], column] = self.sorted[n - depth :]
            made[self.order[:depth], column + dim] = self.sorted[:depth]
            self.known[key] = made
        return self.known[key]


def search(lists: Lists, queries: np.ndarray, query_ids: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, candidate number and score of all pairs that may be among the k best of a query.

    ``bars`` holds for each query a score that k other candidates are known to reach, or ``NONE``.
    """
    n, dim = lists.vectors.shape
    top = _largest(queries) * _largest(lists.vectors) * dim
    kind = np.float32 if top < 1 << 23 else np.float64
    slack = 0.0 if top < 1 << 52 else top * 1e-12
    # Each end of a list counts for the queries whose component has its sign.
    weights = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1).astype(kind)
    own = lists.ids[None, :] == query_ids[:, None]
    bars = bars.astype(np.float64)
    open_rows = np.arange(len(queries))
    lists.asked += len(queries) * n * dim
    before = 0
    out = []
    for share in DEPTHS:
        depth = n if share == 1 else int(n * share)
        lists.entries += len(open_rows) * (depth - before) * dim
        before = depth
        w, mask = weights[open_rows], own[open_rows]
        bound = lambda rows, upper: np.clip(w[rows] @ lists.read(depth, upper, kind).T, *map(float, LONG))  # noqa: B023, E731
        upper = np.where(mask, -np.inf, bound(slice(None), True))
        blank = bars[open_rows] == NONE
        if blank.any() and n > k:
            lower = upper[blank] if depth == n else np.where(mask[blank], -np.inf, bound(blank, False))
            bars[open_rows[blank]] = np.partition(lower, n - k, axis=1)[:, n - k].astype(np.float64) - slack
        alive = (upper + slack >= bars[open_rows][:, None]) & (upper > -np.inf)
        done = alive.sum(1) <= (n if depth == n else RESOLVED)
        rows, cols = np.nonzero(alive[done])
        numbers = open_rows[done][rows]
        for a in range(0, len(numbers), 1 << 16):
            q, c = numbers[a : a + (1 << 16)], cols[a : a + (1 << 16)]
            out.append((q, c, _score(queries[q], lists.vectors[c], top)))
        # A lower bound that this round has given holds for this block only if later rounds don't beat it.
        bars[open_rows[blank & ~done]] = NONE
        open_rows = open_rows[~done]
        if not len(open_rows):
            break
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3


def _score(a: np.ndarray, b: np.ndarray, top: int) -> np.ndarray:
    """Inner products of rows as longs; what passes a long is its nearest end. ``top`` is a bound of their size."""
    if top < 1 << 62:
        return np.einsum("ij,ij->i", a, b)
    exact = (a.astype(object) * b.astype(object)).sum(axis=1)
    return np.array([min(max(x, LONG[0]), LONG[1]) for x in exact], np.int64)


class Best:
    """The k best candidates so far of each query of a block; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, tags: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.tags, self.vectors, self.k = ids, tags, vectors, k
        self.found = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.bars = np.full(len(ids), NONE)

    def add(self, lists: Lists) -> None:
        new = []
        for a in range(0, len(self.ids), BATCH):
            b = min(a + BATCH, len(self.ids))
            q, c, score = search(lists, self.vectors[a:b], self.ids[a:b], self.bars[a:b], self.k)
            new.append((q + a, lists.ids[c], score))
        q, ids, scores = (np.concatenate(x) for x in zip(self.found, *new, strict=True))
        order = np.lexsort((ids, ~scores, q))  # ~x falls as x grows, and never leaves the long
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        full = q[rank == self.k - 1]
        # As a double the score may be rounded up: the next one below is safe.
        self.bars[full] = np.nextafter(scores[rank == self.k - 1].astype(np.float64), -np.inf)
        self.found = q[keep], ids[keep], scores[keep]


def _meet(k: int):
    """Streams the chunks of (query block, candidate group) keys, queries first, and gives each key's best pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, best = None, [], None

        def result() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best.found[0]):
                q, ids, scores = best.found
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[q]), pa.array(best.tags[q]), pa.array(ids), pa.array(scores)], ["query_id", "tag", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["cell"], row["dim"]) != key:
                    yield from result()
                    key, queries, best = (row["cell"], row["dim"]), [], None
                part = _unpack(row["ids"], row["vectors"], row["dim"])
                if row["role"] == 0:
                    queries.append(part)
                    continue
                if queries:
                    best, queries = Best(*(np.concatenate(x) for x in zip(*queries, strict=True)), k), []
                if best is None:
                    continue
                ids, _, vectors = part
                for at in range(0, len(ids), LISTED):
                    best.add(Lists(ids[at : at + LISTED], vectors[at : at + LISTED]))
        yield from result()

    return run


def _of_no_component(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The same for vectors without components, whose products are all 0: the candidates of the smallest ids."""
    given = candidates.where("size(vector) = 0").groupBy("id").agg(F.least(F.count("*"), F.lit(k)).alias("n")).orderBy("id").limit(k + 1)
    first = F.broadcast(given.select(F.col("id").alias("vec_id"), F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("zero")))
    asked = queries.where("size(vector) = 0").select(F.col("id").alias("query_id"), F.xxhash64("vector").alias("tag")).distinct()
    return asked.join(first, F.col("query_id") != F.col("vec_id")).select("query_id", "tag", "vec_id", F.lit(0).cast("long").alias("score"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k candidates of largest inner product for each query: ``query_id, rank, vec_id, score``.

    Both inputs have (``id`` long, ``vector`` array<long>). A candidate with the query's id is the query's own row
    and doesn't count; ties go to the smaller id. Defined cases: rows with a null id or vector take no part; only
    vectors of one length are compared; a query with fewer than k candidates gets them all, one with none gets no
    row; a query that is repeated with the same vector counts once, with another vector it gets a ranking of its own
    under the same id; a repeated candidate counts each time. Scores beyond a long are its ends, and so are ties there.
    """
    usable = "id is not null and vector is not null"
    tag = F.xxhash64("vector").alias("tag")
    bare = _of_no_component(queries.where(usable), candidates.where(usable), k)
    usable += " and size(vector) > 0"
    asked = queries.where(usable).select(F.lit(0).alias("role"), "id", tag, "vector").dropDuplicates(["id", "vector"])
    given = candidates.where(usable).select(F.lit(1).alias("role"), "id", F.lit(0).cast("long").alias("tag"), "vector")
    n_queries, n_given = asked.count(), given.count()
    blocks = max(1, -(-n_queries // QUERIES))
    groups = min(MOST_GROUPS, max(1, -(-n_given // GROUP)))
    in_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pack = lambda rows: rows.mapInArrow(_pack, CHUNKS)
    ask = pack(asked).withColumns({"block": F.pmod("part", F.lit(blocks)), "group": in_all(groups)})
    give = pack(given).withColumns({"block": in_all(blocks), "group": F.pmod("part", F.lit(groups))})
    cell = (F.col("block") * groups + F.col("group")).cast("long")
    met = ask.select(cell.alias("cell"), "role", "part", "dim", "ids", "vectors").unionByName(give.select(cell.alias("cell"), "role", "part", "dim", "ids", "vectors"))
    pairs = met.repartition(blocks * groups, "cell").sortWithinPartitions("cell", "dim", "role", "part").mapInArrow(_meet(k), "query_id long, tag long, vec_id long, score long")
    best = Window.partitionBy("query_id", "tag").orderBy(F.col("score").desc(), F.col("vec_id"))
    return pairs.unionByName(bare).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
