"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of word n-grams (shingles). Pairs whose sets have a Jaccard similarity of at least ``threshold`` are
links.

1. Texts of equal sets are one class; only classes are compared.
2. Candidates: sorted by how many texts have it, rarest first, two sets this similar share one of their first
   ``n - ceil(threshold * n) + 1`` shingles, so no link is lost. Blocks of texts look up these frequencies
   (``blocks``), which count all shingles of all texts by 40 bits of their hash; any fixed order would be right,
   this one keeps shared passages out of the prefixes, and a shingle that only one text has needs no partner.
3. Cells: classes with the same least hash among the more frequent half of their shingles are a cell, or several if
   they are many or long; a large group of near copies has few such hashes. Two cells are compared if a prefix shingle
   occurs in both. So a class is sent once for each cell that it may have a partner in, however many shingles it has in
   common with it.
4. Pruning: MinHash values of a pair are compared ``STEP`` at a time. With m of n equal and a uniform prior, the
   posterior probability that the similarity reaches the threshold is that of at most m successes in n + 1 draws
   of chance ``threshold``; below ``TOLERANCE`` the pair is dropped. First sketches alone are sent (``SKETCH`` values of
   16 bits, whatever the size of a set), then the sets of those classes that still have a partner in that pair of cells;
   of these the pairs that share a prefix shingle are compared by all values.
5. The rest is verified exactly. Pairs never leave their task: what goes on are sums and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet.llm import blocks, tokens
from barquet.llm.graph import components, written

WORDS, THRESHOLD = 5, 0.8
CUT_BITS = np.uint64(24)  #: of a shingle's hash, these don't count for its frequency
HASHES, STEP, TOLERANCE = 128, 16, 1e-8
SKETCH = 48  #: MinHash values that are sent ahead of the sets
BLOCK, CELL_SHINGLES = 512, 1 << 19  #: classes, and shingles of all of them, in a cell, at about
PAIRS = 100_000  #: pairs that are compared at a time
COLUMNS = 2048  #: shingles whose owners are marked at a time
HOT = 1000  #: keys that have more than one in so many of all rows are joined apart; there can't be more of them than this
READ = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("key", T.LongType()),  #: of the set
        T.StructField("n", T.IntegerType()),  #: shingles of the set
        T.StructField("mark", T.LongType()),  #: least hash of the more frequent half of the set
        T.StructField("shared", T.IntegerType()),  #: prefix shingles that others have too; they stand first in ``body``
        T.StructField("sketch", T.BinaryType()),  #: low halves of its first MinHash values
        T.StructField("body", T.BinaryType()),  #: the set, once for each class of a block
    ]
)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, text by text, and the number of each text's.

    Words are what ASCII white space separates, as written. A text of fewer words is a single shingle of all of
    them, one without words has none.
    """
    data, at = tokens.text_bytes(texts)
    starts, ends, n = tokens.word_bounds(data, at)
    h = tokens.word_hashes(data, starts, ends)
    begin, text = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    value = h.copy()
    for k in range(1, words):
        value[: max(len(h) - k, 0)] = tokens.combine(value[: max(len(h) - k, 0)], h[k:])
    full = np.arange(len(h)) - begin[text] + words <= n[text]
    for i in np.flatnonzero((n > 0) & (n < words)):
        whole = h[begin[i] : begin[i] + 1]
        for k in range(1, n[i]):
            whole = tokens.combine(whole, h[begin[i] + k : begin[i] + k + 1])
        value[begin[i]], full[begin[i]] = tokens.mix64(whole + n[i].astype(np.uint64))[0], True
    value, text = value[full], text[full]
    # Sorted by text and the high bits of the hash, which is quick; by all bits only if different hashes share these.
    mixed = (text.astype(np.uint64) << np.uint64(40)) | (value >> CUT_BITS)
    order = np.argsort(mixed)
    mixed, value, text = mixed[order], value[order], text[order]
    if ((mixed[1:] == mixed[:-1]) & (value[1:] != value[:-1])).any():
        order = np.lexsort((value, text))
        value, text = value[order], text[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[fresh], np.bincount(text[fresh], minlength=len(n))


def set_keys(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set as signed integer; of no meaning for empty sets."""
    keys = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[full]
    if len(full):
        keys[full] = tokens.combine(np.add.reduceat(tokens.mix64(values), begin), np.bitwise_xor.reduceat(values, begin))
    return keys.view(np.int64)


def _ask(rows: DataFrame, words: int, p: blocks.Plan) -> DataFrame:
    """Each block's distinct shingles (40 bits) by range, and how many of its texts have them."""
    schema = "block long, bucket int, shingles binary, counts binary"

    def ask(name: int, block: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, counts = np.unique(np.concatenate([shingles(part["text"], words)[0] >> CUT_BITS for part in tokens.slices(block, "text")]), return_counts=True)
        asked = [(name, k, blocks.gaps(keys[part]), blocks.squeeze(counts[part])) for k, part in blocks.runs(keys << CUT_BITS, p.ranges)]
        return blocks.rows_of(asked, schema) if asked else None

    return tokens.mapped(rows, lambda batches: blocks.each(batches, "text", ask), schema)


def _split(row: dict, p: blocks.Plan) -> list[dict]:
    """What a block asks of a range, by its buckets."""
    keys, counts = blocks.from_gaps(row["shingles"]), blocks.expand(row["counts"])
    at = blocks.within(keys << CUT_BITS, row["bucket"], p)
    return [
        {"block": row["block"], "bucket": row["bucket"] * p.within + k, "shingles": blocks.gaps(keys[a:b]), "counts": blocks.squeeze(counts[a:b])}
        for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))
        if b > a
    ]


def _answer(asked: DataFrame, p: blocks.Plan) -> DataFrame:
    """How many texts have each shingle, to each block in the order asked."""

    def resolve(rows: list[dict]) -> list[tuple]:
        lists = [blocks.from_gaps(r["shingles"]) for r in rows]
        keys, total = blocks.counted(lists, [blocks.expand(r["counts"]) for r in rows])
        return [(r["block"], r["bucket"], blocks.squeeze(total[np.searchsorted(keys, x)])) for r, x in zip(rows, lists, strict=True)]

    return blocks.answer(asked, p, _split, resolve)


def _solve(words: int, threshold: float):
    """For a block: key and size of each text's set, and for classes whose prefix has a shingle of others their sets."""

    def solve(block: pa.RecordBatch, got: list[bytes]) -> Iterator[pa.RecordBatch]:
        frequency = blocks.joined([blocks.expand(x) for x in got], np.uint64)
        parts = [(part, *shingles(part["text"], words)) for part in tokens.slices(block, "text")]
        known = blocks.distinct(np.concatenate([v >> CUT_BITS for _, v, _ in parts]))
        blocks.fits(len(known) == len(frequency))
        seen = np.zeros(0, np.int64)
        for part, values, sizes in parts:
            keys, n = set_keys(values, sizes), part.num_rows
            cut = values >> CUT_BITS
            order, often = np.argsort(cut), np.empty(len(cut), np.uint64)
            often[order] = frequency[np.searchsorted(known, cut[order])]
            texts = np.repeat(np.arange(n), sizes)
            # What only one text has comes first in the order and is left out; the rest of the prefix, if any, is sorted.
            prefix = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
            left = prefix - np.bincount(texts[often < 2], minlength=n)
            usable = part["doc_id"].is_valid().to_numpy(zero_copy_only=False) & (sizes > 0) & ~np.isin(keys, seen)
            left[~usable] = 0
            mine = np.flatnonzero(left > 0)
            mine = mine[np.unique(keys[mine], return_index=True)[1]]
            seen = np.concatenate([seen, keys[mine]])
            begin = np.cumsum(sizes) - sizes
            mark, shared, sketches, bodies = np.zeros(n, np.int64), np.zeros(n, np.int32), [None] * n, [None] * n
            held = values[np.isin(texts, mine)]
            signed = signatures(held, np.cumsum(sizes[np.sort(mine)]) - sizes[np.sort(mine)], SKETCH) if len(mine) else None
            for k, i in enumerate(np.sort(mine).tolist()):
                own, times = values[begin[i] : begin[i] + sizes[i]], often[begin[i] : begin[i] + sizes[i]]
                order = np.lexsort((own, times, times < 2))
                mark[i], shared[i] = own[times >= np.median(times)].min().view(np.int64), left[i]
                sketches[i], bodies[i] = signed[k].astype("<u2").tobytes(), own[order].tobytes()
            none = np.ones(n, bool)
            none[mine] = False
            columns = [part["doc_id"], pa.array(keys, mask=sizes == 0), pa.array(sizes.astype(np.int32)), pa.array(mark, mask=none), pa.array(shared, mask=none)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sketches, pa.binary()), pa.array(bodies, pa.binary())], READ.names)

    return solve


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest equal MinHash values of n with which a pair isn't dropped."""
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n + 1


def signatures(values: np.ndarray, begin: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The first MinHash values of each (non-empty) set."""
    seeds = tokens.mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64)).reshape(2, HASHES)
    out = np.empty((len(begin), hashes), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(hashes):
            out[:, k] = np.minimum.reduceat(values * (seeds[0, k] | np.uint64(1)) + seeds[1, k], begin) >> np.uint64(32)
    return out


def likely(signed: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Numbers of the pairs (left, right) of sets that their sizes and MinHash values leave."""
    needed = [least_matches(n, threshold, TOLERANCE) for n in range(STEP, signed.shape[1] + 1, STEP)]
    alive = [np.zeros(0, int)]
    for a in range(0, len(left), PAIRS):
        now = np.arange(a, min(a + PAIRS, len(left)))
        small, large = (f(sizes[left[now]], sizes[right[now]]) for f in (np.minimum, np.maximum))
        now = now[small >= threshold * large - 1e-9]
        equal = np.zeros(len(now), np.int64)
        for k, least in enumerate(needed):
            step = slice(k * STEP, (k + 1) * STEP)
            equal += (signed[left[now], step] == signed[right[now], step]).sum(1)
            now, equal = now[equal >= least], equal[equal >= least]
        alive.append(now)
    return np.concatenate(alive)


def similar(values: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (left, right) of sets are links: pruned by MinHash values, the rest verified."""
    begin = np.cumsum(sizes) - sizes
    alive = likely(signatures(values, begin), sizes, left, right, threshold)
    # Exact: mark one set, count the marks in all of its partners.
    out = np.zeros(len(left), bool)
    if not len(alive):
        return out
    _, ids = np.unique(values, return_inverse=True)
    marked = np.zeros(len(values), bool)
    alive = alive[np.argsort(left[alive], kind="stable")]
    cuts = np.flatnonzero(np.diff(left[alive], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        one = left[alive[a]]
        own = ids[begin[one] : begin[one] + sizes[one]]
        marked[own] = True
        for c in range(a, b, BLOCK):
            pairs = alive[c : min(c + BLOCK, b)]
            other = right[pairs]
            n = sizes[other]
            stops = np.cumsum(n)
            at = np.repeat(begin[other] - (stops - n), n) + np.arange(stops[-1])
            common = np.add.reduceat(marked[ids[at]].astype(np.int64), stops - n)
            out[pairs] = common >= threshold * (sizes[one] + n - common) - 1e-9
        marked[own] = False
    return out


def sharing(unit: np.ndarray, values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Which of the n sets (rows and columns) of one unit have one of these values in common."""
    order = np.lexsort((owner, values, unit[owner]))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (unit[owner[1:]] != unit[owner[:-1]])
    starts = np.flatnonzero(first)
    # Values with the same owners say the same: one of them is enough, and those with a single owner say nothing.
    with np.errstate(over="ignore"):
        owners = np.add.reduceat(tokens.mix64(owner.astype(np.uint64) + np.uint64(1)), starts)
    sizes = np.diff(starts, append=len(values))
    column = np.unique(owners[sizes > 1], return_index=True)[1]
    starts, sizes = starts[sizes > 1][column], sizes[sizes > 1][column]
    out = np.zeros((n, n), bool)
    for a in range(0, len(starts), COLUMNS):
        size = sizes[a : a + COLUMNS]
        stops = np.cumsum(size)
        at = np.repeat(starts[a : a + COLUMNS] - (stops - size), size) + np.arange(stops[-1])
        marks = np.zeros((n, len(size)), np.float32)
        marks[owner[at], np.repeat(np.arange(len(size)), size)] = 1
        out |= (marks @ marks.T) > 0
    return out


LIKELY = "i long, j long, key long"
FOUND = "key long, links long, linked long, into long"
UNIT = "i long, j long, cell long, key long, copies long, shared int, body binary"


def _sketched(threshold: float):
    """The classes of each pair of cells whose sketch has a likely partner in it."""

    def partners(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (unit, i, j, cell, key, n, sketch) of whole units."""
        unit, i, j, cell, keys, sizes = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:6])
        signed = np.frombuffer(b"".join(r[6] for r in rows), "<u2").reshape(len(rows), SKETCH)
        across = (i == j)[:, None] | ((cell == i)[:, None] != (cell == i)[None, :])
        left, right = np.nonzero(np.triu((unit[:, None] == unit[None, :]) & across, 1))
        alive = likely(signed, sizes, left, right, threshold)
        at = np.unique(np.concatenate([left[alive], right[alive]]))
        return pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (i, j, keys)], ["i", "j", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unit, last = [], 0, None
        for batch in batches:
            for i, j, *row in zip(*(batch[c].to_pylist() for c in ("i", "j", "cell", "key", "n", "sketch")), strict=True):
                if (i, j) != last:
                    if len(held) > BLOCK:
                        yield partners(held)
                        held = []
                    last, unit = (i, j), unit + 1
                held.append((unit, i, j, *row))
        if held:
            yield partners(held)

    return run


def _compare(threshold: float):
    """Links within each pair of cells: by class their number, the texts at their other ends, and a smaller class that
    it is connected with by links, if any."""

    def links(rows: list[tuple]) -> pa.RecordBatch | None:
        """rows: (unit, it is in the first cell, that is the only one, key, copies, shared, set) of whole units."""
        unit, first, same, keys, copies, shared, bodies = zip(*rows, strict=True)
        unit, first, same = np.array(unit), np.array(first), np.array(same)
        keys, copies, shared = np.array(keys, np.int64), np.array(copies, np.int64), np.array(shared, np.int64)
        values = np.concatenate([np.frombuffer(b, np.uint64) for b in bodies])
        sizes = np.array([len(b) // 8 for b in bodies])
        begin, stops, n = np.cumsum(sizes) - sizes, np.cumsum(shared), len(keys)
        at = np.repeat(begin - (stops - shared), shared) + np.arange(stops[-1])
        left, right = np.nonzero(np.triu(sharing(unit, values[at], np.repeat(np.arange(n), shared), n), 1))
        across = same[left] | (first[left] != first[right])  # pairs within one of two cells are another unit's
        left, right = left[across], right[across]
        hit = similar(values, sizes, left, right, threshold)
        left, right = left[hit], right[hit]
        if not len(left):
            return None
        number = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
        linked = np.bincount(left, copies[right], n) + np.bincount(right, copies[left], n)
        into = keys.copy()
        while True:
            least = np.minimum(into[left], into[right])
            before = into.copy()
            np.minimum.at(into, left, least)
            np.minimum.at(into, right, least)
            if (into == before).all():
                break
        at = np.flatnonzero(number)
        return pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(number[at]), pa.array(linked[at].astype(np.int64)), pa.array(into[at])], ["key", "links", "linked", "into"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, unit, last = [], 0, 0, None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("i", "j", "cell", "key", "copies", "shared", "body")]
            for i, j, cell, key, copies, shared, body in zip(*columns, strict=True):
                if (i, j) != last:
                    if size > tokens.SLICE_BYTES or len(held) > BLOCK:
                        out = links(held)
                        if out is not None:
                            yield out
                        held, size = [], 0
                    last, unit = (i, j), unit + 1
                held.append((unit, cell == i, i == j, key, copies, shared, body))
                size += len(body)
        if held:
            out = links(held)
            if out is not None:
                yield out

    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, cell) of the shared prefix of each set, each pair once a batch."""
    for batch in batches:
        bodies, shared, cells = batch["body"].to_pylist(), batch["shared"].to_numpy(), batch["cell"].to_numpy()
        pairs = np.stack([np.concatenate([np.frombuffer(b, np.int64, s) for b, s in zip(bodies, shared, strict=True)]), np.repeat(cells, shared)])
        pairs = pairs[:, np.lexsort(pairs)]
        fresh = np.ones(pairs.shape[1], bool)
        fresh[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0][fresh]), pa.array(pairs[1][fresh])], ["shingle", "cell"])


def attach(left: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``left`` with the columns of ``facts`` (unique by ``key``; ``weight`` is how many rows of ``left`` have the key, of
    ``total``), null where there are none.

    Keys of more than ``total / HOT`` rows are at most ``HOT``, so they are broadcast; their rows and those of null key
    are then spread, and no task of the join gets more than that share of the rows for a key.
    """
    most = max(1, total // HOT)
    names = [c for c in facts.columns if c != key]
    fact = F.struct(*names)
    hot = F.broadcast(facts.where(F.col(weight) > most).select(F.col(key), fact.alias("__hot")))
    cold = facts.where(F.col(weight) <= most).select(F.col(key).alias("__key"), fact.alias("__cold"))
    met = left.join(hot, key, "left").withColumn("__own", F.when(F.col("__hot").isNull(), F.col(key)))
    met = met.withColumn("__at", F.coalesce("__own", F.monotonically_increasing_id()))
    met = met.join(cold, F.col("__at") == F.col("__key"), "left")
    found = F.coalesce("__hot", F.when(F.col("__own").isNotNull(), F.col("__cold")))
    return met.withColumn("__found", found).select(*left.columns, *(F.col(f"__found.{c}").alias(c) for c in names))


def _cells(near: DataFrame) -> DataFrame:
    """The cell of each class."""
    counts = near.groupBy("mark").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("classes") / BLOCK), F.ceil(F.col("shingles") / CELL_SHINGLES)).cast("long")
    large = counts.select("mark", "classes", parts.alias("parts")).where("parts > 1")
    salt = F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1).cast("long")))
    return attach(near, large, "mark", "classes", near.count()).select("key", "copies", "n", F.xxhash64("mark", salt).alias("cell"))


def _cell_pairs(sets: DataFrame) -> DataFrame:
    """The pairs of cells that have a prefix shingle in common: ``i, j`` with i <= j, and each cell with itself."""
    posts = tokens.mapped(sets.select("cell", "shared", "body"), _prefixes, "shingle long, cell long")
    # Shingles that the same cells have give the same pairs.
    meet = posts.groupBy("shingle").agg(F.array_sort(F.collect_set("cell")).alias("cells")).where(F.size("cells") > 1).select("cells").distinct()
    left = meet.select("cells", F.posexplode("cells").alias("at", "i"))
    pairs = left.select("i", F.explode(F.expr("slice(cells, at + 2, size(cells))")).alias("j"))
    return pairs.unionByName(sets.groupBy("cell").count().where("count > 1").select(F.col("cell").alias("i"), F.col("cell").alias("j"))).distinct()


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id, class_id, group_id, n_links, n_shingles``.

    ``class_id`` is the smallest id among the rows of equal sets, ``group_id`` that among all rows that links
    connect, ``n_links`` the number of other rows with a similarity of at least ``threshold`` (those of equal sets
    included). Defined cases: rows without id or without words have no links (class and group are their own id);
    repeated rows are copies of each other; texts of fewer than ``words`` words are one shingle. Two different sets
    are taken for equal if their 64-bit keys are.

    The rows of ``docs`` are read three times (sizes, frequencies, sets). A class goes through every shuffle once for
    each block of texts it is in, its sketch once for each cell it meets, and its set once for each of these cells that
    has a likely partner, however many copies it has.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    p = blocks.plan(rows, "text")
    read = written(blocks.finish(rows, _answer(_ask(rows, words, p), p), "text", p, _solve(words, threshold), READ))
    ids = read.select("doc_id", "key", "n")
    own = read.where("key is not null and doc_id is not null")
    classes = written(own.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("mark").alias("mark")))
    of_class = read.where("body is not null").groupBy("key").agg(*(F.first(c).alias(c) for c in ("shared", "sketch", "body")))
    sets = written(_cells(classes.where("mark is not null")).join(of_class, "key"))
    pairs = written(_cell_pairs(sets))
    met = pairs.select("i", "j", F.col("i").alias("cell")).unionByName(pairs.where("i <> j").select("i", "j", F.col("j").alias("cell")))
    sketches = sets.select("cell", "key", "n", "sketch").join(met, "cell").repartition(min(p.buckets, blocks.MOST_PARTITIONS), "i", "j")
    paired = written(tokens.mapped(sketches.sortWithinPartitions("i", "j"), _sketched(threshold), LIKELY))
    units = sets.join(paired, "key").select(*(c.split()[0] for c in UNIT.split(", ")))
    found = written(tokens.mapped(units.repartition("i", "j").sortWithinPartitions("i", "j"), _compare(threshold), FOUND))

    groups = components(found.select(F.col("key").alias("a"), F.col("into").alias("b")))
    sums = found.groupBy("key").agg(F.sum("linked").alias("linked"))
    smallest = groups.withColumnRenamed("node", "key").join(classes, "key").groupBy("root").agg(F.min("class_id").alias("group_id"))
    of_key = groups.join(smallest, "root").select(F.col("node").alias("key"), "group_id")
    facts = classes.select("key", "class_id", "copies").join(sums, "key", "left").join(of_key, "key", "left").where("copies > 1 or linked > 0")
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    own = F.col("doc_id")
    known = own.isNotNull() & F.col("copies").isNotNull()
    return attach(ids, written(facts), "key", "copies", total).select(
        "doc_id",
        F.when(known, F.col("class_id")).otherwise(own).alias("class_id"),
        F.when(known, F.coalesce("group_id", "class_id")).otherwise(own).alias("group_id"),
        F.when(known, F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.col("n").alias("n_shingles"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id; of different texts that repeat it in the group, the
    same one in every run.

    A row is its id and its text: rows that repeat an id with another text are judged each on its own. Rows without
    id, and rows without words, stay. No row is lost but those that another row of their group, or an equal row, stands
    for.

    Rows are dropped in their blocks of texts (``blocks``): what is sorted and joined are ids and places, and the texts
    themselves move once, packed. ``docs`` should be a table that is read, or a checkpoint.
    """
    own, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    row = F.when(own.isNotNull(), F.xxhash64(own, body))
    p = blocks.plan(docs, text)
    linked = join(docs.where(own.isNotNull()).withColumn("__row", row), "__row", text).where("n_links > 0")
    member = written(linked.groupBy(F.col("doc_id").alias("__row")).agg(F.min("group_id").alias("group_id"), F.count("*").alias("times")))
    places = written(_places(docs.withColumns({"__row": row, "__id": own}), text))
    in_group = written(attach(places, member, "__row", "times", places.count()).where("group_id is not null"))
    first = in_group.groupBy("group_id").agg(F.min(F.struct("__id", "__row", "block", "place")).alias("first")).select("first.block", "first.place")
    dropped = in_group.join(first, ["block", "place"], "left_anti").groupBy("block").agg(F.array_join(F.sort_array(F.collect_list("place")), ",").cast("binary").alias("body"))

    def solve(rows: pa.RecordBatch, got: list[bytes]) -> Iterator[pa.RecordBatch]:
        keep = np.ones(rows.num_rows, bool)
        for told in got:
            out = np.array(told.decode().split(","), np.int64)
            blocks.fits(out[-1] < len(keep))
            keep[out] = False
        yield from tokens.slices(rows.filter(pa.array(keep)), text)

    # A block meets a single row of places.
    return blocks.finish(docs, dropped.withColumn("bucket", F.lit(0)), text, blocks.Plan(p.blocks, 1), solve, docs.schema)


def _places(rows: DataFrame, text: str) -> DataFrame:
    """``__row, __id`` of each row, and where it is: the block of texts, and the place in it.

    ``rows`` has all columns that the blocks will have, as Spark's order of repartitioned rows depends on them.
    """
    schema = T.StructType([rows.schema["__row"], rows.schema["__id"], T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType())])

    def placed(name: int, block: pa.RecordBatch) -> pa.RecordBatch:
        n = block.num_rows
        return pa.RecordBatch.from_arrays([block["__row"], block["__id"], pa.array(np.full(n, name)), pa.array(np.arange(n, dtype=np.int32))], schema.names)

    return tokens.mapped(rows, lambda batches: blocks.each(batches, text, placed), schema)
