"""How the sources of a language differ in their terms: an audit by sorted streams.

1. Tasks cut their documents into blocks, sort a block's terms by document and scan the runs: what leaves a block is a
   row for each (lang, term, source), with the number of documents and of occurrences there. A document is whole in one
   block, so numbers of documents add up.
2. These rows are dealt by (lang, term, source), sorted by them and the block, and a scan of the runs adds them up: a
   frequent term of a large source has a row for each block, no more.
3. The sums are dealt by (lang, term) and sorted by source; a scan of a term's run has its document frequency, keeps
   the term if that suffices, and passes the run on with the term's occurrences in the language.
4. With the totals of each source known, runs of kept terms, sorted again, are scanned next to the shares that the
   sources give terms they lack: each task adds up the distances of all pairs of its sources over its terms, in arrays, and
   sends a partial sum for each pair. Sources of a language are taken in tiles of ``TILE``, so that a task's array
   is bounded, and terms are dealt over as many tasks as they need.
5. Pairs are the sums of their partial ones; the terms of a source that exceed the language's share are ranked, of
   which Spark keeps the first in each task before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.llm import tokens
from barquet.session import scratch

LEAST_DOCUMENTS = 30  #: documents of a language that a kept term is in
MOST_TERMS = 50  #: terms that are reported for a source
SMOOTHING = 5
SCALE = 1_000_000_000
BLOCK_BYTES = 16 << 20  #: bytes of text in a block
PIECE_BYTES = 4 << 20  #: bytes that are in arrays of words at a time, but for a longer single word
TILE = 256  #: sources of a side of a task's array
TERMS = 4096  #: terms whose shares are in an array at a time
RUNS = 20_000  #: kept (term, source) rows for each task of the scan for pairs
SMALL = 20_000  #: sources at most whose totals are broadcast
COUNTED = "lang string, term string, source string, block long, docs long, n long"
SUMMED = "lang string, term string, source string, docs long, n long"
KEPT = "lang string, term string, source string, n long, total long, first boolean"


def _term_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of letters A to Z, a to z and bytes of characters beyond ASCII."""
    low = data | 0x20
    inside = ((low >= ord("a")) & (low <= ord("z"))) | (data >= 0x80)
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def _pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The text of each row, cut into pieces between its terms: (row, bytes)."""
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        while b - a > PIECE_BYTES:
            stop = a + PIECE_BYTES
            starts, ends = _term_bounds(data[a:stop])
            if len(ends) and ends[-1] == PIECE_BYTES:  # the last term may go on
                stop = a + int(starts[-1])
                if stop == a:
                    rest = data[a:b]
                    low = rest | 0x20
                    outside = np.flatnonzero(~(((low >= ord("a")) & (low <= ord("z"))) | (rest >= 0x80)))
                    stop = a + int(outside[0]) if len(outside) else b
            yield row, data[a:stop]
            a = stop
        yield row, data[a:b]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new run begins in columns that are sorted together."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    fresh = np.zeros(len(columns[0]), bool)
    fresh[0] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.int64)


class _Block:
    """Terms of the documents of a block as sorted runs: (term, document, occurrences)."""

    def __init__(self) -> None:
        self.groups: list[tuple[str, str]] = []  # of each document
        self.words: dict[int, bytes] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, langs: list[str], sources: list[str], texts: pa.Array) -> None:
        data, at = tokens.text_bytes(texts)
        data = tokens.lower_ascii(data)
        first = len(self.groups)
        self.groups += zip(langs, sources, strict=True)
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for row, piece in _pieces(data, at):
            if held and size + len(piece) > PIECE_BYTES:
                self._scan(held, first)
                held, size = [], 0
            held.append((row, piece))
            size += len(piece)
        if held:
            self._scan(held, first)
        self.size += len(data)

    def _scan(self, held: list[tuple[int, np.ndarray]], first: int) -> None:
        gap = np.zeros(1, np.uint8)
        data = np.concatenate([x for _, piece in held for x in (piece, gap)])
        begins = np.cumsum([0, *(len(piece) + 1 for _, piece in held)])[:-1]
        starts, ends = _term_bounds(data)
        if not len(starts):
            return
        rows = np.array([first + row for row, _ in held], np.int64)
        doc = rows[np.searchsorted(begins, starts, "right") - 1]
        terms = tokens.word_hashes(data, starts, ends)
        new, at = np.unique(terms, return_index=True)
        body = data.tobytes()
        self.words.update((k, body[a:b]) for k, a, b in zip(new.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True) if k not in self.words)
        order = np.lexsort((doc, terms))
        terms, doc = terms[order], doc[order]
        runs = _runs(terms, doc)
        self.parts.append((terms[runs], doc[runs], np.diff(runs, append=len(terms))))

    def rows(self, block: int) -> pa.RecordBatch:
        """A row for each (lang, term, source): documents and occurrences."""
        if self.parts:
            terms, doc, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        else:
            terms, doc, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        names = sorted(set(self.groups))
        number = {g: k for k, g in enumerate(names)}
        group = np.array([number[g] for g in self.groups], np.int64)[doc]
        order = np.lexsort((doc, terms, group))
        terms, doc, n, group = terms[order], doc[order], n[order], group[order]
        whole = _runs(group, terms, doc)  # a long document comes in pieces, whose runs are one
        terms, group, n = terms[whole], group[whole], _sums(n, whole)
        runs = _runs(group, terms)
        docs, n = np.diff(runs, append=len(terms)), _sums(n, runs)
        lang, source = (pa.array([g[i] for g in names], pa.string()).take(pa.array(group[runs])) for i in range(2))
        term = pa.array([self.words[k] for k in terms[runs].tolist()], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([lang, term, source, pa.array(np.full(len(runs), block)), pa.array(docs), pa.array(n)], ["lang", "term", "source", "block", "docs", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    block, serial = _Block(), (task.partitionId() if task else 0) << 24
    for batch in batches:
        for part in tokens.slices(batch, "text", BLOCK_BYTES):
            block.add(part["lang"].to_pylist(), part["source"].to_pylist(), part["text"])
            if block.size >= BLOCK_BYTES:
                yield block.rows(serial)
                block, serial = _Block(), serial + 1
    if block.groups:
        yield block.rows(serial)


def _fresh(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where runs of equal values of these columns, which are sorted, begin."""
    fresh = np.zeros(len(table), bool)
    if len(table):
        fresh[0] = True
        for name in names:
            codes = table[name].combine_chunks().dictionary_encode().indices.to_numpy()
            fresh[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(fresh)


def _whole_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The sorted rows with where their runs begin; no run is in two tables."""
    held: list[pa.RecordBatch] = []
    key = lambda batch, k: tuple(batch[n][k].as_py() for n in names)
    for batch in batches:
        if not len(batch):
            continue
        if held and key(held[-1], len(held[-1]) - 1) != key(batch, 0):
            yield (table := pa.Table.from_batches(held)), _fresh(table, names)
            held = []
        last = int(_fresh(pa.Table.from_batches([batch]), names)[-1])
        if last:
            held.append(batch.slice(0, last))
            yield (table := pa.Table.from_batches(held)), _fresh(table, names)
            held = []
        held.append(batch.slice(last))
    if held:
        yield (table := pa.Table.from_batches(held)), _fresh(table, names)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each run of (lang, term, source) over its blocks."""
    for table, starts in _whole_runs(batches, ["lang", "term", "source"]):
        firsts = table.select(["lang", "term", "source"]).take(pa.array(starts)).combine_chunks()
        for c in ("docs", "n"):
            firsts = firsts.append_column(c, pa.array(_sums(table[c].to_numpy(), starts)))
        yield from firsts.to_batches()


def _keep(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each run of (lang, term): its rows, with the occurrences of all, if it is in documents enough."""
        for table, starts in _whole_runs(batches, ["lang", "term"]):
            lengths = np.diff(starts, append=len(table))
            kept = np.repeat(_sums(table["docs"].to_numpy(), starts) >= least, lengths)
            total = np.repeat(_sums(table["n"].to_numpy(), starts), lengths)
            first = np.zeros(len(table), bool)
            first[starts] = True
            made = table.select(["lang", "term", "source", "n"]).append_column("total", pa.array(total)).append_column("first", pa.array(first))
            yield from made.filter(pa.array(kept)).combine_chunks().to_batches()

    return run


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``KEPT`` for documents (``lang, source, text``, without nulls): a row for each kept term and source that has it."""
    key = ["lang", "term", "source"]
    counted = docs.select("lang", "source", "text").mapInArrow(_count, COUNTED)
    summed = counted.repartition(*key).sortWithinPartitions(*key, "block").mapInArrow(_add_up, SUMMED)
    return summed.repartition("lang", "term").sortWithinPartitions(*key).mapInArrow(_keep(least), KEPT)


def _share(n: Column, words: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (words + SMOOTHING * terms)), exactly; without terms nothing is divided."""
    wide = lambda c: c.cast("decimal(38,0)")
    above, below = wide(F.lit(SCALE)) * (n + SMOOTHING), F.greatest(words + SMOOTHING * terms, F.lit(1))
    return F.call_function("div", above.cast("decimal(38,0)"), wide(below)) + 1


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """(key, its rows) for each (lang, i, j, salt) of the sorted rows."""
    key, queue = None, []
    for batch in batches:
        if not len(batch):
            continue
        starts = _fresh(pa.Table.from_batches([batch]), ["lang", "i", "j", "salt"]).tolist()
        for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
            part = batch.slice(a, b - a)
            new = tuple(part[c][0].as_py() for c in ("lang", "i", "j", "salt"))
            if key is not None and new != key:
                yield key, queue
                queue = []
            key = new
            queue.append(part)
    if key is not None:
        yield key, queue


def _cell(key: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of the pairs of the sources of a (lang, i, j, salt), over its terms, less those of terms that both lack.

    Rows without term come first: the sources of tiles i and j, with the share of terms that they lack. Then come the
    terms' runs with the shares of the sources that have them.
    """
    lang, i, j, _ = key
    table = pa.Table.from_batches(parts)
    header = table.filter(pc.is_null(table["term"]))
    runs = table.filter(pc.is_valid(table["term"]))
    sources, tiles = header["source"].to_pylist(), header["tile"].to_numpy()
    lacking = header["p"].to_numpy()
    number = {s: k for k, s in enumerate(sources)}
    left, right = np.flatnonzero(tiles == i), np.flatnonzero(tiles == j)
    total = np.zeros((len(left), len(right)), np.int64)
    base = np.abs(lacking[left][:, None] - lacking[right][None, :])
    starts = _fresh(runs, ["term"])
    source = np.array([number[s] for s in runs["source"].to_pylist()], np.int64)
    p, term = runs["p"].to_numpy(), np.repeat(np.arange(len(starts)), np.diff(starts, append=len(runs)))
    for a in range(0, len(starts), TERMS):
        b = min(a + TERMS, len(starts))
        x, y = np.searchsorted(term, [a, b])
        shares = np.repeat(lacking[:, None], b - a, axis=1)
        shares[source[x:y], term[x:y] - a] = p[x:y]
        for k, row in enumerate(left):
            total[k] += np.abs(shares[right] - shares[row]).sum(axis=1)
        total -= (b - a) * base
    at = [(k, m) for k in range(len(left)) for m in range(len(right)) if left[k] < right[m]]
    ks, ms = [k for k, _ in at], [m for _, m in at]
    names = lambda side, which: pa.array([sources[side[x]] for x in which], pa.string())
    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), names(left, ks), names(right, ms), pa.array(total[ks, ms] if at else np.zeros(0, np.int64))], ["lang", "source", "item", "part"])


def _partial_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, parts in _whole_cells(batches):
        yield from _cell(key, parts)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) of ``docs``.

    Terms are runs of letters A to Z, in lower case, and of characters beyond ASCII; those in at least ``least``
    documents of a language are kept, V of them. A source that has a kept term ``n`` times, of N occurrences of kept
    terms, gives it the share 1 + floor(SCALE (n + SMOOTHING) / (N + SMOOTHING V)); so does the language as a whole.
    Part ``pair`` has the other sources of the language by the distance of their shares, summed over the kept terms;
    part ``term`` the terms of the source whose share exceeds that of the language, by how much, ``most_terms`` at most.
    Ties go by the item's UTF-8 bytes.

    Defined cases: nulls are empty strings; documents without terms still make their source occur; without kept terms
    all distances are 0; each row is a document, also one that is repeated; a language of one source has no pairs.
    """
    spark = docs.sparkSession
    clean = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    whole = docs.select(clean(lang).alias("lang"), clean(source).alias("source"), clean(text).alias("text"))
    place = scratch(spark)
    kept_terms(whole, least).write.parquet(f"{place}/kept")
    kept = spark.read.schema(KEPT).parquet(f"{place}/kept")
    words = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    terms = kept.where("first").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_words"))
    each = whole.select("lang", "source").distinct().join(words, ["lang", "source"], "left").join(terms, "lang", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("words", "terms", "lang_words")}
    numbered = Window.partitionBy("lang").orderBy("source")
    groups = each.withColumns(zero).withColumn("tile", F.floor((F.row_number().over(numbered) - 1) / TILE).cast("int"))
    groups.write.parquet(f"{place}/groups")
    groups = spark.read.parquet(f"{place}/groups")
    n_groups, n_kept = groups.count(), kept.count()
    facts = F.broadcast(groups) if n_groups <= SMALL else groups

    lacking = _share(F.lit(0).cast("long"), F.col("words"), F.col("terms"))
    shared = kept.join(facts, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("words"), F.col("terms")))

    # the tiles of a language, in pairs; each salt of a pair gets the tiles' sources and its part of the terms
    salts = max(1, -(-n_kept // RUNS))
    tiles = groups.groupBy("lang").agg(F.max("tile").alias("last"))
    cells = lambda tile: F.transform(F.sequence(F.lit(0), F.col("last")), lambda m: F.struct(F.least(m, tile).alias("i"), F.greatest(m, tile).alias("j")))
    spread = lambda frame: frame.join(F.broadcast(tiles) if n_groups <= SMALL else tiles, "lang").withColumn("cell", F.explode(cells(F.col("tile"))))
    named = ["lang", "cell.i", "cell.j", "salt", "term", "source", "tile", "p"]
    head = spread(groups.where("terms > 0").withColumn("p", lacking)).withColumns({"term": F.lit(None).cast("string"), "salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))})
    body = spread(shared).withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
    met = head.select(*named).unionByName(body.select(*named))
    order = ["lang", "i", "j", "salt"]
    parts = met.repartition(F.col("lang"), F.col("i"), F.col("j"), F.col("salt")).sortWithinPartitions(*order, F.col("term").asc_nulls_first(), "source")
    sums = parts.mapInArrow(_partial_pairs, "lang string, source string, item string, part long").groupBy("lang", "source", "item").agg(F.sum("part").alias("part"))

    side = lambda name: groups.select("lang", F.col("source").alias(name), lacking.alias(f"p_{name}"), "terms")
    both = side("source").join(side("item").drop("terms"), "lang").where("source < item")
    far = F.coalesce("part", F.lit(0).cast("long")) + F.col("terms") * F.abs(F.col("p_source") - F.col("p_item"))
    halves = both.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", far.alias("value"))
    pairs = halves.unionByName(halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))

    usual = _share(F.col("total"), F.col("lang_words"), F.col("terms"))
    over = shared.withColumn("value", F.col("p") - usual).where("n > 0 and value > 0")
    top = over.select("lang", "source", F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most_terms)
    named = lambda frame, part: frame.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs, "pair").unionByName(named(top, "term"))
