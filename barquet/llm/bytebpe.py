"""Byte-level byte-pair encoding and decoding: ranked merges as a fold in Spark's higher-order functions.

Texts are cut at the matches of the pattern by Spark's regular expressions, and a block of texts sends each of its
distinct words once, dealt by hash into buckets (``blocks``; never more than ``MOST_PARTITIONS`` of them, so a block
sends a bounded number of rows, whatever the size of the input). Within a bucket Spark groups equal words and encodes
each distinct one once: a fold over its bytes looks up the ranks of adjacent pieces in a literal map and joins the pieces
of the lowest rank, until none is left. The ids go back to the blocks, one row for each block and bucket, and are put
in the places of their words. Decoding concatenates the binary pieces of the ids.

The fold joins all pairs of the lowest rank at once, from the left. That is what joining them one at a time gives if
every token is reached by joins of ranks no higher than its own: then no new pair can have a lower rank than the pair
that it comes from. ``in_order`` checks this for the ranks given; where it fails, pairs are joined one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet.llm import blocks, tokens

MAPS = 8192  #: maps that the ranks are spread over, so that each is short: a look-up in a map of Spark reads its keys in a row
BUCKET_BYTES = 8 << 20  #: bytes of text for each bucket of distinct words
ASKED = "block long, bucket int, words string"  # the words of a row are lines
# How words that hold a line feed, or the character that marks this, are written in a line.
MARKED = (("\x01", "\x01a"), ("\n", "\x01b"))
SENT = "block long, bucket int, lens array<int>, ids array<int>, body binary"
MADE = ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")

# White space, and the letters and numbers of Unicode 16 that the regular expressions of Java 17
# (Unicode 13) don't know as such.
SPACES = r"\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NEW_LETTERS = """
870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4
10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0
107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7
113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D
16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D
1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D
31350-323AF"""
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"


def _newer(ranges: str) -> str:
    """The ranges as a part of a character class; characters before the first of them are told at once."""
    each = "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in ranges.split())
    return rf"[\x{{870}}-\x{{323AF}}&&[{each}]]"


def spark_pattern(pattern: str) -> str:
    """The tokenizer's pattern for Spark: classes of its own stand for ``\\s``, ``\\p{L}`` and ``\\p{N}``."""
    letters, numbers = r"\p{L}" + _newer(NEW_LETTERS), r"\p{N}" + _newer(NEW_NUMBERS)
    whole = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{letters}{numbers}]")
    for short, long in ((r"\S", f"[^{SPACES}]"), (r"\s", f"[{SPACES}]")):
        whole = whole.replace(short, long)
    for short, long in ((r" ?\p{L}+", f" ?[{letters}]+"), (r" ?\p{N}+", f" ?[{numbers}]+")):
        whole = whole.replace(short, long)
    return whole


def in_order(ranks: dict[bytes, int]) -> bool:
    """Whether every token is reached from its bytes by joins whose ranks don't exceed its own."""
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            found = [(ranks.get(a + b, rank + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            least, at = min(found)
            if least > rank:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


@dataclass(frozen=True)
class Ranks:
    """A tokenizer: its ranks, which are the ids, and the pattern that its words match."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Ranks:
        """From a file of lines with a token in base64 and its rank, read where the job starts."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}, pattern)

    @cached_property
    def at_once(self) -> bool:
        return in_order(self.ranks)

    @cached_property
    def maps(self) -> Column:
        """The literal rank map: tokens in hex by the remainder of their checksum."""
        spread: list[dict[str, int]] = [{} for _ in range(MAPS)]
        for token, rank in self.ranks.items():
            spread[zlib.crc32(token) % MAPS][token.hex().upper()] = rank
        return F.from_json(F.lit(json.dumps(spread)), "array<map<string,int>>")

    @cached_property
    def pieces(self) -> np.ndarray:
        """The bytes of each id."""
        table = np.full(max(self.ranks.values(), default=-1) + 1, b"", object)
        for token, rank in self.ranks.items():
            table[rank] = token
        return table


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _rank(maps: Column, piece: Column) -> Column:
    return F.try_element_at(F.get(maps, F.pmod(F.crc32(piece), F.lit(MAPS)).cast("int")), F.hex(piece))


def _pair_ranks(maps: Column, pieces: Column) -> Column:
    """The rank of each piece joined with the next; null where that is no token."""
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda x, i: _rank(maps, F.concat(x, F.get(pieces, i + 1))))


def _join(maps: Column, at_once: bool):
    """A step of the fold over (pieces ``p``, ranks of adjacent pieces ``r``)."""

    def joined(state: Column, least: Column) -> Column:
        hits = F.array_join(F.transform(state["r"], lambda x: F.when(x == least, "1").otherwise("0")), "")
        if at_once:  # a piece is joined to one other at most, from the left
            chosen = F.replace(hits, F.lit("11"), F.lit("10"))
        else:
            first = F.locate("1", hits)
            chosen = F.rpad(F.concat(F.repeat(F.lit("0"), first - 1), F.lit("1")), F.length(hits), F.lit("0"))

        def pieces(taken: Column) -> Column:
            whole = lambda x, i: F.when(F.get(taken, i) == "1", F.concat(x, F.get(state["p"], i + 1))).when((i == 0) | (F.get(taken, i - 1) == "0"), x)
            return _let(F.array_compact(F.transform(state["p"], whole)), lambda p: F.struct(p.alias("p"), _pair_ranks(maps, p).alias("r")))

        return _let(F.split(chosen, F.lit("")), pieces)

    def step(state: Column, _: Column) -> Column:
        return _let(F.array_min(state["r"]), lambda least: F.when(least.isNull(), state).otherwise(joined(state, least)))

    return step


def encode_word(word: Column, tokenizer: Ranks) -> Column:
    """Ids (array<int>) of a word (string): its own rank, or those of the pieces that the ranked merges leave."""
    body = word.cast("binary")
    n = F.octet_length(body)

    def folded(maps: Column) -> Column:
        single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(body, i, F.lit(1)))
        start = lambda p: F.struct(p.alias("p"), _pair_ranks(maps, p).alias("r"))
        ids = lambda s: F.transform(s["p"], lambda x: _rank(maps, x))
        return _let(single, lambda p: F.aggregate(F.sequence(F.lit(1), n), start(p), _join(maps, tokenizer.at_once), ids))

    none = F.array().cast("array<int>")
    return _let(tokenizer.maps, lambda maps: F.when(n == 0, none).otherwise(_let(_rank(maps, body), lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(folded(maps)))))


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the words of these rows, where each word begins and ends, and the number of words of each row."""
    lists = part["__words"]
    data, at = tokens.text_bytes(lists.flatten())
    return data, at[:-1], at[1:], lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _distinct(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: sorted hashes of its distinct words, where each comes first, the place of each word among them, and numbers of words by row."""
    hashes, counts = [], []
    for part in tokens.slices(rows, "__words"):
        data, starts, ends, n = _words(part)
        hashes.append(tokens.word_hashes(data, starts, ends))
        counts.append(n)
    place, new = pd.factorize(blocks.joined(hashes, np.uint64))  # no sort of all words
    first = np.empty(len(new), np.int64)
    first[place[::-1]] = np.arange(len(place) - 1, -1, -1)
    order = np.argsort(new)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return new[order], first[order], rank[place], blocks.joined(counts, np.int64)


def _word(line: Column) -> Column:
    for plain, marked in reversed(MARKED):
        line = F.replace(line, F.lit(marked), F.lit(plain))
    return line


def ask(docs: DataFrame, buckets: int) -> DataFrame:
    """Each block's distinct words, a row for each bucket that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in blocks.cut(batches, "__words"):
            keys, first, _, _ = _distinct(rows)
            words = rows["__words"].flatten().take(pa.array(first))
            for plain, marked in MARKED:
                words = pc.replace_substring(words, plain, marked)
            found = list(blocks.runs(keys, buckets))
            edges = np.array([0, *(run_of.stop for _, run_of in found)], np.int32)
            column = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), words), "\n")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), name)), pa.array([k for k, _ in found], pa.int32()), column], ["block", "bucket", "words"])

    return docs.select("__words").mapInArrow(run, ASKED)


def answer(asked: DataFrame, tokenizer: Ranks, buckets: int) -> DataFrame:
    """``block, bucket, lens, ids``: number of ids of each word asked for, and the ids in a row.

    The rows of a bucket are together, so grouping by word and by block within it needs no further shuffle.
    """
    lines = F.split("words", "\n", -1)
    each = asked.repartition(buckets, "bucket").select("bucket", "block", F.posexplode(lines).alias("nth", "line"))
    distinct = each.groupBy("bucket", "line").agg(F.collect_list(F.struct("block", "nth")).alias("places"))
    coded = distinct.select("bucket", "places", encode_word(_word(F.col("line")), tokenizer).alias("ids"))
    placed = coded.select("bucket", "ids", F.explode("places").alias("at")).select("bucket", "at.block", F.struct("at.nth", "ids").alias("a"))
    told = placed.groupBy("bucket", "block").agg(F.sort_array(F.collect_list("a")).alias("a"))
    return told.select("block", "bucket", F.transform("a", lambda x: F.size(x["ids"])).alias("lens"), F.flatten(F.transform("a", lambda x: x["ids"])).alias("ids"))


def pack(docs: DataFrame) -> DataFrame:
    """The blocks: their rows without the words, and the places of the words, by falling frequency so that they take little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in blocks.cut(batches, "__words"):
            keys, _, place, counts = _distinct(rows)
            order = np.argsort(-np.bincount(place, minlength=len(keys)), kind="stable")
            rank = np.empty(len(order), np.uint64)
            rank[order] = np.arange(len(order), dtype=np.uint64)
            whole = rows.drop_columns(["__words"]).append_column("__n", pa.array(counts))
            whole = whole.replace_schema_metadata({"order": base64.b64encode(blocks.squeeze(order)), "places": base64.b64encode(blocks.squeeze(rank[place]))})
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(whole)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([blocks.ITSELF], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block", "bucket", "body"])

    return docs.mapInArrow(run, blocks.PACKED)


def encode(docs: DataFrame, tokenizer: Ranks, keep: list[str] | None = None, text: str = "text", outputs: tuple[str, ...] = MADE) -> DataFrame:
    """The columns ``keep`` (all, if None) and ``outputs``, out of

    ``n_tokens`` long, ``ids`` array<int>, ``ids_sha256`` of the ids as little-endian 32-bit integers, ``decoded``
    binary (the pieces of the ids) and ``decoded_sha256``.

    Defined cases: null is encoded as empty text; empty texts have no tokens and decode to nothing; repeated rows give
    repeated results; columns of ``keep`` named like an output are replaced; names of special tokens are plain text.
    ``docs`` is read twice and should be a table that is read, or a checkpoint (see ``blocks``).
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    p = blocks.plan(docs, text)
    buckets = min(max(blocks.LEAST_BUCKETS, -(-p.buckets * blocks.BUCKET_BYTES // BUCKET_BYTES)), blocks.MOST_PARTITIONS)
    words = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(spark_pattern(tokenizer.pattern)), F.lit(0))
    source = docs.select(*(F.col(f"`{c}`") for c in keep), words.alias("__words"))
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_sha256": T.StringType(), "decoded": T.BinaryType(), "decoded_sha256": T.StringType()}
    schema = T.StructType([*(source.schema[c] for c in keep), *(T.StructField(c, kinds[c]) for c in outputs)])
    pieces = tokenizer.pieces if {"decoded", "decoded_sha256"} & {*outputs} else np.zeros(0, object)

    def solve(packed: pa.Buffer, lens: list[np.ndarray], flat: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = pa.ipc.open_stream(packed).read_all().combine_chunks().to_batches()[0]
        order, place = (blocks.expand(base64.b64decode(rows.schema.metadata[k])).astype(np.int64) for k in (b"order", b"places"))
        n_of, flat = blocks.joined(lens, np.int32).astype(np.int64), blocks.joined(flat, np.int32)
        blocks.fits(len(order) == len(n_of))
        begin = np.cumsum(n_of) - n_of
        upto = np.concatenate([[0], np.cumsum(rows["__n"].to_numpy())])
        for a, b in _runs(upto):
            word = order[place[upto[a] : upto[b]]]
            n = n_of[word]
            stops = np.cumsum(n)
            ids = flat[np.repeat(begin[word] - (stops - n), n) + np.arange(stops[-1] if len(stops) else 0)]
            edges = np.concatenate([[0], stops])[upto[a : b + 1] - upto[a]]
            each = [ids[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]
            made = {"n_tokens": lambda: pa.array(np.diff(edges))}
            made["ids"] = lambda: pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))
            made["ids_sha256"] = lambda: pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each])
            decoded = [b"".join(pieces[x].tolist()) for x in each] if len(pieces) else [b""] * len(each)
            made["decoded"] = lambda: pa.array(decoded, pa.binary())
            made["decoded_sha256"] = lambda: pa.array([hashlib.sha256(x).hexdigest() for x in decoded])
            part = rows.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(made[c]() for c in outputs)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, packed, lens, flat = None, None, [], []

        def solved() -> Iterator[pa.RecordBatch]:
            if name is not None:
                blocks.fits(packed is not None)
                yield from solve(packed, lens, flat)

        for batch in batches:
            for k, (block, bucket) in enumerate(zip(batch["block"].to_pylist(), batch["bucket"].to_pylist(), strict=True)):
                if block != name:
                    yield from solved()
                    name, packed, lens, flat = block, None, [], []
                if bucket == blocks.ITSELF:
                    packed = batch["body"][k].as_buffer()
                else:
                    lens.append(batch["lens"][k].values.to_numpy())
                    flat.append(batch["ids"][k].values.to_numpy())
        yield from solved()

    answers = answer(ask(source, buckets), tokenizer, buckets)
    none = lambda kind: F.lit(None).cast(kind)
    both = pack(source).select("block", "bucket", none("array<int>").alias("lens"), none("array<int>").alias("ids"), "body")
    both = both.unionByName(answers.select("block", "bucket", "lens", "ids", none("binary").alias("body")))
    return both.repartition(p.block_partitions, "block").sortWithinPartitions("block", "bucket").mapInArrow(run, schema)


def _runs(upto: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Rows in runs of about ``limit`` words; ``upto`` counts the words before each row."""
    group = upto[:-1] // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    return ((a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def decode(encoded: DataFrame, tokenizer: Ranks, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes (binary) of an id list. Null ids give null, unknown ids nothing."""
    source = encoded.drop(decoded)
    schema = T.StructType([*source.schema.fields, T.StructField(decoded, T.BinaryType())])
    pieces = tokenizer.pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch[batch.schema.get_field_index(ids)].to_pylist()
            whole = [None if x is None else b"".join(pieces[i] for i in x if i is not None and 0 <= i < len(pieces)) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole, pa.binary())], schema.names)

    return source.mapInArrow(run, schema)
