"""Byte-pair encoding and decoding by a table of distinct words.

Texts are split into words at ASCII white space, which no token of the tokenizer spans. Each block of texts sends its
distinct words; the buckets of the distinct-word table encode every distinct word once; the ids come back to the
block and are put together by the words' positions. Decoding joins the ids with the tokenizer's table of pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet.llm import blocks, tokens

ASKED = "block long, bucket int, words string"
MADE = ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")


def read_tokenizer(path: str) -> str:
    """The tokenizer's JSON, read where the job starts and sent along with its tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(1)
def _tokenizer(definition: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(definition)
    made.no_truncation()
    made.no_padding()
    return made


@lru_cache(1)
def _pieces(definition: str) -> np.ndarray:
    """The id-to-piece table: its size is that of the vocabulary."""
    made = _tokenizer(definition)
    table = np.full(max(made.get_vocab().values()) + 1, b"", object)
    for piece, k in made.get_vocab().items():
        table[k] = piece.encode()
    return table


def _encode(words: list[str], definition: str) -> list[list[int]]:
    made = _tokenizer(definition)
    return [made.encode(w, add_special_tokens=False).ids for w in words]


def _distinct(rows: pa.RecordBatch, text: str) -> tuple[np.ndarray, list[bytes]]:
    """Sorted hashes of a block's distinct words, and the words."""
    hashes, words = [], []
    for part in tokens.slices(rows, text):
        data, at = tokens.text_bytes(part[text])
        starts, ends, _ = tokens.word_bounds(data, at)
        h, first = np.unique(tokens.word_hashes(data, starts, ends), return_index=True)
        body = data.tobytes()
        hashes.append(h)
        words += [body[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    h, first = np.unique(np.concatenate(hashes), return_index=True)
    return h, [words[k] for k in first.tolist()]


def ask(docs: DataFrame, text: str, p: blocks.Plan) -> DataFrame:
    """Each block's distinct words by range, a line each."""

    def asked(name: int, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, words = _distinct(rows, text)
        lines = [(name, k, b"\n".join(words[run_of]).decode("utf-8", "replace")) for k, run_of in blocks.runs(keys, p.ranges)]
        return blocks.rows_of(lines, ASKED) if lines else None

    return tokens.mapped(docs, lambda batches: blocks.each(batches, text, asked), ASKED)


def _split(row: dict, p: blocks.Plan) -> list[dict]:
    """What a block asks of a range, by its buckets."""
    words = row["words"].split("\n")
    data, at = tokens.text_bytes(pa.array([row["words"]]))
    at = blocks.within(tokens.word_hashes(data, *tokens.word_bounds(data, at)[:2]), row["bucket"], p)
    return [{"block": row["block"], "bucket": row["bucket"] * p.within + k, "words": "\n".join(words[a:b])} for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]


def answer(asked: DataFrame, definition: str, p: blocks.Plan) -> DataFrame:
    """Encode each distinct word of a bucket once, and answer each block with its words' ids in the order asked."""

    def resolve(rows: list[dict]) -> list[tuple]:
        known: dict[str, list[int]] = {}
        out = []
        packer = zstandard.ZstdCompressor()
        for row in rows:
            words = row["words"].split("\n")
            new = [w for w in words if w not in known]
            known.update(zip(new, _encode(new, definition), strict=True))
            ids = [known[w] for w in words]
            counts = np.array([len(x) for x in ids], np.uint32)
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))
            out.append((row["block"], row["bucket"], packer.compress(len(counts).to_bytes(8, "little") + counts.tobytes() + flat.tobytes())))
        return out

    return blocks.answer(asked, p, _split, resolve)


def _read_answer(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw, np.uint32, n, 8), np.frombuffer(raw, np.uint32, offset=8 + 4 * n)


def encode(docs: DataFrame, definition: str, keep: list[str] | None = None, text: str = "text", outputs: tuple[str, ...] = MADE) -> DataFrame:
    """The columns ``keep`` (all, if None) and ``outputs``, out of

    ``n_tokens`` long, ``ids`` array<int>, ``ids_sha256`` of the ids as little-endian 32-bit integers, ``decoded``
    (the pieces of the ids joined by a blank, as the tokenizer decodes) and ``decoded_sha256`` of its UTF-8 form.

    Defined cases: null is encoded as empty text; empty texts have no tokens and decode to empty text; repeated rows
    give repeated results; columns of ``keep`` named like an output are replaced. Other than the tokenizer's own,
    no limit holds for the length of a text or word.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))
    p = blocks.plan(docs, text)
    answers = answer(ask(source.select("__text"), "__text", p), definition, p)
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}
    schema = T.StructType([*(source.schema[c] for c in keep), *(T.StructField(c, kinds[c]) for c in outputs)])

    def solve(rows: pa.RecordBatch, got: list[bytes]) -> Iterator[pa.RecordBatch]:
        answers = [_read_answer(x) for x in got]
        counts, flat = (blocks.joined([x[i] for x in answers], np.uint32) for i in range(2))
        begin = np.cumsum(counts.astype(np.int64)) - counts
        known, parts = [], []
        for part in tokens.slices(rows, "__text"):
            data, at = tokens.text_bytes(part["__text"])
            starts, ends, n_words = tokens.word_bounds(data, at)
            h = tokens.word_hashes(data, starts, ends)
            parts.append((part, h, n_words))
            known.append(blocks.distinct(h))
        keys = blocks.distinct(np.concatenate(known))
        blocks.fits(len(keys) == len(counts))
        pieces = _pieces(definition)
        for part, h, n_words in parts:
            word = np.searchsorted(keys, h)
            n = counts[word].astype(np.int64)
            stops = np.cumsum(n)
            ids = flat[np.repeat(begin[word] - (stops - n), n) + np.arange(stops[-1] if len(stops) else 0)]
            edges = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(n_words)])]
            each = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            made = {"n_tokens": lambda: pa.array(np.diff(edges))}
            made["ids"] = lambda: pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))
            made["ids_sha256"] = lambda: pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each])
            decoded = [b" ".join(pieces[x].tolist()) for x in each] if {"decoded", "decoded_sha256"} & {*outputs} else []
            made["decoded"] = lambda: pa.array([x.decode() for x in decoded])
            made["decoded_sha256"] = lambda: pa.array([hashlib.sha256(x).hexdigest() for x in decoded])
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(made[c]() for c in outputs)], schema.names)

    return blocks.finish(source, answers, "__text", p, solve, schema)


def decode(encoded: DataFrame, definition: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text of an id list: the id-to-piece join on rows that hold their ids. Null ids give null, unknown ids nothing."""
    source = encoded.drop(decoded)
    schema = T.StructType([*source.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(definition)
        for batch in batches:
            lists = batch[batch.schema.get_field_index(ids)].to_pylist()
            texts = [None if x is None else b" ".join(pieces[i] for i in x if i is not None and 0 <= i < len(pieces) and pieces[i]).decode() for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return tokens.mapped(source, run, schema)
