"""Language identification of whole texts, with spans for texts of mixed language.

Every word is scored under each learned language: the script of its letters narrows the languages that can be meant,
and smoothed letter n-grams (pairs, triples, triples at word ends, whole words, all hashed into a fixed number of
slots) give each of these a log-probability. A Viterbi pass over the words, in which a change of language costs a
fixed penalty, then labels each word; runs of a label are the spans of a text, and the label of most letters is its
language.

The model is small, whatever the input: ``KINDS * SLOTS`` numbers for each language. Every label is learned; beyond
``FULL`` labels neighbouring slots are shared, so that the model, and what a task holds, stay as large (down to ``LEAST_SLOTS`` slots
of a kind, which are 8 KB a label). It is fitted on about ``per_language`` labelled texts of each language at most, taken by a hash of the text;
everything is predicted.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet.llm import tokens

UNDETERMINED = "und"
SLOTS, KINDS = 1 << 15, 4
FULL, LEAST_SLOTS = 64, 1 << 8  #: labels with all slots to themselves; slots of a kind that labels have at least
READ_BYTES, LABEL_BYTES = 1 << 19, 4 << 20  #: bytes of text whose letters, and whose words, a task holds in arrays

#: Code point ranges of scripts. Letters outside them form one more group.
SCRIPTS = (
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Latin", 0x2C60, 0x2C7F), ("Latin", 0xA720, 0xA7FF), ("Latin", 0xFF21, 0xFF5A),
    ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x0400, 0x052F), ("Cyrillic", 0x1C80, 0x1C8F), ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F), ("Arabic", 0x08A0, 0x08FF), ("Arabic", 0xFB50, 0xFEFC),
    ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Tamil", 0x0B80, 0x0BFF),
    ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F), ("Sinhala", 0x0D80, 0x0DFF), ("Thai", 0x0E00, 0x0E7F),
    ("Lao", 0x0E80, 0x0EFF), ("Tibetan", 0x0F00, 0x0FFF), ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF), ("Ethiopic", 0x1200, 0x139F),
    ("Khmer", 0x1780, 0x17FF), ("Mongolian", 0x1800, 0x18AF), ("Kana", 0x3040, 0x30FF), ("Hangul", 0x1100, 0x11FF), ("Hangul", 0xAC00, 0xD7AF),
    ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Han", 0xF900, 0xFAFF), ("Han", 0x20000, 0x3134F),
)
N_SCRIPTS = len({name for name, _, _ in SCRIPTS}) + 2

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a letter, its script (0: neither letter nor mark), its lower case."""
    kind = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)
    letter = kind == ord("L")
    script = np.where(letter | (kind == ord("M")), N_SCRIPTS - 1, 0).astype(np.uint8)
    number = {name: i + 1 for i, name in enumerate(dict.fromkeys(name for name, _, _ in SCRIPTS))}
    for name, a, b in SCRIPTS:
        part = script[a : b + 1]
        part[part > 0] = number[name]
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter):
        if len(s := chr(c).lower()) == 1:
            lower[c] = ord(s)
    return letter, script, lower


@dataclass
class Words:
    """Words (runs of letters and marks) of some texts."""

    first: np.ndarray  #: first and last code point of each, within its text
    last: np.ndarray
    per_text: np.ndarray  #: number of words of each text
    letters: np.ndarray
    script: np.ndarray
    of_char: np.ndarray  #: the word of each kept code point
    slots: list[np.ndarray]  #: the slot of each kept code point (kinds 0, 1) or word (kinds 2, 3)


def read_words(texts: pa.Array) -> Words:
    letter, script, lower = _tables()
    points, begin = tokens.code_points(*tokens.text_bytes(texts))
    scripts = script[points]
    inside = scripts > 0
    edge = np.zeros(len(points) + 1, bool)
    edge[begin] = True
    opens = inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]) if len(points) else inside
    at = np.flatnonzero(inside)
    word = np.cumsum(opens[at]) - 1
    n = int(word[-1]) + 1 if len(word) else 0
    low = lower[points[at]].astype(np.uint64)
    starts = np.flatnonzero(opens[at])
    same1 = np.concatenate([[False], word[1:] == word[:-1]]) if len(word) else np.zeros(0, bool)
    same2 = np.concatenate([[False] * 2, word[2:] == word[:-2]])[: len(word)]
    one = np.where(same1, np.concatenate([[0], low[:-1]])[: len(low)], 0).astype(np.uint64)
    two = np.where(same2, np.concatenate([[0, 0], low[:-2]])[: len(low)], 0).astype(np.uint64)
    ends = np.concatenate([starts[1:], [len(at)]])[: len(starts)] - 1
    slot = lambda h: (h & np.uint64(SLOTS - 1)).astype(np.int64)
    with np.errstate(over="ignore"):
        pair = tokens.mix64(low * np.uint64(0x9E3779B97F4A7C15) + one)
        triple = tokens.combine(pair, two)
        end = tokens.combine(pair[ends], np.uint64(7))
        whole = np.add.reduceat(tokens.mix64(triple + np.uint64(1)), starts) if n else np.zeros(0, np.uint64)
    letters = np.bincount(word, weights=letter[points[at]], minlength=n).astype(np.int64)
    real = letters > 0
    text_of = np.searchsorted(begin, at[starts], side="right") - 1
    if not real.all():  # marks without a letter are no words
        new = np.cumsum(real) - 1
        keep = real[word]
        word, pair, triple = new[word[keep]], pair[keep], triple[keep]
        starts, ends, end, whole, letters, text_of = (x[real] for x in (starts, ends, end, whole, letters, text_of))
    return Words(
        first=at[starts] - begin[text_of],
        last=at[ends] - begin[text_of],
        per_text=np.bincount(text_of, minlength=len(texts)),
        letters=letters,
        script=scripts[at[starts]],
        of_char=word,
        slots=[slot(pair), slot(triple), slot(end), slot(tokens.mix64(whole))],
    )


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  #: KINDS x (SLOTS >> shift) x languages, log-probabilities over KINDS
    scripts: np.ndarray  #: scripts x languages, whether the language uses the script
    prior: np.ndarray
    penalty: float
    shift: int = 0  #: so many bits of a slot don't count

    def scores(self, words: Words) -> np.ndarray:
        n = len(words.letters)
        slots = [x >> self.shift for x in words.slots]
        out = self.weights[2][slots[2]] + self.weights[3][slots[3]]
        if n:
            first = np.searchsorted(words.of_char, np.arange(n))
            step = max(1, (1 << 22) // len(self.languages))
            cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(words.of_char), step)), n))
            for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=True):  # bounded rows at a time
                if b > a:
                    part = slice(first[a], first[b] if b < n else None)
                    out[a:b] += np.add.reduceat(self.weights[0][slots[0][part]] + self.weights[1][slots[1][part]], first[a:b] - first[a])
        allowed = self.scripts[words.script]
        return np.where(allowed.any(1)[:, None], np.where(allowed, out, -1e4), 0.0).astype(np.float32)


def viterbi(scores: np.ndarray, per_text: np.ndarray, prior: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word, if a change of label costs ``penalty``; ties go to the smaller label.

    All texts advance together, a word at a time, longest first, so that those still running are always a prefix.
    """
    begin = np.cumsum(per_text) - per_text
    order = np.argsort(-per_text, kind="stable")
    order = order[per_text[order] > 0]
    starts, lengths = begin[order], per_text[order]
    kind = np.int16 if scores.shape[1] < 1 << 15 else np.int32
    labels = np.zeros(len(scores), kind)
    if not len(order):
        return labels
    running = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    stay, source = np.ones(scores.shape, bool), np.zeros(len(scores), kind)
    best = scores[starts].astype(np.float64) + prior
    for t in range(1, lengths[0]):
        n = running[t]
        at, now = starts[:n] + t, best[:n]
        top = now.argmax(1)
        change = now[np.arange(n), top] - penalty
        keeps = now >= change[:, None]
        stay[at], source[at] = keeps, top
        best[:n] = np.where(keeps, now, change[:, None]) + scores[at]
    label = best.argmax(1)
    for t in range(lengths[0] - 1, -1, -1):
        n = running[t]
        at, now = starts[:n] + t, label[:n]
        labels[at] = now
        label[:n] = np.where(stay[at, now], now, source[at])
    return labels


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 2000, penalty: float = 6.0) -> Model:
    """Learn from rows whose text and ``lang`` aren't null, about ``per_language`` of each language at most.

    Where no row is labelled there is nothing to learn, and the model calls every text ``und``. All labels are learned.
    """
    usable = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((KINDS, SLOTS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool), np.zeros(0), penalty)
    spark, shift = docs.sparkSession, 0
    while len(languages) > FULL << shift and SLOTS >> (shift + 1) >= LEAST_SLOTS:
        shift += 1
    share = spark.createDataFrame([(k, min(1.0, per_language / counts[k])) for k in languages], "lang string, share double")
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    slot = F.when(F.col("slot") < KINDS * SLOTS, F.shiftright("slot", shift)).otherwise(F.col("slot") - KINDS * (SLOTS - (SLOTS >> shift))).cast("int")
    counted = tokens.mapped(usable.join(F.broadcast(share), "lang").where(drawn).select("text", "lang"), _count, "lang string, slot int, n long")
    rows = counted.groupBy("lang", slot.alias("slot")).agg(F.sum("n").alias("n")).toArrow()
    slots = SLOTS >> shift
    scripts = KINDS * slots
    table = np.zeros((scripts + N_SCRIPTS, len(languages)))
    who = np.searchsorted(languages, rows["lang"].to_pylist()) if rows.num_rows else np.zeros(0, int)
    table[rows["slot"].to_numpy(), who] = rows["n"].to_numpy()
    letters = table[scripts:]
    grams = table[:scripts].reshape(KINDS, slots, len(languages)) + 0.5
    return Model(
        languages,
        (np.log(grams / grams.sum(1, keepdims=True)) / KINDS).astype(np.float32),
        letters >= 0.01 * np.maximum(letters.sum(0), 1),
        np.log([max(counts[k], 1) / sum(counts.values()) for k in languages]),
        penalty,
        shift,
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots that the texts of each language fill; those after the n-grams count letters by script."""
    totals: dict[str, np.ndarray] = {}
    size = KINDS * SLOTS + N_SCRIPTS
    for batch in batches:
        for part in tokens.slices(batch, "text", READ_BYTES):
            for name in pc.unique(part["lang"]).to_pylist():
                words = read_words(part["text"].filter(pc.equal(part["lang"], name)))
                total = totals.setdefault(name, np.zeros(size, np.int64))
                for k, slots in enumerate(words.slots):
                    total[k * SLOTS : (k + 1) * SLOTS] += np.bincount(slots, minlength=SLOTS)
                total[KINDS * SLOTS :] += np.bincount(words.script, weights=words.letters, minlength=N_SCRIPTS).astype(np.int64)
    for name, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "slot", "n"])


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (all, if None) with ``lang_pred, score, in_script, lang_spans``. A map over rows without a shuffle.

    ``lang_pred`` is the language of most letters (ties: the smaller name), ``score`` its share of the letters,
    ``in_script`` the share of the letters that are in a script of that language (0 for ``und``);
    spans are (start, end, lang) in characters. Texts that are null or have no letter get ``und``, score 0 and no
    spans; letters in scripts of no learned language take the language of the words around them, or the most
    frequent one. Columns of ``keep`` named like a result are replaced.
    """
    made = ("lang_pred", "score", "in_script", "lang_spans")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    carried = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))
    fields = [carried.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("in_script", T.DoubleType()), T.StructField("lang_spans", T.ArrayType(SPAN))])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "__text", _fewer(LABEL_BYTES, model)):
                columns = _label(part, model)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *columns], [*keep, *made])
                tokens.give_back()

    return tokens.mapped(carried, label, schema)


def _fewer(limit: int, model: Model) -> int:
    """Bytes of text at a time, of which each word has a number for each language."""
    return max(1 << 14, limit * FULL // max(FULL, len(model.languages)))


def _label(part: pa.RecordBatch, model: Model) -> list[pa.Array]:
    n_lang, n = len(model.languages), part.num_rows
    if not n_lang:
        return [pa.array([UNDETERMINED] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n)), pa.array([[]] * n, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))]
    pieces = []
    for p in tokens.slices(part, "__text", _fewer(READ_BYTES, model)):
        w = read_words(p["__text"])
        pieces.append((model.scores(w), w.per_text, w.letters.astype(np.int32), w.first.astype(np.int32), w.last.astype(np.int32), w.script))
    scores, per_text, letters, first, last, script = (np.concatenate(x) for x in zip(*pieces, strict=True))
    labels = viterbi(scores, per_text, model.prior, model.penalty)
    text_of = np.repeat(np.arange(n), per_text)
    share = np.bincount(text_of * n_lang + labels, weights=letters, minlength=n * n_lang).reshape(n, n_lang)
    total = share.sum(1)
    names = np.array([*model.languages, UNDETERMINED], dtype=object)
    top = np.where(total > 0, share.argmax(1), n_lang)
    usual = np.append(model.scripts, np.zeros((len(model.scripts), 1), bool), axis=1)[script, top[text_of]]
    in_script = np.bincount(text_of[usual], weights=letters[usual], minlength=n)
    opens = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (text_of[1:] != text_of[:-1])])) if len(labels) else np.zeros(0, int)
    closes = np.append(opens[1:], len(labels)) - 1 if len(opens) else opens
    spans = pa.StructArray.from_arrays(
        [pa.array(first[opens]), pa.array(last[closes] + 1), pa.array(names[labels[opens]], pa.string())], ["start", "end", "lang"]
    )
    at = np.searchsorted(text_of[opens], np.arange(n + 1)).astype(np.int32)
    return [pa.array(names[top], pa.string()), pa.array(share.max(1) / np.maximum(total, 1)), pa.array(in_script / np.maximum(total, 1)), pa.ListArray.from_arrays(pa.array(at), spans)]
