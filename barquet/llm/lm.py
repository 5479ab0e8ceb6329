"""Language-model scoring with a weighted backoff automaton.

The model is a word trigram model with Dirichlet smoothing, learned from all training texts without a cut-off; g is
the context h without its first word:

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(h w) + K p(w | g)) / (c(h) + K)      K by the length of h

As an automaton, every known word and pair of words is a state, and the root stands for no known context. A state has
an arc for each word that has followed it, weighted log10 p(w | h); any other word takes the state's failure arc,
weighted log10 K / (c(h) + K), to the state of g and goes on from there, at last with log10 p(w) from the root. A text
is scored by one traversal from left to right that carries the state and adds up weights.

The automaton of the whole corpus is never in one place: each block of texts asks for the counts of the words,
pairs and triples it has (``blocks``), and compiles just those states and arcs that its own texts can reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet.llm import blocks, tokens
from barquet.llm.graph import written

#: Weight of the shorter context against the counts of one of a word, and of two. Chosen on texts that may be learned from
#: alone (a seventh of them, by hash, was left out, and its negative log10 probability a token taken): 16, 64, 256, 1024 and 4096
#: for the first give 3.73, 3.59, 3.49, 3.43 and 3.40; 16 instead of 4 for the second 3.60 instead of 3.59.
DIRICHLET = (4096.0, 4.0)
ORDER = len(DIRICHLET) + 1
STRETCH = 256  #: tokens; more than ORDER
#: The token at the end of every text.
END = np.uint64(0x5851F42D4C957F2D)
ASKED = "block long, bucket int" + "".join(f", keys{k} binary, counts{k} binary" for k in range(ORDER))
MADE = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def _stream(part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the texts, each followed by END, as hashes; number of tokens of each text."""
    data, at = tokens.text_bytes(part[text])
    data = tokens.lower_ascii(data)
    starts, ends, n = tokens.word_bounds(data, at)
    stops = np.cumsum(n + 1) - 1
    out = np.empty(len(starts) + len(n), np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[stops] = True
    out[is_end] = END
    out[~is_end] = tokens.word_hashes(data, starts, ends)
    return out, n + 1


def _grams(stream: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one word, two and so on up to ``ORDER``: hashes of the grams, and where their last words stand in the stream."""
    nth = np.arange(len(stream)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ending = stream  # hash of the gram that ends at each token; of no meaning at the first tokens of a text
    for k in range(ORDER):
        if k:
            ending = np.concatenate([ending[:1], tokens.combine(ending[:-1], stream[1:])])
        at = np.flatnonzero(nth >= k)
        yield ending[at], at


def ask(docs: DataFrame, text: str, train: str, p: blocks.Plan) -> DataFrame:
    """Each block's distinct grams by range, with how often its training texts have them."""

    def ask_of(name: int, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [([], []) for _ in range(ORDER)]
        for part in tokens.slices(rows, text):
            stream, sizes = _stream(part, text)
            learn = np.repeat(part[train].to_numpy(zero_copy_only=False), sizes)
            for (keys, counts), (grams, at) in zip(found, _grams(stream, sizes), strict=True):
                k, n = blocks.counted([grams], [learn[at]])
                keys.append(k)
                counts.append(n)
        whole = [blocks.counted(*f) for f in found]
        where = [dict(blocks.runs(keys, p.ranges)) for keys, _ in whole]
        asked = []
        for k in sorted({b for w in where for b in w}):
            of = [w.get(k, slice(0, 0)) for w in where]
            asked.append((name, k, *_packed([(keys[w], n[w]) for (keys, n), w in zip(whole, of, strict=True)])))
        return blocks.rows_of(asked, ASKED) if asked else None

    return tokens.mapped(docs, lambda batches: blocks.each(batches, text, ask_of), ASKED)


def _packed(grams: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    """Keys and counts of the grams of each length."""
    return [x for keys, n in grams for x in (blocks.gaps(keys), blocks.squeeze(n))]


def _split(row: dict, p: blocks.Plan) -> list[dict]:
    """What a block asks of a range, by its buckets."""
    grams = [(blocks.from_gaps(row[f"keys{k}"]), blocks.expand(row[f"counts{k}"])) for k in range(ORDER)]
    at = [blocks.within(keys, row["bucket"], p) for keys, _ in grams]
    names = [c.split()[0] for c in ASKED.split(", ")]
    out = []
    for k in range(p.within):
        of = [slice(x[k], x[k + 1]) for x in at]
        if any(w.stop > w.start for w in of):
            parts = [(keys[w], n[w]) for (keys, n), w in zip(grams, of, strict=True)]
            out.append(dict(zip(names, (row["block"], row["bucket"] * p.within + k, *_packed(parts)), strict=True)))
    return out


def answer(asked: DataFrame, p: blocks.Plan) -> DataFrame:
    """Total counts, to each block in the order asked: ``body``; each bucket's training tokens and distinct ones: ``n, v``."""

    def resolve(rows: list[dict]) -> list[tuple]:
        totals, columns = [], []
        for k in range(ORDER):
            lists = [blocks.from_gaps(r[f"keys{k}"]) for r in rows]
            distinct, total = blocks.counted(lists, [blocks.expand(r[f"counts{k}"]) for r in rows])
            columns.append([total[np.searchsorted(distinct, x)] for x in lists])
            totals.append(total)
        bodies = [np.array([len(x) for x in own], "<i8").tobytes() + blocks.squeeze(np.concatenate(own)) for own in zip(*columns, strict=True)]
        n, v = int(totals[0].sum()), int((totals[0] > 0).sum())
        first = [1] + [0] * (len(bodies) - 1)  # a bucket's totals stand in one of its rows
        return [(r["block"], r["bucket"], body, n * f, v * f) for r, body, f in zip(rows, bodies, first, strict=True)]

    return blocks.answer(asked, p, _split, resolve, ", n long, v long")


def _counts(body: bytes) -> list[np.ndarray]:
    """A bucket's answer to a block, by length of the grams."""
    sizes = np.frombuffer(body, "<i8", ORDER)
    return np.split(blocks.expand(body[8 * ORDER :]), np.cumsum(sizes)[:-1])


@dataclass
class Gram:
    """The distinct grams of one length: how often training has them, and the numbers of the grams without their last word
    and without their first."""

    count: np.ndarray
    context: np.ndarray
    shorter: np.ndarray


@dataclass
class Automaton:
    """States and arcs that the texts of a block can reach.

    A state is the number of a gram: words come first, then pairs, ... and the root, which is the last. It reads a word
    along the arc of the gram that is one word longer than its own.
    """

    arcs: list[np.ndarray]  #: weight of each gram's arc, by length; NaN if training doesn't have it (and last, for number -1)
    length: np.ndarray  #: words in each state's gram
    fail: np.ndarray  #: weight of each state's failure arc; the root has none
    failed: np.ndarray  #: state that it leads to
    goto: list[np.ndarray]  #: state after each gram, by length: that of the longest of its ends that training has

    @classmethod
    def compile(cls, grams: list[Gram], n: int, v: int) -> Automaton:
        """From the counts of the grams of each length. Counts are exact up to 2**53."""
        counts = [g.count.astype(np.float64) for g in grams]
        p, arcs = (counts[0] + 1.0) / (n + v + 1), []
        arcs.append(np.log10(p))
        first = np.cumsum([0, *(len(c) for c in counts[:-1])])  # states of a length begin here, the root at the end
        root = int(first[-1])
        length, fail, failed = np.zeros(root + 1, np.int8), np.zeros(root + 1), np.full(root + 1, root)
        goto: list[np.ndarray] = []
        for k, (gram, count) in enumerate(zip(grams, counts, strict=True)):
            shorter = goto[-1][gram.shorter] if k else np.full(len(count), root)
            if k:
                weight, of = DIRICHLET[k - 1], counts[k - 1][gram.context]
                p = (count + weight * p[gram.shorter]) / (of + weight)
                arcs.append(np.append(np.where(count > 0, np.log10(p), np.nan), np.nan))
            if k + 1 == len(grams):
                goto.append(np.append(shorter, root))
                break
            states = slice(int(first[k]), int(first[k + 1]))
            length[states], failed[states] = k + 1, shorter
            fail[states] = np.log10(DIRICHLET[k] / (count + DIRICHLET[k]))
            goto.append(np.append(np.where(count > 0, np.arange(states.start, states.stop), shorter), root))
        return cls(arcs, length, fail, failed, goto)

    def traverse(self, numbers: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """The weight of every text. ``numbers`` are those of the gram of each length that ends at each token, -1 where the
        text has no such gram yet.

        Texts are walked in stretches of ``STRETCH`` tokens. The state that a stretch hands to the next one is that of the
        last gram in it, so all stretches advance together by a token a step, longest first: those running are a prefix.
        """
        begin = np.cumsum(sizes) - sizes
        parts = -(-sizes // STRETCH)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(begin, parts) + nth * STRETCH
        lengths = np.minimum(np.repeat(begin + sizes, parts) - starts, STRETCH)
        order = np.argsort(-lengths, kind="stable")
        starts = starts[order]
        running = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
        handed = self.goto[-2][numbers[-2][starts - 1]]
        state, total = np.where(nth[order] == 0, len(self.fail) - 1, handed), np.zeros(len(starts))
        for t, n in enumerate(running):
            at, now = starts[:n] + t, state[:n].copy()
            going = np.ones(n, bool)
            for k in range(len(self.arcs) - 1, 0, -1):
                here = going & (self.length[now] == k)
                gram = numbers[k][at]
                weight = self.arcs[k][gram]  # of no meaning where the text has no such gram yet
                none = np.isnan(weight)
                read, stuck = here & ~none, here & none
                total[:n] += np.where(read, weight, np.where(stuck, self.fail[now], 0.0))
                state[:n] = np.where(read, self.goto[k][gram], state[:n])
                now = np.where(stuck, self.failed[now], now)
                going &= ~read
            word = numbers[0][at]
            total[:n] += np.where(going, self.arcs[0][word], 0.0)
            state[:n] = np.where(going, self.goto[0][word], state[:n])
        whole = np.zeros(len(order))
        whole[order] = total
        return np.add.reduceat(whole, np.cumsum(parts) - parts)


def score(docs: DataFrame, train: str = "train", keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (all, if None) with ``n_tokens, n_known, train_tokens, base_score, score``.

    The rows where the boolean column ``train`` is true are learned from; all are scored. Words are lower-cased in
    A-Z; the end of a text is a token. ``n_known`` counts tokens that training has, ``base_score`` is the text's
    log10 probability under p(w) alone, ``score`` that of the automaton.

    Defined cases: null text is empty text, which is just its end; null ``train`` is false; without training texts
    every token has probability 1; columns of ``keep`` named like a result are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in MADE]
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))
    p = blocks.plan(docs, text)
    learn = docs.select(F.col(f"`{text}`").alias("__text"), F.coalesce(F.col(f"`{train}`"), F.lit(False)).alias("__train"))
    answers = written(answer(ask(learn, "__text", "__train", p), p))
    n, v = (x or 0 for x in answers.agg(F.sum("n"), F.sum("v")).first())
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*(source.schema[c] for c in keep), *(T.StructField(c, k) for c, k in zip(MADE, kinds, strict=True))])

    def solve(rows: pa.RecordBatch, got: list[bytes]) -> Iterator[pa.RecordBatch]:
        answered = [_counts(body) for body in got]
        counts = [blocks.joined([c[k] for c in answered], np.uint64) for k in range(ORDER)]
        parts = list(tokens.slices(rows, "__text"))
        own = zip(*([blocks.distinct(keys) for keys, _ in _grams(*_stream(part, "__text"))] for part in parts), strict=True)
        known = [blocks.distinct(np.concatenate(keys)) for keys in own]
        blocks.fits([len(k) for k in known] == [len(c) for c in counts])
        for part in parts:
            stream, sizes = _stream(part, "__text")
            grams: list[Gram] = []
            numbers: list[np.ndarray] = []
            for k, (keys, at) in enumerate(_grams(stream, sizes)):
                distinct, where, place = np.unique(keys, return_index=True, return_inverse=True)
                number, last = np.full(len(stream), -1, np.int32), at[where]
                number[at] = place
                context, shorter = (numbers[k - 1][last - 1], numbers[k - 1][last]) if k else (number[:0], number[:0])
                grams.append(Gram(counts[k][np.searchsorted(known[k], distinct)], context, shorter))
                numbers.append(number)
            model = Automaton.compile(grams, n, v)
            texts = np.cumsum(sizes) - sizes
            made = (
                pa.array(sizes.astype(np.int64)),
                pa.array(np.add.reduceat((grams[0].count > 0)[numbers[0]].astype(np.int64), texts)),
                pa.array(np.full(len(sizes), n, np.int64)),
                pa.array(np.add.reduceat(model.arcs[0][numbers[0]], texts)),
                pa.array(model.traverse(numbers, sizes)),
            )
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *made], schema.names)

    return blocks.finish(source, answers, "__text", p, solve, schema)
