"""Toxicity by a weighted finite-state pattern grammar.

Words and marks become symbols: insult, threat, target, negation, reported
speech, a pause (comma, colon, quote, bracket), the end of a clause, or nothing.
Five transducers read them one after another, each the symbols that the one
before it wrote: negation turns insults and threats within its reach into denied
ones, up to the next pause; reported speech and target mark the end of the clause
in which they stand, before or after the match; insult and threat add to that end
what they saw. ``compose`` makes one machine of them. At the end of a clause it
emits its matches with their context, and the weights of the contexts, learnt
from labels, score the clauses of a text. So "not a fool" and "they said: you
fool" weigh differently from "you fool" if the labels say so. A context that the
labels rarely show starts from the weights stated below.

The lexicons hold fixed words and, for insults, markers learnt from labelled
texts: words and word beginnings that toxic texts have and others lack. Counts
cover whole texts. Null and empty texts match nothing and get the score of such
texts. Without labels the stated weights hold. Null labels and labels without
a document are ignored; repeated rows are scored each for itself; an empty table
gives no row; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import words as W
from lodestream.llm.quality_classifier import SUMS, _matrix, _sum_rows, bucket
from lodestream.llm.near_dedup import sketches
from lodestream.llm.store import stored

# Small lexicons, lower case, of four languages.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash clown clowns worthless pathetic disgusting dumb fool fools imbecile jerk bastard bitch asshole dumbass dumm idioten trottel abschaum arschloch imbécile connard salaud idiote estúpido imbécil basura escoria".split()
THREATS = "kill murder destroy hurt beat shoot stab strangle burn töten umbringen vernichten tuer détruire frapper matar destruir golpear".split()
TARGETS = "you your yours u they them their he him she her these those du dich dir ihr euch sie tu toi te vous ils elles eux usted ustedes ellos ellas vosotros".split()
NEGATIONS = "not no never none n't isn't aren't don't nicht kein keine nie ne pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say told called quoted wrote claimed reported sagte sagen nannte dit disait appelé dijo dice llamó".split()

NOTHING, INSULT, THREAT, TARGET, NEGATION, REPORT, PAUSE, END = range(8)
DENIED = {INSULT: -INSULT, THREAT: -THREAT}
#: A negation reaches so many words.
REACH = 6
#: Contexts of a match: insult or threat, by target, negation, report.
CONTEXTS = [(kind, t, n, r) for kind in (INSULT, THREAT) for t, n, r in product((0, 1), repeat=3)]
#: Log-odds that a match adds before labels are seen.
PRIOR = np.array([(1.5 if kind == INSULT else 0.4) + 0.8 * t - 1.0 * n - 0.8 * r for kind, t, n, r in CONTEXTS])
BIAS, PRIOR_ROWS = -2.0, 2.0
#: Labelled texts that markers are learnt from at most, markers kept at most, toxic texts that must show one, its odds.
MARKER_TEXTS, MARKERS, MARKER_LEAST, MARKER_ODDS = 50_000, 2_000, 5, 30.0
BEGINNINGS = (4, 5, 6, 8)
_BREAK, _PAUSE = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?;\n"]] = True
_PAUSE[[ord(c) for c in ",:\"()"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LETTER[39] = True


@dataclass
class Transducer:
    """``step`` gives the next state and the symbol written, by state and symbol read; what it doesn't list leaves both alone."""

    start: Hashable
    step: dict[tuple[Hashable, Hashable], tuple[Hashable, Hashable]]

    def read(self, state: Hashable, symbol: Hashable) -> tuple[Hashable, Hashable]:
        return self.step.get((state, symbol), (state, symbol))


def _negation() -> Transducer:
    """The state is how many words it still reaches."""
    step: dict = {}
    for left in range(REACH + 1):
        step |= {(left, s): (max(0, left - 1), DENIED.get(s, s) if left else s) for s in (NOTHING, INSULT, THREAT, TARGET, REPORT)}
        step |= {(left, NEGATION): (REACH, NOTHING), (left, PAUSE): (0, NOTHING), (left, END): (0, END)}
    return Transducer(0, step)


def _marks(symbol: int, ends: list[tuple | int]) -> Transducer:
    """Adds to the end of a clause whether the symbol stood in it."""
    wrap = lambda e: e if isinstance(e, tuple) else (e,)
    return Transducer(0, {(s, symbol): (1, NOTHING) for s in (0, 1)} | {(s, e): (0, (*wrap(e), s)) for s in (0, 1) for e in ends})


def _matches(symbol: int, ends: list[tuple]) -> Transducer:
    """Adds to the end of a clause whether the symbol stood in it: 2 yes, 1 only denied, 0 no."""
    step = {(s, symbol): (2, NOTHING) for s in range(3)} | {(s, DENIED[symbol]): (max(1, s), NOTHING) for s in range(3)}
    return Transducer(0, step | {(s, e): (0, (*e, s)) for s in range(3) for e in ends})


def compose(one: Transducer, two: Transducer, alphabet: Iterable[Hashable] = range(8)) -> Transducer:
    """The machine that reads as ``one`` does and writes what ``two`` makes of it."""
    start = (one.start, two.start)
    step, todo = {}, [start]
    seen = {start}
    while todo:
        a, b = state = todo.pop()
        for symbol in alphabet:
            to_a, middle = one.read(a, symbol)
            to_b, out = two.read(b, middle)
            step[state, symbol] = (to_a, to_b), out
            if (to_a, to_b) not in seen:
                seen.add((to_a, to_b))
                todo.append((to_a, to_b))
    return Transducer(start, step)


def grammar_machine() -> Transducer:
    flags = lambda *of: [(END, *x) for x in product(*of)]
    two, three = (0, 1), (0, 1, 2)
    return reduce(compose, [_negation(), _marks(REPORT, [END]), _marks(TARGET, flags(two)), _matches(INSULT, flags(two, two)), _matches(THREAT, flags(two, two, three))])


def tables(machine: Transducer) -> tuple[list[list[int]], list[list[int]]]:
    """Next states by state and symbol; contexts emitted by state when a clause ends."""
    number = {machine.start: 0} | {s: i + 1 for i, s in enumerate(sorted({s for s, _ in machine.step} - {machine.start}, key=str))}
    step, emit = [[0] * 8 for _ in number], [[] for _ in number]
    for (state, symbol), (to, out) in machine.step.items():
        step[number[state]][symbol] = number[to]
        if symbol == END:
            _, report, target, insult, threat = out
            emit[number[state]] = [CONTEXTS.index((kind, target, int(seen == 1), report)) for kind, seen in ((INSULT, insult), (THREAT, threat)) if seen]
    return step, emit


STEP, EMIT = tables(grammar_machine())


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    return W.span_hashes(data, np.concatenate([[0], ends[:-1]]), ends - 1)


@dataclass
class Words:
    hashes: np.ndarray
    row: np.ndarray
    clause: np.ndarray
    pauses: np.ndarray  # places, and their clauses
    pause_clause: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def beginning(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first n bytes of words longer than that, and their index."""
        at = np.flatnonzero(self.ends - self.starts > n)
        return W.span_hashes(self.data, self.starts[at], self.starts[at] + n) + W.U64(n), at


def read(data: np.ndarray, off: np.ndarray) -> Words:
    """Words of letters in lower case (of ASCII and Latin-1), with the number of their clause."""
    data = W.LOWER[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    data[capital] += 0x20
    for lead, rest in (((0xE2, 0x80), range(0x9C, 0xA0)), ((0xC2,), (0xAB, 0xBB))):  # other quotes
        at = np.flatnonzero(np.isin(data, list(rest)))
        for k, byte in enumerate(reversed(lead), 1):
            at = at[(at >= k) & (data[at - k] == byte)]
        for k in range(len(lead) + 1):
            data[at - k] = 34
    starts, ends, row = W.spans(_LETTER[data], off)
    breaks, pauses = np.cumsum(_BREAK[data]), np.flatnonzero(_PAUSE[data])
    clause = lambda at, row: breaks[at] + row if len(at) else at
    return Words(W.span_hashes(data, starts, ends), row, clause(starts, row), pauses, clause(pauses, np.searchsorted(off, pauses, "right") - 1), starts, ends, data)


@dataclass
class Grammar:
    markers: np.ndarray  # hashes of words
    beginnings: dict[int, np.ndarray]
    weights: np.ndarray | None = None

    def __post_init__(self):
        table = [(h, NEGATION) for h in _hash_words(NEGATIONS)] + [(h, REPORT) for h in _hash_words(REPORTS)] + [(h, TARGET) for h in _hash_words(TARGETS)] + [(h, THREAT) for h in _hash_words(THREATS)] + [(h, INSULT) for h in _hash_words(INSULTS)] + [(h, INSULT) for h in self.markers]
        known = {int(h): s for h, s in table}
        self.known = np.array(sorted(known), W.U64)
        self.symbol = np.array([known[int(h)] for h in self.known], np.int64)

    def symbols(self, w: Words) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, w.hashes), len(self.known) - 1)
        out = np.where(self.known[at] == w.hashes, self.symbol[at], NOTHING)
        for n, marks in self.beginnings.items():
            if len(marks):
                h, i = w.beginning(n)
                k = np.minimum(np.searchsorted(marks, h), len(marks) - 1)
                out[i[marks[k] == h]] = INSULT
        return out

    def matches(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Counts of matches in each context for each row."""
        w = read(data, off)
        symbols = self.symbols(w)
        out = np.zeros((len(off) - 1, len(CONTEXTS)))
        hits = np.flatnonzero((symbols == INSULT) | (symbols == THREAT))
        if not len(hits):
            return out
        # only clauses with a match are read symbol by symbol, each followed by its end
        ends, first = np.unique(w.clause[hits], return_index=True)
        at, pause = np.flatnonzero(np.isin(w.clause, ends)), np.isin(w.pause_clause, ends)
        place = np.concatenate([w.starts[at], w.pauses[pause]])
        order = np.argsort(place, kind="stable")
        clause = np.concatenate([w.clause[at], w.pause_clause[pause]])[order]
        symbol = np.concatenate([symbols[at], np.full(int(pause.sum()), PAUSE)])[order]
        begins = np.searchsorted(clause, ends)
        symbol = symbol.tolist()
        for row, i, j in zip(w.row[hits[first]].tolist(), begins.tolist(), [*begins[1:].tolist(), len(symbol)], strict=True):
            state, path = 0, symbol[i:j]
            for s in path:
                state = STEP[state][s]
            for c in EMIT[state]:
                out[row, c] += path.count(CONTEXTS[c][0])
        return out


def terms(counts: np.ndarray) -> np.ndarray:
    """Inputs of the score: a constant, and for each context a count that grows ever more slowly."""
    return np.hstack([np.ones((len(counts), 1)), np.log1p(counts)])


def markers(texts: DataFrame) -> Grammar:
    """``texts``: stored (text, label) rows. Learns markers from document counts, summed before they are shuffled."""
    n = texts.groupBy("label").count().collect()  # two rows
    total = {int(r["label"]): r["count"] for r in n}
    if not total.get(1):
        return Grammar(np.zeros(0, W.U64), {})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            for i, j, data, off in W.runs(batch, "text", 4 * W.CHUNK):
                w = read(data, off)
                for n in (0, *BEGINNINGS):
                    h, at = (w.hashes, np.arange(len(w.hashes))) if not n else w.beginning(n)
                    order = np.lexsort((w.row[at], h))
                    h, row = h[order], w.row[at][order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    h, toxic = h[new], label[i:j][row[new]]
                    u, k = np.unique(h, return_inverse=True)
                    yes, all_ = np.bincount(k, toxic, minlength=len(u)), np.bincount(k, minlength=len(u))
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(n, pa.int32()), len(u)), pa.array(u.view(np.int64)), pa.array(yes.astype(np.int64)), pa.array((all_ - yes).astype(np.int64))], ["n", "h", "yes", "no"])

    counts = texts.select("text", "label").mapInArrow(each, "n int, h long, yes long, no long").groupBy("n", "h").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    odds = ((F.col("yes") + 0.5) / (total[1] + 1.0)) / ((F.col("no") + 0.5) / (total.get(0, 0) + 1.0))
    best = counts.filter(F.col("yes") >= MARKER_LEAST).withColumn("odds", odds).filter(F.col("odds") >= MARKER_ODDS).orderBy(F.col("yes").desc(), F.col("odds").desc(), "n", "h").limit(MARKERS).collect()
    pick = lambda n: np.sort(np.array([r["h"] for r in best if r["n"] == n], np.int64).view(W.U64))
    return Grammar(pick(0), {n: pick(n) for n in BEGINNINGS})


def matched(docs: DataFrame, grammar: Grammar, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): counts of contexts."""
    kind = docs.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(grammar)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in W.runs(batch, text):
                x = held.value.matches(data, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))], [key, "x"])

    return docs.select(key, text).mapInArrow(each, f"`{key}` {kind}, x array<double>")


def weigh(counts: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights of the contexts by logistic regression towards PRIOR; tasks sum gradients of fixed size."""
    start = np.concatenate([[BIAS], PRIOR])
    w = start.copy()
    train = stored(counts.join(labels.hint("merge"), "doc_id").select("x", F.col("label").cast("double").alias("y")).repartition(SUMS), "train")
    pull = np.diag([0.01] + [PRIOR_ROWS] * len(PRIOR))
    best = None  # (loss, weights, step from there)
    for _ in range(40):

        def part(x: np.ndarray, y: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = terms(x)
            t = z @ w
            p = 1 / (1 + np.exp(-np.clip(t, -30, 30)))
            return np.concatenate([(z.T * (p * (1 - p)) @ z).ravel(), z.T @ (y - p), [np.sum(np.logaddexp(0, t) - y * t)]])

        s = _sum_rows(train, part)
        if not len(s):
            return start
        d, off = len(w), w - start
        loss = s[-1] + off @ pull @ off / 2
        if best is None or loss <= best[0]:
            move = np.linalg.solve(s[: d * d].reshape(d, d) + pull, s[d * d : -1] - pull @ off)
            best = loss, w, np.clip(move, -2, 2)
            if np.abs(move).max() < 1e-3:
                break
        else:  # too far: half the way
            best = best[0], best[1], best[2] / 2
            if np.abs(best[2]).max() < 1e-6:
                break
        w = best[1] + best[2]
    return best[1]


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every row of ``docs``; learns from ``labels`` (doc_id, label)."""
    labels = stored(labels.select("doc_id", F.col("label").cast("int").alias("label")).filter("doc_id is not null and label is not null"), "labels")
    n = labels.count()
    some = labels if n <= MARKER_TEXTS else labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < 1_000_003 * MARKER_TEXTS / n)
    texts = stored(docs.select("doc_id", "text").join(some.hint("merge"), "doc_id"), "labelled")
    # of texts with the same least shingle, copies mostly, one: what only they share is no marker
    least = stored(sketches(texts, "doc_id", "text").select("doc_id", F.coalesce(F.try_element_at("sketch", F.lit(1)), F.lit(0)).alias("least")), "least")
    one = least.groupBy("least").agg(F.min("doc_id").alias("doc_id"))
    texts = texts.join(one.hint("merge"), "doc_id", "left_semi").select("text", "label")
    grammar = markers(stored(texts, "texts"))
    counts = stored(matched(docs, grammar), "matches")
    grammar.weights = weigh(counts, labels)
    held = docs.sparkSession.sparkContext.broadcast(grammar.weights)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = terms(_matrix(batch, 1)) @ held.value
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return counts.mapInArrow(each, f"doc_id {kind}, score double")


HELD_OUT = (5, 0)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label")).filter(bucket("doc_id", HELD_OUT[0]) != HELD_OUT[1])
    done = score_toxicity(docs, labels)
    held = F.coalesce(bucket("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return done.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
