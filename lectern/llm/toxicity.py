"""Toxicity by a weighted finite-state grammar over clauses, composed of five transducers.

A lexicon turns the words of a clause into symbols: insult, threat, target,
negation, report, other. Each transducer reads symbols and writes symbols with
marks, or weighted events:

- negation marks insults and threats among the SCOPE words after a negation (~),
- report marks those that stand after a word of speech in the clause ("),
- target marks those with a person among the NEAR words before or after (+); a
  person yet to come is guessed, and the path ends unless one comes in time,
- insult turns insults into events, threat turns threats with a target into events.

They are composed into one machine once, by walking the reachable pairs of states.
A clause's weight is that of its best path: the sum over events of the event's
factor times the word's weight. A document's score is a logistic function of its
clauses' weights.

Learned from a bounded sample of labelled training rows (SAMPLE_ROWS rows, those
with the smallest hash of doc_id): the lexicon's insults (whole words and prefixes
of 3 to 7 letters, each with the lower bound of its log odds), a factor for each event (what the
event tells of the label against what a bare insult tells, drawn to a prior where
it is rare), and the logistic function. Scores use the text alone.

Cases: null text is empty; a text without a match gets the score of no match;
repeated rows get equal scores; of repeated labels for a document the larger
counts; rows without a label, and labels without a document, teach nothing; with
no label of either class the score of a match rests on the fixed lists; an empty
table gives an empty one; other columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm._shared import body, freeing, materialize, small_batches

SAMPLE_ROWS, LEAST_BOUND, SHORTEST, LONGEST = 20_000, 1.5, 3, 7
SCOPE, NEAR, THREAT_WEIGHT, PRIOR_COUNT = 3, 5, 2.0, 20.0
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
INSULT = frozenset("idiot idiots moron morons imbecile scum trash worthless loser losers stupid pathetic disgusting clown clowns vermin".split())
THREAT = frozenset("kill kills hurt destroy burn beat stab shoot hang strangle crush töten tuer matar".split())
TARGET = frozenset("you your yours yourself u he she him her they them their everyone people du dich dein ihr euch tu toi vous tú usted ustedes".split())
NEGATION = frozenset("not no never neither nor isn aren wasn don doesn nicht kein keine ne pas jamais ningún nunca".split())
REPORT = frozenset("said says say called calls claimed wrote quoted reported alleged sagte schrieb dit dijo escribió".split())
SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")


# --- transducers ------------------------------------------------------------------------


class Transducer:
    """Arcs by state and symbol: (next state, symbol written, event or None); a path counts if it ends in a final state."""

    def __init__(self, arcs: list[dict[str, list[tuple]]], final: frozenset[int]):
        self.arcs, self.final = arcs, final


def transducer(start, alphabet, move: Callable, final: Callable = lambda state: True) -> Transducer:
    """The machine of move(state, symbol), which gives arcs, over all states that can be reached from start, state 0."""
    number, todo, arcs = {start: 0}, [start], []
    for state in todo:
        out: dict[str, list[tuple]] = {}
        for symbol in alphabet:
            for to, written, event in move(state, symbol):
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                out.setdefault(symbol, []).append((number[to], written, event))
        arcs.append(out)
    return Transducer(arcs, frozenset(n for s, n in number.items() if final(s)))


def marked(symbol: str) -> bool:
    return symbol.startswith(("insult", "threat"))


def negation(state: int, symbol: str) -> list[tuple]:
    if symbol == "negation":
        return [(SCOPE, symbol, None)]
    return [(max(state - 1, 0), symbol + "~" if state and marked(symbol) else symbol, None)]


def report(state: int, symbol: str) -> list[tuple]:
    if symbol == "report":
        return [(1, symbol, None)]
    return [(state, symbol + '"' if state and marked(symbol) else symbol, None)]


def target(state: tuple[int, int], symbol: str) -> list[tuple]:
    """State: words for which the last person is near, and words left in which a guessed one must come."""
    behind, ahead = state
    if symbol == "target":
        return [((NEAR, 0), symbol, None)]
    later = [] if ahead == 1 else [max(ahead - 1, 0)]  # a path whose person hasn't come ends
    if not marked(symbol):
        return [((max(behind - 1, 0), x), symbol, None) for x in later]
    if behind:
        return [((behind - 1, x), symbol + "+", None) for x in later]
    guess = [ahead - 1] if ahead > 1 else [NEAR] if ahead == 0 else []
    return [((0, x), symbol, None) for x in later] + [((0, x), symbol + "+", None) for x in guess]


def insult(state: int, symbol: str) -> list[tuple]:
    return [(0, symbol, symbol if symbol.startswith("insult") else None)]


def threat(state: int, symbol: str) -> list[tuple]:
    return [(0, symbol, symbol if symbol.startswith("threat") and symbol.endswith("+") else None)]


def keep(state: int, symbol: str) -> list[tuple]:
    """In place of a transducer that is taken out."""
    return [(0, symbol, None)]


PARTS = {"negation": (0, negation), "report": (0, report), "target": ((0, 0), target), "insult": (0, insult), "threat": (0, threat)}


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that reads what a reads and writes what b writes of a's output."""

    def move(state, symbol):
        return [((x, y), out, first or second) for x, between, first in a.arcs[state[0]].get(symbol, []) for y, out, second in b.arcs[state[1]].get(between, [])]

    return transducer((0, 0), SYMBOLS, move, lambda s: s[0] in a.final and s[1] in b.final)


@lru_cache(maxsize=16)
def grammar_machine(without: str = "") -> Transducer:
    """All transducers composed in the order of PARTS; the one named is taken out."""
    alphabet, machines = SYMBOLS, []
    for name, (start, move) in PARTS.items():
        start, move = (0, keep) if name == without else (start, move)
        m = transducer(start, alphabet, move, (lambda s: s[1] == 0) if move is target else lambda s: True)
        alphabet = tuple(dict.fromkeys([*SYMBOLS, *(out for arcs in m.arcs for options in arcs.values() for _, out, _ in options)]))
        machines.append(m)
    return reduce(compose, machines)


EVENTS = tuple(sorted({e for arcs in grammar_machine().arcs for options in arcs.values() for _, _, e in options if e}))


def prior(event: str) -> float:
    return (0.3 if "~" in event else 1.0) * (0.6 if '"' in event else 1.0) * (1.25 if event.startswith("insult") and event.endswith("+") else 1.0)


# --- grammar ----------------------------------------------------------------------------


class Grammar:
    def __init__(self, stems: dict[str, float], factors: dict[str, float] | None = None, curve: tuple[float, ...] | None = None, without: str = ""):
        self.learned, self.factors, self.curve = stems, factors or {e: prior(e) for e in EVENTS}, curve or (-3.0, 1.2, 0.6, 0.8, 0.0)
        self.stems = {w: 3.0 for w in INSULT} | stems
        self.machine = grammar_machine(without)
        self.seen: dict[str, tuple[str, float]] = {}

    def classed(self, word: str) -> tuple[str, float]:
        kept = self.seen.get(word)
        if kept is None:
            weight = max([self.stems.get(word, 0.0), self.stems.get(word + "$", 0.0), *(self.stems.get(word[:n] + "*", 0.0) for n in range(SHORTEST, min(len(word), LONGEST) + 1))])
            if weight:
                kept = "insult", weight
            else:
                kept = ("threat", THREAT_WEIGHT) if word in THREAT else ("target", 0.0) if word in TARGET else ("negation", 0.0) if word in NEGATION else ("report", 0.0) if word in REPORT else ("other", 0.0)
            if len(self.seen) > 150_000:
                self.seen.clear()
            self.seen[word] = kept
        return kept

    def clause(self, words: list[tuple[str, float]]) -> tuple[float, tuple]:
        """Weight and events (event, word's weight) of the best path, from (symbol, weight)."""
        arcs, factors = self.machine.arcs, self.factors
        paths: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for symbol, weight in words:
            new: dict[int, tuple[float, tuple]] = {}
            for state, (total, events) in paths.items():
                for to, _, event in arcs[state].get(symbol, ()):
                    value = total + factors[event] * weight if event else total
                    if to not in new or value > new[to][0]:
                        new[to] = value, (events, (event, weight)) if event else events
            paths = new
        total, events = max((p for s, p in paths.items() if s in self.machine.final), key=lambda p: p[0])
        out = []
        while events:
            events, last = events
            out.append(last)
        return total, tuple(reversed(out))

    def clauses(self, text: str) -> tuple[list[tuple[float, tuple]], int]:
        """Weight and events of each clause that may have any, and the number of all words."""
        lower = text.lower()
        words = WORD.findall(lower)
        if not any(self.classed(w)[1] for w in set(words)):
            return [], len(words)
        parts = ([self.classed(w) for w in WORD.findall(part)] for part in CLAUSE.split(lower))
        return [self.clause(p) for p in parts if any(weight for _, weight in p)], len(words)

    def features(self, text: str) -> tuple[float, float, float, float]:
        """Of all clauses: log of the weight, largest weight, log of the events, events a hundred words."""
        found, n = self.clauses(text)
        weights, hits = [max(w, 0.0) for w, _ in found], sum(len(e) for _, e in found)
        return math.log1p(sum(weights)), min(max(weights, default=0.0), 20.0) / 4, math.log1p(hits), min(1.0, 10 * hits / max(n, 1))

    def score(self, text: str) -> float:
        z = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# --- learning ---------------------------------------------------------------------------


def held_out(doc_id="doc_id"):
    """Rows that teach nothing; a null id is not held out and has no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and toxic of at most `rows` labelled training ids; the sampled ids are broadcast, being so few."""
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    ids = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", body().alias("__text")).join(F.broadcast(ids), "doc_id").select("__text", (F.col("__toxic") > 0).cast("int").alias("__toxic"))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Grammar:
    small_batches(docs.sparkSession)
    sample = materialize(labelled_sample(docs, labels, rows), "labelled")
    totals = {r["__toxic"]: r.n for r in sample.groupBy("__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not min(bad, good):
        return Grammar({})

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update({s for w in set(WORD.findall(text.lower())) for s in [w + "$", *(w[:n] + "*" for n in range(SHORTEST, min(len(w), LONGEST) + 1))]})
        keys = list(counts[0].keys() | counts[1].keys())
        for at in range(0, len(keys), 20_000):
            part = keys[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([counts[k][s] for s in part], pa.int64()) for k in (1, 0))], names=["stem", "bad", "good"])

    table = sample.mapInArrow(freeing(stems), "stem string, bad bigint, good bigint").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) * (good + 1.0) / ((F.col("good") + 0.5) * (bad + 1.0)))
    bound = odds - 1.64 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    kept = table.where("bad >= 4").select("stem", bound.alias("bound")).where(F.col("bound") >= LEAST_BOUND).collect()  # no more than the sample has words for
    grammar = Grammar({r.stem: r.bound for r in sorted(kept)})

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                met.update((e, toxic) for e in {e for _, found in grammar.clauses(text)[0] for e, _ in found})
        yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in met], pa.string()), pa.array([t for _, t in met], pa.int32()), pa.array(met.values(), pa.int64())], names=["event", "toxic", "n"])

    met = {(r.event, r.toxic): r.n for r in sample.mapInArrow(freeing(events), "event string, toxic int, n bigint").groupBy("event", "toxic").agg(F.sum("n").alias("n")).collect()}  # two rows an event at most
    tells = lambda e: math.log((met.get((e, 1), 0) + 0.5) * (good + 1.0) / ((met.get((e, 0), 0) + 0.5) * (bad + 1.0)))
    bare = max(tells("insult"), 0.5)
    for e in EVENTS:
        n = met.get((e, 1), 0) + met.get((e, 0), 0)
        grammar.factors[e] = (n * max(tells(e), 0.0) / bare + PRIOR_COUNT * prior(e)) / (n + PRIOR_COUNT)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([grammar.features(t) for t in batch.column(0).to_pylist()], float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(f[:, k]) for k in range(4)), batch.column(1)], names=["a", "b", "c", "d", "y"])

    small = sample.mapInArrow(freeing(measure), "a double, b double, c double, d double, y int").groupBy(*(F.round(x, 2).alias(x) for x in "abcd"), "y").count().collect()  # at most a row for each of the sample
    grammar.curve = logistic(np.array([[1, r.a, r.b, r.c, r.d] for r in small]), np.array([float(r.y) for r in small]), np.array([float(r["count"]) for r in small]))
    return grammar


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Weighted ridge logistic regression by Newton's steps."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (n * (y - p)) - ridge * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(b.tolist())


def score_documents(docs: DataFrame, grammar: Grammar, keep: tuple[str, ...] = ("doc_id",), without: str = "", out: str = "toxicity") -> DataFrame:
    """The columns of keep and the score; without names a transducer to take out."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((grammar.learned, grammar.factors, grammar.curve))
    rows = docs.select(*keep, body().alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + f", `{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*shared.value, without)
        for batch in batches:
            scores = [own.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*keep, out])

    return rows.mapInArrow(freeing(run), schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    grammar = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = score_documents(docs, grammar)
    return rows.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 0.5 or more."""
    grammar = learn(docs, labels)
    return score_documents(docs, grammar, (*(c for c in docs.columns if c != "text"), "text"), out="__toxicity").where(F.col("__toxicity") < 0.5).select(*docs.columns)
