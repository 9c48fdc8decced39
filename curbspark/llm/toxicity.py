"""Toxicity by a weighted finite-state grammar over clauses.

Transducers are composed. The lexicon maps tokens to classes: insult (with a
weight), threat, target, negation, reported speech. Its insults are learned from
labelled training rows: words, and stems that begin many words, that stand in
many different contexts of toxic texts and in few others. Over the classes of a
clause run the transducers of negation, target and reported speech, composed into
one: each insult or threat is rewritten to the way it is used, plain, at a target,
negated, reported. Weights multiply along an arc and add up along a clause;
coefficients fitted on the same rows turn the sums into a probability.

Only clauses that hold an insult or threat are read token by token; an automaton
over the stems finds them in one pass through the whole text.

Null and empty texts match nothing and get the lowest score. Repeated rows get a
row each. Without usable training rows the given coefficients and the given words
stand. Of labelled rows that share an id one is learned from, the one with the
least hash of its text. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.llm.common import staged, table, whole_text

#: Most labelled rows that the model is fitted on, picked by hash of the id.
MAX_TRAINING = 20_000
#: An entry of the lexicon needs so many different contexts in toxic texts ...
MIN_CONTEXTS = 8
#: ... and a log ratio of its rate there to its rate elsewhere.
MIN_LOG_RATIO = 3.0
#: Lengths of stems, and the words that a stem must begin.
STEM_CHARS = range(3, 9)
MIN_STEM_WORDS = 4
#: A score from here on predicts label 1.
THRESHOLD = 0.3

#: Words known from the start, in the language classes of the grammar.
INSULTS = ("idiot", "moron", "scum", "loser", "trash", "worthless", "pathetic", "stupid", "disgusting", "clown")
THREATS = ("kill", "hurt", "destroy", "shoot", "stab", "töten", "umbringen", "tuer", "frapper", "matar", "golpear")
TARGETS = ("you", "your", "he", "she", "they", "them", "du", "dich", "ihr", "tu", "toi", "vous", "tú", "usted", "ustedes")
NEGATIONS = ("not", "no", "never", "without", "nicht", "kein", "nie", "pas", "jamais", "nunca", "jamás", "sin")
REPORTS = ("said", "says", "wrote", "called", "quoted", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió")

USES = ("plain", "targeted", "negated", "reported", "threat")
CLASSES = ("insult", "threat", "target", "negation", "report")
#: Intercept, one coefficient for each use, one for the highest clause.
PRIOR = (-4.0, 4.0, 5.0, 1.0, 2.0, 4.0, 2.0)
#: Strength of the pull of the fitted coefficients towards the given ones.
RIDGE = 0.5

_TOKEN = re.compile(r"[^\W_]+")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, symbol) -> (state, symbol put out or None, weight). A symbol without an arc passes as it is."""

    arcs: dict[tuple, tuple]
    start: object = 0

    def step(self, state, symbol: str) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


def composed(first: Transducer, second: Transducer, symbols: tuple[str, ...]) -> Transducer:
    """The transducer over `symbols` that hands to `second` what `first` puts out; weights multiply."""
    start = (first.start, second.start)
    arcs, states = {}, [start]
    for state in states:
        for symbol in symbols:
            to_first, between, weight = first.step(state[0], symbol)
            to_second, out, more = (state[1], None, 1.0) if between is None else second.step(state[1], between)
            arcs[state, symbol] = ((to_first, to_second), out, weight * more)
            if arcs[state, symbol][0] not in states:
                states.append(arcs[state, symbol][0])
    return Transducer(arcs, start)


#: After a negation (1) the next insult or threat is negated.
NEGATION = Transducer(
    {
        (0, "negation"): (1, None, 1.0),
        (1, "negation"): (1, None, 1.0),
        (1, "insult"): (0, "negated", 1.0),
        (1, "threat"): (0, "averted", 1.0),
    }
)
#: After a target (1) insults and threats are at it; what was negated ends that.
TARGET = Transducer(
    {
        **{(s, "target"): (1, None, 1.0) for s in (0, 1)},
        **{(s, "negated"): (0, "negated", 1.0) for s in (0, 1)},
        **{(s, "averted"): (0, None, 1.0) for s in (0, 1)},
        (0, "insult"): (0, "plain", 1.0),
        (1, "insult"): (1, "targeted", 1.0),
        (0, "threat"): (0, None, 1.0),
    }
)
#: After a word of speech (1) all that follows in the clause is reported.
REPORTED = Transducer(
    {
        **{(s, "report"): (1, None, 1.0) for s in (0, 1)},
        **{(1, use): (1, "reported", 1.0) for use in ("plain", "targeted", "negated")},
        (1, "threat"): (1, None, 1.0),
    }
)
CLAUSE = composed(composed(NEGATION, TARGET, CLASSES), REPORTED, CLASSES)


@dataclass
class Grammar:
    """words and stems: insult -> weight. coefficients as in PRIOR."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 1.0))
    stems: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = PRIOR

    def __post_init__(self):
        self.classes = {
            w: (c, 1.0)
            for c, ws in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS))
            for w in ws
        }
        self.classes |= {w: ("insult", x) for w, x in self.words.items()}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self._triggers = None

    @property
    def triggers(self) -> ahocorasick.Automaton:
        if self._triggers is None:
            self._triggers = ahocorasick.Automaton()
            for whole, entries in ((True, (*self.words, *THREATS)), (False, self.stems)):
                for x in entries:
                    self._triggers.add_word(x, (len(x), whole and x not in self.stems))
            self._triggers.make_automaton()
        return self._triggers

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_triggers"} | {"_triggers": None}

    def class_of(self, token: str) -> tuple[str, float] | None:
        if found := self.classes.get(token):
            return found
        for n in self.lengths:
            if (weight := self.stems.get(token[:n])) is not None:
                return "insult", weight
        return None

    def clauses(self, text: str) -> Iterator[str]:
        """The clauses with an insult or a threat."""
        done = 0
        for end, (size, whole) in self.triggers.iter(text):
            begin = end + 1 - size
            if begin < done or begin and text[begin - 1].isalnum():
                continue
            if whole and end + 1 < len(text) and text[end + 1].isalnum():
                continue
            ends = _CLAUSE_END.search(text, end + 1)
            done = ends.start() if ends else len(text)
            start = max(map(lambda c: text.rfind(c, 0, begin), ".!?;:\n")) + 1
            yield text[start:done]

    def uses(self, clause: str) -> list[float]:
        """Sum of the weights by way of use."""
        state, out = CLAUSE.start, [0.0] * len(USES)
        for token in _TOKEN.findall(clause):
            if found := self.class_of(token):
                state, use, weight = CLAUSE.step(state, found[0])
                if use:
                    out[USES.index(use)] += weight * found[1]
        return out

    def features(self, text: str) -> list[float]:
        """1, damped sums by way of use over the text, and the weight of its heaviest clause."""
        total, highest = [0.0] * len(USES), 0.0
        for clause in self.clauses(text.lower()):
            used = self.uses(clause)
            total = [a + b for a, b in zip(total, used, strict=True)]
            highest = max(highest, sum(used))
        return [1.0, *(math.log1p(x) for x in total), min(highest, 3.0)]

    def score(self, text: str) -> float:
        z = sum(a * b for a, b in zip(self.features(text), self.coefficients, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of at most MAX_TRAINING labelled rows that are not held out, one an id."""
    picked = (
        labels.where("toxic is not null and doc_id is not null")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_TRAINING)
    )
    # Rows that share an id combine before the shuffle.
    one = F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(one)
    return staged(rows.select("text", "toxic"), "toxicity")


def _word_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic, word and the word before it, each pair of a text once, by the tokens that the grammar reads."""
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            tokens = _TOKEN.findall((text or "").lower())
            pairs = list(dict.fromkeys(zip(tokens, ["", *tokens], strict=False)))
            yield pa.RecordBatch.from_pydict(
                {
                    "toxic": pa.array([toxic == 1] * len(pairs), pa.bool_()),
                    "word": pa.array([p[0] for p in pairs], pa.string()),
                    "before": pa.array([p[1] for p in pairs], pa.string()),
                }
            )


def learned_entries(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that mark toxic texts, with weights.

    A word's contexts are the different words before it, counted alike in toxic and
    in other texts: copies of a text add no context on either side.
    """
    words = (
        rows.mapInArrow(_word_pairs, "toxic boolean, word string, before string")
        .groupBy("word", "before")
        .agg(F.max("toxic").alias("inside"), (~F.min("toxic")).alias("outside"))
        .groupBy("word")
        .agg(F.count_if("inside").alias("contexts"), F.count_if("outside").alias("outside"))
    )
    words = staged(words, "toxicity")
    all_in, all_out = words.agg(F.sum("contexts"), F.sum("outside")).first()
    if not all_in or not all_out:
        return {}, {}
    entry = lambda text, whole: F.struct(text.alias("entry"), F.lit(whole).alias("whole"))
    stems = [
        F.when(F.length("word") >= n, entry(F.substring("word", 1, n), False)) for n in STEM_CHARS
    ]
    found = (
        words.select("*", F.explode(F.array_compact(F.array(entry(F.col("word"), True), *stems))).alias("e"))
        .groupBy("e.entry", "e.whole")
        .agg(
            F.sum("contexts").alias("contexts"),
            F.sum("outside").alias("outside"),
            F.sum(F.when(F.col("contexts") > 0, 1).otherwise(0)).alias("words"),
        )
        .withColumn(
            "ratio",
            F.log((F.col("contexts") + 0.5) / F.lit(float(all_in))) - F.log((F.col("outside") + 0.5) / F.lit(float(all_out))),
        )
        .where((F.col("contexts") >= MIN_CONTEXTS) & (F.col("ratio") >= MIN_LOG_RATIO))
        .where(F.col("whole") | (F.col("words") >= MIN_STEM_WORDS))
        .collect()
    )
    stem_contexts = {r.entry: r.contexts for r in found if not r.whole}
    # A stem that a longer one nearly always stands for gives way to it.
    longer = lambda s: any(
        len(t) == len(s) + 1 and t.startswith(s) and n >= 0.95 * stem_contexts[s] for t, n in stem_contexts.items()
    )
    kept = {s for s in stem_contexts if not longer(s)}
    covered = lambda x: any(x[:n] in kept for n in range(1, len(x)))
    weight = lambda r: min(r.ratio, 8.0) / 6
    stems_out = {r.entry: weight(r) for r in found if not r.whole and r.entry in kept and not covered(r.entry)}
    words_out = {r.entry: weight(r) for r in found if r.whole and r.entry not in kept and not covered(r.entry)}
    return words_out, stems_out


def fitted(features: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps, pulled towards PRIOR."""
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (p - toxic) + RIDGE * (w - prior)
        hessian = (features * (p * (1 - p))[:, None]).T @ features + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(x) for x in w)


def _featured(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [grammar.features(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column("toxic").cast(pa.int32())], ["features", "toxic"]
            )

    return run


def learned(docs: DataFrame, labels: DataFrame) -> Grammar:
    rows = training_rows(docs, labels)
    words, stems = learned_entries(rows)
    known = {w: max(1.0, words.get(w, 0.0)) for w in INSULTS}
    grammar = Grammar(words=words | known, stems=stems)
    # At most MAX_TRAINING rows of a few numbers.
    got = rows.mapInArrow(_featured(grammar), "features array<double>, toxic int").toPandas()
    if got.toxic.nunique() > 1:
        grammar.coefficients = fitted(np.array(got.features.tolist()), got.toxic.to_numpy(float))
    return grammar


def scored(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [grammar.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"]
            )

    return (
        docs.select("doc_id", "text")
        .mapInArrow(run, "doc_id long, score double")
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = learned(docs, table(spark, sf_dir, "labels"))
    return scored(docs, grammar).select("doc_id", held_out().alias("held_out"), "score", "predicted")
