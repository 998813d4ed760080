"""Toxicity by a weighted finite-state grammar of clauses.

Words become classes (learned insult stem, verb of violence, intent, intensifier, target, negation, report, plain word). Five
small weighted transducers read them one after another: insults (a stem, heavier after an intensifier), threats (a verb, heavier
after an announced intent or as the clause's first word), negation, reported speech, and aim at a target. They are composed into one
machine whose arcs carry the sum of the weights; it is deterministic, so a clause has one path, which is its best one in the tropical
semiring. Each insult or threat leaves a clause as a kind (aimed, plain, negated or reported) with the weight of its word and its arc.
A document's score is a logistic function of the summed weights of its matched clauses by kind, so a negated or quoted insult
counts by the weight of its own kind, not as the bare word.

Insult stems and their weights are learned: document frequencies of word prefixes in toxic and clean training rows,
counted by Spark over a sample of at most ``TOXIC`` and ``CLEAN`` labelled rows outside the held-out fold (hash order of
doc_id), give log ratios; the best ``STEMS`` non-nested prefixes stay. Weights of the kinds are fitted on the same rows,
drawn towards ``PRIOR`` where the rows show none. Scoring is one pass over whole texts without a shuffle.

Defined cases: null text counts as empty; a text without a match gets the same low score whatever its length; repeated
doc_ids are scored row by row; without toxic or clean training rows only the fixed threat words and the prior weights
act; an empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .shared import map_batches

#: Bounds of the fitting samples and of the learned lexicon.
TOXIC, CLEAN, STEMS = 4000, 6000, 400
FOLDS, HELD_OUT = 5, 0
SHORTEST, LONGEST = 4, 12
#: A stem needs this many toxic rows, and this share of them, and this ratio of rates.
MIN_DOCS, MIN_SHARE, MIN_RATIO = 4, 0.004, 6.0

# Fixed word classes in English, French, German and Spanish.
TARGETS = frozenset("you your yours yourself u he she they them him her his their tu toi te vous votre ton ta il elle ils "
                    "elles du dich dir dein deine ihr euch sie er usted ustedes vosotros ti tus ellos ellas él".split())
NEGATIONS = frozenset("not no never neither nor without isn aren wasn don doesn didn ne pas jamais aucun sans non nicht kein "
                      "keine nie ohne nunca ni sin jamás".split())
REPORTS = frozenset("said says say told called calls wrote writes quoted quote reported claimed dit disait écrit selon "
                    "sagte sagt schrieb laut dijo dice escribió según".split())
INTENSIFIERS = frozenset("such very so total totally complete utter absolute real really tel telle très vraiment si sehr so "
                         "total echt wirklich tan muy verdadero".split())
INTENTS = frozenset("will gonna going shall must should want let vais va allons werde werden will wollen voy va vamos".split())
THREATS = ("kill", "murder", "strangle", "tuer", "tuerai", "égorger", "umbringen", "töten", "matar", "mataré", "degollar")
THREAT_WEIGHT = 2.0
#: Weights of arcs: an intensified insult, a threat whose intent is announced, a threat as the clause's first word.
INTENSE, ANNOUNCED, IMPERATIVE = 0.5, 1.0, 0.5

#: Kinds that leave the composed machine, with the weight each has before fitting.
PRIOR = {"insult": 1.0, "aimed insult": 1.5, "negated insult": 0.3, "reported insult": 0.5, "threat": 0.5, "aimed threat": 1.5}
KINDS = list(PRIOR)
EXTRA = ["heaviest", "stems", "per_word"]

_WORD = re.compile(r"\w+")
_CLAUSE_END = re.compile(r"[.,;:!?\n|]+")
_SYMBOLS = ("stem", "verb", "intent", "intensifier", "target", "negation", "report", "word")


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (next state, symbol out, weight). A missing arc keeps state and symbol and weighs nothing.
    State 0 is the first."""
    arcs: dict[tuple[int, str], tuple[int, str, float]] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Feeds what leaves ``first`` to ``second`` and adds their weights; only the product states that can be reached get arcs."""
    number, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
    for a, b in todo:
        for symbol in {s for _, s in first.arcs} | set(_SYMBOLS):
            a2, middle, w = first.step(a, symbol)
            b2, out, v = second.step(b, middle)
            if (a2, b2) not in number:
                number[a2, b2] = len(number)
                todo.append((a2, b2))
            arcs[number[a, b], symbol] = number[a2, b2], out, w + v
    return Transducer(arcs)


def insults() -> Transducer:
    """A stem is an insult, a heavier one right after an intensifier."""
    t = Transducer({(0, "intensifier"): (1, "intensifier", 0.0), (0, "stem"): (0, "insult", 0.0), (1, "stem"): (0, "insult", INTENSE)})
    for symbol in _SYMBOLS:
        if symbol not in ("stem", "intensifier"):
            t.arcs[1, symbol] = 0, symbol, 0.0
    return t


def threats(reach: int = 4) -> Transducer:
    """A verb of violence is a threat, a heavier one within ``reach`` words after an intent or as the first word (state 0; state 1 is
    any later place without an intent)."""
    t = Transducer({(0, "verb"): (1, "threat", IMPERATIVE), (1, "verb"): (1, "threat", 0.0)})
    symbols = {*_SYMBOLS, "insult"} - {"verb", "intent", "stem"}
    for s in range(reach + 2):
        t.arcs[s, "intent"] = reach + 1, "word", 0.0
        for symbol in symbols:
            t.arcs[s, symbol] = max(1, s - 1), symbol, 0.0
        if s > 1:
            t.arcs[s, "verb"] = 1, "threat", ANNOUNCED
    return t


def negation(reach: int = 2) -> Transducer:
    """A negation turns an insult within the next ``reach`` words into a negated one and hides a threat there."""
    t = Transducer()
    for s in range(reach + 1):
        t.arcs[s, "negation"] = reach, "negation", 0.0
        for symbol in ("word", "target", "report"):
            t.arcs[s, symbol] = max(0, s - 1), symbol, 0.0
        if s:
            t.arcs[s, "insult"] = 0, "negated insult", 0.0
            t.arcs[s, "threat"] = 0, "word", 0.0
    return t


def reported() -> Transducer:
    """After a verb of saying, the rest of the clause is somebody else's words."""
    t = Transducer({(0, "report"): (1, "report", 0.0)})
    t.arcs[1, "insult"] = t.arcs[1, "negated insult"] = 1, "reported insult", 0.0
    t.arcs[1, "threat"] = 1, "word", 0.0
    return t


def aimed() -> Transducer:
    """Once a target is named, the clause's insults and threats are aimed."""
    return Transducer({(0, "target"): (1, "target", 0.0), (1, "insult"): (1, "aimed insult", 0.0),
                       (1, "threat"): (1, "aimed threat", 0.0)})


MACHINES = (insults(), threats(), negation(), reported(), aimed())
GRAMMAR = reduce(compose, MACHINES)


def word_class(word: str) -> str:
    """The class of a word without a stem or verb."""
    return ("target" if word in TARGETS else "negation" if word in NEGATIONS else "report" if word in REPORTS
            else "intent" if word in INTENTS else "intensifier" if word in INTENSIFIERS else "word")


def matcher(lexicon: dict[str, float]):
    import ahocorasick
    machine = ahocorasick.Automaton()
    for stem, weight in lexicon.items():
        machine.add_word(stem, (len(stem), "stem", weight, stem))
    for stem in THREATS:
        if stem not in lexicon:
            machine.add_word(stem, (len(stem), "verb", THREAT_WEIGHT, stem))
    machine.make_automaton()
    return machine


def describe(text: str, machine) -> list[float]:
    """Per kind log(1 + summed weight) over the matched clauses, then the heaviest match, distinct stems, matches a word."""
    text = text.lower()
    hits: dict[int, tuple] = {}
    for end, (size, kind, weight, stem) in machine.iter(text):
        start = end - size + 1
        if start == 0 or not (text[start - 1].isalnum() or text[start - 1] == "_"):
            if start not in hits or size > hits[start][0]:
                hits[start] = size, kind, weight, stem
    if not hits:
        return [0.0] * (len(KINDS) + len(EXTRA))
    total, heaviest, stems = dict.fromkeys(KINDS, 0.0), 0.0, set()
    ends = [m.span() for m in _CLAUSE_END.finditer(text)]
    opens, closes = [0, *(b for _, b in ends)], [*(a for a, _ in ends), len(text)]
    done = -1
    for at in sorted(hits):
        clause = bisect_right(opens, at) - 1
        if clause == done or at >= closes[clause]:
            continue
        done, state = clause, 0
        for m in _WORD.finditer(text, opens[clause], closes[clause]):
            hit, word = hits.get(m.start()), m.group()
            state, out, weight = GRAMMAR.step(state, hit[1] if hit else word_class(word))
            if out in total and hit:
                total[out] += hit[2] + weight
                heaviest = max(heaviest, hit[2] if out != "negated insult" else 0.0)
                stems.add(hit[3])
    words = max(1, len(text) // 6)
    return [*(float(np.log1p(total[k])) for k in KINDS), heaviest, float(np.log1p(len(stems))),
            float(np.log1p(1000.0 * sum(total.values()) / words) / 5)]


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sampling.sigmoid(x @ self.weights + self.bias)


def prior_weights() -> np.ndarray:
    return np.array([*PRIOR.values(), 0.0, 0.0, 0.0])


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic weights by Newton steps, drawn towards the prior weights with a Gaussian of precision ``strength``."""
    mean = np.append(prior_weights(), -3.0)
    if not len(y) or y.min() == y.max():
        return mean[:-1], float(mean[-1])
    z, w = np.column_stack([x, np.ones(len(x))]), mean.copy()
    hold = np.diag(np.append(np.full(x.shape[1], strength), 1e-3))
    for _ in range(30):
        p = sampling.sigmoid(z @ w)
        gradient = z.T @ (p - y) + hold @ (w - mean)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + hold, gradient)
        w = w - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _text_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))


def _stem_counts(sample: DataFrame) -> DataFrame:
    """(stem, toxic, clean): in how many sampled documents a word begins with the stem; pre-counted by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                stems = {w[:k] for w in set(_WORD.findall(text.lower())) if len(w) >= SHORTEST
                         for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}
                counts.update((s, y) for s in stems)
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in counts], pa.string()), pa.array([n * (y == 1) for (_, y), n in counts.items()], pa.int64()),
                     pa.array([n * (y != 1) for (_, y), n in counts.items()], pa.int64())], ["stem", "toxic", "clean"])
    return (map_batches(sample.select("text", "y"), run, "stem string, toxic long, clean long")
            .groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def choose_stems(counts: DataFrame, n_toxic: int, n_clean: int, stems: int = STEMS) -> dict[str, float]:
    """The stems that mark toxic rows most, none of them a prefix of another; their weight is the log ratio of rates."""
    ratio = (F.col("toxic") / F.lit(max(1, n_toxic))) / ((F.col("clean") + 0.5) / F.lit(n_clean + 1.0))
    rows = (counts.where(F.col("toxic") >= max(MIN_DOCS, MIN_SHARE * n_toxic)).withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO)
            .withColumn("gain", F.round(F.col("toxic") * F.log("ratio"), 6))
            .orderBy(F.desc("gain"), F.desc(F.length("stem")), "stem").limit(stems * 5).select("stem", "ratio").collect())
    chosen: dict[str, float] = {}
    taken: list[str] = []  # sorted
    for r in rows:
        s = r["stem"]
        i = bisect_left(taken, s)
        longer = i < len(taken) and taken[i].startswith(s)
        if longer or any(s[:k] in chosen for k in range(SHORTEST, len(s))):
            continue
        chosen[s] = float(np.log(r["ratio"]))
        taken.insert(i, s)
        if len(chosen) == stems:
            break
    return chosen


def _describe_rows(df: DataFrame, lexicon: dict[str, float], keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = matcher(lexicon)
        for batch in batches:
            x = [describe(t.as_py(), machine) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(keep), pa.array(x, pa.list_(pa.float64()))],
                                             ["doc_id", keep, "x"])
    return map_batches(df.select("doc_id", keep, "text"), run, f"doc_id long, {keep} int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = FOLDS, held_out: int = HELD_OUT,
          toxic: int = TOXIC, clean: int = CLEAN) -> Model:
    known = sampling.training_labels(labels, label, parts, held_out)
    chosen = (sampling.first_by_hash(known.where("y = 1"), toxic, 3, "y")
              .unionByName(sampling.first_by_hash(known.where("y = 0"), clean, 4, "y")))
    sample = _text_rows(sampling.rows_of(docs.select("doc_id", "text"), chosen))
    n = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    lexicon = choose_stems(_stem_counts(sample), n.get(1, 0), n.get(0, 0)) if n.get(1) and n.get(0) else {}
    # of a repeated doc_id one row speaks, so the sample's bound holds for what reaches the driver
    rows = (_describe_rows(sample, lexicon, "y").groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy("doc_id").collect())
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(KINDS) + len(EXTRA))
    weights, bias = fit_weights(x, np.array([float(r["y"]) for r in rows]))
    return Model(lexicon, weights, bias)


def score(docs: DataFrame, model: Model, parts: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = matcher(model.lexicon)
        for batch in batches:
            x = np.array([describe(t.as_py(), machine) for t in batch.column("text")]).reshape(batch.num_rows, len(KINDS) + len(EXTRA))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])
    return (map_batches(_text_rows(docs.select("doc_id", "text")), run, "doc_id long, score double")
            .select("doc_id", F.coalesce(sampling.is_held_out(parts, held_out), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def toxicity_scores(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    return score(docs, train(docs, labels, **kw))
