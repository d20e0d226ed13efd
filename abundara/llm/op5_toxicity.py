"""Toxicity by a weighted finite-state pattern grammar.

A text is read clause by clause. A machine over characters (a trie of stems: whole words or beginnings of words,
any language) turns each word into a symbol: known insult, learned strong or weak stem, threat, target, negation, verb of
saying, quotation mark or other. Five small transducers over symbols, for insults, threats, targets, negation and
reported speech, are composed into one deterministic machine; its arcs carry labels (an insult, insults piled
up, a weak stem alone or with another, an aimed, negated or reported one, a menace, a threat that has its target). A clause
matches if its path has a label, and a text is scored by the labels on the paths of its matched clauses:
each label has a weight, and a logistic function of the weighted label counts is the probability.

The weights of the labels are learned from labelled training documents, drawn towards fixed defaults that hold where
labels are few. Stems are learned from the same rows without leaking: the labels' counts of a row come from stems that its
own part of the sample had no say in. A stem is kept by its evidence (a likelihood-ratio statistic), however many there are.
Training uses a bounded sample of labelled rows (SAMPLE, by hash of the id); scoring reads all documents.

Edge cases: null and empty texts match nothing and get the score of a text without matches. Long texts are
read whole. Repeated rows are scored alike. Repeated label rows of a document count by their greatest label.
Without labelled training rows the known insults and default weights hold. An empty table gives an empty result.
Other columns are ignored: a score depends on the text alone.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, HELD_OUT, TOXIC_FROM = 3, 1, 0.7
#: Most labelled rows that training uses; parts that stems and weights are learned across.
SAMPLE, PARTS = 16_000, 4
#: Lengths of the beginnings of words that can be stems, besides whole words.
SHORTEST, LONGEST = 2, 10
#: Least evidence (twice the log-likelihood ratio) and log-odds of a stem, and log-odds of a strong one.
EVIDENCE, WEAK_FROM, STRONG_FROM = 20.0, 1.6, 3.0
SYMBOLS = OTHER, INSULT, STRONG, WEAK, THREAT, TARGET, NEGATION, REPORT, QUOTE = tuple(range(9))
SEEDS = {
    INSULT: (
        "idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumb", "jerk",
        "idiotisch", "dumm", "abschaum", "blöd", "débile", "crétin", "imbécile", "ordure", "idiota", "estúpido", "imbécil", "basura",
    ),
    THREAT: ("kill", "hurt", "destroy", "beat", "stab", "shoot", "burn", "töten", "umbringen", "schlagen", "tuer", "frapper", "matar", "golpear", "destruir"),
    TARGET: ("you", "your", "yourself", "he", "she", "they", "him", "her", "them", "du", "dich", "dein", "ihr", "sie", "euch", "tu", "toi", "vous", "ton", "votre", "tú", "te", "ti", "usted", "ustedes"),
    NEGATION: ("not", "no", "never", "isn't", "aren't", "don't", "nor", "without", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "aucun", "nunca", "ni", "sin"),
    REPORT: ("said", "says", "say", "wrote", "quoted", "called", "claims", "reported", "according", "sagte", "schrieb", "nannte", "dit", "écrit", "selon", "dijo", "escribió", "según"),
}
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
READ = re.compile(WORD.pattern + "|[\"“”«»„]")
CLAUSE_END = re.compile(r"[.!?;:\n]+")

# --- transducers -----------------------------------------------------------------

LABELS = ("insult", "stem", "pile", "weak", "pair", "aimed", "negated", "reported", "menace", "threat")
BAD = (INSULT, STRONG, WEAK)


class Machine:
    """Deterministic transducer: arcs[state][symbol] = (next state, labels)."""

    def __init__(self, states: int, step):
        self.arcs = [[step(state, symbol) for symbol in SYMBOLS] for state in range(states)]

    def compose(self, other: Machine) -> Machine:
        """Both read the same symbols; states are pairs, labels add up."""
        n = len(other.arcs)

        def step(state: int, symbol: int):
            (a, x), (b, y) = self.arcs[state // n][symbol], other.arcs[state % n][symbol]
            return a * n + b, x + y

        return Machine(len(self.arcs) * n, step)


def insults(state: int, symbol: int):
    """States: nothing so far, weak stems only, an insult."""
    if symbol == WEAK:
        return max(state, 1), ("pair" if state else "weak",)
    if symbol in (INSULT, STRONG):
        return 2, ("insult" if symbol == INSULT else "stem", *(("pile",) if state == 2 else ("pair",) if state else ()))
    return state, ()


def threats(state: int, symbol: int):
    """States 1 to 3: words left in which a target makes a menace before it a threat; 4 to 6: a target is that near."""
    if symbol == THREAT:
        return 3, ("threat",) if state > 3 else ("menace",)
    if symbol == TARGET:
        return 6, ("threat",) if 0 < state < 4 else ()
    return (0 if state in (0, 1, 4) else state - 1), ()


def targets(state: int, symbol: int):
    """State: words left in which an insult is aimed at the target before it."""
    return (3 if symbol == TARGET else max(state - 1, 0)), (("aimed",) if state and symbol in BAD else ())


def negations(state: int, symbol: int):
    """State: words left that the negation before them covers."""
    return (2 if symbol == NEGATION else max(state - 1, 0)), (("negated",) if state and symbol in (*BAD, THREAT) else ())


def reports(state: int, symbol: int):
    """States: plain, after a verb of saying, in quotation marks, both."""
    after = state | 1 if symbol == REPORT else state ^ 2 if symbol == QUOTE else state
    return after, (("reported",) if state and symbol in (*BAD, THREAT) else ())


PARTS_OF_GRAMMAR = (Machine(3, insults), Machine(7, threats), Machine(4, targets), Machine(3, negations), Machine(4, reports))
GRAMMAR = PARTS_OF_GRAMMAR[0]
for _part in PARTS_OF_GRAMMAR[1:]:
    GRAMMAR = GRAMMAR.compose(_part)
#: The composed machine with labels as numbers.
ARCS = [[(after, tuple(map(LABELS.index, labels))) for after, labels in row] for row in GRAMMAR.arcs]
#: Weight of the intercept, of each label's log2(1 + count), and of the share of matched clauses.
DEFAULT = np.array([-3.5, 5.0, 2.0, 0.5, 0.3, 0.7, 0.5, -2.0, -1.5, 0.1, 4.5, 0.0])


class Stems:
    """Machine over characters: a trie whose final states have symbols. The longest stem that a word begins with decides."""

    def __init__(self, learned: dict[str, int]):
        self.arcs: list[dict[str, int]] = [{}]
        self.prefix: list[int] = [OTHER]
        self.whole: list[int] = [OTHER]
        for stem, symbol in learned.items():
            self.add(stem.removesuffix("$"), symbol, stem.endswith("$"))
        for symbol, words in SEEDS.items():
            for word in words:
                self.add(word, symbol, True)
        self.words: dict[str, int] = {}
        self.pieces: dict[str, bool] = {}

    def add(self, stem: str, symbol: int, whole: bool) -> None:
        at = 0
        for char in stem:
            if char not in self.arcs[at]:
                self.arcs[at][char] = len(self.arcs)
                self.arcs.append({})
                self.prefix.append(OTHER)
                self.whole.append(OTHER)
            at = self.arcs[at][char]
        (self.whole if whole else self.prefix)[at] = symbol

    def read(self, word: str) -> int:
        symbol = self.words.get(word)
        if symbol is None:
            at, symbol = 0, OTHER
            for char in word:
                at = self.arcs[at].get(char, -1)
                if at < 0:
                    break
                symbol = self.prefix[at] or symbol
            else:
                symbol = self.whole[at] or symbol
            if word in "\"“”«»„":
                symbol = QUOTE
            if len(word) <= 40:
                if len(self.words) > 300_000:
                    self.words.clear()
                self.words[word] = symbol
        return symbol

    def matches(self, piece: str) -> bool:
        """Whether a piece between blanks has a word that a path can be labelled for."""
        found = self.pieces.get(piece)
        if found is None:
            found = any(0 < self.read(x) <= THREAT for x in WORD.findall(piece))
            if len(piece) <= 40:
                if len(self.pieces) > 300_000:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found


def clause_labels(clause: str, stems: Stems) -> list[int]:
    """Labels on the clause's path through the grammar."""
    state, out = 0, []
    for word in READ.findall(clause):
        state, labels = ARCS[state][stems.read(word)]
        out += labels
    return out


def text_features(text: str, stems: Stems) -> list[float]:
    """log2(1 + count) of each label over all clauses, and the share of clauses that match."""
    low = text.lower()
    if not any(map(stems.matches, set(low.split()))):
        return [0.0] * (len(LABELS) + 1)
    counts, clauses, matched = [0] * len(LABELS), 0, 0
    for clause in CLAUSE_END.split(low):
        if not clause:
            continue
        clauses += 1
        found = clause_labels(clause, stems)
        matched += bool(found)
        for x in found:
            counts[x] += 1
    return [*np.log2(1 + np.array(counts)), matched / max(clauses, 1)]


def probability(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + features @ weights[1:], -30, 30)))


# --- training --------------------------------------------------------------------


def stem_features(text: str) -> set[str]:
    out: set[str] = set()
    for word in set(WORD.findall(text.lower())):
        out.add(word + "$")
        out.update(word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1))
    return out


def sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(text, toxic, part) of about `bound` labelled training rows at most."""
    rows = labels.filter(F.col("toxic").isNotNull() & (common.fold(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = rows.count()
    steps = 1_000_000
    share = steps if n <= bound else int(steps * bound / n)
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < share).withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    # at most about `bound` narrow rows
    return docs.select("doc_id", common.text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic", F.pmod(F.hash("doc_id"), F.lit(PARTS)).alias("part"))


def stem_counts(rows: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Documents by (toxic, part) for every stem that toxic documents have beyond chance, and in all."""
    names = [f"n{k}" for k in range(2 * PARTS)]

    def count(batches):
        seen: dict[int, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, toxic, part in zip(*(c.to_pylist() for c in batch.columns)):
                seen[toxic * PARTS + part].update({*stem_features(text), ""})
        stems = list(set().union(*seen.values()))
        yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *[pa.array([seen[k][s] for s in stems], pa.int64()) for k in range(2 * PARTS)]], names=["stem", *names])

    counts = common.spill(rows.mapInArrow(count, "stem string, " + ", ".join(f"{n} long" for n in names)).groupBy("stem").agg(*[F.sum(n).alias(n) for n in names]), "stems")
    totals = counts.filter("stem = ''").select(*names).first()
    if totals is None:
        return {}, np.zeros((2, PARTS))
    total = np.array(totals, float).reshape(2, PARTS)
    good, bad = (sum(F.col(names[t * PARTS + p]) for p in range(PARTS)) for t in (0, 1))
    # a looser test than in any part, so the stems of every part are among these; they come from the bounded sample
    loose = F.log((bad + 0.5) / F.lit(total[1].sum() + 1)) - F.log((good + 0.5) / F.lit(total[0].sum() + 1)) > WEAK_FROM - 1
    found = counts.filter((F.col("stem") != "") & (bad >= 3) & loose).collect()
    return {r.stem: np.array(r[1:], float).reshape(2, PARTS) for r in sorted(found, key=lambda r: r.stem)}, total


def learned_stems(counts: dict[str, np.ndarray], total: np.ndarray, without: int | None = None) -> dict[str, int]:
    """Symbols of stems, from the sample without one of its parts. A longer stem is kept if it says more than its beginning."""
    use = np.arange(PARTS) != (-1 if without is None else without)
    n_good, n_bad = total[:, use].sum(1)
    if not counts or not n_good or not n_bad:
        return {}
    names = list(counts)
    good, bad = np.array([counts[s] for s in names])[:, :, use].sum(2).T
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    share = n_bad / (n_good + n_bad)
    every = np.maximum(good + bad, 1e-9)
    evidence = 2 * (bad * np.log(np.maximum(bad, 1e-9) / (every * share)) + good * np.log(np.maximum(good, 1e-9) / (every * (1 - share))))
    kept: dict[str, float] = {}
    for k in np.flatnonzero((odds > WEAK_FROM) & (evidence > EVIDENCE)):  # in order of name, so beginnings come first
        shorter = [kept[names[k][:n]] for n in range(SHORTEST, len(names[k])) if names[k][:n] in kept]
        if not shorter or odds[k] > max(shorter) + 0.7:
            kept[names[k]] = odds[k]
    return {s: STRONG if o > STRONG_FROM else WEAK for s, o in kept.items()}


def fitted(x: np.ndarray, y: np.ndarray, prior: np.ndarray = DEFAULT, strength: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, with a Gaussian prior about `prior`; the first weight is the intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w = prior.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.eye(len(w)) * strength, a.T @ (y - p) - strength * (w - prior))
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[dict[str, int], np.ndarray]:
    """Symbols of the learned stems, and the weights of the labels."""
    rows = common.spill(sample(docs, labels, bound), "labelled")
    counts, total = stem_counts(rows)
    crossed = [learned_stems(counts, total, part) for part in range(PARTS)]
    names = [*LABELS, "share"]

    def features(batches):
        stems = [Stems(x) for x in crossed]
        for batch in batches:
            f = np.array([text_features(t, stems[p]) for t, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*[pa.array(f[:, i]) for i in range(len(names))], batch.column(1)], names=[*names, "toxic"])

    seen = rows.mapInArrow(features, ", ".join(f"{n} double" for n in names) + ", toxic int").collect()  # the bounded sample
    if not seen:
        return {}, DEFAULT
    table = np.array(seen, float)
    return learned_stems(counts, total), fitted(table[:, :-1], table[:, -1])


def scores(docs: DataFrame, learned: dict[str, int], weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted for all rows of `docs`."""
    rows = docs.select("doc_id", (common.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), common.text_or_empty().alias("text"))

    def run(batches):
        stems = Stems(learned)
        for batch in batches:
            f = np.array([text_features(t.as_py(), stems) for t in batch.column(2)]).reshape(-1, len(LABELS) + 1)
            p = probability(f, weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= TOXIC_FROM).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return scores(docs, *train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
