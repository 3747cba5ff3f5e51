"""Toxicity as a weighted finite-state pattern grammar.

A lexical transducer, an automaton over the letters of a word, rewrites each word of a clause to a class: insult or threat
(each with a weight), target, negation, reported speech or other. Its insult weights are partly fixed and partly learned as
word prefixes from labelled rows. Three transducers over classes follow: `negation` scales down insults and threats within
REACH words of a negation, `reported` those behind a verb of speech, and `target` ends in a state that tells whether the
clause has a target, which scales its insults up and without which its threats don't count. They are tables of transitions
with weights and are composed into one table, `GRAMMAR`, by which a clause is scored in one pass. The scores of matched
clauses, not of isolated words, reach a logistic score per document.

Null and empty texts have no clause and get the score of a text without matches. A text of any length is scored whole, in one
task. Rows are scored one by one, so ties, repeated rows and extra columns change nothing; an empty table gives an empty
table; a column named as the result is replaced. Where labels repeat an id, its greatest label holds. Without labelled rows of
both kinds the fixed lexicon and fixed coefficients hold.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import scratch, values

# Word lists of the lexical transducer.
INSULTS = "idiot moron loser scum trash clown stupid pathetic worthless disgusting imbecile dumb jerk filth vermin fool".split()
THREATS = "kill hurt destroy stab shoot strangle tue tuer schlage umbringen matar golpear".split()
TARGETS = "you your yours u he she they him her them du dich dir ihr euch tu te toi vous il elle ils usted ustedes tú él ella ellos".split()
NEGATIONS = "not never no nobody isn't aren't wasn't don't nicht kein keine nie pas jamais ne nunca ni sin".split()
REPORTS = "said says say called claims claimed quoted reported wrote sagte schrieb nannte dit disait écrit dijo dice escribió".split()
REACH = 3
NEGATED, REPORTED, TARGETED = 0.5, 0.7, 1.5
FIXED_WEIGHT = 2.0
#: Bounds of the sample that the lexicon and the coefficients are learned from.
SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 4000, 8000
PREFIXES = (4, 5, 6, 7)
CACHE = 1 << 17
CLAUSE_END = re.compile(r"[.!?;:,\n]+")
EDGES = "\"'`.,;:!?()[]{}<>#*$%&|-_/\\…“”‘’«»"


def bare(word: str) -> str:
    return word.strip(EDGES).lower()


@dataclass(frozen=True)
class Grammar:
    """Bounded: the fixed lists and at most a few thousand learned prefixes."""

    prefixes: dict[str, float] = field(default_factory=dict)  # learned; a full word ends with "$"
    bias: float = -4.0
    slopes: tuple[float, float, float] = (1.5, 1.0, 0.5)


OTHER, TARGET, NEGATION, REPORT, INSULT, THREAT = range(6)
SCORED = (INSULT, THREAT)


@dataclass(frozen=True)
class Transducer:
    """State x class -> next state, class written, weight. State 0 is the start; `ends` has a pair of final weights for each
    state, one for the clause's insults and one for its threats."""

    moves: tuple[tuple[tuple[int, int, float], ...], ...]
    ends: tuple[tuple[float, float], ...]

    def compose(self, other: "Transducer") -> "Transducer":
        """Reads what this one reads and writes what `other` writes on what this one writes."""
        width = len(other.moves)
        moves = []
        for one in self.moves:
            for k in range(width):
                row = []
                for state, written, weight in one:
                    state_, written_, weight_ = other.moves[k][written]
                    row.append((state * width + state_, written_, weight * weight_))
                moves.append(tuple(row))
        ends = [(a[0] * b[0], a[1] * b[1]) for a in self.ends for b in other.ends]
        return Transducer(tuple(moves), tuple(ends))

    def run(self, kinds: list[tuple[int, float]]) -> float:
        """The weight of a clause, given as its words' classes and weights."""
        state, totals = 0, [0.0, 0.0]
        for kind, weight in kinds:
            state, written, factor = self.moves[state][kind]
            if written >= INSULT:
                totals[written - INSULT] += weight * factor
        return totals[0] * self.ends[state][0] + totals[1] * self.ends[state][1]


def negation() -> Transducer:
    """A state for each number of words that a negation still reaches."""
    rows = []
    for left in range(REACH + 1):
        rows.append(tuple((REACH if k == NEGATION else max(0, left - 1), k, NEGATED if left and k in SCORED else 1.0) for k in range(6)))
    return Transducer(tuple(rows), ((1.0, 1.0),) * (REACH + 1))


def reported() -> Transducer:
    """State 1 is behind a verb of speech."""
    rows = [tuple((int(s or k == REPORT), k, REPORTED if s and k in SCORED else 1.0) for k in range(6)) for s in (0, 1)]
    return Transducer(tuple(rows), ((1.0, 1.0),) * 2)


def target() -> Transducer:
    """State 1 has seen a target."""
    rows = [tuple((int(s or k == TARGET), k, 1.0) for k in range(6)) for s in (0, 1)]
    return Transducer(tuple(rows), ((1.0, 0.0), (TARGETED, TARGETED)))


GRAMMAR = negation().compose(reported()).compose(target())


class Automaton:
    """The lexical transducer: a tree of letters whose states may accept a whole word, with a class and a weight, or any word
    that goes on from there, with an insult's weight."""

    def __init__(self, learned: dict[str, float]):
        self.root: dict = {}
        for kind, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, INSULTS)):
            for w in words:
                self.state(w)["whole"] = (kind, FIXED_WEIGHT if kind in SCORED else 0.0)
        for w, weight in learned.items():
            if w.endswith("$"):
                self.state(w[:-1])["alone"] = weight
            else:
                self.state(w)["on"] = weight

    def state(self, word: str) -> dict:
        now = self.root
        for c in word:
            now = now.setdefault(c, {})
        return now

    def read(self, core: str) -> tuple[int, float]:
        now, best = self.root, 0.0
        for c in core:
            now = now.get(c)
            if now is None:
                return (INSULT, best) if best else (OTHER, 0.0)
            best = max(best, now.get("on", 0.0))
        kind = now.get("whole", (OTHER, 0.0))
        best = max(best, now.get("alone", 0.0))
        return (INSULT, best) if best > kind[1] else kind


class Lexical(dict):
    """Word as written -> class and weight, by the automaton; bounded."""

    def __init__(self, grammar: Grammar):
        super().__init__()
        self.automaton = Automaton(grammar.prefixes)

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = self.automaton.read(bare(word))
        return found


def features(core: str) -> list[str]:
    """What a word can be known by: its prefixes and, with an end mark, itself."""
    return [core[:k] for k in PREFIXES if len(core) >= k] + ([core + "$"] if core else [])


def document_scores(text: str, lexical: Lexical) -> tuple[float, float, float]:
    """Sum and maximum of the clauses' scores, and the number of clauses that matched."""
    words = text.split()
    if not any(weight for _, weight in map(lexical.__getitem__, set(words))):
        return 0.0, 0.0, 0.0
    scores = [GRAMMAR.run([lexical[w] for w in clause.split()]) for clause in CLAUSE_END.split(text)]
    found = [s for s in scores if s]
    return sum(found), max(found, default=0.0), float(len(found))


def with_matches(df: DataFrame, grammar: Grammar, text_col: str, out_col: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(grammar)

    @F.arrow_udf("total double, peak double, clauses double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexical = lexical_of(shared.value)
        for texts in batches:
            rows = [document_scores(t, lexical) if t else (0.0, 0.0, 0.0) for t in values(texts)]
            cols = [pa.array([r[i] for r in rows], pa.float64()) for i in range(3)]
            yield pa.StructArray.from_arrays(cols, names=["total", "peak", "clauses"])

    return df.withColumn(out_col, run(F.col(text_col)))


_LAST: list = []


def lexical_of(grammar: Grammar) -> Lexical:
    if not _LAST or _LAST[0] is not grammar:
        _LAST[:] = [grammar, Lexical(grammar)]
    return _LAST[1]


def sampled(rows: DataFrame, label_col: str, key_col: str) -> DataFrame:
    """About SAMPLE_POSITIVE and SAMPLE_NEGATIVE of the labelled rows, by a hash of their key; all if there are fewer."""
    n = {r[0]: r[1] for r in rows.groupBy(label_col).count().collect()}
    share = F.when(F.col(label_col) == 1, SAMPLE_POSITIVE / max(1, n.get(1, 0))).otherwise(SAMPLE_NEGATIVE / max(1, n.get(0, 0)))
    return rows.where(F.pmod(F.xxhash64(F.lit("toxicity"), key_col), F.lit(1_000_000)) < share * 1_000_000)


def count_features(rows: DataFrame, wanted=None) -> dict[str, list[int]]:
    """Documents of each half that have a feature. Without `wanted`, only features that reach the least support in all
    come to the driver: with support of 1 % of the rows, their number is bounded however many rows there are."""
    keep = rows.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, half in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {f for w in set((text or "").split()) for f in features(bare(w))}
                seen[half].update(own if keep is None else own & keep.value)
        names = list(seen[0] | seen[1])
        counts = [pa.array([c[f] for f in names], pa.int64()) for c in seen]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], names=["feature", "n0", "n1"])

    found = rows.select("_text", "_half").mapInArrow(count, "feature string, n0 long, n1 long")
    found = found.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    if wanted is None:
        found = found.where(F.col("n0") + F.col("n1") >= support(rows.count()))
    return {r.feature: [r.n0, r.n1] for r in found.collect()}


def support(rows: int) -> int:
    return max(3, round(0.01 * rows))


def weigh(pos: dict, neg: dict, n_pos: int, n_neg: int, part) -> dict[str, float]:
    """Features that mark label 1 in a part of the rows: a smoothed log ratio of document counts, kept where many
    documents support it and few speak against it."""
    weights = {}
    for f, counts in pos.items():
        a, b = part(counts), part(neg.get(f, [0, 0]))
        if a >= max(2, round(0.01 * n_pos)):
            ratio = np.log((a + 0.5) / (n_pos + 1)) - np.log((b + 0.5) / (n_neg + 1))
            if ratio > 3.0:
                weights[f] = float(min(4.0, ratio / 2))
    return weights


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Ridge-penalised coefficients, bias first, classes weighted alike; Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(min(steps, 30)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (share * (p - y)) + ridge @ w)
    return w


def scaled(total, peak, clauses):
    return np.c_[np.log1p(total), peak > 0, np.log1p(clauses)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """Learns the insult weights and the coefficients from rows of `docs` that `labels` covers."""
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    # The sample is drawn from the labels, so that texts stay where they are: its bound makes it safe to broadcast.
    marks = F.broadcast(sampled(marks, "_label", "_id"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") > 0)
    rows = rows.join(marks, "_id").withColumn("_half", F.xxhash64(F.lit("half"), "_id").bitwiseAND(1).cast("int")).persist()
    try:
        n = {(r[0], r[1]): r[2] for r in rows.groupBy("_label", "_half").count().collect()}
        n_pos, n_neg = [n.get((1, h), 0) for h in (0, 1)], [n.get((0, h), 0) for h in (0, 1)]
        if not sum(n_pos) or not sum(n_neg):
            return Grammar()
        pos = count_features(rows.where("_label = 1"))
        neg = count_features(rows.where("_label = 0"), frozenset(pos))
        # The coefficients come from matches of lexicons that were learned on the other half of the rows.
        seen = []
        for h in (0, 1):
            other = Grammar(weigh(pos, neg, n_pos[1 - h], n_neg[1 - h], lambda c, h=h: c[1 - h]))
            seen.append(with_matches(rows.where(F.col("_half") == h), other, "_text", "_m").select("_label", "_m.*").toPandas())
    finally:
        rows.unpersist()
    lexicon = weigh(pos, neg, sum(n_pos), sum(n_neg), sum)
    total, peak, clauses, label = (np.concatenate([s[c].to_numpy(float) for s in seen]) for c in ("total", "peak", "clauses", "_label"))
    w = logistic(scaled(total, peak, clauses), label)
    return Grammar(lexicon, float(w[0]), tuple(map(float, w[1:])))


def score(df: DataFrame, grammar: Grammar, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """`df` with `out_col`: how likely `text_col` is toxic, 0 to 1."""
    m = scratch(df, "_matches")
    a, b, c = grammar.slopes
    z = grammar.bias + a * F.log1p(f"{m}.total") + b * (F.col(f"{m}.peak") > 0).cast("double") + c * F.log1p(f"{m}.clauses")
    return with_matches(df, grammar, text_col, m).withColumn(out_col, 1 / (1 + F.exp(-z))).drop(m)
