"""Toxicity by a weighted finite-state pattern grammar over clauses.

Word classes feed composed transducers: one marks insults and threats, the others carry whether the clause has named a
target, whether a negation still governs the next words, and whether the clause reports what somebody said. They run in
step over one reading of a clause; their composition is one table. A match weighs what its word weighs, shifted by the
contexts it stands in; a document's score comes from its matched clauses through a logistic layer.

The insult words and stems are learned from labelled documents, since they differ by corpus and language: a word or a
word beginning that stands far more often in toxic documents than in clean ones gets its log-odds as weight. Threats are
a closed class, whose words get their log-odds too (1 if they do not occur, 0 at least). The weights of contexts and the logistic layer are learned from other labelled documents than the words. Rows held out (CRC-32 of the
id as text, modulo 5, is 0) are never learned from. Labels, language, source and id are no inputs of a score.

Defined cases: a null or empty text matches nothing and scores as such texts do; without labelled rows of both kinds
every score is 0; repeated rows score alike; an empty table gives no rows; documents are read whole, whatever their
length; a null id counts as ''.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import map_arrow, materialize, slices, table

#: Labelled documents of each kind that are learned from, at most about. Patterns are as many as the sample gives.
SAMPLE_ROWS = 15_000
#: A pattern must stand in so many toxic documents, and so many times more often than in clean ones.
LEAST_SUPPORT, LEAST_RATIO = 5, 15.0
STEM_LENGTHS = range(4, 9)

# Closed word classes in four languages.
TARGETS = frozenset("you your yours u he him she her they them du dich dir dein ihr euch sie ihn tu te toi ton vous votre ils elles tú ti usted ustedes vosotros ellos ellas".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't doesn't nobody without nicht kein keine keinen nie niemals ohne pas ne jamais aucun aucune sans nunca jamás ningún ninguna sin".split())
REPORTS = frozenset("said says say called calls wrote writes quoted reported claims claimed sagte sagt nannte schrieb berichtete dit disait appelle écrit rapporte dijo dice llamó escribió informó".split())
THREATS = frozenset("kill kills killing murder hurt destroy shoot stab burn umbringen töten schlagen vernichten tuer frapper détruire matar golpear destruir".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]+")
_CLAUSE_ENDS = frozenset(".!?;:\n")


class Transducer:
    """A deterministic transducer over word classes: next_state[state][class], and output[state][class]."""

    def __init__(self, next_state: list[list[int]], output: list[list[tuple]]):
        self.next_state, self.output = next_state, output

    def compose(self, other: "Transducer") -> "Transducer":
        """Both read the same classes in step; states are pairs, outputs are joined."""
        m = len(other.next_state)
        pairs = list(itertools.product(range(len(self.next_state)), range(m)))
        following = [[self.next_state[a][c] * m + other.next_state[b][c] for c in range(6)] for a, b in pairs]
        output = [[self.output[a][c] + other.output[b][c] for c in range(6)] for a, b in pairs]
        return Transducer(following, output)


def _flag(sets: dict[int, int], states: int, decay: bool = False) -> Transducer:
    """Outputs whether its state is over 0. A class of `sets` puts it in that state; with `decay` it counts down at other words."""
    following = [[sets.get(c, max(0, s - 1) if decay else s) for c in range(6)] for s in range(states)]
    return Transducer(following, [[(int(s > 0),)] * 6 for s in range(states)])


def grammar() -> Transducer:
    """Outputs (kind, targeted, negated, reported) at each word; kind is 1 for an insult, 2 for a threat, else 0."""
    kind = Transducer([[0] * 6], [[(0,), (1,), (2,), (0,), (0,), (0,)]])
    return kind.compose(_flag({TARGET: 1}, 2)).compose(_flag({NEGATION: 3}, 4, decay=True)).compose(_flag({REPORT: 1}, 2))


#: Features of a document: log counts of matches by (kind, targeted, negated, reported), weight of the heaviest clause, log of the total weight, matched clauses per log word.
N_FEATURES = 2 * 8 + 3


class Grammar:
    """The composed transducers over learned patterns (word or stem* -> weight)."""

    def __init__(self, patterns: dict[str, float], threats: dict[str, float], contexts: bool = True):
        """Without `contexts` targets, negations and reports are words like others."""
        import ahocorasick

        self.threats = threats
        closed = ((NEGATION, NEGATIONS), (REPORT, REPORTS), (TARGET, TARGETS)) if contexts else ()
        self.closed = {word: kind for kind, words in reversed(closed) for word in words}

        self.words = {p: w for p, w in patterns.items() if not p.endswith("*")}
        self.stems = {p[:-1]: w for p, w in patterns.items() if p.endswith("*")}
        self.longest = max(map(len, self.stems), default=0)
        self.shortest = min(map(len, self.stems), default=1)
        self.table = grammar()
        self.finder = ahocorasick.Automaton()
        for p in {*self.words, *self.stems, *THREATS}:
            self.finder.add_word(p, len(p))
        self.finder.make_automaton()
        self.known: dict[str, tuple[int, float]] = {}

    def classify(self, word: str) -> tuple[int, float]:
        """(class, weight); a learned pattern comes before the closed classes, the heaviest stem before lighter ones."""
        weight = max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in range(self.shortest, min(self.longest, len(word)) + 1))])
        if weight > 0:
            return INSULT, weight
        if word in THREATS:
            return THREAT, self.threats.get(word, 1.0)
        return self.closed.get(word, OTHER), 0.0

    def may_match(self, text: str) -> bool:
        return any(end - n < 0 or not text[end - n].isalpha() for end, n in self.finder.iter(text))

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(N_FEATURES)
        text = (text or "").lower()
        if not text or not self.may_match(text):
            return out
        if len(self.known) > 200_000:
            self.known.clear()
        known, classify, following, output = self.known, self.classify, self.table.next_state, self.table.output
        counts: Counter = Counter()
        heaviest = total = clause = 0.0
        clauses = words = state = 0
        for m in _WORD.finditer(text):
            word = m.group()
            if word[0] in _CLAUSE_ENDS:
                heaviest, clauses = max(heaviest, clause), clauses + (clause > 0)
                state, clause = 0, 0.0
                continue
            words += 1
            found = known.get(word)
            if found is None:
                found = known[word] = classify(word)
            if found[0]:
                kind, targeted, negated, reported = output[state][found[0]]
                if kind:
                    counts[(kind - 1) * 8 + targeted * 4 + negated * 2 + reported] += 1
                    clause += found[1]
                    total += found[1]
                state = following[state][found[0]]
            elif state:
                state = following[state][OTHER]
        heaviest, clauses = max(heaviest, clause), clauses + (clause > 0)
        for k, n in counts.items():
            out[k] = math.log1p(n)
        out[16:] = heaviest, math.log1p(total), clauses / math.log(words + 2)
        return out


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Newton's method with a ridge on standardised features; a step is halved until the loss falls. The last weight is the bias.

    Matches part the two kinds almost without fault, so plain Newton steps would run off; the loss is convex, so halved ones cannot.
    """
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    x = np.hstack([x / scale, np.ones((len(x), 1))])
    penalty = np.append(np.full(len(scale), ridge), 1e-6)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * w * w).sum())

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        size = 1.0
        while loss(w - size * step) > now - 1e-4 * size * float(slope @ step) and size > 1e-8:
            size /= 2
        w, before, now = w - size * step, now, loss(w - size * step)
        if before - now < 1e-9 * abs(now):
            break
    return np.append(w[:-1] / scale, w[-1])


def _fold(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


class Model:
    def __init__(self, patterns: dict[str, float], weights: np.ndarray | None, threats: dict[str, float] | None = None, contexts: bool = True):
        self.patterns, self.weights, self.threats, self.contexts = patterns, weights, threats or {}, contexts
        self.grammar: Grammar | None = None

    def __getstate__(self):
        return {**self.__dict__, "grammar": None}

    def features(self, texts: list[str | None]) -> np.ndarray:
        if self.grammar is None:
            self.grammar = Grammar(self.patterns, self.threats, self.contexts)
        return np.array([self.grammar.features(t) for t in texts]).reshape(len(texts), N_FEATURES)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each kind that hold a word."""
    counts = {0: Counter(), 1: Counter()}
    for part in slices(batches, "text"):
        for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
            counts[toxic].update({w for w in _WORD.findall((text or "").lower()) if w[0] not in _CLAUSE_ENDS})
    words = list({*counts[0], *counts[1]})
    for at in range(0, len(words), 50_000):
        some = words[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([counts[1][w] for w in some], pa.int64()), pa.array([counts[0][w] for w in some], pa.int64())], ["word", "bad", "good"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, contexts: bool = True) -> Model:
    """Learns from at most about `sample_rows` labelled documents of each kind, none of them held out. Without `contexts` only the words count."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", _fold()).where("fold != 0")
    sizes = dict(usable.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return Model({}, None)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    keep = F.when(F.col("toxic") == 1, share < min(1.0, sample_rows / sizes[1])).otherwise(share < min(1.0, sample_rows / sizes[0]))
    rows = F.broadcast(usable.where(keep))  # at most about twice sample_rows ids
    sample = materialize(docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(rows, "doc_id").dropDuplicates(["text", "toxic"]), "toxic-sample")  # copies are one witness
    learn, tune = sample.where("fold != 4"), sample.where("fold = 4")
    totals = {t: n for t, n in learn.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model({}, None)
    words = map_arrow(learn.select("text", "toxic"), _word_counts, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    stems = words.select(F.explode(F.array(F.struct(F.col("word").alias("p")), *[F.struct(F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))).alias("p")) for n in STEM_LENGTHS])).alias("s"), "bad", "good")
    found = stems.select("s.p", "bad", "good").where("p IS NOT NULL").groupBy("p").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / F.lit(totals[1] + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(totals[0] + 1.0))
    best = found.withColumn("w", odds).where(F.col("p").isin(sorted(THREATS)) | (F.col("bad") >= LEAST_SUPPORT) & (F.col("w") >= math.log(LEAST_RATIO)))
    learned = {r.p: r.w for r in best.select("p", "w").collect()}  # words and stems of a bounded sample
    threats = {p: min(6.0, max(0.0, w)) for p, w in learned.items() if p in THREATS}
    patterns = {p: min(6.0, w) for p, w in learned.items() if p not in THREATS}
    reader = Model(patterns, None, threats, contexts)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = reader.features(part.column("text").to_pylist()).tolist()
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    held = map_arrow(tune.select("text", "toxic"), kernel, "toxic int, x array<double>").toArrow()
    y = np.asarray(held.column("toxic"), float)
    if len(set(y)) < 2:
        return Model(patterns, None, threats, contexts)
    return Model(patterns, _fit_logistic(np.array(held.column("x").to_pylist()).reshape(-1, N_FEATURES), y), threats, contexts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            p = sent.value.score(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = map_arrow(wanted, kernel, "doc_id long, score double")
    return scored.select("doc_id", (_fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all their columns, that the model does not call toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    if model.weights is None:
        return docs

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield part.filter(pa.array(sent.value.score(part.column("text").to_pylist()) < 0.5))

    return map_arrow(docs, kernel, schema)


def op7_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
