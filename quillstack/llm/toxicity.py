"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words map to symbols (insult, threat, target, negation, speech verb, other).
Small transducers over those symbols are composed into one machine:

* ``NEGATION`` remembers a negation for the next three words,
* ``REPORT`` remembers a speech verb until the clause ends,
* ``TARGET`` remembers a person word for the next four words.

Reading an insult or threat, the machine emits one pattern (plain, targeted,
negated, reported; for insults and threats).  A clause's score is the sum of
its patterns' arc weights times the weight of the matched term, so no word is
scored by itself.  Arc weights start from fixed prior values and are fitted,
with the prior as centre, on labelled rows.  Terms are a short fixed seed list
plus words and word beginnings that the labelled rows show to be toxic.  A learnt
term is a threat if in toxic rows its object, a person word right after it,
follows it at least as often as not, like a verb's; else it is an insult.

The fit uses at most ``MAX_LABELLED`` labelled rows (lowest id hash first);
scoring covers every text, whole.  Model size is bounded by ``MAX_TERMS``.

Defined cases: null, blank or wordless texts match nothing and get the base
score; repeated label rows of one id count once, toxic if any is; no labels at
all leaves the prior weights; rows keep their columns and order of columns;
names ``toxicity`` of the input are replaced.  Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import fold, table

MAX_LABELLED = 30_000
MAX_TERMS = 4096
THRESHOLD = 0.7
STEMS = (4, 5, 6)
#: Least log-likelihood gain (nats) of a learnt term; e**-16 is far below one over the number of words tried.
EVIDENCE = 16.0
_REMEMBERED = 200_000
_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

INSULTS = "idiot moron imbecile scumbag bastard dumbass idiota imbécil pendejo connard salaud abruti dummkopf arschloch vollidiot".split()
THREATS = "kill murder stab strangle tuer égorger matar asesinar töten umbringen erschlagen".split()
TARGETS = "you your you're yourself he she they them these those tu toi vous ils eux usted ustedes ellos du dich euch ihr sie".split()
NEGATIONS = "not never no isn't aren't don't nobody ne pas jamais nunca ningún nicht kein keine niemals".split()
SPEECH = "said says wrote reported claimed quoted alleged dit écrit affirma dijo escribió afirmó sagte schrieb behauptete".split()
SYMBOLS = "insult threat target negation speech other".split()


class Transducer:
    """Deterministic machine: (state, symbol) -> (state, mark); marks name what holds at that symbol."""

    def __init__(self, start: tuple, step):
        self.start, self.step = start, step

    def compose(self, other: Transducer) -> Transducer:
        def step(state, symbol):
            (a, x), (b, y) = self.step(state[0], symbol), other.step(state[1], symbol)
            return (a, b), x | y

        return Transducer((self.start, other.start), step)


def _window(symbol: str, mark: str, length: int) -> Transducer:
    """Holds ``mark`` for the ``length`` symbols after ``symbol``."""
    return Transducer(0, lambda left, s: (length if s == symbol else max(0, left - 1), frozenset([mark] if left and s != symbol else ())))


NEGATION = _window("negation", "negated", 3)
TARGET = _window("target", "targeted", 4)
REPORT = Transducer(False, lambda on, s: (on or s == "speech", frozenset(["reported"] if on else ())))
PATTERNS = [f"{kind}_{how}" for kind in ("insult", "threat") for how in ("plain", "targeted", "negated", "reported")]
#: Prior arc weights, in the order of PATTERNS, then the clause maximum.
PRIOR = np.array([5.0, 6.0, 1.0, 1.0, 2.0, 5.0, 0.5, 0.5, 3.0])
PRIOR_BASE = -4.0


def compiled(machine: Transducer) -> tuple[list[list[int]], list[list[int]]]:
    """Tables of the reachable states: next state and emitted pattern (-1: none) by state and symbol."""
    states, goto, emit = {machine.start: 0}, [], []
    queue = [machine.start]
    for state in queue:
        row, out = [], []
        for symbol in SYMBOLS:
            nxt, marks = machine.step(state, symbol)
            if nxt not in states:
                states[nxt] = len(states)
                queue.append(nxt)
            row.append(states[nxt])
            how = next((m for m in ("reported", "negated", "targeted") if m in marks), "plain")
            out.append(PATTERNS.index(f"{symbol}_{how}") if symbol in ("insult", "threat") else -1)
        goto.append(row)
        emit.append(out)
    return goto, emit


GOTO, EMIT = compiled(NEGATION.compose(TARGET).compose(REPORT))
_FIXED = {w: SYMBOLS.index(k) for k, ws in (("speech", SPEECH), ("negation", NEGATIONS), ("target", TARGETS), ("threat", THREATS), ("insult", INSULTS)) for w in ws}


@dataclass
class Grammar:
    """Terms with weights, arc weights, base; small and picklable."""

    whole: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    threats: frozenset[tuple[str, bool]] = frozenset()  # learnt ones: term, and whether it is a word's beginning
    arcs: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    base: float = PRIOR_BASE

    def symbol(self, word: str) -> tuple[int, float]:
        weight, term = self.whole.get(word, 0.0), (word, False)
        for n in STEMS:
            if len(word) > n and (w := self.stems.get(word[:n], 0.0)) > weight:
                weight, term = w, (word[:n], True)
        if weight:
            return int(term in self.threats), weight
        fixed = _FIXED.get(word, 5)
        return fixed, 1.0 if fixed < 2 else 0.0

    def features(self, texts: Iterator[str | None]) -> np.ndarray:
        """Per text: log1p of each pattern's summed term weights, and the largest clause score."""
        known: dict[str, tuple[int, float]] = {}
        hot: set[str] = set()
        rows = []
        for text in texts:
            row = np.zeros(len(PATTERNS) + 1)
            rows.append(row)
            low = (text or "").lower()
            seen = set(_WORD.findall(low))
            if len(known) > _REMEMBERED:
                known, hot = {}, set()
            for word in seen.difference(known):
                known[word] = s = self.symbol(word)
                if s[0] < 2:
                    hot.add(word)
            if hot.isdisjoint(seen):
                continue
            for clause in _CLAUSE.split(low):
                tokens = _WORD.findall(clause)
                if hot.isdisjoint(tokens):
                    continue
                state, score = 0, 0.0
                for word in tokens:
                    s, weight = known.get(word) or self.symbol(word)
                    if (out := EMIT[state][s]) >= 0:
                        row[out] += weight
                        score += weight * PRIOR[out] / PRIOR[0]
                    state = GOTO[state][s]
                row[-1] = max(row[-1], score)
        out = np.array(rows).reshape(len(rows), len(PATTERNS) + 1)
        return np.log1p(out)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + features @ self.arcs, -30, 30)))


def _fit_arcs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, pulled towards the prior arcs."""
    centre = np.append(PRIOR, PRIOR_BASE)
    ridge = np.append(np.full(len(PRIOR), 0.5), 0.01)
    x1, w = np.column_stack([x, np.ones(len(x))]), centre.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(ridge), x1.T @ (y - p) - ridge * (w - centre))
        w += step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    w[: len(PRIOR)] = np.maximum(w[: len(PRIOR)], 0.0)  # a pattern never speaks for a clean text
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, train, max_labelled: int = MAX_LABELLED) -> Grammar:
    """Grammar learnt from rows of ``labels`` that fulfil ``train`` (a Column over doc_id)."""
    chosen = (
        labels.filter(train & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows of 12 bytes
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))
    spelled = rows.select("toxic", F.explode(F.array_distinct(found)).alias("word"))
    n = chosen.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    pos, neg = int(n[0]), int(n[1]) - int(n[0])
    if not pos or not neg:
        return Grammar(whole=dict.fromkeys(INSULTS, 1.0))
    counted = spelled.groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    stem = counted.filter(F.length("word") > 4).select(F.explode(F.array(*[F.when(F.length("word") > k, F.left("word", F.lit(k))) for k in STEMS])).alias("term"), "pos", "neg").filter("term IS NOT NULL")
    stem = stem.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count_if(F.col("pos") > 0).alias("kinds")).filter("kinds >= 3").withColumn("stem", F.lit(True)).drop("kinds")
    odds = F.log(((F.col("pos") + 0.1) / pos) / ((F.col("neg") + 0.5) / neg))
    share, rate = F.col("pos") / (F.col("pos") + F.col("neg")), pos / (pos + neg)
    evidence = F.col("pos") * F.log(share / rate) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - rate))).otherwise(0)
    terms = (
        counted.select(F.col("word").alias("term"), "pos", "neg", F.lit(False).alias("stem")).unionByName(stem)
        .withColumn("odds", odds).filter(F.col("pos") >= 3).filter("odds >= 3").filter(evidence >= EVIDENCE)
        .orderBy(F.desc(F.col("pos") * F.col("odds")), "term", "stem").limit(MAX_TERMS).collect()
    )
    weigh = lambda t: min(2.0, t["odds"] / 4)
    grammar = Grammar({t["term"]: weigh(t) for t in terms if not t["stem"]}, {t["term"]: weigh(t) for t in terms if t["stem"]})
    grammar.threats = _threats(rows.filter("toxic = 1"), grammar)
    for word in INSULTS:
        grammar.whole.setdefault(word, 1.0)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame(grammar.features(b["text"]), columns=[f"f{i}" for i in range(len(PATTERNS) + 1)])
            out["y"] = b["toxic"].to_numpy()
            yield out

    schema = ", ".join(f"f{i} double" for i in range(len(PATTERNS) + 1)) + ", y int"
    sums = rows.select("text", "toxic").mapInPandas(measure, schema)
    # equal feature rows are counted together: few rows reach the driver, max_labelled at most
    data = sums.groupBy(*[c for c in sums.columns]).agg(F.count("*").alias("n")).toPandas()
    data = data.sort_values(list(data.columns)).to_numpy(float)
    data = np.repeat(data[:, :-1], data[:, -1].astype(int), axis=0)
    grammar.arcs, grammar.base = _fit_arcs(data[:, :-1], data[:, -1])
    return grammar


def _threats(toxic: DataFrame, grammar: Grammar) -> frozenset[tuple[str, bool]]:
    """The terms of ``grammar`` that take a person word as their object in the texts of ``toxic``."""
    terms = [(t, len(t), False) for t in grammar.whole] + [(t, len(t), True) for t in grammar.stems]
    if not terms:
        return frozenset()
    held = toxic.sparkSession.createDataFrame(terms, "term string, size int, stem boolean")  # MAX_TERMS rows at most
    word = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+(?:'\p{L}+)?)"), F.lit(1))
    after = toxic.select(word.alias("w")).select(F.inline(F.transform("w", lambda x, i: F.struct(x.alias("word"), F.coalesce(F.get("w", i + 1).isin(*TARGETS), F.lit(False)).alias("aimed")))))
    counted = after.groupBy("word").agg(F.count("*").alias("n"), F.count_if("aimed").alias("aimed"))
    is_term = ((F.col("word") == F.col("term")) & ~F.col("stem")) | ((F.left("word", F.col("size")) == F.col("term")) & F.col("stem") & (F.length("word") > F.col("size")))
    sizes = sorted({n for _, n, _ in terms})
    cut_at = counted.select("*", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("size")).withColumn("term", F.left("word", F.col("size"))).filter(F.length("word") >= F.col("size"))
    found = cut_at.join(F.broadcast(held), ["term", "size"]).filter(is_term).groupBy("term", "stem").agg(F.sum("n").alias("n"), F.sum("aimed").alias("aimed"))
    return frozenset((r["term"], r["stem"]) for r in found.filter("2 * aimed >= n").collect())


def score(docs: DataFrame, grammar: Grammar, to: str = "toxicity") -> DataFrame:
    """``docs`` with the score of its text in column ``to``; one map over the rows, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(grammar)  # MAX_TERMS bounds it

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        g = held.value
        for texts in parts:
            yield pd.Series(g.score(g.features(texts)))

    return docs.withColumn(to, scored(F.col("text")))


def train_rows():
    return fold("doc_id", 3) != 1


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = fit(docs, table(spark, sf_dir, "labels"), train_rows())
    out = score(docs, grammar)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents scored at or above the threshold."""
    grammar = fit(docs, labels, train_rows())
    return score(docs, grammar, "__toxicity").filter(F.col("__toxicity") < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
