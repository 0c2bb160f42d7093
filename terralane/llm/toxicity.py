"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon turns words into symbols: insults with weights learned from labelled documents, and threats, targets, negations and
words of reported speech. Small transducers read the symbols of a clause: one marks insults, one threats against a target, and others
what stands under a negation, in reported speech or near a target. Their composition reads each clause once; the clause's marks and its
heaviest insult make it a match of one kind. A document's matched clauses are summed by kind, and a logistic model of these sums, learned from
labels too, gives the score.
"""

from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import free, stored, tidy
from .fingerprints import with_sketch

#: Labelled documents that the model is fit on at most: those whose ids hash lowest. They bound the lexicon too.
MAX_TRAIN = 20_000
#: Words count for the lexicon when so many toxic documents have them.
MIN_SUPPORT = 5
#: Lower end of a word's log odds ratio from which it is an insult.
MIN_WEIGHT = 1.8
STEMS = range(3, 9)
HELD_OUT_OF = 5

# Function words of the four languages of the corpus.
TARGETS = "you your yours yourself he him his she her they them their du dich dir dein deine ihr euch sie ihn ihm er vous votre vos toi ton ta il elle ils elles tu te tus usted ustedes él ella ellos ellas vosotros".split()
NEGATIONS = "not no never none isn't aren't wasn't don't nicht kein keine keiner nie niemals pas jamais aucun aucune ni nunca ningún ninguna jamás".split()
REPORTS = "said says say saying told tells called calls claims claimed wrote writes quote quoted sagte sagt sagten schrieb nannte dit dits disait écrit appelé dijo dice dicen llamó escribió".split()
THREATS = "kill hurt beat destroy die murder attack töten umbringen schlagen sterben tuer frapper mourir matar golpear morir".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
CLAUSE_END = re.compile(r"[.,;:!?]+[\W\d_]*$")
NEAR = 4


@dataclass
class Transducer:
    """(state, symbol) -> state, and the mark that a state gives to an insult or threat. Missing moves lead to `other`."""

    moves: dict[tuple[int, int], int]
    other: dict[int, int]
    marks: dict[int, int]
    start: int = 0

    def step(self, state: int, symbol: int) -> int:
        return self.moves.get((state, symbol), self.other[state])

    def compose(self, after: Transducer) -> Transducer:
        """Both read the same symbols; the mark of a pair of states joins those of both."""
        number = {(self.start, after.start): 0}
        todo, moves, other, marks = [(self.start, after.start)], {}, {}, {}
        while todo:
            a, b = pair = todo.pop()
            n = number[pair]
            marks[n] = self.marks[a] | after.marks[b]
            for symbol in range(OTHER + 1):
                to = (self.step(a, symbol), after.step(b, symbol))
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                if symbol == OTHER:
                    other[n] = number[to]
                else:
                    moves[n, symbol] = number[to]
        return Transducer(moves, other, marks)


def just(symbol: int, mark: int) -> Transducer:
    """Marks the symbol itself."""
    return Transducer({(s, symbol): 1 for s in (0, 1)}, {0: 0, 1: 0}, {0: 0, 1: mark})


def within(symbol: int, reach: int, mark: int) -> Transducer:
    """Marks what follows a symbol within `reach` words."""
    states = range(reach + 2)
    return Transducer({(s, symbol): reach + 1 for s in states}, {s: max(0, s - 1) for s in states}, {s: mark if s else 0 for s in states})


def since(symbol: int, mark: int) -> Transducer:
    """Marks all that follows a symbol in the clause."""
    return Transducer({(s, symbol): 1 for s in (0, 1)}, {0: 0, 1: 1}, {0: 0, 1: mark})


def followed(first: int, then: int, reach: int, mark: int) -> Transducer:
    """Marks the second symbol where the first stands at most `reach` words before it."""
    hit = reach + 2
    states = range(reach + 3)
    moves = {(s, first): reach + 1 for s in states} | {(s, then): hit for s in states if 1 < s < hit} | {(s, then): 0 for s in (0, 1, hit)}
    return Transducer(moves, {s: 0 if s in (0, hit) else s - 1 for s in states}, {s: mark if s == hit else 0 for s in states})


NEGATED, REPORTED, AIMED, INSULTED, THREATENED, AT_TARGET = (1 << i for i in range(6))
INSULTS = just(INSULT, INSULTED)
#: A threat with its target behind it, or (with AIMED) before it.
THREAT_RULE = just(THREAT, THREATENED).compose(followed(THREAT, TARGET, NEAR, AT_TARGET))
CONTEXT = within(NEGATION, NEAR, NEGATED).compose(since(REPORT, REPORTED)).compose(within(TARGET, NEAR, AIMED))
GRAMMAR = INSULTS.compose(THREAT_RULE).compose(CONTEXT)
#: Sums of a document's clauses by kind, the share of its clauses that match, and the heaviest one.
FIELDS = ["plain", "negated", "reported", "aimed", "threats", "share", "most"]
#: Tokens kept in a task's cache. Beyond it the older half stays: frequent tokens are met first.
CACHE_TOKENS = 200_000


def word_of(token: str) -> str:
    return EDGE.sub("", token).lower()


def features_of(word: str) -> list[str]:
    """The whole word, and its beginnings as stems."""
    return [f"={word}", *(f"^{word[:k]}" for k in STEMS if k <= len(word))] if len(word) >= 3 else []


@dataclass
class Grammar:
    """The lexicon with the composed transducer."""

    weights: dict[str, float]
    fixed: dict[str, int] = field(default_factory=lambda: {w: s for s, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in words})
    cache: dict[str, tuple[int, float, bool]] = field(default_factory=dict)
    #: Tokens met so far that are insults or threats.
    hot: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.starts = {f[1:4] for f in self.weights}

    def symbol(self, token: str) -> tuple[int, float, bool]:
        """Symbol, weight, and whether the clause ends behind the token."""
        word = word_of(token)
        weight = max((self.weights.get(f, 0.0) for f in features_of(word)), default=0.0) if word[:3] in self.starts else 0.0
        kind = INSULT if weight else self.fixed.get(word, OTHER)
        return kind, weight, CLAUSE_END.search(token) is not None

    def learn(self, tokens: list[str]) -> None:
        new = set(tokens).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_TOKENS:
            self.cache = dict(itertools.islice(self.cache.items(), CACHE_TOKENS // 2))
            self.hot &= self.cache.keys()
            new = set(tokens).difference(self.cache)
        for t in new:
            self.cache[t] = found = self.symbol(t)
            if found[0] <= THREAT:
                self.hot.add(t)

    def sums(self, text: str) -> list[float]:
        """FIELDS of a text."""
        tokens = text.split()
        self.learn(tokens)
        out = dict.fromkeys(FIELDS, 0.0)
        if not self.hot.isdisjoint(tokens):
            clauses = matched = 0
            for insult, threat, seen, ends in self.clauses(tokens):
                clauses += ends
                weight = 0.0
                if insult:
                    weight = insult
                    out["negated" if seen & NEGATED else "reported" if seen & REPORTED else "plain"] += insult
                    if seen & AIMED:
                        out["aimed"] += insult
                if threat:
                    weight += 1.0
                    out["threats"] += 1.0
                matched += weight > 0
                out["most"] = max(out["most"], weight)
            out["share"] = matched / clauses
        return [math.log1p(v) if k != "share" else v for k, v in out.items()]

    def clauses(self, tokens: list[str]):
        """(weight of the clause's insults, whether it threatens, the marks at its heaviest insult, 1) of each clause."""
        state, insult, top, threat, seen, any_word = GRAMMAR.start, 0.0, 0.0, False, 0, False
        for kind, weight, ends in map(self.cache.__getitem__, tokens):
            state = GRAMMAR.step(state, kind)
            mark = GRAMMAR.marks[state]
            any_word = True
            if mark & INSULTED:
                insult += weight
                if weight > top:
                    top, seen = weight, mark
            if not mark & (NEGATED | REPORTED) and (mark & AT_TARGET or (mark & THREATENED and mark & AIMED)):
                threat = True
            if ends:
                yield insult, threat, seen, 1
                state, insult, top, threat, seen, any_word = GRAMMAR.start, 0.0, 0.0, False, 0, False
        if any_word:
            yield insult, threat, seen, 1


@dataclass
class Model:
    weights: dict[str, float]
    coefficients: list[float]
    intercept: float

    def score(self, sums: list[float]) -> float:
        z = self.intercept + sum(c * x for c, x in zip(self.coefficients, sums))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(True))


def weights_of(counts: DataFrame, t: str, c: str) -> dict[str, float]:
    """Lower ends of the log odds ratios of words and stems between toxic (t) and other (c) documents, from MIN_WEIGHT on."""
    sums = counts.where("feature = ''").select(F.expr(t).alias("t"), F.expr(c).alias("c")).first()
    if sums is None or not sums["t"]:
        return {}
    found = counts.where("feature <> ''").select("feature", F.expr(t).alias("t"), F.expr(c).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (sums["t"] + 1)) - F.log((F.col("c") + 0.5) / (sums["c"] + 1))
    low = odds - 1.64 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    return {r["feature"]: r["w"] for r in found.where(F.col("t") >= MIN_SUPPORT).select("feature", low.alias("w")).where(F.col("w") >= MIN_WEIGHT).collect()}


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, t0, c0, t1, c1): the toxic and other documents of each half that have a word or stem; feature '' counts them all."""

    def counted(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic, half in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = {""}
                for word in {word_of(t) for t in text.split()}:
                    found.update(features_of(word))
                at = 2 * half + (1 - toxic)
                for f in found:
                    counts.setdefault(f, [0, 0, 0, 0])[at] += 1
        # a stem without a toxic document in this task can still have clean ones that count elsewhere
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(4))], ["feature", "t0", "c0", "t1", "c1"])

    parts = sample.select("text", "toxic", "half").mapInArrow(tidy(counted), "feature string, t0 long, c0 long, t1 long, c1 long")
    return parts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")))


def half_sums(sample: DataFrame, weights: tuple[dict, dict]) -> DataFrame:
    """(toxic, sums array<double>) of the sample, each row under the lexicon of the other half."""
    shared = sample.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        grammars = [Grammar(w) for w in shared.value]
        for batch in batches:
            sums = [grammars[1 - half].sums(t) for t, half in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sums, pa.list_(pa.float64()))], ["toxic", "sums"])

    return sample.select("text", "toxic", "half").mapInArrow(tidy(run), "toxic int, sums array<double>")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labels.toxic of rows that aren't held out; the scores are fit on sums under the other half's lexicon.

    Labels without a document, null labels and null ids count for nothing; of several labels of one id the highest counts, and of
    several documents of one id any one. Of the sampled documents whose four least three-word shingles agree, which near copies'
    do, one counts, with the highest label. Without toxic or without other documents all scores are the share of toxic ones.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    known = labels.where(~held_out()).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    # copies are in one half
    sample = with_sketch(sample, "text", "sketch", k=4, width=3).withColumn("half", F.pmod(F.xxhash64("sketch"), F.lit(2)).cast("int"))
    once = stored(sample.groupBy("sketch", "half").agg(F.min_by("text", "doc_id").alias("text"), F.max("toxic").alias("toxic")).drop("sketch"), "sample")
    counts = stored(feature_counts(once), "counts")
    weights, *halves = (weights_of(counts, t, c) for t, c in (("t0 + t1", "c0 + c1"), ("t0", "c0"), ("t1", "c1")))
    rows = stored(half_sums(once, tuple(halves)), "sums")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        model = Model(weights, [0.0] * len(FIELDS), math.log((n.get(1, 0) + 0.5) / (n.get(0, 0) + 0.5)))
    else:
        fit = LogisticRegression(labelCol="toxic", regParam=1e-3, maxIter=50).fit(rows.select("toxic", array_to_vector("sums").alias("features")))
        model = Model(weights, list(map(float, fit.coefficients)), float(fit.intercept))
    free(once, counts, rows)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on) by text alone; columns of docs with these names are replaced.

    A null text counts as empty, and an empty text gets the score of one without matches. Every row gives one row; no rows none.
    """
    own = [i for i, c in enumerate(docs.columns) if c.lower() not in ("score", "predicted")]
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    text = F.coalesce(F.col(names[docs.columns.index("text")]), F.lit("")).alias("text")
    rows = rows.select(*(names[i] for i in own), text)
    kept = rows.columns[:-1]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        grammar = Grammar(model.weights)
        for batch in batches:
            scores = [model.score(grammar.sums(t)) for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*kept, "score", "predicted"])

    return rows.mapInArrow(tidy(run), schema).toDF(*(docs.columns[i] for i in own), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model that is trained on the labels."""
    model = train(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
