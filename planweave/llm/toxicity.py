"""Toxicity by weak supervision: voters, a generative label model with accuracies and correlations, a linear classifier on its posterior."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm.common import documents, in_slices, stored

#: Labelled documents that voters are mined from and held against at most, and documents that the classifier is fitted on at most: bounds that
#: do not grow with the data. When there are more, those with the smallest hashes are taken.
LABELLED_ROWS, SAMPLE_ROWS = 12_000, 12_000
#: Terms that voters know, and further ones that the classifier knows.
TERMS = 2_000
#: A term is mined from so many toxic rows on, and from this log-likelihood ratio (G squared) on.
MIN_TOXIC, MIN_G2 = 3, 15.0
#: Of the pairs of voters, so many with the strongest dependence given the class get a correlation of their own.
PAIRS = 12
#: Small public lexicons, the two that are not mined: English insults, and words of courtesy.
INSULTS = frozenset("idiot stupid moron loser scum trash clown pathetic worthless disgusting imbecile dumb jerk".split())
COURTESY = frozenset("please thanks thank welcome sorry sincerely regards kindly bitte danke merci gracias".split())
PREFIXES = (3, 4, 5, 6)
#: Words from which on a text without any hit counts as calm.
CALM_WORDS = 8

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"[#*$%&]{3,}")
#: Tokens that a worker remembers with their terms: the latest and those before them, each at most so many (about 80 MB).
_REMEMBERED = 1 << 18


def words_of(text: str | None) -> set[str]:
    """Distinct words (letters only, lower case)."""
    return set(_WORD.findall((text or "").lower()))


def terms_of(word: str) -> list[str]:
    """The terms of a word: itself and its prefixes, marked by length."""
    return [f"w:{word[:32]}", *(f"{k}:{word[:k]}" for k in PREFIXES if len(word) > k)]


class Lexicon(dict):
    """Token (a run without white space) -> numbers of the terms of its words, for mined terms in order, the strongest first; INSULT and COURTEOUS stand for the public lexicons.

    What was looked up is remembered in two halves, of which the older is dropped.
    """

    INSULT, COURTEOUS = -1, -2

    def __init__(self, terms: list[str]):
        super().__init__()
        self.terms = {t: i for i, t in enumerate(terms)}
        self.starts = {k: {t.split(":", 1)[1] for t in terms if t.startswith(f"{k}:")} for k in PREFIXES}
        self.whole = {t[2:] for t in terms if t.startswith("w:")}
        self.older: dict[str, tuple[int, ...]] = {}

    def _terms(self, word: str) -> list[int]:
        known = word[:32] in self.whole or any(word[:k] in starts for k, starts in self.starts.items())
        found = [self.terms[t] for t in terms_of(word) if t in self.terms] if known else []
        return found + [self.INSULT] * (word in INSULTS) + [self.COURTEOUS] * (word in COURTESY)

    def __missing__(self, token: str) -> tuple[int, ...]:
        found = self.older.get(token)
        if found is None:
            found = tuple(i for word in _WORD.findall(token.lower()) for i in self._terms(word))
        if len(self) >= _REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[token] = found
        return found

    def hits(self, tokens: set[str]) -> set[int]:
        """Numbers of the terms that the tokens hold."""
        return {i for found in map(self.__getitem__, tokens) if found for i in found}


#: All but the last two say toxic or nothing; those say clean or nothing.
VOTERS = ("insults", "word", "prefix3", "prefix4", "prefix5", "prefix6", "dense", "shouting", "bangs", "symbols", "calm", "courteous")


def votes(text: str, tokens: list[str], distinct: int, hits: set[int], kinds: list[str]) -> int:
    """Bit mask of the voters that say something. ``kinds`` are those of the voters' terms; hits of other terms do not count."""
    mine = [i for i in hits if 0 <= i < len(kinds)]
    found = {kinds[i] for i in mine}
    insulting = Lexicon.INSULT in hits
    said = [
        insulting,
        "w" in found,
        *(str(k) in found for k in PREFIXES),
        len(mine) >= 0.02 * distinct and bool(mine),
        2 * sum(map(str.isupper, tokens)) > len(tokens),
        "!!" in text,
        any(c in text for c in "#*$%&") and bool(_SYMBOLS.search(text)),
        not mine and not insulting and distinct >= CALM_WORDS,
        Lexicon.COURTEOUS in hits,
    ]
    return sum(1 << i for i, v in enumerate(said) if v)


class LabelModel:
    """p(votes, y) is log-linear: a bias of y, an accuracy of every voter for each y, and a correlation for chosen pairs of voters.

    A voter says its word or nothing, so all 2^m patterns can be summed up exactly. The likelihood of the pattern counts of all documents (y is
    summed out) and of labelled rows that no voter was mined from is climbed by gradient steps from these labelled rows' rates. Patterns are few, so
    rows never come here.
    """

    def __init__(self, m: int):
        self.m = m
        self.patterns = np.array([[p >> j & 1 for j in range(m)] for p in range(1 << m)], float)
        self.pairs: list[tuple[int, int]] = []

    def _features(self) -> np.ndarray:
        both = [self.patterns[:, a] * self.patterns[:, b] for a, b in self.pairs]
        return np.column_stack([self.patterns, *both]) if both else self.patterns

    def fit(self, unlabelled: np.ndarray, labelled: np.ndarray, steps: int = 400) -> LabelModel:
        """unlabelled: counts by pattern; labelled: counts by y and pattern."""
        n = labelled.sum(axis=1) + 1.0
        rate = (labelled @ self.patterns + 0.5) / n[:, None]
        rest = np.zeros((self.m, self.m))
        for y in (0, 1):
            centred = self.patterns - rate[y]
            spread = np.sqrt(np.maximum(rate[y] * (1 - rate[y]), 1e-6))
            rest += np.abs((centred * (labelled[y] / n[y])[:, None]).T @ centred) / np.outer(spread, spread)
        upper = sorted(((rest[a, b], a, b) for a in range(self.m) for b in range(a + 1, self.m)), reverse=True)
        self.pairs = [(a, b) for _, a, b in upper[:PAIRS]]
        f = self._features()
        width = f.shape[1]
        w = np.zeros((2, width))
        w[:, : self.m] = np.log(rate / (1 - rate)).clip(-6, 6)
        shared = slice(self.m, width)  # correlations are the same for both classes
        bias = math.log(n[1] / n[0])
        scale = min(1.0, labelled.sum() / max(unlabelled.sum(), 1.0))  # unlabelled rows count as much as labelled ones together
        u = unlabelled * scale
        total = u.sum() + labelled.sum() + 1.0
        velocity = [np.zeros_like(w), 0.0]
        for _ in range(steps):
            logits = f @ w.T + np.array([0.0, bias])
            joint = np.exp(logits - logits.max())
            p = joint / joint.sum()
            post = joint / joint.sum(axis=1, keepdims=True)
            data = u[:, None] * post + labelled.T
            diff = data / total - p * (data.sum() / total)
            grad = diff.T @ f - 0.001 * w / total
            grad[:, shared] = grad[:, shared].sum(axis=0)
            velocity[0] = 0.9 * velocity[0] + grad
            velocity[1] = 0.9 * velocity[1] + diff[:, 1].sum()
            w = w + velocity[0]
            bias += velocity[1]
        logits = f @ w.T + np.array([0.0, bias])
        self.logit = logits[:, 1] - logits[:, 0]
        self.accuracy = w[1, : self.m] - w[0, : self.m]
        self.correlation = dict(zip(self.pairs, w[0, shared], strict=True))
        return self


def fit_linear(rows: list[np.ndarray], target: np.ndarray, width: int, steps: int = 300, penalty: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features (numbers, by row) and soft targets, by gradient steps with a diagonal scale."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows).astype(np.int64) if len(owner) else np.zeros(0, np.int64)
    w, b = np.zeros(width), math.log((target.sum() + 0.5) / (len(rows) - target.sum() + 0.5))
    scale = 1.0 / (penalty + 0.25 * np.bincount(column, minlength=width) * 4)
    for _ in range(steps):
        z = np.bincount(owner, w[column], minlength=len(rows)) + b
        off = target - 1 / (1 + np.exp(-z.clip(-40, 40)))
        w = w + scale * (np.bincount(column, off[owner], minlength=width) - penalty * w)
        b += 2.0 * off.sum() / len(rows)
    return w, b


@dataclass
class ToxicityModel:
    """What scoring needs: terms (those of the voters first), their number, and the linear classifier's weights."""

    terms: list[str]
    voter_terms: int
    weights: np.ndarray
    bias: float
    label_model: LabelModel | None = None

    def lexicon(self) -> Lexicon:
        return Lexicon(self.terms)

    def kinds(self) -> list[str]:
        return [t.split(":", 1)[0] for t in self.terms[: self.voter_terms]]

    def features(self, text: str | None, lexicon: Lexicon, kinds: list[str]) -> tuple[list[int], int]:
        text = text or ""
        tokens = text.split()
        distinct = set(tokens)
        hits = lexicon.hits(distinct)
        said = votes(text, tokens, len(distinct), hits, kinds)
        return sorted(i for i in hits if i >= 0) + [len(self.terms) + j for j in range(len(VOTERS)) if said >> j & 1], said

    def posterior(self, pattern: int) -> float:
        """Probability of toxic given what the voters say."""
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.label_model.logit[pattern])))))


def mine_terms(sample: DataFrame) -> list[str]:
    """Terms that tell toxic rows apart: of at least MIN_TOXIC toxic rows, by log-likelihood ratio, the strongest TERMS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            terms = [*{*counts[0], *counts[1]}]
            made = [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(made, ["term", "clean", "toxic"])

        for batch in in_slices(batches):
            for i, (text, toxic) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                counts[toxic].update({t for w in words_of(text) for t in terms_of(w)})
                if i % 400 == 399:
                    yield flush()
        yield flush()

    per = sample.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in per}
    if not n.get(0) or not n.get(1):
        return []
    counted = sample.select("text", "toxic").mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    all_, toxic = float(n[0] + n[1]), float(n[1])
    part = lambda k, of, share: F.when(k > 0, k * F.log(k / (of * share))).otherwise(0.0)
    c, t = F.col("c"), F.col("t")
    df = c + t
    g2 = 2 * (
        part(t, df, F.lit(toxic / all_)) + part(c, df, F.lit(1 - toxic / all_))
        + part(F.lit(toxic) - t, F.lit(all_) - df, F.lit(toxic / all_)) + part(F.lit(all_ - toxic) - c, F.lit(all_) - df, F.lit(1 - toxic / all_))
    )
    strong = counted.where((t >= MIN_TOXIC) & (t / df > 3 * toxic / all_)).withColumn("g2", g2).where(F.col("g2") >= MIN_G2)
    return [r["term"] for r in strong.orderBy(F.desc("g2"), "term").limit(TERMS).select("term").collect()]


def pattern_counts(docs: DataFrame, model: ToxicityModel, *by: str) -> list:
    """How many rows of ``docs`` (``text`` and the integer columns ``by``) have each pattern of votes; counted per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, kinds = model.lexicon(), model.kinds()
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            c = Counter((model.features(t, lexicon, kinds)[1], *rest) for t, *rest in rows)
            made = [*zip(*c, strict=True)] or [()] * (1 + len(by))
            yield pa.RecordBatch.from_arrays([*(pa.array(m, pa.int32()) for m in made), pa.array([*c.values()], pa.int64())], ["pattern", *by, "n"])

    columns = ", ".join(["pattern int", *(f"{c} int" for c in by), "n long"])
    return docs.select("text", *by).mapInArrow(run, columns).groupBy("pattern", *by).agg(F.sum("n").alias("n")).collect()  # 2^voters at most


def weak_labels(docs: DataFrame, model: ToxicityModel, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, n, posterior``: about ``rows`` distinct texts (those with the smallest hashes), how many rows have each, and what the voters make of it."""
    total = docs.count()
    share = min(1.0, 1.2 * rows / max(total, 1))  # of the distinct texts; a few more than needed, as the limit below cuts
    hashed = docs.select("text", F.xxhash64("text").alias("h")).where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    texts = hashed.groupBy("text", "h").agg(F.count("*").alias("n")).orderBy(F.pmod("h", F.lit(1 << 20)), "h", "text").limit(rows).select("text", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, kinds = model.lexicon(), model.kinds()
        for batch in batches:
            said = [model.posterior(model.features(t, lexicon, kinds)[1]) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.float64())], ["text", "n", "posterior"])

    return stored(texts, "sampled-texts").mapInArrow(run, "text string, n long, posterior double")


def fit_toxicity(docs: DataFrame, labelled: DataFrame) -> ToxicityModel:
    """Fit on ``docs`` (text; all, unlabelled) and ``labelled`` (text, toxic 0/1; LABELLED_ROWS at most).

    Labelled rows fall into two halves by a hash of the text. The terms of the voters are mined from one half. The label model learns prior,
    accuracies and correlations from the vote patterns of all documents and of the other half. What it then says of a text, from the votes
    alone, is the label of the classifier's rows: SAMPLE_ROWS texts of ``docs`` at most. The classifier knows the voters, their terms, and terms mined from
    these posterior labels; no row's own gold label reaches it. Texts that repeat count once in the fit. Ties among terms go by G squared, then by name. Without
    labels of both kinds in both halves the model is the public lexicon alone. Null and empty texts have no terms; an empty table has no votes.
    """
    half = labelled.select("text", F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(7)), F.lit(2)) == 0).alias("mines"))
    terms = mine_terms(half.where("mines").select("text", "toxic"))
    model = ToxicityModel(terms, len(terms), np.zeros(0), 0.0)
    known = np.zeros((2, 1 << len(VOTERS)))
    for r in pattern_counts(half.where("NOT mines"), model, "toxic"):
        known[r["toxic"], r["pattern"]] = r["n"]
    if not terms or not known[0].sum() or not known[1].sum():
        model.weights = np.zeros(len(model.terms) + len(VOTERS))
        model.weights[len(model.terms)] = 4.0
        model.bias = -2.0
        return model
    seen = np.zeros(1 << len(VOTERS))
    for r in pattern_counts(docs, model):
        seen[r["pattern"]] = r["n"]
    model.label_model = LabelModel(len(VOTERS)).fit(seen, known)
    sample = stored(weak_labels(docs, model), "weak-labels")
    more = mine_terms(sample.select("text", (F.col("posterior") >= 0.5).cast("int").alias("toxic")))
    model.terms = terms + [t for t in more if t not in set(terms)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, kinds = model.lexicon(), model.kinds()
        for batch in batches:
            got = [model.features(t, lexicon, kinds)[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32())), batch.column(1)], ["features", "posterior"])

    rows = sample.select("text", "posterior").mapInArrow(run, "features array<int>, posterior double").collect()  # SAMPLE_ROWS at most
    posterior = np.array([r["posterior"] for r in rows])
    model.weights, model.bias = fit_linear([np.array(r["features"], int) for r in rows], posterior, len(model.terms) + len(VOTERS))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Adds ``score`` (0 to 1) to documents; the text alone is read. Null and empty texts get the score of no feature. No shuffle."""
    docs = docs.drop("score")
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, kinds = model.lexicon(), model.kinds()
        for batch in in_slices(batches):
            z = [model.bias + float(model.weights[model.features(t, lexicon, kinds)[0]].sum()) for t in batch.column(place).to_pylist()]
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, type(docs.schema)(list(docs.schema.fields)).add("score", "double"))


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """``text, toxic`` of at most ``rows`` labelled documents, those with the smallest hashes of their ids.

    A document labelled twice counts as toxic if once; of rows that repeat a doc_id, one text stands for it. Null ids and labels are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # of ``rows`` rows at most
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    return met.groupBy("doc_id").agg(one.alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; labels of held-out rows are not read."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    learn = docs.where(~held_out(F.col("doc_id")))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    sample = stored(labelled_sample(learn, labels), "labelled-sample")
    scored = score_toxicity(docs, fit_toxicity(docs, sample)).select("doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
