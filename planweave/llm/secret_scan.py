"""Secret scans: fixed patterns find what is surely a secret; a character network judges every other candidate with its context."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm.char_cnn import AFTER, BEFORE, VALUE, CharCNN, encode, mean_state, platt, threshold_for_recall
from planweave.llm.common import documents, in_slices, stored

#: Kinds in the order in which spans of one start are listed. The first three are the base kinds, the last is what the network adds.
KINDS = ("assign", "access", "hex", "learned")

# The base patterns of the data contract.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # whole runs of [0-9a-f]+ that are long enough
LEAST_VALUE, LEAST_ACCESS = 8, 16

#: Candidates: runs of these characters with a digit, and runs that something is assigned with.
RUN, DIGIT = re.compile(r"[A-Za-z0-9+/_.=-]*"), re.compile("[0-9]")
RUN_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
ASSIGNED = re.compile(r"""[:=]["']?\x20?["']?([A-Za-z0-9+/_.-][A-Za-z0-9+/_.=-]{7,})""")
#: Passes of the training over all labelled findings, planted variations that each finding brings of its own label, and findings that are a part, about: parts learn side by side.
EPOCHS, VARIATIONS, PART = 8, 4, 2000
#: Logits count in steps of this fraction and up to this bound, so that findings can be counted by their logits, however many there are.
STEPS, BOUND = 1024, 32
#: Share of the positives of the calibration rows that a threshold keeps, and the least calibrated score that is ever reported.
RECALL, LEAST_SCORE = 0.98, 0.5

# What planted findings are made of: names and forms of secrets, and of values that are none.
SECRET_NAMES = ("pwd", "auth", "bearer", "credential", "private_key", "access_key", "passphrase", "signature", "session_key", "client_key", "encryption_key", "login")
PLAIN_NAMES = ("version", "order", "invoice", "date", "phone", "page", "ref", "isbn", "file", "host", "url", "article", "build", "item", "address", "card")
MARKS = (' = "', ": ", "=", " = ", ': "', "='")
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each base pattern that are long enough; a match that is too short is dropped without another try. One look at each character per pattern."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def runs_with_digits(text: str) -> Iterator[tuple[int, int]]:
    """Longest runs of RUN_CHARACTERS that hold a digit; every character is seen once."""
    end, digit = 0, DIGIT.search(text)
    while digit:
        start = digit.start()
        while start > end and text[start - 1] in RUN_CHARACTERS:
            start -= 1
        end = RUN.match(text, digit.end()).end()
        yield start, end
        digit = DIGIT.search(text, end)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of all candidates, without dots at their ends, in order."""
    found = set(runs_with_digits(text))
    found |= {m.span(1) for m in ASSIGNED.finditer(text)}
    out = {(s + len(v) - len(v.lstrip(".")), e - len(v) + len(v.rstrip("."))) for s, e in found for v in (text[s:e],)}
    return sorted((s, e) for s, e in out if e - s >= LEAST_VALUE)


def windows(text: str, start: int, end: int) -> Iterator[tuple[str, str, str]]:
    """Windows over a candidate with what stands around it; a long one has several, the last of them at its end."""
    for s in [*range(start, end - VALUE, VALUE), max(start, end - VALUE)]:
        e = min(s + VALUE, end)
        yield text[max(0, s - BEFORE) : s], text[s:e], text[e : e + AFTER]


def is_assigned(before: str) -> bool:
    """Whether the text before a value ends in an assignment."""
    return before.rstrip(" \"'")[-1:] in (":", "=")


def planted(before: str, after: str, secret: bool, rng: random.Random) -> tuple[str, str, str]:
    """A window of the given label in the surroundings of another one."""
    some = lambda letters, low, high: "".join(rng.choices(letters, k=rng.randint(low, high)))
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    if secret:
        forms = (
            some(digits + "abcdef", 20, 48), some(ALNUM, 14, 40), some(ALNUM + "+/", 22, 42) + "=" * rng.randint(0, 2), "ghp_" + some(ALNUM, 36, 36),
            "sk_live_" + some(ALNUM, 24, 24), some(ALNUM + "_-", 16, 43), "ASIA" + some(ALNUM[:26] + digits, 16, 16),
        )
        name = rng.choice(SECRET_NAMES)
    else:
        forms = (
            some(digits, 8, 19), ".".join(some(digits, 1, 3) for _ in range(rng.randint(3, 4))), f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
            f"{some(lower, 3, 9)}{rng.randint(0, 99)}.{some(lower, 3, 8)}.{rng.choice(('com', 'org', 'net'))}", f"{some(lower, 4, 10)}/{some(lower, 4, 10)}{rng.randint(0, 99)}.txt",
            some(lower, 8, 18), f"{some(lower, 5, 12)}-{some(lower, 3, 9)}-{rng.randint(0, 999)}", "-".join(some(digits, 3, 4) for _ in range(3)), f"{some(lower, 4, 9)}_{some(lower, 4, 9)}{rng.randint(0, 9)}",
        )
        name = rng.choice(PLAIN_NAMES)
    value, mark = rng.choice(forms), rng.choice(MARKS)
    before = before[: rng.choice((BEFORE // 2, rng.randint(0, BEFORE // 2)))]  # without the name that the other value may have had; at times from the text's beginning
    after = after[: rng.choice((AFTER, rng.randint(0, AFTER)))]
    if not secret and rng.random() < 0.5 or secret and value[:4] in ("ghp_", "sk_l", "ASIA") and rng.random() < 0.5:
        return before, value, after  # in running text
    quote = mark[-1] if mark[-1] in "\"'" else ""
    return f"{before} {name}{mark}", value, quote + after


def known_findings(docs: DataFrame) -> DataFrame:
    """Labelled findings of documents: every candidate with label 1 if it lies in a base span, else 0: ``hash, label, before, value, after``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1024):
            made = []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text or "")
                for s, e in candidates(text or ""):
                    label = int(any(a < e and s < b for _, a, b in spans))
                    made += [(zlib.crc32("\0".join(w).encode()), label, *w) for w in windows(text, s, e)]
            columns = [*zip(*made, strict=True)] or [()] * 5
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["hash", "label", "before", "value", "after"])

    return docs.select("text").mapInArrow(run, "hash long, label int, before string, value string, after string")


def labelled_findings(findings: DataFrame) -> DataFrame:
    """All distinct findings with a label and a value."""
    texts = (F.coalesce(c, F.lit("")).alias(c) for c in ("before", "value", "after"))
    return findings.where("label IN (0, 1) AND value IS NOT NULL").select("hash", "label", *texts).distinct()


def labelled_sample(findings: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` distinct findings of each label, those with the smallest hashes. Only for a caller who asks for it: the query learns from all."""
    distinct = labelled_findings(findings)
    order = ("hash", "before", "value", "after")
    return distinct.where("label = 1").orderBy(*order).limit(rows).unionByName(distinct.where("label = 0").orderBy(*order).limit(rows))


def with_variations(batch: pa.RecordBatch | pa.Table, seed: int) -> tuple[list[tuple[str, str, str]], np.ndarray]:
    """Windows of findings (``place, label, before, value, after``), each followed by planted ones that its place decides, and the labels of all."""
    made, labels = [], []
    for place, label, before, value, after in zip(*(batch[c].to_pylist() for c in ("place", "label", "before", "value", "after")), strict=True):
        rng = random.Random(f"{seed}:{label}:{place}")
        made += [(before, value, after), *(planted(before, after, bool(label), rng) for _ in range(VARIATIONS))]
        labels += [label] * (1 + VARIATIONS)
    return made, np.array(labels, np.uint8)


@dataclass
class SecretModel:
    """The network, its calibration, and a threshold for values that are assigned and one for others."""

    net: CharCNN
    slope: float
    shift: float
    thresholds: tuple[float, float]

    def scores(self, found: list[tuple[str, str, str]]) -> np.ndarray:
        """Calibrated scores of windows."""
        return self.calibrated(steps_of(self.net, found))

    def calibrated(self, steps: np.ndarray) -> np.ndarray:
        """Probabilities of logits in steps."""
        return 1 / (1 + np.exp(-np.clip(self.slope * steps / STEPS + self.shift, -30, 30)))


def steps_of(net: CharCNN, found: list[tuple[str, str, str]]) -> np.ndarray:
    """Logits of windows in whole steps."""
    z = net.logits(np.stack([encode(*w) for w in found])) if found else np.zeros(0)
    return np.rint(np.clip(z, -BOUND, BOUND) * STEPS).astype(np.int64)


def in_parts(findings: DataFrame, parts: int, seed: int) -> DataFrame:
    """Findings (with ``place``) and their variations as codes, one row a part: ``part, codes, labels``. Places decide the part, so it is the same however the rows are spread."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)  # a partition is a part
        if sum(b.num_rows for b in got):
            table = pa.Table.from_batches(got).sort_by([(c, "ascending") for c in ("place", "label", "before", "value", "after")])
            made, labels = with_variations(table, seed)
            codes = np.stack([encode(*w) for w in made])
            yield pa.RecordBatch.from_arrays([pa.array(table["part"][:1].to_pylist(), pa.int32()), pa.array([codes.tobytes()]), pa.array([labels.tobytes()])], ["part", "codes", "labels"])

    dealt = findings.withColumn("part", F.pmod(F.shiftright("place", 8), F.lit(parts)).cast("int"))
    return dealt.repartitionById(parts, F.col("part")).mapInArrow(pack, "part int, codes binary, labels binary")


def mean_of_parts(passed: DataFrame, parts: int) -> np.ndarray:
    """Mean of the states of parts (``part, n, state``), in an order that does not go by how they are spread: about sqrt(parts) states meet in a task, and as many on the driver."""

    def mean(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["part", "n", "state"]).to_pylist(), key=lambda r: r["part"])
        n = [r["n"] for r in rows]
        state = mean_state([np.frombuffer(r["state"]) for r in rows], n)
        return pa.table({"part": pa.array([rows[0]["part"]], pa.int32()), "n": pa.array([sum(n)], pa.int64()), "state": pa.array([state.tobytes()], pa.binary())})

    met = passed.groupBy(F.pmod("part", F.lit(math.isqrt(parts - 1) + 1))).applyInArrow(mean, passed.schema)
    rows = sorted(met.collect(), key=lambda r: r["part"])
    return mean_state([np.frombuffer(r["state"]) for r in rows], [r["n"] for r in rows])


def train(packed: DataFrame, parts: int, weights: tuple[float, float], seed: int) -> CharCNN:
    """Train on all rows of all parts: in each pass every part goes on from the common state by itself, and the mean of the parts' states is the next common state."""
    state = CharCNN(seed).state()
    for epoch in range(EPOCHS):

        def run(batches: Iterator[pa.RecordBatch], state: np.ndarray = state, epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            for batch in in_slices(batches, 1):
                part, codes, labels = (batch[c][0].as_py() for c in ("part", "codes", "labels"))
                y = np.frombuffer(labels, np.uint8)
                learned = CharCNN(seed).learn(np.frombuffer(codes, np.uint8).reshape(len(y), -1), y, np.where(y == 1, weights[1], weights[0]), state, [seed, epoch, part])
                yield pa.RecordBatch.from_arrays([batch["part"], pa.array([len(y)], pa.int64()), pa.array([learned.tobytes()], pa.binary())], ["part", "n", "state"])

        state = mean_of_parts(packed.mapInArrow(run, "part int, n long, state binary"), parts)
    return CharCNN(seed).take(state)


def tally(findings: DataFrame, net: CharCNN, seed: int) -> np.ndarray:
    """How many windows of all findings (with ``place``) and their variations have each logit in steps, label, and mark of being assigned: rows of these and the count.

    Counted on Spark; the rows that come here are bounded by the number of steps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1024):
            made, labels = with_variations(batch, seed)
            n = Counter(zip(steps_of(net, made).tolist(), labels.tolist(), (int(is_assigned(w[0])) for w in made), strict=True))
            columns = [*zip(*n, strict=True)] or [()] * 3
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array([*n.values()], pa.int64())], ["step", "label", "given", "n"])

    by = ("step", "label", "given")
    return np.array(sorted(map(tuple, findings.mapInArrow(run, "step int, label int, given int, n long").groupBy(*by).agg(F.sum("n")).collect())), np.int64)


def fit_secret_model(findings: DataFrame, rows: int | None = None, seed: int = 7) -> SecretModel | None:
    """Train and calibrate on all labelled findings (``hash, label, before, value, after``), each with VARIATIONS planted ones; with ``rows``, on so many of each label.

    A quarter of the findings (by hash), with their variations, only calibrates: a slope and a shift turn logits into probabilities, and each of the two thresholds (for assigned
    values, for others) is the most precise that keeps RECALL of these findings' positives, no less than LEAST_SCORE. All others train. Where a quarter or the rest lacks a label,
    all findings do both. Repeated findings count once. None where a label is missing. The result does not go by how rows are spread.
    """
    distinct = labelled_findings(findings) if rows is None else labelled_sample(findings, rows)
    place = F.xxhash64("hash", "before", "value", "after")
    data = stored(distinct.withColumn("place", place).withColumn("checks", F.pmod("place", F.lit(4)) == 3), "labelled-findings")
    n = {(r["label"], r["checks"]): r["count"] for r in data.groupBy("label", "checks").count().collect()}
    if {label for label, _ in n} != {0, 1}:
        return None
    apart = len(n) == 4
    learned = [n[k, False] if apart else n.get((k, False), 0) + n.get((k, True), 0) for k in (0, 1)]
    parts = math.ceil(sum(learned) / PART)
    packed = stored(in_parts(data.where("NOT checks") if apart else data, parts, seed), "packed-findings")
    net = train(packed, parts, tuple(sum(learned) / (2 * k) for k in learned), seed)
    step, y, given, count = tally(data.where("checks") if apart else data, net, seed).T
    model = SecretModel(net, *platt(step / STEPS, y, count), (LEAST_SCORE, LEAST_SCORE))
    p = model.calibrated(step)
    model.thresholds = tuple(threshold_for_recall(p[given == g], y[given == g], RECALL, LEAST_SCORE, count[given == g]) for g in (1, 0))
    return model


def find_secrets(texts: list[str | None], model: SecretModel | None) -> list[list[tuple[str, int, int, float, bool]]]:
    """Spans of texts by start, then kind: kind, start, end (exclusive), score, base or not. All candidates are judged at once."""
    spans, asked, owners = [], [], []
    for i, text in enumerate(texts):
        spans.append(base_spans(text or ""))
        for s, e in candidates(text or "") if model else ():
            for w in windows(text, s, e):
                asked.append(w)
                owners.append((i, s, e))
    score: dict[tuple[int, int, int], float] = {}
    sure: set[tuple[int, int, int]] = set()
    for key, w, p in zip(owners, asked, model.scores(asked) if model else (), strict=True):
        score[key] = max(score.get(key, 0.0), float(p))
        if p >= model.thresholds[0 if is_assigned(w[0]) else 1]:
            sure.add(key)
    out: list[list] = [[] for _ in texts]
    judged: dict[int, list] = {}
    for (i, s, e), p in score.items():
        judged.setdefault(i, []).append((s, e, p))
    for i, found in enumerate(spans):
        covers = _Cover(found)
        values = sorted(judged.get(i, []))
        out[i] = [(kind, s, e, max((p for a, b, p in _near(values, s, e)), default=0.0), True) for kind, s, e in found]
        out[i] += [("learned", s, e, p, False) for s, e, p in values if (i, s, e) in sure and not covers.meets(s, e)]
        out[i].sort(key=lambda f: (f[1], KINDS.index(f[0]), f[2]))
    return out


class _Cover:
    """Whether a span meets one of many."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        ordered = sorted((s, e) for _, s, e in spans)
        self.starts = np.array([s for s, _ in ordered], np.int64)
        self.reach = np.maximum.accumulate(np.array([e for _, e in ordered], np.int64)) if ordered else self.starts

    def meets(self, start: int, end: int) -> bool:
        k = int(np.searchsorted(self.starts, end, "left"))
        return k > 0 and self.reach[k - 1] > start


def _near(values: list[tuple[int, int, float]], start: int, end: int) -> Iterator[tuple[int, int, float]]:
    """Values that meet a span; they are sorted and do not overlap by more than an assigned one with the run it ends."""
    from bisect import bisect_left

    k = bisect_left(values, (end,))
    while k and values[k - 1][1] > start:
        k -= 1
        yield values[k]


def scan_secrets(docs: DataFrame, model: SecretModel | None) -> DataFrame:
    """Adds ``secret_spans`` (array of kind, start, end, score, base) to documents (``text``).

    Base spans are always there, with the network's score of the values in them; every other candidate from its threshold on is a span of kind ``learned``. One pass over
    whole texts, no shuffle; offsets are code points, ends exclusive. A candidate longer than a window is judged in windows and has the highest score. Null and empty texts
    have no spans; repeated rows and other columns pass through, a column of that name is replaced. Without a model only base spans are found.
    """
    docs = docs.drop("secret_spans")
    place = docs.columns.index("text")
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())])
    fields = docs.sparkSession.createDataFrame([], "secret_spans array<struct<kind:string,start:int,end:int,score:double,base:boolean>>").schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1024):
            found = find_secrets(batch.column(place).to_pylist(), model)
            listed = [[{"kind": k, "start": s, "end": e, "score": p, "base": b} for k, s, e, p, b in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(listed, pa.list_(kind))], [*batch.schema.names, "secret_spans"])

    schema = type(docs.schema)(list(docs.schema.fields))
    return docs.mapInArrow(run, schema.add(fields[0]))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. The given tables label no findings; those of the base patterns stand for labelled ones."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_secret_model(known_findings(docs))
    found = scan_secrets(docs, model).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("secret_spans")).alias("spans"),
        F.size("secret_spans").cast("long").alias("n_spans"),
    )


QUERIES = {"op11_scan_secrets": op11_scan_secrets}
SQL: dict[str, str] = {}
