import random
import re
from collections import Counter

import numpy as np

from planweave.llm.quality import base_counts, compression, judge, quality_rules
from planweave.llm.toxicity import VOTERS, LabelModel, fit_toxicity, held_out, op4_toxicity, score_toxicity


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeats = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeats)


def test_base_counts_equal_brute_force(spark):
    rnd = random.Random(2)
    texts = ["", " \n\t", "a", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n\n\nx ", "é😀 |#\x1c\x85 b"]
    texts += [" ".join(rnd.choice("abcd\n") for _ in range(rnd.randrange(60))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts:
        assert base_counts(t) == brute_base(t)


def test_bands():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9))) for _ in range(4000)]
    prose = " ".join(words)
    noise = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(12000))
    accepts = lambda t: compression(t.encode())[3]
    assert accepts("") and accepts("short text") and all(accepts(prose[:n]) for n in (120, 300, 900, 3000, 10000, 17000))
    assert not any(accepts(noise[:n]) for n in (3000, 9000))
    assert not any(accepts(("the same words again " * 900)[:n]) for n in (150, 400, 3000, 18000))
    assert not accepts(prose[:12000] + "x " * 20000)  # a repetitive stretch inside ordinary text shows in its chunks
    tail = prose[:8192] + noise[:3500]  # and so does a last part that is no full chunk
    assert compression(tail.encode())[1] == 3 and compression(tail.encode())[2] >= 1
    assert compression(b"a" * 4096)[1] == 0 and compression(prose[:4097].encode())[1] == 2


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    got = quality_rules(docs).where("quality = 1 AND NOT base_failed").selectExpr("avg(CAST(kept AS INT)) AS share").first()
    assert got.share > 0.97


def test_quality_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "w " * 60, 5), (3, "w " * 60, 5), (3, "w " * 60, 5)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, kept long")).collect()
    assert len(got) == 5 and not any(r.kept for r in got) and {r.n_words for r in got} == {0, 60}
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert judge(None)[:5] == (0, 0, 0, 0, 0)


def test_label_model_finds_accuracies():
    """Votes drawn from a known model: two independent good voters, one that copies the first, one that is noise."""
    rng = np.random.default_rng(0)
    y = rng.random(40000) < 0.2
    v = np.zeros((40000, len(VOTERS)), bool)
    v[:, 0] = np.where(y, rng.random(40000) < 0.8, rng.random(40000) < 0.05)
    v[:, 1] = np.where(rng.random(40000) < 0.95, v[:, 0], rng.random(40000) < 0.3)
    v[:, 2] = np.where(y, rng.random(40000) < 0.7, rng.random(40000) < 0.05)
    v[:, 3] = rng.random(40000) < 0.3
    pattern = (v << np.arange(len(VOTERS))).sum(axis=1)
    known = np.zeros((2, 1 << len(VOTERS)))
    np.add.at(known, (y[:2000].astype(int), pattern[:2000]), 1)
    model = LabelModel(len(VOTERS)).fit(np.bincount(pattern, minlength=1 << len(VOTERS)).astype(float), known)
    assert model.accuracy[0] > 1 and model.accuracy[2] > 2 and abs(model.accuracy[3]) < 0.5
    assert (0, 1) in model.correlation and model.correlation[0, 1] > 1
    assert model.logit[0b101] > 0 > model.logit[0]
    right = ((model.logit[pattern] > 0) == y).mean()
    assert right > 0.9


def test_held_out_accuracy(spark):
    got = op4_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8
    assert n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.9


def test_labels_come_from_votes(spark):
    """The classifier finds words that only go along with what voters know, and no gold label reaches the row it belongs to."""
    rnd = random.Random(6)
    plain = [f"{a}{b}lo" for a in "bcdfgklm" for b in "aeiou"]
    said = lambda *more: " ".join([*(rnd.choice(plain) for _ in range(30)), *more])
    labelled = [(said("grumblo", "wretchy"), 1) for _ in range(60)] + [(said(), 0) for _ in range(400)]
    wrong = [(said(), 1) for _ in range(6)] + [(said("grumblo"), 0) for _ in range(3)]
    docs = [(t,) for t, _ in labelled + wrong] + [(said("wretchy", "vexorim"),) for _ in range(60)] + [(said(),) for _ in range(500)]
    model = fit_toxicity(spark.createDataFrame(docs, "text string"), spark.createDataFrame(labelled + wrong, "text string, toxic int"))
    assert "w:vexorim" in model.terms[model.voter_terms :]
    rows = [(1, said("grumblo", "wretchy")), (2, said("vexorim", "wretchy")), (3, said()), (4, wrong[0][0]), (5, "")]
    score = {r.doc_id: r.score for r in score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert score[1] > 0.5 and score[2] > 0.5 and max(score[3], score[4], score[5]) < 0.5
    calm, word = (1 << VOTERS.index(v) for v in ("calm", "word"))
    assert model.posterior(calm) < 0.1 < 0.5 < model.posterior(word | sum(1 << VOTERS.index(f"prefix{k}") for k in (3, 4, 5, 6)))


def test_toxicity_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "you idiot", 0.5), (3, "kind words", 0.5), (3, "kind words", 0.5)], "doc_id long, text string, score double")
    model = fit_toxicity(docs, spark.createDataFrame([], "text string, toxic int"))
    got = score_toxicity(docs, model).collect()
    assert len(got) == 5 and all((r.score > 0.5) == (r.text == "you idiot") for r in got)
    assert docs.where(held_out(docs.doc_id)).count() >= 1
    assert score_toxicity(docs.limit(0), model).collect() == []
