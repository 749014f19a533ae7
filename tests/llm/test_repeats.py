import random

import numpy as np
import pytest

from planweave.llm.repeats import remove_repeats
from planweave.llm.suffix_groups import suffix_arrays

DOCS = "doc_id long, text string"


def brute_force(rows, window=100):
    seen, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in order:
        data = (t or "").encode()
        for p in range(len(data) - window + 1):
            seen.setdefault(data[p : p + window], (i, p))
    for i, t in rows:
        data = (t or "").encode()
        cut = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - window + 1):
            if seen[data[p : p + window]] != (i, p):
                cut[p : p + window] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], cut[:-1], [False]]).astype(int)))
        spans = [tuple(map(int, x)) for x in edge.reshape(-1, 2)]
        out.append((i, len(data), spans, bytes(b for b, c in zip(data, cut, strict=False) if not c)))
    return out


def corpus():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [text(rnd.randrange(12, 60)) for _ in range(12)]
    rows = []
    for _ in range(150):
        parts = [text(rnd.randrange(0, 30))]
        for _ in range(rnd.randrange(0, 3)):
            parts += [rnd.choice(passages), text(rnd.randrange(0, 20))]
        rows.append(" ".join(parts))
    line = text(30)
    rows += [f"{text(3)} {line} {text(3)}" for _ in range(90)]  # more contexts than are sorted together
    rows += ["", None, "a" * 99, "a" * 100, "a" * 101, "a" * 450, "ab" * 200, rows[0], rows[0], rows[3][5:] + "!"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("most, hot", [(64, 25), (64, 10_000), (4, 3), (1, 1)])
def test_equals_brute_force(spark, most, hot):
    """Whatever number of contexts is sorted at once, and whichever anchors are dealt by context, the same bytes go."""
    rows = corpus()
    got = remove_repeats(spark.createDataFrame(rows, DOCS).repartition(6), most=most, hot=hot).collect()
    mine = {r.doc_id: (r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.removed], bytes(r.kept)) for r in got}
    assert len(got) == len(rows)
    for row in brute_force(rows):
        assert mine[row[0]] == row


def test_null_and_repeated_ids(spark):
    t = "".join(chr(97 + i * 7 % 26) + chr(97 + i * i % 23) for i in range(120))
    rows = [(None, t), (4, t), (4, "x" + t), (4, None), (5, t)]
    got = remove_repeats(spark.createDataFrame([(*r, b"") for r in rows], DOCS + ", kept binary")).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, len(r.kept)) for r in got) == [(-1, 240, 240), (4, 0, 0), (4, 240, 0), (4, 241, 1), (5, 240, 0)]
    assert remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_suffix_arrays():
    rnd = random.Random(1)
    for _ in range(150):
        strings = [[rnd.randrange(1, rnd.choice((2, 3, 5, 200))) for _ in range(rnd.randrange(0, 60))] + [0] for _ in range(rnd.randrange(1, 9))]
        want, at = [], 0
        for s in strings:
            want += [at + i for i in sorted(range(len(s)), key=lambda i, s=s: s[i:])]
            at += len(s)
        assert suffix_arrays(np.array(sum(strings, [])), np.array([len(s) for s in strings])).tolist() == want
