import random
from itertools import combinations

from planweave.llm.near_dup import near_duplicates

DOCS = "doc_id long, text string"


def shingles(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if len(words) >= size else frozenset([tuple(words)])


def brute_force(rows, size=4, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


def corpus():
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice((3, 8, 30, 120, 400)))] for _ in range(40)]
    line = [rnd.choice(vocabulary) for _ in range(60)]
    rows = []
    for words in base:
        for _ in range(rnd.choice((1, 1, 2, 5))):
            copy = list(words)
            for _ in range(rnd.randrange(0, max(2, len(copy) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append(" ".join(copy))
    big = [rnd.choice(vocabulary) for _ in range(100)]
    for _ in range(60):  # a large group, each with its own edits
        copy = list(big)
        for _ in range(rnd.randrange(0, 4)):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
        rows.append(" ".join(copy).upper() if rnd.random() < 0.3 else " ".join(copy))
    for _ in range(40):  # a passage that many share, next to words of their own
        rows.append(" ".join(line + [rnd.choice(vocabulary) for _ in range(40)]))
    rows += ["", None, " \t\n", "one two", "ONE  two", "one two three", "é É", "É é", "same words here now ok"] + ["same words here now ok"] * 3
    return list(enumerate(rows))


def test_equals_brute_force(spark):
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5), size=4).collect()
    assert {tuple(r) for r in got} == brute_force(rows)
    assert len(got) == len(rows)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, None), (9, "a b c d e f")]
    got = near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", set_id string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [
        (-1, -1, True), (1, 1, True), (3, 3, True), (3, 3, True), (9, 3, False),
    ]
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_pairs_at_the_threshold_are_found(spark):
    """Sets of more shingles than a sketch holds, at a similarity of exactly 0.8: the last shingle-shifting edits of which 100 pairs are made."""
    rnd = random.Random(11)
    rows = []
    for pair in range(100):
        n = rnd.choice((108, 180, 360, 900))  # shingles of each; 8/9 of them are shared, so the similarity is 8/9 / (2 - 8/9) = 0.8
        words = [f"p{pair}w{i}" for i in range(n + 3)]
        other = words[: n - n // 9 + 3] + [f"q{pair}w{i}" for i in range(n // 9)]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] == i - i % 2 for i in got)
