"""Alignment of tokenizers against plain loops over byte ranges."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from planweave.llm import align as A

SF = "/root/testdata/sf0.001"
FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EDGES = [
    None, "", " ", "  two  spaces ", "\n\nlines \n of\n text\n", "a▁b", "tab\tand\r\nmore", "<|endoftext|> and </s> <s>", "é ß 漢字 \U0001f600", "\x00zero", "x" * 5000, "a b " * 9000,
    "plain words here", "plain words here", " lead", "trail ",
]


@pytest.fixture(scope="module")
def raw():
    tok = Tokenizer.from_file(FIRST)
    tok.encode_special_tokens = True
    alphabet = json.loads(tok.to_str())["pre_tokenizer"]["type"]
    assert alphabet == "ByteLevel"
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    model = SentencePieceProcessor(model_file=SECOND)

    def encode(text):
        if not text:
            return [], []
        found = tok.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(back[c] for c in t)) for i, t in zip(found.ids, found.tokens, strict=True)]
        piece = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
        b = [(i, piece(i)) for i in model.encode(text)]
        same = all(b"".join(t for _, t in side) == (" " + text).encode() for side in (a, b))
        return (a, b) if same else ([], [])

    return encode


def brute(texts, encode):
    docs, count = [], Counter()
    for text in texts:
        sides = encode(text)
        spans = []
        for side in sides:
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        a, b = spans
        low, pairs = 0, []
        for i, s, e in a:
            while low < len(b) and b[low][2] <= s:
                low += 1
            k = low
            while k < len(b) and b[k][1] < e:
                pairs.append((i, b[k][0]))
                k += 1
        count.update(pairs)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, ia, ib = [], 0, 0
        for end in ends:
            parts = []
            for side, at in ((a, ia), (b, ib)):
                stop = at
                while stop < len(side) and side[stop][2] <= end:
                    stop += 1
                parts.append((",".join(str(x[0]) for x in side[at:stop]), stop))
            (ga, ia), (gb, ib) = parts
            groups.append(f"{ga}|{gb}")
        docs.append((len(a), len(b), groups, pairs))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return Counter(
        (na, nb, len(g), len(p), sum(count[x] == best[x[1]] for x in p), sum(count[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for na, nb, g, p in docs
    ), count, best


@pytest.mark.parametrize("block", [1 << 22, 2000])
def test_whole_table(spark, raw, block, tmp_path):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()] + EDGES
    docs = spark.createDataFrame([(None if i == 3 else i % 100, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want, count, best = brute(texts, raw)
    aligned, pairs = A.align_tokenizers(spark.read.parquet(f"{tmp_path}/documents.parquet"), FIRST, SECOND, block)
    rows = aligned.collect()
    assert Counter(tuple(r)[1:] for r in rows) == want
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(i % 100 for i in range(len(texts)) if i != 3)
    if block > 2000:
        assert {(r.a_id, r.b_id): (r.n, r.best) for r in pairs.collect()} == {k: (n, n == best[k[1]]) for k, n in count.items()}


def test_terminals_by_walking():
    rng = random.Random(4)
    for _ in range(300):
        size = rng.randint(1, 60)
        a_end, b_end = (np.array(sorted({*rng.sample(range(1, size + 1), rng.randint(0, size)), size})) for _ in range(2))
        ends = sorted(set(a_end) & set(b_end))
        got_a, got_b = A.terminals(a_end, b_end)
        for end, got in ((a_end, got_a), (b_end, got_b)):
            assert [int(b_end[g]) for g in got] == [min(x for x in ends if x >= e) for e in end]


def test_links_in_parts():
    both = A.pair(FIRST, SECOND)
    one = A.Block([both.encode("some words, in öne text 漢字 " * 20)], both)
    whole, parts = (list(A.links(one.a, one.b, one.a_end, one.b_end, both.table_a.lengths, n)) for n in (1 << 18, 7))
    for side in (0, 1):
        assert np.concatenate([p[side] for p in parts]).tolist() == whole[0][side].tolist()


def test_empty_table(spark):
    aligned, pairs = A.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), FIRST, SECOND)
    assert aligned.count() == 0 and pairs.count() == 0
