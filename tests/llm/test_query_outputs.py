"""The registered queries' own columns against brute force over whole small tables."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from test_pii import brute_base
from test_quality_and_toxicity import brute_base as brute_counts
from test_repeats import brute_force as brute_repeats
from tokenizers import Tokenizer

from planweave.llm import quality as Q
from planweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TWICE = 700_007
EDGES = [(None, "null id", None), (TWICE, None, "s"), (TWICE, "", "s"), (TWICE, "twice twice", "s"), (TWICE, "twice twice", "s"), (10**15 + 1, "x" * 9000 + " end", "s")]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """The smallest documents and edge cases, as a table, and its rows."""
    d = tmp_path_factory.mktemp("edges")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    edges = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in EDGES], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(edges.select(docs.columns)).repartition(3).write.parquet(f"{d}/documents.parquet")
    return str(d), [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]


def ids_of(name, end):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: [*library.encode(t or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def test_op1(spark, table):
    d, rows = table
    ids = ids_of("byte_bpe_50k.json", 2)
    got = sorted(QUERIES["op1_token_files"](spark, d).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    assert [r.doc_id or -1 for r in got] == sorted(i or -1 for i, _ in rows)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or -1, len(ids(t)), crc(ids(t))) for i, t in rows)


def verdict(text):
    """The bands anew, from their tables."""
    data, pack = (text or "").encode(), zstandard.ZstdCompressor(level=Q.LEVEL).compress
    if not data:
        return True
    low, high = [b[1:] for b in Q.BANDS if b[0] <= len(data)][-1]
    if not low <= len(data) / len(pack(data)) <= high:
        return False
    if len(data) <= Q.CHUNK:
        return True
    cuts = [data[i : i + Q.CHUNK] for i in range(0, len(data), Q.CHUNK)]
    cuts[-1] = data[-Q.CHUNK :]
    bad = sum(not Q.CHUNK_BAND[0] <= len(c) / len(pack(c)) <= Q.CHUNK_BAND[1] for c in cuts)
    return bad / len(cuts) < [s for n, s in Q.CHUNK_SHARES if n <= len(cuts)][-1]


def test_op2(spark, table):
    d, rows = table
    want = []
    for i, t in rows:
        n, chars, symbols, lines, repeats = brute_counts(t or "")
        failed = n < 50 or 100 * repeats > 50 * n
        want.append((i, n, chars, symbols, lines, repeats, failed, not failed and verdict(t)))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = [tuple(r) for r in QUERIES["op2_quality_rules"](spark, d).select(names).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({r[-1] for r in got}) == 2


def test_op6(spark, table):
    d, rows = table
    want = {}
    for i, t in rows:
        found = brute_base(t or "")
        want.setdefault(i, []).append((*(sum(s[0] == k for s in found) for k in ("email", "ip", "card", "phone")), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()))
    got = {}
    for r in QUERIES["op6_find_pii"](spark, d).collect():
        got.setdefault(r.doc_id, []).append((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
        listed = r.spans.split(",") if r.spans else []
        base = [s for s in listed if s.split(":")[0] in ("email", "ip", "phone")]
        assert len(listed) == r.n_spans >= r.n_email + r.n_ip + r.n_card + r.n_phone and len(base) == r.n_email + r.n_ip + r.n_phone
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}


def test_op8(spark, table):
    d, rows = table
    unique = [r for r in rows if r[0] != TWICE]  # which of two rows with one id is earlier goes by a hash
    want = {i: (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in brute_repeats(unique)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op8_remove_repeats"](spark, d).collect() if r.doc_id != TWICE}
    assert got == want and any(n for _, n, _, _ in want.values())


def test_op9(spark, table):
    d, rows = table
    ids, want, total = ids_of("word_bpe_49k.json", 0), [], 0
    for i, t in rows:
        e = ids(t)
        total += len(e)
        want += [(i, p, 2048 * p, len(e[a : a + 2048]), crc(e[a : a + 2048])) for p, a in enumerate(range(0, len(e), 2048))]
    got = QUERIES["op9_pack_documents"](spark, d).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(max(o + n for o, n in parts) == sum(n for _, n in parts) <= 2048 for parts in filled.values())
    assert len(filled) <= -(-total // 2048) + 1
