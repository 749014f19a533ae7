import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from planweave.llm.common import scratch_path
from planweave.llm.token_file import pack_ids, read_token_files, token_index, unpack_ids, write_token_files
from planweave.llm.tokens import TextEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", "a", " a", "a ", "  a b", "a\nb c", "a \n b", "a\n\nb", "\na", "a\n", "Don't we'll. 12 3,4", "<|endoftext|> x", "ÀÉ İstanbul Σας ΣΑΣ",
    "x y z", "é é ́x", ".,., a., b,. ,c", "tab\tx", "日本 語", "Ŀl ŉ ſ K", "a" * 5000 + " b", "\x1c x", "The the\nThe, the.",
]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(spark, path):
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    mine, theirs = TextEncoder(path), Tokenizer.from_file(path)
    for t in texts:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids
    assert mine.encode(None) == b""


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000, 1100000])
@pytest.mark.parametrize("top", [1, 2, 300, 50000, 1 << 31, 1 << 62])
def test_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint64)
    ids[::97] = ids[::97] << np.uint64(1)
    words, starts, places, escapes = pack_ids(ids)
    assert (unpack_ids(words, starts, places, escapes, n) == ids).all()
    if n > 512:  # one block alone
        one = words[starts[1] : starts[2]]
        keep = (places >= 512) & (places < 1024)
        m = min(512, n - 512)
        assert (unpack_ids(one, np.array([0, len(one)]), places[keep] - 512, escapes[keep], m) == ids[512 : 512 + m]).all()


def test_files(spark):
    rows = [(i * 3 % 101, t, "x") for i, t in enumerate(TEXTS * 4)] + [(None, "null id", "y"), (7, None, "z"), (7, "again", "z"), (7, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    path = scratch_path(spark, "test")
    write_token_files(docs.repartition(5), path, BYTES, shards=4)
    library = Tokenizer.from_file(BYTES)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    got = sorted(token_index(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    want = sorted((i or -1, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t, _ in rows)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == want
    whole = {(r.doc_id, bytes(r.ids)) for r in read_token_files(spark, path).collect()}
    assert whole == {(i, np.array(ids(t), "<u4").tobytes()) for i, t, _ in rows}


def test_no_rows(spark):
    path = scratch_path(spark, "test")
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, BYTES, shards=2)
    assert token_index(spark, path).collect() == []


def test_one_id_in_several_shards(spark):
    rows = [(None if i % 2 else 5, f"text {i}") for i in range(400)]
    path = scratch_path(spark, "test")
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, BYTES, shards=8)
    got = sorted(token_index(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))] and len(got) == 400
    assert spark.read.parquet(path).select("shard").distinct().count() > 4
