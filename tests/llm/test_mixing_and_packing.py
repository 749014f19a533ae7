import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from planweave.llm.mixing import OP5_SQL, mix_sources, op5_mix_sources
from planweave.llm.packing import assemble, cut_pieces, op9_pack_documents, pack_pieces, vector_best_fit

WORDS = public_tokenizers.path("word_bpe_49k.json")


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_mix_equals_sql(spark, tmp_path):
    rows = [(i, "w " * (i * 37 % 90), "en", None if i % 7 == 0 else "s" + "abcéz"[i % 5] * (1 + i % 2), 0) for i in range(400)]
    rows += [(None, "null id", "en", "sa", 0), (5, None, "en", "sa", 0), (5, "twice", "en", "only", 0), (5, "twice", "en", "only", 0), (9, "", None, "empty", 0)]
    d = table(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    want = sorted((tuple(r) for r in con.execute(OP5_SQL).fetchall()), key=key)
    got = sorted((tuple(r) for r in op5_mix_sources(spark, d).collect()), key=key)
    assert got == want
    sizes = {}
    for r in got:
        assert r[4] <= 3 * r[1]
        s = sizes.setdefault((r[2], r[3]), [0, 0])
        s[0] += r[4]
    for (size, target), (taken, _) in sizes.items():
        assert target <= 3 * size and abs(taken - target) <= 0.1 * target + 180
    assert abs(sum(t for _, t in sizes) - sum(r[1] for r in got)) < 1


def test_many_shards_keep_the_sum(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE concat('b', id % 9) END AS source", "id % 50 AS size", "1 AS copies")
    got = mix_sources(docs, shard_rows=100).groupBy("source").agg({"copies": "sum", "target": "max", "source_size": "max", "size": "count"}).collect()
    for r in got:
        assert abs(r["sum(copies)"] - r["count(size)"] * r["max(target)"] / r["max(source_size)"]) <= 1
    assert mix_sources(docs.limit(0)).collect() == []


def test_packing(spark, tmp_path):
    text = "some words in a row "
    rows = [(i, text * (i * 53 % 300), "en", "s", 0) for i in range(300)]
    rows += [(None, "null id", "en", "s", 0), (3, None, "en", "s", 0), (3, "twice", "en", "s", 0), (3, "twice", "en", "s", 0), (900, text * 3000, "en", "s", 0)]
    got = op9_pack_documents(spark, table(spark, tmp_path, rows)).collect()
    library = Tokenizer.from_file(WORDS)
    total = sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r.length for r in got) == total
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-total // 2048) + 1
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 900)
    assert [p for p, _, _ in long] == list(range(len(long))) and all(n == 2048 for _, _, n in long[:-1]) and [s for _, s, _ in long] == [2048 * p for p, _, _ in long]


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 40), "x") for i in range(60)], "doc_id long, text string, sequence_id string")
    pieces = cut_pieces(docs, WORDS, max_tokens=64)
    made = assemble(pack_pieces(pieces.withColumn("offset", pieces.start), max_tokens=64)).collect()
    count = sorted(i for r in made for i in np.frombuffer(r.ids, "<u4").tolist())
    assert count == sorted(i for r in pieces.collect() for i in np.frombuffer(r.ids, "<u4").tolist())
    assert max(len(r.ids) for r in made) <= 256
    assert pack_pieces(pieces.limit(0)).collect() == []


def test_every_capacity_holds():
    rng = np.random.default_rng(5)
    n = rng.integers(1, 900, 3000).astype(float)
    need = np.stack([n, np.ones(3000), n * n], axis=1)
    for rule in ("dot", "norm"):
        for cap in ([2048.0, 5.0, 2048.0**2], [2048.0, 2048.0, 900.0**2]):
            bins = vector_best_fit(need, np.array(cap), np.array([1.0, 0.5, 0.5]), rule)
            for d in range(3):
                assert np.bincount(bins, need[:, d]).max() <= cap[d] + 1e-6
            assert bins.max() + 1 <= 1.25 * max(np.ceil(need.sum(axis=0) / cap)) + 1
