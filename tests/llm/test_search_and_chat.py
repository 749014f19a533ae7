import random

import duckdb

from planweave.llm.chat import OP10_SQL, format_preferences, op10_format_preferences
from planweave.llm.hamming import hamming_top_k, sign_codes

TURNS = "pair_id long, turn long, role string, text string"


def test_top_k_equals_brute_force(spark):
    rnd = random.Random(1)
    codes = [rnd.getrandbits(64) - (1 << 63) for _ in range(60)]
    near = [c ^ (1 << rnd.randrange(63)) for c in codes[:30] for _ in range(3)]
    rows = list(enumerate(codes + near + [codes[0]] * 30))
    base = spark.createDataFrame([*rows, (None, 5), (999, None)], "id long, code long")
    queries = base.where("id % 7 = 0")
    got = {}
    for r in hamming_top_k(base, queries, k=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.id))
    for i, c in rows:
        if i % 7 == 0:
            want = sorted(((c ^ d) & (1 << 64) - 1).bit_count() * 1000 + j for j, d in rows)[:4]
            assert [(d * 1000 + j) for _, d, j in sorted(got[i])] == want
    assert set(got) == {i for i, _ in rows if i % 7 == 0}


def test_few_rows(spark):
    base = spark.createDataFrame([(1, 3), (2, 3), (2, 3)], "id long, code long")
    assert sorted((r.id, r.distance, r.rank) for r in hamming_top_k(base, base.where("id = 1"), k=5, bits=8).collect()) == [(1, 0, 1), (2, 0, 2), (2, 0, 3)]
    assert hamming_top_k(base.limit(0), base, k=5, bits=8).collect() == []
    assert hamming_top_k(base, base.limit(0), k=5, bits=8).collect() == []
    vectors = spark.createDataFrame([(1, [1.0, -1.0, None, 2.0], 7), (2, None, 7), (3, [], 7)], "vec_id long, embedding array<float>, code int")
    assert sorted((r.id, r.code) for r in sign_codes(vectors, 4).collect()) == [(1, 9), (3, 0)]


def test_preferences(spark):
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "a"), (3, 0, "user", "q"), (3, 1, "assistant", "r"), (4, None, None, None), (4, 1, "user", None), (6, 0, "user", "only")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "?"), (2, 0, "user", "b"), (3, 0, "user", "q"), (3, 1, "assistant", "r"), (4, None, None, None), (5, 0, "user", "only")]
    got = {r.pair_id: r for r in format_preferences(spark.createDataFrame(a, TURNS), spark.createDataFrame(b, TURNS)).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].prompt == "<|im_start|>user\nhi<|im_end|>\n" and got[1].n_prompt_turns == 1
    start, end = map(int, got[1].chosen_mask.split(":"))
    assert got[1].chosen[start:end] == "yes<|im_end|>\n" and got[1].rejected.endswith("?<|im_end|>\n")
    start, end = map(int, got[1].rejected_mask.split(":"))
    assert got[1].rejected[start:end] == "no<|im_end|>\n"
    assert got[2].prompt == "" and got[2].chosen_mask == ""
    assert got[3].identical and got[3].chosen == "" == got[3].rejected
    assert got[4].rejected == "" and got[4].chosen == "<|im_start|>user\n<|im_end|>\n" and not got[4].identical
    none = spark.createDataFrame([], TURNS)
    assert format_preferences(none, none).collect() == []


def test_preferences_equal_sql(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", None]), rnd.choice(["x", "yy", "é😀", None, ""])) for c in range(60) for t in range(rnd.randrange(1, 9))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = op10_format_preferences(spark, str(tmp_path))
    want = con.execute(OP10_SQL).fetchall()
    names = [d[0] for d in con.execute(OP10_SQL).description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want)
