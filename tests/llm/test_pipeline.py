import corpus_pipeline as cp
import pytest
from test_near_dup import brute_force

from planweave.llm.quality import judge

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [[r.asDict() for r in docs.collect()]]
    for i, (_, stage) in enumerate(cp.STAGES):
        docs = cp.stored(stage(spark, docs, SF), f"test-{i}")
        out.append([r.asDict() for r in docs.collect()])
    return out


def test_columns(stages):
    for rows in stages[1:-1]:
        assert set(rows[0]) == set(stages[0][0])


def test_quality(stages):
    assert {r["doc_id"] for r in stages[1]} == {r["doc_id"] for r in stages[0] if judge(r["text"])[-1]}


def test_near_duplicates(stages):
    want = {i for i, _, _, kept in brute_force([(r["doc_id"], r["text"]) for r in stages[1]], size=4) if kept}
    assert {r["doc_id"] for r in stages[2]} == want and len(stages[2]) == len(want)


def test_personal_data(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2]}
    assert {r["doc_id"] for r in stages[3]} == set(before)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3])
    assert any("<email>" in r["text"] for r in stages[3])
    assert not any("@mail" in r["text"] for r in stages[3])


def test_mix(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[3]}
    copies = {}
    for r in stages[4]:
        assert texts[r["doc_id"]] == r["text"]
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 3


def test_packing(stages):
    by, at = {}, {}
    for r in stages[5]:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        at[r["doc_id"]] = at.get(r["doc_id"], 0) + (r["piece"] == 0)
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert sum(at.values()) == len(stages[4])


def test_run(spark, stages):
    assert cp.run(spark, SF).count() == len(stages[5])


CLASHES = {"kept": "k", "ratio": 1.5, "size": 3, "target": "t", "copies": "c", "source_size": 1, "pii_spans": "p", "sequence_id": "q", "group": 9, "_rest": "r", "_bin": 4}


def test_edges_of_every_stage(spark):
    """Null ids and texts, rows that repeat, long texts, ties and clashing names; what a stage does not read comes out as it went in."""
    text = " ".join(f"w{i * i % 997}x{i}" for i in range(90))
    rows = [(None, text, None), (1, None, "s"), (1, "", "s"), (2, text, None), (3, text + " more", "s"), (3, text + " more", "s"), (4, f"{text} a@b.cd " * 60, "t")]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], names)
    wide = docs.select("*", *(cp.F.lit(v).alias(k) for k, v in CLASHES.items()))
    want = {"quality rules": 4, "near duplicates": 4, "personal data": 7, "packing": None}
    for name, stage in cp.STAGES:
        for df in (wide, wide.limit(0)):
            got = stage(spark, df, SF)
            out = [r.asDict() for r in got.collect()]
            if name == "packing":
                assert {r["doc_id"] for r in out} == ({r[0] for r in rows} if df is wide else set())
                continue
            assert got.columns == wide.columns
            assert all(r[k] == v for r in out for k, v in CLASHES.items())
            if df is not wide:
                assert out == []
            elif name in want:
                assert len(out) == want[name], name
            if name == "near duplicates" and df is wide:
                assert sorted(r["doc_id"] or -1 for r in out) == [-1, 1, 1, 2]  # 4 repeats the words of 2
