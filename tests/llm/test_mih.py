import numpy as np
import pytest

from weftline.llm import mih

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, label int, query long, entry long"


def brute(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % 50 == 0:
            scored = sorted((-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w in ok if j != i)
            out[i] = [(j, -c) for c, j in scored[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = brute(rows), answers(mih.nearest(df))
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, near in got.items():
        for j, s in near:
            a, b = vectors[q], vectors[j]
            assert s == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-12)


def test_probing_reaches_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (3000, 8), np.uint8)
    codes[:500] = codes[0] ^ (np.uint8(1) << rng.integers(0, 8, (500, 8), np.uint8)) * (rng.random((500, 8)) < 0.5)
    index = mih.MultiIndex(codes)
    for r in (0, 3, 9, 17, 40, 64):
        distance = np.bitwise_count(codes ^ codes[0]).sum(1)
        assert index.within(codes[0], r).tolist() == np.flatnonzero(distance <= r).tolist()


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)


def test_odd_vectors(spark):
    """Copies (ties), null, zero, non-finite and broken vectors, null ids; everything within reach, so results are exact."""
    rng = np.random.default_rng(2)
    same = [float(x) for x in rng.normal(size=4)]
    rows = [(i, same) for i in range(0, 120)] + [(200 + i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(300, None), (350, [0.0] * 4), (400, [1.0, float("nan"), 0.0, 1.0]), (450, [1.0, None, 0.0, 1.0]), (500, [float("inf"), 1.0, 1.0, 1.0]), (None, same), (550, []), (600, [1.0, 2.0])]
    got, want = answers(mih.nearest(frame(spark, rows))), brute([r for r in rows if r[1] is None or len(r[1]) == 4])
    assert set(got) == set(want) == {0, 50, 100, 200, 250}
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]] or q >= 200
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-6)


def test_tiny_and_huge_vectors(spark):
    """Components whose squares vanish or overflow: the cosines are those of the same directions."""
    rng = np.random.default_rng(3)
    plain = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    scaled = [(i, [x * (1e-200, 1.0, 1e200, 1e-5)[i % 4] for x in v]) for i, v in plain]
    df = spark.createDataFrame(scaled, "vec_id long, embedding array<double>")
    got, want = answers(mih.nearest(df)), brute(plain)
    assert set(got) == set(want) and all([j for j, _ in got[q]] == [j for j, _ in want[q]] for q in want)
    assert all([s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-9) for q in want)


def test_an_id_of_several_near_vectors(spark):
    """A query's own vectors take none of its five places; ids beyond 2^53 are told apart."""
    rng = np.random.default_rng(5)
    big = 50 * (2**54 // 50)
    rows = [(big, [1.0, 0.0, 0.0, i / 1000]) for i in range(9)] + [(big + 1 + i, [float(x) for x in rng.normal(size=4)]) for i in range(20)]
    got = mih.nearest(frame(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 9 * 5 and big not in by[big]


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])]
    assert [j for j, _ in answers(mih.nearest(frame(spark, rows)))[0]] == [1, 2]
    assert mih.nearest(frame(spark, [])).collect() == [] and mih.nearest(frame(spark, rows[1:])).collect() == []
    assert mih.nearest(frame(spark, rows[:1])).collect() == []


def test_blocks_and_shards(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    monkeypatch.setattr(mih, "SHARD", 97)
    monkeypatch.setattr(mih, "BLOCK", 3)
    want, got = brute([(r.vec_id, r.embedding) for r in df.collect()]), answers(mih.nearest(df))
    assert sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
