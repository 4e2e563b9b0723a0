import numpy as np
import pytest

from graticule.llm import multi_index
from graticule.llm.queries import QUERIES


def brute(ids, vectors, k, every):
    out = {}
    for i, q in zip(ids, vectors):
        if i % every == 0:
            scores = (vectors * q).sum(1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def collect(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_substring_index_finds_the_whole_ball():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (500, 4), dtype=np.uint16)
    codes[:200] = codes[0] ^ (1 << rng.integers(0, 16, (200, 4))).astype(np.uint16)
    index = multi_index.SubstringIndex(codes)
    for radius in range(0, 65, 3):
        for q in (codes[0], codes[300], np.zeros(4, np.uint16)):
            want = np.flatnonzero(multi_index.distances(q, codes) <= radius)
            assert index.within(q, radius).tolist() == want.tolist()


def test_hot_vector_and_ties(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 16))
    vectors[100:300] = vectors[100]  # a large group of copies
    ids = np.arange(400) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)],
                               "vec_id bigint, embedding array<double>")
    got = collect(multi_index.nearest(df, every=20, k=20, index_block=64, query_block=8))
    want = brute(ids, vectors, 20, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    hot = [q for q in want if 300 <= q < 900]
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in hot)
    for q in want:
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))


def test_awkward_vectors(spark):
    good = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [-1.0, 0.0]), (3, [-1.0, 0.0]), (5, [1.0, -0.0]), (6, [1.0, 0.0])]
    bad = [(7, None), (40, [0.0, 0.0]), (8, [1.0, None]), (60, [float("nan"), 1.0]), (None, [1.0, 1.0]),
           (9, [float("inf"), 1.0]), (80, [1.0, 2.0, 3.0]), (100, [])]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<double>")
    got = collect(multi_index.nearest(df))
    assert got.keys() == {0, 20}
    assert got[0] == [(20, 4.0), (5, 1.0), (6, 1.0), (3, -1.0)]
    assert collect(multi_index.nearest(df.limit(0))) == {}
    alone = spark.createDataFrame([(20, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert collect(multi_index.nearest(alone)) == {}


def test_query_recall(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    got = collect(QUERIES["op9_multi_index"](spark, small))
    want = brute(rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float), 20, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    scores = {q: dict(want[q]) for q in want}
    assert all(s == pytest.approx(scores[q][i], abs=1e-12) for q in got for i, s in got[q] if i in scores[q])
