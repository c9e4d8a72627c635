import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from titlegauge.llm import hash_search as m

COLUMNS = "vec_id long, embedding array<float>, label int"


def _brute(ids, vectors, asks, k=5):
    """All cosines in double precision, ties to the smaller id."""
    out = []
    for q, query in zip(ids, vectors, strict=True):
        if q is not None and asks(q):
            scores = [
                (-(v * query).sum() / (np.linalg.norm(v) * np.linalg.norm(query)), i is None, i or 0)
                for i, v in zip(ids, vectors, strict=True)
                if i != q
            ]
            out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def _rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def _table(spark, ids, vectors):
    rows = [(i, [float(x) for x in v], 1) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, COLUMNS)


def _same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=0, atol=1e-12)


def test_small_table_is_exact(spark, small_dir):
    """Up to the sample's size every row meets every query."""
    table = pq.read_table(f"{small_dir}/embeddings.parquet")
    ids, vectors = table["vec_id"].to_pylist(), np.array(table["embedding"].to_pylist(), np.float64)
    got = _rows(m.contract_neighbours(spark.read.parquet(f"{small_dir}/embeddings.parquet")))
    _same(got, sorted(_brute(ids, vectors, lambda q: q % 50 == 0)))


@pytest.mark.parametrize("kind", ["spread", "clustered"])
def test_recall_beyond_the_sample(spark, monkeypatch, kind):
    """Most rows are outside the sample, so they are found by their codes alone."""
    monkeypatch.setattr(m, "SAMPLE_ROWS", 256)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(6_000, 24))
    if kind == "clustered":
        vectors = 3 * rng.normal(size=(40, 24))[rng.integers(0, 40, 6_000)] + vectors
    vectors = vectors.astype(np.float32).astype(np.float64)
    ids = list(range(6_000))
    want = _brute(ids, vectors, lambda q: q % 50 == 0)
    got = _rows(m.contract_neighbours(_table(spark, ids, vectors)))
    assert len(got) == len(want)
    found = {(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}
    assert len(found) >= 0.95 * len(want)
    for query, _, vec, score in got:
        a, b = vectors[query], vectors[vec]
        assert abs(score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 16, (400, 16)).astype(np.uint16)
    near = np.repeat(codes[:20], 20, axis=0)
    for row in near:
        for bit in rng.choice(256, rng.integers(0, 60), replace=False):
            row[bit // 16] ^= np.uint16(1 << (bit % 16))
    codes = np.concatenate([codes, near])
    index = m.BlockIndex(codes)
    for code in codes[::37]:
        distance = np.bitwise_count(codes ^ code).sum(axis=1)
        for radius in (0, 1, 7, 15, 16, 31, 32, 50, 100, 255, 256):
            assert index.within(code, radius).tolist() == np.flatnonzero(distance <= radius).tolist()


def test_rotations_are_learned_and_orthonormal():
    rng = np.random.default_rng(8)
    sample = rng.normal(size=(500, 10)) * np.arange(1, 11)
    coder = m.learn_coder(sample, bits=64)
    assert coder.directions.shape == (10, 64)
    first = coder.directions[:, :10]
    assert np.allclose(first.T @ first, np.eye(10))
    assert m.learn_coder(rng.normal(size=(50, 300)), bits=64).directions.shape == (300, 256)
    assert m.learn_coder(rng.normal(size=(1, 3))).codes(np.ones((2, 3))).shape == (2, 16)


def test_odd_rows_and_clashing_names(spark):
    rng = np.random.default_rng(2)
    good = {i: rng.normal(size=6).astype(np.float32).astype(float) for i in (0, 1, 2, 3, 50, 51, 100)}
    good[2] = good[1]  # a tie
    rows = [(i, v.tolist()) for i, v in good.items()]
    rows += [(50, good[50].tolist())] * 3  # a repeated row
    rows += [(200, None), (250, []), (300, [0.0] * 6), (350, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (400, [float("nan")] * 6)]
    rows += [(450, [float("inf")] * 6), (500, [1.0] * 5), (None, [3.0] * 6), (None, [3.0] * 6), (None, [-3.0, 3.0, 3.0, 3.0, 3.0, 3.0])]
    rows += [(51, (good[51] + 9).tolist())]  # a second vector under one id: the least counts
    least = min(good[51].tolist(), (good[51] + 9).astype(np.float32).astype(float).tolist())
    df = spark.createDataFrame(
        [(*r, 5, "x", 1.0, 2, 3, 4) for r in rows],
        "vec_id long, embedding array<float>, rank int, vector string, score double, radius int, unnamed int, row_block int",
    )
    ids = [*good, None, None]
    vectors = [*(good | {51: np.array(least)}).values(), np.full(6, 3.0), np.array([-3.0, 3.0, 3.0, 3.0, 3.0, 3.0])]
    want = sorted(_brute(ids, vectors, lambda q: q % 50 == 0), key=repr)
    got = sorted(_rows_any(m.contract_neighbours(df)), key=repr)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=0, atol=1e-12)
    assert {r[0] for r in got} == {0, 50, 100}


def _rows_any(df):
    return [tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()]


def test_a_crowd_of_equal_vectors_ties_to_small_ids(spark):
    rng = np.random.default_rng(4)
    vectors = np.concatenate([np.tile([0.1, 0.7, -0.3, 0.2], (2_000, 1)), rng.normal(size=(1_000, 4))])
    got = _rows(m.contract_neighbours(_table(spark, range(3_000), vectors)))
    crowd = [r for r in got if r[0] < 2_000]
    assert len(crowd) == 5 * 40
    for query in (0, 50, 1950):
        want = [i for i in range(6) if i != query][:5]
        assert [r[2] for r in crowd if r[0] == query] == want


def test_fewer_candidates_than_asked_and_empty(spark):
    two = _table(spark, [0, 1], np.eye(2, 3) + 0.1)
    assert [r[:3] for r in _rows(m.contract_neighbours(two))] == [(0, 1, 1)]
    assert _rows(m.contract_neighbours(_table(spark, [0], np.ones((1, 3))))) == []
    empty = m.contract_neighbours(spark.createDataFrame([], COLUMNS))
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert _rows(m.contract_neighbours(_table(spark, [1, 2], np.ones((2, 3))))) == []


def test_cells_of_many_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    table = _table(spark, range(900), rng.normal(size=(900, 8)))
    one = _rows(m.nearest(table, F.col("vec_id") % 10 == 0))
    monkeypatch.setattr(m, "BLOCK_ROWS", 60)
    monkeypatch.setattr(m, "BLOCK_QUERIES", 25)
    assert _rows(m.nearest(table, F.col("vec_id") % 10 == 0)) == one
