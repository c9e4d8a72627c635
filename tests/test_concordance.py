import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from titlegauge.operators import concordance as m

CELLS = "g string, h int, x double, y double, a long, b long"


def _brute(rows):
    out = {}
    for g, h, x, y, a, _ in rows:
        for g2, h2, x2, y2, _, b2 in rows:
            if (g, h) == (g2, h2):
                out[g, h] = out.get((g, h), 0) + (a * b2 if x > x2 and y > y2 else 0)
    return out


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.integers(0, 5), st.integers(0, 3), st.integers(0, 3)), max_size=25))
def test_counts_of_one_task(rows):
    got = m.count_ordered(*(np.array([r[i] for r in rows], int) for i in range(5)))
    want = _brute([(r[0], 0, *r[1:]) for r in rows])
    assert all(got[g] == n for (g, _), n in want.items())


def _rows():
    rng = random.Random(2)
    hot = [("hot", 1, rng.random() ** 3, float(rng.randrange(40)), 1, 1) for _ in range(500)]
    small = [(rng.choice("ab"), rng.randrange(3), rng.randrange(4) / 2, rng.random(), rng.randrange(3), 1) for _ in range(60)]
    return hot + small + [(None, 0, 1.0, 2.0, 1, 1), (None, 0, 0.0, 1.0, 1, 1), ("hot", 1, 0.5, 3.0, 0, 7)]


def test_groups_cut_into_blocks_give_the_same(spark, monkeypatch):
    rows = _rows()
    df = spark.createDataFrame(rows, CELLS)
    want = _brute(rows)
    for limit in (50_000, 40):
        monkeypatch.setattr(m, "BLOCK_ROWS", limit)
        monkeypatch.setattr(m, "CUTS", 5)
        got = {(r.g, r.h): r.pairs for r in m.ordered_pairs(df, ["g", "h"], "x", "y").collect()}
        assert {k: v for k, v in got.items() if k[0]} == {k: v for k, v in want.items() if k[0]}
    assert m.ordered_pairs(df.limit(0), ["g", "h"], "x", "y").collect() == []


def test_slots_are_told_apart_in_the_task(spark, monkeypatch):
    rng = random.Random(3)
    rows = [
        (rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(30) / 2, float(rng.randrange(6)), rng.getrandbits(5), 1 << rng.randrange(5))
        for _ in range(200)
    ] + [("z", 1.0, 1.0, 3, 3), ("z", 1.0, 2.0, 3, 3), ("y", 0.0, 0.0, 1 << 62, 0), ("y", -1.0, -1.0, 0, 1 << 62)]
    want = {}
    for g, x, y, first, _ in rows:
        for g2, x2, y2, _, second in rows:
            if g == g2 and x > x2 and y > y2:
                for slot in range(63):
                    if first & second & 1 << slot:
                        want[g, slot > 0] = want.get((g, slot > 0), 0) + 1
    df = spark.createDataFrame(rows, "g string, x double, y double, first long, second long")
    for limit, step in ((50_000, 50_000), (50_000, 30), (40, 50_000)):
        monkeypatch.setattr(m, "BLOCK_ROWS", limit)
        monkeypatch.setattr(m, "STEP_ROWS", step)
        monkeypatch.setattr(m, "CUTS", 5)
        got = {(r.g, r.slotted): r.pairs for r in m.ordered_pairs(df, ["g"], "x", "y").collect()}
        assert got == want
