import random

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import documents, no_documents, odd_documents, odd_rows, prose
from titlegauge.llm import common
from titlegauge.llm import near_dup as m
from titlegauge.llm.components import components


def _sets(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def _brute(texts, plan):
    sets = {i: _sets(t, plan.words) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= plan.percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def _edited(text, seed, n):
    rng, words = random.Random(seed), text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"edit{seed}x{at}"
    return " ".join(words)


def _texts():
    out = {i: prose(i, 60) for i in range(40)}
    # Near copies of one text that are alike only through it, its id being neither first nor last.
    original = prose(777, 120)
    for i in range(40):
        out[1_000 + i] = _edited(original, i, 2)
    out[1_020] = original
    # A chain: each step alike, the ends not.
    step = prose(888, 100)
    for i in range(8):
        out[2_000 + i] = step
        step = _edited(step, 50 + i, 1)
    out |= {3_000: "one", 3_001: "One", 3_002: "one two", 3_003: "", 3_004: None, 3_005: out[5].upper()}
    return out


@pytest.mark.parametrize("plan", [m.CONTRACT, m.CORPUS, m.NearDupPlan(block=4)], ids=["contract", "corpus", "small blocks"])
def test_equals_brute_force(spark, plan):
    texts = _texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.near_duplicates(documents(spark, texts), plan).collect()}
    assert got == _brute(texts, plan)


def test_kept_is_the_smallest_of_a_group(spark):
    rows = m.near_duplicates(documents(spark, _texts())).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_odd_rows_and_empty_table(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in m.near_duplicates(odd_documents(spark)).collect()), key=str)
    assert len(got) == len(odd_rows())
    by_id = {g[0]: g for g in got if g[0] is not None}
    assert by_id[1][2:] == (1, True) and by_id[2][2:] == (1, False) and by_id[4][1:] == (0, 4, True)
    assert [g for g in got if g[0] is None and g[2] is None and g[3]] == [g for g in got if g[0] is None]
    assert m.near_duplicates(no_documents(spark)).count() == 0


def test_posterior_bounds_fall_with_fewer_matches():
    steps = m.fewest_matches(192, 32, 85, 1e-6)
    assert [n for n, _ in steps] == [32, 64, 96, 128, 160, 192]
    assert all(0 < least < n for n, least in steps)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 500 for i in range(500, 540)}


def test_batches_of_long_rows_are_bounded_by_bytes(spark):
    """10,000 candidates with their sets would be one batch otherwise, whatever their size."""
    long = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 4_000).alias("text"))
    sizes = common.id_and_text(long, "doc_id", "text").mapInArrow(
        lambda batches: (common.record_batch(n=[b.num_rows], bytes=[b.nbytes]) for b in batches), "n long, bytes long"
    )
    row = sizes.agg(F.sum("n").alias("n"), F.max("bytes").alias("most")).first()
    assert row.n == 2_000 and row.most <= 2 * common.ARROW_BYTES
