from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import DOCUMENTS, no_documents, odd_documents, odd_rows, prose
from titlegauge.llm import source_mix as m


def _targets(sizes: dict, share=1.5):
    """Shares by weight, the excess over twice a source's size shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left = share * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_weight = sum(w for s, w in weight.items() if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / open_weight for s in order}
        above = {s for s in order if s not in full and target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


def _documents(spark, sources):
    rows = [(i, prose(i, 5 + i % 40), "en", s, 1) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, DOCUMENTS), rows


def test_targets_and_taken(spark):
    sources = [["a", "b", None, "c", "d"][(i * i) % 5] if i % 3 else "a" for i in range(600)]
    docs, rows = _documents(spark, sources)
    got = m.mix_sources(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    want = _targets(dict(sizes))
    taken = Counter()
    for r in got:
        source = sources[r.doc_id]
        assert abs(r.target - want[source]) < 1e-6 and r.source_size == sizes[source]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
    longest = max(len(r[1].split()) for r in rows)
    assert all(abs(taken[s] - want[s]) <= 3 * longest for s in sizes)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert sorted(map(tuple, m.mix_sources(docs.repartition(7)).collect())) == sorted(map(tuple, got))


def test_narrowing_gives_the_same_cut(spark, monkeypatch):
    docs, _ = _documents(spark, ["a", "b", "c"] * 60)
    plain = sorted(map(tuple, m.mix_sources(docs).collect()))
    monkeypatch.setattr(m, "RANGES", 3)
    monkeypatch.setattr(m, "SORT_ROWS", 1)
    monkeypatch.setattr(m, "GROUP_ROWS", 5)
    assert sorted(map(tuple, m.mix_sources(docs).collect())) == plain


@settings(max_examples=10, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.integers(0, 500), min_size=1))
def test_levels_equal_repeated_sharing(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = m.source_targets(spark.createDataFrame(rows, "source string, size long"), m.MixPlan()).collect()
    want = _targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in got)


def test_odd_rows_and_empty_table(spark):
    got = m.mix_sources(odd_documents(spark)).collect()
    assert len(got) == len(odd_rows()) and all(r.taken <= 2 * r.size for r in got)
    assert m.mix_sources(no_documents(spark)).count() == 0
    assert m.take_mix(no_documents(spark)).count() == 0
