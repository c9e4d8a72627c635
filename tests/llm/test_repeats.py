import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import documents, no_documents, odd_documents, odd_rows, prose
from titlegauge.llm import repeats as m
from titlegauge.llm.suffix_groups import suffix_arrays


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), max_size=5))
def test_suffix_arrays_equal_sorting(texts):
    got = suffix_arrays([np.array(t, np.int64) for t in texts])
    assert [g.tolist() for g in got] == [sorted(range(len(t)), key=lambda i: t[i:]) for t in texts]


def test_suffix_arrays_of_runs_and_words():
    texts = [b"a" * 300, b"ab" * 150, b"mississippi" * 9, b"", b"abcab" * 40 + b"abcac"]
    got = suffix_arrays([np.frombuffer(t, np.uint8) for t in texts])
    assert [g.tolist() for g in got] == [sorted(range(len(t)), key=lambda i: t[i:]) for t in texts]


def _brute(texts):
    raw = [(t or "").encode() for t in texts]
    windows = Counter(t[p : p + 200] for t in raw for p in range(len(t) - 199))
    out = []
    for t in raw:
        gone = [False] * len(t)
        for p in range(len(t) - 199):
            if windows[t[p : p + 200]] > 1:
                gone[p : p + 200] = [True] * 200
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def _texts():
    rng = random.Random(3)
    passage, other = prose(50, 70), prose(51, 45)
    out = {i: prose(i, 90) for i in range(12)}
    for i in range(60):
        out[100 + i] = prose(200 + i, rng.randint(0, 30)) + " " + passage[rng.randint(0, 9) :] + " é" + prose(300 + i, 20)
    out[400] = other + " x " + other
    out[401] = "ab" * 260
    out[402] = "z" * 450
    out[403] = prose(60, 60)[:200]
    out[404] = "q" + prose(60, 60)[:200] + "r"
    out[405] = prose(60, 60)[:199]
    out |= {406: None, 407: "", 408: out[3], 409: "日本語" * 70, 410: "x日本語" + "日本語" * 70}
    return out


@pytest.mark.parametrize("lane", [m.LANE_SEGMENTS, 2, 1])
def test_equals_brute_force(spark, monkeypatch, lane):
    monkeypatch.setattr(m, "LANE_SEGMENTS", lane)
    texts = _texts()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in m.contract_digest(documents(spark, texts)).collect()}
    assert got == dict(zip(texts, _brute(texts.values()), strict=True))


def test_odd_rows_and_empty_table(spark):
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in m.contract_digest(odd_documents(spark)).collect())
    assert got == sorted(_brute([r[1] for r in odd_rows()]))
    assert m.contract_digest(no_documents(spark)).count() == 0


def test_texts_without_id_whose_checksums_agree_are_two_texts(spark):
    passage, other = prose(71, 60), prose(72, 80)
    tail = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    sums = {zlib.crc32(f"{passage} {tail(i)}".encode()): tail(i) for i in range(200_000)}
    i, j = next((sums[c], tail(j)) for j in range(400_000) if (c := zlib.crc32(f"{other} {tail(j)}".encode())) in sums)
    rows = [(None, f"{passage} {i}"), (None, f"{other} {j}"), (None, f"{passage} and more")]
    got = m.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = {bytes(r.kept).decode(): r.n_removed for r in got}
    assert removed[f"{other} {j}"] == 0 and sorted(removed.values())[0] == 0 and sorted(removed.values())[1] >= len(passage)


def test_an_anchor_of_a_thousand_segments(spark):
    """A passage among different neighbours a thousand times: crowded lanes at both of its ends."""
    rng = random.Random(9)
    passage = prose(90, 60)
    texts = {i: prose(5_000 + i, 12) + rng.choice([" ", "\n", "é"]) + passage[i % 3 :] + " " + prose(9_000 + i, 12) for i in range(1_000)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in m.contract_digest(documents(spark, texts)).collect()}
    assert got == dict(zip(texts, _brute(texts.values()), strict=True))


def test_ten_thousand_equal_rows_without_id(spark):
    """Equal rows share one list of ranges, whatever their number."""
    same = prose(91, 80)
    docs = spark.createDataFrame([(None, same)] * 10_000 + [(7, prose(92, 60))], "doc_id long, text string")
    ranges = m.repeated_ranges(m._keyed(docs))
    assert ranges.count() <= len(same) // 50
    got = m.remove_repeats(docs).groupBy("doc_id", "n_removed").count().collect()
    assert sorted((r.doc_id or 0, r.n_removed, r["count"]) for r in got) == [(0, len(same), 10_000), (7, 0, 1)]


def test_parts_cover_every_window_once():
    rng = np.random.default_rng(1)
    at, extra = rng.integers(0, 169, 40), rng.integers(0, 60, 40)
    width = np.minimum(at + 1 + extra, 169)
    at = np.minimum(at, width - 1)
    pieces = [rng.integers(0, 256, w + m.LENGTH - 1, dtype=np.uint8).tobytes() for w in width]
    first = rng.integers(0, 1000, 40)
    for starts in m.PART_STARTS:
        parts = m.cut_parts(np.arange(40), first, width, at, pieces, starts)
        seen = Counter((r, f + i) for r, f, w in zip(parts["row"], parts["first"], parts["width"]) for i in range(w))
        assert seen == Counter((r, first[r] + i) for r in range(40) for i in range(width[r]))
        for r, f, w, piece in zip(parts["row"], parts["first"], parts["width"], parts["piece"]):
            assert piece == pieces[r][f - first[r] : f - first[r] + w + m.LENGTH - 1] and w <= starts
