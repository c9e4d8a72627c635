import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.cases import documents, no_documents, odd_documents, odd_rows, prose
from titlegauge.llm import mixing_lm as m


def _base(rows):
    tokens = [(t or "").encode().lower().split() + ["END"] for _, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    counts = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6), h)
        for ws, h in zip(tokens, held, strict=True)
    )


def test_baseline_equals_brute_force_on_odd_rows(spark):
    got = m.contract_scores(odd_documents(spark)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.held_out) for r in got) == _base(odd_rows())
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_empty_table(spark):
    assert m.contract_scores(no_documents(spark)).count() == 0


def test_grams_are_the_bytes_after_their_contexts():
    row, gram = m.grams(pa.array(["aB", "", None, "é"]))
    assert row.tolist() == [0, 0, 0, 1, 2, 3, 3, 3]
    last = [int(g) & 0xFF for g in gram]
    assert last == [ord("a"), ord("b"), 3, 3, 3, 0xC3, 0xA9, 3]
    assert (int(gram[1]) >> 8) & 0xFF == ord("a") and (int(gram[0]) >> 8) & 0xFF == 2


def test_probabilities_of_a_symbol_sum_to_one():
    rng = np.random.default_rng(3)
    layout = m.Slots.for_grams(100)
    mixer = m.Mixer(layout, rng.integers(0, 1 << 18, layout.offsets[-1]).astype(np.uint32), m._first_weights())
    context = np.uint64(0x616263646500)
    p = 2.0 ** mixer.log2_probability(context | np.arange(256, dtype=np.uint64))
    assert abs(p.sum() - 1) < 1e-4


def test_held_out_text_like_the_corpus_scores_better_than_noise(spark):
    docs = documents(spark, {i: prose(i % 50, 80) + " " + prose(i, 5) for i in range(160)} | {999: "qzx wvk " * 40})
    got = {r.doc_id: r for r in m.contract_scores(docs).collect()}
    bits = {i: -r.score / r.n_tokens for i, r in got.items()}
    assert max(b for i, b in bits.items() if i != 999) < bits[999]


def test_memory_of_a_step():
    """Cutting a step's text into grams needs at most 40 bytes a symbol beside the text."""
    column = pa.array([prose(i, 400) for i in range(300)])
    n = sum(len(t.encode()) + 1 for t in column.to_pylist())
    tracemalloc.start()
    rows, _ = m.grams(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == n and peak < 40 * n
