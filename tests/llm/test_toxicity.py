import math
import re

import numpy as np
import pytest

from tests.llm.cases import documents, no_documents, odd_documents, odd_rows, prose
from titlegauge.llm import toxicity as t

LABELS = "doc_id long, quality int, toxic int"


def _corpus():
    texts = {i: prose(i, 60) for i in range(300)}
    for i in range(0, 300, 5):
        texts[i] += " vilewort" + " nastything" * (i % 3)
    return texts


@pytest.fixture(scope="module")
def scored(spark):
    texts = _corpus()
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in texts], LABELS)
    return {r.doc_id: r for r in t.contract_scores(documents(spark, texts | {999: ""}), labels).collect()}


def test_held_out_accuracy(scored):
    wrong = [i for i, r in scored.items() if i != 999 and r.held_out and r.predicted != (i % 5 == 0)]
    assert not wrong
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored.values())
    assert scored[999].predicted == 0


def test_evidence_names_training_rows_only(scored):
    held = {i for i, r in scored.items() if r.held_out}
    assert held and not held & {j for r in scored.values() for j in r.neighbours}


def _sparse(dense):
    first = np.append(0, np.cumsum((dense > 0).sum(axis=1)))
    rows, terms = np.nonzero(dense)
    return t.Vectors(first, terms, dense[rows, terms])


@pytest.mark.parametrize("common, together", [(64, 128), (1, 128), (1_000, 7), (20, 7)])
def test_block_search_equals_brute_force(monkeypatch, common, together):
    monkeypatch.setattr(t, "COMMON", common)
    monkeypatch.setattr(t, "TOGETHER", together)
    rng = np.random.default_rng(2)
    dense = (rng.random((400, 90)) * (rng.random((400, 90)) < 0.08)).astype(np.float32)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    labels = rng.integers(0, 2, 300)
    index = t.ExampleIndex(
        np.arange(90, dtype=np.uint64), np.ones(90), 1.0, np.arange(300), np.arange(300), labels, _sparse(dense[:300]), 0.3
    )
    order = index.ids
    best, found = index.neighbours(_sparse(dense[300:]))
    exact = dense[300:] @ dense[:300].T
    for i in range(100):
        top = np.sort(exact[i])[::-1][: t.NEIGHBOURS]
        assert np.allclose(best[i], np.where(top > 0, top, 0), atol=1e-5)
        real = found[i] >= 0
        assert np.allclose(exact[i, order[found[i][real]]], best[i][real], atol=1e-5)


def test_cosines_are_over_whole_texts(spark):
    """Against plain Python, with terms that no example holds."""
    texts = {i: prose(i % 7, 12 + i) + f" own{i} word{i % 3}" for i in range(40)}
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(24)], LABELS)
    rows = t.score_toxicity(documents(spark, texts), labels).collect()

    def counts(text):
        out = {}
        for w in re.findall(r"[a-z0-9]+", text.lower()):
            for term in [("w", w)] + ([("p", w[: t.PREFIX])] if len(w) > t.PREFIX else []):
                out[term] = out.get(term, 0) + 1
        return out

    n, prior, classes = 24, (6 + 1) / (24 + 2), (18, 6)
    held = [{}, {}]
    for i in range(24):
        for term in counts(texts[i]):
            held[i % 4 == 0][term] = held[i % 4 == 0].get(term, 0) + 1
    share = lambda x: prior * held[1].get(x, 0) / classes[1] + (1 - prior) * held[0].get(x, 0) / classes[0]

    def factor(x):
        a, b = held[1].get(x, 0), held[0].get(x, 0)
        chi = n * (a * 18 - b * 6) ** 2 / ((a + b) * (n - a - b) * 18 * 6) if 0 < a + b < n else 0
        return max(min(chi / t.FULL_CHI_SQUARE, 1) ** 2, t.LEAST_FACTOR)

    def vector(text):
        v = {x: (1 + math.log(c)) * (math.log((n + 1) / (share(x) * n + 1)) + 1) * factor(x) for x, c in counts(text).items()}
        length = math.sqrt(sum(w * w for w in v.values()))
        return {x: w / length for x, w in v.items()}

    examples = {i: vector(texts[i]) for i in range(24)}
    for r in rows:
        own = vector(texts[r.doc_id])
        want = sorted((sum(w * e.get(x, 0) for x, w in own.items()) for e in examples.values()), reverse=True)
        assert np.allclose(r.cosines, want[: t.NEIGHBOURS], atol=1e-5)


def test_copies_of_toxic_examples_with_words_of_their_own_are_found(spark):
    texts = {i: " ".join(f"clean{i}x{j}" for j in range(40)) for i in range(300)}
    texts |= {1_000 + i: " ".join(f"rude{i}x{j}" for j in range(40)) for i in range(30)}
    labels = spark.createDataFrame([(i, 1, int(i >= 1_000)) for i in texts], LABELS)
    copies = {2_000 + i: texts[1_000 + i] for i in range(30)} | {3_000 + i: texts[i] for i in range(30)}
    rows = {r.doc_id: r for r in t.score_toxicity(documents(spark, texts | copies), labels).collect()}
    for i in range(30):
        assert rows[2_000 + i].neighbours[0] == 1_000 + i and rows[2_000 + i].cosines[0] > 0.999
        assert rows[2_000 + i].score > rows[3_000 + i].score


def test_odd_rows_one_class_no_labels_and_empty_tables(spark):
    odd = odd_documents(spark)
    none = spark.createDataFrame([], LABELS)
    assert t.contract_scores(odd, none).count() == len(odd_rows())
    ones = spark.createDataFrame([(1, 1, 1), (1, 1, None), (2, 1, 1), (None, 1, 1)], LABELS)
    got = t.contract_scores(odd, ones).collect()
    assert len(got) == len(odd_rows()) and len({round(r.score, 9) for r in got}) == 1
    assert t.contract_scores(no_documents(spark), ones).count() == 0
