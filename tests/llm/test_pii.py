import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import documents, no_documents, odd_documents, odd_rows
from titlegauge.llm import pii
from titlegauge.llm.char_tagger import CharTagger
from titlegauge.llm.pii_spans import PATTERNS, base_spans, ip_holds, joined, luhn


def _plain(text):
    out = [(x.start(), x.end(), "email") for x in PATTERNS["email"].finditer(text)]
    out += [(x.start(), x.end(), "ip") for x in PATTERNS["ip"].finditer(text) if all(int(p) <= 255 for p in x[0].split("."))]
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out += [(x.start(), x.end(), "card") for x in PATTERNS["card"].finditer(text) if 14 <= len(digits(x[0])) <= 19 and luhn(digits(x[0]))]
    out += [(x.start(), x.end(), "phone") for x in PATTERNS["phone"].finditer(text) if 10 <= len(digits(x[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], ["email", "ip", "card", "phone"].index(s[2])))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.-+ 0459()é%\n", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert base_spans(text) == _plain(text)


def test_a_million_digits_take_one_pass():
    text = "3." + "7" * 1_000_000 + " 10.0.0.1 " + "1" * 500_000 + ".2"
    assert ip_spans(text) == [(1_000_003, 1_000_011, "ip")]


@given(st.text(alphabet="0127.", max_size=40))
def test_ips_equal_the_plain_pattern(text):
    plain = [(m.start(), m.end(), "ip") for m in PATTERNS["ip"].finditer(text) if ip_holds(m[0])]
    assert ip_spans(text) == plain


def ip_spans(text):
    return [s for s in base_spans(text) if s[2] == "ip"]


def test_luhn():
    assert luhn("4539148803436467") and not luhn("4539148803436468")


def _corpus(n=120):
    rng = np.random.default_rng(5)
    out = {}
    for i in range(n):
        d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
        card = d(15)
        card += next(c for c in "0123456789" if luhn(card + c))
        out[i] = f"word of the {i % 9} kind a{d(2)}.b@mail{d(1)}.example.com then +1 ({d(3)}) 555-{d(4)} and 10.{rng.integers(0, 255)}.7.{rng.integers(0, 255)} or {card} end"
    return out


@pytest.fixture(scope="module")
def found(spark):
    texts = _corpus() | {901: "plain words only", 902: None}
    return texts, {r.doc_id: r for r in pii.contract_spans(documents(spark, texts)).collect()}


def test_base_columns_and_digest(found):
    import hashlib

    texts, rows = found
    for i, text in texts.items():
        spans = base_spans(text or "")
        assert rows[i].base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert rows[i].n_phone == sum(s[2] == "phone" for s in spans)
        assert set(joined(spans).split(",")) - {""} <= set(rows[i].spans.split(","))


def test_the_tagger_adds_a_phone_without_prefix(spark, found):
    tagger = pii.train_tagger(documents(spark, _corpus()).select("doc_id", "text"))
    text = "word of the 3 kind a12.b@mail3.example.com then (242) 555-3475 and 10.1.2.3 or"
    at = text.index("(242)")
    assert (at, at + 14, "phone", False) in [s[:4] for s in pii.spans_of([text], tagger)[0]]
    assert found[1][901].spans == ""


def test_masking(spark):
    got = pii.mask_personal_data(documents(spark, {1: "to a@b.example.com now", 2: None, 3: "x"}))
    assert {r.doc_id: r.text for r in got.collect()} == {1: "to [EMAIL] now", 2: None, 3: "x"}
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_odd_rows_and_empty_table(spark):
    assert pii.contract_spans(odd_documents(spark)).count() == len(odd_rows())
    assert pii.contract_spans(no_documents(spark)).count() == 0


def test_gradient_of_the_tagger_equals_finite_differences():
    tagger = CharTagger(1, hidden=3)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    rng = np.random.default_rng(1)
    x, tags = rng.integers(0, 100, (6, 4)), np.array([[0, 1, 2, 2, 0, 1]] * 4).T
    _, g = tagger._gradients(x, tags)
    for name, at in (("u", (0, 1, 2)), ("u", (1, 0, 5)), ("o", (1, 2, 1)), ("a", (0, 1)), ("b", (0, 0, 4)), ("s", (0,))):
        h, saved = 1e-4, tagger.p[name][at]
        tagger.p[name][at] = saved + h
        up = tagger._gradients(x, tags)[0]
        tagger.p[name][at] = saved - h
        down = tagger._gradients(x, tags)[0]
        tagger.p[name][at] = saved
        assert abs((up - down) / (2 * h) - g[name][at]) < 2e-3


def test_reconcile_unites_cut_spans_and_keeps_the_heavier_set():
    spans = [(0, 10, "card", 0.9), (8, 20, "card", 0.8), (15, 18, "phone", 0.99), (30, 40, "ip", 0.95)]
    assert pii.reconcile(spans) == [(0, 20, "card", 0.9), (30, 40, "ip", 0.95)]


def test_windows_cover_the_context_of_every_trigger():
    triggers = np.array([3, 50, 400, 401, 999])
    covered = np.zeros(1_000, bool)
    for start in pii._windows(1_000, triggers):
        covered[start : start + pii.WINDOW] = True
    for t in triggers:
        assert covered[max(0, t - pii.CONTEXT) : t + pii.CONTEXT + 1].all()


def test_training_takes_every_kind_however_many_texts_have_none(spark):
    texts = {i: f"plain words and number {i} only" for i in range(4_000)}
    texts |= {9_000 + i: f"see 10.4.7.{i} there" for i in range(3)}
    rows = pii._training_windows(documents(spark, texts).select("doc_id", "text"))
    assert sorted(r["doc_id"] for r in rows if r["kinds"]) == [9_000, 9_001, 9_002]
    assert sum(not r["kinds"] for r in rows) == pii.QUOTA


def test_masking_trains_on_a_sample_of_documents(spark, monkeypatch):
    # The match lies at one of a few offsets, as in a large table; a sample by offset has only one of them.
    texts = {i: " " * (16 * (i % 4)) + f"call +1 (242) 555-{i:04d} now" for i in range(6_000)}
    seen = []
    monkeypatch.setattr(pii, "train_tagger", lambda docs: seen.extend(pii._training_windows(docs)))
    pii.mask_personal_data(documents(spark, texts)).count()
    assert {r["at"] for r in seen} == {0, 16, 32, 48} and len({r["doc_id"] for r in seen}) == pii.QUOTA


def test_masking_sample_without_ids_does_not_depend_on_the_order_of_rows(spark):
    texts = [f"call +1 (242) 555-{i:04d} now" for i in range(1_000)]
    rows = [[(None, t) for t in order] for order in (texts, texts[::-1])]
    one, two = ([r["text"] for r in pii._training_windows(spark.createDataFrame(r, "doc_id long, text string"))] for r in rows)
    assert one == two and len(one) == pii.QUOTA
