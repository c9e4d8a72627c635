import re
from collections import Counter

import pytest

from tests.llm.cases import documents, no_documents, odd_documents, odd_rows, prose
from titlegauge.llm import fertility as m

spm = pytest.importorskip("sentencepiece")


def _base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed


def test_base_columns_on_odd_rows(spark):
    got = m.quality_by_fertility(odd_documents(spark)).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(_base(r[1]) for r in odd_rows())
    assert all(not (r.base_failed and r.kept) for r in got)


def test_tokens_equal_the_library(spark):
    texts = {1: "Some plain words here", 2: "日本 words 𝔘", 3: "a a a a"}
    processor = spm.SentencePieceProcessor(model_file=m.VOCABULARY)
    for r in m.quality_by_fertility(documents(spark, texts)).collect():
        ids = [i for w in texts[r.doc_id].split() for i in processor.encode(w)]
        assert r.n_tokens == len(ids)
        assert abs(r.byte_share - sum(processor.is_byte(i) for i in ids) / len(ids)) < 1e-9


def test_broken_up_text_is_rejected_and_prose_kept(spark):
    texts = {i: prose(i, 120 + i) for i in range(100)}
    texts[500] = " ".join(w + "$$$%%" for w in prose(500, 120).split())
    rows = {r.doc_id: r for r in m.quality_by_fertility(documents(spark, texts)).collect()}
    assert not rows[500].kept and not rows[500].base_failed
    assert sum(rows[i].kept for i in range(100)) >= 98


def test_empty_table(spark):
    assert m.quality_by_fertility(no_documents(spark)).count() == 0
