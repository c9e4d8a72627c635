import re

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from tests.llm.cases import documents, no_documents, odd_documents, odd_rows, prose
from titlegauge.llm import licenses as m


def _bigrams(text):
    words = re.findall(r"[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return set(zip(words, words[1:], strict=False))


TEMPLATES = [
    (n, _bigrams(t)) for n, t in sorted((n, t) for n, ts in m.TEMPLATES.items() for t in ts)
]


def _brute(text):
    lines, at = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines.append((at, at + len(line)))
        at += len(line) + 1
    parts = set(lines)
    if lines:
        parts.add((lines[0][0], lines[-1][1]))
        begin, end = lines[0]
        for a, b in lines[1:]:
            if a - end > 1:
                parts.add((begin, end))
                begin = a
            end = b
        parts.add((begin, end))
    out = []
    for a, b in sorted(parts):
        own = _bigrams(text[a:b])
        if own:
            dice, name = max(((2 * len(own & t) / (len(own) + len(t)), -i) for i, (_, t) in enumerate(TEMPLATES)))
            if dice >= m.THRESHOLD:
                out.append((TEMPLATES[-name][0], a, b))
    return out


PIECES = ["Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "licensed under the apache license version", "\n", "\n\n", " ", "This work is licensed under the GNU General Public License, version 2.", "é word", "of the"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=6).map("".join), min_size=1, max_size=4))
def test_equals_brute_force(texts):
    index = m.TemplateIndex(m.TEMPLATES, m.THRESHOLD)
    column = pa.array(texts, pa.string())
    found, number, template, _, data = index.matches(column)
    got = [[] for _ in texts]
    for i, t in zip(number, template, strict=True):
        before = sum(len(x.encode()) for x in texts[: found.row[i]])
        raw = texts[found.row[i]].encode()
        place = lambda b: len(raw[: b - before].decode())
        got[found.row[i]].append((index.names[t], place(found.start[i]), place(found.end[i])))
    assert [sorted(g, key=lambda x: x[1:]) for g in got] == [_brute(t) for t in texts]


def test_full_notice_over_wrapped_lines(spark):
    notice = m.TEMPLATES["MIT"][3].replace(" of ", " of\n")
    rows = {r.doc_id: r for r in m.summary(documents(spark, {1: "Title\n\n" + notice + "\n\nmore text here", 2: "of the license"})).collect()}
    assert rows[1].license == "MIT" and rows[1].dice == 1.0 and rows[2].n_matches == 0 and rows[2].license is None


def test_odd_rows_and_empty_table(spark):
    assert m.summary(odd_documents(spark)).count() == len(odd_rows())
    assert m.summary(no_documents(spark)).count() == 0


def _found(text):
    column = pa.array([text], pa.string())
    index = m.TemplateIndex(m.TEMPLATES, m.THRESHOLD)
    found, _ = m.all_matches(index, column)
    raw = text.encode()
    return [(index.names[t], raw[a:b].decode()) for t, a, b in zip(found.template, found.start, found.end, strict=True)]


def test_notice_inside_a_line():
    text = "This dataset was collected by the project team and is licensed under CC BY 4.0. Ask them for more."
    assert _found(text) == [("CC-BY-4.0", "licensed under CC BY 4.0")]


def test_long_notice_in_a_text_without_line_breaks():
    notice = m.TEMPLATES["MIT"][3]
    got = _found("é some words before it " + notice + " and " + prose(1, 300) + " Released under the MIT License.")
    assert [n for n, _ in got] == ["MIT", "MIT"] and notice.startswith(got[0][1]) and len(got[0][1]) > len(notice) - 3


def test_comment_header_without_blank_lines():
    notice = m.TEMPLATES["Apache-2.0"][1]
    text = "# Copyright of the people who wrote this long header of many words in it\n#\n# " + notice.replace(" of ", " of\n# ") + "\n#\n# and here " + prose(2, 300)
    assert any(n == "Apache-2.0" and len(t) >= len(notice) - 3 for n, t in _found(text))


def test_identifier_of_an_unlisted_licence_is_no_window():
    assert _found("some code SPDX-License-Identifier: Foo and more words here") == []


def _brute_windows(text):
    words = re.findall(r"[a-z0-9]+", text.lower())
    pairs = list(zip(words, words[1:], strict=False))
    out = 0
    for a in range(len(pairs)):
        for b in range(a + 1, len(pairs) + 1):
            own = set(pairs[a:b])
            for _, t in TEMPLATES:
                if len(t) >= m.LEAST_PART or own >= t:
                    out = max(out, 2 * len(own & t) / (len(own) + len(t)))
    return out if out >= m.THRESHOLD else None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["licensed", "under", "the", "mit", "license", "cc", "by", "4", "0", "released", "x"]), max_size=14).map(" ".join))
def test_best_window_equals_brute_force(text):
    got = m.TemplateIndex(m.TEMPLATES, m.THRESHOLD).windows(pa.array([text], pa.string())).dice
    assert (max(got) if len(got) else None) == _brute_windows(text)


def _best(spark, text):
    return m.summary(documents(spark, {1: text})).first().license


def test_program_notices_of_the_gnu_family_name_their_own_licence(spark):
    notice = next(t for t in m.TEMPLATES["GPL-3.0"] if t.startswith("This program is free"))
    kin = {"GPL-3.0": "GNU General", "LGPL-3.0": "GNU Lesser General", "AGPL-3.0": "GNU Affero General"}
    for name, words in kin.items():
        assert _best(spark, notice.replace("GNU General", words)) == name


def test_whole_bsd_texts_with_a_copyright_line(spark):
    for name in ("BSD-3-Clause", "BSD-2-Clause"):
        text = max(m.TEMPLATES[name], key=len)
        for mark in ("1. ", "2. ", "3. ", "THIS SOFTWARE IS"):
            text = text.replace(" " + mark, "\n\n" + mark)
        assert _best(spark, "Copyright (c) 2020, The people of the project\nAll rights reserved.\n\n" + text) == name
