import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import documents, no_documents, odd_documents, odd_rows, prose
from titlegauge.llm import fill_middle as m


def _units(text):
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def _brute(doc_id, text, suffix_first=50):
    """Output, form, sizes by whole strings."""
    text, name = text or "", "" if doc_id is None else str(doc_id)
    units = _units(text)
    h = hashlib.sha256(f"7:{name}".encode()).hexdigest()
    a, b = sorted(int(h[8 * i : 8 * i + 8], 16) % (len(units) + 1) for i in (0, 1))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if int(h[24:32], 16) % 100 < suffix_first:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _expected(doc_id, text):
    n, form, pre, mid, out = _brute(doc_id, text)
    return (doc_id, n, form, pre, mid, _sha(out), _sha(text or ""))


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_odd_rows_with_clashing_names_equal_brute_force(spark):
    got = m.contract_digests(odd_documents(spark)).collect()
    assert _sorted(got) == _sorted(_expected(r[0], r[1]) for r in odd_rows())


def test_tiny_pieces_many_lines_and_marks(spark):
    """Pieces of three bytes: marks and code points are cut everywhere."""
    rng = random.Random(5)
    texts = {i: "".join(rng.choice(["a", "é", "\n", "<", "P", "S>", "😀", " "]) for _ in range(rng.randint(0, 60))) for i in range(300)}
    texts |= {900: "x<P>y", 901: "<M", 902: "\n\n\n", 903: "<S\n<P\n<M\n", 904: "z" * 100}
    pieces = m.output_pieces(documents(spark, texts), m.Rates(piece_bytes=3))
    assert pieces.filter("length(piece) > 3").count() == 0
    got = m.digests(m.restored_pieces(pieces)).collect()
    assert _sorted(got) == _sorted(_expected(i, t) for i, t in texts.items())


def test_texts_and_round_trip(spark):
    texts = {i: prose(i, 40).replace(" the ", "\n") for i in range(50)} | {60: None, 61: "", 62: "no <S> change"}
    docs = documents(spark, texts)
    out = {r.doc_id: (r.form, r.text) for r in m.fill_in_middle(docs).collect()}
    assert out == {i: _brute(i, t)[1::3] for i, t in texts.items()}
    back = {r.doc_id: r.text for r in m.restored_texts(docs).collect()}
    assert back == {i: t or "" for i, t in texts.items()}


def test_rates(spark):
    docs = documents(spark, {i: f"a{i}\nb\nc" for i in range(200)})
    never = m.fill_in_middle(docs, m.Rates(transformed=0)).collect()
    assert {r.form for r in never} == {"plain"} and all(r.text.startswith("a") for r in never)
    half = [r.form for r in m.fill_in_middle(docs, m.Rates(transformed=50, suffix_first=0)).collect()]
    assert set(half) == {"plain", "psm"} and 60 < half.count("plain") < 140


def test_many_equal_rows_without_id(spark):
    row = (None, "one\ntwo\nthree\n", "en", "a", 3)
    docs = spark.createDataFrame([row] * 5_000, "doc_id long, text string, lang string, source string, n_chars long")
    got = m.contract_digests(docs.repartition(6))
    assert got.count() == 5_000
    assert [tuple(r) for r in got.distinct().collect()] == [_expected(None, row[1])]
    # Equal rows of a partition travel once.
    assert m.output_pieces(docs.repartition(6)).count() <= 6 * 6 * 10


def test_same_id_with_several_texts(spark):
    rows = [(1, "a\nb", "en", "a", 3), (1, "c\nd\n", "en", "a", 3), (1, "a\nb", "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = m.contract_digests(docs).collect()
    assert _sorted(got) == _sorted(_expected(r[0], r[1]) for r in rows)


def test_empty_table(spark):
    assert m.contract_digests(no_documents(spark)).collect() == []
    assert m.fill_in_middle(no_documents(spark)).collect() == []


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="a\n<PSM>é", max_size=30), st.integers(0, 10**6), st.integers(1, 7))
def test_streamed_reading_of_any_cut(text, doc_id, step):
    """Reading an output piece by piece finds the parts of the original."""
    form, pieces = m.parts_of(text.encode(), str(doc_id), m.Rates())
    output = b"".join(p for _, p in pieces)
    assert output.decode() == _brute(doc_id, text)[4] and form == _brute(doc_id, text)[1]
    reader, parts = m._Reader(form), [b"", b"", b""]
    for at in range(0, len(output), step):
        for part, data in reader.read(output[at : at + step]):
            parts[part] += data
    for part, data in reader.read(b"", last=True):
        parts[part] += data
    assert b"".join(parts).decode() == text
