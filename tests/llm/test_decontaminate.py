import re

from pyspark.sql import functions as F

from tests.llm.cases import documents, no_documents, odd_documents, prose
from titlegauge.llm import decontaminate as m

ITEMS = "item_id long, text string"


def _words(text):
    return re.findall(r"[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", (text or "").lower())


def _grams(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def _brute(texts, items):
    out = set()
    for item, text in items:
        words = _words(text)
        k = min(5, len(words))
        own = _grams(words, k) if k else set()
        for doc, body in texts.items():
            shared = len(own & _grams(_words(body), k)) if own else 0
            if own and shared >= 0.8 * len(own):
                out.add((doc, item, len(own), shared))
    return out


def _case():
    items = [(i, prose(900 + i, 8 + 3 * i)) for i in range(14)] + [(50, "two words"), (51, None), (52, ""), (53, "?!")]
    texts = {i: prose(i, 200) for i in range(30)}
    for i, text in items[:14]:
        words = text.split()
        texts[100 + i] = prose(i, 4_000) + " " + text + " " + prose(i + 1, 4_000)
        texts[200 + i] = prose(i, 30) + " (" + ", ".join(words).upper() + ")!"
        texts[300 + i] = " ".join(words[:-1]) + " " + prose(i, 30)
        texts[400 + i] = " ".join(words[: len(words) // 2]) + " " + prose(i, 30)
    texts[500] = "has two words inside"
    return texts, items


def test_equals_brute_force(spark):
    texts, items = _case()
    got = m.contaminated_pairs(documents(spark, texts), spark.createDataFrame(items, ITEMS))
    rows = got.collect()
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in rows} == _brute(texts, items)
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})


def test_odd_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, prose(1, 20)), (1, prose(1, 20)), (None, prose(5, 20)), (2, None)], ITEMS)
    empty = spark.createDataFrame([], ITEMS)
    got = {(r.doc_id, r.item_id) for r in m.contaminated_pairs(odd_documents(spark), items).collect()}
    assert got == {(1, 1), (2, 1), (9, 1), (9, None)}
    assert m.contaminated_pairs(odd_documents(spark), empty).count() == 0
    assert m.contaminated_pairs(no_documents(spark), items).count() == 0


def test_a_sketch_always_meets_a_contained_item(spark):
    sizes = spark.range(1, 2_000).select("id", m._sketch_size(F.col("id"), 0.8).alias("size"))
    for r in sizes.collect():
        allowed = r.id - -(-8 * r.id // 10)
        assert allowed < r.size <= r.id


def test_a_full_filter_gives_the_same_pairs(spark, monkeypatch):
    texts, items = _case()
    monkeypatch.setattr(m, "FILTER_BITS", 64)
    rows = m.contaminated_pairs(documents(spark, texts), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in rows} == _brute(texts, items)


def test_texts_that_share_an_id_are_searched_apart(spark):
    item = prose(1, 40)
    halves = [(None, " ".join(item.split()[:22])), (None, " ".join(item.split()[18:])), (3, item), (3, "no " + item)]
    docs = spark.createDataFrame(halves, "doc_id long, text string")
    rows = m.contaminated_pairs(docs, spark.createDataFrame([(7, item)], ITEMS)).collect()
    assert [(r.doc_id, r.item_id, r.containment) for r in rows] == [(3, 7, 1.0)]
