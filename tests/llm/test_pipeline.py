"""The pipeline stages against brute force on a small corpus, each on its own input."""

import math

import pytest

import corpus_pipeline as p
from tests.llm.cases import DOCUMENTS, prose
from tests.llm.test_near_dup import _sets
from titlegauge.llm.common import let_workers_import, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows():
    rows = [(i, prose(i, 50 + i % 60), "en", f"s{i % 4}", None) for i in range(200)]
    rows += [(500 + i, prose(i, 50 + i % 60) + (" vilewort nastything" if i % 2 else ""), "en", "s0", 1) for i in range(200, 300)]
    rows += [(1_000 + i, prose(i, 50 + i % 60), "en", "s1", 1) for i in range(0, 30)]  # copies
    rows += [(1_100 + i, prose(i, 50 + i % 60) + " tail", "en", "s1", 1) for i in range(30, 60)]  # near copies
    rows += [(1_200 + i, prose(9_000 + i, 80) + " " + prose(5_000, 30) + " x", "en", "s2", 1) for i in range(4)]  # leaks
    rows += [(1_300, prose(9_100, 30) + " mail me at a.b@c.example.com now", "en", "s3", 1)]
    rows += [(1_400, None, None, None, None), (1_401, "", "en", "s3", 0), (None, prose(9_200, 30), "en", "s3", 0)]
    rows += [(1_402, prose(9_300, 40), "en", "s3", 0)] * 2
    return rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    let_workers_import(spark)
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(_rows(), DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    labels = [(500 + i, 1, i % 2) for i in range(200, 300)] + [(i, 1, 0) for i in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(5_000, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {"input": docs}
    for name, stage in p.STAGES:
        docs = written(stage(spark, docs, folder))
        out[name] = docs
    return out


def _ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_columns(stages):
    for name in list(stages)[:-1]:
        assert stages[name].columns == COLUMNS
    assert stages["mix_sources"].columns == [*COLUMNS, "copies"]


def test_toxic_documents_go_and_clean_ones_stay(stages):
    toxic = {500 + i for i in range(201, 300, 2)}
    assert _ids(stages["toxicity"]) == sorted((r[0] for r in _rows() if r[0] not in toxic), key=str)


def test_one_document_of_each_group_stays(stages):
    before = {r.doc_id: r.text for r in stages["toxicity"].collect() if r.doc_id is not None}
    kept, sets = set(), {i: _sets(t, 5) for i, t in before.items()}
    root = {i: i for i in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(before)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    kept = [i for i in ids if find(i) == i]
    assert _ids(stages["near_duplicates"]) == sorted([*kept, None], key=str)


def test_documents_with_benchmark_items_go(stages):
    before = _ids(stages["near_duplicates"])
    assert _ids(stages["decontamination"]) == [i for i in before if i is None or not 1_200 <= i < 1_300]


def test_personal_data_is_masked_and_the_rest_unchanged(stages):
    before = {r.doc_id: r for r in stages["decontamination"].collect()}
    after = {r.doc_id: r for r in stages["personal_data"].collect()}
    assert before.keys() == after.keys()
    assert after[1_300].text.endswith("mail me at [EMAIL] now")
    for i, row in after.items():
        if i != 1_300:
            assert row.text == before[i].text
        assert row.n_chars == (None if before[i].n_chars is None or row.text is None and before[i].n_chars is None else len(row.text or "") if row.text is not None else before[i].n_chars)


def test_the_mix_reaches_its_budget(stages):
    size = lambda t: len((t or "").split())
    before = {r.doc_id: r for r in stages["personal_data"].collect()}
    taken = stages["mix_sources"].collect()
    assert {r.doc_id for r in taken} <= set(before) and all(r.copies in (1, 2) for r in taken)
    words = sum(size(r.text) * r.copies for r in taken if r.doc_id is not None)
    total = sum(size(r.text) for i, r in before.items() if i is not None)
    assert 1.5 * total - 2 * max(size(r.text) for r in before.values()) <= words <= math.floor(1.5 * total)


def _run(spark, folder, docs):
    for _, stage in p.STAGES:
        docs = written(stage(spark, docs, folder))
    return docs


@pytest.fixture
def folder(spark, tmp_path):
    let_workers_import(spark)
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(5_000, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_clashing_names_pass_through_every_stage(spark, folder):
    rows = [(i, prose(i, 30), "s", 9, 8, i, "k", 0.5, True) for i in range(12)] + [(3, prose(3, 30), "s", 9, 8, 3, "k", 0.5, True)]
    schema = "doc_id long, text string, source string, copies int, mix_id long, gone_id long, size string, score double, kept boolean"
    got = _run(spark, folder, spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "source", "mix_id", "gone_id", "size", "score", "kept", "copies"]
    taken = got.collect()
    assert taken and all(r.copies in (1, 2) and r.gone_id == r.doc_id and r.mix_id == 8 for r in taken)
    again = _run(spark, folder, got)
    assert again.columns == got.columns and {r.doc_id for r in again.collect()} <= {r.doc_id for r in taken}


def test_an_empty_table_passes_as_an_empty_table(spark, folder):
    got = _run(spark, folder, spark.createDataFrame([], DOCUMENTS))
    assert got.columns == [*COLUMNS, "copies"] and got.count() == 0
