"""The corpus job against its stages done plainly."""

import re
import uuid

import pytest

import corpus_pipeline
from plumbline.llm import language_id

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{uuid.uuid4().hex}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs.toPandas())
    return found


def test_stages_keep_columns_and_rows_of_their_input(steps):
    for before, after in zip(steps[:-2], steps[1:-1]):
        assert list(after.columns) == list(before.columns)
        merged = after.merge(before, how="left", indicator=True)
        assert (merged["_merge"] == "both").all()


def test_language_keeps_documents_it_is_sure_of(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labeller = language_id.Labeller(language_id.train(docs))
    rows = docs.collect()
    sure = {r.doc_id for r, (lang, _, each) in zip(rows, labeller.label([r.text for r in rows]))
            if lang != "und" and each >= language_id.LEAST_SURE}
    assert set(steps[1].doc_id) == sure and len(sure) > 0.9 * len(rows)


def test_exact_copies_leave_the_largest_identifier(steps):
    wanted = steps[1].fillna({"text": ""}).groupby("text").doc_id.max()
    assert set(steps[2].doc_id) == set(wanted)


def test_near_duplicates_leave_the_smallest_of_a_component(steps):
    sets = {}
    for r in steps[2].itertuples():
        w = "".join(c.lower() if c.isascii() else c for c in r.text or "").encode().split()
        sets[r.doc_id] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    part = {i: i for i in ids}

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                part[y] = x
    assert set(steps[3].doc_id) == {i for i in ids if find(i) == i}


def test_leaks_go_and_clean_documents_stay(spark, steps):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [cut(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k:k + 4]) for w in items for k in range(len(w) - 3)}
    kept = set(steps[4].doc_id)
    for r in steps[3].itertuples():
        words = cut(r.text)
        whole = {tuple(words[k:k + 13]) for k in range(len(words) - 12)}
        if any(tuple(w[k:k + 13]) in whole for w in items for k in range(len(w) - 12)):
            assert r.doc_id not in kept
        elif not any(tuple(words[k:k + 4]) in grams for k in range(len(words) - 3)):
            assert r.doc_id in kept


def test_packing_takes_all_that_is_left(steps):
    last, packed = steps[-2], steps[-1]
    assert set(packed.doc_id) == set(last.doc_id)
    per_doc = packed.groupby("doc_id").agg(n=("length", "sum"), t=("doc_tokens", "first"))
    assert (per_doc.n == per_doc.t).all()


def test_run_equals_its_stages(spark, steps):
    found = corpus_pipeline.run(spark, SF).toPandas()
    columns = ["doc_id", "doc_tokens"]
    assert found[columns].drop_duplicates().sort_values(columns).values.tolist() == \
        steps[-1][columns].drop_duplicates().sort_values(columns).values.tolist()
