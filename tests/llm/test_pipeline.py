"""Each stage against plain Python on what the stage before it kept, over the smallest tables."""

import re

import pytest
from test_decontam import brute as hits
from test_jaccard import brute as components
from test_quality_rules import brute as counts

import corpus_pipeline as cp
from linkloom.functions.scratch import cut
from linkloom.llm.common import documents, table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = documents(spark, FOLDER), []
    for name, stage in cp.STAGES:
        after = cut(stage(spark, docs, FOLDER), name)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_schema_and_order(stages):
    names = ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii_pseudonyms", "best_fit_packing"]
    assert [n for n, _ in cp.STAGES] == names
    assert all(after.columns == before.columns and after.dtypes == before.dtypes for before, after in stages[:-1])


def test_quality(spark, stages):
    before, after = map(rows, stages[0])
    assert set(after) <= {i for i, t in before.items() if not counts(t)[-1]}
    good = {r.doc_id for r in table(spark, FOLDER, "labels").where("quality = 1").collect()}
    gone = {i for i in good & set(before) if i not in after and not counts(before[i])[-1]}
    assert len(gone) <= 0.05 * len(good)


def test_near_copies(stages):
    before, after = map(rows, stages[1])
    found = [eval(x) for x in components(sorted(before.items()), 5, 4, 5)]
    assert set(after) == {c for _, _, c in found}


def test_benchmark(spark, stages):
    before, after = map(rows, stages[2])
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    assert set(after) == {eval(x)[0] for x in hits(before.items(), items) if x.endswith("False)")}


def test_private_values(stages):
    before, after = map(rows, stages[3])
    assert set(after) == set(before)
    mails = {m for t in before.values() for m in re.findall(r"[\w.]+@[\w.]+\w", t)}
    assert not any(m in t for m in mails for t in after.values())


def test_run(spark, stages):
    got, want = cp.run(spark, FOLDER), stages[4][1]
    assert got.columns == want.columns and got.count() == want.count()
    assert {r.doc_id for r in got.collect()} == set(rows(stages[3][1]))
