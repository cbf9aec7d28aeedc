"""The registered queries against their SQL, and the pipeline stage by stage."""

import os

import pytest
from pyspark.sql import functions as F

from docreg.llm.base import fold, table
from docreg.llm.queries import QUERIES
from docreg.llm.quality import score_quality
from docreg.llm.toxicity import score_toxicity
from test_groups_and_mix import plain_groups, plain_hits, plain_targets
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    query, sql = QUERIES[name]
    ok, note = compare(query(spark, SF), sql, con)
    assert ok, note


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[0])


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    made = {}
    for name, stage in p.STAGES:
        before = docs
        docs = p.reliable(stage(spark, docs, SF))
        made[name] = (before, docs)
        if name != "mix":
            assert docs.columns == before.columns
            assert set(rows_of(docs)) <= set(rows_of(before))
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())

    before, after = made["quality"]
    scored = score_quality(before, labels, fold(F.col("doc_id"), 3) != 1)
    assert ids(after) == ids(scored.where("score >= 0.5"))
    before, after = made["toxicity"]
    scored = score_toxicity(before, labels, fold(F.col("doc_id"), 5) != 0)
    assert ids(after) == ids(scored.where("score < 0.5"))
    before, after = made["near_dedup"]
    groups, _ = plain_groups([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert ids(after) == sorted(set(groups.values()))
    before, after = made["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert ids(after) == sorted(r.doc_id for r in before.collect() if not plain_hits(r.text, items)[1])
    before, after = made["mix"]
    rows = before.collect()
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(len((r.text or "").encode().split()) for r in rows if r.source == s) for s in sources}
    want = plain_targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)})
    mixed = {r.doc_id: r for r in after.collect()}
    assert sorted(mixed) == sorted(r.doc_id for r in rows)
    for s in sources:
        own = [mixed[r.doc_id] for r in rows if r.source == s]
        assert all(abs(m.target - want[s]) < 1e-6 * (1 + want[s]) and m.source_size == sizes[s] and m.taken <= 2 * m.size for m in own)
        assert sum(m.taken for m in own) == int(own[0].target)
    assert rows_of(p.run(spark, SF)) == rows_of(docs)
