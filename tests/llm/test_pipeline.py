"""Every stage on the small tables, held against plain Python."""

import re

import pytest

import corpus_pipeline as pipeline
from spantail.llm import toxicity
from spantail.llm.common import table, written

from .test_nearcopies import least_of
from .test_text import base_spans, brute_hits


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = [docs]
    for name, stage in pipeline.STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(stages):
    assert [df.columns for df in stages[:-1]] == [stages[0].columns] * 5


def test_toxic_documents_go(spark, sf_dir, stages):
    model = toxicity.learn(stages[0], table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(stages[0], model, keep=["doc_id"])
    assert ids(stages[1]) == ids(scored.where("score < 0.5"))


def test_one_of_each_group(stages):
    """Linked at five words and a similarity of 0.8."""
    assert ids(stages[2]) == least_of([(r.doc_id, r.text) for r in stages[1].collect()])


def test_benchmarks_are_cut(spark, sf_dir, stages):
    items = [(str(r.item_id), r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    hits = dict(zip(before, brute_hits(before.values(), items, 10)))
    assert any(h for _, h, _ in hits.values())
    for d, (_, hit, _) in hits.items():
        if not hit:
            assert after[d].text == before[d]
        elif d in after:
            assert after[d].text != before[d] and after[d].n_chars == len(after[d].text)
    assert all(h == 0 for _, h, _ in brute_hits([r.text for r in after.values()], items, 10))


def test_secrets_are_replaced(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    after = {r.doc_id: r.text for r in stages[4].collect()}
    assert before.keys() == after.keys()
    for d, text in before.items():
        assert base_spans(after[d]) == [] if base_spans(text) else after[d] == text or re.search(r"\[SECRET\]", after[d])


def test_all_is_packed(spark, sf_dir, stages):
    got = stages[5].collect()
    assert {r.doc_id for r in got} == ids(stages[4])
    size = {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert all(size[r.doc_id] == r.doc_tokens for r in got)
    assert pipeline.run(spark, sf_dir).count() == len(got)


def test_odd_rows_and_clashing_names(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, items string, Score int, fp string, spans int, base string, `a.b` int"
    rows = [(1, None, None, None, None, "i", 1, "f", 2, "b", 3), (2, "", "en", "s", 0, "i", 1, "f", 2, "b", 3), (None, "one two three four", "en", "s", 18, "i", 1, "f", 2, "b", 3)]
    rows += [(3, "alpha beta gamma delta", "en", "s", 22, "i", 1, "f", 2, "b", 3)] * 2 + [(4, "word " * 50_000, "en", "s", 250_000, "x", 5, None, None, None, None)]
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(rows, schema)
        for df, least in ((docs, 3), (docs.limit(0), 0)):
            out = stage(spark, df, sf_dir)
            assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
            got = out.collect()
            assert len(got) >= least and all(tuple(r)[5:] in {r[5:] for r in rows} for r in got), name
    assert pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, schema), sf_dir).agg({"length": "sum"}).first()[0] > 50_000
