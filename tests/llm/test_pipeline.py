from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import line_dedup, packing, simhash
from ledgerloom.llm.common import table
from ledgerloom.operators.scale import stage

from .conftest import SMALL


def test_stages_follow_each_other(spark):
    docs = table(spark, SMALL, "documents")
    given = docs
    for name, work in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(work(spark, docs, SMALL))
        assert docs.columns == given.columns, name
        if name == "toxicity":
            labels = table(spark, SMALL, "labels")
            gone = before.join(docs, "doc_id", "left_anti").join(labels.where("toxic = 0"), "doc_id").count()
            assert gone <= 2
        elif name == "line_dedup":
            want = {r[0]: r[1] for r in line_dedup.drop_lines(before).select("row.doc_id", "kept_text").collect()}
            assert {r.doc_id: r.text or "" for r in docs.collect()} == want
        elif name == "simhash":
            names = simhash.near_duplicates(before).select("component_id").distinct()
            assert sorted(r[0] for r in names.collect()) == sorted(r.doc_id for r in docs.collect())
        else:
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    tokens = sum(len(packing.encoder().ids(r.text or "")) + 1 for r in docs.collect())
    assert pieces.agg(F.sum("length")).first()[0] == tokens
