"""Stages hand through all columns, whatever their names, of tables with repeated rows and rows without ids."""

import pytest
from pyspark.sql import functions as F

from factledger.llm import mixing, near_dedup, quality_classifier, simhash, substring_dedup
from factledger.llm.common import count_words, with_ids

CLASH = "row_id long, kept_text string, score string, mix_size long, mix_copies string, cut_text string, doc string, key int, fp long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text number {i} of some words and more", "s") for i in range(30)] + [(3, "text number 3 of some words and more", "s")] * 2 + [(None, None, None), (None, "", "s")]
    return spark.createDataFrame([(*r, 100 + k, f"k{k}", "x", k, "y", "z", "d", 1, 2) for k, r in enumerate(rows)], f"doc_id long, text string, source string, {CLASH}").cache()


def test_stages_keep_columns(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    whole = set(map(tuple, docs.collect()))
    for out in (quality_classifier.accepted(docs, labels, 0.0), substring_dedup.cut(docs), simhash.one_each(docs), near_dedup.one_each(docs), mixing.mix(docs, count_words(F.col("text"))).select("doc.*")):
        assert out.columns == docs.columns
        assert set(map(tuple, out.collect())) <= whole
    assert substring_dedup.cut(docs).count() == docs.count()


def test_numbers_are_the_same_in_every_run(docs):
    one, two = (with_ids(d, "n").select("n", "doc_id", "text", "key").collect() for d in (docs, docs.repartition(7)))
    assert sorted(r.n for r in one) == list(range(docs.count()))
    assert {r.n: tuple(r) for r in one} == {r.n: tuple(r) for r in two}
