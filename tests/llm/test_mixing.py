"""Pareto sampling: inclusion by size, and a mixture that comes near its target for copies and rows without ids too."""

import random

import pytest
from pyspark.sql import functions as F

from factledger.llm import mixing


def test_inclusion_grows_with_size_as_planned(spark):
    sizes = [1 + (7 * i) % 60 for i in range(240)]
    rows = spark.createDataFrame([(i, None if i % 2 else "a", n) for i, n in enumerate(sizes)], "mix_row long, mix_source string, mix_size long").cache()
    count, runs = [0] * len(sizes), 12
    for seed in range(runs):
        aim = mixing.plan(rows, (3, 1), 0.5, 2, f"s{seed}")
        for r in mixing.copies(rows, aim, f"s{seed}").collect():
            count[r.mix_row] += r.mix_copies
    factor = {r.mix_source: r.mix_factor for r in aim.collect()}
    for source in ("a", None):
        own = [i for i in range(len(sizes)) if (i % 2 == 0) == (source == "a")]
        total = sum(sizes[i] for i in own)
        wanted = total / 2 * 2 * (0.75 if source == "a" else 0.25)
        expected = {i: min(1, factor[source] * sizes[i]) for i in own}
        assert sum(expected[i] * sizes[i] for i in own) == pytest.approx(0.5 * sum(sizes) * (0.75 if source == "a" else 0.25), rel=1e-9), wanted
        for low, high in ((1, 20), (21, 40), (41, 60)):
            some = [i for i in own if low <= sizes[i] <= high]
            plan, got = sum(expected[i] for i in some) / len(some), sum(count[i] for i in some) / runs / len(some)
            assert abs(plan - got) < 0.1, (source, low, plan, got)


def test_copies_and_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "w " * 10, "a")] * 50 + [(7, "v " * 20, "b")] * 6 + [(8, "", "c"), (None, None, None)], "doc_id long, text string, source string")
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != ""))
    rows = mixing.mix(docs, size).select("doc.source", "mix_size", "mix_target", "mix_copies").collect()
    assert len(rows) == 58
    for source, step in (("a", 10), ("b", 20)):
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.mix_size * r.mix_copies for r in own) - own[0].mix_target) <= step / 2
    again = mixing.mix(docs.repartition(3), size).groupBy("doc.source", "mix_copies").count().collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.mix(docs, size).groupBy("doc.source", "mix_copies").count().collect()))


def test_a_hot_source_among_random_sizes(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, i % 10 and "hot", rng.choice([0, 1, 5, 40, 700])) for i in range(3000)], "mix_row long, mix_source string, mix_size long")
    aim = mixing.plan(docs, (1,), 0.9, 2, "x")
    got = mixing.copies(docs, aim, "x").groupBy("mix_source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("n"), F.first("mix_target").alias("t")).collect()
    assert all(abs(r.n - r.t) <= 350 for r in got)
