"""Sweep join and ordered folds against brute force, and on one family of a million facts."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factledger import schema as S
from factledger.operators import resolve, sweep

DAY = timedelta(days=1)
START = datetime(2020, 1, 1)
INTERVALS = "iri string, s string, o string, eff_from timestamp_ntz, eff_to timestamp_ntz"


def meets(x, y):
    return (x[3] is None or y[4] is None or x[3] < y[4]) and (y[3] is None or x[4] is None or y[3] < x[4])


def intervals(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randrange(12)
        b = a + rng.randrange(1, 6)
        out.append((f"f{i:04d}", rng.choice("ab" * 5 + "c"), rng.choice("xyz"), None if rng.random() < 0.15 else START + a * DAY, None if rng.random() < 0.15 else START + b * DAY))
    return out


def test_overlaps(spark):
    rows = intervals(160)
    df = spark.createDataFrame(rows, INTERVALS).repartition(5)
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and meets(x, y)}
    got = [(r.iri, r.other_iri, r.o, r.other_o) for r in sweep.overlapping(df, ["s"], ["o"]).collect()]
    assert len(got) == len(want) and {tuple(sorted(g[:2])) for g in got} == want
    objects = {r[0]: r[2] for r in rows}
    assert all((g[2], g[3]) == (objects[g[0]], objects[g[1]]) for g in got)
    each = defaultdict(int)
    for a, b in want:
        each[a] += 1
        each[b] += 1
    assert {r.iri: r.n for r in sweep.overlaps(df, ["s"]).collect()} == {r[0]: each[r[0]] for r in rows}
    empty = spark.createDataFrame([], INTERVALS)
    assert sweep.overlapping(empty, ["s"], ["o"]).collect() == [] and sweep.overlaps(empty, ["s"]).collect() == []


def test_a_family_of_a_million(spark):
    """Each fact overlaps the one before and the one behind it: the join has as many rows as pairs, over many partitions."""
    n = 1_000_000
    at = F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("1950-01-01 00:00:00").cast("timestamp_ntz"))
    df = spark.range(n).select(F.col("id").cast("string").alias("iri"), F.lit("one").alias("s"), F.lit("x").alias("o"), at.alias("eff_from"), F.timestamp_add("MINUTE", F.lit(90), at).alias("eff_to"))
    pairs = sweep.overlapping(df, ["s"], ["o"])
    assert pairs.agg(F.count("iri"), F.max(F.abs(F.col("iri").cast("long") - F.col("other_iri").cast("long")))).first() == (n - 1, 1)


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_saturating_folds(spark, monkeypatch, block):
    monkeypatch.setattr(sweep, "BLOCK", block)
    top, low = S.LONG_MAX, S.LONG_MIN
    rng = random.Random(block)
    groups = {"max": [top, 7], "min": [low, -1, 5], "small": [-3, 1], "turn": [top, top, low, low, 3], "back": [low, 1, top, top, -2, low]}
    groups |= {f"r{i}": [rng.choice([top, low, 1, -1, 10**18, -(10**18), 0]) for _ in range(rng.randint(1, 25))] for i in range(40)}
    rows = [(k, f"i{i:03d}", w) for k, ws in groups.items() for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "k string, i string, w long").repartition(4)
    found = sweep.folded(df, ["k"], "i", "w", {"n": F.count(F.lit(1))}, {"n": F.sum("n")})
    got = {r.k: (r.w, r.n) for r in found.select("k", sweep.added(F.col("step"), F.lit(0)).alias("w"), "n").collect()}
    want = {}
    for k, ws in groups.items():
        total = 0
        for w in ws:
            total = max(low, min(top, total + w))
        want[k] = (total, len(ws))
    assert got == want


FACTS = f"{S.FACTS}"


def facts(spark, rows):
    names = [x.strip().split(" ", 1)[0] for x in FACTS.split(", ")]
    full = [{"type": "ASSERTS", "property_iri": "p", "s_iri": "s", "layers": [], "weight": 0, "eff_qualified": False, **r} for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], FACTS)


def test_consolidate(spark):
    """Weights saturate, layers unite unless one is global, and no array of members is made."""
    df = facts(spark, [
        {"iri": "rel-a", "o_iri": "o1", "layers": ["l1"], "weight": S.LONG_MAX, "episode_id": "e1"}, {"iri": "rel-b", "o_iri": "o1", "layers": ["l2"], "weight": 7, "episode_id": "e2"},
        {"iri": "rel-d", "o_iri": "o2", "layers": ["l1"], "weight": 1}, {"iri": "rel-c", "o_iri": "o2", "weight": -3},
        {"iri": "rel-e", "o_iri": "o2", "weight": 9, "valid_to": START},
    ])
    got = resolve.consolidate(df)
    assert sorted((r.iri, r.layers, r.weight, r.members, r.provenance_episode_ids) for r in got.collect()) == [("rel-a", ["l1", "l2"], S.LONG_MAX, 2, ["e1", "e2"]), ("rel-c", [], -2, 2, [])]
    assert {(r.iri, r.into) for r in resolve.survivors(df, got).collect()} == {("rel-a", "rel-a"), ("rel-b", "rel-a"), ("rel-c", "rel-c"), ("rel-d", "rel-c")}
