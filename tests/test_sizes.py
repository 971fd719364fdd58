"""Plans on ledgers of which no table is small: what is few is handed to all tasks, and what is many is not dealt out for it."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F
from test_name_index import frame
from test_walk import ledger

from factledger import schema as S
from factledger.operators import resolve, search, semantic, walk


@pytest.fixture
def large(spark):
    """As if every table were beyond the size that the planner broadcasts."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, before)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_anchors_and_references_filter_facts_before_nodes_are_met(large):
    facts, nodes = ledger(large, 50, 5)
    anchors = large.createDataFrame([("link", 0.5)], "iri string, anchor_score double")
    assert "SortMergeJoin [iri" not in plan(semantic.resolved(facts, nodes, [], only=anchors))
    found = semantic.structural(anchors, facts, nodes, [])
    assert "SortMergeJoin [iri" not in plan(found) and plan(found).count("s_iri#") and " IN (" in plan(found)
    assert {r.iri for r in found.collect()} >= {"a000", "loop", "h0000000"}


def test_a_walk_reads_the_facts_it_answers_and_deals_out_none(large):
    facts, nodes = ledger(large, 50, 5)
    found = walk.around(facts, nodes, [], "start", depth=1)
    assert "SortMergeJoin [iri" not in plan(found)
    assert [r.iri for r in found.collect()] == ["a000", "a001", "a002", "a003", "a004", "loop", "link"]


def test_facts_of_one_property_are_not_sent_to_one_task(large):
    facts, nodes = ledger(large, 50, 5)
    assert "SortMergeJoin" not in plan(search.property_facts(facts, nodes, "p"))


def test_names_of_one_length_are_not_sent_to_one_task(large):
    nodes = frame(large, [{"iri": f"n{i}", "name": f"number {i}", "labels": ["Element"]} for i in range(20)])
    found = resolve.suggestions(nodes, [], ["n1"])
    assert "SortMergeJoin" not in plan(found) and found.count() == 3


def test_few_references_meet_nodes_that_are_not_dealt_out(large):
    facts, nodes = ledger(large, 50, 5)
    near = large.createDataFrame([("a", ["link", "a001", "gone"], [1.0], 9, 0.9)], f"{S.ACTIVATIONS}, similarity double")
    known = semantic.resolved(facts, nodes, [], only=semantic.references(near))
    assert "SortMergeJoin" not in plan(known)
    assert {(r.iri, r.s_iri, r.o_iri) for r in known.select("iri", "s_iri", "o_iri").collect()} == {("link", "start", "hub"), ("a001", "start", "near001")}


def test_hits_are_ranked_without_gathering_candidates(large, monkeypatch):
    facts, nodes = ledger(large, 50, 5)
    facts = facts.withColumn("fact_text", F.concat_ws(" ", "s_iri", "o_iri"))
    plans, real = [], search.pinned
    monkeypatch.setattr(search, "pinned", lambda df: plans.append(plan(df)) or real(df))
    direct = semantic.direct_evidence(search.recall_text(facts, nodes, [], "start near001", S.MAX_LIMIT))
    assert {r.iri: r.eligible for r in direct.collect()}["a001"] and "SortMergeJoin [iri" not in plans[0]


def test_a_bundle_reads_the_facts_of_its_hits(large):
    facts, _ = ledger(large, 50, 5)
    fused = large.createDataFrame([(f"a00{i}", 1.0 - i, True, True, i + 1) for i in range(4)] + [("link", 0.5, True, False, 5)], "iri string, fused double, is_direct boolean, eligible boolean, rank long")
    found = semantic.bundle(fused, facts)
    assert "SortMergeJoin" not in plan(found)
    assert [(r.iri, r.place) for r in found.orderBy("place").collect()] == [("a000", 1), ("a001", 2), ("a002", 3)]
