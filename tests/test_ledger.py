"""The facade on a small stored ledger: scenarios with known answers."""

from datetime import datetime, timedelta
from itertools import count

import pytest

from factledger.api import FactLedger, sat
from factledger.errors import ConcurrentMutation, InvalidInput, PreconditionFailed
from factledger.operators.semantic import FixtureProvider
from factledger.sources.store import Store


@pytest.fixture(scope="module")
def ledger(spark, tmp_path_factory):
    ids, ticks = count(), count()
    return FactLedger(spark, f"file://{tmp_path_factory.mktemp('ledger')}/led", FixtureProvider(), clock=lambda: datetime(2024, 1, 1) + timedelta(seconds=next(ticks)), new_id=lambda: f"id{next(ids):04d}")


def fact(s, p, o, **more):
    return {"s": {"name": s}, "p": p, "o": {"kind": "literal", "value": o}, **more}


def values(df):
    return sorted(r["o_value"] for r in df.collect() if r["o_value"])


def test_state_as_of(ledger):
    ledger.write([fact("Ada", "livesIn", "Rome", effective={"from": "2020-01-01T00:00:00Z", "to": "2022-01-01T00:00:00Z"}), fact("Ada", "livesIn", "Lisbon", effective={"from": "2022-01-01T00:00:00Z", "to": "2024-01-01T00:00:00Z"}), fact("Ada", "livesIn", "Unknown")], [])
    assert values(ledger.visible([], "2021-12-31T23:59:59Z")) == ["Rome"]
    assert values(ledger.visible([], "2022-01-01T00:00:00Z")) == ["Lisbon"]
    assert values(ledger.visible([])) == ["Lisbon", "Rome", "Unknown"]


def test_noop_layers_and_withdraw(ledger):
    first = ledger.write([fact("Bo", "likes", "tea")], ["a"])
    version = ledger.store.version()
    again = ledger.write([fact("Bo", "likes", "tea")], ["a"])
    assert again["episode"] is None and ledger.store.version() == version
    ledger.write([fact("Bo", "likes", "tea")], ["b"])
    iri = first["facts"][0]["iri"]
    row = ledger.table("facts").filter(f"iri = '{iri}'").first()
    assert row["layers"] == ["a", "b"]
    assert ledger.withdraw(["a"], subject="kg:element/bo")["changed"] == 1
    row = ledger.table("facts").filter(f"iri = '{iri}'").first()
    assert row["layers"] == ["b"] and row["valid_to"] is None
    ledger.withdraw(["b"], target=iri)
    row = ledger.table("facts").filter(f"iri = '{iri}'").first()
    assert row["layers"] == ["b"] and row["valid_to"] is not None


def test_revise_and_history(ledger):
    made = ledger.write([fact("Cy", "worksAt", "mill")], [])["facts"][0]["iri"]
    done = ledger.revise([], made, {"kind": "literal", "value": "farm"})
    assert done["changed"] and not ledger.revise([], done["fact"], {"kind": "literal", "value": "farm"})["changed"]
    found = ledger.recall([], history="kg:element/cy")
    assert [(r["o_value"], r["current"]) for r in found["facts"].orderBy("rank").collect()] == [("farm", True), ("mill", False)]
    assert found["revisions"].count() == 1
    assert ledger.recall([], history=done["fact"])["facts"].count() == 2


def test_judge_and_place(ledger):
    iri = ledger.write([fact("Di", "plays", "chess")], ["a"])["facts"][0]["iri"]
    assert ledger.judge(["a"], [{"target": iri, "mode": "strengthen"}])["weights"][iri] == 1
    with pytest.raises(PreconditionFailed):
        ledger.judge(["c"], [{"target": iri, "mode": "weaken"}])
    with pytest.raises(PreconditionFailed):
        ledger.place(["a"], [{"target": iri, "add": ["b"]}])
    literal = ledger.table("facts").filter(f"iri = '{iri}'").first()["o_iri"]
    every = [{"target": x, "add": ["b"]} for x in (iri, "kg:element/di", literal)]
    assert ledger.place(["a"], every)["layers"][iri] == ["a", "b"]


def test_unify_and_suggestions(ledger):
    made = ledger.write([{"s": {"name": "Marlin-fish"}, "p": "swimsIn", "o": {"name": "Sea"}}, {"s": {"name": "Marlin-fishs"}, "p": "swimsIn", "o": {"name": "Sea"}}], [])
    found = ledger.suggestions([], made["created"]).collect()
    assert ("kg:element/marlin-fishs", "kg:element/marlin-fish") in [(r["source"], r["target"]) for r in found]
    ledger.unify("kg:element/marlin-fishs", "kg:element/marlin-fish")
    assert ledger.table("nodes").filter("iri = 'kg:element/marlin-fishs'").count() == 0
    assert ledger.recall([], iris=["kg:element/marlin-fish"], hops=1)["facts"].count() == 1


def test_search_and_learning(ledger):
    ledger.write([fact("Boat", "circledBy", "great marlin"), fact("Boat", "paintedIn", "green")], [])
    hits = ledger.recall([], text="marlin circles beneath the boat")["facts"]
    assert "great marlin" in values(hits)
    first = ledger.recall_semantic([], "great marlin")["facts"].orderBy("rank").collect()
    assert first and ledger.table("activations").count() == 1
    assert len(ledger.table("activations").first()["result_refs"]) <= 3
    ledger.recall_semantic([], "great marlin")
    assert ledger.table("activations").count() == 1  # it converges
    assert ledger.recall([], around="kg:element/boat")["facts"].count() == 2


def test_refusals(ledger):
    for bad in ({"text": "a", "iris": ["b"]}, {"labels": []}, {"text": "a", "limit": 0}, {"around": "x", "depth": 4}):
        with pytest.raises(InvalidInput):
            ledger.recall([], **bad)
    with pytest.raises(InvalidInput):
        ledger.write([], [])
    with pytest.raises(InvalidInput):
        ledger.write([fact("x", "p", "y", effective={"from": "2020-01-01"})], [])
    with pytest.raises(PreconditionFailed):
        ledger.unify("kg:class/Element", "kg:class/Other")
    assert sat((1 << 63) - 1, 7) == (1 << 63) - 1


def test_one_writer_wins(ledger):
    store = Store(ledger.spark, ledger.store.path)
    base, some = store.version(), ledger.table("nodes").limit(1)
    store.publish(base, {"nodes": some})
    with pytest.raises(ConcurrentMutation):
        store.publish(base, {"nodes": some})
