"""Nested answers of every selector, concise answers of changes, and changes with rows before and after."""

import pytest
from pyspark.sql import functions as F

from factledger.api import FactLedger
from factledger.errors import InvalidInput
from factledger.operators.semantic import FixtureProvider
from factledger.streaming import feed


@pytest.fixture(scope="module")
def ledger(spark, tmp_path_factory):
    led = FactLedger(spark, f"file://{tmp_path_factory.mktemp('answers')}/led", FixtureProvider())
    led.write([{"s": {"name": "Ann"}, "p": "knows", "o": {"name": "Bea"}}, {"s": {"name": "Cid"}, "p": "knows", "o": {"name": "Bea"}}, {"s": {"name": "Cid"}, "p": "likes", "o": {"kind": "literal", "value": "tea"}}], ["a"])
    return led


def test_around_has_paths_along_its_facts_and_all_nodes(ledger):
    got = ledger.answer(["a"], around="kg:element/ann", depth=3)
    assert [f["p"] for f in got["facts"]] == ["knows", "knows", "likes"] and got["mode"] == "around" and not got["truncated"]
    assert [len(x["edges"]) for x in got["paths"]] == [1, 2, 3]
    back = got["paths"][1]["edges"][1]
    assert (back["from"], back["to"]) == ("kg:element/cid", "kg:element/bea")  # as it is stored, not as it is walked
    assert [n["iri"] for n in got["nodes"]] == sorted(n["iri"] for n in got["nodes"]) and len(got["nodes"]) == 4
    short = ledger.answer(["a"], 2, True, around="kg:element/ann", depth=3)
    assert short["truncated"] and "nodes" not in short and short["paths"][1]["edges"] == [e["iri"] for e in got["paths"][1]["edges"]]
    none = ledger.answer(["a"], around="kg:element/nobody")
    assert none["facts"] == none["nodes"] == none["paths"] == []


def test_iris_and_catalog(ledger):
    got = ledger.answer(["a"], iris=["kg:element/bea", "kg:element/nobody"], hops=1)
    assert [(x["found"], len(x["facts"])) for x in got["lookups"]] == [(True, 2), (False, 0)] and len(got["facts"]) == 2
    short = ledger.answer(["a"], concise=True, iris=["kg:element/bea"], hops=1)
    assert short["facts"] == [] and len(short["lookups"][0]["facts"]) == 2 and short["lookups"][0]["node"] == {"iri": "kg:element/bea", "name": "Bea"}
    listed = ledger.answer([], 2, True, labels=["Class"])
    assert len(listed["nodes"]) == 2 and listed["truncated"]
    assert ledger.answer(["a"], text="tea")["facts"][0]["p"] == "likes"


def test_arguments_that_do_not_go_together(ledger):
    for asked in ({"text": "tea", "depth": 2}, {"labels": ["Element"], "p": ["knows"]}, {"around": "kg:element/ann", "hops": 1}, {"history": "kg:element/ann", "effective_at": "2020-01-01T00:00:00Z"}, {"labels": ["Class"], "effective_at": "2020-01-01T00:00:00Z"}, {"around": "kg:relationship/x"}, {"iris": ["no iri"]}, {}, {"text": "a", "around": "kg:element/ann"}):
        with pytest.raises(InvalidInput):
            ledger.answer(["a"], **asked)


def test_changes_answer_whole_and_short(spark, tmp_path):
    led = FactLedger(spark, f"file://{tmp_path}/led")
    made = led.change("write", [{"s": {"name": "Dov"}, "p": "owns", "o": {"kind": "literal", "value": "boat"}}], ["a"])
    iri = made["facts"][0]["target"]["iri"]
    assert made["ok"] and not made["noop"] and made["facts"] == [{"target": {"kind": "fact", "iri": iri}, "noop": False}] and "suggestions" not in made
    again = led.change("write", [{"s": {"name": "Dov"}, "p": "owns", "o": {"kind": "literal", "value": "boat"}}], ["a"])
    assert again["noop"] and again["facts"][0]["noop"]
    done = led.change("revise", ["a"], iri, {"kind": "literal", "value": "ship"})
    assert done["previous"] == iri and done["fact"] != iri and "created" not in done
    assert led.change("judge", ["a"], [{"target": done["fact"], "mode": "weaken"}])["weights"] == {done["fact"]: -1}
    told = led.answer(["a"], history="kg:element/dov")
    assert [(f["current"], f["transaction"]["to"] is None) for f in told["facts"]] == [(True, True), (False, False)] and len(told["revisions"]) == 1 and not told["revisionsTruncated"]
    assert [n["iri"] for n in told["nodes"]] == sorted(n["iri"] for n in told["nodes"]) and len(told["nodes"]) == 3
    whole = led.change("withdraw", ["a"], target=done["fact"], concise=False)
    assert whole["tool"] == "withdraw" and whole["changed"] == 1
    with pytest.raises(InvalidInput):
        led.change("read")


def test_change_feed(spark, tmp_path):
    led = FactLedger(spark, f"file://{tmp_path}/led")
    first = led.store.version()
    iri = led.write([{"s": {"name": "Eve"}, "p": "owns", "o": {"kind": "literal", "value": "boat"}}], ["a"])["facts"][0]["iri"]
    led.judge(["a"], [{"target": iri, "mode": "strengthen"}])
    led.write([{"s": {"name": "Eve"}, "p": "owns", "o": {"kind": "literal", "value": "boat"}}], ["b"])
    told = []

    def handle(rows, after, upto):
        told.append((after, upto, [(r["version"], r["kind"], r["before"] and r["before"]["weight"], r["after"] and r["after"]["weight"]) for r in rows.filter(f"key = '{iri}'").orderBy("version").collect()]))

    point = f"file://{tmp_path}/point"
    for _ in range(2):
        feed.follow_changes(led.store, "facts", handle, point).awaitTermination()
    last = led.store.version()
    assert told == [(0, last, [(first + 1, "insert", None, 0), (first + 2, "update", 0, 1), (last, "update", 1, 1)])]
    led.store.publish(last, {"facts": led.table("facts").withColumn("deleted", F.col("iri") == iri)})
    feed.follow_changes(led.store, "facts", handle, point).awaitTermination()
    assert told[1:] == [(last, last + 1, [(last + 1, "delete", 1, None)])]
    assert feed.changes(led.store, "facts", last + 1, last + 1).count() == 0
    led.store.publish(last + 1, {"facts": led.table("facts")})  # as they were
    assert feed.changes(led.store, "facts", last + 1, last + 2).count() == 0


def test_a_failed_handler_is_told_again_and_a_late_listing_changes_nothing(spark, tmp_path):
    led = FactLedger(spark, f"file://{tmp_path}/led")
    led.write([{"s": {"name": "Fay"}, "p": "owns", "o": {"kind": "literal", "value": "kite"}}], ["a"])
    told, point = [], f"file://{tmp_path}/point"

    def fails(rows, after, upto):
        raise RuntimeError("not now")

    with pytest.raises(Exception, match="not now"):
        feed.follow_changes(led.store, "facts", fails, point).awaitTermination()
    for _ in range(2):
        feed.follow_changes(led.store, "facts", lambda rows, after, upto: told.append((after, upto, rows.count())), point).awaitTermination()
    assert told == [(0, led.store.version(), 1)]
