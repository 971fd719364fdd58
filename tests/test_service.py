"""Names, settings, limits, answers and the change feed."""

import pytest
from pyspark.sql import functions as F

from factledger import schema as S
from factledger.api import FactLedger
from factledger.errors import InvalidInput, RateLimited
from factledger.functions import exprs as E
from factledger.functions import names as N
from factledger.operators import search
from factledger.operators.semantic import FixtureProvider
from factledger.service import Config, Semantic, TimedOut, TokenBucket, within
from factledger.streaming.feed import follow


def test_names(spark):
    assert N.slugify("kg:class/Foo", "literal") == "foo" and N.slugify("kg:x/Foo Bar", "class") == "Foo-Bar"
    given = spark.createDataFrame([("kg:class/Foo", ["Literal"]), (" a/b ", ["Element", "Class"]), ("x", [])], "n string, l array<string>")
    rows = given.select(E.slugify(F.col("n"), "literal").alias("s"), E.kind_from_labels(F.col("l")).alias("k"), E.label_for_kind(F.lit("CLASS")).alias("c"), E.kind_for_label(F.lit("Nope")).alias("x")).collect()
    assert [tuple(r) for r in rows] == [("foo", None, "Class", None), ("a-b", "class", "Class", None), ("x", None, "Class", None)]
    assert N.phrase_query('a(b) "x"') == '"a\\(b\\) \\"x\\""' and N.phrase_query("isIn") == '("isIn" OR "is In")'
    assert N.fuzzy_term("Ab c-d") == "ab\\ c\\-d~2"
    assert N.lock_key("a", "bc", "") != N.lock_key("ab", "c", "") and len(N.lock_key("", "", "")) == 64
    assert N.safe_relationship("about") == "ABOUT" and N.safe_label("A_1") == "A_1"
    for bad in (lambda: N.safe_label("1a"), lambda: N.safe_label("a b"), lambda: N.safe_relationship("")):
        with pytest.raises(InvalidInput):
            bad()
    assert N.latency([5.0, 1.0, 3.0, 2.0]) == {"samples": 4, "min_ms": 1.0, "p50_ms": 2.0, "p95_ms": 5.0, "max_ms": 5.0}
    assert N.percentile([float(i) for i in range(1, 101)], 0.95) == 95


def test_bucket_and_time(spark):
    now = [0.0]
    bucket = TokenBucket(clock=lambda: now[0])
    for _ in range(20):
        bucket.take()
    with pytest.raises(RateLimited) as e:
        bucket.take()
    assert e.value.args[0] == 500
    now[0] = 0.5
    bucket.take()
    assert within(spark, lambda: spark.range(5).count(), 30) == 5
    with pytest.raises(TimedOut):
        within(spark, lambda: spark.range(0, 1 << 40, 1, 100_000).select(F.max(F.sha2(F.col("id").cast("string"), 256))).collect(), 1.5)


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text('path = "file:///x"\n[semantic]\nttl_days = 3\n')
    assert Config.load(tmp_path / "c.toml").semantic.ttl_days == 3 and Config.load(tmp_path / "c.toml", {"FACTLEDGER_PATH": "y"}).path == "y"
    assert Config.load(tmp_path / "none.toml") == Config()
    for bad in ({"ttl_days": 0}, {"neighbor_limit": 101}, {"recall_similarity_threshold": 1.0}, {"rrf_k": 0.0}, {"direct_weight": 0.5}, {"convergence_similarity_threshold": float("nan")}):
        with pytest.raises(InvalidInput):
            Semantic(**bad)


def test_score_of_a_token_in_every_row_stays_positive(spark):
    docs = spark.range(2_000_000).select(F.col("id").cast("string").alias("iri"), F.array(F.lit("same")).alias("tokens"))
    assert search.scored(docs, "tokens", ["same"], []).filter("phrase_score > 0").count() == 2_000_000


def test_answers_guards_and_feed(spark, tmp_path):
    led = FactLedger(spark, f"file://{tmp_path}/led", FixtureProvider())
    first = led.write([{"s": {"name": f"Boat {i}"}, "p": "sailsOn", "o": {"kind": "literal", "value": f"sea {i}"}} for i in range(4)], ["a"])
    got = led.answer(["a"], 3, labels=["Element"])
    assert len(got["facts"]) == 3 and got["truncated"] and got["facts"][0]["mutable"] and not led.answer(["a"], 4, labels=["Element"])["truncated"]
    assert [n["iri"] for n in got["nodes"]] == [f"kg:element/boat-{i}" for i in range(3)]
    assert [h["iri"] for h in got["handles"]["nodes"]][:3] == [n["iri"] for n in got["nodes"]] and len(got["handles"]["facts"]) == 3
    assert "handles" not in led.answer(["a"], 2, True, text="sea 1")
    literal = N.literal_iri("sea 1", "xsd:string")
    for source, target in ((literal, "kg:element/boat-1"), ("kg:property/sailsOn", "kg:property/SUPERSEDES"), ("kg:property/sailsOn", "kg:property/ABOUT"), ("kg:element/boat-1", "kg:class/Element")):
        with pytest.raises(InvalidInput):
            led.unify(source, target)
    seen = []
    for _ in range(2):
        follow(led.store, "facts", lambda df, v: seen.append((v, df.count())), f"file://{tmp_path}/point").awaitTermination()
    assert seen == [(led.store.version(), 4)] and first["facts"][0]["changed"]
    led.judge(["a"], [{"target": first["facts"][0]["iri"], "mode": "strengthen"}])
    follow(led.store, "facts", lambda df, v: seen.append((v, df.count())), f"file://{tmp_path}/point").awaitTermination()
    assert seen[1:] == [(led.store.version(), 1)]
    assert S.MAX_LIMIT == 100


def test_changes_suggest_merges_and_contradict_once(spark, tmp_path):
    led = FactLedger(spark, f"file://{tmp_path}/led")
    first = led.write([{"s": {"name": "Stone Harbour"}, "p": "liesIn", "o": {"name": "North Bay"}}], ["a"])
    assert first["suggestions"] == []
    again = led.write([{"s": {"name": "Stone Harbours"}, "p": "liesIn", "o": {"name": "South Coast"}}], ["a"])
    assert [(x["source"], x["target"]) for x in again["suggestions"]] == [("kg:element/stone-harbours", "kg:element/stone-harbour")]
    got = led.revise(["a"], again["facts"][0]["iri"], {"name": "North Bays"})
    assert [(x["source"], x["target"]) for x in got["suggestions"]] == [("kg:element/north-bays", "kg:element/north-bay")]
    for value in ("East Isle", "West Isle"):
        led.write([{"s": {"name": "Stone Harbour"}, "p": "liesIn", "o": {"name": value}, "contradicts": True}], ["a"])
    led.write([{"s": {"name": "Stone Harbour"}, "p": "liesIn", "o": {"name": "West Isle"}, "contradicts": True}], ["b"])
    edges = led.table("facts").filter("type = 'CONTRADICTS'").select("s_iri", "o_iri").collect()
    assert len(edges) == len(set(edges)) and len(edges) >= 2
