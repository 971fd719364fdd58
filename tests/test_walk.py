"""Walks beside a hub of a million edges."""

from pyspark.sql import functions as F

from factledger import schema as S
from factledger.operators import walk

ROWS = {"type": "'ASSERTS'", "property_iri": "'p'", "layers": "array()", "weight": "0L", "eff_qualified": "false"}


def table(df, schema, given):
    names = [x.strip().split(" ", 1) for x in schema.split(", ")]
    return df.select(*(F.expr(given.get(n, "null")).cast(t).alias(n) for n, t in names))


def ledger(spark, edges, own):
    hub = spark.range(edges).selectExpr("concat('h', lpad(id, 7, '0')) AS iri", "'hub' AS s_iri", "concat('leaf', id) AS o_iri")
    near = spark.range(own).selectExpr("concat('a', lpad(id, 3, '0')) AS iri", "'start' AS s_iri", "concat('near', lpad(id, 3, '0')) AS o_iri")
    link = spark.createDataFrame([("link", "start", "hub"), ("loop", "start", "start")], "iri string, s_iri string, o_iri string")
    raw = hub.unionAll(near).unionAll(link)
    facts = table(raw, S.FACTS, ROWS | {c: c for c in ("iri", "s_iri", "o_iri")})
    nodes = raw.select(F.explode(F.array("s_iri", "o_iri")).alias("iri")).distinct()
    return facts, table(nodes, S.NODES, {"iri": "iri", "layers": "array()", "labels": "array('Element')"})


def test_hub_is_not_walked_through(spark, monkeypatch):
    """Twenty facts lie nearer than anything behind the hub: its million edges give its degree and no path."""
    facts, nodes = ledger(spark, 1_000_000, 25)
    rows, keep = [], walk.stored
    monkeypatch.setattr(walk, "stored", lambda df: rows.append(keep(df)) or rows[-1])
    got = walk.around(facts, nodes, [], "start", depth=3, limit=20).collect()
    assert [r.iri for r in got] == [*(f"a{i:03d}" for i in range(20))] and {(r.route_cost, r.hub_count) for r in got} == {(1, 0)}
    assert [df.count() for df in rows][0] == 27 and sum(df.count() for df in rows) < 100


def test_through_the_hub_where_too_little_is_near(spark):
    facts, nodes = ledger(spark, 300, 2)
    got = walk.around(facts, nodes, [], "start", depth=2, limit=50).collect()
    assert [(r.iri, r.route_cost, r.hub_count) for r in got[:5]] == [("a000", 1, 0), ("a001", 1, 0), ("loop", 1, 0), ("link", 2, 1), ("h0000000", 3, 1)]
    assert len(got) == 50 and all(r.path_edges == ["link", r.iri] for r in got[4:])
    assert walk.around(facts, nodes, [], "nobody", depth=2).collect() == []
    assert [r.iri for r in walk.around(facts, nodes, [], "leaf7", depth=1, direction="incoming").collect()] == ["h0000007"]
