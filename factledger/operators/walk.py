"""Constrained walks of one to three steps around a node, with one witness path for each fact, cheapest first.

A walk goes on from its frontier only: the edges at the nodes that the last step reached give both those nodes' degrees and the next
step. A frontier of at most `FEW` nodes, which is counted first, is handed to all tasks, so the facts are filtered where they are read; a larger one is a join.

Every step costs one, and one more into a hub, so costs only rise along a path. As soon as `limit` facts have a witness,
the dearest of them bounds the search: a path whose next step would cost more can neither bring a fact among the first nor cheapen one that is, and
isn't followed. A hub of any size is read once and not walked through unless fewer facts lie nearer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger import schema as S
from factledger.operators import triples as T
from factledger.operators.search import numbered
from factledger.operators.sweep import stored

#: Nodes of a frontier that are broadcast.
FEW = 300_000


def cost() -> Column:
    return F.size("path_edges") + F.col("hub_count")


def around(facts: DataFrame, nodes: DataFrame, scope: Sequence[str], start: str, depth: int = 1, direction: str = "both", predicates: Sequence[str] = (), at: str | None = None, limit: int = S.DEFAULT_LIMIT) -> DataFrame:
    """Facts on trails from a visible start, cheapest witness first; a hidden or missing start gives no rows."""
    usable = T.current(facts, scope, at, lenient=True, types=S.WALKABLE, predicates=predicates)
    half = T.half_edges(usable.select("iri", "s_iri", "o_iri"), direction).select("iri", "v", "other")
    seen = T.seen_nodes(nodes, scope)
    begin = seen.filter(F.col("iri") == start).select(F.col("iri").alias("tail"), F.array("iri").alias("path_nodes"), F.array().cast("array<string>").alias("path_edges"), F.lit(0).alias("hub_count"))
    edges, _ = incident(half, seen, begin)
    paths, every = begin, None
    for step in range(depth):
        longer = paths.join(edges, F.col("tail") == F.col("v")).filter(~F.array_contains("path_edges", F.col("iri")))
        longer = longer.select(F.col("other").alias("tail"), F.concat("path_nodes", F.array("other")).alias("path_nodes"), F.concat("path_edges", F.array("iri")).alias("path_edges"), "hub_count")
        edges, hubs = incident(half, seen, longer)
        flagged = longer.join(hubs, "tail", "left").select("tail", "path_nodes", "path_edges", (F.col("hub_count") + F.coalesce("is_hub", F.lit(0))).alias("hub_count"))
        if step + 1 == depth:
            every = flagged if every is None else every.unionAll(flagged)
            break
        paths = stored(flagged)
        every = paths if every is None else every.unionAll(paths)
        bound = dearest(every, limit)
        if bound is not None:
            paths = paths.filter(cost() + 1 <= bound)
    distance = F.size("path_edges")
    witness = every.select(F.struct(cost().alias("route_cost"), "hub_count", distance.alias("distance"), "path_nodes", "path_edges").alias("w"), F.explode("path_edges").alias("iri")).groupBy("iri").agg(F.min("w").alias("w"))
    order = [F.col(c) for c in ("route_cost", "hub_count", "distance", "path_nodes", "path_edges")]
    first = witness.select("iri", "w.*").orderBy(*order).limit(limit)  # no ties: the path up to a fact costs less than one beyond it, so a witness ends in its own fact
    return numbered(usable.join(F.broadcast(first), "iri"), [*order, F.col("s_iri"), F.col("property_iri"), F.col("o_iri"), F.col("iri")], limit)


def incident(half: DataFrame, seen: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Half edges from the ends of these paths to visible nodes, and which of the ends are hubs (tail, is_hub)."""
    ends = paths.select(F.col("tail").alias("v")).distinct()
    few = ends.limit(FEW + 1).toArrow()
    if few.num_rows <= FEW:
        ends = F.broadcast(half.sparkSession.createDataFrame(few, ends.schema))
    edges = half.join(ends, "v", "left_semi").join(seen.select(F.col("iri").alias("other")), "other", "left_semi").select("iri", "v", "other")
    hubs = edges.groupBy("v").agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") > S.HUB_DEGREE)
    return edges, hubs.select(F.col("v").alias("tail"), F.lit(1).alias("is_hub"))


def dearest(paths: DataFrame, limit: int) -> int | None:
    """The cost of the fact in place `limit`, if there are so many."""
    costs = paths.select(cost().alias("c"), F.explode("path_edges").alias("iri")).groupBy("iri").agg(F.min("c").alias("c")).orderBy("c").limit(limit)
    n, most = costs.agg(F.count(F.lit(1)), F.max("c")).first()
    return most if n == limit else None


def path_edges(found: DataFrame, facts: DataFrame) -> DataFrame:
    """rank, place, iri, from_iri, property_iri, to_iri: the edges of each ranked fact's witness path in order, each in the direction in which it is stored."""
    steps = found.select("rank", F.posexplode("path_edges").alias("place", "iri"))  # at most a page of paths
    return steps.join(facts.select("iri", F.col("s_iri").alias("from_iri"), "property_iri", F.col("o_iri").alias("to_iri")), "iri").withColumn("place", F.col("place").cast("long"))


def path_nodes(found: DataFrame, nodes: DataFrame, scope: Sequence[str], start: str | None = None) -> DataFrame:
    """The visible nodes of an answer, by iri: its start, the ends of its facts and what its paths pass; no start for answers without paths."""
    ends = found.select(F.explode(F.concat(F.array("s_iri", "o_iri"), F.col("path_nodes") if "path_nodes" in found.columns else F.array())).alias("iri"))
    if start is not None:
        ends = ends.unionAll(nodes.filter(F.col("iri") == start).select("iri"))
    return T.seen_nodes(nodes, scope).join(ends.distinct(), "iri", "left_semi")
