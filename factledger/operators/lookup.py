"""Reads by key: nodes with their facts, history, revisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factledger import schema as S
from factledger.functions import exprs as E
from factledger.operators import triples as T
from factledger.operators.search import numbered


def inputs(nodes: DataFrame, iris: Sequence[str]) -> DataFrame:
    """position, iri of a bounded list of keys."""
    return nodes.sparkSession.createDataFrame([(i, x) for i, x in enumerate(iris)], "position long, iri string")


def lookup_nodes(nodes: DataFrame, scope: Sequence[str], iris: Sequence[str]) -> DataFrame:
    """position, iri, found and the node of every key asked for; a key that is missing or hidden has found = false."""
    seen = T.seen_nodes(nodes.filter(F.col("iri").isin(*iris)), scope).select("iri", "kind", "name", "labels", "layers", "weight", "value", F.lit(True).alias("hit"))
    return inputs(nodes, iris).join(seen, "iri", "left").withColumn("found", F.coalesce("hit", F.lit(False))).drop("hit")


def lookup_facts(facts: DataFrame, nodes: DataFrame, scope: Sequence[str], iris: Sequence[str], limit: int = S.DEFAULT_LIMIT, at: str | None = None) -> DataFrame:
    """Facts of each key, at most `limit` for each, and whether there were more."""
    usable = T.current(facts, scope, at, lenient=True).filter("type <> 'ABOUT'")
    near = T.half_edges(usable).filter(F.col("v").isin(*iris))
    roots = T.seen_nodes(nodes.filter(F.col("iri").isin(*iris)), scope).join(inputs(nodes, iris), "iri").select(F.col("iri").alias("v"), "position")
    found = near.join(roots, "v").join(T.seen_nodes(nodes, scope).select(F.col("iri").alias("other")), "other", "left_semi")
    place = W.partitionBy("position").orderBy("s_iri", "property_iri", "o_iri", "iri")
    top = found.withColumn("n", F.row_number().over(place).cast("long")).filter(F.col("n") <= limit + 1)
    more = F.max("n").over(W.partitionBy("position")) > limit
    return top.withColumn("truncated", more).filter(F.col("n") <= limit)


def revised(episodes: DataFrame, scope: Sequence[str]) -> DataFrame:
    return episodes.filter((F.col("tool") == "revise") & E.visible(F.col("selected_scope"), scope))


def once_visible(facts: DataFrame, episodes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Facts of all times that are visible themselves or named by a visible revision."""
    named = revised(episodes, scope).select(F.explode(F.array("previous_fact_iri", "replacement_fact_iri")).alias("iri")).distinct().withColumn("revised", F.lit(True))
    return facts.join(named, "iri", "left").filter(E.visible(F.col("layers"), scope) | F.coalesce("revised", F.lit(False))).drop("revised")


def unprotected() -> Column:
    return ~F.col("type").isin("ABOUT", *S.SYSTEM)


def _by_time() -> list[Column]:
    return [F.col("valid_to").isNull().desc(), F.col("valid_to").desc(), F.col("iri")]


def decorated(history: DataFrame) -> DataFrame:
    """A history with the time of the ledger beside each fact: whether it still stands, and from when to when it stood."""
    there = F.col("valid_to").isNull()
    return history.withColumns({"current": there, "transaction_current": there, "transaction": F.struct(F.col("valid_from").alias("from"), F.col("valid_to").alias("to"))})


def history_node(facts: DataFrame, nodes: DataFrame, episodes: DataFrame, scope: Sequence[str], iri: str, limit: int = S.DEFAULT_LIMIT) -> DataFrame:
    """Current and retired facts of one node."""
    own = facts.filter(((F.col("s_iri") == iri) | (F.col("o_iri") == iri)) & unprotected())
    return numbered(T.closed(once_visible(own, episodes, scope), nodes, scope), _by_time(), limit).transform(decorated)


def family(facts: DataFrame, nodes: DataFrame, episodes: DataFrame, scope: Sequence[str], iri: str) -> DataFrame:
    """s_iri, property_iri of one visible fact."""
    anchor = once_visible(facts.filter(F.col("iri") == iri), episodes, scope)
    return T.closed(anchor, nodes, scope).select("s_iri", "property_iri")


def history_fact(facts: DataFrame, nodes: DataFrame, episodes: DataFrame, scope: Sequence[str], iri: str, limit: int = S.DEFAULT_LIMIT) -> DataFrame:
    """All facts, current and retired, with the subject and property of one fact."""
    own = facts.join(family(facts, nodes, episodes, scope, iri), ["s_iri", "property_iri"], "left_semi").filter(unprotected())
    return numbered(T.closed(once_visible(own, episodes, scope), nodes, scope), _by_time(), limit).transform(decorated)


def _revisions(facts: DataFrame, nodes: DataFrame, episodes: DataFrame, scope: Sequence[str], of: DataFrame, limit: int) -> DataFrame:
    """Visible revisions that name a fact of `of`(iri), where all three facts they name exist."""
    named = revised(episodes, scope).withColumn("iri_named", F.explode(F.array("previous_fact_iri", "replacement_fact_iri")))
    found = named.join(of.select(F.col("iri").alias("iri_named")), "iri_named", "left_semi").drop("iri_named").dropDuplicates(["iri"])
    there = facts.select("iri", "type")
    for column in ("previous_fact_iri", "replacement_fact_iri"):
        found = found.join(there.select(F.col("iri").alias(column)), column, "left_semi")
    found = found.join(there.filter("type = 'SUPERSEDES'").select(F.col("iri").alias("supersedes_iri")), "supersedes_iri", "left_semi")
    return numbered(found, [F.col("at").desc(), F.col("iri")], limit)


def revisions_fact(facts: DataFrame, nodes: DataFrame, episodes: DataFrame, scope: Sequence[str], iri: str, limit: int = S.DEFAULT_LIMIT) -> DataFrame:
    anchor = T.closed(facts.filter(F.col("iri") == iri), nodes, scope).select("s_iri", "property_iri")
    own = facts.join(anchor, ["s_iri", "property_iri"], "left_semi")
    seen = T.seen_nodes(nodes, scope).select(F.col("iri").alias("o_iri"))
    return _revisions(facts, nodes, episodes, scope, own.join(seen, "o_iri", "left_semi"), limit)


def revisions_node(facts: DataFrame, nodes: DataFrame, episodes: DataFrame, scope: Sequence[str], iri: str, limit: int = S.DEFAULT_LIMIT) -> DataFrame:
    own = facts.filter(((F.col("s_iri") == iri) | (F.col("o_iri") == iri)) & unprotected())
    return _revisions(facts, nodes, episodes, scope, T.closed(own, nodes, scope), limit)
