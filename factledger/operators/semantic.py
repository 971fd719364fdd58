"""Fusion of direct, learned and structural evidence.

Vectors are searched exactly: a dot product in the projection and a top-k. All later steps work on at most a hundred
direct hits, k neighbours and sixteen anchors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factledger import schema as S
from factledger.functions import exprs as E
from factledger.operators import search as Q
from factledger.operators import triples as T


class Settings(NamedTuple):
    neighbors: int = S.NEIGHBORS
    floor: float = S.RECALL_FLOOR
    converge: float = S.CONVERGE_FLOOR
    overlap: float = S.CONVERGE_OVERLAP
    rrf_k: float = S.RRF_K
    direct: float = S.DIRECT_WEIGHT
    keyword: float = S.FALLBACK_WEIGHT
    raw_cosine: bool = False


class EmbeddingProvider(Protocol):
    def embed(self, text: str) -> list[float]: ...


class FixtureProvider:
    """A deterministic three-component embedding, for tests."""

    def embed(self, text: str) -> list[float]:
        data = text.encode()
        return unit([1.0, len(data) + 1.0, sum(data) + 1.0])


def unit(vector: Sequence[float]) -> list[float]:
    if not vector or len(vector) > 4096 or not all(math.isfinite(x) for x in vector):
        raise ValueError("an embedding has 1 to 4096 finite components")
    norm = math.sqrt(sum(x * x for x in vector))
    if not norm or not math.isfinite(norm):
        raise ValueError("an embedding's norm is neither zero nor infinite")
    return [x / norm for x in vector]


def nearest(activations: DataFrame, vector: Sequence[float], settings: Settings = Settings()) -> DataFrame:
    """The k most similar activations, expired ones among them."""
    asked = F.array(*(F.lit(float(x)) for x in vector))
    scored = activations.select("id", "result_refs", "expires_at_ms", E.similarity(F.col("embedding"), asked, settings.raw_cosine).alias("similarity"))
    return scored.orderBy(F.col("similarity").desc(), "id").limit(settings.neighbors)


def live(near: DataFrame, now_ms: int, settings: Settings = Settings()) -> DataFrame:
    """Those of the k that have not expired and reach the floor."""
    return near.filter((F.col("expires_at_ms") >= now_ms) & (F.col("similarity") >= settings.floor))


def resolved(facts: DataFrame, nodes: DataFrame, scope: Sequence[str], labels: Sequence[str] = (), at: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """Ordinary visible facts; of a few named in only(iri) nothing else meets the nodes, and no node is dealt out for them."""
    if only is None:
        found = T.closed(T.current(facts, scope, at, types=("ASSERTS",)), nodes, scope)
    else:
        few, seen = T.current(facts.join(F.broadcast(only.select("iri").distinct()), "iri", "left_semi"), scope, at, types=("ASSERTS",)), T.seen_nodes(nodes, scope)
        found = F.broadcast(F.broadcast(few).join(T.end(seen, "s"), "s_iri")).join(T.end(seen, "o"), "o_iri")
    return found.filter(T.any_label(labels)) if labels else found


def references(near: DataFrame) -> DataFrame:
    """iri of the facts that near activations name: a few for each."""
    return near.select(F.explode("result_refs").alias("iri"))


def activation_evidence(near: DataFrame, known: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """iri, contribution, id: of each reference that resolves; places of others count all the same."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("similarity") - settings.floor) / (1.0 - settings.floor)))
    refs = near.select("id", share.alias("share"), F.posexplode("result_refs").alias("place", "iri"))
    return refs.join(known.select("iri"), "iri", "left_semi").select("iri", "id", (settings.keyword * F.col("share") / (settings.rrf_k + F.col("place") + 1.0)).alias("contribution"))


def direct_evidence(hits: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """iri, contribution, eligible: reciprocal ranks over hits(iri, rank, exact, matched, evidence) that have evidence."""
    weight = F.when(F.col("exact") == 1, settings.direct).otherwise(settings.keyword * F.col("evidence"))
    own = hits.filter("matched").withColumn("w", weight).filter("w > 0")
    place = F.row_number().over(W.orderBy("rank"))  # at most a hundred hits
    return own.withColumn("place", place).select("iri", (F.col("w") / (settings.rrf_k + F.col("place"))).alias("contribution"), ((F.col("exact") == 1) | (F.col("evidence") >= 1.0)).alias("eligible"))


def structural(anchors: DataFrame, facts: DataFrame, nodes: DataFrame, scope: Sequence[str], labels: Sequence[str] = (), at: str | None = None) -> DataFrame:
    """iri, score: one step from each anchor(iri, anchor_score), damped by degrees and by the size of groups.

    Two ends of sixteen anchors are pinned, so facts are filtered by them where they are read, and only those meet the nodes.
    """
    own = resolved(facts, nodes, scope, labels, at, anchors)
    pairs = Q.pinned(own.join(F.broadcast(anchors), "iri").select(F.col("iri").alias("anchor"), "anchor_score", F.explode(F.array_distinct(F.array("s_iri", "o_iri"))).alias("v")))  # sixteen anchors
    ends = [r.v for r in pairs.select("v").distinct().collect()]
    known = resolved(facts.filter(F.col("s_iri").isin(ends) | F.col("o_iri").isin(ends)), nodes, scope, labels, at)
    half = T.half_edges(known.select("iri", "s_iri", "o_iri", "property_iri")).join(F.broadcast(pairs), "v").filter("iri <> anchor")
    degree = half.groupBy("anchor", "v").agg(F.count(F.lit(1)).alias("degree"))
    first = half.withColumn("n", F.row_number().over(W.partitionBy("anchor", "v").orderBy("iri"))).filter(F.col("n") <= S.PER_ENDPOINT)
    unique = first.join(degree, ["anchor", "v"]).groupBy("anchor", "anchor_score", "iri", "property_iri").agg(F.min("degree").alias("degree"))
    size = F.count(F.lit(1)).over(W.partitionBy("anchor", "property_iri"))
    score = F.col("anchor_score") * S.STRUCTURAL_SCALE / F.sqrt(F.greatest(F.col("degree"), F.lit(1)).cast("double")) / F.sqrt(size.cast("double"))
    return unique.withColumn("score", score).groupBy("iri").agg(F.max("score").alias("score"))


def fuse(hits: DataFrame, near: DataFrame, facts: DataFrame, nodes: DataFrame, scope: Sequence[str], limit: int | None = S.DEFAULT_LIMIT, labels: Sequence[str] = (), at: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """iri, fused, is_direct, eligible, rank: facts by fused score, direct ones first among equals.

    hits holds a hundred rows at most and near the nearest activations, each with a few references, so what both find is pinned.
    """
    known = resolved(facts, nodes, scope, labels, at, references(near))
    direct = direct_evidence(hits, settings)
    learned = activation_evidence(near, known, settings).groupBy("iri").agg(F.max("contribution").alias("learned"))
    both = direct.join(learned, "iri", "full").select("iri", (F.coalesce("contribution", F.lit(0.0)) + F.coalesce("learned", F.lit(0.0))).alias("fused"), F.col("contribution").isNotNull().alias("is_direct"), F.coalesce("eligible", F.lit(False)).alias("eligible"), "contribution", "learned")
    both = Q.pinned(both)
    anchor_score = F.greatest(F.when(F.col("eligible"), F.col("contribution")), F.col("learned"))
    anchors = both.withColumn("anchor_score", anchor_score).filter("anchor_score is not null").orderBy(F.col("anchor_score").desc(), "iri").limit(S.ANCHORS).select("iri", "anchor_score")
    more = structural(anchors, facts, nodes, scope, labels, at).join(both.select("iri"), "iri", "left_anti")
    every = both.select("iri", "fused", "is_direct", "eligible").unionAll(more.select("iri", F.col("score").alias("fused"), F.lit(False), F.lit(False)))
    order = [F.col("fused").desc(), F.col("is_direct").desc(), F.col("iri")]
    return every.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long")) if limit is None else Q.numbered(every, order, limit)


def bundle(fused: DataFrame, facts: DataFrame) -> DataFrame:
    """iri, place: up to three eligible facts; two of a group (subject, property) before a third."""
    own = F.broadcast(fused.filter("eligible")).join(facts.select("iri", "s_iri", "property_iri"), "iri")  # the limit bounds the one, nothing the other
    nth = F.row_number().over(W.partitionBy("s_iri", "property_iri").orderBy("rank"))
    ordered = own.withColumn("late", (nth > 2).cast("int"))
    return Q.numbered(ordered, [F.col("late"), F.col("rank")], S.BUNDLE_REFS).select("iri", F.col("rank").alias("place"))


def contributing(near: DataFrame, known: DataFrame) -> DataFrame:
    """id of activations of which some reference is visible: their leases are renewed."""
    return near.select("id", F.explode("result_refs").alias("iri")).join(known.select("iri"), "iri", "left_semi").select("id").distinct()


def converging(near: DataFrame, refs: Column, settings: Settings = Settings()) -> DataFrame:
    """The one activation that is near enough and says nearly the same; of equals the last in order."""
    alike = E.jaccard(F.col("result_refs"), refs)
    return near.withColumn("overlap", alike).filter((F.col("similarity") >= settings.converge) & (F.col("overlap") >= settings.overlap)).orderBy(F.col("similarity").desc(), F.col("id").desc()).limit(1)
