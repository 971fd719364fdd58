"""Views over the ledger that the reads share: current facts, closed triples, half edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger import schema as S
from factledger.functions import exprs as E

END = ("iri", "kind", "name", "labels", "layers", "weight", "value")


def as_of(at: str | None, lenient: bool = False) -> Column:
    """State as of an instant; where lenient, structural facts have no world time and pass."""
    holds = E.effective_at(at, F.col("eff_qualified"), F.col("eff_from"), F.col("eff_to"))
    return (F.col("type") != "ASSERTS") | holds if lenient and at is not None else holds


def current(facts: DataFrame, scope: Sequence[str], at: str | None = None, lenient: bool = False, types: Sequence[str] = (), predicates: Sequence[str] = ()) -> DataFrame:
    """Visible facts that are not retired; every test is a plain filter that reaches the scan."""
    keep = F.col("valid_to").isNull() & E.visible(F.col("layers"), scope) & as_of(at, lenient)
    if types:
        keep = keep & F.col("type").isin(*types)
    if predicates:
        keep = keep & F.col("property_iri").isin(*predicates)
    return facts.filter(keep)


def seen_nodes(nodes: DataFrame, scope: Sequence[str]) -> DataFrame:
    return nodes.filter(E.visible(F.col("layers"), scope))


def end(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(*(F.col(c).alias(f"{side}_{c}") for c in END))


def closed(facts: DataFrame, nodes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Facts with both ends, where both ends are visible."""
    seen = seen_nodes(nodes, scope)
    return facts.join(end(seen, "s"), "s_iri").join(end(seen, "o"), "o_iri")


def half_edges(facts: DataFrame, direction: str = "both") -> DataFrame:
    """facts with v and other; a self-loop is one row."""
    out = facts.withColumns({"v": F.col("s_iri"), "other": F.col("o_iri")})
    back = facts.withColumns({"v": F.col("o_iri"), "other": F.col("s_iri")})
    if direction == "outgoing":
        return out
    if direction == "incoming":
        return back
    return out.unionAll(back.filter("s_iri <> o_iri"))


def any_label(labels: Sequence[str]) -> Column:
    wanted = E.strings(labels)
    return F.arrays_overlap("s_labels", wanted) | F.arrays_overlap("o_labels", wanted)


def structural(types: Sequence[str] = S.STRUCTURAL) -> Column:
    return F.col("type").isin(*types)
