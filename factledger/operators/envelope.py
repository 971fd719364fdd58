"""What the operations answer with: nodes, facts and their ends as structs, and the parts put together.

The structs are columns, so a page of an answer is one projection over the ranked rows. Only a finished answer, which has at most a
hundred facts, is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.functions import exprs as E


def handle(kind: str, iri: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), iri.alias("iri"))


def labels_shown(labels: Column) -> Column:
    return F.filter(labels, lambda x: x != "Entity")


def node(prefix: str = "") -> Column:
    """A whole node: kind node or literal, what names it, its scope and weight, and the handle to name it by."""
    c = lambda name: F.col(prefix + name)
    literal = F.array_contains(c("labels"), "Literal")
    return F.struct(
        F.when(literal, "literal").otherwise("node").alias("kind"), c("iri").alias("iri"), c("name").alias("name"), labels_shown(c("labels")).alias("labels"), F.when(literal, c("value")).alias("value"),
        F.when(literal, c("datatype")).alias("datatype"), c("stub").alias("stub"), c("layers").alias("scope"), c("weight").alias("weight"), handle("node", c("iri")).alias("target"),
    )


def end(side: str) -> Column:
    """The compact end of a fact: entities show name and labels, literals their value."""
    c = lambda name: F.col(f"{side}_{name}")
    literal = F.array_contains(c("labels"), "Literal")
    return F.struct(
        F.when(literal, "literal").otherwise("node").alias("kind"), c("iri").alias("iri"), F.when(~literal, c("name")).alias("name"), F.when(~literal, labels_shown(c("labels"))).alias("labels"),
        F.when(literal, c("value")).alias("value"), c("layers").alias("scope"), c("weight").alias("weight"), handle("node", c("iri")).alias("target"),
    )


def effective() -> Column:
    """The interval of a fact that has one, as RFC 3339 texts; null where it is unknown."""
    stamp = lambda name: F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(F.coalesce(F.col("eff_qualified"), F.lit(False)), F.struct(stamp("eff_from").alias("from"), stamp("eff_to").alias("to")))


def edge() -> Column:
    """A fact as an edge, for paths and schema answers."""
    return F.struct(
        F.lit("fact").alias("kind"), F.col("type").alias("type"), F.col("s_iri").alias("from"), F.col("o_iri").alias("to"), F.col("iri").alias("iri"), F.col("property_iri").alias("propertyIri"), F.col("episode_id").alias("episodeId"),
        F.col("reason").alias("reason"), F.col("spike").alias("spike"), effective().alias("effective"), F.col("layers").alias("scope"), F.col("weight").alias("weight"),
    )


def fact(scope: Iterable[str] = ()) -> Column:
    """A closed current fact: its handle, both ends, the predicate's local name, and what this scope may do with it."""
    return F.struct(
        handle("fact", F.col("iri")).alias("target"), end("s").alias("s"), E.name_from_iri(F.col("property_iri")).alias("p"), end("o").alias("o"), F.col("layers").alias("scope"), F.col("spike").alias("spike"),
        effective().alias("effective"), F.col("weight").alias("weight"), F.col("valid_to").isNull().alias("current"), F.col("valid_to").isNull().alias("rateable"), (F.col("valid_to").isNull() & E.mutable(F.col("layers"), list(scope))).alias("mutable"),
    )


def nodes_of(facts: DataFrame) -> DataFrame:
    """position, iri: the ends of facts(rank, s_*, o_*) that are no literals, once each, in the order they are first seen."""
    ends = F.array(*(F.struct((F.col("rank") * 2 + i).alias("at"), F.col(f"{s}_iri").alias("iri"), F.array_contains(f"{s}_labels", "Literal").alias("literal")) for i, s in enumerate("so")))
    return facts.select(F.explode(ends).alias("e")).filter("not e.literal").groupBy("e.iri").agg(F.min("e.at").alias("position"))


def handles(facts: list[dict], nodes: list[dict], current: dict | None = None, retired: dict | None = None, unify: list[dict] | None = None) -> dict:
    """What an answer names, once each, in the order it is first seen."""
    shown: dict[str, dict] = {}
    named: dict[str, dict] = {}
    for f in facts:
        shown.setdefault(f["target"]["iri"], f["target"])
    for n in (*nodes, *(f[x] for f in facts for x in "so")):
        named.setdefault(n["target"]["iri"], n["target"])
    return {"facts": list(shown.values()), "nodes": list(named.values()), "current": current, "retired": retired, "unify": unify or []}


def page(ranked: DataFrame, limit: int, scope: Iterable[str] = (), *more: str) -> tuple[list[dict], bool]:
    """The first facts of an answer (`limit` + 1 are looked at), each with `more` columns in it, and whether there are more facts."""
    rows = ranked.filter(F.col("rank") <= limit + 1).select("rank", fact(scope).alias("f"), *more).orderBy("rank").collect()  # bounded by the limit
    return [r["f"].asDict(True) | {m: r[m].asDict(True) if hasattr(r[m], "asDict") else r[m] for m in more} for r in rows[:limit]], len(rows) > limit


def finish(mode: str, scope: Iterable[str], facts: list[dict], truncated: bool, nodes: list[dict] | None = None, concise: bool = False, **parts: object) -> dict:
    """A whole answer of a mode (text, labels, catalog, iris, around, history, semantic); a concise one has what its mode needs and leaves out what can be looked up."""
    seen: dict[str, dict] = {}
    for n in nodes if nodes is not None else [f[x] for f in facts for x in "so"]:
        if nodes is not None or n["kind"] != "literal":
            seen.setdefault(n["iri"], n)
    whole = {"mode": mode, "scope": list(scope), "facts": facts, "nodes": list(seen.values()), "paths": [], "about": [], "lookups": [], "truncated": truncated} | parts
    if not concise:
        return whole | {"handles": handles([*facts, *(f for x in whole["lookups"] for f in x["facts"])], whole["nodes"])}
    return _short(whole)


def _bare(n: dict | None) -> dict | None:
    return n and {k: n[k] for k in ("iri", "name", "value") if n.get(k) is not None}


def _short_fact(f: dict) -> dict:
    times = {k: f[k] for k in ("effective", "spike", "current", "transaction") if f.get(k) is not None and (k != "current" or "transaction" in f)}
    return {"target": f["target"]["iri"], "s": _bare(f["s"]), "p": f["p"], "o": _bare(f["o"]), "weight": f["weight"]} | times


def _short(whole: dict) -> dict:
    """Only a catalog lists nodes, only a walk has paths, only iris and history have lookups; facts of iris stand in their lookups alone."""
    mode = whole["mode"]
    out = {k: v for k, v in whole.items() if k not in ("mode", "scope", "about", "nodes", "paths", "lookups")}
    out["facts"] = [] if mode == "iris" else [_short_fact(f) for f in whole["facts"]]
    if mode == "catalog":
        out["nodes"] = [_bare(n) for n in whole["nodes"]]
    if mode == "around":
        out["paths"] = [{"nodes": x["nodes"], "edges": [e["iri"] for e in x["edges"]]} for x in whole["paths"]]
    if mode in ("iris", "history"):
        out["lookups"] = [x | {"facts": [_short_fact(f) for f in x["facts"]]} | ({"node": _bare(x["node"])} if "node" in x else {}) for x in whole["lookups"]]
    return out


#: What a concise answer of each change keeps beside its episode and whether anything changed.
KEPT = {"write": ("facts", "created", "suggestions"), "revise": ("fact", "previous", "suggestions"), "withdraw": ("changed",), "judge": ("weights",), "place": ("layers",), "unify": ("node",)}


def changed(tool: str, answer: dict, concise: bool = False) -> dict:
    """The answer of a change with `ok`, `noop` and handles; a concise one keeps its tool's own parts, and of written facts what names them. Empty reviews go."""
    noop = answer.get("episode") is None
    if not concise:
        return {"ok": True, "noop": noop, "tool": tool} | answer | {"handles": [{"kind": "fact", "iri": f["iri"]} for f in answer.get("facts", [])] or [{"kind": "fact", "iri": answer[k]} for k in ("fact", "previous") if answer.get(k)]}
    kept = {k: answer[k] for k in KEPT[tool] if k in answer and (k not in ("suggestions", "created") or answer[k])}
    if tool == "write":
        kept["facts"] = [{"target": {"kind": "fact", "iri": f["iri"]}, "noop": not f["changed"]} for f in answer["facts"]]
    return {"ok": True, "noop": noop, "episode": answer.get("episode")} | kept
