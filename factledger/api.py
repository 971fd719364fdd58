"""The ledger as eight operations: two reads and six changes, on a stored snapshot.

Changes touch at most twenty items: the rows they may concern are selected by key, planned on the driver in the order
given, and published as one version with one episode. Merges can touch any number of rows and stay DataFrames.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger import schema as S
from factledger.errors import InvalidInput, MissingEmbedding, PreconditionFailed
from factledger.functions import exprs as E
from factledger.functions import names as N
from factledger.operators import envelope, lookup, resolve, search, semantic, triples, walk
from factledger.sources import fixtures
from factledger.sources.store import TABLES, Store

CATALOG = {"Class", "Property"}
#: What may stand beside each selector of a recall.
SELECTORS = {"text": ("effective_at",), "labels": ("effective_at",), "iris": ("hops", "effective_at"), "around": ("p", "depth", "direction", "effective_at"), "history": ()}
IRI = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:\S+")


def bounded(items: list, what: str, most: int = S.MAX_BATCH) -> list:
    if not 1 <= len(items) <= most:
        raise InvalidInput(f"1 to {most} {what}, not {len(items)}")
    return items


def sat(a: int, b: int) -> int:
    return max(S.LONG_MIN, min(S.LONG_MAX, a + b))


def sees(layers: list[str], scope: list[str]) -> bool:
    return not layers or bool(set(layers) & set(scope))


def may_change(layers: list[str], scope: list[str]) -> bool:
    return bool(set(layers) & set(scope)) if scope else not layers


class FactLedger:
    """`clock` and `new_id` are parameters, so that a run can be repeated."""

    def __init__(self, spark: SparkSession, path: str, provider: semantic.EmbeddingProvider | None = None, space: dict | None = None, clock: Callable[[], datetime] | None = None, new_id: Callable[[], str] | None = None, settings: semantic.Settings = semantic.Settings()) -> None:
        self.spark, self.store, self.provider, self.settings = spark, Store(spark, path), provider, settings
        self.clock = clock or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))
        self.new_id = new_id or (lambda: str(uuid.uuid4()))
        self.space = space
        self.store.bootstrap(fixtures.seed_nodes(spark), space)

    def table(self, name: str, at: int | None = None) -> DataFrame:
        return self.store.read(name, at)

    # Reads

    def recall(self, scope: list[str], text: str | None = None, iris: list[str] | None = None, labels: list[str] | None = None, around: str | None = None, history: str | None = None, hops: int = 0, p: list[str] | None = None, depth: int = 1, direction: str = "both", limit: int = S.DEFAULT_LIMIT, effective_at: str | None = None, _more: int = 0, _version: int | None = None) -> dict[str, DataFrame]:
        """Exactly one of text, iris, labels, around and history; the parts of the answer by name."""
        if sum(x is not None for x in (text, iris, labels, around, history)) != 1:
            raise InvalidInput("exactly one of text, iris, labels, around, history")
        if not 1 <= limit <= S.MAX_LIMIT:
            raise InvalidInput(f"limit is 1 to {S.MAX_LIMIT}")
        if not 1 <= depth <= S.MAX_DEPTH or direction not in ("both", "outgoing", "incoming") or hops not in (0, 1):
            raise InvalidInput("depth is 1 to 3, direction both, outgoing or incoming, hops 0 or 1")
        scope = N.layers(scope)
        at = str(N.instant(effective_at)) if effective_at else None
        now = self.store.version() if _version is None else _version
        nodes, facts = self.table("nodes", now), self.table("facts", now)
        if history is not None:
            episodes = self.table("episodes", now)
            of_fact = N.kind_of(history) == "relationship"
            shown, changed = (lookup.history_fact, lookup.revisions_fact) if of_fact else (lookup.history_node, lookup.revisions_node)
            return {"facts": shown(facts, nodes, episodes, scope, history, limit + _more), "revisions": changed(facts, nodes, episodes, scope, history, limit + _more)}
        if around is not None:
            predicates = [N.mint_iri(x, "property") for x in p or []]
            return {"facts": walk.around(facts, nodes, scope, around, depth, direction, predicates, at, limit + _more)}
        if iris is not None:
            bounded(iris, "iris")
            if len(set(iris)) != len(iris) or any(N.kind_of(x) == "relationship" for x in iris):
                raise InvalidInput("iris are different nodes")
            found = {"lookups": lookup.lookup_nodes(nodes, scope, iris)}
            return found | ({"facts": lookup.lookup_facts(facts, nodes, scope, iris, limit, at)} if hops else {})
        if labels is not None:
            if not labels or len(set(labels)) != len(labels):
                raise InvalidInput("labels are different and at least one")
            if set(labels) <= CATALOG:
                return {"nodes": search.catalog(nodes, labels, limit + _more)}
            if set(labels) & CATALOG:
                raise InvalidInput("Class and Property are listed on their own")
            hits = search.recall_labels(facts, nodes, scope, labels, limit + _more, at)
        else:
            if not text.strip():
                raise InvalidInput("text is empty")
            hits = search.recall_text(facts, nodes, scope, text.strip(), limit + _more, at, lexicon=self.store.lexicon(now))
        return {"facts": hits, "about": search.about_context(facts, nodes, scope, search.context_subjects(hits, nodes), limit)}

    @staticmethod
    def _asked(asked: dict) -> str:
        """The one selector of a recall; arguments that it doesn't take are refused."""
        mode = [k for k in SELECTORS if asked.get(k) is not None]
        if len(mode) != 1:
            raise InvalidInput("exactly one of text, iris, labels, around, history")
        mode = mode[0]
        for name in asked.keys() - SELECTORS.keys():
            if name not in SELECTORS[mode] and asked[name] is not None:
                raise InvalidInput(f"{name} does not go with {mode}")
        for iri in [asked[mode]] if mode in ("around", "history") else asked[mode] if mode == "iris" else []:
            if not IRI.fullmatch(iri) or (N.kind_of(iri) == "relationship" and mode != "history"):
                raise InvalidInput(f"{iri!r} is no node of a ledger")
        if mode == "labels" and set(asked["labels"]) <= CATALOG and asked.get("effective_at"):
            raise InvalidInput("the catalog has no time")
        return mode

    def answer(self, scope: list[str], limit: int = S.DEFAULT_LIMIT, concise: bool = False, **asked: object) -> dict:
        """A recall as one nested answer: facts with both ends, nodes, paths, lookups, revisions, what is said about them, handles, and whether there is more."""
        mode = self._asked(asked)
        if not 1 <= limit <= S.MAX_LIMIT:
            raise InvalidInput(f"limit is 1 to {S.MAX_LIMIT}")
        scope = N.layers(scope)
        now = self.store.version()
        found = self.recall(scope, limit=limit, _more=1, _version=now, **asked)
        if "nodes" in found:
            rows = [r["n"].asDict(True) for r in found["nodes"].select("rank", envelope.node().alias("n")).orderBy("rank").collect()]  # a page
            return envelope.finish("catalog", scope, [], len(rows) > limit, rows[:limit], concise)
        nodes, facts = self.table("nodes", now), self.table("facts", now)
        listed = lambda df: [r["n"].asDict(True) for r in df.select("iri", envelope.node().alias("n")).orderBy("iri").collect()]
        if mode == "iris":
            return self._looked_up(found, scope, limit, concise, nodes)
        if mode == "around":
            shown, more = envelope.page(triples.closed(found["facts"], nodes, scope), limit, scope, "path_nodes")
            first = found["facts"].filter(F.col("rank") <= limit)
            steps: dict[int, list] = {}
            for r in walk.path_edges(first, facts).orderBy("rank", "place").collect():  # three at most for each fact
                steps.setdefault(r["rank"], []).append({"iri": r["iri"], "from": r["from_iri"], "p": r["property_iri"], "to": r["to_iri"]})
            paths = [{"nodes": f.pop("path_nodes"), "edges": steps[i]} for i, f in enumerate(shown, 1)]
            return envelope.finish(mode, scope, shown, more, listed(walk.path_nodes(first, nodes, scope, asked["around"])), concise, paths=paths, **{"from": asked["around"]})
        if mode == "history":
            shown, more = envelope.page(found["facts"], limit, scope, "current", "transaction_current", "transaction")
            changes = [r.asDict(True) for r in found["revisions"].orderBy("rank").collect()]
            revised = [{"replacement": r["replacement_fact_iri"], "previous": r["previous_fact_iri"], "supersedes": r["supersedes_iri"], "scope": r["selected_scope"], "episode": {"iri": r["iri"], "at": r["at"]}} for r in changes[:limit]]
            lookups = [{"iri": asked["history"], "found": bool(shown), "facts": [], "truncated": more}]
            return envelope.finish(mode, scope, shown, more or len(changes) > limit, listed(walk.path_nodes(found["facts"].filter(F.col("rank") <= limit), nodes, scope)), concise, revisions=revised, revisionsTruncated=len(changes) > limit, lookups=lookups, **{"from": asked["history"]})
        shown, more = envelope.page(found["facts"], limit, scope)
        about = search.about_context(facts, nodes, scope, search.context_subjects(found["facts"].filter(F.col("rank") <= limit), nodes), limit)
        return envelope.finish(mode, scope, shown, more, concise=concise, about=envelope.page(about, limit, scope)[0])

    def _looked_up(self, found: dict[str, DataFrame], scope: list[str], limit: int, concise: bool, nodes: DataFrame) -> dict:
        """Each iri with its node and facts; the facts of all, once each, in front."""
        rows = found["lookups"].drop("datatype", "stub").join(nodes.select("iri", "datatype", "stub"), "iri", "left").select("position", "iri", "found", envelope.node().alias("n")).orderBy("position").collect()  # twenty at most
        own: dict[int, list] = {}
        more: dict[int, bool] = {}
        if "facts" in found:
            ends = triples.closed(found["facts"].drop("v", "other"), nodes, scope)
            for r in ends.select("position", "n", "truncated", envelope.fact(scope).alias("f")).orderBy("position", "n").collect():  # a page for each
                own.setdefault(r["position"], []).append(r["f"].asDict(True))
                more[r["position"]] = r["truncated"]
        lookups = [{"iri": r["iri"], "found": r["found"], "node": r["n"].asDict(True) if r["found"] else None, "facts": own.get(r["position"], []), "truncated": more.get(r["position"], False)} for r in rows]
        once = {f["target"]["iri"]: f for x in lookups for f in x["facts"]}
        return envelope.finish("iris", scope, list(once.values()), any(x["truncated"] for x in lookups), [x["node"] for x in lookups if x["found"]], concise, lookups=lookups)

    def change(self, tool: str, *args: object, concise: bool = True, **more: object) -> dict:
        """write, revise, withdraw, judge, place or unify, with the answer in its concise or its whole form."""
        if tool not in envelope.KEPT:
            raise InvalidInput(f"{tool!r} is no change")
        answer = getattr(self, tool)(*args, **more)
        if tool == "revise":
            answer = answer | {"previous": more.get("target", args[1] if len(args) > 1 else None)}
        if tool == "unify":
            node = self.table("nodes").filter(F.col("iri") == more.get("target", args[-1])).select(envelope.node().alias("n")).first()["n"].asDict(True)
            answer = answer | {"node": {k: node[k] for k in ("iri", "name", "labels")} if concise else node}
        return envelope.changed(tool, answer, concise)

    def recall_semantic(self, scope: list[str], text: str, labels: list[str] | None = None, limit: int = S.DEFAULT_LIMIT, effective_at: str | None = None) -> dict[str, DataFrame]:
        """Fused retrieval; it learns: neighbours that helped live on, and the query's own facts are remembered."""
        if self.provider is None:
            raise MissingEmbedding("no embedding provider")
        if not text.strip() or len(text.encode()) > S.SEMANTIC_TEXT_BYTES or not 1 <= limit <= S.MAX_LIMIT:
            raise InvalidInput("text of 1 to 32768 bytes, limit of 1 to 100")
        scope, labels = N.layers(scope), labels or []
        if self.space is not None:
            self.store.check(self.space)
        at = str(N.instant(effective_at)) if effective_at else None
        vector = semantic.unit(self.provider.embed(text.strip()))
        now = int(self.clock().replace(tzinfo=timezone.utc).timestamp() * 1000)
        base = self.store.version()
        nodes, facts = self.table("nodes", base), self.table("facts", base)
        hits = search.recall_text(facts, nodes, scope, text.strip(), S.MAX_LIMIT, at, labels, self.store.lexicon(base))
        near = semantic.live(semantic.nearest(self.table("activations", base), vector, self.settings), now, self.settings)
        fused = semantic.fuse(hits, near, facts, nodes, scope, None, labels, at, self.settings)
        refs = [r["iri"] for r in semantic.bundle(fused, facts).orderBy("place").collect()]  # three at most
        known = semantic.resolved(facts, nodes, scope, labels, at)
        used = [r["id"] for r in semantic.contributing(near, known).collect()]  # k at most
        same = [r["id"] for r in semantic.converging(near, E.strings(refs), self.settings).collect()] if refs else []
        shown = search.numbered(fused.drop("rank"), [F.col("fused").desc(), F.col("is_direct").desc(), F.col("iri")], limit)
        answer = {"facts": self.spark.createDataFrame(shown.collect(), shown.schema)}  # ranked before anything is learned
        ends = answer["facts"].select("iri").join(known.select("iri", "s_iri", "o_iri"), "iri")
        answer["about"] = search.about_context(facts, nodes, scope, search.context_subjects(ends, nodes), limit)
        self.store.mutate(lambda base: (self._learn(base, vector, refs, used, same, now + S.TTL_DAYS * 86_400_000), None))
        return answer

    def _learn(self, base: int, vector: list[float], refs: list[str], used: list[str], same: list[str], until: int) -> dict[str, DataFrame]:
        rows = {r["id"]: r.asDict() for r in self.table("activations", base).filter(F.col("id").isin(*used, *same)).collect()} if used or same else {}
        for r in rows.values():
            r["expires_at_ms"] = until
        if same and same[0] in rows:
            r = rows[same[0]]
            r |= {"result_refs": refs, "embedding": semantic.unit([a + b for a, b in zip(r["embedding"], vector, strict=True)])}
        elif refs:
            rows["new"] = {"id": self.new_id(), "result_refs": refs, "embedding": vector, "expires_at_ms": until}
        return {"activations": self._frame("activations", rows.values())} if rows else {}

    def vacuum(self) -> None:
        """Activations whose lease is over go."""
        now = int(self.clock().replace(tzinfo=timezone.utc).timestamp() * 1000)

        def plan(base: int) -> tuple[dict, None]:
            over = self.table("activations", base).filter(F.col("expires_at_ms") < now)
            return ({"activations": over.withColumn("deleted", F.lit(True))} if over.limit(1).count() else {}), None

        self.store.mutate(plan)

    # Changes

    def _frame(self, table: str, rows) -> DataFrame:
        schema = TABLES[table][1]
        names = [x.strip().split(" ", 1)[0] for x in schema.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema).coalesce(1)  # at most a batch

    def _rows(self, table: str, base: int, column: str, keys) -> dict[str, dict]:
        keys = [k for k in keys if k]
        return {r["iri"]: r.asDict() for r in self.table(table, base).filter(F.col(column).isin(*keys)).collect()} if keys else {}

    def _episode(self, tool: str, note: str | None, **more: object) -> dict:
        return {"iri": f"{S.NAMESPACE}:episode/{self.new_id()}", "tool": tool, "at": self.clock(), "note": note} | more

    def _done(self, episode: dict, nodes: dict[str, dict], facts: dict[str, dict]) -> dict[str, DataFrame]:
        """The changes of one episode; none at all if no row changed."""
        if not nodes and not facts:
            return {}
        mirror = {"iri": episode["iri"], "kind": "episode", "name": episode["iri"], "labels": ["Episode"], "layers": [], "weight": 0, "stub": False, "search_text": episode["iri"], "created_at": episode["at"]}
        changes = {"episodes": self._frame("episodes", [episode]), "nodes": self._frame("nodes", [*nodes.values(), mirror])}
        return changes | ({"facts": self._frame("facts", facts.values())} if facts else {})

    def _node_of(self, given: dict) -> dict:
        """The row a node or literal input asks for."""
        if given.get("kind") == "literal":
            value, datatype = given["value"], given.get("datatype") or "xsd:string"
            iri = N.literal_iri(value, datatype)
            return {"iri": iri, "kind": "literal", "name": None, "labels": ["Literal"], "value": value, "datatype": datatype}
        if not given.get("iri") and not (given.get("name") or "").strip():
            raise InvalidInput("a node has an iri or a name")
        labels = list(dict.fromkeys(given.get("labels") or []))
        named = (given.get("name") or "").strip() or None
        kind = (N.kind_of(given["iri"]) if given.get("iri") else None) or ("class" if "Class" in labels else "property" if "Property" in labels else "element")
        iri = given.get("iri") or N.mint_iri(named, kind)
        own = {"class": "Class", "property": "Property", "element": "Element"}.get(kind)
        return {"iri": iri, "kind": kind, "name": named or N.local_name(iri), "labels": list(dict.fromkeys([*([own] if own else []), *labels])), "value": None, "datatype": None}

    def write(self, facts: list[dict], scope: list[str], note: str | None = None) -> dict:
        """Assert facts in order, all or none. What is there already only gains layers."""
        bounded(facts, "facts")
        scope = N.layers(scope)
        return self._suggesting(scope, self.store.mutate(lambda base: self._write(base, facts, scope, note)))

    def _suggesting(self, scope: list[str], answer: dict) -> dict:
        """An answer with the merges (a hundred at most) that its new nodes suggest."""
        found = resolve.suggestions(self.table("nodes"), scope, answer["created"]).collect() if answer["created"] else []
        return answer | {"suggestions": [{"source": x.source, "target": x.target, "similarity": x.similarity} for x in found]}

    def _family(self, base: int, subjects: set[str], properties: set[str], objects: set[str]) -> dict[str, dict]:
        """Current facts that new ones of these subjects and properties can repeat or contradict, and contradictions of the objects."""
        kinds = {N.local_name(p).upper() for p in properties} & set(S.STRUCTURAL)
        same = F.col("s_iri").isin(*subjects) & (F.col("property_iri").isin(*properties) | F.col("type").isin(*kinds))
        known = (F.col("type") == "CONTRADICTS") & F.col("s_iri").isin(*objects)
        return {r["iri"]: r.asDict() for r in self.table("facts", base).filter(F.col("valid_to").isNull() & (same | known)).collect()}

    def _write(self, base: int, items: list[dict], scope: list[str], note: str | None) -> tuple[dict, dict]:
        asked = [(self._node_of(x["s"]), N.mint_iri(x["p"], "property"), self._node_of(x["o"])) for x in items]
        nodes = self._rows("nodes", base, "iri", {i for s, p, o in asked for i in (s["iri"], p, o["iri"])})
        facts = self._family(base, {s["iri"] for s, _, _ in asked}, {p for _, p, _ in asked}, {o["iri"] for _, _, o in asked})
        episode, answers = self._episode("write", note), []
        new_nodes, new_facts, created = {}, {}, []
        for item, (s, prop, o) in zip(items, asked, strict=True):
            answers.append(self._assert(item, s, prop, o, scope, episode, nodes, facts, new_nodes, new_facts, created))
        changes = self._done(episode, new_nodes, new_facts) if any(a["changed"] for a in answers) else {}
        return changes, {"facts": answers, "episode": episode["iri"] if changes else None, "created": created}

    def _ensure(self, row: dict, layers: list[str], nodes: dict, changed: dict, created: list, now: datetime) -> None:
        schema = row["kind"] in ("class", "property")
        old = nodes.get(row["iri"])
        if old is None:
            layers = [] if schema else list(layers)
            text = " ".join(x for x in (row["name"] or "", row["iri"], row["value"] or "")).strip()
            new = row | {"layers": layers, "weight": 0, "stub": False, "search_text": text, "merge_name": (row["name"] or "").lower() or None, "created_at": now}
            created.append(row["iri"])
        else:
            grown = old["layers"] if not old["layers"] else [] if schema or not layers else list(dict.fromkeys([*old["layers"], *layers]))
            new = old | {"labels": list(dict.fromkeys([*old["labels"], *row["labels"]])), "layers": grown, "name": old["name"] or row["name"]}
        if new != old:
            nodes[row["iri"]] = changed[row["iri"]] = new

    def _assert(self, item: dict, s: dict, prop: str, o: dict, scope: list[str], episode: dict, nodes: dict, facts: dict, new_nodes: dict, new_facts: dict, created: list) -> dict:
        if item.get("spike") not in (None, *S.SPIKES):
            raise InvalidInput(f"{item['spike']!r} is no class of facts")
        kind = N.local_name(prop).upper()
        kind = kind if kind in S.STRUCTURAL else "ASSERTS"
        if kind in S.SYSTEM:
            raise PreconditionFailed(f"{kind} is made by the ledger only")
        schema_object = o["kind"] in ("class", "property")
        layers = [] if kind in ("SUBCLASS_OF", "SUBPROPERTY_OF") or (kind == "INSTANCE_OF" and schema_object) or (kind in ("DOMAIN", "RANGE") and s["kind"] in ("class", "property")) else scope
        known, start, end = N.interval(item.get("effective")) if kind == "ASSERTS" else (False, None, None)
        now = episode["at"]
        self._ensure(s, layers, nodes, new_nodes, created, now)
        self._ensure(o, layers, nodes, new_nodes, created, now)
        self._ensure({"iri": prop, "kind": "property", "name": N.local_name(prop), "labels": ["Property"], "value": None, "datatype": None}, [], nodes, new_nodes, created, now)
        conflicts = [f for f in facts.values() if f["valid_to"] is None and f["s_iri"] == s["iri"] and f["type"] == kind and (kind != "ASSERTS" or f["property_iri"] == prop) and f["o_iri"] != o["iri"] and sees(f["layers"], scope) and (kind != "ASSERTS" or self._overlap(f, known, start, end))]
        same = [f for f in facts.values() if f["valid_to"] is None and (f["s_iri"], f["type"], f["o_iri"]) == (s["iri"], kind, o["iri"]) and (kind != "ASSERTS" or (f["property_iri"], bool(f["eff_qualified"]), f["eff_from"], f["eff_to"]) == (prop, known, start, end))]
        if len(same) > 1:
            raise PreconditionFailed("one fact stands there more than once")
        if same:
            old = same[0]
            grown = [] if not old["layers"] or not layers else sorted({*old["layers"], *layers})
            new = old | {"layers": grown, "spike": item.get("spike") or old["spike"]}
            changed = new != old
            new = new | {"layer_episode_id": episode["iri"]} if changed else new
        else:
            text = N.fact_text(s["name"] or s["iri"], prop, o["value"] or o["name"] or o["iri"])
            new = {
                "iri": f"{S.NAMESPACE}:relationship/{self.new_id()}", "type": kind, "property_iri": prop, "s_iri": s["iri"], "o_iri": o["iri"], "layers": list(layers), "weight": 0, "valid_from": now, "valid_to": None,
                "eff_qualified": known, "eff_from": start, "eff_to": end, "episode_id": episode["iri"], "fact_text": text, "spike": item.get("spike"), "reason": item.get("reason"),
            }
            changed = True
        if changed:
            facts[new["iri"]] = new_facts[new["iri"]] = new
        if item.get("contradicts"):
            for other in {f["o_iri"] for f in conflicts}:
                edge = [f for f in facts.values() if (f["s_iri"], f["type"], f["o_iri"]) == (o["iri"], "CONTRADICTS", other)]
                if not edge:
                    made = {"iri": f"{S.NAMESPACE}:relationship/{self.new_id()}", "type": "CONTRADICTS", "property_iri": f"{S.NAMESPACE}:property/CONTRADICTS", "s_iri": o["iri"], "o_iri": other, "layers": list(layers), "weight": 0, "valid_from": now, "eff_qualified": False, "episode_id": episode["iri"], "fact_text": N.fact_text(o["iri"], "CONTRADICTS", other)}
                    facts[made["iri"]] = new_facts[made["iri"]] = made | dict.fromkeys(("valid_to", "spike", "reason", "eff_from", "eff_to"))
        return {"iri": new["iri"], "changed": changed, "conflicts": sorted(f["iri"] for f in conflicts)}

    @staticmethod
    def _overlap(f: dict, known: bool, start: datetime | None, end: datetime | None) -> bool:
        if not known or not f["eff_qualified"]:
            return known == bool(f["eff_qualified"])
        return (end is None or f["eff_from"] is None or f["eff_from"] < end) and (f["eff_to"] is None or start is None or start < f["eff_to"])

    def _fact(self, base: int, iri: str, scope: list[str]) -> dict:
        found = self._rows("facts", base, "iri", [iri])
        if not found:
            raise PreconditionFailed(f"{iri} is not there")
        fact = found[iri]
        if fact["valid_to"] is not None or not sees(fact["layers"], scope):
            raise PreconditionFailed(f"{iri} is no current fact in this scope")
        if not may_change(fact["layers"], scope):
            raise PreconditionFailed(f"{iri} is not this scope's to change")
        return fact

    @staticmethod
    def _take(fact: dict, scope: list[str], now: datetime, episode: str) -> dict:
        rest = [x for x in fact["layers"] if x not in scope]
        return fact | ({"layers": sorted(rest), "layer_episode_id": episode} if rest else {"valid_to": now, "withdrawn_by": episode})

    def revise(self, scope: list[str], target: str, replacement: dict, reason: str | None = None, **more: object) -> dict:
        """Supersede a fact by another object; `effective` left out is inherited, None clears it."""
        scope = N.layers(scope)

        def plan(base: int) -> tuple[dict, dict]:
            old = self._fact(base, target, scope)
            if old["type"] in S.SYSTEM:
                raise PreconditionFailed("the ledger's own facts are not revised")
            episode = self._episode("revise", None)
            o = self._node_of(replacement)
            nodes = self._rows("nodes", base, "iri", {old["s_iri"], old["o_iri"], o["iri"], old["property_iri"]})
            inherited = {"from": old["eff_from"], "to": old["eff_to"]} if old["eff_qualified"] else None
            stamp = lambda x: x and x.isoformat() + "Z"
            effective = more["effective"] if "effective" in more else inherited and {k: stamp(v) for k, v in inherited.items()}
            if o["iri"] == old["o_iri"] and N.interval(effective) == (bool(old["eff_qualified"]), old["eff_from"], old["eff_to"]):
                return {}, {"fact": target, "episode": None, "changed": False, "created": []}
            facts = self._family(base, {old["s_iri"]}, {old["property_iri"]}, {o["iri"]})
            new_nodes: dict = {}
            created: list = []
            taken = self._take(old, scope, episode["at"], episode["iri"])
            facts[target] = taken
            new_facts = {target: taken}
            item = {"effective": effective, "spike": more.get("spike") or old["spike"], "contradicts": more.get("contradicts"), "reason": reason}
            answer = self._assert(item, nodes[old["s_iri"]], old["property_iri"], o, scope, episode, nodes, facts, new_nodes, new_facts, created)
            made = f"{S.NAMESPACE}:relationship/{self.new_id()}"
            new_facts[made] = {"iri": made, "type": "SUPERSEDES", "property_iri": f"{S.NAMESPACE}:property/SUPERSEDES", "s_iri": o["iri"], "o_iri": old["o_iri"], "layers": list(scope), "weight": 0, "valid_from": episode["at"], "eff_qualified": False, "episode_id": episode["iri"], "fact_text": N.fact_text(o["iri"], "SUPERSEDES", old["o_iri"]), "reason": reason}
            episode |= {"previous_fact_iri": target, "replacement_fact_iri": answer["iri"], "supersedes_iri": made, "selected_scope": scope}
            return self._done(episode, new_nodes, new_facts), {"fact": answer["iri"], "episode": episode["iri"], "changed": True, "created": created}

        return self._suggesting(scope, self.store.mutate(plan))

    def withdraw(self, scope: list[str], target: str | None = None, subject: str | None = None, p: str | None = None, reason: str | None = None) -> dict:
        """Take one fact, or all of a subject (and property) that this scope may change, out of the scope."""
        if (target is None) == (subject is None) or (p and not subject):
            raise InvalidInput("either a target, or a subject with or without p")
        scope = N.layers(scope)

        def plan(base: int) -> tuple[dict, dict]:
            episode = self._episode("withdraw", reason)
            if target is not None:
                row = self._take(self._fact(base, target, scope), scope, episode["at"], episode["iri"])
                return self._done(episode, {}, {target: row}), {"changed": 1, "episode": episode["iri"]}
            own = self.table("facts", base).filter(F.col("s_iri") == subject)
            own = own.filter(F.col("property_iri") == N.mint_iri(p, "property")) if p else own
            found = resolve.withdraw_plan(own, scope)  # a subject can have any number of facts
            n = found.count()
            if not n:
                return {}, {"changed": 0, "episode": None}
            at = F.lit(episode["at"]).cast("timestamp_ntz")
            rows = found.withColumns({"layers": F.col("new_layers"), "valid_to": F.when(F.col("retired"), at), "withdrawn_by": F.when(F.col("retired"), F.lit(episode["iri"])), "layer_episode_id": F.when(~F.col("retired"), F.lit(episode["iri"]))})
            return self._done(episode, {}, {}) | {"episodes": self._frame("episodes", [episode]), "facts": rows.drop("retired", "new_layers")}, {"changed": n, "episode": episode["iri"]}

        return self.store.mutate(plan)

    def _targets(self, base: int, iris: list[str], scope: list[str]) -> tuple[dict, dict]:
        if len(set(iris)) != len(iris):
            raise InvalidInput("targets are different")
        facts = self._rows("facts", base, "iri", [x for x in iris if N.kind_of(x) == "relationship"])
        nodes = self._rows("nodes", base, "iri", [x for x in iris if N.kind_of(x) != "relationship"])
        for x in iris:
            row = facts.get(x) or nodes.get(x)
            if row is None or row.get("valid_to") is not None or not sees(row["layers"], scope):
                raise PreconditionFailed(f"{x} is not there in this scope")
        return nodes, facts

    def judge(self, scope: list[str], ratings: list[dict], note: str | None = None) -> dict:
        """One step up or down for each target."""
        bounded(ratings, "ratings")
        scope = N.layers(scope)

        def plan(base: int) -> tuple[dict, dict]:
            iris = [r["target"] for r in ratings]
            nodes, facts = self._targets(base, iris, scope)
            episode = self._episode("judge", note, batch_size=len(iris), target_iris=iris, target_kinds=["fact" if x in facts else "node" for x in iris], modes=[r["mode"] for r in ratings])
            for r in ratings:
                row = facts.get(r["target"]) or nodes.get(r["target"])
                if r["mode"] not in ("strengthen", "weaken"):
                    raise InvalidInput("mode is strengthen or weaken")
                step = 1 if r["mode"] == "strengthen" else -1
                if row["weight"] == (S.LONG_MAX if step > 0 else S.LONG_MIN):
                    raise PreconditionFailed(f"{r['target']} has its last weight")
                row["weight"] += step
                if r["target"] in facts:
                    row["judgment_episode_id"] = episode["iri"]
            return self._done(episode, nodes, facts), {"episode": episode["iri"], "weights": {x: (facts.get(x) or nodes[x])["weight"] for x in iris}}

        return self.store.mutate(plan)

    def place(self, scope: list[str], edits: list[dict]) -> dict:
        """Change layers; afterwards every current fact must still be seen with both its ends."""
        bounded(edits, "edits")
        scope = N.layers(scope)

        def plan(base: int) -> tuple[dict, dict]:
            iris = [e["target"] for e in edits]
            nodes, facts = self._targets(base, iris, scope)
            changed = {}
            for e in edits:
                add, remove = N.layers(e.get("add") or []), N.layers(e.get("remove") or [])
                if set(add) & set(remove) or not (add or remove):
                    raise InvalidInput("add or remove something, and nothing both ways")
                row = facts.get(e["target"]) or nodes[e["target"]]
                if set(row.get("labels") or []) & CATALOG or row.get("type") in S.SCHEMA:
                    raise PreconditionFailed("the schema is global")
                after = sorted((set(row["layers"]) - set(remove)) | set(add))
                if after != row["layers"]:
                    row["layers"] = changed[e["target"]] = after
            if not changed:
                return {}, {"episode": None, "layers": {}}
            nodes, facts = ({k: v for k, v in x.items() if k in changed} for x in (nodes, facts))
            every_node, every_fact = self.table("nodes", base), self.table("facts", base)
            touched = every_fact.filter(F.col("iri").isin(*facts) | F.col("s_iri").isin(*nodes) | F.col("o_iri").isin(*nodes)) if nodes or facts else every_fact.limit(0)
            after = lambda df, rows: df.join(self.spark.createDataFrame([(k, v["layers"]) for k, v in rows.items()], "iri string, after array<string>"), "iri", "left").withColumn("layers", F.coalesce("after", "layers")).drop("after")
            if resolve.violations(after(touched, facts), after(every_node, nodes)).limit(1).count():
                raise PreconditionFailed("a fact would be seen without one of its ends")
            episode = self._episode("place", None, batch_size=len(iris), target_iris=iris)
            return self._done(episode, nodes, facts), {"episode": episode["iri"], "layers": changed}

        return self.store.mutate(plan)

    def unify(self, source: str, target: str) -> dict:
        """The source becomes the target: facts move, and those that then say the same become one."""
        if source == target:
            raise InvalidInput("two different nodes")
        structural = [x if (x := N.local_name(i).upper()) in S.STRUCTURAL else None for i in (source, target)]
        if source in {f"{S.NAMESPACE}:class/{x}" for x in S.SEED_CLASSES} | {f"{S.NAMESPACE}:property/{x}" for x in S.SEED_PROPERTIES}:
            raise PreconditionFailed("what every ledger has stays")

        def plan(base: int) -> tuple[dict, dict]:
            nodes, facts = self.table("nodes", base), self.table("facts", base)
            pair = self._rows("nodes", base, "iri", [source, target])
            if len(pair) < 2:
                raise PreconditionFailed("both nodes must be there")
            if any(set(r["labels"]) & set(S.FORBIDDEN_MERGE_LABELS) for r in pair.values()):
                raise InvalidInput("literals, episodes and the ledger's own nodes are not merged")
            kinds = {N.kind_from_labels(r["labels"]) for r in pair.values()}
            if len(kinds) != 1 or None in kinds:
                raise InvalidInput("both nodes have the same kind: class, property or element")
            if kinds == {"property"} and (set(structural) & set(S.SYSTEM) or structural[0] != structural[1]):
                raise InvalidInput("properties of the ledger's own, or of another structural type, are not merged")
            episode = self._episode("unify", None, target_iris=[source, target])
            now, by = F.lit(episode["at"]).cast("timestamp_ntz"), F.lit(episode["iri"])
            prop = kinds == {"property"}
            pairs = self.spark.createDataFrame([(source, target)], "source string, target string")
            ends = ["s_iri", "o_iri", *(["property_iri"] if prop else [])]
            near = F.lit(False)
            for c in ends:
                near = near | F.col(c).isin(source, target)
            usable = facts.filter(F.col("valid_to").isNull() & near)
            between = usable.filter(F.col("s_iri").isin(source, target) & F.col("o_iri").isin(source, target) & (F.col("s_iri") != F.col("o_iri")))
            moved = resolve.remap(usable, pairs, prop).drop("moved")
            whole = resolve.consolidate(moved)
            merged = whole.select("iri", F.col("layers").alias("l"), F.col("weight").alias("w"), F.col("provenance_episode_ids").alias("pe"))
            name = lambda side: nodes.select(F.col("iri").alias(f"{side}_iri"), F.coalesce("value", "name", "iri").alias(f"{side}_name"))
            kept = moved.join(merged, "iri").join(name("s"), "s_iri").join(name("o"), "o_iri").withColumns({"layers": F.col("l"), "weight": F.col("w"), "merge_episode_id": by, "provenance_episode_ids": F.col("pe"), "fact_text": E.fact_text(F.col("s_name"), F.col("property_iri"), F.col("o_name"), False)})
            lost = resolve.survivors(moved, whole).filter("iri <> into").withColumns({"valid_to": now, "merged_into": F.col("into"), "merge_episode_id": by})
            cols = facts.columns
            rows = kept.select(*cols).unionByName(lost.select(*cols)).unionByName(between.withColumns({"valid_to": now, "merge_episode_id": by}).select(*cols))
            joined = resolve.unify_nodes(nodes.filter(F.col("iri").isin(source, target)), pairs).select("iri", F.col("layers").alias("l"), F.col("weight").alias("w"))
            after = nodes.join(joined, "iri").withColumns({"layers": F.col("l"), "weight": F.col("w"), "deleted": F.lit(False)}).drop("l", "w")
            gone = nodes.filter(F.col("iri") == source).withColumn("deleted", F.lit(True))
            return {"nodes": after.unionByName(gone), "facts": rows, "episodes": self._frame("episodes", [episode])}, {"episode": episode["iri"]}

        return self.store.mutate(plan)

    def suggestions(self, scope: list[str], created: list[str]) -> DataFrame:
        """Which older nodes the ones just created may repeat."""
        return resolve.suggestions(self.table("nodes"), N.layers(scope), created)

    def visible(self, scope: list[str], effective_at: str | None = None) -> DataFrame:
        """Every visible current fact."""
        at = str(N.instant(effective_at)) if effective_at else None
        return triples.closed(triples.current(self.table("facts"), N.layers(scope), at), self.table("nodes"), N.layers(scope))
