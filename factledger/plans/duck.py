"""The ledger queries as DuckDB SQL, and the parameters both sides share."""

from __future__ import annotations

from factledger import schema as S
from factledger.operators.search import channels, query_keywords

SCOPE = ("market:building",)
EVERY = ("market:automobile", "market:building", "market:furniture", "market:household", "market:machinery")
AT = "1998-06-01 00:00:00"
IRIS = ["kg:element/nation-3", "kg:element/missing", "kg:element/part-7", "kg:element/customer-5", "kg:element/order-44"]
NODE, FACT, ANCHOR = "kg:element/order-11", "kg:relationship/ob-11", "kg:relationship/ob-3"
TEXT, PHRASE = "which order is placedBy Customer#000000005", "order 44"
CREATED = [f"kg:element/supplier-{i}" for i in range(20)]
LIKE, CONVERGE = 150, 0.6
START = "kg:element/customer-5"
WALKS: dict[str, dict] = {
    "recall_around_d1": {"start": START, "depth": 1},
    "recall_around_d2": {"start": START, "depth": 2},
    "recall_around_d3": {"start": START, "depth": 3},
    "recall_around_outgoing": {"start": START, "depth": 2, "direction": "outgoing"},
    "recall_around_incoming": {"start": START, "depth": 2, "direction": "incoming"},
    "recall_around_predicate": {"start": START, "depth": 3, "predicates": ("kg:property/placedBy", "kg:property/containsPart")},
    "recall_around_as_of": {"start": START, "depth": 3, "at": AT},
}

BASE = """
oc AS (SELECT o.*, c_name, CASE WHEN c_custkey % 5 = 0 THEN []::VARCHAR[] ELSE ['market:' || lower(c_mktsegment)] END AS layers,
  'kg:element/order-' || o_orderkey AS o_iri0, 'kg:element/customer-' || o_custkey AS c_iri, 'order ' || o_orderkey AS o_name FROM orders o JOIN customer ON o_custkey = c_custkey),
n0 AS (
  SELECT 'kg:' || kind || '/' || name AS iri, kind, name, [label] AS labels, NULL::VARCHAR AS value, []::VARCHAR[] AS layers, 0::BIGINT AS weight
    FROM (SELECT 'class' AS kind, 'Class' AS label, unnest(['Class', 'Property', 'Element']) AS name UNION ALL
          SELECT 'property', 'Property', unnest(['INSTANCE_OF', 'SUBCLASS_OF', 'SUBPROPERTY_OF', 'DOMAIN', 'RANGE', 'ABOUT', 'EVIDENCE_FOR', 'DERIVED_FROM', 'SUPPORTS', 'CONTRADICTS', 'SUPERSEDES', 'placedBy', 'hasStatus', 'containsPart', 'locatedIn']))
  UNION ALL SELECT 'kg:element/region-' || r_regionkey, 'element', r_name, ['Element', 'Region'], NULL, [], r_regionkey FROM region
  UNION ALL SELECT 'kg:element/nation-' || n_nationkey, 'element', n_name, ['Element', 'Nation'], NULL, [], n_nationkey % 7 - 3 FROM nation
  UNION ALL SELECT 'kg:element/customer-' || c_custkey, 'element', c_name, ['Element', 'Customer'], NULL, CASE WHEN c_custkey % 5 = 0 THEN [] ELSE ['market:' || lower(c_mktsegment)] END, c_custkey % 17 - 8 FROM customer
  UNION ALL SELECT 'kg:element/supplier-' || s_suppkey, 'element', s_name, ['Element', 'Supplier'], NULL, [], s_suppkey % 11 - 5 FROM supplier
  UNION ALL SELECT 'kg:element/part-' || p_partkey, 'element', p_name, ['Element', 'Part'], NULL, [], p_partkey % 13 - 6 FROM part
  UNION ALL SELECT o_iri0, 'element', o_name, ['Element', 'Order'], NULL, layers, o_orderkey % 17 FROM oc
  UNION ALL SELECT 'kg:literal/' || lower(v) || '-' || substr(sha256('xsd:string:' || v), 1, 12), 'literal', NULL, ['Literal'], v, [], 0 FROM (SELECT DISTINCT o_orderstatus AS v FROM orders)
  UNION ALL SELECT 'kg:element/document-' || doc_id, 'element', 'document ' || doc_id, ['Element', 'Document'], NULL, [], 0 FROM documents),
nodes AS (SELECT *, trim(concat_ws(' ', coalesce(name, ''), iri, coalesce(value, ''))) AS search_text FROM n0),
f0 AS (
  SELECT 'ob-' || o_orderkey AS k, 'ASSERTS' AS type, 'placedBy' AS p, o_iri0 AS s_iri, c_iri AS o_iri, layers, (o_orderkey % 13 - 6)::BIGINT AS weight, o_orderdate::TIMESTAMP AS valid_from,
    CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL 30 DAY END::TIMESTAMP AS valid_to, o_orderkey % 4 <> 0 AS eff_qualified,
    CASE WHEN o_orderkey % 4 IN (1, 2) THEN o_orderdate END::TIMESTAMP AS eff_from, CASE WHEN o_orderkey % 4 IN (2, 3) THEN o_orderdate + to_days((o_orderkey % 400 + 1)::INTEGER) END::TIMESTAMP AS eff_to,
    o_name AS sn, c_name AS "on", CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Knowledge' WHEN '2' THEN 'Insight' WHEN '3' THEN 'Pattern' WHEN '4' THEN 'Signal' END AS spike FROM oc
  UNION ALL SELECT 'os-' || o_orderkey, 'ASSERTS', 'hasStatus', o_iri0, 'kg:literal/' || lower(o_orderstatus) || '-' || substr(sha256('xsd:string:' || o_orderstatus), 1, 12), layers, o_orderkey % 5 - 2, o_orderdate, NULL, false, NULL, NULL, o_name, o_orderstatus, NULL FROM oc
  UNION ALL SELECT 'op-' || o_orderkey || '-' || l_partkey, 'ASSERTS', 'containsPart', o_iri0, 'kg:element/part-' || l_partkey, layers, n, o_orderdate, NULL, true, a, b + INTERVAL 1 DAY, o_name, p_name, NULL
    FROM (SELECT l_orderkey, l_partkey, count(*) AS n, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1, 2) JOIN oc ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT 'cn-' || c_custkey, 'ASSERTS', 'locatedIn', 'kg:element/customer-' || c_custkey, 'kg:element/nation-' || c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN [] ELSE ['market:' || lower(c_mktsegment)] END, 0, NULL, NULL, false, NULL, NULL, c_name, n_name, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'sn-' || s_suppkey, 'ASSERTS', 'locatedIn', 'kg:element/supplier-' || s_suppkey, 'kg:element/nation-' || s_nationkey, [], 0, NULL, NULL, false, NULL, NULL, s_name, n_name, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'nr-' || n_nationkey, 'SUPPORTS', 'SUPPORTS', 'kg:element/nation-' || n_nationkey, 'kg:element/region-' || n_regionkey, [], 0, NULL, NULL, false, NULL, NULL, n_name, r_name, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'da-' || doc_id, 'ABOUT', 'ABOUT', 'kg:element/document-' || doc_id, o_iri0, layers, quality - toxic, NULL, NULL, false, NULL, NULL, 'document ' || doc_id, o_name,
      CASE WHEN quality = 1 AND toxic <> 1 THEN 'Knowledge' WHEN quality = 1 THEN 'Insight' WHEN toxic <> 1 THEN 'Signal' END
    FROM documents JOIN labels USING (doc_id) JOIN oc ON doc_id % (SELECT count(*) FROM orders) = o_orderkey
  UNION ALL SELECT 'obr-' || o_orderkey, 'ASSERTS', 'placedBy', o_iri0, c_iri, layers, 0, o_orderdate + INTERVAL 30 DAY, NULL, true, o_orderdate + INTERVAL 30 DAY, NULL, o_name, c_name,
      CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Knowledge' WHEN '2' THEN 'Insight' WHEN '3' THEN 'Pattern' WHEN '4' THEN 'Signal' END FROM oc WHERE o_orderkey % 11 = 0
  UNION ALL SELECT 'sup-' || o_custkey, 'SUPERSEDES', 'SUPERSEDES', c_iri, c_iri, layers, 0, NULL, NULL, false, NULL, NULL, c_name, c_name, NULL FROM (SELECT DISTINCT o_custkey, c_iri, c_name, layers FROM oc WHERE o_orderkey % 11 = 0)),
facts AS (SELECT 'kg:relationship/' || k AS iri, type, 'kg:property/' || p AS property_iri, s_iri, o_iri, layers, weight, valid_from, valid_to, eff_qualified, eff_from, eff_to, spike,
  concat_ws(' ', sn, p, "on") || CASE WHEN regexp_replace(p, '([a-z])([A-Z])', '\\1 \\2', 'g') <> p THEN ' ' || regexp_replace(p, '([a-z])([A-Z])', '\\1 \\2', 'g') ELSE '' END AS fact_text FROM f0),
episodes AS (SELECT 'kg:episode/revise-' || o_orderkey AS iri, (o_orderdate + INTERVAL 30 DAY)::TIMESTAMP AS at, 'kg:relationship/ob-' || o_orderkey AS previous_fact_iri, 'kg:relationship/obr-' || o_orderkey AS replacement_fact_iri,
  'kg:relationship/sup-' || o_custkey AS supersedes_iri, layers AS selected_scope FROM oc WHERE o_orderkey % 11 = 0)"""

ACTIVATIONS = """
unit0 AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
q0 AS (SELECT i, sum(e[i]) AS x FROM unit0, (SELECT unnest(generate_series(1, (SELECT max(len(e)) FROM unit0))) AS i) WHERE vec_id IN (7, 150, 160) GROUP BY i),
q AS (SELECT list(x ORDER BY i) AS v FROM q0),
act AS (SELECT 'act-' || vec_id AS id, ['kg:relationship/ob-' || vec_id, 'kg:relationship/os-' || vec_id, 'kg:relationship/missing-' || vec_id] AS refs, 1700000000000 + vec_id % 200 * 1000 AS expires_at_ms,
  (list_cosine_similarity(e, v) + 1) / 2 AS similarity FROM unit0, q),
near AS (SELECT * FROM act ORDER BY similarity DESC, id LIMIT 10),
live AS (SELECT * FROM near WHERE expires_at_ms >= 1700000100000 AND similarity >= 0.65)"""


def lst(values: list | tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def inside(values: list | tuple) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def vis(column: str, scope: tuple) -> str:
    return f"(len({column}) = 0 OR list_has_any({column}, {lst(scope)}))"


def as_of(at: str | None, lenient: bool = False) -> str:
    if at is None:
        return "true"
    holds = f"(eff_qualified AND (eff_from IS NULL OR eff_from <= TIMESTAMP '{at}') AND (eff_to IS NULL OR TIMESTAMP '{at}' < eff_to))"
    return f"(type <> 'ASSERTS' OR {holds})" if lenient else holds


def current(scope: tuple, at: str | None = None, lenient: bool = False, types: tuple = (), predicates: tuple = ()) -> str:
    more = (f" AND type IN {inside(types)}" if types else "") + (f" AND property_iri IN {inside(predicates)}" if predicates else "")
    return f"valid_to IS NULL AND {vis('layers', scope)} AND {as_of(at, lenient)}{more}"


def closed(source: str, scope: tuple) -> str:
    ends = ", ".join(f"{x}.{c} AS {x}_{c}" for x in "so" for c in ("labels", "layers", "weight"))
    return f"SELECT f.*, {ends} FROM {source} f JOIN nodes s ON f.s_iri = s.iri AND {vis('s.layers', scope)} JOIN nodes o ON f.o_iri = o.iri AND {vis('o.layers', scope)}"


def text(column: str) -> str:
    return f"array_to_string({column}, ',') AS {column}"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


SPIKE = "CASE spike WHEN 'Knowledge' THEN 4 WHEN 'Insight' THEN 3 WHEN 'Pattern' THEN 2 WHEN 'Signal' THEN 1 ELSE 0 END"
ADD = "least({1}, greatest({0}, {{}}::HUGEINT + {{}}::HUGEINT))::BIGINT".format(*(f"{x}::HUGEINT" for x in (S.LONG_MIN, S.LONG_MAX)))
WEIGHT = ADD.format(ADD.format("s_weight", "weight"), "o_weight")


def ranked(scope: tuple, limit: int, at: str | None = None, labels: tuple = (), candidates: str = "") -> str:
    """CTEs that end in `hits`."""
    where = f" WHERE list_has_any(s_labels, {lst(labels)}) OR list_has_any(o_labels, {lst(labels)})" if labels else ""
    join, score = ("JOIN cand USING (iri)", "score, exact, matched, evidence") if candidates else ("", "1.0::DOUBLE AS score")
    order = "spike_rank DESC, effective_weight DESC, score DESC, s_iri, property_iri, o_iri, iri"
    return f"""{candidates}
ab0 AS (SELECT * FROM facts WHERE {current(scope, types=("ABOUT",))} AND spike IS NOT NULL), ab AS ({closed("ab0", scope)}),
att AS (SELECT o_iri AS s_iri, max({SPIKE}) AS attached FROM ab GROUP BY 1),
c0 AS (SELECT * FROM facts WHERE {current(scope, at, types=("ASSERTS",))}), c1 AS ({closed("c0", scope)}),
c2 AS (SELECT c1.*, {score}, {WEIGHT} AS effective_weight, (CASE WHEN {SPIKE} > 0 THEN {SPIKE} ELSE coalesce(attached, 0) END)::BIGINT AS spike_rank FROM c1 {join} LEFT JOIN att USING (s_iri){where}),
hits AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM c2 ORDER BY {order} LIMIT {limit})"""


RANKED = "SELECT rank, iri, s_iri, property_iri, o_iri, effective_weight, spike_rank, round(score, 6) AS score FROM hits"


def tokens(column: str) -> str:
    return f"regexp_extract_all(lower(regexp_replace({column}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[\\p{{L}}\\p{{N}}]+')"


def scored(name: str, source: str, phrase: list[str], keywords: list[str]) -> str:
    asked = list(dict.fromkeys([*phrase, *keywords]))
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{a}'))::DOUBLE AS tf{i}" for i, a in enumerate(asked))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS df{i}" for i in range(len(asked)))

    def bm25(own: list[str]) -> str:
        parts = [f"ln(1.0::DOUBLE + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * {S.BM25_K1 + 1}::DOUBLE / (tf{i} + {S.BM25_K1}::DOUBLE * ({1 - S.BM25_B}::DOUBLE + {S.BM25_B}::DOUBLE * len(t) / mean))" for i in (asked.index(x) for x in own)]
        return ' + '.join(parts) or '0.0::DOUBLE'

    exact = f"contains(' ' || array_to_string(t, ' ') || ' ', ' {' '.join(phrase)} ')" if phrase else "false"
    return f"""{name}_t AS (SELECT *, {tf} FROM {source}), {name}_s AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean, {df} FROM {name}_t),
{name}_b AS (SELECT *, {exact} AS hit, {bm25(list(dict.fromkeys(phrase)))} AS ps, {bm25(keywords)} AS ks FROM {name}_t, {name}_s WHERE {exact} OR list_has_any(t, {lst(keywords)})),
{name} AS (SELECT *, greatest(CASE WHEN hit THEN {S.EXACT_WEIGHT} * ps ELSE 0 END, {S.KEYWORD_WEIGHT} * ks)::DOUBLE AS sc FROM {name}_b)"""


def candidates(asked: str) -> str:
    phrase, keywords = channels(asked)
    kw = query_keywords(asked)
    cover = f"len(list_intersect({lst(kw)}, list_distinct(t)))::DOUBLE / {len(kw)}" if kw else "0.0::DOUBLE"
    return f"""
nt AS (SELECT iri, {tokens("search_text")} AS t FROM nodes), {scored("ns", "nt", phrase, keywords)},
ft AS (SELECT iri, {tokens("fact_text")} AS t FROM facts WHERE type IN {inside(S.SEARCHABLE)}), {scored("fs", "ft", phrase, keywords)},
half0 AS (SELECT iri, s_iri AS v FROM facts UNION ALL SELECT iri, o_iri FROM facts WHERE s_iri <> o_iri),
each0 AS (SELECT h.iri, 0.0::DOUBLE AS fsc, 0 AS exact, ns.sc AS esc, 0.0::DOUBLE AS cov FROM half0 h JOIN ns ON h.v = ns.iri
  UNION ALL SELECT iri, sc, hit::INTEGER, 0.0, {cover} FROM fs
  UNION ALL SELECT f.iri, 1.0, 1, 0.0, 0.0 FROM facts f JOIN nodes p ON f.property_iri = p.iri WHERE valid_to IS NULL AND type = 'ASSERTS' AND list_contains(p.labels, 'Property') AND (lower(p.name) = lower('{asked}') OR p.iri = '{asked}' OR ends_with(p.iri, '/{asked}'))),
best0 AS (SELECT iri, max(fsc) AS fsc, max(exact) AS exact, max(esc) AS esc, max(cov) AS cov FROM each0 GROUP BY 1),
cand AS (SELECT iri, CASE WHEN fsc > 0 THEN fsc ELSE esc END AS score, exact, fsc > 0 AS matched, CASE WHEN exact = 1 THEN 1.0 ELSE cov END::DOUBLE AS evidence FROM best0),"""


def around(start: str, depth: int, direction: str = "both", predicates: tuple = (), at: str | None = None) -> str:
    out, back = "SELECT iri, s_iri AS v, o_iri AS other FROM e", "SELECT iri, o_iri AS v, s_iri AS other FROM e"
    half = {"outgoing": out, "incoming": back, "both": f"{out} UNION ALL {back} WHERE s_iri <> o_iri"}[direction]
    steps = [f"p1 AS (SELECT other AS tail, [v, other] AS pn, [iri] AS pe, coalesce(hub, 0) AS hc FROM h LEFT JOIN hubs ON hubs.x = other WHERE v = '{start}')"]
    for i in range(2, depth + 1):
        steps.append(f"p{i} AS (SELECT other AS tail, list_append(pn, other) AS pn, list_append(pe, iri) AS pe, hc + coalesce(hub, 0) AS hc FROM p{i - 1} JOIN h ON v = tail LEFT JOIN hubs ON hubs.x = other WHERE NOT list_contains(pe, iri))")
    every = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, depth + 1))
    order = "route_cost, hub_count, distance, path_nodes, path_edges"
    return f"""e0 AS (SELECT * FROM facts WHERE {current(SCOPE, at, True, S.WALKABLE, predicates)}), e AS ({closed("e0", SCOPE)}), h AS ({half}),
hubs AS (SELECT v AS x, 1 AS hub FROM h GROUP BY 1 HAVING count(*) > {S.HUB_DEGREE}), {", ".join(steps)},
paths AS (SELECT len(pe) + hc AS route_cost, hc AS hub_count, len(pe) AS distance, pn AS path_nodes, pe AS path_edges FROM ({every})),
x AS (SELECT *, unnest(path_edges) AS iri FROM paths), w AS (SELECT *, row_number() OVER (PARTITION BY iri ORDER BY {order}) AS n FROM x),
r AS (SELECT w.*, s_iri, o_iri, row_number() OVER (ORDER BY {order}, s_iri, property_iri, o_iri, iri) AS rank FROM (SELECT * FROM w WHERE n = 1) w JOIN e USING (iri))
SELECT rank, iri, s_iri, o_iri, route_cost::BIGINT AS route_cost, hub_count::BIGINT AS hub_count, distance::BIGINT AS distance, {text("path_nodes")}, {text("path_edges")} FROM r WHERE rank <= 100"""


ONCE = f"""named AS (SELECT DISTINCT unnest([previous_fact_iri, replacement_fact_iri]) AS iri FROM episodes WHERE {vis("selected_scope", EVERY)}),
once AS (SELECT * FROM facts WHERE {vis("layers", EVERY)} OR iri IN (SELECT iri FROM named))"""
UNPROTECTED = "type NOT IN ('ABOUT', 'CONTRADICTS', 'SUPERSEDES')"


def history(where: str, limit: int) -> str:
    order = "valid_to IS NULL DESC, valid_to DESC NULLS LAST, iri"
    return f"""{ONCE}, h0 AS (SELECT * FROM once WHERE {UNPROTECTED} AND {where}), h AS ({closed("h0", EVERY)})
SELECT row_number() OVER (ORDER BY {order}) AS rank, iri, s_iri, o_iri, valid_to IS NULL AS current, {stamp("valid_from")}, {stamp("valid_to")} FROM h ORDER BY {order} LIMIT {limit}"""


def revisions(own: str, limit: int) -> str:
    return f"""own AS ({own}), ev AS (SELECT * FROM episodes WHERE {vis("selected_scope", EVERY)} AND (previous_fact_iri IN (SELECT iri FROM own) OR replacement_fact_iri IN (SELECT iri FROM own))
  AND previous_fact_iri IN (SELECT iri FROM facts) AND replacement_fact_iri IN (SELECT iri FROM facts) AND supersedes_iri IN (SELECT iri FROM facts WHERE type = 'SUPERSEDES'))
SELECT row_number() OVER (ORDER BY ev.at DESC, iri) AS rank, iri, strftime(ev.at, '%Y-%m-%d %H:%M:%S') AS at, previous_fact_iri, replacement_fact_iri, supersedes_iri FROM ev ORDER BY ev.at DESC, iri LIMIT {limit}"""


DIRECT = f"""d0 AS (SELECT iri, exact, evidence, rank, CASE WHEN exact = 1 THEN {S.DIRECT_WEIGHT} ELSE {S.FALLBACK_WEIGHT} * evidence END AS w FROM hits WHERE matched),
direct AS (SELECT iri, w / ({S.RRF_K} + row_number() OVER (ORDER BY rank)) AS contribution, exact = 1 OR evidence >= 1 AS eligible FROM d0 WHERE w > 0)"""
LEARNED = f"""k0 AS (SELECT * FROM facts WHERE {current(EVERY, types=("ASSERTS",))}), known AS ({closed("k0", EVERY)}),
refs AS (SELECT id, similarity, unnest(refs) AS iri, generate_subscripts(refs, 1) - 1 AS place FROM live),
learned AS (SELECT iri, max({S.FALLBACK_WEIGHT} * least(1, greatest(0, (similarity - {S.RECALL_FLOOR}) / (1 - {S.RECALL_FLOOR}))) / ({S.RRF_K} + place + 1)) AS learned FROM refs WHERE iri IN (SELECT iri FROM known) GROUP BY 1)"""
STRUCTURAL = f"""pairs AS (SELECT DISTINCT k.iri AS anchor, anchor_score, unnest([s_iri, o_iri]) AS v FROM known k JOIN anchors USING (iri)),
hk AS (SELECT iri, s_iri AS v, property_iri FROM known UNION ALL SELECT iri, o_iri, property_iri FROM known WHERE s_iri <> o_iri),
hp AS (SELECT hk.iri, hk.v, property_iri, anchor, anchor_score, count(*) OVER (PARTITION BY anchor, v) AS degree, row_number() OVER (PARTITION BY anchor, v ORDER BY hk.iri) AS n FROM hk JOIN pairs USING (v) WHERE hk.iri <> anchor),
u AS (SELECT anchor, anchor_score, iri, property_iri, min(degree) AS degree FROM hp WHERE n <= {S.PER_ENDPOINT} GROUP BY ALL),
us AS (SELECT iri, anchor_score * {S.STRUCTURAL_SCALE} / sqrt(greatest(degree, 1)::DOUBLE) / sqrt((count(*) OVER (PARTITION BY anchor, property_iri))::DOUBLE) AS score FROM u),
struct AS (SELECT iri, max(score) AS score FROM us GROUP BY 1)"""


def fused(limit: int) -> str:
    return f"""{ranked(EVERY, S.MAX_LIMIT, candidates=candidates(PHRASE))}, {DIRECT}, {ACTIVATIONS}, {LEARNED},
both0 AS (SELECT coalesce(d.iri, l.iri) AS iri, contribution, learned, coalesce(contribution, 0) + coalesce(learned, 0) AS fused, contribution IS NOT NULL AS is_direct, coalesce(eligible, false) AS eligible FROM direct d FULL JOIN learned l ON d.iri = l.iri),
anchors AS (SELECT iri, greatest(CASE WHEN eligible THEN contribution END, learned) AS anchor_score FROM both0 WHERE anchor_score IS NOT NULL ORDER BY anchor_score DESC, iri LIMIT {S.ANCHORS}), {STRUCTURAL},
ev0 AS (SELECT iri, fused, is_direct, eligible FROM both0 UNION ALL SELECT iri, score, false, false FROM struct WHERE iri NOT IN (SELECT iri FROM both0)),
ev1 AS (SELECT iri, fused, is_direct, eligible FROM ev0),
fused AS (SELECT *, row_number() OVER (ORDER BY fused DESC, is_direct DESC, iri) AS rank FROM ev1 ORDER BY rank LIMIT {limit})"""


CUSTOMER_LAYERS = f"CASE WHEN list_contains(labels, 'Customer') THEN {lst(SCOPE)} ELSE layers END"


def consolidated(source: str) -> str:
    return f"""SELECT min(iri) AS iri, s_iri, property_iri, o_iri, CASE WHEN bool_or(len(layers) = 0) THEN '' ELSE array_to_string(list_sort(list_distinct(flatten(list(layers)))), ',') END AS layers,
  list_reduce(list_prepend(0::HUGEINT, list(weight::HUGEINT ORDER BY iri)), lambda a, b: least({S.LONG_MAX}::HUGEINT, greatest(-{S.LONG_MAX}::HUGEINT - 1, a + b)))::BIGINT AS weight, count(*) AS members FROM {source} GROUP BY s_iri, type, property_iri, o_iri, eff_qualified, eff_from, eff_to"""


PARTS = "pairs AS (SELECT 'kg:element/part-' || p_partkey AS source, 'kg:element/part-' || low AS target FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS low FROM part) WHERE p_partkey <> low)"


def remapped(where: str) -> str:
    return f"""m0 AS (SELECT f.* EXCLUDE (s_iri, o_iri), coalesce(a.target, s_iri) AS s_iri, coalesce(b.target, o_iri) AS o_iri, s_iri = o_iri AS was_loop FROM facts f LEFT JOIN pairs a ON s_iri = a.source LEFT JOIN pairs b ON o_iri = b.source WHERE valid_to IS NULL),
m AS (SELECT * FROM m0 WHERE (s_iri <> o_iri OR was_loop) AND {where})"""


def slug(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed')"


def one(ctes: str, select: str) -> str:
    return f"WITH {BASE.strip()}{', ' + ctes if ctes else ''}\n{select}"


def suggested(created: str) -> str:
    """s(source, target, similarity) for new nodes that fulfil a condition on `iri` or `labels`."""
    return f"""c AS (SELECT iri, labels, lower(name) AS low, name, CASE WHEN list_contains(labels, 'Class') THEN 'Class' WHEN list_contains(labels, 'Property') THEN 'Property' WHEN list_contains(labels, 'Element') THEN 'Element' END AS kind, layers, {created} AS new FROM nodes WHERE name IS NOT NULL),
p AS (SELECT n.iri AS ni, n.name AS nn, o.iri AS oi, o.name AS "on", o.new, n.kind, levenshtein(n.low, o.low) AS d, 1 - levenshtein(n.low, o.low)::DOUBLE / greatest(length(n.low), length(o.low)) AS similarity
  FROM c n JOIN c o ON n.kind = o.kind AND n.iri <> o.iri AND abs(length(n.name) - length(o.name)) <= 2 WHERE n.new AND {vis("o.layers", EVERY)}),
a AS (SELECT *, row_number() OVER (PARTITION BY ni ORDER BY similarity DESC, length("on"), oi) AS n FROM p WHERE d <= CASE WHEN least(length(nn), length("on")) < 3 THEN 0 WHEN least(length(nn), length("on")) < 5 THEN 1 ELSE 2 END AND similarity >= CASE WHEN kind = 'Property' THEN {S.PROPERTY_MERGE_FLOOR} ELSE {S.MERGE_FLOOR} END),
t AS (SELECT *, length(nn) < length("on") OR (length(nn) = length("on") AND new AND ni < oi) AS onto FROM a WHERE n <= {S.SUGGESTIONS}),
s AS (SELECT DISTINCT CASE WHEN onto THEN oi ELSE ni END AS source, CASE WHEN onto THEN ni ELSE oi END AS target, similarity FROM t)"""


def oracles() -> dict[str, str]:
    seen = lambda scope, *a: one(f"a AS (SELECT * FROM facts WHERE {current(scope, *a)}), b AS ({closed('a', scope)})", f"SELECT iri, type, s_iri, o_iri, {text('layers')}, weight FROM b")
    looked = lambda limit, at: one(
        f"""a AS (SELECT * FROM facts WHERE {current(SCOPE, at, True)} AND type <> 'ABOUT'), b AS ({closed("a", SCOPE)}), h AS (SELECT *, s_iri AS v FROM b UNION ALL SELECT *, o_iri FROM b WHERE s_iri <> o_iri),
i AS (SELECT unnest({lst(IRIS)}) AS v, generate_subscripts({lst(IRIS)}, 1) - 1 AS position), j AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY s_iri, property_iri, o_iri, iri) AS n, count(*) OVER (PARTITION BY position) > {limit} AS truncated FROM h JOIN i USING (v))""",
        f"SELECT position, n, iri, s_iri, property_iri, o_iri, truncated FROM j WHERE n <= {limit}",
    )
    order_about = "spike_rank DESC, effective_weight DESC, o_iri, s_iri, iri"
    asked = lst(EVERY[:2])
    out = {
        "visible_facts_scope": seen(SCOPE),
        "visible_facts_global": seen(()),
        "state_as_of": seen(EVERY, AT),
        "state_as_of_lenient": seen(EVERY, AT, True),
        "recall_labels": one(ranked(SCOPE, 20, labels=("Order",)), RANKED),
        "recall_labels_as_of": one(ranked(EVERY, 50, AT, ("Customer", "Part")), RANKED),
        "recall_catalog": one("", "SELECT row_number() OVER (ORDER BY CASE WHEN list_contains(labels, 'Class') THEN 0 ELSE 1 END, name, iri) AS rank, iri, name, kind FROM nodes WHERE list_has_any(labels, ['Class', 'Property'])"),
        "recall_iris": one(f"i AS (SELECT unnest({lst(IRIS)}) AS iri, generate_subscripts({lst(IRIS)}, 1) - 1 AS position), n AS (SELECT * FROM nodes WHERE {vis('layers', SCOPE)})", f"SELECT position, i.iri, n.iri IS NOT NULL AS found, name, weight, {text('labels')} FROM i LEFT JOIN n ON i.iri = n.iri"),
        "recall_iris_facts": looked(20, None),
        "recall_iris_truncated": looked(3, AT),
        "history_node": one("", "").rstrip() + ", " + history(f"(s_iri = '{NODE}' OR o_iri = '{NODE}')", 100),
        "history_fact": one("", "").rstrip() + ", " + history(f"(s_iri, property_iri) IN (SELECT (s_iri, property_iri) FROM facts WHERE iri = '{FACT}')", 20),
        "revisions_fact": one("", "").rstrip() + ", " + revisions(f"SELECT iri FROM facts WHERE (s_iri, property_iri) IN (SELECT (s_iri, property_iri) FROM facts WHERE iri = '{FACT}')", 20),
        "revisions_node": one("", "").rstrip() + ", " + revisions(f"SELECT iri FROM facts WHERE (s_iri = '{NODE}' OR o_iri = '{NODE}') AND {UNPROTECTED}", 100),
        "about_context": one(f"a AS (SELECT * FROM facts WHERE {current(SCOPE, types=('ABOUT',))} AND spike IS NOT NULL), b AS ({closed('a', SCOPE)}), c AS (SELECT *, {SPIKE} AS spike_rank, {WEIGHT} AS effective_weight FROM b WHERE list_contains(o_labels, 'Order'))", f"SELECT row_number() OVER (ORDER BY {order_about}) AS rank, iri, s_iri AS node, o_iri AS about, spike, effective_weight FROM c ORDER BY {order_about} LIMIT 20"),
        "tokens_keyword": one(f"t AS (SELECT iri, {tokens('search_text')} AS t FROM nodes)", "SELECT iri, array_to_string(list_filter(list_transform(generate_series(1, len(t)), lambda i: CASE WHEN list_position(t, t[i]) = i AND length(t[i]) >= 4 AND strlen(t[i]) <= 64 THEN t[i] END), lambda x: x IS NOT NULL)[1:16], ',') AS keywords FROM t"),
        "keyword_coverage": one("", f"SELECT iri, coverage FROM (SELECT iri, round(len(list_intersect({lst(query_keywords(TEXT))}, list_distinct({tokens('fact_text')})))::DOUBLE / {len(query_keywords(TEXT))}, 6) AS coverage FROM facts) WHERE coverage > 0"),
        "token_postings": one(f"t AS (SELECT iri, {tokens('search_text')} AS t FROM nodes), u AS (SELECT iri, len(t) AS length, unnest(t) AS token FROM t)", "SELECT iri, token, count(*) AS tf, any_value(length)::BIGINT AS length FROM u GROUP BY 1, 2"),
        "recall_text": one(ranked(SCOPE, 20, candidates=candidates(TEXT)).strip(), RANKED),
        "recall_text_phrase": one(ranked(EVERY, 50, candidates=candidates(PHRASE)).strip(), RANKED),
        "store_recall_text": one(ranked(SCOPE, 20, candidates=candidates(TEXT)).strip(), RANKED),
        "store_postings": one(
            f"d AS (SELECT iri, search_text AS x FROM nodes UNION ALL SELECT iri, fact_text FROM facts WHERE type IN {inside(S.SEARCHABLE)}), t AS (SELECT iri, {tokens('x')} AS t FROM d), u AS (SELECT iri, len(t) AS length, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS place FROM t)",
            "SELECT iri, token, count(*) AS tf, any_value(length)::BIGINT AS length, string_agg(place, ',' ORDER BY place) AS places FROM u GROUP BY 1, 2",
        ),
        "text_candidates": one(candidates(TEXT).strip().rstrip(","), "SELECT iri, round(score, 6) AS score, exact::BIGINT AS exact, matched, round(evidence, 6) AS evidence FROM cand"),
        "property_channel": one("", "SELECT iri FROM facts WHERE valid_to IS NULL AND type = 'ASSERTS' AND property_iri = 'kg:property/placedBy'"),
        "activation_knn": f"WITH {ACTIVATIONS.strip()} SELECT id, round(similarity, 6) AS similarity, expires_at_ms FROM near",
        "ttl_live": f"WITH {ACTIVATIONS.strip()} SELECT id, round(similarity, 6) AS similarity FROM live",
        "activation_evidence": one(f"{ACTIVATIONS}, {LEARNED}", "SELECT iri, round(learned, 6) AS contribution FROM learned"),
        "contributing_activations": one(f"{ACTIVATIONS}, {LEARNED}", "SELECT DISTINCT id FROM refs WHERE iri IN (SELECT iri FROM known)"),
        "convergence_pick": f"WITH {ACTIVATIONS.strip()}, w AS (SELECT [x || '-{LIKE}' FOR x IN ['kg:relationship/ob', 'kg:relationship/os', 'kg:relationship/missing']] AS w) SELECT id, round(similarity, 6) AS similarity, round(len(list_intersect(refs, w))::DOUBLE / len(list_distinct(list_concat(refs, w))), 6) AS overlap FROM near, w WHERE similarity >= {CONVERGE} AND overlap >= {S.CONVERGE_OVERLAP} ORDER BY near.similarity DESC, id DESC LIMIT 1",
        "rrf_direct": one(f"{ranked(EVERY, S.MAX_LIMIT, candidates=candidates(PHRASE)).strip()}, {DIRECT}", "SELECT iri, round(contribution, 6) AS contribution, eligible FROM direct"),
        "semantic_fused": one(fused(40).strip(), "SELECT rank, iri, round(fused, 6) AS fused, is_direct FROM fused"),
        "bundle_select": one(f"{fused(S.MAX_LIMIT).strip()}, g AS (SELECT x.*, row_number() OVER (PARTITION BY s_iri, property_iri ORDER BY rank) > 2 AS late FROM fused x JOIN facts USING (iri) WHERE eligible)", f"SELECT iri, row_number() OVER (ORDER BY late, rank) AS place FROM g ORDER BY place LIMIT {S.BUNDLE_REFS}"),
        "structural_context": one(f"k0 AS (SELECT * FROM facts WHERE {current(EVERY, types=('ASSERTS',))}), known AS ({closed('k0', EVERY)}), anchors AS (SELECT * FROM (VALUES ('{FACT}', 0.5::DOUBLE), ('{ANCHOR}', 0.25::DOUBLE)) t(iri, anchor_score)), {STRUCTURAL}", "SELECT iri, round(score, 6) AS score FROM struct"),
        "merge_suggestions": one(
            suggested(f"iri IN {inside(CREATED)}"),
            "SELECT row_number() OVER (ORDER BY similarity DESC, source, target) AS rank, source, target, round(similarity, 6) AS similarity FROM s",
        ),
        "merge_suggestions_all": one(suggested("list_has_any(labels, ['Customer', 'Supplier'])"), "SELECT source, target, round(similarity, 6) AS similarity FROM s"),
        "conflicts_overlap": one(
            f"a AS (SELECT * FROM facts WHERE {current(SCOPE, types=('ASSERTS',))}), b AS ({closed('a', SCOPE)})",
            "SELECT x.iri, y.iri AS other_iri FROM b x JOIN b y ON x.s_iri = y.s_iri AND x.property_iri = y.property_iri AND x.o_iri <> y.o_iri AND x.iri < y.iri WHERE (NOT x.eff_qualified AND NOT y.eff_qualified) OR (x.eff_qualified AND y.eff_qualified AND (x.eff_from IS NULL OR y.eff_to IS NULL OR x.eff_from < y.eff_to) AND (y.eff_from IS NULL OR x.eff_to IS NULL OR y.eff_from < x.eff_to))",
        ),
        "conflict_counts": one(
            f"""t AS (SELECT * REPLACE (CASE WHEN property_iri = 'kg:property/placedBy' THEN o_iri ELSE s_iri END AS s_iri, CASE WHEN property_iri = 'kg:property/placedBy' THEN s_iri ELSE o_iri END AS o_iri) FROM facts),
a AS (SELECT * FROM t WHERE {current(EVERY, types=('ASSERTS',))}), b AS ({closed('a', EVERY)})""",
            "SELECT x.iri, count(*) AS n FROM b x JOIN b y ON x.s_iri = y.s_iri AND x.property_iri = y.property_iri AND x.o_iri <> y.o_iri WHERE (NOT x.eff_qualified AND NOT y.eff_qualified) OR (x.eff_qualified AND y.eff_qualified AND (x.eff_from IS NULL OR y.eff_to IS NULL OR x.eff_from < y.eff_to) AND (y.eff_from IS NULL OR x.eff_to IS NULL OR y.eff_from < x.eff_to)) GROUP BY 1",
        ),
        "consolidate_saturated": one(f"z AS (SELECT * REPLACE ('all' AS s_iri, false AS eff_qualified, NULL::TIMESTAMP AS eff_from, NULL::TIMESTAMP AS eff_to, CASE WHEN weight > 3 THEN {S.LONG_MAX}::HUGEINT WHEN weight < -3 THEN -{S.LONG_MAX}::HUGEINT - 1 ELSE weight END AS weight) FROM facts WHERE valid_to IS NULL)", consolidated("z")),
        "duplicate_consolidation": one("z AS (SELECT * REPLACE ('all' AS s_iri, false AS eff_qualified, NULL::TIMESTAMP AS eff_from, NULL::TIMESTAMP AS eff_to) FROM facts WHERE valid_to IS NULL)", consolidated("z")),
        "unify_facts": one(f"{PARTS}, {remapped('(s_iri IN (SELECT target FROM pairs) OR o_iri IN (SELECT target FROM pairs))')}", consolidated("m")),
        "unify_nodes": one(f"{PARTS}, g AS (SELECT target, sum(weight) AS w, count(*) AS merged, bool_or(len(layers) = 0) AS every FROM pairs JOIN nodes ON source = iri GROUP BY 1)", "SELECT iri, name, '' AS layers, (weight + w)::BIGINT AS weight, merged FROM g JOIN nodes ON target = iri"),
        "unify_property": one("z AS (SELECT * REPLACE ('kg:property/placedBy' AS property_iri) FROM facts WHERE valid_to IS NULL AND property_iri = 'kg:property/hasStatus')", consolidated("z")),
        "closure_violations": one(
            f"n2 AS (SELECT iri, {CUSTOMER_LAYERS} AS layers FROM nodes)",
            f"SELECT f.iri, array_to_string(f.layers, ',') AS layers, array_to_string(s.layers, ',') AS s_layers, array_to_string(o.layers, ',') AS o_layers FROM facts f JOIN n2 s ON s_iri = s.iri JOIN n2 o ON o_iri = o.iri WHERE valid_to IS NULL AND NOT ({' AND '.join(f'(len({e}.layers) = 0 OR (len(f.layers) > 0 AND list_has_all({e}.layers, f.layers)))' for e in 'so')})",
        ),
        "withdraw_plan": one(
            f"w AS (SELECT * REPLACE (CASE WHEN weight > 2 AND len(layers) > 0 THEN list_distinct(list_append(layers, '{EVERY[0]}')) ELSE layers END AS layers) FROM facts)",
            f"SELECT iri, len(rest) = 0 AS retired, CASE WHEN len(rest) = 0 THEN array_to_string(layers, ',') ELSE array_to_string(list_sort(rest), ',') END AS new_layers FROM (SELECT *, list_filter(layers, lambda x: x <> '{SCOPE[0]}') AS rest FROM w WHERE valid_to IS NULL AND type NOT IN {inside((*S.SCHEMA, *S.SYSTEM))} AND list_contains(layers, '{SCOPE[0]}'))",
        ),
        "judge_apply": one("", f"SELECT iri, weight > 3 AND weight % 2 = 0 OR weight < -3 AND weight % 2 <> 0 AS refused, CASE WHEN NOT (weight > 3 AND weight % 2 = 0 OR weight < -3 AND weight % 2 <> 0) THEN {ADD.format(f'(CASE WHEN weight > 3 THEN {S.LONG_MAX} WHEN weight < -3 THEN {S.LONG_MIN} ELSE weight END)', '(CASE WHEN weight % 2 = 0 THEN 1 ELSE -1 END)')} END AS weight FROM nodes WHERE list_contains(labels, 'Supplier')".replace(str(S.LONG_MIN), f"({S.LONG_MIN + 1} - 1)")),
        "membership_algebra": one(
            "",
            f"""SELECT iri, CASE WHEN len(layers) = 0 THEN '' ELSE array_to_string(list_sort(list_distinct(list_concat(layers, {asked}))), ',') END AS merged,
  CASE WHEN len(layers) = 0 THEN '' ELSE array_to_string(list_concat(layers, list_filter({asked}, lambda x: NOT list_contains(layers, x))), ',') END AS appended,
  CASE WHEN list_contains(layers, '{SCOPE[0]}') THEN array_to_string(list_sort(list_filter(layers, lambda x: x <> '{SCOPE[0]}')), ',') END AS rest,
  array_to_string(list_sort(list_distinct(list_concat(list_filter(layers, lambda x: x <> '{SCOPE[0]}'), {asked}))), ',') AS placed,
  round(len(list_intersect(layers, {asked}))::DOUBLE / len(list_distinct(list_concat(layers, {asked}))), 6) AS alike FROM facts""",
        ),
        "mint_iri_exprs": f"""SELECT p_partkey, 'kg:element/' || s AS iri, 'kg:property/' || {slug("trim(p_type)")} AS property_iri, s AS local, 'element' AS kind,
  'kg:literal/' || substr({slug("lower(trim(p_name))")}, 1, 40) || '-' || substr(sha256('xsd:string:' || p_name), 1, 12) AS literal_iri FROM (SELECT *, {slug("lower(trim(' ' || p_name || '/' || p_type || ' '))")} AS s FROM part)""",
        "node_envelopes": one("", "SELECT CASE WHEN value IS NULL THEN 'node' ELSE 'literal' END AS kind, iri, name, array_to_string(labels, ',') AS labels, value, CASE WHEN value IS NOT NULL THEN 'xsd:string' END AS datatype, false AS stub, array_to_string(layers, ',') AS scope, weight, 'node' AS target_kind, iri AS target_iri FROM nodes"),
        "fact_envelopes": one(
            "",
            f"""SELECT f.iri, CASE WHEN s.value IS NULL THEN 'node' ELSE 'literal' END AS s_kind, s_iri AS s, s.name AS s_name, string_split(property_iri, '/')[-1] AS p, CASE WHEN o.value IS NULL THEN 'node' ELSE 'literal' END AS o_kind, o_iri AS o, o.name AS o_name, o.value AS o_value,
  array_to_string(f.layers, ',') AS scope, spike, CASE WHEN eff_qualified THEN strftime(eff_from, '%Y-%m-%dT%H:%M:%SZ') END AS "from", CASE WHEN eff_qualified THEN strftime(eff_to, '%Y-%m-%dT%H:%M:%SZ') END AS "to", f.weight, true AS current, list_has_any(f.layers, {lst(SCOPE)}) AS mutable, type, property_iri
  FROM facts f JOIN nodes s ON s_iri = s.iri AND {vis("s.layers", SCOPE)} JOIN nodes o ON o_iri = o.iri AND {vis("o.layers", SCOPE)} WHERE {current(SCOPE).replace("layers", "f.layers")}""",
        ),
        "answer_nodes": one(ranked(SCOPE, 50, labels=("Order",)).strip(), "SELECT iri, min(pos) AS position FROM (SELECT s_iri AS iri, rank * 2 AS pos, s_labels AS labels FROM hits UNION ALL SELECT o_iri, rank * 2 + 1, o_labels FROM hits) WHERE NOT list_contains(labels, 'Literal') GROUP BY 1"),
        "fact_text_exprs": one("", "SELECT iri, fact_text FROM facts"),
    }
    walked = around(**WALKS["recall_around_d2"]).rsplit("SELECT rank, iri", 1)[0]
    told = history(f"(s_iri = '{NODE}' OR o_iri = '{NODE}')", 100)
    kept = f", k AS (SELECT * FROM h ORDER BY valid_to IS NULL DESC, valid_to DESC NULLS LAST, iri LIMIT 100)"
    out |= {
        "around_paths": one("", "").rstrip() + ", " + walked + "SELECT p.rank, p.place, p.iri, f.s_iri AS from_iri, f.property_iri AS p, f.o_iri AS to_iri FROM (SELECT rank, unnest(path_edges) AS iri, generate_subscripts(path_edges, 1) - 1 AS place FROM r WHERE rank <= 100) p JOIN facts f USING (iri)",
        "around_nodes": one("", "").rstrip() + ", " + walked + f"SELECT iri, kind, name, weight FROM nodes WHERE {vis('layers', SCOPE)} AND (iri = '{START}' OR iri IN (SELECT unnest(list_concat([s_iri, o_iri], path_nodes)) FROM r WHERE rank <= 100))",
        "history_transactions": f"SELECT rank, iri, current AS transaction_current, valid_from AS \"from\", valid_to AS \"to\" FROM ({one('', '').rstrip()}, {told})",
        "history_nodes": one("", "").rstrip() + ", " + told.rsplit("SELECT row_number()", 1)[0].rstrip() + kept + f" SELECT iri, kind, name, weight FROM nodes WHERE {vis('layers', EVERY)} AND iri IN (SELECT unnest([s_iri, o_iri]) FROM k)",
        "store_changes": one("t AS (SELECT iri, fact_text AS x, weight AS w, ascii(md5(iri)) % 3 AS third FROM facts)", """SELECT 2::BIGINT AS version, iri, 'insert' AS kind, NULL AS before_text, NULL::BIGINT AS before_weight, 'stale Customer ' || iri AS after_text, w + 1 AS after_weight FROM t WHERE third = 0
            UNION ALL SELECT 4, iri, 'update', 'stale Customer ' || iri, w + 1, x, w FROM t WHERE third = 0 UNION ALL SELECT 3, iri, 'insert', NULL, NULL, x, w FROM t WHERE third > 0
            UNION ALL SELECT 2, iri || '-gone', 'insert', NULL, NULL, 'order placedBy nobody', w FROM t WHERE third = 1 UNION ALL SELECT 3, iri || '-gone', 'delete', 'order placedBy nobody', w, NULL, NULL FROM t WHERE third = 1"""),
    }
    return out | {name: one("", "").rstrip() + ", " + around(**args) for name, args in WALKS.items()}
