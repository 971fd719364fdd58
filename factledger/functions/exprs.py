"""Column expressions of the ledger: identity, visibility, time, weights, set algebra, text. No user functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from factledger import schema as S

IRI = r"^[A-Za-z][A-Za-z0-9+.-]*:"
LAYER = r"^[a-z0-9]+(-[a-z0-9]+)*(:[a-z0-9]+(-[a-z0-9]+)*)*$"


def strings(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


# Identity


def is_iri(c: Column) -> Column:
    return c.rlike(IRI)


def kind_prefix(kind: str, namespace: str = S.NAMESPACE) -> str:
    return f"{namespace}:{kind}/"


def slugify(name: Column, kind: str, namespace: str = S.NAMESPACE) -> Column:
    """Trimmed, without a `<ns>:<any kind>/` prefix, runs of other characters as one dash; empty is `unnamed`."""
    bare = F.regexp_replace(F.trim(name), rf"(?s)\A{namespace}:[^/]*/", "")
    bare = F.lower(bare) if kind in ("element", "literal", "episode") else bare
    slug = F.regexp_replace(F.regexp_replace(bare, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.when(slug == "", F.lit("unnamed")).otherwise(slug)


def mint_iri(name: Column, kind: str, namespace: str = S.NAMESPACE) -> Column:
    return F.when(is_iri(name), name).otherwise(F.concat(F.lit(kind_prefix(kind, namespace)), slugify(name, kind, namespace)))


def property_iri(name: Column, namespace: str = S.NAMESPACE) -> Column:
    return mint_iri(name, "property", namespace)


def kind_from_iri(iri: Column, namespace: str = S.NAMESPACE) -> Column:
    kind = F.regexp_extract(iri, rf"^{namespace}:([^/]+)/", 1)
    return F.when(kind != "", kind)


def name_from_iri(iri: Column) -> Column:
    """After the last slash unless it ends there, else after the first colon, else the whole."""
    tail = F.substring_index(iri, "/", -1)
    after = F.regexp_extract(iri, r"(?s)^[^:]*:(.*)$", 1)
    return F.when(iri.contains("/") & (tail != ""), tail).when(iri.contains(":"), after).otherwise(iri)


def split_camel(c: Column) -> Column:
    return F.regexp_replace(c, r"([a-z])(?=[A-Z])", "$1 ")


def kind_from_labels(labels: Column) -> Column:
    """What a node is by its labels; null for literals, episodes and what has none of the three."""
    has = lambda x: F.array_contains(labels, x)
    return F.when(has("Class"), "class").when(has("Property"), "property").when(has("Element"), "element")


def label_for_kind(kind: Column) -> Column:
    """The label of a kind, in any case; null for what is none."""
    low = F.lower(kind)
    return F.when(low.isin("class", "property", "element", "literal", "episode"), F.initcap(low))


def kind_for_label(label: Column) -> Column:
    return F.when(label.isin("Class", "Property", "Element", "Literal", "Episode"), F.lower(label))


def literal_iri(value: Column, datatype: Column, namespace: str = S.NAMESPACE) -> Column:
    slug = F.substring(slugify(value, "literal", namespace), 1, 40)
    digest = F.substring(F.sha2(F.concat(datatype, F.lit(":"), value), 256), 1, 12)
    return F.concat(F.lit(kind_prefix("literal", namespace)), slug, F.lit("-"), digest)


def structural_type(name: Column, namespace: str = S.NAMESPACE) -> Column:
    """The relationship type of a predicate that has one of its own, else null; case does not matter."""
    local = F.upper(name_from_iri(property_iri(name, namespace)))
    return F.when(local.isin(*S.STRUCTURAL), local)


def fact_text(subject: Column, predicate: Column, object_: Column, with_split: bool = True) -> Column:
    """`subject predicate object`, and the predicate's words where camel case hides them (unify leaves those out)."""
    local = name_from_iri(predicate)
    split = split_camel(local)
    text = F.concat_ws(" ", subject, local, object_)
    return F.when(split != local, F.concat_ws(" ", text, split)).otherwise(text) if with_split else text


def search_text(name: Column, iri: Column, value: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(name, F.lit("")), iri, F.coalesce(value, F.lit(""))))


# Visibility and mutability


def visible(layers: Column, scope: Sequence[str]) -> Column:
    """Global, or in a layer of the scope; an empty scope sees only what is global."""
    everywhere = F.size(layers) == 0
    return everywhere | F.arrays_overlap(layers, strings(scope)) if scope else everywhere


def mutable(layers: Column, scope: Sequence[str]) -> Column:
    """Global rows only from the empty scope, named ones where the scope meets them."""
    return F.arrays_overlap(layers, strings(scope)) if scope else F.size(layers) == 0


def closed(fact: Column, end: Column) -> Column:
    """Whether an end is visible wherever the fact is: global facts need global ends, named ones a global end or a superset."""
    return (F.size(end) == 0) | ((F.size(fact) > 0) & (F.size(F.array_except(fact, end)) == 0))


# Time


def effective_at(at: str | None, qualified: Column, start: Column, end: Column) -> Column:
    """Half-open state as of an instant; an unknown interval matches no instant."""
    if at is None:
        return F.lit(True)
    t = F.lit(at).cast("timestamp_ntz")
    return F.coalesce(qualified, F.lit(False)) & (start.isNull() | (start <= t)) & (end.isNull() | (t < end))


def intervals_overlap(q1: Column, from1: Column, to1: Column, q2: Column, from2: Column, to2: Column) -> Column:
    """Both unknown, or both known and overlapping."""
    q1, q2 = F.coalesce(q1, F.lit(False)), F.coalesce(q2, F.lit(False))
    before = lambda a, b: a.isNull() | b.isNull() | (a < b)
    return (~q1 & ~q2) | (q1 & q2 & before(from1, to2) & before(from2, to1))


# Weights


def sat_add(a: Column, b: Column) -> Column:
    """Sum of two longs, held at the ends of their range."""
    total = a.cast("decimal(20,0)") + b.cast("decimal(20,0)")
    top, low = F.lit(str(S.LONG_MAX)).cast("decimal(20,0)"), F.lit(str(S.LONG_MIN)).cast("decimal(20,0)")
    return F.least(top, F.greatest(low, total)).cast("long")


def may_step(weight: Column, step: Column) -> Column:
    """Whether a weight can go one step up or down without leaving its range."""
    return ~(((step > 0) & (weight == S.LONG_MAX)) | ((step < 0) & (weight == S.LONG_MIN)))


def sat_sum(weights: Column) -> Column:
    """Saturating sum of an array of longs in its order."""
    return F.aggregate(weights, F.lit(0).cast("long"), sat_add)


def spike_rank(spike: Column) -> Column:
    rank = F.lit(0)
    for i, name in enumerate(S.SPIKES, 1):
        rank = F.when(spike == name, i).otherwise(rank)
    return rank


# Sets of layers


def union_dominant(a: Column, b: Column) -> Column:
    """Union where global wins, sorted."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_union(a, b)))


def union_append(a: Column, b: Column) -> Column:
    """Union in order of arrival; a global row stays global, an empty request makes it global."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.array().cast("array<string>")).otherwise(F.array_union(a, b))


def take_away(layers: Column, scope: Sequence[str]) -> Column:
    """What is left without the scope; null where the scope selects nothing. A global row is selected only by the empty scope."""
    if not scope:
        return F.when(F.size(layers) == 0, F.array().cast("array<string>"))
    return F.when(F.arrays_overlap(layers, strings(scope)), F.array_sort(F.array_except(layers, strings(scope))))


def place(layers: Column, add: Column, remove: Column) -> Column:
    """Without `remove`, with `add`, sorted; empty means global."""
    return F.array_sort(F.array_union(F.array_except(layers, remove), add))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), both.cast("double")))


# Text and vectors


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, camel case split."""
    return F.regexp_extract_all(F.lower(split_camel(text)), F.lit(r"[\p{L}\p{N}]+"), 0)


def keywords(text: Column, limit: int | None = S.KEYWORDS) -> Column:
    found = F.array_distinct(F.filter(tokens(text), lambda t: (F.char_length(t) >= S.KEYWORD_CHARS) & (F.octet_length(t) <= S.KEYWORD_BYTES)))
    return found if limit is None else F.slice(found, 1, limit)


def coverage(query: Column, found: Column) -> Column:
    return F.when(F.size(query) == 0, 0.0).otherwise(F.try_divide(F.size(F.array_intersect(query, found)).cast("double"), F.size(query).cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / norm)


def similarity(a: Column, b: Column, raw: bool = False) -> Column:
    """Cosine of two unit vectors, scaled to 0..1 unless `raw`."""
    return dot(a, b) if raw else (dot(a, b) + 1.0) / 2.0


def name_similarity(a: Column, b: Column) -> Column:
    return 1.0 - F.levenshtein(a, b).cast("double") / F.greatest(F.char_length(a), F.char_length(b), F.lit(1)).cast("double")


def fuzzy_limit(length: Column) -> Column:
    """Edits allowed for a name of so many characters."""
    return F.when(length < 3, 0).when(length < 5, 1).otherwise(2)
