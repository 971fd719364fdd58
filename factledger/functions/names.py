"""Identity rules for single values, on the driver; the same rules as the columns of `exprs`."""

from __future__ import annotations

import hashlib
import re
from datetime import datetime, timezone

from factledger import schema as S
from factledger.errors import InvalidInput

_IRI = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_LAYER = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*(?::[a-z0-9]+(?:-[a-z0-9]+)*)*")


def slugify(name: str, kind: str) -> str:
    bare = re.sub(rf"\A{S.NAMESPACE}:[^/]*/", "", name.strip())
    bare = bare.lower() if kind in ("element", "literal", "episode") else bare
    return re.sub(r"[^A-Za-z0-9._-]+", "-", bare).strip("-") or "unnamed"


def mint_iri(name: str, kind: str) -> str:
    return name if _IRI.match(name) else f"{S.NAMESPACE}:{kind}/{slugify(name, kind)}"


def kind_of(iri: str) -> str | None:
    found = re.match(rf"{S.NAMESPACE}:([^/]+)/", iri)
    return found[1] if found else None


def local_name(iri: str) -> str:
    tail = iri.rsplit("/", 1)[-1] if "/" in iri else ""
    return tail or (iri.split(":", 1)[1] if ":" in iri else iri)


def literal_iri(value: str, datatype: str) -> str:
    digest = hashlib.sha256(f"{datatype}:{value}".encode()).hexdigest()[:12]
    return f"{S.NAMESPACE}:literal/{slugify(value, 'literal')[:40]}-{digest}"


def fact_text(subject: str, predicate: str, object_: str) -> str:
    local = local_name(predicate)
    split = re.sub(r"([a-z])(?=[A-Z])", r"\1 ", local)
    return " ".join([subject, local, object_, *([split] if split != local else [])])


def layers(scope: list[str]) -> list[str]:
    """A scope, sorted and without repeats; each entry is checked."""
    for x in scope:
        if x == "global" or not _LAYER.fullmatch(x):
            raise InvalidInput(f"{x!r} is no layer")
    return sorted(set(scope))


def instant(text: str) -> datetime:
    """A full RFC 3339 time, in UTC without zone; a bare date is refused."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)", text):
        raise InvalidInput(f"{text!r} is no RFC 3339 time")
    return datetime.fromisoformat(text.upper().replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None)


def interval(given: dict | None) -> tuple[bool, datetime | None, datetime | None]:
    """(known, from, to); none at all is unknown, an empty one is known and open."""
    if given is None:
        return False, None, None
    start, end = (instant(given[x]) if given.get(x) else None for x in ("from", "to"))
    if start and end and start >= end:
        raise InvalidInput("an interval ends after it starts")
    return True, start, end


LABELS = {"class": "Class", "property": "Property", "element": "Element", "literal": "Literal", "episode": "Episode"}
#: Characters that a text query would read as operators.
OPERATORS = "+-&|!(){}[]^\"~*?:\\/"


def label_for_kind(kind: str) -> str | None:
    return LABELS.get(kind.lower())


def kind_for_label(label: str) -> str | None:
    return next((k for k, v in LABELS.items() if v == label), None)


def lower_by_default(kind: str) -> bool:
    """Whether slugs of a kind are lower-case unless said otherwise."""
    return kind in ("element", "literal", "episode")


def kind_from_labels(labels: list[str]) -> str | None:
    return next((k for k in ("class", "property", "element") if LABELS[k] in labels), None)


def escaped(text: str, spaces: bool = False) -> str:
    return re.sub(rf"([{re.escape(OPERATORS)}{chr(92) + 's' if spaces else ''}])", r"\\\1", text)


def phrase_query(text: str) -> str:
    """A quoted phrase whose operators are literal; with its words apart where camel case hides them."""
    split = re.sub(r"([a-z])(?=[A-Z])", r"\1 ", text)
    return f'"{escaped(text)}"' if split == text else f'("{escaped(text)}" OR "{escaped(split)}")'


def fuzzy_term(name: str) -> str:
    """A whole name as one term that may differ in two places."""
    return f"{escaped(name.lower(), spaces=True)}~2"


def lock_key(subject: str, predicate: str, layer: str) -> str:
    """A digest of three texts, each with its length before it, so that no two triples look alike."""
    digest = hashlib.sha256()
    for part in (subject, predicate, layer):
        data = part.encode()
        digest.update(len(data).to_bytes(8, "big") + data)
    return digest.hexdigest()


def safe_label(label: str) -> str:
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", label):
        raise InvalidInput(f"{label!r} is no label")
    return label


def safe_relationship(name: str) -> str:
    """A relationship type in upper case."""
    up = re.sub("[a-z]", lambda m: m[0].upper(), name)
    if not re.fullmatch(r"[A-Z][A-Z0-9_]*", up):
        raise InvalidInput(f"{name!r} is no relationship type")
    return up


def percentile(samples: list[float], share: float) -> float:
    """Nearest rank: the smallest sample that at least this share of all does not exceed."""
    from math import ceil

    ordered = sorted(samples)
    return ordered[max(0, ceil(round(share * len(ordered), 9)) - 1)]


def latency(samples_ms: list[float]) -> dict[str, float]:
    return {"samples": len(samples_ms), "min_ms": min(samples_ms), "p50_ms": percentile(samples_ms, 0.5), "p95_ms": percentile(samples_ms, 0.95), "max_ms": max(samples_ms)}
