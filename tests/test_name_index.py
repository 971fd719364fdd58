"""Whole-table merge suggestions by deletion keys against edit distances of all pairs."""

import random

from factledger import schema as S
from factledger.operators import resolve


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, name, n):
    for _ in range(n):
        i = rng.randrange(len(name) + 1)
        name = rng.choice([name[:i] + rng.choice("abé") + name[i:], name[:i] + name[i + 1 :], name[:i] + rng.choice("AB") + name[i + 1 :]]) or "a"
    return name


def frame(spark, rows):
    names = [x.strip().split(" ", 1)[0] for x in S.NODES.split(", ")]
    return spark.createDataFrame([tuple({"layers": [], **r}.get(n) for n in names) for r in rows], S.NODES).repartition(3)


def test_suggestions_among(spark):
    rng, rows = random.Random(9), [{"iri": "kg:class/Element", "name": "Element", "labels": ["Class"]}, {"iri": "x-null", "labels": ["Element"]}, {"iri": "x-lit", "name": "Element", "labels": ["Element", "Literal"]}]
    for g in range(25):
        base = "".join(rng.choice("abcdeé ") for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 11, 12, 13, 14, 18, 26])))
        for k in range(6):
            rows.append({"iri": f"n{g:02d}-{k}", "name": edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3])), "labels": [rng.choice(["Class", "Property", "Element", "Element"])], "layers": rng.choice([[], [], ["hidden"]])})
    rows += [{"iri": f"same{i:03d}", "name": "Of the same name", "labels": ["Element"]} for i in range(60)]
    kind = lambda r: next((x for x in ("Class", "Property", "Element") if x in r["labels"]), None)
    usable = [r for r in rows if r.get("name") is not None and "Literal" not in r["labels"]]
    new = {r["iri"] for i, r in enumerate(usable) if i % 3}
    want = set()
    for n in usable:
        if n["iri"] not in new:
            continue
        found = []
        for o in usable:
            if o["iri"] == n["iri"] or kind(o) != kind(n) or o.get("layers"):
                continue
            a, b = n["name"].lower(), o["name"].lower()
            d, least = distance(a, b), min(len(n["name"]), len(o["name"]))
            alike = 1 - d / max(len(a), len(b), 1)
            if d <= (0 if least < 3 else 1 if least < 5 else 2) and alike >= (S.PROPERTY_MERGE_FLOOR if kind(n) == "Property" else S.MERGE_FLOOR):
                found.append((-alike, len(o["name"]), o["iri"]))
        for alike, size, iri in sorted(found)[:3]:
            onto = n["iri"] == "kg:class/Element" or (iri != "kg:class/Element" and (len(n["name"]) < size or (len(n["name"]) == size and iri in new and n["iri"] < iri)))
            want.add((iri, n["iri"], round(-alike, 9)) if onto else (n["iri"], iri, round(-alike, 9)))
    nodes = frame(spark, rows)
    created = spark.createDataFrame([(i,) for i in sorted(new)] + [("missing",)], "iri string")
    got = {(r.source, r.target, round(r.similarity, 9)) for r in resolve.suggestions_among(nodes, [], created).collect()}
    assert got == want and len(want) > 100
    stored = resolve.name_index(nodes)
    assert {(r.source, r.target, round(r.similarity, 9)) for r in resolve.suggestions_among(nodes, [], created, stored).collect()} == want
    assert resolve.suggestions_among(nodes.limit(0), [], created).collect() == []


def test_dense_names_make_no_pairs_of_two_edits(spark, monkeypatch):
    """Numbered names have enough nodes within one edit, so the many within two never meet."""
    nodes = frame(spark, [{"iri": f"n{i:04d}", "name": f"Customer#{i:09d}", "labels": ["Element"]} for i in range(300)])
    asked, keep = [], resolve._listed
    monkeypatch.setattr(resolve, "_listed", lambda a, h, edits, *more: asked.append(edits) or keep(a, h, edits, *more))
    got = {(r.source, r.target) for r in resolve.suggestions_among(nodes, [], nodes.select("iri")).collect()}
    assert asked == [1] and ("n0001", "n0000") in got
    want = set()
    for i in range(300):
        near = sorted((distance(f"{i:09d}", f"{j:09d}"), j) for j in range(300) if j != i)[:3]
        want |= {(f"n{max(i, j):04d}", f"n{min(i, j):04d}") for _, j in near}
    assert got == want
