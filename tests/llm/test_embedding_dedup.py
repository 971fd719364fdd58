"""Embedding near-dedup against brute force."""

import numpy as np
import pytest

from factledger.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, id int, root string"


def clusters(rng, groups, size, dims=64, noise=0.06):
    out = []
    for _ in range(groups):
        centre = rng.standard_normal(dims)
        centre /= np.linalg.norm(centre)
        out += [(centre + noise * rng.standard_normal(dims) * rng.uniform(0.2, 1)).astype(np.float32) for _ in range(size)]
    return out


def brute(rows, cosine=E.COSINE):
    fine = [i for i, (_, v, label, *_) in enumerate(rows) if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for i in fine:
        for j in fine:
            a, b = rows[i], rows[j]
            if i < j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float64), np.array(b[1], np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        names = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(names) if names else None
        out.append((row[0], len(near[i]), low, row[0] is not None and row[0] == low))
    return sorted(out, key=repr)


def rows_of():
    rng = np.random.default_rng(3)
    found = clusters(rng, 12, 9) + clusters(rng, 150, 1)
    rows = [(i, v.tolist(), i // 9 % 3 if i % 31 else None, 1, "x") for i, v in enumerate(found)]
    rows += [(900 + i, rows[5][1], rows[5][2], 1, "x") for i in range(20)]  # copies
    rows += [(7, rows[7][1], rows[7][2], 1, "x"), (8, rows[50][1], 1, 1, "x"), (None, rows[5][1], rows[5][2], 1, "x"), (None, rows[90][1], 2, 1, "x")]
    rows += [(950, None, 1, 1, "x"), (951, [], 1, 1, "x"), (952, [0.0] * 64, 1, 1, "x"), (953, [float("nan")] * 64, 1, 1, "x"), (954, [float("inf")] + [1.0] * 63, 1, 1, "x"), (955, [None] + [1.0] * 63, 1, 1, "x"), (956, [1.0, 2.0], 1, 1, "x"), (957, [2.0, 4.0], 1, 1, "x"), (None, None, None, 1, "x")]
    return rows


@pytest.mark.parametrize("block, alone", [(4096, 32768), (16, 32768), (16, 4)])
def test_embedding_dedup(spark, monkeypatch, block, alone):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "ALONE", alone)
    monkeypatch.setattr(E, "MISS", 1e-7)  # so that no pair of the fixture is missed
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()), key=repr)
    assert got == brute(rows)
    assert sum(n > 1 for _, n, *_ in got) > 80


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_of_calibration():
    """Pairs right at the threshold are found as often as the calibration says, at every number of classes."""
    rng = np.random.default_rng(1)
    for classes in (10, 10**6, 10**9):
        plan = E.calibrate(E.COSINE, classes)
        a = E.unit(rng.standard_normal((2000, 64)))
        off = rng.standard_normal((2000, 64))
        off = E.unit(off - (off * a).sum(axis=1)[:, None] * a)
        b = E.COSINE * a + np.sqrt(1 - E.COSINE**2) * off
        way = E.lines(64, E.LINES, E.SEED)
        counted = (np.abs(a @ way - b @ way) <= plan.half_width).sum(axis=1) >= plan.least
        met = (E.routes(a, plan) == E.routes(b, plan)).any(axis=1)
        assert (counted & met).mean() > 0.99
    far = rng.standard_normal((2000, 64))
    assert (E.tail(10, 0.5, 0.0), E.tail(10, 1.0, 0.5)) == (0, 10)
    assert ((np.abs(E.unit(far) @ way - a @ way) <= plan.half_width).sum(axis=1) >= plan.least).mean() < 0.1
