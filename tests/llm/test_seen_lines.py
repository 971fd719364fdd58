"""First-seen line stripping against brute force."""

import hashlib
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from factledger.llm import seen_lines as L

SCHEMA = "doc_id long, text string, batch string, chunk int, kind string"


def documents():
    rng = random.Random(11)
    pool = [f"Line number {i} of the house" for i in range(30)] + ["short", "été été é1", "éééééééééé", " padded by nbsp", "", "  ", "IJKLMNOPQÉ"]
    out = []
    for i in range(400):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 12))]
        lines = [rng.choice(["", " ", "\t", "\x0b"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "\r", "  "]) for x in lines]
        out.append((i, "\n".join(lines) + rng.choice(["", "\n", "\n\n"])))
    out += [(500, None), (501, ""), (502, "\n"), (503, "alone"), (504, "very long " * 20000), (3, "Line number 1 of the house\nLine number 1 of the house"), (3, out[3][1]), (None, "Line number 2 of the house"), (None, None), (-7, "Line number 2 of the house\nown line of this text")]
    return [(i, t, "x", 1, "y") for i, t in out]


def brute(rows, batches=8):
    lots = [[] for _ in range(batches)]
    for i, text, *_ in rows:
        lots[0 if i is None else 8 * (zlib.crc32(str(i).encode()) % 64) // 64].append((i, text or ""))
    held, first, removed, out = Counter(), {}, Counter(), []
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for n, lot in enumerate(lots):
        fresh = Counter()
        for i, text in lot:
            kept = []
            lines = text.split("\n")
            for line in lines:
                k = key(line)
                if len(k) >= 10 and held[k] >= 5:
                    first.setdefault(k, n)
                    removed[k] += 1
                else:
                    kept.append(line)
            fresh.update({key(x) for x in lines})
            out.append(("doc", None if i is None else str(i), n, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
        held += fresh
    return sorted([*out, *(("line", hashlib.sha256(k.encode()).hexdigest(), first[k], held[k], removed[k], None) for k in first)], key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_seen_lines(spark, tmp_path, monkeypatch):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    assert sum(r[0] == "line" for r in want) > 20
    assert as_rows(L.op11_seen_lines(spark, str(tmp_path))) == want
    monkeypatch.setattr(L, "WAITING", 3)
    monkeypatch.setattr(L, "SHARD_BYTES", 5000)
    assert as_rows(L.op11_seen_lines(spark, str(tmp_path))) == want


def test_texts_and_limits(spark):
    rows = [(i, "a common line\nown line %d" % i, b) for b in range(3) for i in range(2)]
    store = L.strip_seen(spark.createDataFrame(rows, "doc_id long, text string, batch int"), 3, least_docs=3)
    got = sorted((r.batch, r.doc_id, r.kept) for r in store.documents().collect())
    assert got == [(b, i, f"own line {i}" if b == 2 else f"a common line\nown line {i}") for b in range(3) for i in range(2)]
    assert [(r.batch, r.n_all, r.n_removed) for r in store.lines().collect()] == [(2, 6, 2)]


def test_goes_on_where_it_stopped(spark):
    rows = [(i, "a common line", b) for b in range(3) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch int")
    one = L.Stripper(spark, 3)
    one.stage(df)
    one.feed(0)
    two = L.Stripper(spark, 3, folder=one.folder)
    for batch in (0, 1, 1, 2):
        two.feed(batch)
    assert [(r.batch, r.n_all, r.n_removed) for r in two.lines().collect()] == [(1, 15, 10)]
    assert two.documents().count() == 15


def test_empty(spark):
    store = L.strip_seen(spark.createDataFrame([], "doc_id long, text string, batch int"), 2)
    assert store.documents().collect() == [] and store.lines().collect() == []
    assert spark.range(1).select(L.batch_of(F.lit(None))).first()[0] == 0
