"""The common core with many small buckets, one key in several of them, and two deals; and the factors of op7."""

from collections import Counter

import numpy as np
import pytest
from test_operators import WORD, corpus

from factledger.llm import substring_dedup, suffix_dedup, windows


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(windows, "BUCKET_BYTES", 1500)


def texts():
    """The fixture's texts, and a passage that many documents hold between words of their own."""
    passage = " ".join(f"p{i}" for i in range(50))
    return [t for _, t, *_ in corpus()] + [f"own{k} {passage} {k}own and end" for k in range(150)] + ["same " * 60] * 20


def table(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(6)


@pytest.mark.parametrize("fan", [20_000, 5])
def test_words(spark, small, monkeypatch, fan):
    monkeypatch.setattr(windows, "FAN", fan)
    found = [WORD.findall(t or "") for t in texts()]
    count = Counter(tuple(w[k : k + 35]) for w in found for k in range(len(w) - 34))
    rows = {r.row_id: r for r in substring_dedup.remove_repeats(table(spark).selectExpr("doc_id AS row_id", "doc_id", "text")).collect()}
    assert len(rows) == len(found)
    for i, w in enumerate(found):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = True
        r = rows[i]
        assert (r.n_removed, bytes(r.kept).decode()) == (int(gone.sum()), " ".join(np.array(w, object)[~gone]))
        inside, last = np.zeros(len(w), bool), -1
        for f in r.factors:
            assert f.length >= 35 and f.start > last and (f.from_row, f.from_start) != (i, f.start)
            assert found[f.from_row][f.from_start : f.from_start + f.length] == w[f.start : f.start + f.length]
            inside[f.start : f.start + f.length] = True
            last = f.start
        assert (inside == gone).all()


@pytest.mark.parametrize("fan", [20_000, 5])
def test_bytes(spark, small, monkeypatch, fan):
    monkeypatch.setattr(windows, "FAN", fan)
    seen, want = set(), {}
    for i, t in enumerate(texts()):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        want[i] = np.frombuffer(b, np.uint8)[~gone].tobytes()
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(table(spark)).collect()} == want


def turned(n):
    """A string of a and b that sums of powers modulo 2^64 can't tell from the one with a and b exchanged."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word[:n]


@pytest.mark.parametrize("n", [64, 512, 1024, 2048, 4096])
def test_long_words_that_are_turned_over(spark, n):
    word, rest = turned(n), " ".join(f"w{i}" for i in range(34))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"{word} {rest}")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df.selectExpr("doc_id AS row_id", "doc_id", "text")).collect()}
    assert got == {1: 35, 2: 0, 3: 35}


def test_bytes_that_are_turned_over(spark):
    word = turned(256)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, "-" + other[:120]), (3, "+" + word[:120])]
    seen, want = set(), {}
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(t[k : k + 100])
        want[i] = int(gone.sum())
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
