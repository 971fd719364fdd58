"""Cross-tokenizer alignment against a plain version over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from factledger.llm import token_align as T
from factledger.llm.packing import tokenizer_path

SCHEMA = "doc_id long, text string, chunk int, pair long"


def texts():
    rng = random.Random(12)
    words = ["house", "naïve", "Straße", "l'été", "123", "4,567.89", "don't", "<s>", "<|endoftext|>", "<unk>", "日本語", "עברית", "🙂🙂", "a b", "　", " ", "é", "ﬁn", "tab\tx", "x\n\ny", "\r\n", "ßß", "..", "—", " ", "\x1c", "\x85", "Ⅳ", "️", "кот", "é", "́"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    out += ["".join(rng.choice([*words, " ", "  ", "\n", "  ", "  "]) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    out += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x7FF), rng.randint(0x2000, 0x206F), rng.randint(0x3000, 0x30FF)])) for _ in range(30)) for _ in range(60)]
    out += ["a▁b", "▁", " lead", "  two", "trail  ", "\x00nul", "long " * 5000, "nospace" * 3000, "a b c", "a b c"]
    return [(i, t) for i, t in enumerate(out)] + [(1000, None), (1001, ""), (1002, " "), (None, "a b c"), (3, "house naïve")]


def brute(rows):
    v = T.vocabulary(tokenizer_path(T.A_FILE), tokenizer_path(T.B_FILE))
    found, df = [], Counter()
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        a = v.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = v.b.encode(text) if text else []
        if not text or b"".join(v.a_bytes[i] for i in a) != whole or b"".join(v.b_bytes[i] for i in b) != whole:
            found.append((doc, [], [], [], []))
            continue
        spans = []
        for ids, size in ((a, v.a_size), (b, v.b_size)):
            ends = np.cumsum([size[i] for i in ids]).tolist()
            spans.append(list(zip([0, *ends], ends, strict=False)))
        links, k = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][k][1] <= s:
                k += 1
            m = k
            while m < len(b) and spans[1][m][0] < e:
                links.append((a[i], b[m]))
                m += 1
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for e in common:
            groups.append("|".join(",".join(str(x) for x, (_, end) in zip(ids, own, strict=True) if low < end <= e) for ids, own in zip((a, b), spans, strict=True)))
            low = e
        df.update(set(links))
        found.append((doc, a, b, groups, links))
    top = {}
    for (x, _), n in df.items():
        top[x] = max(n, top.get(x, 0))
    return sorted(((d, len(a), len(b), len(g), len(ls), sum(df[p] == top[p[0]] for p in ls), sum(df[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, ls in found), key=repr), df


@pytest.mark.parametrize("chunk, cached", [(4 << 20, 1_500_000), (500, 100)])
def test_token_align(spark, tmp_path, monkeypatch, chunk, cached):
    monkeypatch.setattr(T, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(T, "CACHED", cached)
    rows = texts()
    spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want, df = brute(rows)
    assert sum(r[1] > 0 for r in want) > 250 and sum(r[1] == 0 for r in want) >= 4
    assert sorted((tuple(r) for r in T.op12_token_align(spark, str(tmp_path)).collect()), key=repr) == want
    counts = T.aligned(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(T.A_FILE), tokenizer_path(T.B_FILE))[1]
    assert {(r.a, r.b): r.n for r in counts.collect()} == df


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.aligned(empty, tokenizer_path(T.A_FILE), tokenizer_path(T.B_FILE))[0].collect() == []


def test_align():
    a, b, border = T.align(np.array([1, 4, 6, 9]), np.array([3, 4, 9]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (1, 0), (1, 1), (2, 2), (3, 2)]
    assert border.tolist() == [4, 9]
