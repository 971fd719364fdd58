"""Which fixed-length windows of a corpus occur again: the common core of suffix-array and substring dedup.

A text is a sequence of units (bytes, or words). Every window of `length` units names the smallest hashed
`gram`-unit piece in it as its anchor, so equal windows have equal anchors at equal places. The windows of a
document that share an anchor form a run. Exactness needs nothing else: equal windows always lie in runs with the same anchor piece.

1. Runs are sorted by (anchor piece, whole run, document, start), dealt to buckets by sampled splitters. A key that
   holds a third of all rows is cut by document, as document and start are part of the key. A run equal to the one before
   it repeats it whole. A run whose anchor piece also occurs in a different run is a probe.
2. Probes are spread into their single windows, again dealt by sampled splitters of their leading units and sorted.
   Equal neighbours repeat, also across the border of two buckets: the first and last rows of all buckets are compared in a join.
3. Documents gather what was found about them: which windows repeat and, unless the first of equal windows stays, a place that each of
   them repeats.

Documents cross the network twice, as compressed blocks; nothing is ever joined pair by pair. The sample behind
the splitters is bounded (about `SAMPLE_BYTES` of text, and `SAMPLE_ROWS` rows of each chunk) and decides only how evenly work is dealt, never
a result. There are at most `FAN` splitters, as every worker holds them; where that leaves buckets larger than `BUCKET_BYTES`, a
second deal cuts them by hashes of their keys (and by document where one key fills a bucket).
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.llm import packed
from factledger.llm.common import materialise, partitions

#: Bytes of text behind the splitters (about) and rows of a chunk there; bytes of text a bucket gets (about); most splitters; bytes hashed at once.
SAMPLE_BYTES, SAMPLE_ROWS, BUCKET_BYTES, FAN, CHUNK = 8 << 20, 4096, 6 << 20, 20_000, 1 << 18
_LOW = np.uint64(0xFFFFFFFF)
_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1))
SPAN, PROBE, EDGE, TEXT = 0, 1, 2, 9
#: Words of more bytes are hashed by XXH3 instead of a sum of powers.
LONG_WORD = 48


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_BYTES = [mix(np.arange(1, 257, dtype=np.uint64) * b) for b in _BASES]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(n, CHUNK + 1024)
        base = int(_BASES[which])
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[which] = (out[0], out[1])
    return _POWERS[which]


class Rolling:
    """Hashes of any range of a sequence of 64-bit codes, in constant time a range."""

    def __init__(self, codes: np.ndarray, which: int) -> None:
        up, self.down = powers(which, len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, n: int) -> np.ndarray:
        """Of all ranges of n units, in order."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


class Units(NamedTuple):
    """Units of some documents: codes under both bases, and where each document's units begin (one more at the end)."""

    codes: tuple[np.ndarray, np.ndarray]
    begins: np.ndarray
    #: First and last byte of each unit, for words.
    start: np.ndarray | None = None
    end: np.ndarray | None = None


def byte_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    return Units((_BYTES[0][data], _BYTES[1][data]), offsets)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Words are maximal runs of bytes other than ASCII spaces; a word's code is a hash of its bytes (128 bits over both bases)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Units((none.astype(np.uint64), none.astype(np.uint64)), np.zeros(len(offsets), np.int64), none, none)
    inside = ~_IS_SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    before = np.r_[False, inside[:-1]]
    after = np.r_[inside[1:], False]
    start = np.flatnonzero(inside & (~before | fresh[:-1]))
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    h = [Rolling(_BYTES[i][data], i).of(start, end) for i in (0, 1)]
    long = np.flatnonzero(end - start > LONG_WORD)  # sums of powers modulo 2^64 can be fooled by long runs that repeat themselves turned over
    view = memoryview(data)
    for k, a, b in zip(long.tolist(), start[long].tolist(), end[long].tolist(), strict=True):
        both = xxhash.xxh3_128_intdigest(view[a:b])
        h[0][k], h[1][k] = both & 0xFFFFFFFFFFFFFFFF, both >> 64
    return Units((h[0] + np.uint64(1), h[1] + np.uint64(1)), np.searchsorted(start, offsets), start, end)


class Kind(NamedTuple):
    """What a unit is, and how long windows and anchor pieces are."""

    units: Callable[[np.ndarray, np.ndarray], Units]
    length: int
    gram: int
    #: Whether the first of equal windows stays.
    first_stays: bool


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def runs(units: Units, kind: Kind) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: row (of the document), p (first window), m (windows), g (anchor piece), s (whole run)."""
    n, length = len(units.codes[0]), kind.length
    lens = np.diff(units.begins)
    count = np.maximum(0, lens - length + 1)
    total = int(count.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return {"row": none, "p": none, "m": none, "g": none.astype(np.uint64), "s": none.astype(np.uint64)}
    one, two = Rolling(units.codes[0], 0), Rolling(units.codes[1], 1)
    grams = one.every(kind.gram)
    anchor = sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), length - kind.gram + 1) & _LOW
    row = np.repeat(np.arange(len(lens)), count)
    at = np.arange(total) + (units.begins[:-1] - (np.cumsum(count) - count))[row]
    named = anchor[at].astype(np.int64)
    begin = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]) | (row[1:] != row[:-1])])
    m = np.diff(np.r_[begin, total])
    p, a, row = at[begin], named[begin], row[begin]
    end = p + m - 1 + length
    s = mix(one.of(p, end) + (a - p).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ two.of(p, end) ^ mix(m.astype(np.uint64))
    assert n < 1 << 32
    return {"row": row, "p": p - units.begins[row], "m": m, "g": grams[a], "s": s}


def multikey_quicksort(keys: list[np.ndarray], small: int = 4096) -> np.ndarray:
    """The order of rows by their keys: parts a range by a pivot of one key into less, equal and more; equal goes on with the next key."""
    done, stack = [], [(np.arange(len(keys[0])), 0)]
    while stack:
        at, d = stack.pop()
        if len(at) <= small or d == len(keys):
            done.append(at[np.lexsort([k[at] for k in reversed(keys[d:])])] if len(at) > 1 and d < len(keys) else at)
            continue
        k = keys[d][at]
        pivot = np.partition(k[:: max(1, len(k) // 101)], 50 if len(k) >= 101 else 0)[50 if len(k) >= 101 else 0]
        stack += [x for x in ((at[k > pivot], d), (at[k == pivot], d + 1), (at[k < pivot], d)) if len(x[0])]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def place(keys: list[np.ndarray], splitters: list[tuple]) -> np.ndarray:
    """The bucket of each row: how many splitters are not above its key."""
    if not splitters:
        return np.zeros(len(keys[0]), np.int64)
    lead = np.array([s[0] for s in splitters], keys[0].dtype)
    low, high = np.searchsorted(lead, keys[0], "left"), np.searchsorted(lead, keys[0], "right")
    for i in np.flatnonzero(low != high):
        low[i] = bisect.bisect_right(splitters, tuple(int(k[i]) for k in keys), int(low[i]), int(high[i]))
    return low


def quantiles(sample: list[tuple], buckets: int) -> list[tuple]:
    sample = sorted(sample)
    return [sample[i * len(sample) // buckets] for i in range(1, buckets)] if len(sample) >= buckets else sample


def doc_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) if ids.dtype == np.int64 else ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        data, offsets = packed.texts(batch, "text")
        for a, b in packed.chunks(offsets, CHUNK):
            yield ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def send_runs(kind: Kind, splitters: list[tuple]) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = packed.Sender(PROBE)
        for ids, data, offsets in each_chunk(batches):
            r = runs(kind.units(data, offsets), kind)
            doc = ids[r["row"]]
            yield from out.add(place([r["g"], r["s"], doc, r["p"]], splitters), {"g": r["g"], "s": r["s"], "doc": doc, "p": r["p"].astype(np.uint32), "m": r["m"].astype(np.uint16)})
        yield from out.flush()

    return work


def thin(hashes: np.ndarray) -> np.ndarray:
    """An eighth of these rows, by hash, and no more than `SAMPLE_ROWS` or so."""
    share = min(0.125, SAMPLE_ROWS / max(1, len(hashes)))
    return hashes < np.uint64(int(share * 2**64))


def sample_runs(kind: Kind) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in each_chunk(batches):
            r = runs(kind.units(data, offsets), kind)
            doc = ids[r["row"]]
            some = thin(mix(r["s"] ^ mix(doc.astype(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64)) for x in (r["g"], r["s"], doc, r["p"])], names=["a", "b", "c", "d"])

    return work


def narrow(rows: DataFrame, coarse: int, fine: int, keys: list[str], whole: list[str]) -> DataFrame:
    """Rows dealt over `coarse` buckets, cut into `fine` buckets each by the first of `keys` that differs there, or else by document.

    A bucket between two equal splitters holds one value of the key that they share.
    """
    if fine == 1:
        return rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = packed.Sender(PROBE)
        for bucket, pairs in packed.by_bucket(batches):
            for _, payload in pairs:
                batch = packed.unpack(payload)
                cols = {n: packed.column(batch, n) for n in batch.schema.names}
                by = keys[0] if bucket >= 0 and not int(whole[bucket]) else keys[1]
                sub = (mix(cols[by].astype(np.uint64)) % np.uint64(fine)).astype(np.int64)
                yield from out.add(bucket * fine + sub, cols)
        yield from out.flush()

    return packed.deal(rows, coarse, work, packed.SCHEMA)


def inside_one_key(splitters: list[tuple], n: int) -> list[bool]:
    """For each bucket whether the splitters around it share their first n values."""
    lead = [x[:n] for x in splitters]
    return [False, *(a == b for a, b in zip(lead, lead[1:], strict=False)), *([False] * min(1, len(lead)))]


def gather(pairs: Iterator[tuple[int, bytes]], names: list[str]) -> list[np.ndarray] | None:
    found = [packed.unpack(p) for _, p in pairs]
    return [np.concatenate([packed.column(b, n) for b in found]) for n in names] if found else None


def repeated(doc: np.ndarray, p: np.ndarray, number: np.ndarray, first: np.ndarray, first_stays: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows in numbered groups: which repeat another place, and the row of a place that they repeat.

    That is the first of the group, and for the first itself the last one. Rows of one document and start are one place.
    """
    last = np.r_[first[1:], len(doc)] - 1
    own, end = first[number], last[number]
    at_first = (doc == doc[own]) & (p == p[own])
    alone = (doc[own] == doc[end]) & (p[own] == p[end])
    return ~at_first if first_stays else ~alone, np.where(at_first, end, own)


def compare_runs(kind: Kind, doc_buckets: int) -> Callable:
    """Repeated runs, and probes for single windows, sent to their documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pairs in packed.by_bucket(batches):
            g, s, doc, p, m = gather(pairs, ["g", "s", "doc", "p", "m"])
            order = multikey_quicksort([g, s, doc.view(np.uint64) ^ np.uint64(1 << 63), p])
            g, s, doc, p, m = g[order], s[order], doc[order], p[order], m[order]
            again = np.r_[False, (g[1:] == g[:-1]) & (s[1:] == s[:-1])]
            first = np.flatnonzero(~again)
            lead = g[first]
            shared = np.r_[False, lead[1:] == lead[:-1]]
            shared |= np.r_[shared[1:], False]
            shared |= (lead == g[0]) | (lead == g[-1])  # the next bucket may go on with it
            probe = np.zeros(len(g), bool)
            probe[first[shared]] = True
            number = np.cumsum(~again) - 1
            gone, source = repeated(doc, p, number, first, kind.first_stays)
            for what, is_probe in ((gone, 0), (probe, 1)):
                cols = {"doc": doc[what], "p": p[what], "m": m[what]} | ({} if is_probe or kind.first_stays else {"from_doc": doc[source[what]], "from_p": p[source[what]]})
                found = list(packed.split(doc_bucket(cols["doc"], doc_buckets), cols, is_probe))
                for i in range(0, len(found), 64):
                    yield packed.rows(found[i : i + 64])

    return work


def send_texts(doc_buckets: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = doc_bucket(batch.column("id").to_numpy(zero_copy_only=False), doc_buckets)
            order = np.argsort(bucket, kind="stable")
            of = bucket[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)] if len(of) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.take(pa.array(order[a:b]))
                yield packed.rows([(int(of[a]), TEXT, packed.pack({n: part.column(n) for n in part.schema.names}))])

    return work


class Places:
    """Records of (doc, p, m and others) looked up by document, in the order of p, the longer first."""

    def __init__(self, found: list[pa.RecordBatch], others: tuple[str, ...] = ()) -> None:
        cat = lambda n: np.concatenate([packed.column(b, n).astype(np.int64) for b in found]) if found else np.zeros(0, np.int64)
        doc, p, m = cat("doc"), cat("p"), cat("m")
        order = np.lexsort([-m, p, doc])
        self.doc, self.columns = doc[order], [p[order], m[order], *(cat(n)[order] for n in others)]

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row of ids, p, m, others) for the records of these documents."""
        a, b = np.searchsorted(self.doc, ids, "left"), np.searchsorted(self.doc, ids, "right")
        n = b - a
        row = np.repeat(np.arange(len(ids)), n)
        at = np.arange(int(n.sum())) + (a - (np.cumsum(n) - n))[row]
        return row, *(c[at] for c in self.columns)


def lead_token(units: Units, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The first eight bytes of each window, as a number that sorts like them (fewer at the end of the data count as zeros)."""
    start = at if units.start is None else units.start[at]
    padded = np.r_[data, np.zeros(8, np.uint8)]
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[start + j].astype(np.uint64)
    if units.end is not None:  # no further than the first word
        size = np.minimum(units.end[at] - start, 8).astype(np.uint64)
        gap = (np.uint64(8) - size) * np.uint64(8)
        out = (out >> gap) << gap
    return out


def spread(kind: Kind, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, places: Places) -> dict[str, np.ndarray] | None:
    """The single windows of all probes of these documents."""
    row, p, m = places.of(ids)
    if not len(row):
        return None
    units = kind.units(data, offsets)
    of = np.repeat(np.arange(len(row)), m)
    start = p[of] + (np.arange(len(of)) - (np.cumsum(m) - m)[of])
    at = start + units.begins[row[of]]
    end = at + kind.length
    return {"a": lead_token(units, at, data), "b": Rolling(units.codes[0], 0).of(at, end), "c": Rolling(units.codes[1], 1).of(at, end), "doc": ids[row[of]], "p": start.astype(np.uint32)}


def probed(kind: Kind, use: Callable) -> Callable:
    """`use` on the single windows of each chunk of a bucket's documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = use()
        for _, pairs in packed.by_bucket(batches):
            found, places = [], None
            for what, payload in pairs:
                if what != TEXT:
                    found.append(packed.unpack(payload))
                    continue
                places = places or Places(found)
                if not len(places.doc):
                    continue
                for ids, data, offsets in each_chunk(iter([packed.unpack(payload)])):
                    w = spread(kind, ids, data, offsets, places)
                    if w is not None:
                        yield from state(w)
        yield from state(None)

    return work


def send_windows(splitters: list[tuple]) -> Callable:
    def use() -> Callable:
        out = packed.Sender(PROBE)

        def go(w: dict | None) -> Iterator[pa.RecordBatch]:
            yield from out.flush() if w is None else out.add(place([w["a"], w["b"], w["c"], w["doc"], w["p"]], splitters), w)

        return go

    return use


def sample_windows() -> Callable:
    def go(w: dict | None) -> Iterator[pa.RecordBatch]:
        if w is not None:
            some = thin(mix(w["b"] ^ mix(w["doc"].astype(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(x[some].astype(np.int64) if x.dtype != np.uint64 else x[some].view(np.int64)) for x in (w["a"], w["b"], w["c"], w["doc"], w["p"])], names=list("abcde"))

    return go


def compare_windows(kind: Kind, doc_buckets: int) -> Callable:
    """Windows equal to their neighbours in the sorted bucket; the bucket's own edges go to bucket -1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, pairs in packed.by_bucket(batches):
            a, b, c, doc, p = gather(pairs, ["a", "b", "c", "doc", "p"])
            order = multikey_quicksort([a, b, c, doc.view(np.uint64) ^ np.uint64(1 << 63), p])
            a, b, c, doc, p = a[order], b[order], c[order], doc[order], p[order]
            again = np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1])]
            gone, source = repeated(doc, p, np.cumsum(~again) - 1, np.flatnonzero(~again), kind.first_stays)
            cols = {"doc": doc[gone], "p": p[gone], "m": np.ones(int(gone.sum()), np.uint16)} | ({} if kind.first_stays else {"from_doc": doc[source[gone]], "from_p": p[source[gone]]})
            found = list(packed.split(doc_bucket(cols["doc"], doc_buckets), cols, 0))
            ends = [0, len(a) - 1]
            edge = {n: x[ends].view(np.int64) for n, x in (("a", a), ("b", b), ("c", c))} | {"doc": doc[ends], "p": p[ends].astype(np.int64)}
            yield packed.rows([*found, (-1, EDGE, packed.pack(edge))])

    return work


def across(windows: DataFrame, first_stays: bool, doc_buckets: int) -> DataFrame:
    """Packed records of windows that repeat one in another bucket; every bucket has two rows here."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                yield packed.unpack(payload.as_py())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = packed.Sender(SPAN)
        for batch in batches:
            doc, p, from_doc, from_p = (packed.column(batch, n) for n in ("doc", "p", "from_doc", "from_p"))
            yield from out.add(doc_bucket(doc, doc_buckets), {"doc": doc, "p": p.astype(np.uint32), "m": np.ones(len(doc), np.uint16)} | ({} if first_stays else {"from_doc": from_doc, "from_p": from_p.astype(np.uint32)}))
        yield from out.flush()

    key = ["a", "b", "c"]
    edges = windows.filter(F.col("kind") == EDGE).mapInArrow(packed.frugal(unpacked), "a long, b long, c long, doc long, p long").distinct()
    place = F.struct("doc", "p")
    groups = edges.groupBy(*key).agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high")
    both = edges.join(groups, key)
    if first_stays:
        both = both.filter(place != F.col("low"))
    source = F.when(place == F.col("low"), F.col("high")).otherwise(F.col("low"))
    return both.select("doc", "p", source["doc"].alias("from_doc"), source["p"].alias("from_p")).mapInArrow(packed.frugal(pack), packed.SCHEMA)


def unsigned(rows: list, n: int) -> list[tuple]:
    """The first n columns of a sample as unsigned numbers."""
    return [tuple(int(v) & 0xFFFFFFFFFFFFFFFF if i < n else int(v) for i, v in enumerate(r)) for r in rows]


def repeats(docs: DataFrame, kind: Kind, finish: Callable, schema: str) -> DataFrame:
    """`finish(ids, batch, units, places)` on every chunk of documents, with the repeated runs of windows.

    docs has id (long, not null), text, and any further columns; rows are sent whole.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(partitions(docs.sparkSession), total // BUCKET_BYTES, 1)
    coarse = min(buckets, FAN)
    fine = -(-buckets // coarse)
    slim = docs.select("id", "text")
    some = slim.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, total))) < SAMPLE_BYTES)
    cut = quantiles(unsigned(some.mapInArrow(packed.frugal(sample_runs(kind)), "a long, b long, c long, d long").collect(), 2), coarse)
    sent = narrow(slim.mapInArrow(packed.frugal(send_runs(kind, cut)), packed.SCHEMA), coarse, fine, ["g", "s"], inside_one_key(cut, 1))
    spans = materialise(packed.deal(sent, coarse, compare_runs(kind, buckets), packed.SCHEMA))
    probes = spans.filter("kind = 1")
    with_texts = lambda rows: probes.unionAll(rows.mapInArrow(packed.frugal(send_texts(buckets)), packed.SCHEMA))
    cut2 = quantiles(unsigned(packed.deal(with_texts(some), coarse, probed(kind, sample_windows), "a long, b long, c long, d long, e long").collect(), 3), coarse)
    singles = packed.deal(with_texts(slim), coarse, probed(kind, send_windows(cut2)), packed.SCHEMA)
    singles = narrow(singles, coarse, fine, ["b", "doc"], inside_one_key(cut2, 3))
    windows = materialise(packed.deal(singles, coarse, compare_windows(kind, buckets), packed.SCHEMA))
    found = spans.filter("kind = 0").unionAll(windows.filter("kind = 0")).unionAll(across(windows, kind.first_stays, buckets))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pairs in packed.by_bucket(batches):
            held, places = [], None
            for what, payload in pairs:
                if what != TEXT:
                    held.append(packed.unpack(payload))
                    continue
                places = places or Places(held, () if kind.first_stays else ("from_doc", "from_p"))
                batch = packed.unpack(payload)
                data, offsets = packed.texts(batch, "text")
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                for a, b in packed.chunks(offsets, CHUNK):
                    yield finish(batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], places.of(ids[a:b]))

    whole = docs.mapInArrow(packed.frugal(send_texts(buckets)), packed.SCHEMA)
    return packed.deal(found.unionAll(whole), coarse, work, schema)


def covered(units: Units, found: tuple[np.ndarray, ...], length: int) -> np.ndarray:
    """Which units of a chunk lie in repeated windows."""
    row, p, m = found[:3]
    n = len(units.codes[0])
    if not len(row):
        return np.zeros(n, bool)
    start = p + units.begins[row]
    edges = np.bincount(start, minlength=n + 1) - np.bincount(start + m - 1 + length, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0
