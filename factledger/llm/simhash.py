"""SimHash near-dedup: meet-in-the-middle ball hashing of 64-bit fingerprints.

Two fingerprints within 4 bits have a common variant within 2 bits of both. So every fingerprint emits all its
variants within half the radius; equal variants of different fingerprints are links. The shuffle goes by the leading
bits of the variant: a fingerprint is sent once to each bucket in which it has variants (1 + t + t(t-1)/2 of 2^t), and
its variants are written out there, so that the network never carries them one by one. A bucket with too many variants is
halved by one more leading bit, again and again. Colliding pairs are verified, and each bucket sends on only a
star for each of its groups.

Exact copies share a fingerprint and are merged before anything is shuffled, so a group of copies of any size is one
row. Components are found by alternating large and small stars over tables, never on the driver.

Defined results: null or empty texts, and texts of spaces only, have the fingerprint zero and link like any other;
repeated rows get the same answer; a null doc_id takes part in groups but never names one; an empty table gives an
empty table; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm import packed
from factledger.llm.common import free_name, materialise, partitions, table, with_ids

SHINGLE, SEED, RADIUS = 4, 42, 4
BITS = 64
#: Variants written out at once.
AT_ONCE, MOST_LEADING = 1 << 21, 20


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of each bit over the hashes of all shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[a:b], seed) for a, b in zip(begin[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """row_id, doc_id and fp (the fingerprint's bits as a long) of docs(row_id, doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed.texts(batch, "text")
            view = memoryview(data)
            fp = np.fromiter((fingerprint(bytes(view[a:b]), shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.uint64, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["row_id", "doc_id", "fp"])

    slim = docs.select(F.col("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(packed.frugal(work), "row_id long, doc_id long, fp long")


def masks(bits: int, most: int) -> np.ndarray:
    """All numbers of `bits` bits with at most `most` ones."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.uint64)


def emit(leading: int, half: int) -> Callable:
    """Each fingerprint to the buckets of its variants' leading bits."""
    near = masks(leading, half)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = packed.Sender(0)
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 1 << 14):
                f = fp[i : i + (1 << 14)]
                lead = f >> np.uint64(BITS - leading) if leading else np.zeros_like(f)
                bucket = (lead[:, None] ^ near[None, :]).astype(np.int64).ravel()
                yield from out.add(bucket, {"fp": np.repeat(f, len(near))})
        yield from out.flush()

    return work


def stars(fp: np.ndarray, lead: int, leading: int, half: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(smallest, other) of fingerprints that share a variant that begins with these leading bits."""
    own = fp >> np.uint64(BITS - leading) if leading else np.zeros_like(fp)
    left = half - np.bitwise_count(own ^ np.uint64(lead)).astype(np.int64)
    fp, left = fp[left >= 0], left[left >= 0]
    if len(fp) < 2:
        return []
    rest = BITS - leading
    if sum(math.comb(rest, k) for k in range(half + 1)) * int((left == half).sum()) > AT_ONCE and leading < 48:
        return stars(fp, lead << 1, leading + 1, half) + stars(fp, (lead << 1) | 1, leading + 1, half)
    low = np.uint64((1 << rest) - 1)
    keys, owner = [], []
    for budget in range(half + 1):
        at = np.flatnonzero(left == budget)
        near = masks(rest, budget)
        keys.append(((fp[at] & low)[:, None] ^ near[None, :]).ravel())
        owner.append(np.repeat(at, len(near)))
    key, who = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(key)
    key, who = key[order], who[order]
    same = key[1:] == key[:-1]
    if not same.any():
        return []
    pairs = np.unique(np.stack([who[:-1][same], who[1:][same]], axis=1), axis=0)  # neighbours in a variant's list link all of it
    a, b = pairs[:, 0], pairs[:, 1]
    near = np.bitwise_count(fp[a] ^ fp[b]) <= 2 * half
    a, b = a[near], b[near]
    return forest(fp, a, b)


def forest(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A star from the smallest member of each group that these links make."""
    label = np.arange(len(fp))
    order = np.argsort(fp)
    rank = np.empty(len(fp), np.int64)
    rank[order] = np.arange(len(fp))
    label = rank.copy()
    while True:
        low = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[order[label]]  # the label of whom the label names
        if (label == was).all():
            break
    other = np.flatnonzero(label != rank)
    return [(fp[order[label[other]]], fp[other])]


def links(distinct: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """u, v (fingerprints): stars whose components are those of all links."""
    half = radius // 2
    spark = distinct.sparkSession
    each = sum(math.comb(BITS, k) for k in range(half + 1))
    leading = min(MOST_LEADING, max(0, math.ceil(math.log2(max(1, count * each / AT_ONCE)))))
    parts = min(1 << leading, max(partitions(spark), (1 << leading) // 4))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, pairs in packed.by_bucket(batches):
            fp = np.concatenate([packed.column(packed.unpack(p), "fp") for _, p in pairs])
            for u, v in stars(fp, bucket, leading, half):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return packed.deal(distinct.select("fp").mapInArrow(packed.frugal(emit(leading, half)), packed.SCHEMA), parts, work, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """v, root for every node that isn't its own root: large and small stars in turn until nothing changes."""
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("root")).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "root").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            return edges
        before = state
        both = edges.select(F.col("v").alias("x"), F.col("root").alias("y")).unionAll(edges.select(F.col("root").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("v"), F.col("m").alias("root")).filter("v <> root").distinct()
        low = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(low, "v").select(F.col("root").alias("v"), F.col("m").alias("root")).filter("v <> root").unionAll(low.select("v", F.col("m").alias("root"))).distinct()
        edges = materialise(small)


def near_duplicates(rows: DataFrame) -> DataFrame:
    """row_id, doc_id, fp, component_id (smallest doc_id) and component_row (smallest row_id) of rows(row_id, doc_id, text)."""
    marked = materialise(fingerprints(rows))
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("low_doc"), F.min("row_id").alias("low_row")))
    roots = components(links(distinct, distinct.count()))
    named = distinct.join(roots, distinct.fp == roots.v, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low_doc", "low_row")
    ids = named.groupBy("root").agg(F.min("low_doc").alias("component_id"), F.min("low_row").alias("component_row"))
    groups = named.join(ids, "root").select("fp", "component_id", "component_row")
    return marked.join(groups, "fp").select("row_id", "doc_id", "fp", "component_id", "component_row")


def one_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose row is the first of its component; all columns as they are."""
    row = free_name(docs, "row_id")
    rows = with_ids(docs, row)
    first = near_duplicates(rows.select(F.col(row).alias("row_id"), "doc_id", "text")).filter("row_id = component_row").select(F.col("row_id").alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "doc_id", "text")
    return near_duplicates(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
