"""The pipeline's SimHash near-dedup: word 5-grams, Jaccard similarity of 0.8 or more, no pair missed.

Texts whose words are the same (ASCII case and spaces aside) are merged first. Ball hashing (see `simhash`) of fingerprints over 5-word
shingles then finds the texts whose fingerprints differ in few bits; their similarity is verified on the shingle sets. Fingerprints alone
can't give right results here: at a similarity of 0.8 two of 64 bits differ in about ten places, a radius whose variants can't be written out. So
prefix filtering, which is exact, completes the links. Of a text's shingles only those that stand in another text matter: the
others are in no intersection. In the order of rising text counts, two sets within the threshold have a shingle in common among the first
n - ceil(0.8 n) + 1 of each, so only those are looked up, and no pair is missed. Pairs are verified by the size of the intersection.

Groups are the components of all such pairs. So that a large group of near copies does not become all its pairs, the links of ball hashing and of
a few look-ups of each text come first; afterwards only pairs of different groups are made. For these a shingle counts once for each group that
has it: what only one group has is in no intersection of two, however many copies the group has, and the order of the shingles is by groups.
A pair is made only if what both have left from the shingle on could still reach the threshold.

Defined results: texts of fewer than five words are one shingle; null or empty texts and texts of spaces only are copies of each other; an
empty table gives an empty table. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.llm import packed
from factledger.llm.common import free_name, materialise, partitions, with_ids
from factledger.llm.simhash import components, fingerprints, links
from factledger.llm.windows import doc_bucket

SHINGLE = 5
#: Similarity as a fraction.
OVER, UNDER = 4, 5
#: Shingles of a bucket, about; comparisons of a text before groups are known.
AT_ONCE, TRIES = 500_000, 3


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the different shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    begin = end - length
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(line[a:b]) for a, b in zip(begin[: len(words) - size + 1].tolist(), end[size - 1 :].tolist(), strict=True)], np.uint64))


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row_id, a digest of the words, and how many there are."""
    for batch in batches:
        data, offsets = packed.texts(batch, "text")
        view = memoryview(data)
        found = [bytes(view[a:b]).lower().split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        key = pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in found], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), key, pa.array([len(w) for w in found], pa.int64())], names=["row_id", "key", "words"])


def emit(buckets: int):
    """Each shingle of each text to the bucket of its hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = packed.Sender(0)
        for batch in batches:
            data, offsets = packed.texts(batch, "text")
            view = memoryview(data)
            for row, a, b in zip(batch.column("row_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                s = shingles(bytes(view[a:b]))
                yield from out.add((s % np.uint64(buckets)).astype(np.int64), {"s": s.view(np.int64), "row": np.full(len(s), row, np.int64), "n": np.full(len(s), len(s), np.int32), "of": np.full(len(s), row, np.int64)})
        yield from out.flush()

    return work


def emit_sets(buckets: int):
    """Each shingle of sets with their groups (row, n, s, root) to the bucket of its hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = packed.Sender(0)
        for batch in batches:
            lists = batch.column("s")
            size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            s = lists.flatten().to_numpy(zero_copy_only=False)
            row, n, root = (np.repeat(packed.column(batch, c), size) for c in ("row", "n", "root"))
            for i in range(0, len(s), 1 << 17):
                k = slice(i, i + (1 << 17))
                yield from out.add((s[k].view(np.uint64) % np.uint64(buckets)).astype(np.int64), {"s": s[k], "row": row[k], "n": n[k], "of": root[k]})
        yield from out.flush()

    return work


def shared(buckets: int):
    """The shingles that more than one text (or group: `of`) has, with the number of those, to the bucket of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = packed.Sender(0)
        for _, pairs in packed.by_bucket(batches):
            held = [packed.unpack(p) for _, p in pairs]
            s, row, n, of = (np.concatenate([packed.column(x, c) for x in held]) for c in ("s", "row", "n", "of"))
            del held
            order = np.lexsort([of, s])
            s, row, n, of = s[order], row[order], n[order], of[order]
            fresh = np.r_[True, s[1:] != s[:-1]]
            first = np.flatnonzero(fresh)
            df = np.add.reduceat((fresh | np.r_[True, of[1:] != of[:-1]]).astype(np.int64), first)
            df = np.repeat(df, np.diff(np.r_[first, len(s)]))
            at = np.flatnonzero(df > 1)
            yield from out.add(doc_bucket(row[at], buckets), {"row": row[at], "n": n[at], "df": df[at], "s": s[at]})
        yield from out.flush()

    return work


def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, n and the shared shingles of each text that has enough of them, by rising text counts."""
    for _, pairs in packed.by_bucket(batches):
        held = [packed.unpack(p) for _, p in pairs]
        row, n, df, s = (np.concatenate([packed.column(x, c) for x in held]) for c in ("row", "n", "df", "s"))
        del held
        order = np.lexsort([s, df, row])
        row, n, s = row[order], n[order].astype(np.int64), s[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        size = np.diff(np.r_[first, len(row)])
        enough = size >= (OVER * n[first] + UNDER - 1) // UNDER
        s = s[np.repeat(enough, size)]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[enough])], pa.int32()), pa.array(s))
        yield pa.RecordBatch.from_arrays([pa.array(row[first][enough]), pa.array(n[first][enough], pa.int32()), lists], names=["row", "n", "s"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v of the pairs whose Jaccard similarity reaches the threshold."""
    a = sets.select(F.col("row").alias("u"), F.col("n").alias("nu"), F.col("s").alias("su"))
    b = sets.select(F.col("row").alias("v"), F.col("n").alias("nv"), F.col("s").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.join(a, "u").join(b, "v").filter((OVER + UNDER) * both >= OVER * (F.col("nu") + F.col("nv"))).select("u", "v")


def ball(distinct: DataFrame) -> DataFrame:
    """u, v: texts whose fingerprints are the same or linked by ball hashing; stars, not all pairs."""
    marked = materialise(fingerprints(distinct.withColumn("doc_id", F.col("row_id")).select("row_id", "doc_id", "text"), SHINGLE))
    first = materialise(marked.groupBy("fp").agg(F.min("row_id").alias("first")))
    near = links(first.select("fp"), first.count())
    a, b = first.select(F.col("fp").alias("u"), F.col("first").alias("a")), first.select(F.col("fp").alias("v"), F.col("first").alias("b"))
    other = near.join(a, "u").join(b, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same = marked.join(first, "fp").filter("row_id <> first").select(F.col("first").alias("u"), F.col("row_id").alias("v"))
    return other.unionByName(same)


def needed(n: Column) -> Column:
    """The least overlap that a set of n shingles has with one within the threshold."""
    return F.floor((OVER * n + UNDER - 1) / UNDER)


def reachable(left: str, other_left: str, n: str, other_n: str) -> Column:
    """Whether two sets can still reach the threshold by the shingles that both have left."""
    return (OVER + UNDER) * F.least(left, other_left) >= OVER * (F.col(n) + F.col(other_n))


def many_pairs(keys: DataFrame) -> bool:
    """Whether texts of different groups that share a key make more than four pairs for each key."""
    own = keys.groupBy("s", "root").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("s").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("own"))
    pairs, rows = own.agg(F.sum((F.col("c") * F.col("c") - F.col("own")) / 2), F.sum("c")).first()
    return bool(rows) and pairs > 4 * rows


def near(distinct: DataFrame, words: int) -> DataFrame:
    """v, root: every row of distinct(row_id, text) that is a near copy of one with a smaller id, and the smallest of its group."""
    spark = distinct.sparkSession
    buckets = max(partitions(spark), words // AT_ONCE + 1)
    sent = distinct.select("row_id", "text").mapInArrow(packed.frugal(emit(buckets)), packed.SCHEMA)
    seen = packed.deal(sent, buckets, shared(buckets), packed.SCHEMA)
    sets = materialise(packed.deal(seen, buckets, ranked, "row long, n int, s array<long>"))
    # Shingles of one text only come first in the order; they are never looked up.
    shared_of = F.size("s") / F.col("n")
    keys = materialise(sets.select("row", shared_of.alias("share"), F.explode(F.slice("s", F.lit(1), (F.size("s") - needed(F.col("n")) + 1).cast("int"))).alias("s")))
    # Each text first tries the texts of its shingles that have least of their own: an original among its edited copies.
    best = F.struct("share", F.xxhash64("row", "s"))
    pivots = keys.groupBy("s").agg(F.max_by("row", best).alias("u"), F.max("share").alias("of"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    tries = keys.join(pivots, "s").filter("u <> row").select("u", "of", F.col("row").alias("v")).distinct()
    some = F.slice(F.transform(F.array_sort(F.collect_set(F.struct((-F.col("of")).alias("o"), F.xxhash64("u", "v").alias("h"), "u"))), lambda x: x["u"]), 1, TRIES)
    tries = tries.groupBy("v").agg(some.alias("u")).select(F.explode("u").alias("u"), "v")
    found = materialise(verified(tries.unionByName(ball(distinct)).distinct(), sets))
    roots = components(found)
    # Between groups: shingles by how many groups have them.
    grouped = sets.join(roots.withColumnRenamed("v", "row"), "row", "left").select("row", "n", "s", F.coalesce("root", "row").alias("root"))
    sent = packed.deal(grouped.mapInArrow(packed.frugal(emit_sets(buckets)), packed.SCHEMA), buckets, shared(buckets), packed.SCHEMA)
    sets = materialise(packed.deal(sent, buckets, ranked, "row long, n int, s array<long>"))
    named = sets.join(grouped.select("row", "root"), "row")
    first = F.slice("s", F.lit(1), (F.size("s") - needed(F.col("n")) + 1).cast("int"))
    keys = materialise(named.select("row", "n", "root", F.size("s").alias("size"), F.posexplode(first).alias("k", "s")).select("row", "n", "root", "s", (F.col("size") - F.col("k")).alias("left"), (F.col("size") / F.col("n")).alias("share")))
    edges = materialise(roots.select(F.col("root").alias("u"), "v"))
    while many_pairs(keys):
        # A large group in a few parts would become all pairs of them: once more, now among texts of other groups.
        pivot = F.max_by(F.struct("row", "n", "root", "left", "share"), F.struct("share", F.xxhash64("row", "s"))).alias("m")
        meet = keys.join(keys.groupBy("s").agg(pivot), "s").filter((F.col("root") != F.col("m.root")) & reachable("left", "m.left", "n", "m.n"))
        tries = meet.select(F.col("m.row").alias("u"), F.col("m.share").alias("of"), F.col("row").alias("v")).distinct().groupBy("v").agg(some.alias("u")).select(F.explode("u").alias("u"), "v")
        more = materialise(verified(tries, sets))
        edges = materialise(edges.unionByName(more))
        roots = components(edges)
        keys = materialise(keys.drop("root").join(roots.withColumnRenamed("v", "row"), "row", "left").select("row", "n", F.coalesce("root", "row").alias("root"), "s", "left", "share"))
        if 20 * more.count() < keys.select("root").distinct().count():
            break  # what is left is no large group in parts
    a, b = keys.select("s", F.col("row").alias("u"), F.col("n").alias("p"), F.col("root").alias("x"), F.col("left").alias("lu")), keys.select("s", F.col("row").alias("v"), F.col("n").alias("q"), F.col("root").alias("y"), F.col("left").alias("lv"))
    rest = a.join(b, "s").filter((F.col("x") < F.col("y")) & reachable("lu", "lv", "p", "q")).select("u", "v").distinct()
    more = materialise(verified(rest, sets))
    return components(edges.unionByName(more))


def one_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose row is the first of its group; all columns as they are."""
    row = free_name(docs, "row_id")
    rows = with_ids(docs, row)
    slim = rows.select(F.col(row).alias("row_id"), "text")
    marked = materialise(slim.mapInArrow(packed.frugal(digests), "row_id long, key binary, words long"))
    firsts = marked.groupBy("key").agg(F.min("row_id").alias("first"))
    copies = materialise(marked.join(firsts, "key").filter("row_id <> first").select("row_id"))
    distinct = slim.join(copies, "row_id", "left_anti")
    gone = near(distinct, marked.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]).select(F.col("v").alias("row_id"))
    left = copies.unionByName(gone).select(F.col("row_id").alias(row))
    return rows.join(left, row, "left_anti").select(*docs.columns)
