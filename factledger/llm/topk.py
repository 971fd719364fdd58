"""Exact top-k inner-product search with a KD-tree per shard.

Vectors are dealt to shards by a hash of their row number, which is the id where ids are unique. Each shard builds a tree by median splits of its widest
component, with the tight bounding box of every node. A query walks a tree best first: the box gives an upper bound of its
scores, and a node below the query's kth score so far is never opened. Every query first searches its own shard; the
kth score found there goes with it to all other shards, which open only what can still beat it. Queries are a stated
set and travel in blocks, so a task holds one shard and one block at a time.

Defined results: vectors that are null, or hold null or non-finite components, and rows without an id take no part;
shorter vectors count as filled with zeros; rows that share an id are rows of their own, each a candidate and, if its id is asked,
a query that excludes itself only; ties go to the smaller id; an empty table gives an empty table; columns other than
vec_id and embedding are ignored. Scores are exact while they are below 2^53.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factledger.llm import packed
from factledger.llm.common import materialise, partitions, table

K, EVERY, SCALE = 5, 50, 256
LEAF, BLOCK, SHARD = 48, 1024, 65_536
VECTORS, QUERIES = 0, 1
FOUND = "query_id long, query_row long, home long, vec_id long, score long, vector binary"


class Tree(NamedTuple):
    """Nodes in order of their making: box, children (or -1) and the range of rows; rows are in leaf order."""

    ids: np.ndarray
    own: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    span: np.ndarray
    least_id: np.ndarray


def build(ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF, own: np.ndarray | None = None) -> Tree:
    """The tree of vectors with their ids and row numbers (the ids, unless given)."""
    numbers = ids if own is None else own
    order = np.arange(len(ids))
    low, high, child, span = [], [], [], []
    stack = [(0, len(ids), -1)]
    while stack:
        a, b, parent = stack.pop()
        me = len(low)
        if parent >= 0:
            child[parent][child[parent].index(-1)] = me
        inside = rows[order[a:b]]
        low.append(inside.min(axis=0))
        high.append(inside.max(axis=0))
        child.append([-1, -1])
        span.append((a, b))
        wide = high[me] - low[me]
        at = int(wide.argmax()) if len(wide) else 0
        if b - a > leaf and len(wide) and wide[at] > 0:
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(inside[:, at], mid)]
            stack += [(a + mid, b, me), (a, a + mid, me)]
    ids, span = ids[order], np.array(span)
    return Tree(ids, numbers[order], rows[order], np.array(low), np.array(high), np.array(child), span, np.array([ids[a:b].min() for a, b in span]))


def search(tree: Tree, queries: np.ndarray, own_rows: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """For each query the best (score, id) of this tree, but for its own row, that may be among its k best, given a kth score from elsewhere."""
    bounds = np.maximum(queries, 0) @ tree.high.T + np.minimum(queries, 0) @ tree.low.T
    child, span, least = tree.child.tolist(), tree.span.tolist(), tree.least_id.tolist()
    for i, q in enumerate(queries):
        own, bound = own_rows[i], bounds[i].tolist()
        best: list[tuple[float, int]] = []  # (score, -id), the worst first
        floor = (kth[i], -int(kth_id[i]))
        todo = [(-bound[0], 0)]
        while todo:
            b, node = heapq.heappop(todo)
            if (-b, -least[node]) < floor:
                if -b < floor[0]:
                    break
                continue
            if child[node][0] >= 0:
                for c in child[node]:
                    if (bound[c], -least[c]) >= floor:
                        heapq.heappush(todo, (-bound[c], c))
                continue
            x, y = span[node]
            scores = tree.rows[x:y] @ q
            for j in np.flatnonzero(scores >= floor[0]).tolist():
                one = (float(scores[j]), -int(tree.ids[x + j]))
                if tree.own[x + j] == own or one < floor:
                    continue
                if len(best) < k:
                    heapq.heappush(best, one)
                else:
                    heapq.heappushpop(best, one)
                if len(best) == k:
                    floor = max(floor, best[0])
        yield [(int(s), -i) for s, i in sorted(best, key=lambda x: (-x[0], -x[1]))]


def shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)).astype(np.int64) % shards


def matrix(batch: pa.RecordBatch, dim: int, scale: int) -> np.ndarray:
    """Whole numbers floor(scale * x) of a list column without nulls, filled up with zeros."""
    col = batch.column("embedding")
    flat, size = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.array([len(x) for x in col]) if len(col) else np.zeros(0, np.int64)
    out = np.zeros((len(col), dim))
    row = np.repeat(np.arange(len(col)), size)
    out[row, np.arange(len(flat)) - (np.cumsum(size) - size)[row]] = np.floor(scale * flat)
    return out


def blob(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def send(dim: int, shards: int, scale: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("vec_id", "row"))
            rows, shard = matrix(batch, dim, scale), shard_of(own, shards)
            yield packed.rows([(int(s), VECTORS, packed.pack({"id": ids[shard == s], "own": own[shard == s], "v": blob(rows[shard == s])})) for s in np.unique(shard)])

    return work


def send_queries(shards: int) -> Callable:
    """Blocks of queries with their kth scores, to every shard but their own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                home = part.column("home").to_numpy(zero_copy_only=False)
                for s in range(shards):
                    own = part.filter(pa.array(home != s))
                    if own.num_rows:
                        yield packed.rows([(s, QUERIES, packed.pack({n: own.column(n) for n in own.schema.names}))])

    return work


def look(dim: int, k: int, every: int, at_home: bool) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, pairs in packed.by_bucket(batches):
            held, tree = [], None

            def grown() -> Tree | None:
                if not held:  # noqa: B023
                    return None
                ids, own = (np.concatenate([packed.column(b, n) for b in held]) for n in ("id", "own"))  # noqa: B023
                rows = np.frombuffer(b"".join(v for b in held for v in b.column("v").to_pylist()), np.float64).reshape(len(ids), dim)  # noqa: B023
                return build(ids, rows, own=own)

            def answers(tree: Tree, ids: np.ndarray, own: np.ndarray, rows: np.ndarray, kth: np.ndarray, kth_id: np.ndarray) -> pa.RecordBatch:
                out: list[list] = [[], [], [], [], [], []]
                for i, best in enumerate(search(tree, rows, own, k, kth, kth_id)):
                    for n, (score, vec) in enumerate(best or ([(None, None)] if at_home else [])):
                        row = (int(ids[i]), int(own[i]), shard, vec, score, rows[i].tobytes() if at_home and n == 0 else None)  # noqa: B023
                        for c, v in zip(out, row, strict=True):
                            c.append(v)
                return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5], pa.binary())], names=["query_id", "query_row", "home", "vec_id", "score", "vector"])

            for what, payload in pairs:
                batch = packed.unpack(payload)
                if what == VECTORS:
                    held.append(batch)
                    continue
                tree = tree or grown()
                if tree:
                    rows = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float64).reshape(batch.num_rows, dim)
                    yield answers(tree, packed.column(batch, "query_id"), packed.column(batch, "query_row"), rows, packed.column(batch, "kth"), packed.column(batch, "kth_id"))
            if at_home and (tree := grown()):
                mine = np.flatnonzero(tree.ids % every == 0)
                for a in range(0, len(mine), BLOCK):
                    at = mine[a : a + BLOCK]
                    yield answers(tree, tree.ids[at], tree.own[at], tree.rows[at], np.full(len(at), -np.inf), np.zeros(len(at)))

    return work


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    if good.groupBy("vec_id").count().filter("count > 1").limit(1).count():
        good = materialise(good.withColumn("row", F.monotonically_increasing_id()))  # written, so that a lost task finds the same numbers
    else:
        good = good.withColumn("row", F.col("vec_id"))
    n, dim = good.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    shards = max(1, math.ceil(n / SHARD), min(partitions(spark), n // 4096))
    sent = good.mapInArrow(packed.frugal(send(dim, shards, scale)), packed.SCHEMA)
    first = materialise(packed.deal(sent, shards, look(dim, k, every, True), FOUND))
    mine = first.filter("vector is not null").select("query_id", "query_row", "home", "vector")
    ranked = F.sort_array(F.collect_list(F.struct("score", (-F.col("vec_id")).alias("low"))), asc=False)
    best = first.filter("vec_id is not null").groupBy("query_row").agg(F.get(ranked, F.lit(k - 1)).alias("at")).filter("at is not null")
    kth = best.select("query_row", F.col("at.score").cast("double").alias("kth"), (-F.col("at.low")).alias("kth_id"))
    asked = mine.join(kth, "query_row", "left").select("query_id", "query_row", "home", "vector", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"), F.coalesce("kth_id", F.lit(0)).alias("kth_id"))
    if shards > 1:
        blocks = asked.mapInArrow(packed.frugal(send_queries(shards)), packed.SCHEMA)
        more = packed.deal(sent.unionAll(blocks), shards, look(dim, k, every, False), FOUND)
        first = first.unionAll(more)
    found = first.filter("vec_id is not null").select("query_id", "query_row", "vec_id", "score")
    place = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}
"""
