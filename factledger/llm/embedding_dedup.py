"""Near-dedup of embeddings by collision-counting projections.

Vectors of one label are compared by cosine. Equal vectors are merged first, into classes with a number of copies, so a group of
copies of any size is one row. A class is projected onto many random lines. Two unit vectors at distance d differ on a line by a normal
number of deviation d, independently from line to line, so how often one falls into the window of half-width `WIDTH` d around
the other is binomial; `calibrate` takes the largest count that a pair right at the threshold misses with probability `MISS` at most.
Around every query the sorted projections of its tile give the windows, collisions are counted for each pair, and pairs that
reach the count are verified by their cosine.

Tiles: where a label has many classes, `routes` deals them by a grid over a few more lines, several times over, so that a pair at the
threshold shares a cell with probability 1 - `MISS` at least; a pair is taken in the first deal that has it in one cell. A cell of
more than `BLOCK` classes, such as a dense group, is cut into blocks and each pair of blocks is a tile, so no task ever holds more than two blocks.
A tile sends on a count of links for each class and a star for each of its groups, never pairs. The count of links is exact for
all pairs found, so the work on a dense group still grows with the square of its different vectors, as tiles.

Defined results: vectors that are null or zero, or hold null or non-finite components, and rows without a label link with nothing: no links, a
component of their own. Vectors of different length don't link. Rows that repeat a vec_id are vectors of their own, and count as
others; a null vec_id takes part but never names a component unless nothing else is there (then component_id is null), and is never kept. Extra columns are ignored,
whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm import packed
from factledger.llm.common import materialise, partitions, table
from factledger.llm.simhash import components

COSINE = 0.93
#: Lines that are counted, half-width of a window in distances at the threshold, and how often a pair at the threshold may be missed, by the count and by the deal each.
LINES, WIDTH, MISS = 32, 1.0, 1e-3
#: Classes in a block; classes of a label from which a line is added to the grid, and again at each doubling; cells' width on unit vectors' projections.
BLOCK, ALONE, CELL = 4096, 32768, 3.0
SEED = 13


class Plan(NamedTuple):
    """How a label's classes are compared."""

    half_width: float
    least: int
    grid: int
    deals: int


def tail(n: int, p: float, miss: float) -> int:
    """The largest count that a binomial number falls below with this probability at most."""
    below, k = 0.0, 0
    while k <= n and below + math.comb(n, k) * p**k * (1 - p) ** (n - k) <= miss:
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        k += 1
    return k


def calibrate(cosine: float, classes: int) -> Plan:
    d = math.sqrt(max(0.0, 2 - 2 * cosine))
    inside = math.erf(WIDTH / math.sqrt(2))
    grid = max(0, math.ceil(math.log2(max(1, classes) / ALONE)))
    together = max(0.0, 1 - d * math.sqrt(2 / math.pi) / CELL) ** grid  # at least so often a pair is in one cell
    deals = 1 if grid == 0 else math.ceil(math.log(MISS) / math.log(1 - together))
    return Plan(d * WIDTH, tail(LINES, inside, MISS), grid, deals)


@lru_cache(16)
def lines(size: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, n))


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def routes(vectors: np.ndarray, plan: Plan, label_seed: int = SEED) -> np.ndarray:
    """The cell of each vector in each deal, as one number: hashed places on the grid's lines."""
    out = np.zeros((len(vectors), plan.deals), np.int64)
    for g in range(plan.deals if plan.grid else 0):
        rng = np.random.default_rng([label_seed, g, vectors.shape[1]])
        axes, shift = rng.standard_normal((vectors.shape[1], plan.grid)), rng.uniform(0, CELL, plan.grid)
        place = np.floor((unit(vectors) @ axes + shift) / CELL).astype(np.int64)
        out[:, g] = place @ (rng.integers(1, 1 << 62, plan.grid) | 1)
    return out


def collisions(queries: np.ndarray, base: np.ndarray, plan: Plan) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the rows of base that fall into its windows on `least` lines or more."""
    way = lines(base.shape[1], LINES, SEED)
    on_line, asked = (base @ way).T, (queries @ way).T
    order = np.argsort(on_line, axis=1)
    by_line = np.take_along_axis(on_line, order, axis=1)
    low = np.stack([np.searchsorted(s, q - plan.half_width, "left") for s, q in zip(by_line, asked, strict=True)], axis=1).tolist()
    high = np.stack([np.searchsorted(s, q + plan.half_width, "right") for s, q in zip(by_line, asked, strict=True)], axis=1).tolist()
    count = np.zeros(len(base), np.uint16)
    for i, (lo, hi) in enumerate(zip(low, high, strict=True)):
        count[:] = 0
        for j in range(LINES):
            count[order[j, lo[j] : hi[j]]] += 1
        yield i, np.flatnonzero(count >= plan.least)


def compare(first: dict, second: dict | None, plan: Plan, deal: int, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of a tile: how many rows each class of both blocks links with, and the linked pairs' forest. Without a second block: the pairs within the first."""
    base = first if second is None else second
    q, b = unit(first["vector"]), unit(base["vector"])
    mine, theirs = np.zeros(len(q), np.int64), np.zeros(len(b), np.int64)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, near in collisions(q, b, plan):
        if second is None:
            near = near[near > i]
        near = near[b[near] @ q[i] >= cosine]
        if deal and len(near):  # an earlier deal has this pair in one cell
            near = near[(base["cells"][near, :deal] != first["cells"][i, :deal]).all(axis=1)]
        if not len(near):
            continue
        mine[i] += base["copies"][near].sum()
        theirs[near] += first["copies"][i]
        a = find(int(first["id"][i]))
        for other in base["id"][near].tolist():
            root[find(other)] = a
    if second is None:
        mine += theirs
    return mine, theirs, [(x, find(x)) for x in root if find(x) != x]


def tiles(plans: dict[tuple, Plan], cosine: float) -> callable:
    """Counts and stars of each tile, from rows sorted by tile and block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in whole(batches, ["label", "size", "deal", "cell", "low_block", "high_block"]):
            label, size, deal, _, low, high = key
            side = lambda k, rows=rows: {n: x[rows["block"] == k] for n, x in rows.items()}
            first, second = side(low), None if low == high else side(high)
            mine, theirs, star = compare(first, second, plans[label, size], deal, cosine)
            for ids, n in ((first["id"], mine), *([] if second is None else [(second["id"], theirs)])):
                yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.nulls(int((n > 0).sum()), pa.int64()), pa.array(n[n > 0])], names=["u", "v", "n"])
            if star:
                u, v = zip(*star, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.nulls(len(u), pa.int64())], names=["u", "v", "n"])

    return packed.frugal(work)


def whole(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, dict]]:
    """(key, its columns) for rows that come sorted by key."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names], axis=1)
        cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            now = tuple(keys[a].tolist())
            if held and now != key:
                yield key, columns(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, columns(held)


def columns(held: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    got = pa.Table.from_batches(held).combine_chunks()
    plain = {n: got[n].to_numpy() for n in ("block", "id", "copies")}
    return plain | {"vector": matrix(pa.concat_arrays(got["vector"].chunks)), "cells": matrix(pa.concat_arrays(got["cells"].chunks))}


def usable(vector: str = "embedding") -> F.Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col("label").isNotNull() & F.col(vector).isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    good = rows.filter(usable())
    classes = good.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("id"), "label", F.size("embedding").cast("long").alias("size"), F.col("embedding").alias("vector"), "copies", "low"))
    plans = {(r.label, r.size): calibrate(cosine, r.n) for r in classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as labels

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, size = batch.column("label").to_numpy(), batch.column("size").to_numpy()
            for key in sorted(set(zip(label.tolist(), size.tolist(), strict=True))):
                some = batch.filter(pa.array((label == key[0]) & (size == key[1])))
                cell = routes(matrix(some.column("vector")), plans[key])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1) * cell.shape[1], pa.int32()), pa.array(cell.ravel()))
                yield pa.RecordBatch.from_arrays([*(some.column(n) for n in ("id", "label", "size", "vector", "copies")), lists], names=["id", "label", "size", "vector", "copies", "cells"])

    dealt = classes.select("id", "label", "size", "vector", "copies").mapInArrow(packed.frugal(cells), "id long, label long, size long, vector array<double>, copies long, cells array<long>")
    dealt = dealt.select("*", F.posexplode("cells").alias("deal", "cell"))
    key = ["label", "size", "deal", "cell"]
    blocks = dealt.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = dealt.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = placed.select(*key, F.least("block", "with").alias("low_block"), F.greatest("block", "with").alias("high_block"), "block", "id", "vector", "copies", "cells")
    tile = [*key, "low_block", "high_block"]
    found = tiled.repartition(partitions(spark), *tile).sortWithinPartitions(*tile).mapInArrow(tiles(plans, cosine), "u long, v long, n long")
    found = materialise(found)
    counts = found.filter("v is null").groupBy("u").agg(F.sum("n").alias("others"))
    roots = components(found.filter("v is not null").select("u", "v"))
    named = classes.join(counts, classes.id == counts.u, "left").join(roots, classes.id == roots.v, "left")
    named = named.select("label", F.col("vector").alias("embedding"), "low", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    groups = named.groupBy("root").agg(F.min("low").alias("component_id"))
    answers = named.join(groups, "root").select("label", "embedding", "n_links", "component_id")
    linked = good.join(answers, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(usable(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE given AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (
    SELECT r, vec_id, label, len(e) AS size, e, sqrt(list_inner_product(e, e)) AS norm FROM given
    WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.size = b.size AND a.r <> b.r
    WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {COSINE}
),
reach(a, b) AS (SELECT r, r FROM given UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT reach.a AS r, min(given.vec_id) AS component_id FROM reach JOIN given ON reach.b = given.r GROUP BY 1),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, FALSE) AS kept
FROM given JOIN named USING (r) LEFT JOIN counts USING (r)
"""
