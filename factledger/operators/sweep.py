"""Sweeps over sorted events and ordered folds that no single task holds.

Rows are range-partitioned by family and order, so a family of any size lies over as many partitions as it needs; what one partition
hands to the next is one row per family in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factledger import schema as S
from factledger.sources.store import scratch

FIRST, LAST = "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"
#: Rows that are folded at once, and rows of a family that may lie in one task.
BLOCK, LARGE = 4096, 10_000


def stored(df: DataFrame) -> DataFrame:
    """Written down in the shared folder and read again, so that what depends on how rows were dealt is fixed."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split(rows: DataFrame, family: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of families of at most `LARGE` rows, and those of the others, if there are any.

    Families are counted by a hash, so a few small ones may pass for large. A large one has over `LARGE` rows, so the list of them is short beside the rows.
    """
    key = F.xxhash64(*family)
    large = stored(rows.groupBy(key.alias("family_hash")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select("family_hash"))
    if large.isEmpty():
        return rows, None
    known = F.broadcast(large)
    return rows.join(known, key == F.col("family_hash"), "left_anti"), rows.join(known, key == F.col("family_hash"), "left_semi")


def running(rows: DataFrame, family: Sequence[str], order: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """rows with running totals (this row included) over their family, in an order that has no ties; columns of `family` are not null."""
    keys = [*family, *order]
    placed = stored(rows.withColumns({f"own_{k}": v for k, v in totals.items()}).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
    here = W.partitionBy("part", *family).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*family).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition that has some of the family
    sums = placed.groupBy("part", *family).agg(*(F.sum(f"own_{k}").alias(f"own_{k}") for k in totals))
    carried = sums.select("part", *family, *(F.coalesce(F.sum(f"own_{k}").over(before), F.lit(0)).alias(f"carried_{k}") for k in totals))
    local = placed.withColumns({k: F.sum(f"own_{k}").over(here) for k in totals})
    return local.join(carried, ["part", *family]).select(*rows.columns, *((F.col(k) + F.col(f"carried_{k}")).alias(k) for k in totals))


def swept(facts: DataFrame, family: Sequence[str]) -> DataFrame:
    """Facts (iri, eff_from, eff_to, family) with `place` (rank of their start in the family), `last` (the greatest place whose start lies before their end) and `ended` (facts that end up to their start).

    Facts of places place + 1 to last start while this one holds, so each overlapping pair is named once, by the fact that starts first. A fact overlaps
    last - ended - 1 others. A missing end of an interval is open; intervals are not empty (the ledger refuses those).
    """
    events = facts.select("iri", *family, F.explode(_moments()).alias("e")).select("iri", *family, "e.time", "e.kind")
    run = running(events, family, ["time", "kind", "iri"], {"starts": F.col("kind").cast("long"), "ends": (1 - F.col("kind")).cast("long")})
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    found = run.groupBy("iri").agg(at(1, "starts").alias("place"), at(0, "starts").alias("last"), at(1, "ends").alias("ended"))
    return facts.join(found, "iri")


def _moments() -> Column:
    """Start (kind 1) and end (kind 0) of a fact; a missing end of an interval is open, and what ends goes before what starts."""
    start = F.coalesce("eff_from", F.lit(FIRST).cast("timestamp_ntz"))
    end = F.coalesce("eff_to", F.lit(LAST).cast("timestamp_ntz"))
    return F.array(F.struct(start.alias("time"), F.lit(1).alias("kind")), F.struct(end.alias("time"), F.lit(0).alias("kind")))


def counted(facts: DataFrame, family: Sequence[str], finer: Sequence[str]) -> DataFrame:
    """facts with n and n_alike: how many others of the family, and of the finer family, each overlaps. For families that a task can hold: rows are dealt out once, by family."""
    dealt = facts.select("*", F.explode(_moments()).alias("e"))
    over = {"": W.partitionBy(*family), "_alike": W.partitionBy(*finer)}
    sums = {}
    for k, w in over.items():
        so_far = w.orderBy("e.time", "e.kind", "iri").rowsBetween(W.unboundedPreceding, 0)
        sums |= {f"starts{k}": F.sum(F.col("e.kind").cast("long")).over(so_far), f"ends{k}": F.sum(1 - F.col("e.kind").cast("long")).over(so_far)}
    run = dealt.select("*", *(v.alias(k) for k, v in sums.items()))
    at = lambda kind, c: F.max(F.when(F.col("e.kind") == kind, F.col(c)))
    counts = [(at(0, f"starts{k}") - at(1, f"ends{k}") - 1).alias(f"n{k}") for k in over]
    return run.groupBy(*facts.columns).agg(*counts)


def overlapping(facts: DataFrame, family: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """iri, other_iri and columns (`carry`, `other_...`) of all pairs of a family that overlap: an equi-join on places, whose rows are its pairs and nothing else."""
    placed = stored(swept(facts, family).select("iri", *family, *carry, "place", "last"))
    left = placed.filter("last > place").select("iri", *family, *carry, F.explode(F.sequence(F.col("place") + 1, F.col("last"))).alias("place"))
    right = placed.select(*family, "place", F.col("iri").alias("other_iri"), *(F.col(c).alias(f"other_{c}") for c in carry))
    return left.join(right, [*family, "place"]).drop("place")


def overlaps(facts: DataFrame, family: Sequence[str]) -> DataFrame:
    """iri and n: how many others of the family each fact overlaps, without making a pair."""
    return swept(facts, family).select("iri", (F.col("last") - F.col("ended") - 1).alias("n"))


def _long(x: int) -> Column:
    return F.lit(str(x)).cast("decimal(38,0)")


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, x)).cast("decimal(38,0)")


def composed(steps: Column) -> Column:
    """An array of steps (off, low, high), each of them x -> min(high, max(low, x + off)), as the one step that they make in their order.

    Steps of this form are closed under composition, which is associative; so saturating sums can be folded part by part.
    """
    none = F.struct(_long(0).alias("off"), _long(S.LONG_MIN).alias("low"), _long(S.LONG_MAX).alias("high"))
    return F.aggregate(steps, none, lambda a, b: F.struct((a["off"] + b["off"]).cast("decimal(38,0)").alias("off"), clamp(a["low"] + b["off"], b["low"], b["high"]).alias("low"), clamp(a["high"] + b["off"], b["low"], b["high"]).alias("high")))


def added(step: Column, to: Column) -> Column:
    """What a step makes of a long."""
    return clamp(to.cast("decimal(38,0)") + step["off"], step["low"], step["high"]).cast("long")


def _steps(order: str, weight: str) -> Column:
    """All weights of a group as one step, in the given order."""
    one = F.struct(F.col(order).alias("o"), F.col(weight).cast("decimal(38,0)").alias("off"), _long(S.LONG_MIN).alias("low"), _long(S.LONG_MAX).alias("high"))
    return composed(F.array_sort(F.collect_list(one)))


def _folded_across(rows: DataFrame, keys: Sequence[str], order: str, weight: str, inner: dict[str, Column], outer: dict[str, Column]) -> DataFrame:
    """`folded` for keys of any number of rows.

    Rows lie in ranges of (keys, order); a block is at most `BLOCK` neighbours, so no array grows with a key, but for one entry a block.
    """
    block = rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).withColumn("block", F.expr(f"monotonically_increasing_id() div {BLOCK}"))
    parts = block.groupBy(*keys, "block").agg(_steps(order, weight).alias("step"), *(v.alias(k) for k, v in inner.items()))
    step = F.struct(F.col("block").alias("o"), "step.off", "step.low", "step.high")
    return parts.groupBy(*keys).agg(composed(F.array_sort(F.collect_list(step))).alias("step"), *(v.alias(k) for k, v in outer.items()))


def folded(rows: DataFrame, keys: Sequence[str], order: str, weight: str, inner: dict[str, Column], outer: dict[str, Column]) -> DataFrame:
    """keys, `step` (all weights of a key, added with saturation in the given order) and aggregates, first `inner` by block, then `outer` over the blocks.

    A key of at most `LARGE` rows is one block: its rows are dealt out once. Rows of the other keys are sorted across partitions.
    """
    few, many = split(rows, keys)
    parts = few.groupBy(*keys).agg(_steps(order, weight).alias("step"), *(v.alias(k) for k, v in inner.items()))
    # Grouped again by the same keys, so `outer` applies and nothing moves.
    found = parts.groupBy(*keys).agg(F.first("step").alias("step"), *(v.alias(k) for k, v in outer.items()))
    return found if many is None else found.unionByName(_folded_across(many, keys, order, weight, inner, outer))
