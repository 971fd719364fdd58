"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. Whole copies of all its documents come first. The words that are left are sampled with
unequal probabilities: a document's inclusion is its size times a factor of its source, at most 1, so that the expected words are
those that are left; documents with inclusion 1 are certain. The others are ranked by the odds of a fixed random number divided by
their inclusion odds. The sample is the beginning of that order whose words fit, and then the one later document that comes nearest to the words
still missing.

No source is ever ordered in one task: ranks are cut into ranges of their logarithm, whose words are summed before they are
shuffled; the range in which the words run out is cut again, and only one of its parts is ordered row by row. Tables with one row
for each source are stored, so that Spark knows their size and broadcasts them only below its limit.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of its own and comes last;
repeated rows and rows without an id are documents of their own, each with its own random number; a source without
words has target 0; an empty table gives an empty table; `mix` hands through all columns as the struct `doc`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factledger.llm.common import WORD, count_words, materialise, table, with_ids

#: Fixed values of the query's contract.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BITS = 52
#: Ranges of a rank's logarithm by unit, and parts of the range that holds the cut.
RANGES, PARTS = 256, 4096
SEED = "mix"


def random_bits(row_id: Column, seed: str = SEED) -> Column:
    """A fixed number below 2^52 for each document, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), row_id.cast("string"))), 1, BITS // 4), 16, 10).cast("long")


def pareto_rank(bits: Column, inclusion: Column) -> Column:
    """Odds of the random number divided by the odds of inclusion; 0 for what is certain, null for what is never taken."""
    u = (bits.cast("double") + 0.5) / float(1 << BITS)
    return F.when(inclusion >= 1, 0.0).when(inclusion > 0, (u / (1 - u)) * ((1 - inclusion) / inclusion))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """mix_source, mix_words and mix_target of every source of (mix_source, mix_words).

    Sources fill in the order in which they reach their limit, which gives at once what resharing the excess
    again and again ends in. One row per source; the tables here have as many rows as there are sources.
    """
    by_name = W.orderBy(F.col("mix_source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("mix_weight", weight)
    fill = W.orderBy((F.col("mix_words") / F.col("mix_weight")).asc(), F.col("mix_source").asc_nulls_last())
    every = W.partitionBy()
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    left = share * F.sum("mix_words").over(every) - most * F.coalesce(F.sum("mix_words").over(before), F.lit(0))
    weight_left = F.sum("mix_weight").over(every) - F.coalesce(F.sum("mix_weight").over(before), F.lit(0.0))
    steps = weighed.withColumn("mix_level", left / weight_left).withColumn("mix_full", F.col("mix_level") * F.col("mix_weight") >= most * F.col("mix_words"))
    level = F.max(F.when(~F.col("mix_full"), F.col("mix_level"))).over(every)
    target = F.when(F.col("mix_full"), (most * F.col("mix_words")).cast("double")).otherwise(F.col("mix_weight") * level)
    return steps.select("mix_source", "mix_words", target.alias("mix_target"))


def joined(rows: DataFrame, per_source: DataFrame, *columns: str) -> DataFrame:
    """Columns of the table per source beside each row; null sources match. Spark broadcasts it only below its size limit."""
    return rows.alias("r").join(per_source.alias("p"), F.col("r.mix_source").eqNullSafe(F.col("p.mix_source")), "left").select("r.*", *(F.col(f"p.{c}") for c in columns))


def whole_copies(aim: DataFrame) -> DataFrame:
    """aim with the whole copies of every document of a source, and the words still missing then."""
    whole = F.when(F.col("mix_words") > 0, F.floor(F.col("mix_target") / F.col("mix_words"))).otherwise(F.lit(0)).cast("long")
    return aim.withColumn("mix_whole", whole).withColumn("mix_rest", F.col("mix_target") - F.col("mix_whole") * F.col("mix_words"))


def factors(sizes: DataFrame) -> DataFrame:
    """mix_source, mix_factor: inclusions are min(1, factor * size), and sizes times inclusions make mix_rest.

    `sizes` counts the documents (mix_n) of each source and size. If all larger sizes are certain, the factor follows from what they leave;
    the right one belongs to the largest size that isn't certain by its own factor.
    """
    size, n = F.col("mix_size").cast("decimal(19,0)"), F.col("mix_n").cast("decimal(19,0)")
    down = W.partitionBy("mix_source").orderBy(F.col("mix_size").desc())
    certain = F.coalesce(F.sum(size * n).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("double")
    squares = F.sum((F.col("mix_size") * F.col("mix_size")).cast("decimal(20,0)") * F.col("mix_n").cast("decimal(17,0)")).over(down.rowsBetween(0, W.unboundedFollowing)).cast("double")
    by_size = sizes.filter("mix_size > 0").withColumn("mix_factor", (F.col("mix_rest") - certain) / squares)
    return by_size.filter(F.col("mix_factor") * F.col("mix_size") <= 1).groupBy("mix_source").agg(F.max_by("mix_factor", "mix_size").alias("mix_factor"))


def first_over(sums: DataFrame, aim: DataFrame, place: str, start: Column) -> DataFrame:
    """mix_source, place, before: where the words (mix_in) of a source's places, summed up from `start`, first exceed mix_rest."""
    upto = F.sum("mix_in").over(W.partitionBy("mix_source").orderBy(place))
    running = joined(sums.withColumn("mix_sum", upto), aim, "mix_rest", *(["mix_before"] if "mix_before" in aim.columns else [])).withColumn("mix_sum", F.col("mix_sum") + start)
    over = running.filter(F.col("mix_sum") > F.col("mix_rest"))
    return over.groupBy("mix_source").agg(F.min(F.struct(place, (F.col("mix_sum") - F.col("mix_in")).alias("before"))).alias("first")).select("mix_source", F.col(f"first.{place}").alias(place), F.col("first.before").alias("before"))


def ranked(rows: DataFrame, aim: DataFrame, seed: str) -> DataFrame:
    """rows(mix_row, mix_source, mix_size, ...) with the table per source beside them, their rank, its range and its part of the range."""
    beside = joined(rows, aim, *(c for c in aim.columns if c != "mix_source"))
    rank = pareto_rank(random_bits(F.col("mix_row"), seed), F.least(F.lit(1.0), F.col("mix_factor") * F.col("mix_size")))
    level = F.ln("mix_rank") * RANGES
    fine = F.when(F.col("mix_rank") > 0, F.floor((level - F.floor(level)) * PARTS)).otherwise(F.lit(0)).cast("long")
    coarse = F.when(F.col("mix_rank") > 0, F.floor(level)).when(F.col("mix_rank") == 0, F.lit(-(1 << 40))).cast("long")
    return beside.withColumn("mix_rank", rank).withColumns({"mix_range": coarse, "mix_part": fine})


def early() -> Column:
    """Whether a row of `ranked` stands before the cut."""
    key = F.struct("mix_rank", "mix_row")
    inside = (F.col("mix_part") < F.col("mix_cut_part")) | ((F.col("mix_part") == F.col("mix_cut_part")) & F.coalesce(key <= F.col("mix_stop"), F.lit(False)))
    return F.coalesce((F.col("mix_range") < F.col("mix_cut_range")) | ((F.col("mix_range") == F.col("mix_cut_range")) & inside), F.lit(False))


def plan(sized: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: str) -> DataFrame:
    """The table per source by which `copies` decides; sized has mix_row, mix_source and mix_size."""
    sizes = materialise(sized.groupBy("mix_source", "mix_size").agg(F.count(F.lit(1)).alias("mix_n")))
    words = sizes.groupBy("mix_source").agg(F.sum(F.col("mix_size") * F.col("mix_n")).alias("mix_words"))
    aim = materialise(whole_copies(targets(words, weights, share, most)))
    aim = materialise(joined(aim, factors(joined(sizes, aim, "mix_rest")), "mix_factor"))
    some = sized.filter("mix_size > 0")
    ranges = ranked(some, aim, seed).groupBy("mix_source", "mix_range").agg(F.sum("mix_size").alias("mix_in"))
    cut = first_over(ranges, aim, "mix_range", F.lit(0)).select("mix_source", F.col("mix_range").alias("mix_cut_range"), F.col("before").alias("mix_before"))
    aim = materialise(joined(aim, cut, "mix_cut_range", "mix_before"))
    parts = ranked(some, aim, seed).filter("mix_range = mix_cut_range").groupBy("mix_source", "mix_part").agg(F.sum("mix_size").alias("mix_in"))
    cut = first_over(parts, aim, "mix_part", F.col("mix_before")).select("mix_source", F.col("mix_part").alias("mix_cut_part"), F.col("before").alias("mix_part_before"))
    aim = materialise(joined(aim, cut, "mix_cut_part", "mix_part_before"))
    upto = F.col("mix_part_before") + F.sum("mix_size").over(W.partitionBy("mix_source").orderBy("mix_rank", "mix_row"))
    inside = ranked(some, aim, seed).filter("mix_range = mix_cut_range and mix_part = mix_cut_part").withColumn("mix_sum", upto).filter("mix_sum <= mix_rest")
    stop = inside.groupBy("mix_source").agg(F.max(F.struct("mix_rank", "mix_row")).alias("mix_stop"), F.max("mix_sum").alias("mix_sum"))
    aim = joined(aim, stop, "mix_stop", "mix_sum").withColumn("mix_gap", F.col("mix_rest") - F.coalesce("mix_sum", "mix_part_before"))
    aim = materialise(aim.drop("mix_sum", "mix_before", "mix_part_before"))
    # The one later document that comes nearest to the words still missing.
    off = F.abs(F.col("mix_size") - F.col("mix_gap"))
    late = ranked(some, aim, seed).filter(~early() & (off < F.col("mix_gap")))
    last = late.groupBy("mix_source").agg(F.min_by("mix_row", F.struct(off, "mix_row")).alias("mix_last"))
    return materialise(joined(aim, last, "mix_last"))


def copies(sized: DataFrame, aim: DataFrame, seed: str) -> DataFrame:
    """sized with mix_words and mix_target of its source and mix_copies of each row."""
    taken = early() | F.coalesce(F.col("mix_row") == F.col("mix_last"), F.lit(False))
    found = ranked(sized, aim, seed).withColumn("mix_copies", F.col("mix_whole") + F.when(taken, 1).otherwise(0))
    return found.select(*sized.columns, "mix_words", "mix_target", "mix_copies")


def sizes_of(docs: DataFrame, size: Column) -> DataFrame:
    """The columns of docs as the struct doc, and mix_row, mix_source, mix_size."""
    rows = with_ids(docs.select(F.struct("*").alias("doc"), "doc_id", "text", F.col("source").alias("mix_source"), size.cast("long").alias("mix_size")), "mix_row")
    return rows.drop("doc_id", "text")


def mix(docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc (the columns of docs), mix_size, mix_words and mix_target of the source, and mix_copies of each document."""
    sized = sizes_of(docs, size)
    slim = materialise(sized.drop("doc"))
    return copies(sized, plan(slim, weights, share, most, seed), seed).drop("mix_row", "mix_source")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sized = sizes_of(docs, count_words(F.col("text")))
    slim = materialise(sized.withColumn("doc", F.struct("doc.doc_id")))  # texts are counted once
    found = copies(slim, plan(slim, WEIGHTS, SHARE, MOST, SEED), SEED)
    return found.select("doc.doc_id", F.col("mix_size").alias("size"), F.col("mix_words").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


_WEIGHTS = f"[{', '.join(f'{w}.0::DOUBLE' for w in WEIGHTS)}]"
ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
  (('0x' || substr(md5('{SEED}-' || doc_id::VARCHAR), 1, {BITS // 4}))::BIGINT + 0.5::DOUBLE) / {float(1 << BITS)!r}::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY 1),
w AS (SELECT *, {_WEIGHTS}[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM s),
l AS (SELECT *, ({SHARE} * sum(words) OVER () - {MOST} * coalesce(sum(words) OVER f, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM w WINDOW f AS (ORDER BY words / weight ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN level * weight >= {MOST} * words THEN {MOST} * words::DOUBLE ELSE weight * max(CASE WHEN level * weight < {MOST} * words THEN level END) OVER () END AS target FROM l),
a AS (SELECT *, CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END::BIGINT AS whole FROM t),
b AS (SELECT source, words, target, whole, target - whole * words AS rest FROM a),
h AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY 1, 2),
x AS (SELECT h.source, h.size, (b.rest - coalesce(sum(h.size * n) OVER (PARTITION BY h.source ORDER BY h.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(h.size::HUGEINT * h.size * n) OVER (PARTITION BY h.source ORDER BY h.size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS factor FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source),
y AS (SELECT source, arg_max(factor, size) AS factor FROM x WHERE factor * size <= 1 GROUP BY 1),
p AS (SELECT d.*, words, target, whole, rest, least(1.0::DOUBLE, factor * size) AS p FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN y ON d.source IS NOT DISTINCT FROM y.source),
k AS (SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS rank FROM p),
r AS (SELECT *, CASE WHEN rank IS NOT NULL THEN sum(size) OVER (PARTITION BY source ORDER BY rank ASC NULLS LAST, doc_id) END AS upto FROM k),
g AS (SELECT *, coalesce(upto <= rest, false) AS early, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM r),
n AS (SELECT *, CASE WHEN NOT early AND size > 0 AND abs(size - gap) < gap THEN row_number() OVER (PARTITION BY source ORDER BY CASE WHEN NOT early AND size > 0 AND abs(size - gap) < gap THEN 0 ELSE 1 END, abs(size - gap), doc_id) END AS nearest FROM g)
SELECT doc_id, size, words AS source_size, target, (size * (whole + CASE WHEN early OR coalesce(nearest = 1, false) THEN 1 ELSE 0 END))::BIGINT AS taken FROM n
"""
