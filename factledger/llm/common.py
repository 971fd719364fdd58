"""What the operators of this package share: tables, words, scratch folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these ASCII spaces.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
DUCK_WORD = r"[^\x20\x09-\x0D]+"


#: Spark's own size of an Arrow batch, which every task holds several times beside the heap, and the one used here in its place.
ARROW_BYTES, SPARKS_ARROW_BYTES, OUR_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20


def modest_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, where the session has Spark's own size of them."""
    if spark.conf.get(ARROW_BYTES, None) == f"{SPARKS_ARROW_BYTES}b":
        spark.conf.set(ARROW_BYTES, str(OUR_ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, null as none, without user code."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder the session names.

    Only where the session names none (a local session, as in tests) a folder of this machine is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        root = "file://" + tempfile.mkdtemp(prefix="factledger-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/factledger-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    modest_batches(spark)
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_ids(docs: DataFrame, name: str = "row_id") -> DataFrame:
    """docs with a unique number (long) in the order of doc_id, in a column of this name, which docs must not have.

    It is doc_id itself where that is unique and never null. Otherwise rows are sorted across partitions by doc_id, null
    first, and by hashes of the text and of all plain columns, and numbered from 0 in that order, so the numbers are the same in every run up
    to rows that are alike; the numbers are fixed by writing them down.
    """
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    plain = [c for c, t in docs.dtypes if "<" not in t and t not in ("variant", "interval")]
    keys = {f"{name}_{i}": k for i, k in enumerate((F.xxhash64("text"), F.xxhash64(*plain)))}
    order = [F.col("doc_id").asc_nulls_first(), *keys]
    spread = docs.withColumns(keys).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).drop(*keys)
    part, own = f"{name}_part", f"{name}_own"
    placed = materialise(spread.withColumns({part: F.spark_partition_id(), own: F.monotonically_increasing_id()}))
    counts = {r[0]: r[1] for r in placed.groupBy(part).count().collect()}  # as many rows as partitions
    before, at = [], 0
    for k, n in sorted(counts.items()):
        before.append((k, at - (k << 33)))  # own numbers of partition k begin at k * 2^33
        at += n
    begins = docs.sparkSession.createDataFrame(before, f"`{part}` int, `{name}_begin` long")
    return placed.join(F.broadcast(begins), part).withColumn(name, F.col(own) + F.col(f"{name}_begin")).select(*docs.columns, name)
