"""The ledger's changes as a stream.

Commit files are the source: each arrives whole and names the tables and the folder of one version, so a stream sees exactly what was
committed, in the order of versions, and what was never committed does not appear. How far versions were handled is kept with the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factledger.sources.store import TABLES, Store, versioned

COMMIT = "tables array<string>, attempt string"


def commits(store: Store) -> DataFrame:
    """A stream of version, tables and attempt of every commit."""
    found = store.spark.readStream.schema(COMMIT).json(f"{store.path}/_commits")
    return found.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).cast("long").alias("version"), "tables", "attempt")


def attempts(store: Store, table: str, after: int, upto: int) -> list[tuple[int, str]]:
    """(version, folder) of the commits to a table behind one version and up to another, in order; a torn commit is passed over."""
    known = ((v, store._file("_commits", v)) for v in range(after + 1, upto + 1))
    return [(v, c["attempt"]) for v, c in known if c and table in c["tables"]]


def changes(store: Store, table: str, after: int, upto: int) -> DataFrame:
    """version, key, kind (insert, update, delete), before, after: what each commit of the range did to each row.

    Only touched keys are looked up in the older version, and a row meets only the versions of its own key. A commit that writes a row as it was is no change, nor is
    one that deletes what isn't there.
    """
    key, schema = TABLES[table]
    runs = attempts(store, table, after, upto)
    names = [x.strip().split(" ", 1)[0] for x in schema.split(", ")]
    if not runs:
        nothing = store.spark.createDataFrame([], schema)
        row = F.struct(*names)
        return nothing.select(F.lit(0).cast("long").alias("version"), F.col(key).alias("key"), F.lit("").alias("kind"), row.alias("before"), row.alias("after"))
    new = store._scan(table, runs, versioned(schema)).withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    known = new
    if store.runs(table, after):  # else no key is old
        old = store.read(table, after).join(new.select(key).distinct(), key, "left_semi").withColumns({"deleted": F.lit(False), "version": F.lit(after).cast("long")})
        known = new.unionByName(old)
    state = known.select("version", F.col(key).alias("key"), F.when(~F.col("deleted"), F.struct(*names)).alias("after"))
    found = state.withColumn("before", F.lag("after").over(W.partitionBy("key").orderBy("version"))).filter(F.col("version") > after)
    kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return found.filter(~F.col("before").eqNullSafe(F.col("after"))).select("version", "key", kind.alias("kind"), "before", "after")


def _ranges(store: Store, handle: Callable[[int, int], None], checkpoint: str) -> StreamingQuery:
    """`handle(after, upto)` for ranges of versions that follow each other without gap or overlap.

    Commit files only wake the stream. A batch ends at the last version it was told of, and begins where the batch before it ended, which is noted beside the checkpoint
    before its own work is counted as done: a commit that a listing missed falls into the range of the next, and one that is listed late is done already.
    """
    notes = Store(store.spark, f"{checkpoint}-ranges")

    def each(batch: DataFrame, number: int) -> None:
        past = [n for n in notes._numbers("batches") if n < number]
        after = int(notes._read("batches", str(max(past)))) if past else 0
        upto = max(after, batch.agg(F.max("version")).first()[0] or 0)
        if upto > after:
            handle(after, upto)
        notes._write(str(upto), "batches", str(number))

    return commits(store).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(store: Store, table: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """`handle(rows, version)` for the row versions of a table in each new commit (`deleted` rows end a key), in order; ends when all are handled."""
    schema = f"{TABLES[table][1]}, deleted boolean"

    def each(after: int, upto: int) -> None:
        for version, attempt in attempts(store, table, after, upto):  # commits, not rows
            handle(store.spark.read.schema(schema).parquet(f"{store.path}/{table}/{attempt}"), version)

    return _ranges(store, each, checkpoint)


def follow_changes(store: Store, table: str, handle: Callable[[DataFrame, int, int], None], checkpoint: str) -> StreamingQuery:
    """`handle(changes, after, upto)` for ranges of versions in order, with each row before and after; a range is told again if its handler failed."""
    return _ranges(store, lambda after, upto: handle(changes(store, table, after, upto), after, upto), checkpoint)
