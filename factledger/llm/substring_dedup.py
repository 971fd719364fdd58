"""Substring dedup by relative Lempel-Ziv parsing over words.

Every document is factored against all reference blocks. Their index has the 35-word windows of all documents, by
content, in blocks dealt by sampled splitters (see `windows`): windows that share an anchor are held as one run, and looked up
one by one only where a run doesn't occur whole. A look-up gives a place that the window repeats: the first one there is, or for
the first one itself the last. A document is then parsed from left to right: a factor begins at the next window that repeats and goes on as long
as the following windows continue at the same place, so it is a copy of the words there (`factors`: start and length in words, and
where they are copied from). Windows across the end of a factor are looked up on their own, as all are. A factor has 35
words or more and is a duplicate span; a word goes if a factor covers it. The factor is the longest copy of the place that the index names,
not of all places; which words are covered does not depend on that.

No reference block is broadcast and nothing is compared pair by pair, so a passage that a third of all documents
shares costs a sorted run of rows, cut over buckets by document and start.

Defined results: a null or empty text has no words and the hash of nothing; texts shorter than a window lose
nothing; rows that repeat a doc_id, or have none, are documents of their own, so that exact copies repeat each other; an empty table gives
an empty table; `cut` hands through all columns, whatever their names. Words are compared by 128-bit fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm import windows
from factledger.llm.common import free_name, table, with_ids

LENGTH, PIECE = 35, 12
SCHEMA = "row_id long, doc_id long, n_words long, n_removed long, kept binary, factors array<struct<start: long, length: long, from_row: long, from_start: long>>"


def parse(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The factors (row, start, words, row copied from, start there) that records of repeated windows make, from left to right."""
    row, p, m, from_row, from_p = found
    if not len(row):
        return found
    end = p + m
    reach = np.maximum.accumulate((row << 34) + end)  # records of a row come by start, the longer first
    keep = np.r_[True, (row[1:] << 34) + end[1:] > reach[:-1]]
    row, p, m, from_row, from_p = (x[keep] for x in (row, p, m, from_row, from_p))
    on = (row[1:] == row[:-1]) & (p[1:] == p[:-1] + m[:-1]) & (from_row[1:] == from_row[:-1]) & (from_p[1:] == from_p[:-1] + m[:-1])
    first = np.flatnonzero(np.r_[True, ~on])
    return row[first], p[first], np.add.reduceat(m, first) + LENGTH - 1, from_row[first], from_p[first]


def finish(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, found: tuple) -> pa.RecordBatch:
    units = windows.word_units(data, offsets)
    row, start, words, from_row, from_start = parse(found)
    gone = windows.covered(units, (row, start, words - LENGTH + 1), LENGTH)
    factor = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, words, from_row, from_start)], ["start", "length", "from_row", "from_start"])
    factors = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(offsets))), pa.int32()), factor)
    stay = np.flatnonzero(~gone)
    n = len(data)
    inside = np.bincount(units.start[stay], minlength=n + 1) - np.bincount(units.end[stay], minlength=n + 1)
    take = np.cumsum(inside[:n]) > 0
    row = np.searchsorted(units.begins, stay, "right") - 1
    joints = units.end[stay[:-1][row[1:] == row[:-1]]]  # the space after each kept word but a document's last
    out = data.copy()
    out[joints] = 32
    take[joints] = True
    ends = np.r_[0, np.cumsum(take)][offsets].astype(np.int64)
    kept = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out[take].tobytes())])
    lost = np.diff(np.r_[0, np.cumsum(gone)][units.begins]).astype(np.int64)
    columns = [batch.column("id"), batch.column("doc_id"), pa.array(np.diff(units.begins).astype(np.int64)), pa.array(lost), kept.cast(pa.binary()), factors]
    return pa.RecordBatch.from_arrays(columns, names=["row_id", "doc_id", "n_words", "n_removed", "kept", "factors"])


def remove_repeats(rows: DataFrame) -> DataFrame:
    """row_id, doc_id, n_words, n_removed, the kept words (joined by one space) and the factors of rows(row_id, doc_id, text)."""
    kind = windows.Kind(windows.word_units, LENGTH, PIECE, False)
    slim = rows.select(F.col("row_id").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return windows.repeats(slim, kind, finish, SCHEMA)


def cut(docs: DataFrame) -> DataFrame:
    """docs without the words of duplicate spans; other texts stay as they are, and so do all other columns."""
    row, kept = free_name(docs, "row_id"), free_name(docs, "kept_text")
    rows = with_ids(docs, row)
    found = remove_repeats(rows.select(F.col(row).alias("row_id"), "doc_id", "text")).filter("n_removed > 0")
    changed = found.select(F.col("row_id").alias(row), F.decode("kept", "UTF-8").alias(kept))
    text = F.when(F.col(kept).isNotNull(), F.col(kept)).otherwise(F.col("text"))
    return rows.join(changed, row, "left").withColumn("text", text).select(*docs.columns)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(with_ids(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
