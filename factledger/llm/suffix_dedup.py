"""Suffix-array dedup of bytes: remove what a 100-byte string covers that also starts earlier.

The suffix array is sparse: of all suffixes only those at content-defined anchors are sorted (see `windows`), which is
enough as two equal strings share their anchor. Sampled splitters range-partition the suffixes by their leading
tokens (fingerprints of the leading piece and of the whole run; then leading bytes, for single windows); each bucket is
sorted by multikey quicksort, equal neighbours are found inside it, and the borders of buckets are compared with each
other. Document and start are the last tokens, so any number of equal suffixes can be cut over many buckets.

Defined results: a null or empty text has 0 bytes and the hash of nothing; texts shorter than the window lose nothing;
rows that repeat a doc_id, or have none, are documents of their own, ordered by a hash of their text; an empty table
gives an empty table; only doc_id and text are read, so other columns may have any name.
Fingerprints have 128 bits (64 for pieces, which are then told apart by whole runs).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm import windows
from factledger.llm.common import table, with_ids

LENGTH, PIECE = 100, 32


def finish(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, found: tuple) -> pa.RecordBatch:
    gone = windows.covered(windows.Units((data, data), offsets), found, LENGTH)
    rise = gone.copy()
    rise[1:] &= ~gone[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    rise[begins] = gone[begins]
    count = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][offsets])
    lost, spans = count(gone), count(rise)
    left = data[~gone]
    ends = np.r_[0, np.cumsum(np.diff(offsets) - lost)].astype(np.int64)
    kept = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(left.tobytes())])
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(lost.astype(np.int64)), pa.array(spans.astype(np.int64)), kept.cast(pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row of docs(doc_id, text)."""
    kind = windows.Kind(windows.byte_units, LENGTH, PIECE, True)
    rows = with_ids(docs.select("doc_id", "text")).select(F.col("row_id").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return windows.repeats(rows, kind, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
