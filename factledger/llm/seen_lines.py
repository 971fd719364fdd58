"""First-seen line stripping: a stream that remembers, per hash shard, in how many documents each line has stood.

Documents come in batches. A line goes if its key (stripped at both ends, A-Z lower-cased) has `least_chars` code points or more and at
least `least_docs` documents of earlier batches held it. `Stripper.feed` runs a Structured Streaming query with state on one checkpoint,
started anew for each batch; a new `Stripper` on the same folder goes on at the batch an old one had reached, and feeding a batch again changes nothing.

Documents are cut into chunks of about `CHUNK_BYTES`, in the task that first reads them. A chunk sends each of its different keys once, with how many of its documents and lines
hold it, packed by the shard of the key's digest; so a line that every document holds is one record a chunk. `applyInPandasWithState` has one group per shard: its state is two
blobs, the sorted SHA-256 digests (32 bytes each) and their counts of documents. Look-ups are binary searches (`numpy.searchsorted`) in the state as it was before the batch, the batch's digests are merged in afterwards.
The answer names, per chunk, the digests that go; documents meet these by chunk, and nothing is ever broadcast or sent to the driver.
The number of shards follows the bytes of the first batch times the batches expected, so that a state of `SHARD_BYTES` of text or so stays small.

Defined results: a null or empty text is one empty line; trailing empty lines count; rows that repeat a doc_id, or have none, are documents
of their own (without an id: of the first batch); keys of a document count once, however often it holds them; a text whose lines all go is
empty; a batch or a table without rows gives no rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factledger.llm import packed
from factledger.llm.common import SPACES, partitions, shared_dir, table

BATCHES, LEAST_DOCS, LEAST_CHARS = 8, 5, 10
#: Bytes of text in a chunk and in all batches' share of a shard; records of a shard that wait to be merged.
CHUNK_BYTES, SHARD_BYTES, WAITING = 2 << 20, 16 << 20, 1 << 20
STAGED = "doc_id long, text string, chunk long"
FOUND = "kind int, chunk long, batch int, digests binary, docs binary, lines binary"
CHUNK, KEY = 0, 1
_STRIP, _DIGEST = SPACES.encode(), np.dtype("S32")


def keys_of(text: bytes, least_chars: int) -> list[bytes | None]:
    """The key of each line, or None where it is too short to be judged."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(_STRIP).lower()
        size = len(key)
        if size >= least_chars and (size >= 4 * least_chars or sum((b & 0xC0) != 0x80 for b in key) >= least_chars):
            out.append(key)
        else:
            out.append(None)
    return out


def each_text(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = packed.texts(batch, "text")
    view = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(view[a:b])


def cut_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their chunk: the task's rows come by batch and are cut where a chunk is full or the batch ends."""
    part, number, size, now = TaskContext.get().partitionId(), 0, 0, None
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_pylist()
        chunk = []
        for n, b in zip(lengths, batch.column("batch").to_pylist(), strict=True):
            if b != now or size > CHUNK_BYTES:
                number, size, now = number + 1, 0, b
            size += n
            chunk.append((part << 32) | number)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "text", "batch")), pa.array(chunk, pa.int64())], names=["doc_id", "text", "batch", "chunk"])


def send_keys(shards: int, least_chars: int) -> callable:
    """For each chunk and shard: the chunk's different digests, and how many of its documents and lines hold each."""

    def packed_rows(chunk: int, lot: int, held: dict[bytes, list[int]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        digest = np.array([hashlib.sha256(k).digest() for k in held], _DIGEST)
        docs, lines = np.array(list(held.values()), np.int64).T
        shard = digest.view(np.uint8).reshape(-1, 32)[:, :8].copy().view(np.uint64).ravel() % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(shard[order])) + 1, len(order)]
        out = [(int(shard[order[a]]), chunk, lot, digest[order[a:b]].tobytes(), docs[order[a:b]].tobytes(), lines[order[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "chunk", "batch", "digests", "docs", "lines"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for text, chunk, lot in zip(each_text(batch), batch.column("chunk").to_pylist(), batch.column("batch").to_pylist(), strict=True):
                if now != (chunk, lot):
                    if now:
                        yield from packed_rows(*now, held)
                    now, held = (chunk, lot), {}
                own = set()
                for key in keys_of(text, least_chars):
                    if key is not None:
                        count = held.setdefault(key, [0, 0])
                        count[1] += 1
                        if key not in own:
                            own.add(key)
                            count[0] += 1
        if now:
            yield from packed_rows(*now, held)

    return packed.frugal(work)


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sorted different digests with the sums of their counts."""
    digest = np.concatenate([p[0] for p in parts])
    different, of = np.unique(digest, return_inverse=True)
    return different, *(np.bincount(of, np.concatenate([p[i] for p in parts]), len(different)).astype(np.int64) for i in range(1, len(parts[0])))


def found_at(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted `known` has what is asked (anywhere, if it hasn't), and whether it has it."""
    if not len(known):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return at, known[at] == asked


def remember(least_docs: int) -> callable:
    """Answers a shard's records from its state as it was, then counts them in."""

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blobs = state.get if state.exists else (b"", b"")
        known, counts = np.frombuffer(blobs[0], _DIGEST), np.frombuffer(blobs[1], np.int64)
        parts, waiting, gone, lot = [], 0, [], 0
        for frame in frames:
            out = []
            for chunk, lot, *cells in zip(frame["chunk"], frame["batch"], frame["digests"], frame["docs"], frame["lines"], strict=True):
                digest, docs, lines = (np.frombuffer(c, t) for c, t in zip(cells, (_DIGEST, np.int64, np.int64), strict=True))
                at, there = found_at(known, digest)
                old = there & (counts[at] >= least_docs) if len(known) else there
                if old.any():
                    out.append((CHUNK, chunk, lot, digest[old].tobytes(), None, None))
                    gone.append((digest[old], lines[old]))
                parts.append((digest, docs))
                waiting += len(digest)
                if waiting > WAITING:
                    parts = [merged(parts)]
                    waiting = 0
            yield pd.DataFrame(out, columns=["kind", "chunk", "batch", "digests", "docs", "lines"])
        if not parts:
            return
        fresh, docs = merged(parts)
        at, there = found_at(known, fresh)
        counts = counts.copy()
        counts[at[there]] += docs[there]
        place = np.searchsorted(known, fresh[~there])
        known, counts = np.insert(known, place, fresh[~there]), np.insert(counts, place, docs[~there])
        state.update((known.tobytes(), counts.tobytes()))
        if gone:
            digest, lines = merged(gone)
            at, _ = found_at(known, digest)
            yield pd.DataFrame([(KEY, None, lot, digest.tobytes(), counts[at].tobytes(), lines.tobytes())], columns=["kind", "chunk", "batch", "digests", "docs", "lines"])

    return work


def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without the lines that go, from rows sorted by chunk: first the digests, then the texts."""
    now, gone, known = None, set(), {}

    def goes(key: bytes | None) -> bool:
        if key is None:
            return False
        if key not in known:
            known[key] = hashlib.sha256(key).digest() in gone
        return known[key]

    for batch in batches:
        out = []
        least = batch.column("least_chars").to_pylist()
        cells = (batch.column(n).to_pylist() for n in ("chunk", "kind", "digests", "doc_id", "batch"))
        for text, chars, chunk, kind, digests, doc, lot in zip(each_text(batch), least, *cells, strict=True):
            if chunk != now:
                now, gone, known = chunk, set(), {}
            if kind == 0:
                gone.update(digests[i : i + 32] for i in range(0, len(digests), 32))
                continue
            n = text.count(b"\n") + 1
            lost = [goes(k) for k in keys_of(text, chars)] if gone else []
            if any(lost):
                text = b"\n".join(line for line, x in zip(text.split(b"\n"), lost, strict=True) if not x)
            out.append((doc, lot, n, sum(lost), text))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays([*cols[:4], cols[4].cast(pa.string())], names=["doc_id", "batch", "n_all", "n_removed", "kept"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest of the packed totals."""
    for batch in batches:
        for lot, *cells in zip(*(batch.column(n).to_pylist() for n in ("batch", "digests", "docs", "lines")), strict=True):
            digest, docs, lines = (np.frombuffer(c, t) for c, t in zip(cells, (_DIGEST, np.int64, np.int64), strict=True))
            raw = [cells[0][i : i + 32] for i in range(0, len(cells[0]), 32)]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array(np.full(len(digest), lot, np.int32)), pa.array(docs), pa.array(lines)], names=["digest", "batch", "docs", "lines"])


class Stripper:
    """A store of seen lines in a folder of its own, fed batch by batch."""

    def __init__(self, spark: SparkSession, shards: int, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, folder: str | None = None) -> None:
        self.spark, self.shards, self.least_docs, self.least_chars = spark, shards, least_docs, least_chars
        self.folder = folder or shared_dir(spark)
        hadoop = spark._jvm.org.apache.hadoop.fs
        self.path = hadoop.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self.path(f"{self.folder}/feed"))

    def stage(self, docs: DataFrame) -> None:
        """Write documents (doc_id, text, batch) down in chunks, by batch, where the stream doesn't see them yet."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("batch").cast("int").alias("batch"))
        cut = rows.sortWithinPartitions("batch").mapInArrow(packed.frugal(cut_chunks), "doc_id long, text string, batch int, chunk long")
        cut.sortWithinPartitions("batch", "chunk").write.partitionBy("batch").option("compression", "zstd").parquet(f"{self.folder}/staged")

    def feed(self, batch: int) -> None:
        """Hand one staged batch to the stream and wait until it has counted it."""
        staged = self.path(f"{self.folder}/staged/batch={batch}")
        if self.files.exists(staged):
            self.files.rename(staged, self.path(f"{self.folder}/feed/batch={batch}"))
        source = self.spark.readStream.schema(f"{STAGED}, batch int").parquet(f"{self.folder}/feed")
        keys = source.mapInArrow(send_keys(self.shards, self.least_chars), "shard int, chunk long, batch int, digests binary, docs binary, lines binary")
        answers = keys.groupBy("shard").applyInPandasWithState(remember(self.least_docs), FOUND, "digests binary, docs binary", "append", GroupStateTimeout.NoTimeout)
        running = answers.writeStream.format("parquet").option("checkpointLocation", f"{self.folder}/stream").trigger(availableNow=True).start(f"{self.folder}/found")
        running.awaitTermination()

    def answers(self, kind: int) -> DataFrame:
        return self.spark.read.schema(FOUND).parquet(f"{self.folder}/found").filter(F.col("kind") == kind)

    def documents(self) -> DataFrame:
        """doc_id, batch, n_all, n_removed and kept (the text that stays) of every document fed so far."""
        nothing = F.lit(None)
        texts = self.spark.read.schema(f"{STAGED}, batch int").parquet(f"{self.folder}/feed")
        texts = texts.select("chunk", F.lit(1).alias("kind"), "doc_id", "batch", "text", nothing.cast("binary").alias("digests"))
        gone = self.answers(CHUNK).select("chunk", F.lit(0).alias("kind"), nothing.cast("long").alias("doc_id"), "batch", nothing.cast("string").alias("text"), "digests")
        both = texts.unionAll(gone).withColumn("least_chars", F.lit(self.least_chars))
        dealt = both.repartition(max(partitions(self.spark), self.shards), "chunk").sortWithinPartitions("chunk", "kind")
        return dealt.mapInArrow(packed.frugal(strip), "doc_id long, batch int, n_all long, n_removed long, kept string")

    def lines(self) -> DataFrame:
        """digest (SHA-256 of the key), batch (the first that lost lines), n_all (documents that hold it) and n_removed (lines) of each key that lost lines."""
        rows = self.answers(KEY).mapInArrow(packed.frugal(unpacked), "digest binary, batch int, docs long, lines long")
        return rows.groupBy("digest").agg(F.min("batch").alias("batch"), F.max("docs").alias("n_all"), F.sum("lines").alias("n_removed"))


def strip_seen(docs: DataFrame, batches: int = BATCHES, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> Stripper:
    """Feed documents (doc_id, text, batch from 0) in order of batch; ask what comes back for `documents` and `lines`."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    store = Stripper(docs.sparkSession, max(partitions(docs.sparkSession), total // SHARD_BYTES), least_docs, least_chars)
    store.stage(docs)
    for batch in range(batches):
        store.feed(batch)
    return store


def batch_of(doc_id: F.Column, batches: int = BATCHES) -> F.Column:
    """floor(batches * (crc32(decimal doc_id) mod 64) / 64); without an id 0."""
    return F.coalesce(F.floor(F.crc32(doc_id.cast("long").cast("string")) % 64 * batches / 64), F.lit(0)).cast("int")


def op11_seen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = strip_seen(docs.select("doc_id", "text", batch_of(F.col("doc_id")).alias("batch")))
    rows = store.documents().select(F.lit("doc").alias("row_kind"), F.col("doc_id").cast("string").alias("row_id"), "batch", "n_all", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    lines = store.lines().select(F.lit("line").alias("row_kind"), F.lower(F.hex("digest")).alias("row_id"), "batch", "n_all", "n_removed", F.lit(None).cast("string").alias("kept_sha256"))
    return rows.unionAll(lines)


ORACLE = r"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
named AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, CAST(doc_id AS VARCHAR) AS s FROM documents),
coded AS (
    SELECT r, doc_id, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(s) + 1), lambda i: CAST(ord(substr(s, i, 1)) AS BIGINT))),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc
    FROM named, bits
),
docs AS (SELECT r, doc_id, CAST(coalesce((crc % 64) // 8, 0) AS INTEGER) AS batch, string_split(text, chr(10)) AS lines FROM coded),
line AS (
    SELECT r, batch, i, lines[i] AS line, translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT r, batch, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)
),
per AS (SELECT k, batch, count(DISTINCT r) AS n FROM line WHERE length(k) >= 10 GROUP BY ALL),
before AS (SELECT k, batch, sum(n) OVER (PARTITION BY k ORDER BY batch) - n AS n, sum(n) OVER (PARTITION BY k) AS n_all FROM per),
judged AS (SELECT line.*, coalesce(before.n >= 5, FALSE) AS gone, n_all FROM line LEFT JOIN before USING (k, batch)),
kept AS (SELECT r, count(*) AS n_all, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY r)
SELECT 'doc' AS row_kind, CAST(doc_id AS VARCHAR) AS row_id, batch, CAST(n_all AS BIGINT) AS n_all, CAST(n_removed AS BIGINT) AS n_removed, kept_sha256 FROM docs JOIN kept USING (r)
UNION ALL
SELECT 'line', sha256(k), min(batch), CAST(max(n_all) AS BIGINT), CAST(count(*) AS BIGINT), NULL FROM judged WHERE gone GROUP BY k
"""
