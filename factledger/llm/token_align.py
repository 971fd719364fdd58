"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Tokenizer A (byte-level BPE) reads a space and the text, B (pieces with byte fallback) the text, to which it adds the space itself. Where both give back the same bytes,
B's tokens are a static interval index, their sorted ends and starts; each A token asks it by bisection for all B tokens it overlaps (`align`). Byte offsets
that no token of either side spans are the borders of groups.

A text is cut before each space that follows a character that is surely not white space. Neither tokenizer merges across such a place (A's
words begin with the space; no piece of B has a space behind another character, which `Vocabulary` makes sure of), so tokens, links and groups of a text are those of
its segments, and each different segment is encoded and aligned once. Segments are remembered in a bounded cache, which
ends with the task.

How often an id pair is linked is counted in documents. Tasks cut their documents into chunks of about `CHUNK_BYTES`; a chunk counts its
documents for each of its different pairs, Spark adds these up and finds the highest of each A id, and every chunk is joined with the counts of its own pairs, by
pair. So a pair that all documents hold is one row a chunk, nothing grows with the square of anything, and the vocabulary bounds what an A id has.

Defined results: texts that are null or empty, or that either tokenizer doesn't give back byte for byte, have no tokens, and all their columns are zero or ''.
Repeated rows are documents of their own; a null doc_id stays null; an empty table gives an empty table; only doc_id and text are read,
so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factledger.llm import packed
from factledger.llm.common import materialise, partitions, table
from factledger.llm.packing import ranges, tokenizer_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a chunk; longest segment that is looked up again; tokens that the cache may hold.
CHUNK_BYTES, SHORT, CACHED = 4 << 20, 64, 8_000_000
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Both tokenizers, and the bytes of all their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        stands = byte_names()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(stands[c] for c in x) if all(c in stands for c in x) else x.encode() for x in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        if any("▁" in x.lstrip("▁") for x in pieces):
            raise ValueError("a piece spans a space behind another character: texts can't be cut before spaces")
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_flat, self.b_flat = b"".join(self.a_bytes), b"".join(self.b_bytes)
        names = [str(i).encode() for i in range(max(len(entries), len(pieces)))]
        self.name_size = np.array([len(x) for x in names], np.int64)
        self.name_begin, self.name_flat = np.cumsum(self.name_size) - self.name_size, np.frombuffer(b"".join(names), np.uint8)

    @property
    def base(self) -> int:
        """A pair of ids is the number a * base + b."""
        return len(self.b_bytes)


@lru_cache(1)
def vocabulary(a_path: str, b_path: str) -> Vocabulary:
    return Vocabulary(a_path, b_path)


def align(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token) of every overlap, and the offsets at which tokens of both sides end, from the ends of tokens that cover the same bytes without gaps."""
    a_start, b_start = np.r_[0, a_end[:-1]], np.r_[0, b_end[:-1]]
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = np.maximum(0, high - low) * (a_end > a_start)
    return np.repeat(np.arange(len(a_end)), n), ranges(low, n), np.intersect1d(a_end, b_end)


def segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments begin, texts included: before each space behind a character that is surely no white space (ASCII from 33 on, or of two bytes from U+00C0 on)."""
    before, one = np.r_[np.uint8(0), data[:-1]], np.r_[np.zeros(2, np.uint8), data[:-2]]
    solid = (before > 32) & (before < 127) | (before >= 0x80) & (before < 0xC0) & (one >= 0xC3) & (one <= 0xDF)
    cut = (data == 32) & solid
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def spelled(ids: np.ndarray, sizes: np.ndarray, tokens: bytes) -> np.ndarray:
    """The bytes of these tokens, one behind the other, from all tokens' bytes in a line."""
    begin = np.cumsum(sizes) - sizes
    return np.frombuffer(tokens, np.uint8)[ranges(begin[ids], sizes[ids])]


def says_all(data: np.ndarray, size: np.ndarray, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, tokens: bytes) -> np.ndarray:
    """Which segments (data, size) their tokens (ids, n) give back byte for byte."""
    of = np.repeat(np.arange(len(n)), n)
    good = np.bincount(of, sizes[ids], len(n)).astype(np.int64) == size
    at = np.repeat(good, size)
    wrong = spelled(ids[good[of]], sizes, tokens) != data[at]
    return good & (np.bincount(np.repeat(np.arange(len(n)), size)[at][wrong], minlength=len(n)) == 0)


class Aligner:
    """Segments by number: tokens, groups and linked pairs of each, in flat arrays."""

    def __init__(self, words: Vocabulary) -> None:
        self.words = words
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.n = self.held = 0
        self.parts: dict[str, list[np.ndarray]] = {k: [] for k in ("counts", "whole", "codes", "groups", "n_chars")}

    def flat(self, name: str) -> np.ndarray:
        """All segments' values, one behind the other."""
        self.parts[name] = [np.concatenate(self.parts[name])] if self.parts[name] else []
        return self.parts[name][0] if self.parts[name] else np.zeros((0, 4) if name == "counts" else 0, np.int64)

    def numbers(self, found: list[bytes]) -> np.ndarray:
        """The numbers of these different segments; new ones are encoded and aligned."""
        new = [x for x in found if x not in self.known]
        fresh = dict(zip(new, range(self.n, self.n + len(new)), strict=True))
        for i in range(0, len(new), 8192):
            self.add(new[i : i + 8192])
        out = np.fromiter((fresh[x] if x in fresh else self.known[x] for x in found), np.int64, len(found))
        self.known.update((x, k) for x, k in fresh.items() if len(x) <= SHORT)
        return out

    def add(self, new: list[bytes]) -> None:
        words = self.words
        text, space = [x.decode() for x in new], [words.b.piece_to_id("▁")]
        sides = [x.ids for x in words.a.encode_batch_fast(text, add_special_tokens=False)], [ids or space for ids in words.b.encode([x[1:] for x in text], num_threads=1)]  # to nothing at all B adds no space
        n = [np.fromiter(map(len, x), np.int64, len(new)) for x in sides]
        ids = [np.array(list(chain.from_iterable(x)), np.int64) for x in sides]
        data, size = np.frombuffer(b"".join(new), np.uint8), np.fromiter(map(len, new), np.int64, len(new))
        whole = np.logical_and(*(says_all(data, size, *x) for x in zip(ids, n, (words.a_size, words.b_size), (words.a_flat, words.b_flat), strict=True)))
        ids = [i[np.repeat(whole, k)] for i, k in zip(ids, n, strict=True)]
        n = [k * whole for k in n]
        end = [np.cumsum(sizes[i]) for i, sizes in zip(ids, (words.a_size, words.b_size), strict=True)]
        of_a, of_b, border = align(*end)
        ends = np.cumsum(size * whole)
        last_link, last_group = np.searchsorted(of_a, np.cumsum(n[0]), "left"), np.searchsorted(border, ends, "right")
        n_links, n_groups = np.diff(last_link, prepend=0), np.diff(last_group, prepend=0)
        # names of ids by group, A before B, each with the sign behind it
        group = np.concatenate([np.searchsorted(border, e, "left") * 2 + k for k, e in enumerate(end)])
        order = np.argsort(group, kind="stable")
        group, name = group[order], np.concatenate(ids)[order]
        same = np.r_[group[1:] == group[:-1], False]
        sign = np.where(same, ord(","), np.where(group % 2 == 0, ord("|"), ord(";"))).astype(np.uint8)
        begin, long = words.name_begin[name], words.name_size[name]
        close = np.cumsum(long + 1)
        line = np.zeros(int(close[-1]) if len(close) else 0, np.uint8)
        line[close - 1] = sign
        line[ranges(close - long - 1, long)] = words.name_flat[ranges(begin, long)]
        until = np.searchsorted(group, 2 * last_group, "left")  # tokens of the segments so far
        self.parts["n_chars"].append(np.diff(np.r_[0, close][until], prepend=0))
        self.parts["groups"].append(line)
        self.parts["codes"].append(ids[0][of_a] * words.base + ids[1][of_b])
        self.parts["whole"].append(whole)
        self.parts["counts"].append(np.stack([*n, n_groups, n_links], axis=1))
        self.n += len(new)
        self.held += int(n[0].sum() + n[1].sum()) + 8 * len(new)


class Chunk:
    """Documents whose pairs are counted together."""

    def __init__(self, aligner: Aligner) -> None:
        self.aligner, self.docs, self.sizes, self.numbers, self.bytes = aligner, [], [], [], 0

    def add(self, docs: list, data: np.ndarray, offsets: np.ndarray) -> None:
        """Texts; a null or empty one has no bytes here."""
        size = np.diff(offsets)
        full = size > 0
        spaced = np.full(len(data) + int(full.sum()), 32, np.uint8)
        begins = np.r_[0, np.cumsum(size + full)]
        spaced[ranges(begins[:-1] + full, size)] = data
        start = segments(spaced, begins)
        number = np.zeros(0, np.int64)
        if len(start):
            where = np.r_[start, len(spaced)].astype(np.int64)
            parts = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(where.tobytes()), pa.py_buffer(spaced.tobytes())]).dictionary_encode()
            number = self.aligner.numbers(parts.dictionary.to_pylist())[parts.indices.to_numpy()]
        self.docs += docs
        self.sizes.append(np.diff(np.searchsorted(start, begins)))
        self.numbers.append(number)
        self.bytes += len(spaced)

    def close(self) -> dict:
        """Columns of the chunk's row: documents as they are, pairs with the number of documents that hold each, and what is needed to add up counts later."""
        al, size, number = self.aligner, np.concatenate(self.sizes), np.concatenate(self.numbers)
        used, local = np.unique(number, return_inverse=True)
        counts, broken, n_chars = al.flat("counts")[used], ~al.flat("whole").astype(bool)[used], al.flat("n_chars")
        until, text = np.cumsum(n_chars), memoryview(al.flat("groups").astype(np.uint8))
        groups = [bytes(text[a:b]) for a, b in zip((until - n_chars)[used].tolist(), until[used].tolist(), strict=True)]
        of = np.repeat(np.arange(len(size)), size)
        spoilt = np.bincount(of[broken[local]], minlength=len(size)) > 0
        fine = (size > 0) & ~spoilt
        sums = [np.bincount(of, counts[local, i], len(size)).astype(np.int64) * fine for i in range(4)]
        digests, at = [], np.r_[0, np.cumsum(size)]
        for k in range(len(size)):
            line = b"".join([groups[i] for i in local[at[k] : at[k + 1]].tolist()]) if fine[k] else b""
            digests.append(hashlib.sha256(memoryview(line)[:-1]).hexdigest() if line else "")
        keep = fine[of]
        key, times = np.unique(of[keep] * len(used) + local[keep], return_counts=True)  # different segments of each document
        doc, segment = key // max(1, len(used)), key % max(1, len(used))
        n_codes, all_codes = counts[:, 3], al.flat("counts")[:, 3]
        pair, dense = np.unique(al.flat("codes")[ranges((np.cumsum(all_codes) - all_codes)[used], n_codes)], return_inverse=True)
        begin = np.cumsum(n_codes) - n_codes
        df, stamp = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
        cuts = np.searchsorted(doc, np.arange(len(size) + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mine = segment[a:b]
            ids = dense[ranges(begin[mine], n_codes[mine])]
            order = np.arange(len(ids))
            stamp[ids] = order
            df[ids[stamp[ids] == order]] += 1  # each of the document's pairs once
        held = df > 0
        docs = {"doc_id": pa.array(self.docs, pa.int64()), **dict(zip(COUNTS, sums, strict=True)), "groups_sha256": pa.array(digests, pa.string())}
        return {
            "pairs": pair[held].tobytes(), "n_docs": df[held].tobytes(),
            "docs": packed.pack(docs), "uses": packed.pack({"doc": doc.astype(np.int32), "segment": segment.astype(np.int32), "times": times.astype(np.int32)}),
            "segments": packed.pack({"n": n_codes.astype(np.int32)}), "links": packed.pack({"code": pair[dense]}),
        }


CHUNK = pa.schema([("chunk", pa.int64()), *((n, pa.binary()) for n in ("pairs", "n_docs", "docs", "uses", "segments", "links"))])


def cut(a_path: str, b_path: str) -> callable:
    """One row for each chunk of a task's documents."""

    def row(chunk: Chunk, number: int) -> pa.RecordBatch:
        cells = {"chunk": (TaskContext.get().partitionId() << 32) | number} | chunk.close()
        return pa.RecordBatch.from_arrays([pa.array([cells[f.name]], f.type) for f in CHUNK], schema=CHUNK)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(vocabulary(a_path, b_path)), 0
        chunk = Chunk(aligner)
        for batch in batches:
            data, offsets = packed.texts(batch, "text")
            ids = batch.column("doc_id").to_pylist()
            for i, j in packed.chunks(offsets, CHUNK_BYTES // 4):
                chunk.add(ids[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if chunk.bytes > CHUNK_BYTES:
                    yield row(chunk, number)
                    number += 1
                    if aligner.held > CACHED:
                        aligner.forget()
                    chunk = Chunk(aligner)
        if chunk.docs:
            yield row(chunk, number)

    return packed.frugal(work)


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, pairs, n in zip(batch.column("chunk").to_pylist(), (x.as_py() for x in batch.column("pairs")), (x.as_py() for x in batch.column("n_docs")), strict=True):
            pair = np.frombuffer(pairs, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), chunk)), pa.array(pair), pa.array(np.frombuffer(n, np.int64))], names=["chunk", "pair", "n"])


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with what their links' counts come to, from rows sorted by chunk: first its pairs' counts, then the chunk."""
    now, held = None, []
    for batch in batches:
        kinds, chunks = batch.column("kind").to_numpy(), batch.column("chunk").to_numpy()
        cuts = np.r_[0, np.flatnonzero((chunks[1:] != chunks[:-1]) | (kinds[1:] != kinds[:-1])) + 1, len(chunks)]
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if len(chunks) else ():
            if now != chunks[i]:
                now, held = chunks[i], []
            if kinds[i] == 0:
                held.append([packed.column(batch.slice(i, j - i), n) for n in ("pair", "n", "best")])
                continue
            for k in range(i, j):  # one row, as a chunk is one
                yield summed(held, {n: packed.unpack(batch.column(n)[k].as_py()) for n in ("docs", "uses", "segments", "links")})


def summed(held: list, cells: dict[str, pa.RecordBatch]) -> pa.RecordBatch:
    docs, code, n_codes = cells["docs"], packed.column(cells["links"], "code"), packed.column(cells["segments"], "n")
    doc, segment, times = (packed.column(cells["uses"], n) for n in ("doc", "segment", "times"))
    totals = [np.zeros(docs.num_rows, np.int64)] * 2
    if held:
        pair, n, best = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(pair)
        at = np.minimum(np.searchsorted(pair[order], code), len(pair) - 1)  # a pair that isn't there is of a text without tokens
        ends = np.r_[0, np.cumsum(n_codes)]
        totals = []
        for value in (best.astype(np.int64), n):
            sums = np.r_[0, np.cumsum(value[order][at])]
            of_segment = sums[ends[1:]] - sums[ends[:-1]]
            total = np.zeros(docs.num_rows, np.int64)
            np.add.at(total, doc, of_segment[segment] * times)
            totals.append(total)
    return pa.RecordBatch.from_arrays([*(docs.column(n) for n in ("doc_id", *COUNTS)), *map(pa.array, totals), docs.column("groups_sha256")], names=["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])


def aligned(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """Documents with the figures of their alignment, and the counts: pair ids a and b, n (documents that hold them linked), best (whether no pair of a has more)."""
    spark = docs.sparkSession
    base = vocabulary(a_path, b_path).base
    chunks = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut(a_path, b_path), "chunk long, pairs binary, n_docs binary, docs binary, uses binary, segments binary, links binary"))
    asked = chunks.select("chunk", "pairs", "n_docs").mapInArrow(packed.frugal(pair_rows), "chunk long, pair long, n long")
    counts = asked.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {base}"))
    counts = materialise(counts.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy("a"))).select("pair", "a", (F.col("pair") % base).alias("b"), "n", "best"))
    known = asked.select("chunk", "pair").join(counts.select("pair", "n", "best"), "pair")
    nothing = F.lit(None).cast("binary")
    names = ["docs", "uses", "segments", "links"]
    both = known.select("chunk", F.lit(0).alias("kind"), "pair", "n", "best", *(nothing.alias(n) for n in names))
    both = both.unionAll(chunks.select("chunk", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("pair"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("best"), *names))
    dealt = both.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "kind")
    figures = dealt.mapInArrow(packed.frugal(answered), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return figures, counts


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(A_FILE), tokenizer_path(B_FILE))[0]
