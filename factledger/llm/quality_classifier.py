"""Quality classifier by positive-unlabelled learning.

A linear score over features of the whole text is fitted by the non-negative unbiased risk: trusted positives (label 1),
unlabelled web text, and a class prior estimated as the share of label 1 among the labels that may be learned
from. The risk of the unlabelled texts as negatives, less the prior's share of the positives', is kept from
going below zero, which is where such a fit begins to overfit: a step that would take it there is shortened, and the fit ends at that border. The
pull of weights to zero is `PULL` over the number of positives, so it fades as there are more.

Every text that may be learned from counts as unlabelled web text, and those of at most `POSITIVES` documents with label 1, chosen by hash, as trusted positives; mean and spread of the features, the risk and its
gradient are sums over all of them, added up by Spark in one pass over stored features each. Only the scale of a step, the matrix of second derivatives,
comes from a sample of `SCALE_ROWS` texts or so, chosen by hash; it decides how fast the fit arrives, not where. Up to that border
the risk is convex (the logistic losses of a text as a positive and as a negative differ by the score itself), so about ten passes do.
Every text is scored whole. Features come from the text only: shares of bytes, lengths, repeats of words and lines, stop words.

Defined results: a null or empty text has features of zero and a score like any other; repeated rows score alike;
without labels every score is 0.5; a null doc_id is never held out nor learned from; empty tables give an empty table;
columns other than doc_id and text are ignored in scoring, and `accepted` hands all of them through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from factledger.llm import packed
from factledger.llm.common import free_name, materialise, table
from factledger.llm.quality_rules import STOP_WORDS
from factledger.llm.windows import CHUNK, Rolling, word_units, _BYTES

FOLDS, HELD_OUT, CUT = 5, 0, 0.3
#: Labelled documents that are trusted positives (all, if there are fewer). Texts behind the scale of a step (about), passes over all texts, gradient at which they end, how far a step moves scores on average, and the pull of weights to zero, times the positives.
POSITIVES = 20_000
SCALE_ROWS, PASSES, ENOUGH, REACH, PULL = 4000, 14, 1e-4, 2.0, 80.0
DENSE = 12
WIDTH = 256 + DENSE


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def _word_hashes(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    offsets = np.r_[0, np.cumsum([len(d) for d in data])]
    return np.sort(Rolling(_BYTES[0][np.frombuffer(b"".join(data), np.uint8)], 0).of(offsets[:-1], offsets[1:]) + np.uint64(1))


_STOPS = _word_hashes(STOP_WORDS)


def distinct_by_row(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """How many different values each row has."""
    order = np.lexsort([value, row])
    r, v = row[order], value[order]
    fresh = np.r_[True, (r[1:] != r[:-1]) | (v[1:] != v[:-1])] if len(r) else np.zeros(0, bool)
    return np.bincount(r[fresh], minlength=rows)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of `WIDTH` numbers for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    out = np.zeros((n, WIDTH))
    some = np.maximum(size, 1)[:, None]
    out[:, :256] = np.sqrt(np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256) / some)
    units = word_units(data, offsets)
    count = np.diff(units.begins)
    words = np.maximum(count, 1)
    of = np.repeat(np.arange(n), count)
    code = units.codes[0]
    tally = lambda flags, at: np.bincount(at, weights=flags, minlength=n)
    again = np.r_[False, (code[1:] == code[:-1]) & (of[1:] == of[:-1])] if len(code) else np.zeros(0, bool)
    stop = _STOPS[np.minimum(np.searchsorted(_STOPS, code), len(_STOPS) - 1)] == code
    length = units.end - units.start
    ends = np.unique(np.r_[np.flatnonzero(data == 10), offsets[1:]]).astype(np.int64)
    begins = np.r_[0, ends[:-1] + (np.r_[data, 0][ends[:-1]] == 10)] if len(ends) else ends
    line = np.flatnonzero(ends > begins)
    begins, ends = begins[line], ends[line]
    line_of = np.searchsorted(offsets, begins, "right") - 1
    line_code = Rolling(_BYTES[0][data], 0).of(begins, ends)
    lines = np.maximum(np.bincount(line_of, minlength=n), 1)
    different = distinct_by_row(of, code, n)
    mean_length = tally(length, of) / words
    out[:, 256:] = np.stack(
        [
            np.log1p(count), (count < 20).astype(float), mean_length, np.abs(mean_length - 5), different / words, different / np.sqrt(words),
            tally(again, of) / words, tally(stop, of) / words, (tally(stop, of) * 50 < count).astype(float),
            distinct_by_row(line_of, line_code, n) / lines, np.log1p(lines), np.log1p(count / lines),
        ],
        axis=1,
    )
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def scaled(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.c_[np.clip((x - mean) / spread, -8, 8), np.ones(len(x))]


def risk_sums(x: np.ndarray, positive: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of scaled features: texts, positives, losses as negatives of both, and the gradients of these losses and of the positives' own, one behind the other."""
    g = sigmoid(x @ w)
    loss = np.logaddexp(0, x @ w)  # of a text as a negative
    of = positive.astype(float)
    return np.r_[len(x), of.sum(), loss.sum(), loss @ of, (loss - x @ w) @ of, x.T @ g, x.T @ (g * of), x.T @ ((g - 1) * of)]


def risk(sums: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The risk with its pull to zero, the part of it that unlabelled texts have as negatives, and the gradient."""
    n, p, as_negative, p_as_negative, p_loss = sums[:5]
    gu, gp, own = sums[5:].reshape(3, -1)
    negative = as_negative / n - prior * p_as_negative / p
    pull = PULL / p
    return prior * p_loss / p + negative + 0.5 * pull * float(w[:-1] @ w[:-1]), negative, gu / n - prior * gp / p + prior * own / p + pull * np.r_[w[:-1], 0]


def curvature(x: np.ndarray, w: np.ndarray, pull: float) -> np.ndarray:
    g = sigmoid(x @ w)
    return (x.T * (g * (1 - g))) @ x / max(1, len(x)) + np.diag(np.r_[np.full(len(w) - 1, pull), 1e-3])


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offsets = packed.texts(batch, "text")
    for a, b in packed.chunks(offsets, CHUNK):
        yield a, b, features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def summed(rows: DataFrame, sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """`sums(features, positive)` added up over all rows(positive, x); only the total goes to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = sums(_stored(batch.column("x")), batch.column("positive").to_numpy(zero_copy_only=False))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "value"])

    added = rows.mapInArrow(packed.frugal(work), "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    return np.array([r.value for r in sorted(added.collect(), key=lambda r: r.place)])


def _stored(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), WIDTH).astype(np.float64)


def training(docs: DataFrame, known: DataFrame) -> DataFrame:
    """positive and x (features) of every text that may be learned from."""
    some = known.filter("quality = 1").orderBy(F.xxhash64("doc_id", F.lit("trusted")), "doc_id").limit(POSITIVES)
    trusted = F.broadcast(some.select(F.col("doc_id").alias("known_id")))  # `POSITIVES` numbers at most
    usable = docs.select("doc_id", "text").filter(fold(F.col("doc_id")) != HELD_OUT)
    rows = usable.join(trusted, F.col("doc_id") == F.col("known_id"), "left").select(F.col("known_id").isNotNull().alias("positive"), F.xxhash64("doc_id", F.lit("sample")).alias("by_hash"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in _chunks(batch):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("positive"), part.column("by_hash"), pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary())], names=["positive", "by_hash", "x"])

    return rows.mapInArrow(packed.frugal(work), "positive boolean, by_hash long, x binary")


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model: mean and spread of the features, and weights (the last is the constant), from all texts and labels outside the held-out fold."""
    known = labels.filter((fold(F.col("doc_id")) != HELD_OUT) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    nothing = np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1)
    prior, n = known.agg(F.avg("quality"), F.sum("quality")).first()
    if not n:
        return nothing
    prior = min(0.99, max(0.01, float(prior)))
    rows = materialise(training(docs, known))
    moments = summed(rows, lambda x, positive: np.r_[len(x), positive.sum(), x.sum(axis=0), (x * x).sum(axis=0)])
    if not len(moments) or not moments[1]:
        return nothing
    mean, square = moments[2:].reshape(2, -1) / moments[0]
    spread = np.sqrt(np.maximum(0.0, square - mean * mean)) + 1e-3
    some = rows.filter(F.pmod("by_hash", F.lit(int(moments[0]))) < SCALE_ROWS).select("by_hash", "x").orderBy("by_hash").limit(2 * SCALE_ROWS)
    sample = scaled(_stored(pa.array([bytes(r.x) for r in some.collect()], pa.binary())), mean, spread)
    look = lambda w: risk(summed(rows, lambda x, positive: risk_sums(scaled(x, mean, spread), positive, w)), w, prior)
    w, reach = np.zeros(WIDTH + 1), REACH
    value, _, grad = look(w)
    for _ in range(PASSES):
        step = np.linalg.solve(curvature(sample, w, PULL / moments[1]), grad)
        there = w - step * min(1.0, reach / max(1e-12, float(np.abs(sample @ step).mean())))
        risk_there, negative, grad_there = look(there)
        if negative < 0 or risk_there > value:  # beyond here the fit would only learn that the positives are known
            reach /= 4
        else:
            w, value, grad = there, risk_there, grad_there
        if np.abs(grad).max() < ENOUGH or reach < REACH / 200:
            break
    return mean, spread, w


def score(docs: DataFrame, labels: DataFrame, keep: list[str], name: str = "score") -> DataFrame:
    """The columns of `keep` and, under `name`, the score of every row of docs."""
    mean, spread, w = learn(docs, labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in _chunks(batch):
                s = sigmoid(np.clip((x - mean) / spread, -8, 8) @ w[:-1] + w[-1])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), pa.array(s)], names=[*keep, name])

    schema = StructType([*(docs.schema[n] for n in keep), StructField(name, DoubleType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(packed.frugal(work), schema)


def accepted(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs that the classifier takes for good, all columns as they are, whatever their names."""
    name = free_name(docs, "score")
    return score(docs, labels, docs.columns, name).filter(F.col(name) >= cut).select(*docs.columns)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
