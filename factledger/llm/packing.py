"""Best-fit packing of token pieces into sequences by bin completion.

Documents become token pieces of at most `capacity` ids. Only how many pieces there are of each length (at most
`capacity` numbers) goes to the driver, which plans there by branch and bound: around the longest piece left, the undominated
fillings are tried depth first, nearest to full first; a branch ends once its waste forbids fewer sequences than the
incumbent has, and best-fit decreasing is the first incumbent. A filling is repeated as often as the counts allow, and once
as the other branch, so that every plan can be reached. Where best-fit decreasing stays more than `GAP` above the lower bound, a second incumbent
comes from column generation over the lengths: fillings in fractions of sequences, whose whole parts are taken, and bin completion
of what rounding leaves, which is as small for any counts. Its prices give a lower bound, too. The search ends at a lower bound on the sequences or after `STEPS`
steps; a plan is whole and valid then, only not proven to be the smallest. The plan is a list of patterns, bounded by
`capacity` as well; pieces of one length are numbered across the cluster and look up their place in it.

Numbering cuts the pieces of one length into parts of bounded size (about the square root of their count), so a length
that a third of all pieces share is no single task.

Defined results: a null or empty text is the one token 0; repeated rows and copies are pieces of their own; an empty table
gives an empty table; a null doc_id stays null; only doc_id and text are read, so other columns may have any name.
The tokenizer is a file named by a parameter. Its ids of a text are put together from those of its parts between single
spaces and line feeds, which it can't merge. Texts are taken some megabytes at a time: Arrow splits them and numbers their
different parts, each of which is encoded once; ids are gathered by number. Ids of words are remembered in a bounded
cache, which ends with the task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factledger.llm import packed
from factledger.llm.common import materialise, table

CAPACITY, END = 2048, 0
TOKENIZER = "word_bpe_49k.json"
#: Bytes of text that are split at once, and ids that the cache of words may hold.
TEXT_BYTES, CACHED_IDS = 2 << 20, 1_000_000
#: Parts whose ids come from a lower-case word and the marks behind it.
_SIMPLE = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[.,;:!?*$%&#]*)$"
#: Steps of the plan's search: pieces tried for a filling, and so many more for each sequence that fillings are looked for.
STEPS, NODE_STEPS = 500_000, 100
#: Numbers that column generation touches at most, and how often what its rounding leaves is solved again.
WORK, ROUNDINGS = 3e9, 8
#: Fillings that one pricing offers, and the share of sequences above the bound from which on columns are generated.
FILLINGS, GAP = 24, 0.001
#: Places of bin completion that keep their search open, and rows of a matrix that change at once.
HELD, ROWS = 16, 64


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + size), one range behind the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


@lru_cache(1)
def tokenizer(path: str) -> tuple:
    """The tokenizer, and which of its tokens end a word; a worker loads it once."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return model, np.array([(model.id_to_token(i) or "").endswith("</w>") for i in range(model.get_vocab_size())])


class Encoder:
    """Unsigned 32-bit ids of texts."""

    def __init__(self, path: str) -> None:
        self.model, self.ends = tokenizer(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.n = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.n + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        k = len(self.known)
        while k + len(words) > len(self.start):
            self.start, self.size = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.size, np.zeros_like(self.size)]
        self.ids[self.n : self.n + len(ids)] = ids
        self.size[k : k + len(words)] = sizes
        self.start[k : k + len(words)] = self.n + np.cumsum(sizes) - sizes
        self.n += len(ids)
        self.known.update(zip(words, range(k, k + len(words)), strict=True))

    def numbers(self, words: list[str], plain: bool) -> np.ndarray:
        """The cache's numbers of these different words; plain ones are encoded many in a line, as a token says where a word ends."""
        new = [w for w in words if w not in self.known]
        for i in range(0, len(new), 256):
            some = new[i : i + 256]
            if plain:
                ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(some) and cuts[-1] == len(ids):
                    self.add(some, ids, np.diff(np.r_[0, cuts]))
                    continue
            each = [x.ids for x in self.model.encode_batch_fast(some, add_special_tokens=False)]
            self.add(some, np.array([v for x in each for v in x], np.uint32), np.array([len(x) for x in each], np.int64))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these texts, one text behind the other, and where each text's ids begin (one more at the end)."""
        if self.n > CACHED_IDS:
            self.forget()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        part = split.flatten().dictionary_encode()
        different = part.dictionary
        found = pc.extract_regex(different, _SIMPLE)
        simple = pc.is_valid(found)
        cores = pc.utf8_lower(found.field("core").filter(simple)).dictionary_encode()
        marks = found.field("mark").filter(simple).dictionary_encode()
        is_simple = simple.to_numpy(zero_copy_only=False)
        first, second = np.zeros(len(different), np.int64), np.zeros(len(different), np.int64)
        first[is_simple] = self.numbers(cores.dictionary.to_pylist(), True)[cores.indices.to_numpy()]
        second[is_simple] = self.numbers(marks.dictionary.to_pylist(), False)[marks.indices.to_numpy()]
        first[~is_simple] = self.numbers(different.filter(pc.invert(simple)).to_pylist(), False)
        second[~is_simple] = self.numbers([""], False)[0]
        size = np.stack([self.size[first], self.size[second]], axis=1)
        of_part = self.ids[ranges(np.stack([self.start[first], self.start[second]], axis=1).ravel(), size.ravel())]
        size = size.sum(axis=1)
        use = part.indices.to_numpy()
        ids = of_part[ranges((np.cumsum(size) - size)[use], size[use])]
        ends = np.r_[0, np.cumsum(size[use])]
        return ids, ends[split.offsets.to_numpy() - split.offsets[0].as_py()]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of docs(doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Encoder(path)
        for batch in batches:
            offsets = packed.texts(batch, "text")[1]
            for a, b in packed.chunks(offsets, TEXT_BYTES):
                ids, begins = model.encode(pc.fill_null(batch.column("text").slice(a, b - a).cast(pa.string()), ""))
                ids = np.insert(ids, begins[1:], np.uint32(END)).astype("<u4")
                begins = begins + np.arange(len(begins))
                count = -(-np.diff(begins) // capacity)
                row = np.repeat(np.arange(b - a), count)
                piece = ranges(np.zeros(b - a, np.int64), count)
                start = piece * capacity
                at = begins[row] + start
                length = np.minimum(capacity, begins[row + 1] - at)
                view = memoryview(ids).cast("B")
                own = [view[4 * x : 4 * y] for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)]
                cols = [batch.column("doc_id").slice(a, b - a).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(map(zlib.crc32, own), pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([bytes(x) for x in own], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(packed.frugal(work), schema)


class Pattern(NamedTuple):
    """A filling (lengths, longest first) and how many sequences have it."""

    lengths: tuple[int, ...]
    times: int


def smear(bits: int, by: int) -> int:
    """Every set bit also set at the next `by` places."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits |= bits << step
        done += step
    return bits


def undominated(rest: tuple[int, ...], room: int, left: int) -> bool:
    """Whether no piece of `left` (a bit for each length that is still there) could stand for some of the filling's and waste no more."""
    slack = room - sum(rest)
    none_or_two, ones = 1, 0  # sums of no piece, or of two and more; sums of one
    for v in rest:
        none_or_two |= ((none_or_two & ~1) << v) | (ones << v)
        ones |= 1 << v
    better = smear(none_or_two, slack) | (smear(ones << 1, slack - 1) if slack else 0)
    return not better & left & ~1


def fillings(count: np.ndarray, room: int, waste: int, steps: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of the room from the lengths left that waste at most so much, nearest to full first, larger pieces first.

    It ends once no steps are left; `steps` holds their number.
    """
    steps[0] -= NODE_STEPS
    if count[room]:
        yield (room,) if room else ()  # dominates all others
        return
    have = np.flatnonzero(count[: room + 1])
    have = have[have > 0].tolist()
    number = [int(min(count[v], room // v)) for v in have]
    every = (1 << (room + 1)) - 1
    reach = [1]  # sums that the first i lengths make
    for v, n in zip(have, number, strict=True):
        sums, k = reach[-1], 1
        while n > 0 and sums != every:
            k = min(k, n)
            sums |= (sums << (v * k)) & every
            n, k = n - k, k * 2
        reach.append(sums)
    bits = sum(1 << v for v in have)
    for target in range(room, max(-1, room - waste - 1), -1):
        if not reach[-1] >> target & 1:
            continue
        todo = [(len(have), target, ())]
        while todo and steps[0] > 0:
            steps[0] -= 1
            i, t, taken = todo.pop()
            if not t:
                used = {v: taken.count(v) for v in set(taken)}
                gone = sum(1 << v for v, n in used.items() if count[v] <= n)
                if undominated(taken, room, bits & ~gone):
                    yield taken
                continue
            while i and have[i - 1] > t:
                i -= 1
            if not i or not reach[i] >> t & 1:
                continue
            v = have[i - 1]
            # Fewer of this length wait below; most of it goes first.
            todo += [(i - 1, t - k * v, taken + (v,) * k) for k in range(min(number[i - 1], t // v) + 1) if reach[i - 1] >> (t - k * v) & 1]


def best_fit(count: np.ndarray, capacity: int) -> tuple[list[Pattern], int]:
    """Best-fit decreasing over lengths with counts: the incumbent to begin with."""
    open_bins: dict[int, list[list]] = {}  # room left -> [lengths, how many]
    for length in range(capacity, 0, -1):
        left = int(count[length])
        while left:
            room = next((r for r in range(length, capacity) if open_bins.get(r)), None)
            if room is None:
                per = capacity // length
                times, odd = divmod(left, per)
                for n, k in ((per, times), (odd, 1)):
                    if n and k:
                        open_bins.setdefault(capacity - n * length, []).append([(length,) * n, k])
                break
            lengths, times = open_bins[room].pop()
            n = min(room // length, left)
            k = min(times, left // n)
            if k < times:
                open_bins[room].append([lengths, times - k])
            open_bins.setdefault(room - n * length, []).append([lengths + (length,) * n, k])
            left -= n * k
    plan = [Pattern(lengths, k) for held in open_bins.values() for lengths, k in held]
    return plan, sum(p.times for p in plan)


def least(count: np.ndarray, capacity: int) -> int:
    """A lower bound on the sequences: by all lengths, and by those of some size and more, which can't share with what is too long."""
    sizes = np.arange(capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * sizes)
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    over = int(n[-1] - n[half])
    for small in range(1, half + 1):
        big = int(n[-1] - n[capacity - small])  # longer than the rest of a sequence beside `small`
        free = (over - big) * capacity - int(total[capacity - small] - total[half])
        held = int(total[half] - total[small - 1])
        best = max(best, over + max(0, -(-(held - free) // capacity)))
    return best


def fullest(price: np.ndarray, lengths: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Fillings worth more than 1, where each length has a price and may be taken any number of times: how many of each; the one that is worth most first."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    use = np.flatnonzero(price > 0)
    for i, v, p in zip(use.tolist(), lengths[use].tolist(), price[use].tolist(), strict=True):
        for _ in range(capacity // v):
            more = worth[:-v] + p
            better = more > worth[v:] + 1e-12
            if not better.any():
                break
            worth[v:][better] = more[better]
            last[v:][better] = i
    around = price + worth[capacity - lengths]  # the best filling that has this length
    found = []
    for first in np.argsort(-around, kind="stable")[:FILLINGS]:
        if around[first] <= 1 + 1e-9:
            break
        taken, at = np.zeros(len(lengths)), int(capacity - lengths[first])
        taken[first] = 1
        while at > 0:
            if last[at] < 0 or worth[at] <= worth[at - 1]:
                at -= 1
                continue
            taken[last[at]] += 1
            at -= int(lengths[last[at]])
        found.append(taken)
    return found


def columns(count: np.ndarray, capacity: int, work: list[float]) -> tuple[list[tuple[np.ndarray, np.ndarray, float]], np.ndarray, int]:
    """Fillings (which lengths, how many of each) with the fractions of sequences that use up the counts in the fewest of them (column generation), the lengths, and a lower bound.

    `work` holds how many numbers may still be touched; the fractions are right, but perhaps not the fewest, if that ends it. One matrix is held, which changes in place.
    """
    lengths = np.flatnonzero(count)
    need = count[lengths].astype(float)
    most = capacity // lengths
    own = [(np.array([i]), most[i : i + 1]) for i in range(len(lengths))]
    inverse, x = np.diag(1 / most), need / most
    m, bound = len(lengths), 0.0
    cost = float((capacity // lengths).sum()) * capacity
    while work[0] > 0:
        work[0] -= cost
        price = inverse.sum(axis=0)
        found = fullest(price, lengths, capacity)
        bound = max(bound, float(need @ price) / max([1.0, *(float(price @ f) for f in found[:1])]))
        if not found or math.ceil(bound - 1e-6) >= math.ceil(x.sum() - 1e-6):
            break
        for new in found:
            if inverse.sum(axis=0) @ new <= 1 + 1e-9:
                continue
            work[0] -= m * m
            step = inverse @ new
            can = np.flatnonzero(step > 1e-9)
            out = can[np.argmin(x[can] / step[can])]
            by = x[out] / step[out]
            x = np.maximum(x - by * step, 0)
            x[out] = by
            used = np.flatnonzero(new)
            own[out] = used, new[used].astype(np.int64)
            row = inverse[out] / step[out]
            for a in range(0, m, ROWS):
                inverse[a : a + ROWS] -= np.outer(step[a : a + ROWS], row)
            inverse[out] = row
    return [(*own[i], float(x[i])) for i in np.flatnonzero(x > 1e-9).tolist()], lengths, math.ceil(bound - 1e-6)


def seeded(count: np.ndarray, capacity: int, work: float = WORK) -> tuple[list[Pattern], np.ndarray, int]:
    """A plan from rounded fractions, with the pieces that it leaves (few, whatever the counts), and a lower bound on the sequences."""
    left, done, goal, budget = count.copy(), [], 0, [work]
    for turn in range(ROUNDINGS):
        if not left.any():
            break
        found, lengths, bound = columns(left, capacity, budget)
        goal = bound if not turn else goal
        before = len(done)
        for up in (False, True):
            for used, own, x in sorted(found, key=lambda f: f[2] % 1, reverse=True):
                most = int((left[lengths[used]] // own).min())
                times = min(most, int(x + 1e-9) if not up else int(x % 1 > 0.7 or len(done) == before))
                if times:
                    left[lengths[used]] -= times * own
                    done.append(Pattern(tuple(np.repeat(lengths[used], own)[::-1].tolist()), times))
        if len(done) == before or budget[0] <= 0:
            break
    return done, left, goal


def plan(count: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> list[Pattern]:
    """Patterns that use up the counts (by length, 0 to capacity) in as few sequences as the search finds."""
    count = np.array(count, np.int64)
    count[0] = 0
    best, bins = best_fit(count, capacity)
    goal = least(count, capacity)
    if bins - goal > GAP * goal:
        some, rest, bound = seeded(count, capacity)
        goal = max(goal, bound)
        other = some + complete(rest, capacity, *best_fit(rest, capacity), least(rest, capacity), steps)
        if sum(p.times for p in other) < bins:
            best, bins = other, sum(p.times for p in other)
    return complete(count, capacity, best, bins, goal, steps)


class Place:
    """A place of the search: the waste so far, what the next filling may waste, how many were tried and which is taken; `found` yields them and is None before the first and far from the end of the path."""

    def __init__(self, waste: int, spare: int) -> None:
        self.waste, self.spare, self.tried, self.taken, self.found = waste, spare, 0, None, None


def complete(count: np.ndarray, capacity: int, best: list[Pattern], bins: int, goal: int, steps: int) -> list[Pattern]:
    """Bin completion: a plan of fewer sequences than the incumbent `best` has, or that.

    Only the last `HELD` places of the path keep the sums that fillings are looked for by; an earlier one makes them anew if the search comes back to it, at no cost in steps.
    """
    count = count.copy()
    total = int((count * np.arange(capacity + 1)).sum())
    left = [steps]

    def options(own: np.ndarray, spare: int) -> Iterator[Pattern]:
        """Fillings around the longest piece that waste at most so much."""
        longest = int(np.flatnonzero(own)[-1])
        room = capacity - longest
        own[longest] -= 1
        for rest in fillings(own, room, min(room, spare), left):
            need = np.bincount((longest, *rest), minlength=capacity + 1)
            used = np.flatnonzero(need)
            most = int(((own[used] + (used == longest)) // need[used]).min())
            yield Pattern((longest, *rest), most)
            if most > 1:
                yield Pattern((longest, *rest), 1)

    def opened(place: Place) -> Iterator[Pattern]:
        """The fillings that were not tried yet."""
        found, spent = options(count.copy(), place.spare), left[0]
        left[0] = 1 << 62
        for _ in range(place.tried):
            next(found)
        left[0] = spent
        return found

    path = [Place(0, (bins - 1) * capacity - total)] if bins > goal else []
    while path and left[0] > 0 and bins > goal:
        here = path[-1]
        if here.taken:
            for v in here.taken.lengths:
                count[v] += here.taken.times
            here.taken = None
        here.found = here.found or opened(here)
        p = next(here.found, None)
        if p is None:
            path.pop()
            continue
        here.tried += 1
        now = here.waste + p.times * (capacity - sum(p.lengths))
        if now > (bins - 1) * capacity - total:
            continue
        for v in p.lengths:
            count[v] -= p.times
        here.taken = p
        if count.any():
            path.append(Place(now, (bins - 1) * capacity - total - now))
            if len(path) > HELD:
                path[-1 - HELD].found = None
        else:
            best = [x.taken for x in path]
            bins = sum(x.times for x in best)
    return best


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length, in order: from which number on pieces go to which sequences, how many to each, at which offset."""
    rows, used, sequence = [], {}, 0
    for p in patterns:
        offset = 0
        for length in sorted(set(p.lengths), reverse=True):
            per = p.lengths.count(length)
            rows.append((length, used.get(length, 0), per, sequence, offset))
            used[length] = used.get(length, 0) + per * p.times
            offset += per * length
        sequence += p.times
    rows.sort()
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(("length", "base", "per", "sequence", "offset"))}


def number(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """rows with `number`: 0, 1, ... among the rows of each length."""
    spark = rows.sparkSession
    parts = spark.createDataFrame([(length, max(1, n // max(500, 4 * math.isqrt(n)))) for length, n in histogram.items()], "length long, parts long")
    dealt = rows.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    own = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    return dealt.withColumn("own", own).join(before, ["length", "part"]).withColumn("number", (F.col("before") + F.col("own")).cast("long")).drop("part", "own", "before")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of docs(doc_id, text), each with its sequence_id and its offset there."""
    cut = materialise(pieces(docs, path, capacity, with_ids))
    histogram = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    count = np.zeros(capacity + 1, np.int64)
    count[list(histogram)] = list(histogram.values())
    where = slots(plan(count, capacity))
    names = list(cut.columns)
    key = where["base"] + (where["length"] << 44)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "number"))
            i = np.searchsorted(key, at + (length << 44), "right") - 1
            nth, which = divmod(at - where["base"][i], where["per"][i])
            sequence, offset = where["sequence"][i] + nth, where["offset"][i] + which * length
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    assert len(key) <= 64 * (capacity + 1), "the plan is bounded by the capacity"
    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return number(cut, histogram).mapInArrow(packed.frugal(work), schema)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
