"""Best-fit packing of token sequences by linear grouping."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import tokenizer
from millrace.llm.common import batched, frugal, narrow_reads, saved

PIECES = "id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_pieces(docs: DataFrame, capacity: int, path: str, closing: int, id_column: str, text_column: str) -> DataFrame:
    """Encode whole texts and cut those over ``capacity``; a shorter piece comes first.

    ``part`` and ``nth`` number the pieces of one length within a task.
    """

    def encode(batches):
        enc, part, seen = tokenizer.encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = ([], [], [], [], [], [])
            for k, text in enumerate(batch.column(1)):
                ids = enc.ids(text.as_py() or "")
                ids.append(closing)
                array = np.array(ids, dtype="<u4")
                start = 0
                first = (len(ids) - 1) % capacity + 1
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    n = end - start
                    values = (k, piece, start, n, zlib.crc32(array[start:end].tobytes()), seen[n])
                    for column, v in zip(rows, values, strict=True):
                        column.append(v)
                    seen[n] += 1
                    start = end
            ids = batch.column(0).take(pa.array(rows[0], pa.int64()))
            longs = [pa.array(c, pa.int64()) for c in rows[2:]]
            part_column = pa.array([part] * len(rows[0]), pa.int32())
            arrays = [ids, pa.array(rows[1], pa.int32()), *longs[:3], part_column, longs[3]]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = docs.schema[id_column].dataType.simpleString()
    return batched(docs).select(F.col(id_column).alias("id"), text_column).mapInArrow(frugal(encode), PIECES.format(kind=kind))


class Run:
    """``count`` sequences numbered from ``first`` that hold the same lengths."""

    __slots__ = ("count", "first", "lengths", "room")

    def __init__(self, first: int, count: int, lengths: list[int], room: int):
        self.first, self.count, self.lengths, self.room = first, count, lengths, room


def grouped(histogram: dict[int, int], large: list[int], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Linear grouping: sizes, each the largest length of one of ``groups`` equal shares of the items, and their demands."""
    counts = np.array([histogram[n] for n in large], dtype=np.int64)
    width = max(1, -(-int(counts.sum()) // groups))
    before = np.cumsum(counts) - counts
    demand: dict[int, int] = {}
    for g in range(-(-int(counts.sum()) // width)):
        # the share's first item, in descending order, is its largest
        size = large[int(np.searchsorted(before, g * width, side="right")) - 1]
        demand[size] = demand.get(size, 0) + min(width, int(counts.sum()) - g * width)
    return np.array(list(demand), dtype=np.int64), np.array(list(demand.values()), dtype=np.int64)


def fullest(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size stands in the configuration of the greatest worth, by dynamic programming over the room."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for g in np.flatnonzero(worth > 0).tolist():
        size = int(sizes[g])
        for _ in range(capacity // size):
            offer = best[:-size] + worth[g]
            better = offer > best[size:] + 1e-12
            if not better.any():
                break
            best[size:][better], last[size:][better] = offer[better], g
    used, room = np.zeros(len(sizes), dtype=np.int64), int(best.argmax())
    while room > 0 and last[room] >= 0:
        used[last[room]] += 1
        room -= int(sizes[last[room]])
    return used


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 40) -> list[tuple[np.ndarray, int]]:
    """Configurations (how often each size) with the whole number of times that an optimal mixture has each.

    The linear program "fewest sequences that meet the demand" is solved by column generation: the
    basis has as many configurations as sizes, and the configuration worth most at the basis's
    prices enters until none is worth more than a sequence, or after ``rounds`` times as many steps
    as sizes.  What the fractions leave of the demand is not in the result.
    """
    n = len(sizes)
    if not n:
        return []
    each = capacity // sizes
    basis = [np.where(np.arange(n) == g, each, 0) for g in range(n)]
    cost, inverse, times = np.ones(n), np.diag(1 / each), demand / each
    for _ in range(rounds * n):
        price = cost @ inverse
        if price.min() < -1e-9:
            # more of this size than asked for is no harm, so its surplus is a column without cost
            enters, its_cost = -np.eye(n, dtype=np.int64)[price.argmin()], 0.0
        else:
            enters, its_cost = fullest(sizes, price, capacity), 1.0
            if price @ enters <= 1 + 1e-7:
                break
        step = inverse @ enters
        held = np.flatnonzero(step > 1e-9)
        if not len(held):
            break
        leaves = held[np.argmin(times[held] / step[held])]
        amount = times[leaves] / step[leaves]
        times = np.maximum(times - amount * step, 0)
        times[leaves] = amount
        row = inverse[leaves] / step[leaves]
        inverse = inverse - np.outer(step, row)
        inverse[leaves] = row
        basis[leaves], cost[leaves] = enters, its_cost
    return [(used, int(t + 1e-6)) for used, t, c in zip(basis, times, cost, strict=True) if c and t >= 1 - 1e-6]


class Stock:
    """How many items of each length are left."""

    def __init__(self, histogram: dict[int, int], lengths: list[int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for n in lengths:
            self.left[n] = histogram[n]

    def largest(self, most: int) -> int:
        """The largest length left up to ``most``, or 0."""
        found = np.flatnonzero(self.left[: most + 1])
        return int(found[-1]) if len(found) else 0


def substituted(stock: Stock, places: list[int], times: int, capacity: int, spare: int) -> Iterator[tuple[list[int], int]]:
    """Yield (lengths, count) of sequences that follow one configuration, up to ``times`` of them.

    Every place takes the largest actual length up to its size, but the last and any after it take
    the largest that still fits, so that what rounding left free is used.  Where more than ``spare``
    would still be free, the lengths are left to best fit.
    """
    while times:
        taken, room = [], capacity
        for size in [*places[:-1], *([capacity] * (capacity // places[-1] + 1))]:
            n = stock.largest(min(size, room))
            if not n:
                break
            stock.left[n] -= 1
            taken.append(n)
            room -= n
        if not taken:
            return
        uses = Counter(taken)
        for n, k in uses.items():
            stock.left[n] += k
        if room > spare:
            return
        count = min(times, *(int(stock.left[n]) // k for n, k in uses.items()))
        for n, k in uses.items():
            stock.left[n] -= k * count
        yield taken, count
        times -= count


def best_fit(runs: list[Run], stock: Stock, capacity: int) -> list[Run]:
    """Deal out what is left, longest first, each to the least room that holds it, opening sequences as needed."""
    first = sum(run.count for run in runs)
    rooms: list[list[Run]] = [[] for _ in range(capacity + 1)]
    for run in runs:
        rooms[run.room].append(run)
    some = np.array([bool(r) for r in rooms])
    for n in np.flatnonzero(stock.left)[::-1].tolist():
        left = int(stock.left[n])
        while left:
            fits = np.flatnonzero(some[n:])
            if not len(fits):
                # none holds it: as many of them as a sequence can take, and the rest in one
                for lengths, count in (([n] * (capacity // n), left // (capacity // n)), ([n] * (left % (capacity // n)), 1)):
                    if lengths and count:
                        run = Run(first, count, lengths, capacity - n * len(lengths))
                        rooms[run.room].append(run)
                        some[run.room] = True
                        first += count
                break
            room = n + int(fits[0])
            run = rooms[room].pop()
            some[room] = bool(rooms[room])
            count = min(left, run.count)
            if count < run.count:
                rooms[room].append(Run(run.first + count, run.count - count, list(run.lengths), room))
                some[room] = True
            rooms[room - n].append(Run(run.first, count, [*run.lengths, n], room - n))
            some[room - n] = True
            left -= count
    return [run for held in rooms for run in held]


def plan_packing(
    histogram: dict[int, int], capacity: int, groups: tuple[int, ...] = (32, 64, 128), small: float = 1 / 8, spares: tuple[int, ...] = (0, 2, 4, 8, 16)
) -> list[Run]:
    """Runs of equal sequences for a histogram of lengths.

    Linear grouping: the lengths over ``small * capacity``, in descending order, are dealt into
    groups of equal cardinality and rounded up to their group's largest; an optimal mixture of
    configurations of the few sizes left is found; its places take actual lengths; what is left,
    the small ones above all, goes by best fit, longest first, into the room that these leave.

    Numbers of groups and limits of the spare room of a configuration's sequence are tried in turn
    until the sequences are as few as the total volume needs; else the best try counts.  All of it
    works on counts by length, so its cost is bounded by the capacity, not by the number of documents.
    """
    lengths = sorted((n for n, k in histogram.items() if k), reverse=True)
    least = -(-sum(n * histogram[n] for n in lengths) // capacity)
    large = [n for n in lengths if n > capacity * small]
    used = lambda runs: sum(run.count for run in runs)
    best: list[Run] = []
    for number in groups:
        sizes, demand = grouped(histogram, large, number)
        # configurations of the largest sizes first, while there is the most to choose from
        mixture = sorted(configurations(sizes, demand, capacity), key=lambda m: tuple(-m[0]))
        for spare in spares:
            stock, runs, first = Stock(histogram, lengths, capacity), [], 0
            for counts, times in mixture:
                for taken, count in substituted(stock, np.repeat(sizes, counts).tolist(), times, capacity, spare):
                    runs.append(Run(first, count, taken, capacity - sum(taken)))
                    first += count
            runs = best_fit(runs, stock, capacity)
            if not best or used(runs) < used(best):
                best = runs
            if used(best) <= least:
                return best
    return best


def placements(runs: list[Run]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: the first rank, first sequence and offset of each stretch of ranks."""
    found = defaultdict(lambda: ([], [], []))
    taken: Counter = Counter()
    for run in runs:
        offset = 0
        for n in run.lengths:
            ranks, firsts, offsets = found[n]
            ranks.append(taken[n])
            firsts.append(run.first)
            offsets.append(offset)
            taken[n] += run.count
            offset += n
    return {n: tuple(np.array(c, dtype=np.int64) for c in columns) for n, columns in found.items()}


def pack(
    docs: DataFrame, capacity: int = 2048, path: str | None = None, closing: int = 0, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset), one for each piece.

    A null or empty text is its closing id alone.  Null ids stay null, equal rows are packed apart,
    an empty table gives no rows and other columns are ignored.  The driver sees a histogram of at
    most ``capacity`` lengths; ranks within a length come from counts by task, so no length, however
    common, is numbered by one task.
    """
    path = path or tokenizer.default_path()
    with narrow_reads(docs.sparkSession):
        # rows of few bytes, dealt out anew so that files are few
        pieces = saved(cut_pieces(docs, capacity, path, closing, id_column, text_column).hint("rebalance"), "pieces")
    counts = saved(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(placements(plan_packing(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases.hint("merge"), ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )

    def place(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            values, starts = np.unique(length[order], return_index=True)
            for n, rows in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
                ranks, firsts, offsets = plan.value[n]
                at = np.searchsorted(ranks, rank[rows], side="right") - 1
                sequence[rows] = firsts[at] + rank[rows] - ranks[at]
                offset[rows] = offsets[at]
            arrays = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(frugal(place), out).withColumnRenamed("id", id_column)
