"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.common import RangeHash, batched, dropped, frugal, joined_words, laid_out, saved, slices
from millrace.llm.toxicity import BREAK, LOWER

LETTERS, WORDS = RangeHash(30), RangeHash(31)
BLOCK_BITS = 16
BLOCKS = 64 // BLOCK_BITS
#: Low bits of a shingle's hash that a table of flags is asked about before the sorted hashes are.
PROBE = (1 << 20) - 1


class Words:
    """The words of texts laid end to end: hashes, each text's bounds, and the words joined by single spaces."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        lowered = LOWER[data]
        starts, ends, (self.hashes,) = common.word_hashes(LETTERS, lowered, bounds, BREAK)
        self.bounds = np.searchsorted(starts, bounds)
        self.line, self.begin = joined_words(lowered, starts, ends, BREAK)
        self.length = (ends - starts).astype(np.int32)

    def shingle(self, at: int, width: int) -> bytes:
        last = at + width - 1
        return self.line[int(self.begin[at]) : int(self.begin[last]) + int(self.length[last])]


def bit_counts(shingles: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in the hashes before each place."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros((len(shingles) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=counts[1:])
    return counts


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of the ``size`` shingles from each start: a bit is 1 if set in over half of them."""
    counts = bit_counts(shingles)
    return np.packbits(2 * (counts[starts + size] - counts[starts]) > size, axis=1, bitorder="little").view("<u8").ravel()


def radii(radius: int) -> list[int]:
    """For each block the distance within which it is looked up: fingerprints beyond all of them differ by more than ``radius``."""
    each, more = divmod(radius + 1 - BLOCKS, BLOCKS)
    return [each + (b < more) for b in range(BLOCKS)]


@cache
def masks(distance: int) -> np.ndarray:
    """All block values with at most so many bits."""
    chosen = [sum(1 << b for b in c) for n in range(distance + 1) for c in combinations(range(BLOCK_BITS), n)]
    return np.array(chosen, dtype=np.uint16)


class BlockIndex:
    """Fingerprints by the values of their blocks of 16 bits.

    A fingerprint within the radius of another is within the block's own radius in one block at
    least, so looking up the near values of every block loses none.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.near = prints, radius, radii(radius)
        blocks = prints.astype("<u8").view("<u2").reshape(-1, BLOCKS)
        self.order = [np.argsort(blocks[:, b], kind="stable").astype(np.int32) for b in range(BLOCKS)]
        self.values, self.first = [], []
        for b, order in enumerate(self.order):
            values, first = np.unique(blocks[order, b], return_index=True)
            self.values.append(values)
            self.first.append(np.append(first, len(order)).astype(np.int32))

    def nbytes(self) -> int:
        return self.prints.nbytes + sum(a.nbytes for held in (self.order, self.values, self.first) for a in held)

    def looked_up(self, block: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asked, print) numbers that are near in one block: from lists of its values, whichever way is shorter."""
        values, first = self.values[block], self.first[block]
        near = masks(self.near[block])
        if len(near) < len(values):
            wanted = (asked[:, None] ^ near[None, :]).ravel()
            at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
            met = np.flatnonzero(values[at] == wanted)
            a, v = met // len(near), at[met]
        else:
            a, v = np.nonzero(np.bitwise_count(asked[:, None] ^ values[None, :]) <= self.near[block])
        n = first[v + 1] - first[v]
        place = np.repeat(first[v] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(a, n), self.order[block][place].astype(np.int64)

    def candidates(self, asked: np.ndarray, part: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(asked, print) numbers within the radius."""
        out = [np.zeros((2, 0), dtype=np.int64)]
        for k in range(0, len(asked), part):
            some = asked[k : k + part]
            blocks = some.astype("<u8").view("<u2").reshape(-1, BLOCKS)
            met = [a * len(self.prints) + p for a, p in (self.looked_up(b, blocks[:, b]) for b in range(BLOCKS))]
            a, p = np.divmod(np.unique(np.concatenate(met)), len(self.prints))
            close = np.bitwise_count(some[a] ^ self.prints[p]) <= self.radius
            out.append(np.stack([a[close] + k, p[close]]))
        return tuple(np.concatenate(out, axis=1))


class Benchmark:
    """Items by length: their shingles, each exactly one, and a multi-index of their fingerprints.

    Everything is held in arrays of a few numbers a word, so that the index is a small multiple of
    the items' text.
    """

    def __init__(self, texts: list[str], size: int = 5, threshold: float = 0.8, radius: int = 16):
        self.size, self.threshold = size, threshold
        self.words = words = Words(*laid_out(pa.array(texts, pa.string())))
        lengths = np.diff(words.bounds)
        width = np.minimum(size, lengths)
        prefix = WORDS.prefix(words.hashes)
        # every shingle: its first word, its item and its hash, in the items' order
        n = np.where(lengths > 0, lengths - width + 1, 0)
        self.first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        item = np.repeat(np.arange(len(texts), dtype=np.int32), n)
        at = (np.arange(self.first[-1]) - self.first[item] + words.bounds[item]).astype(np.int32)
        hashes = WORDS.between(prefix, at, at + width[item])
        self.kind, self.known, self.sample = self.told_apart(hashes, at, width[item])
        self.known_width = width[item][self.sample[1]].astype(np.int8)
        self.sample = self.sample[0]
        # for each shingle the lengths of items that have it
        pairs = np.unique(self.kind.astype(np.int64) * (int(lengths.max(initial=0)) + 1) + lengths[item])
        self.has_length = (pairs % (int(lengths.max(initial=0)) + 1)).astype(np.int32)
        self.has_first = np.searchsorted(pairs, np.arange(len(self.known) + 1) * (int(lengths.max(initial=0)) + 1)).astype(np.int32)
        self.items: dict[int, np.ndarray] = {int(k): np.flatnonzero(lengths == k).astype(np.int32) for k in np.unique(lengths[lengths > 0])}
        self.index: dict[int, BlockIndex] = {}
        for k, held in self.items.items():
            m = int(n[held[0]])
            prints = [np.zeros(0, dtype=np.uint64)]
            for a in range(0, len(held), max(1, (1 << 16) // m)):
                some = held[a : a + max(1, (1 << 16) // m)]
                rows = hashes[self.first[some][:, None] + np.arange(m)]
                prints.append(fingerprints(rows.ravel(), np.arange(len(some)) * m, m))
            self.index[k] = BlockIndex(np.concatenate(prints), radius)
        # what only the building needs goes, and a block of items is shorter than 2 GB
        words.hashes, words.begin = words.hashes[:0], words.begin.astype(np.int32)
        self.probe = np.zeros(PROBE + 1, dtype=bool)
        self.probe[(self.known & np.uint64(PROBE)).astype(np.int64)] = True

    def told_apart(self, hashes: np.ndarray, at: np.ndarray, width: np.ndarray):
        """Numbers of equal shingles, and for each number its hash and where it stands.

        Numbers are in the order of hashes; shingles of one hash are compared by their bytes.
        """
        order = np.argsort(hashes, kind="stable")
        kind, known, sample = np.zeros(len(order), dtype=np.int32), [], []
        a = 0
        sorted_hashes = hashes[order]
        ends = np.append(np.flatnonzero(np.diff(sorted_hashes)) + 1, len(order)).tolist() if len(order) else []
        for b in ends:
            if b == a + 1:
                kind[order[a]] = len(known)
                known.append(sorted_hashes[a])
                sample.append(order[a])
            else:
                seen: dict[bytes, int] = {}
                for k in order[a:b].tolist():
                    s = self.words.shingle(int(at[k]), int(width[k]))
                    if s not in seen:
                        seen[s] = len(known)
                        known.append(sorted_hashes[a])
                        sample.append(k)
                    kind[k] = seen[s]
            a = b
        sample = np.array(sample, dtype=np.int64)
        return kind, np.array(known, dtype=np.uint64), (at[sample] if len(sample) else sample.astype(np.int32), sample)

    def nbytes(self) -> int:
        """What the index holds, the items' text included, but for the table of flags, which has a fixed size."""
        w = self.words
        arrays = (w.bounds, w.begin, w.length, self.first, self.kind, self.known, self.sample, self.known_width, self.has_length, self.has_first, *self.items.values())
        return len(w.line) + sum(a.nbytes for a in arrays) + sum(i.nbytes() for i in self.index.values())

    def numbers(self, words: Words, at: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
        """The items' numbers of the shingles at ``at``, compared by their bytes; -1 for others."""
        low, high = np.searchsorted(self.known, hashes), np.searchsorted(self.known, hashes, side="right")
        out = np.full(len(at), -1, dtype=np.int64)
        for k in np.flatnonzero(low < high).tolist():
            mine = words.shingle(int(at[k]), width)
            for number in range(int(low[k]), int(high[k])):
                if self.known_width[number] == width and self.words.shingle(int(self.sample[number]), width) == mine:
                    out[k] = number
        return out

    def matches(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words) of each text's best window for each item found."""
        words = Words(data, bounds)
        prefix = WORDS.prefix(words.hashes)
        for width in sorted({min(self.size, n) for n in self.items}):
            lengths = {n for n in self.items if min(self.size, n) == width}
            shingles = WORDS.windows(prefix, width)
            hit = np.flatnonzero(self.probe[(shingles & np.uint64(PROBE)).astype(np.int64)])
            text = np.searchsorted(words.bounds, hit, side="right") - 1
            inside = hit + width <= words.bounds[text + 1]
            hit, text = hit[inside], text[inside]
            number = self.numbers(words, hit, shingles[hit], width)
            hit, text, number = (x[number >= 0] for x in (hit, text, number))
            for a, b in pairwise([*np.flatnonzero(np.diff(text, prepend=-1)).tolist(), len(hit)]):
                if a < b:
                    t = int(text[a])
                    begin = int(words.bounds[t])
                    own = shingles[begin : max(begin, int(words.bounds[t + 1]) - width + 1)]
                    for item, s, start, n in self.in_text(own, hit[a:b] - begin, number[a:b], width, lengths):
                        yield t, item, s, start, n

    def in_text(self, own: np.ndarray, hit: np.ndarray, number: np.ndarray, width: int, lengths: set[int]):
        """A window shares a shingle with what it is similar to, so only windows over hits are printed."""
        over: dict[int, list[int]] = {}
        for h, k in zip(hit.tolist(), number.tolist(), strict=True):
            for n in self.has_length[self.has_first[k] : self.has_first[k + 1]].tolist():
                if n in lengths:
                    over.setdefault(n, []).append(h)
        best: dict[int, tuple[float, int, int]] = {}
        for n, hits in over.items():
            m = n - width + 1
            # window starts that have a hit among their shingles, each once
            h = np.unique(np.array(hits))
            least, most = np.maximum(h - m + 1, 0), np.minimum(h, len(own) - m)
            least = np.maximum(least, np.concatenate([[0], most[:-1] + 1]))
            each = np.maximum(most - least + 1, 0)
            starts = np.repeat(least - (np.cumsum(each) - each), each) + np.arange(each.sum())
            for k in range(0, len(starts), 4096):
                for run in np.split(some := starts[k : k + 4096], np.flatnonzero(np.diff(some) > 1) + 1):
                    a, b = int(run[0]), int(run[-1]) + m
                    w, found = self.index[n].candidates(fingerprints(own[a:b], run - a, m))
                    for s, p in zip(run[w].tolist(), found.tolist(), strict=True):
                        item = int(self.items[n][p])
                        if item in best and best[item][0] == 1.0:
                            continue  # the first of equals stays
                        i, j = np.searchsorted(hit, [s, s + m])
                        got = self.similarity(item, number[i:j], m)
                        if got >= self.threshold and (item not in best or got > best[item][0]):
                            best[item] = (got, s, n)
        for item, (s, start, n) in sorted(best.items()):
            yield item, s, start, n

    def similarity(self, item: int, numbers: np.ndarray, m: int) -> float:
        """Weighted Jaccard of an item's shingles and a window's ``m``, of which ``numbers`` are those of any item."""
        shared = sum((Counter(numbers.tolist()) & Counter(self.kind[self.first[item] : self.first[item + 1]].tolist())).values())
        return shared / (2 * m - shared)


def item_blocks(benchmark: DataFrame, text_column: str, block_bytes: int) -> Iterator[list[str]]:
    """The distinct item texts, in blocks of about ``block_bytes``."""
    held, size = [], 0
    distinct = benchmark.where(F.col(text_column).isNotNull()).select(F.col(text_column).alias("item_text")).distinct()
    for (text,) in distinct.orderBy("item_text").toLocalIterator():
        held.append(text)
        size += len(text.encode())
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def ahead(blocks: Iterator[list[str]]) -> Iterator[tuple[list[str], bool]]:
    """Each block, and whether it is the last; two blocks are held at a time."""
    held = next(blocks, None)
    while held is not None:
        following = next(blocks, None)
        yield held, following is None
        held = following


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, size: int = 5, radius: int = 16, block_bytes: int = 8 << 20,
    id_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text",
) -> DataFrame:
    """Rows (id, item, similarity, first_word, n_words): each document's best window for each item at ``threshold``.

    Similarity is the weighted Jaccard of ``size``-word shingles, weights being their counts; an item
    with fewer words is one shingle.  Items enter in blocks of about ``block_bytes`` of text, each a
    pass over all whole documents, so what is broadcast is bounded however large the benchmark; of
    several blocks each but the last is done, and given back, before the next is read.  Null
    and empty texts of either side match nothing; items of equal text are each reported; null ids
    stay null; repeated rows are reported apart; empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((docs, id_column), (benchmark, item_column))]
    names = benchmark.where(F.col(text_column).isNotNull()).select(F.col(item_column).alias("item"), F.col(text_column).alias("item_text"))
    schema = f"id {kinds[0]}, number int, similarity double, first_word long, n_words long"
    frame = batched(docs).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def search(shared) -> DataFrame:
        def look(batches):
            index = Benchmark(shared.value, size, threshold, radius)
            for batch in batches:
                rows = [(k + a, *rest) for data, bounds, a, _ in slices(batch.column(1)) for k, *rest in index.matches(data, bounds)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                kind = (pa.int32(), pa.float64(), pa.int64(), pa.int64())
                found = (pa.array(c, t) for c, t in zip(columns[1:], kind, strict=True))
                yield pa.RecordBatch.from_arrays([ids, *found], ["id", "number", "similarity", "first_word", "n_words"])

        return frame.mapInArrow(frugal(look), schema)

    parts = []
    for texts, last in ahead(item_blocks(benchmark, text_column, block_bytes)):
        shared = spark.sparkContext.broadcast(texts)
        # as many rows as a block has items
        items = names.join(F.broadcast(spark.createDataFrame(list(enumerate(texts)), "number int, item_text string")), "item_text").select("number", "item")
        part = search(shared).join(items, "number").drop("number")
        if not last:
            part = saved(part, "contaminated")
            shared.destroy()
        parts.append(part)
    if not parts:
        parts = [spark.createDataFrame([], f"{schema.replace(', number int', '')}, item {kinds[1]}")]
    everything = reduce(DataFrame.unionByName, parts)
    return everything.select(F.col("id").alias(id_column), F.col("item").alias(item_column), "similarity", "first_word", "n_words")


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, size: int = 5, radius: int = 16, block_bytes: int = 8 << 20, text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, that match no item.

    One narrow pass for each block of items; of several, each but the last is written before the next.
    """
    at, rows, before = docs.columns.index(text_column), docs, None

    def without(shared):
        def keep(batches):
            index = Benchmark(shared.value, size, threshold, radius)
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for data, bounds, a, _ in slices(batch.column(at)):
                    for k, *_ in index.matches(data, bounds):
                        clean[k + a] = False
                yield batch.filter(pa.array(clean))

        return keep

    for texts, last in ahead(item_blocks(benchmark, text_column, block_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(texts)
        rows = batched(rows).mapInArrow(frugal(without(shared)), docs.schema)
        if not last:
            rows = saved(rows, "uncontaminated")
            shared.destroy()
            if before is not None:
                dropped(before)
            before = rows
    return rows
