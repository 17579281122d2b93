"""Removal of repeated word windows behind a count-min prefilter."""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.chunks import (
    CELL_BITS, ChunkTable, bits, by_page, located, numbered, opened, pack, page_of, planes, ranged, replies, sorted_out, unpack, with_text,
)
from millrace.llm.common import RangeHash, digests, dropped, frugal, joined_words, mixed, word_hashes

BYTES, SKETCH = RangeHash(1), RangeHash(2)
LOW = np.uint64((1 << CELL_BITS) - 1)


def window_hashes(data: np.ndarray, bounds: np.ndarray, size: int):
    """Word ranges, words before each text, and the starts of its windows with a hash of each."""
    starts, ends, (words,) = word_hashes(BYTES, data, bounds)
    first = np.searchsorted(starts, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    n = max(0, len(words) - size + 1)
    at = np.flatnonzero(text[:n] == text[size - 1 : size - 1 + n])
    return starts, ends, first, at, SKETCH.windows(SKETCH.prefix(words), size)[at]


def window_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the windows at ``at``: of their words, joined by one space each."""
    if not len(at):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    line, begin = joined_words(data, starts, ends)
    last = at + size - 1
    return digests(line, begin[at], begin[last] + (ends - starts)[last])


def repeated(values: np.ndarray) -> np.ndarray:
    """The distinct values that stand twice or more among ``values``."""
    values = np.sort(values)
    return np.unique(values[1:][values[1:] == values[:-1]])


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[at] == values


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words the windows that start at ``at`` cover."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(at + size, n), -1)
    return np.cumsum(steps[:n]) > 0


def kinds(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal columns are of one kind: the first row of each kind, in order, and every row's kind."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    of = np.empty(len(order), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


class SubstringDedup:
    """Repeated windows of ``size`` words, found in two passes over chunks of whole texts.

    Pass 1, the count-min sketch of ``depth`` rows: every chunk counts its windows' cells in each
    row up to two; the sketches of all chunks are added page by page (a page is a range of a row),
    and whether a count is two or more, which can be too high but never too low, comes back as one
    bit a cell.  A window is estimated repeated if all its rows say so.  A row has a page of 2**28
    cells for every ``page_items`` windows of the input, so estimates stay as sharp when the input
    grows.  Pass 2 groups only the windows estimated repeated, by 128-bit digests of their words,
    and tells each chunk which of them truly are.
    """

    def __init__(self, size: int = 35, page_items: int = 4 << 20, depth: int = 1):
        self.size, self.page_items, self.depth = size, page_items, depth

    def run(self, docs: DataFrame, use, schema, carry: bool = False, **names) -> DataFrame:
        """``use(chunk, starts, ends, first, gone)`` makes a batch for each chunk; the result is a written table.

        With ``carry`` rows hold texts and are written where they are made; others are few bytes each,
        and are dealt out anew so that files are few.
        """
        chunks, size, depth = ChunkTable(docs, carry=carry, **names), self.size, self.depth
        pages = chunks.pages(chunks.total // 6, self.page_items)

        def rows(h):
            """A chunk's distinct cells of each row with the row's first page, how often, and which is each window's."""
            for k in range(depth):
                h = mixed(h ^ np.uint64(k)) if k else h
                yield k * pages, *np.unique(located(h, pages), return_inverse=True, return_counts=True)

        def count(c):
            *_, h = window_hashes(c.data, c.bounds, size)
            for first_page, cells, _, often in rows(h):
                for page, a, b in by_page(page_of(cells)):
                    yield first_page + page, pack((cells[a:b] & LOW).astype(np.uint32), often[a:b] > 1)

        def add(_, blobs):
            held = [unpack(b, np.uint32, bool) for b in blobs]
            often = repeated(np.concatenate([x for cells, twice in held for x in (cells, cells[twice])]))
            return [planes(member(cells, often)) for cells, _ in held]

        def suspects(c, answers):
            """The chunk's words, the windows that the sketch holds for repeated, and these by digest."""
            *words, at, h = window_hashes(c.data, c.bounds, size)
            likely = np.ones(len(at), dtype=bool)
            for first_page, cells, which, _ in rows(h):
                likely &= bits(answers, page_of(cells), 0, first_page)[which]
            at = at[likely]
            high, low = window_digests(c.data, words[0], words[1], at, size)
            first, kind = kinds(high, low)
            return words, at, high[first], low[first], kind

        def detail(c):
            *_, high, low, kind = suspects(c, c.answers)
            many = np.bincount(kind, minlength=len(high)) > 1
            for page, a, b in by_page(ranged(high, pages)):
                yield page, pack(high[a:b], low[a:b], many[a:b])

        def group(_, blobs):
            held = [unpack(b, np.uint64, np.uint64, bool) for b in blobs]
            high, low, many = (np.concatenate([x[k] for x in held]) for k in range(3))
            _, kind = kinds(high, low)
            # a window that repeats within one chunk repeats for all chunks that hold it
            often = np.bincount(kind, 1 + many) > 1
            return [planes(f) for f in np.split(often[kind], np.cumsum([len(x[0]) for x in held])[:-1])]

        def finish(batches):
            # both passes' answers are needed: the first tells which windows the second was asked about
            for c in opened(batches):
                passes = sorted_out(c.answers, 2)
                (starts, ends, words), at, high, _, kind = suspects(c, passes[0])
                truly = bits(passes[1], ranged(high, pages))
                yield use(c, starts, ends, words, covered(at[truly[kind]], size, len(starts)))

        try:
            first = chunks.saved(replies(chunks.rows(), count, depth * pages, add).hint("rebalance"), "sketch")
            second = chunks.saved(replies(chunks.answered(first), detail, pages, group).hint("rebalance"), "windows")
            result = chunks.answered(numbered([first, second])).mapInArrow(frugal(finish), schema)
            result = chunks.saved(result if carry else result.hint("rebalance"), "substring-dedup")
            dropped(first, second)
        finally:
            chunks.drop()
        return result


def digest_rows(c, starts, ends, first, gone) -> pa.RecordBatch:
    raw, kept = c.data.tobytes(), []
    for a, b in pairwise(first.tolist()):
        words = np.flatnonzero(~gone[a:b]) + a
        kept.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(starts[words].tolist(), ends[words].tolist(), strict=True)])).hexdigest())
    totals = np.concatenate([[0], np.cumsum(gone)])
    arrays = [c.ids, pa.array(np.diff(first)), pa.array(np.diff(totals[first])), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256"])


def removed_digests(docs: DataFrame, size: int = 35, **names) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), one for each input row, whole texts.

    A null or empty text has no words, and one with fewer words than a window loses none.  Repeated
    rows, and rows of one id, are separate texts that repeat each other's windows.  Null ids stay
    null; an empty table gives no rows; other columns are ignored.
    """
    return SubstringDedup(size).run(docs, digest_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string", **names)


def without_repeats(docs: DataFrame, size: int = 35, text_column: str = "text", **names) -> DataFrame:
    """The rows of ``docs``, all columns, with the words left joined by single spaces.

    Texts that lose no word, and null ones, are unchanged.
    """

    columns = docs.columns

    def rows(c, starts, ends, first, gone) -> pa.RecordBatch:
        raw, kept = c.data.tobytes(), []
        for (a, b), (from_, to) in zip(pairwise(first.tolist()), pairwise(c.bounds.tolist()), strict=True):
            if gone[a:b].any():
                words = np.flatnonzero(~gone[a:b]) + a
                kept.append(b" ".join([raw[s:e] for s, e in zip(starts[words].tolist(), ends[words].tolist(), strict=True)]).decode())
            else:
                kept.append(raw[from_:to].decode())
        return with_text(columns, c, kept, text_column)

    return SubstringDedup(size).run(docs, rows, docs.schema, carry=True, text_column=text_column, **names)
