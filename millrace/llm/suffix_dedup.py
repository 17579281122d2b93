"""Removal of repeated byte strings through maximal repeats of an enhanced suffix array.

Texts are cut into *contexts*: the stretch of window starts that share their least 50-byte gram, the
anchor, together with the bytes their windows reach.  Equal windows have equal anchors at equal
places, so a window's repeats lie in contexts of the same anchor.  Anchors are asked about first;
contexts of an anchor that stands alone need nothing more.  Equal contexts are resolved by 128-bit
digests of their bytes.  What is left are the first occurrences of different contexts of one anchor, the edges of copied
passages: their bytes meet page by page, and an enhanced suffix array over each page gives all
maximal repeats with all their occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from millrace.llm.chunks import (
    CELL_BITS, Chunk, ChunkTable, bits, by_page, located, numbered, opened, pack, page_of, planes, replies, sorted_out, unpack, with_text,
)
from millrace.llm.common import RangeHash, digests, dropped, frugal
from millrace.llm.substring_dedup import kinds

GRAMS = RangeHash(8)
LOW = np.uint64((1 << CELL_BITS) - 1)
LAST = np.iinfo(np.int64).max


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values, from running minima of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: np.ndarray, bounds: np.ndarray, size: int, part: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, and anchor, of every context of texts laid end to end.

    Grams are hashed in parts of ``part`` window starts, and of a part only its contexts are kept.
    """
    gram = size // 2
    n = max(0, len(data) - size + 1)
    place = np.uint64((1 << 31) - 1)  # Spark's own limit of a text
    fits, begins = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
    for a, b in pairwise(bounds.tolist()):
        fits[a : max(a, b - size + 1)] = True
    anchors, before = [np.zeros(0, dtype=np.int64)], -1
    for a in range(0, n, part):
        hashes = GRAMS.windows(GRAMS.prefix(data[a : a + part + size - 1]), gram)
        hashes &= ~place
        hashes |= np.arange(len(hashes), dtype=np.uint64)
        anchor = (sliding_least(hashes, size - gram + 1) & place).astype(np.int64) + a
        mine = fits[a : a + len(anchor)]
        new = mine.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~mine[:-1]
        if a and fits[a - 1] and anchor[0] == before:
            new[0] = False
        begins[a : a + len(anchor)] = new
        anchors.append(anchor[new])
        before = int(anchor[-1])
    # a context ends where its text's windows end or the next one begins
    last = fits[:-1] & (~fits[1:] | begins[1:])
    return np.flatnonzero(begins), np.flatnonzero(last), np.concatenate(anchors)


class Ranks:
    """Ranks of all suffixes of separate strings by their first 8, 16, 32 ... bytes."""

    def __init__(self, text: np.ndarray, rest: np.ndarray, reach: int):
        """``rest``: bytes from each place to the end of its string; UTF-8 has no byte 255, the filling."""
        n = len(text)
        key = np.zeros(n, dtype=np.uint64)
        padded = np.concatenate([text, np.full(8, 255, dtype=np.uint8)])
        for k in range(8):
            key = (key << np.uint64(8)) | np.where(rest > k, padded[k : k + n], 255).astype(np.uint64)
        self.rest, self.levels = rest, [(8, self.ranked(key))]
        size = 8
        while size * 2 < reach:
            rank = self.levels[-1][1]
            self.levels.append((size * 2, self.ranked((rank << np.uint64(32)) | self.after(rank, size))))
            size *= 2
        self.size = size

    @staticmethod
    def ranked(key: np.ndarray) -> np.ndarray:
        return np.unique(key, return_inverse=True)[1].astype(np.uint64)

    def after(self, rank: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(len(rank)) if at is None else at
        beyond = rank[np.minimum(at + size, len(rank) - 1)]
        return np.where(self.rest[at] > size, beyond, np.uint64(len(rank)))

    def sort(self, at: np.ndarray) -> np.ndarray:
        """The given places in order of their suffixes, equal ones by place."""
        rank, keys = self.levels[-1][1], [at]
        far = int(self.rest[at].max(initial=0))
        for size in range((far // self.size) * self.size, -1, -self.size):
            keys.append(self.after(rank, size, at) if size else rank[at])
        return at[np.lexsort(keys)]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j."""
        most = np.minimum(self.rest[i], self.rest[j])
        n = np.zeros(len(i), dtype=np.int64)
        for size, rank in [self.levels[-1]] * (int(most.max(initial=0)) // self.size) + self.levels[::-1]:
            fits = n + size <= most
            a, b = np.where(fits, i + n, 0), np.where(fits, j + n, 0)
            n += size * (fits & (rank[a] == rank[b]))
        # fewer than 8 bytes are left, or they differ within 8
        text = self.text
        going = n < most
        for _ in range(8):
            a, b = np.where(going, i + n, 0), np.where(going, j + n, 0)
            going = going & (text[a] == text[b])
            n += going
            going = going & (n < most)
        return n


def maximal_repeats(text: np.ndarray, ends: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places of all occurrences) of the maximal repeats of ``least`` bytes or more.

    ``text`` holds separate strings that end at ``ends``; no repeat crosses an end.  The suffixes of
    ``least`` bytes or more are sorted and their common prefixes found; a scan with a stack visits
    the prefix intervals from the inside out.  An interval is kept if its occurrences can't all be
    extended to the left: two follow different bytes, or one begins its string.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    rest = np.repeat(ends, ends - starts) - np.arange(len(text))
    at = np.flatnonzero(rest >= least)
    if len(at) < 2:
        return
    ranks = Ranks(text, rest, least)
    ranks.text = text
    sa = ranks.sort(at)
    lcp = ranks.common(sa[:-1], sa[1:])
    begins = np.zeros(len(text), dtype=bool)
    begins[starts[starts < len(text)]] = True
    left = text[np.maximum(sa - 1, 0)].astype(np.int64)
    change = (left[1:] != left[:-1]) | begins[sa[1:]] | begins[sa[:-1]]
    changes = np.concatenate([[0], np.cumsum(change)])
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return
    runs = np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1)
    for run in runs:
        a, b = int(run[0]), int(run[-1]) + 1  # suffixes a to b share ``least`` bytes
        if b == a + 1:
            if change[a]:
                yield int(lcp[a]), sa[a : b + 1]
            continue
        stack = []
        for k, depth in enumerate([*lcp[a:b].tolist(), 0], a):
            lower = k
            while stack and stack[-1][0] > depth:
                length, lower = stack.pop()
                if changes[k] > changes[lower]:
                    yield length, sa[lower : k + 1]
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, lower))


def later_windows(text: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which places start a window of ``size`` bytes that also starts at a smaller place."""
    steps = np.zeros(len(text) + 1, dtype=np.int64)
    for length, places in maximal_repeats(text, ends, size):
        again = places[places != places.min()]
        steps[again] += 1
        np.subtract.at(steps, again + length - size + 1, 1)
    return np.cumsum(steps[:-1]) > 0


class View:
    """A chunk's contexts with their anchors' hashes."""

    def __init__(self, c: Chunk, size: int):
        lo, span, offset = unpack(c.notes, np.uint32, np.uint8, np.uint8)
        self.lo, self.size, self.data = lo.astype(np.int64), size, c.data
        self.hi = self.lo + span
        anchor = self.lo + offset
        self.key = self.hashes(anchor, anchor + size // 2)
        texts = np.searchsorted(c.bounds, self.lo, side="right") - 1
        doc = np.asarray(c.ids.fill_null(LAST).to_numpy(zero_copy_only=False), dtype=np.int64)
        self.doc_of = doc[texts] if len(texts) else texts

    def hashes(self, lo: np.ndarray, end: np.ndarray, part: int = 1 << 18) -> np.ndarray:
        """Hashes of data[lo:end] for short ranges whose starts ascend, in parts of ``part`` starts, for the working memory."""
        out = np.empty(len(lo), dtype=np.uint64)
        k = 0
        while k < len(lo):
            a = int(lo[k])
            to = int(np.searchsorted(lo, a + part))
            prefix = GRAMS.prefix(self.data[a : int(end[k:to].max())])
            out[k:to] = GRAMS.between(prefix, lo[k:to] - a, end[k:to] - a)
            k = to
        return out

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and documents of all windows of the chosen contexts."""
        n = (self.hi - self.lo + 1)[which]
        at = np.repeat(self.lo[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else self.lo[:0]
        return at, np.repeat(self.doc_of[which], n)


class Asked:
    """What a chunk asks in pass 2: distinct strings by (cell, digest), where each is first, and every string's kind."""

    def __init__(self, raw: bytes, cells: np.ndarray, doc: np.ndarray, lo: np.ndarray, end: np.ndarray):
        high, low = digests(raw, lo, end)
        # a chunk's strings stand in the order of documents and places, and equal ones keep it
        self.first, self.kind = kinds(cells, high, low)
        self.cells, self.high, self.low = cells[self.first], high[self.first], low[self.first]
        self.doc, self.lo = doc[self.first], lo[self.first]

    def questions(self, first_page: int):
        for page, a, b in by_page(page_of(self.cells)):
            columns = ((self.cells[a:b] & LOW).astype(np.uint32), self.high[a:b], self.low[a:b], self.doc[a:b], self.lo[a:b].astype(np.uint32))
            yield first_page + page, pack(*columns)


def stretches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of equal neighbours, and the number of its stretch for each."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


class SuffixDedup:
    """Finds, for every window of ``size`` bytes, whether it also starts earlier.

    An anchor with over ``hot`` contexts, counted by chunk, is too much for one page: its windows are
    resolved by their own digests instead, which spreads different windows over all pages, while
    equal windows of a chunk are combined first.  Nothing is capped: that way is exact as well.
    """

    def __init__(self, size: int = 100, page_items: int = 1 << 20, page_bytes: int = 4 << 20, hot: int = 1 << 14):
        if not 16 <= size <= 256:
            raise ValueError("windows of 16 to 256 bytes")
        self.size, self.page_items, self.page_bytes, self.hot = size, page_items, page_bytes, hot

    def run(self, docs: DataFrame, use, schema, carry: bool = False, **names) -> DataFrame:
        """``use(chunk, gone)`` makes a batch for each chunk; the result is a written table.

        With ``carry`` rows hold texts and are written where they are made; others are few bytes each,
        and are dealt out anew so that files are few.
        """
        size, hot = self.size, self.hot

        def note(data, bounds):
            lo, hi, anchor = contexts(data, bounds, size)
            return pack(lo.astype(np.uint32), (hi - lo).astype(np.uint8), (anchor - lo).astype(np.uint8))

        chunks = ChunkTable(docs, note, carry, **names)
        pages = chunks.pages(chunks.total // (size // 4), self.page_items)
        text_pages = max(1, -(-chunks.total // self.page_bytes))

        def count(c):
            v = View(c, size)
            # a weak hash of the contexts does here: it tells how many kinds there are, not which are equal
            weak = v.hashes(v.lo, v.hi + size)
            first, kind = kinds(located(v.key, pages), weak)
            if not len(first):
                return
            cells = located(v.key[first], pages)
            starts, _ = stretches(cells)
            different = np.minimum(np.diff(np.append(starts, len(first))), 65535).astype(np.uint16)
            many = np.add.reduceat(np.bincount(kind), starts) > 1
            cells = cells[starts]
            for page, a, b in by_page(page_of(cells)):
                yield page, pack((cells[a:b] & LOW).astype(np.uint32), different[a:b], many[a:b])

        def weigh(_, blobs):
            held = [unpack(b, np.uint32, np.uint16, bool) for b in blobs]
            cells, different, many = (np.concatenate([x[k] for x in held]) for k in range(3))
            order = np.argsort(cells, kind="stable")
            starts, number = stretches(cells[order])
            twice, heavy = np.empty(len(cells), dtype=bool), np.empty(len(cells), dtype=bool)
            twice[order] = (np.add.reduceat(1 + many[order], starts) > 1)[number]
            heavy[order] = (np.add.reduceat(different[order].astype(np.int64), starts) > hot)[number]
            at = np.cumsum([len(x[0]) for x in held])[:-1]
            return [planes(t, h & t) for t, h in zip(np.split(twice, at), np.split(heavy, at), strict=True)]

        def asked(c, v: View, answers):
            """What pass 2 is asked: the contexts of repeated anchors, chosen by number, and the windows of hot ones."""
            cells, which = np.unique(located(v.key, pages), return_inverse=True)
            twice, heavy = bits(answers, page_of(cells))[which], bits(answers, page_of(cells), 1)[which]
            chosen, raw = np.flatnonzero(twice & ~heavy), c.data.tobytes()
            whole = Asked(raw, located(v.key[chosen], pages), v.doc_of[chosen], v.lo[chosen], v.hi[chosen] + size)
            at, doc = v.windows(np.flatnonzero(heavy))
            single = Asked(raw, located(v.hashes(at, at + size), pages), doc, at, at + size)
            return chosen, whole, at, single

        def detail(c):
            _, whole, _, single = asked(c, View(c, size), c.answers)
            yield from whole.questions(0)
            yield from single.questions(pages)

        def resolve(owners, blobs):
            held = [unpack(b, np.uint32, np.uint64, np.uint64, np.int64, np.uint32) for b in blobs]
            sizes = [len(x[0]) for x in held]
            cells, high, low, doc, at = (np.concatenate([x[k] for x in held]) for k in range(5))
            owner = np.repeat(np.array(owners, dtype=np.int64), sizes)
            order = np.lexsort((at, owner, doc, low, high, cells))
            c, h, g = cells[order], high[order], low[order]
            new = np.ones(len(c), dtype=bool)
            new[1:] = (c[1:] != c[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            starts, number = stretches(c)
            several = (np.add.reduceat(new.astype(np.int64), starts) > 1)[number]
            earliest, apart = np.empty(len(c), dtype=bool), np.empty(len(c), dtype=bool)
            earliest[order], apart[order] = new, new & several
            cuts = np.cumsum(sizes)[:-1]
            return [planes(e, s) for e, s in zip(np.split(earliest, cuts), np.split(apart, cuts), strict=True)]

        def text_page(v: View, which: np.ndarray) -> np.ndarray:
            return ((v.key[which] >> np.uint64(CELL_BITS)) % np.uint64(text_pages)).astype(np.int64)

        def opened_contexts(v: View, chosen, whole: Asked, answers):
            """The contexts whose bytes must be compared, by the page where they meet, in text order there."""
            mine = np.sort(chosen[whole.first[bits(answers, page_of(whole.cells), 1)]])
            page = text_page(v, mine)
            order = np.argsort(page, kind="stable")
            for p, a, b in by_page(page[order]):
                yield p, mine[order[a:b]]

        def show(c):
            v, passes = View(c, size), sorted_out(c.answers, 2)
            chosen, whole, *_ = asked(c, v, passes[0])
            for page, mine in opened_contexts(v, chosen, whole, passes[1]):
                lo, hi = v.lo[mine], v.hi[mine] + size
                text = b"".join([c.data[s:e].tobytes() for s, e in zip(lo.tolist(), hi.tolist(), strict=True)])
                head = pack(lo.astype(np.uint32), (hi - lo).astype(np.uint32), v.doc_of[mine])
                yield page, len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=1).compress(text)

        def compare(owners, blobs):
            heads, texts = [], []
            for b in blobs:
                n = int.from_bytes(b[:4], "little")
                heads.append(unpack(b[4 : 4 + n], np.uint32, np.uint32, np.int64))
                texts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4 + n :]), dtype=np.uint8))
            sizes = [len(h[0]) for h in heads]
            at, length, doc = (np.concatenate([h[k] for h in heads]) for k in range(3))
            length = length.astype(np.int64)
            given = np.concatenate([[0], np.cumsum(length)])
            # strings stand in the order of their occurrences, so that a smaller place is an earlier one
            order = np.lexsort((at, np.repeat(np.array(owners, dtype=np.int64), sizes), doc))
            ends = np.cumsum(length[order])
            source = np.repeat(given[:-1][order] - (ends - length[order]), length[order]) + np.arange(given[-1])
            later = np.zeros(given[-1], dtype=bool)
            later[source] = later_windows(np.concatenate(texts)[source], ends, size)
            bounds = given[np.concatenate([[0], np.cumsum(sizes)])]
            return [planes(later[a:b]) for a, b in pairwise(bounds.tolist())]

        def finish(batches):
            for c in opened(batches):
                v, passes = View(c, size), sorted_out(c.answers, 3)
                chosen, whole, at, single = asked(c, v, passes[0])
                steps = np.zeros(len(c.data) + 1, dtype=np.int32)

                def cover(lo, end, steps=steps):
                    np.add.at(steps, lo, 1)
                    np.subtract.at(steps, end, 1)

                # contexts of repeated anchors are gone, but for the earliest of each kind
                kept = np.ones(len(v.lo), dtype=bool)
                kept[chosen] = False
                kept[chosen[whole.first[bits(passes[1], page_of(whole.cells))]]] = True
                cover(v.lo[~kept], v.hi[~kept] + size)
                stays = np.zeros(len(at), dtype=bool)
                stays[single.first[bits(passes[1], page_of(single.cells), 0, pages)]] = True
                cover(at[~stays], at[~stays] + size)
                for page, mine in opened_contexts(v, chosen, whole, passes[1]):
                    if page in passes[2]:
                        length = v.hi[mine] + size - v.lo[mine]
                        place = np.repeat(v.lo[mine] - (np.cumsum(length) - length), length) + np.arange(length.sum())
                        flags = np.unpackbits(np.frombuffer(passes[2][page], np.uint8), count=len(place)).astype(bool)
                        cover(place[flags], place[flags] + size)
                yield use(c, np.cumsum(steps[:-1], dtype=np.int32) > 0)

        try:
            first = chunks.saved(replies(chunks.rows(), count, pages, weigh).hint("rebalance"), "anchors")
            second = chunks.saved(replies(chunks.answered(first), detail, 2 * pages, resolve).hint("rebalance"), "contexts")
            third = chunks.saved(replies(chunks.answered(numbered([first, second])), show, text_pages, compare).hint("rebalance"), "suffixes")
            result = chunks.answered(numbered([first, second, third])).mapInArrow(frugal(finish), schema)
            result = chunks.saved(result if carry else result.hint("rebalance"), "suffix-dedup")
            dropped(first, second, third)
        finally:
            chunks.drop()
        return result


def spans(gone: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))
    return np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()


def digest_rows(c, gone) -> pa.RecordBatch:
    removed, runs, kept = [], [], []
    for a, b in pairwise(c.bounds.tolist()):
        mine, data = gone[a:b], c.data[a:b]
        removed.append(int(mine.sum()))
        runs.append(len(spans(mine)[0]) if removed[-1] else 0)
        kept.append(hashlib.sha256((data[~mine] if removed[-1] else data).tobytes()).hexdigest())
    arrays = [c.ids, pa.array(np.diff(c.bounds)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_digests(docs: DataFrame, size: int = 100, **names) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one for each input row, whole texts.

    A null text is empty; one shorter than a window loses nothing.  Repeated rows and rows of one id
    are separate texts in a fixed order; null ids come last in that order and stay null.  An empty
    table gives no rows; other columns are ignored.
    """
    return SuffixDedup(size).run(docs, digest_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", **names)


def without_repeats(docs: DataFrame, size: int = 100, text_column: str = "text", **names) -> DataFrame:
    """The rows of ``docs``, all columns, with the texts that the cuts leave.

    The bytes of a character that a cut breaks go too.  Texts that lose nothing, and null ones, are
    unchanged.
    """

    columns = docs.columns

    def rows(c, gone) -> pa.RecordBatch:
        kept = []
        for a, b in pairwise(c.bounds.tolist()):
            mine = gone[a:b]
            kept.append((c.data[a:b][~mine] if mine.any() else c.data[a:b]).tobytes().decode("utf-8", "ignore"))
        return with_text(columns, c, kept, text_column)

    return SuffixDedup(size).run(docs, rows, docs.schema, carry=True, text_column=text_column, **names)
