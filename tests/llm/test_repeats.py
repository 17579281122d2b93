from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import substring_dedup, suffix_dedup
from millrace.llm.chunks import Chunk, ChunkTable, even_keys, pack, spark_hash, unpack
from millrace.llm.common import SEPARATOR, RangeHash, digests, word_hashes, word_ranges
from millrace.llm.suffix_dedup import View, contexts, later_windows, maximal_repeats, sliding_least

from .conftest import words


def brute_words(texts, size):
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[k : k + size]) for w in split for k in range(len(w) - size + 1))
    for w in split:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        yield w, gone


def brute_bytes(texts, size):
    seen = set()
    for t in texts:
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for k in range(len(data) - size + 1):
            if data[k : k + size] in seen:
                gone[k : k + size] = True
            seen.add(data[k : k + size])
        yield data, gone


@pytest.mark.parametrize(("size", "chunk"), [(35, 4 << 20), (35, 3000), (3, 3000)])
def test_substring_dedup(docs, corpus, multiset, size, chunk):
    want = []
    for (i, _, _), (w, gone) in zip(corpus, brute_words([t for _, t, _ in corpus], size), strict=True):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert multiset(substring_dedup.removed_digests(docs, size, chunk_bytes=chunk).collect()) == multiset(want)


def test_substring_rows(docs, no_docs, corpus, multiset):
    got = substring_dedup.without_repeats(docs)
    assert got.schema == docs.schema
    want = []
    for (i, t, _), (w, gone) in zip(corpus, brute_words([t for _, t, _ in corpus], 35), strict=True):
        want.append((i, " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else t))
    assert multiset(got.select("doc_id", "text").collect()) == multiset(want)
    assert substring_dedup.without_repeats(no_docs).collect() == []
    assert substring_dedup.removed_digests(no_docs).collect() == []


def unique_ids(docs):
    return docs.where("doc_id is not null").dropDuplicates(["doc_id"]).cache()


@pytest.mark.parametrize(("size", "chunk", "hot"), [(100, 4 << 20, 1 << 14), (100, 3000, 1 << 14), (100, 3000, 2), (20, 3000, 3)])
def test_suffix_dedup(docs, multiset, size, chunk, hot):
    rows = unique_ids(docs)
    texts = sorted(((r["doc_id"], r["text"]) for r in rows.collect()), key=lambda x: x[0])
    want = []
    for (i, _), (data, gone) in zip(texts, brute_bytes([t for _, t in texts], size), strict=True):
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        want.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    found = suffix_dedup.SuffixDedup(size, page_items=5000, page_bytes=4000, hot=hot).run(rows, suffix_dedup.digest_rows, schema, chunk_bytes=chunk)
    assert multiset(found.collect()) == multiset(want)


def test_suffix_rows_of_repeated_ids(docs, no_docs, corpus):
    got = suffix_dedup.without_repeats(docs)
    assert got.schema == docs.schema
    held = got.where("doc_id = 4000").collect()
    assert len(held) == 3 and sum(len(r["text"]) for r in held) < 200  # the original has a smaller id
    assert got.count() == len(corpus)
    by_digest = suffix_dedup.removed_digests(docs)
    assert by_digest.count() == len(corpus)
    assert suffix_dedup.without_repeats(no_docs).collect() == []
    assert suffix_dedup.removed_digests(no_docs).collect() == []


def brute_maximal(strings, least):
    places = {}
    at = 0
    for s in strings:
        for k in range(len(s)):
            for n in range(least, len(s) - k + 1):
                places.setdefault(s[k : k + n], []).append((at, k, len(s)))
        at += len(s)
    text = b"".join(strings)
    found = set()
    for s, held in places.items():
        if len(held) < 2:
            continue
        left = {text[at + k - 1] if k else (at, k) for at, k, _ in held}
        right = {text[at + k + len(s)] if k + len(s) < n else (at, k) for at, k, n in held}
        if len(left) > 1 and len(right) > 1:
            found.add((len(s), tuple(sorted(at + k for at, k, _ in held))))
    return found


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=40), max_size=6), st.integers(2, 20))
def test_maximal_repeats(texts, least):
    strings = [t.encode() for t in texts]
    text, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings]).astype(np.int64)
    got = {(n, tuple(sorted(p.tolist()))) for n, p in maximal_repeats(text, ends, least)}
    assert got == brute_maximal(strings, least)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=60), max_size=6), st.integers(2, 30))
def test_later_windows(texts, size):
    strings = [t.encode() for t in texts]
    seen, want = set(), []
    for s in strings:
        for k in range(len(s)):
            w = s[k : k + size]
            want.append(len(w) == size and w in seen)
            seen.add(w)
    got = later_windows(np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings]).astype(np.int64), size)
    assert got.tolist() == want


def test_contexts_cover_every_window_once():
    rnd = np.random.default_rng(2)
    data = rnd.integers(97, 100, 3000).astype(np.uint8)
    bounds = np.array([0, 0, 500, 599, 700, 3000])
    lo, hi, anchor = contexts(data, bounds, 100)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)])
    assert starts.tolist() == [k for a, b in zip(bounds, bounds[1:], strict=False) for k in range(a, b - 99)]
    assert ((anchor >= hi) & (anchor <= lo + 50)).all()


@pytest.mark.parametrize("part", [1, 7, 64, 300])
def test_contexts_in_parts(part):
    rng = np.random.default_rng(part)
    for alphabet in (1, 2, 90):
        bounds = np.concatenate([[0], np.cumsum([400, 0, 99, 100, 101, 700])])
        data = rng.integers(97, 97 + alphabet, bounds[-1]).astype(np.uint8)
        for got, want in zip(contexts(data, bounds, 100, part), contexts(data, bounds, 100), strict=True):
            assert got.tolist() == want.tolist()


def test_memory_of_contexts_is_a_small_multiple_of_a_long_text():
    data = np.random.default_rng(9).integers(97, 123, 8 << 20).astype(np.uint8)
    tracemalloc.start()
    lo, hi, anchor = contexts(data, np.array([0, len(data)]), 100)
    assert tracemalloc.get_traced_memory()[1] < 8 * len(data)
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    note = pack(lo.astype(np.uint32), (hi - lo).astype(np.uint8), (anchor - lo).astype(np.uint8))
    view = View(Chunk(0, pa.array([1]), data, np.array([0, len(data)]), np.zeros(1, dtype=bool), note, {}, None), 100)
    assert len(view.key) == len(lo) and tracemalloc.get_traced_memory()[1] - held < 8 * len(data)
    tracemalloc.stop()


def test_sliding_least():
    x = np.random.default_rng(1).integers(0, 50, 200)
    for width in (1, 2, 7, 51, 200):
        assert sliding_least(x, width).tolist() == [x[k : k + width].min() for k in range(len(x) - width + 1)]
    assert len(sliding_least(x, 201)) == 0


def test_packed_columns():
    rnd = random.Random(1)
    for n in (0, 1, 9, 500):
        a = np.sort(np.array([rnd.getrandbits(32) for _ in range(n)], dtype=np.uint32))
        b, c = np.array([rnd.getrandbits(64) for _ in range(n)], dtype=np.uint64), np.array([rnd.random() < 0.5 for _ in range(n)], dtype=bool)
        got = unpack(pack(a, b, c), np.uint32, np.uint64, bool)
        assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(got, (a, b, c), strict=True))


def test_range_hashes_depend_on_content_alone():
    data = np.frombuffer(b"abcXabcYab cabc", np.uint8)
    h = RangeHash(4)
    p = h.prefix(data)
    at = np.array([0, 4, 12])
    assert len(set(h.between(p, at, at + 3).tolist())) == 1
    assert h.between(p, np.array([0]), np.array([3])) != h.between(p, np.array([1]), np.array([4]))
    assert (h.windows(p, 3)[at] == h.between(p, at, at + 3)).all()


def test_words_never_cross_texts():
    data, bounds = np.frombuffer(b"ab cdef  g", np.uint8), np.array([0, 2, 5, 5, 10])
    starts, ends = word_ranges(data, bounds)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"ef", b"g"]


def test_words_hash_alike_in_parts():
    data, bounds = np.frombuffer(b"abcdefgh ab abc  abcdefgh xyz" * 9, np.uint8), np.array([0, 100, 261])
    whole = word_hashes(RangeHash(5), data, bounds, SEPARATOR, (1 << 40, 3))
    for part in (1, 4, 50):
        some = word_hashes(RangeHash(5), data, bounds, SEPARATOR, (1 << 40, 3), part)
        assert all((a == b).all() for a, b in zip([*whole[:2], *whole[2]], [*some[:2], *some[2]], strict=True))


def thue_morse(n, a="a", b="b"):
    """The sequence and its complement; polynomial hashes modulo 2**64 can't tell long ones apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


def test_regular_strings_do_collide_in_range_hashes():
    one, other = ("".join(x).encode() for x in thue_morse(2048))
    h = RangeHash(1)
    assert h.windows(h.prefix(np.frombuffer(one, np.uint8)), 2048) == h.windows(h.prefix(np.frombuffer(other, np.uint8)), 2048)


@pytest.mark.parametrize("n", [64, 128, 256, 512, 1024, 2048, 4096])
def test_windows_that_differ_in_one_regular_word_are_different(spark, n):
    shared = [f"w{k}" for k in range(34)]
    texts = [" ".join([*shared, "".join(x)]) for x in thue_morse(n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 2):
        got = substring_dedup.removed_digests(df.repartition(parts)).collect()
        assert [r["n_removed"] for r in got] == [0, 0]


@pytest.mark.parametrize("n", [64, 256, 1024, 4096])
def test_windows_of_regular_words_are_different(spark, n, multiset):
    texts = [" ".join(x) for x in thue_morse(n)]
    texts += [texts[0] + " more", "x " + texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring_dedup.removed_digests(df, n).select("doc_id", "n_removed").collect()
    assert multiset(got) == multiset((k, sum(gone)) for k, (_, gone) in enumerate(brute_words(texts, n)))


@pytest.mark.parametrize(("size", "hot"), [(256, 1 << 14), (256, 0), (100, 0)])
def test_regular_bytes_are_compared(spark, multiset, size, hot):
    one, other = ("".join(x) for x in thue_morse(4096))
    rnd = random.Random(9)
    shared = "".join(rnd.choices("abcdefgh", k=150))
    texts = [shared + one, shared + other, one[:200] + shared + other[:300], other[64:1088], one[128:1152]]
    want = [(k, int(gone.sum())) for k, (_, gone) in enumerate(brute_bytes(texts, size))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    got = suffix_dedup.SuffixDedup(size, hot=hot).run(df, suffix_dedup.digest_rows, schema).select("doc_id", "n_removed").collect()
    assert multiset(got) == multiset(want)


def test_digests_are_sha256():
    data = b"abcdefgh" * 20
    high, low = digests(data, np.array([0, 3, 160]), np.array([5, 3, 160]))
    for k, (a, b) in enumerate(((0, 5), (3, 3), (160, 160))):
        assert np.array([high[k], low[k]]).tobytes() == hashlib.sha256(data[a:b]).digest()[:16]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_sketches_of_any_depth_lose_nothing(docs, corpus, multiset, depth):
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    got = substring_dedup.SubstringDedup(35, page_items=500, depth=depth).run(docs, substring_dedup.digest_rows, schema, chunk_bytes=3000)
    want = [(i, sum(gone)) for (i, _, _), (_, gone) in zip(corpus, brute_words([t for _, t, _ in corpus], 35), strict=True)]
    assert multiset(got.select("doc_id", "n_removed").collect()) == multiset(want)


def test_even_keys(spark):
    from pyspark.sql import functions as F

    numbers = list(range(-3, 500))
    assert [r[0] for r in spark.createDataFrame([(k,) for k in numbers], "k int").select(F.hash("k")).collect()] == spark_hash(np.array(numbers)).tolist()
    for n in (1, 2, 7, 100):
        assert (spark_hash(even_keys(n)).astype(np.int64) % n).tolist() == list(range(n))


def test_chunk_buckets_are_even(spark):
    texts = [(k, "ab " * 300) for k in range(640)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    chunks = ChunkTable(df, chunk_bytes=2000, bucket_bytes=20_000)
    try:
        sizes = [r["n"] for r in chunks.rows().groupBy("part").agg({"body": "count"}).withColumnRenamed("count(body)", "n").collect()]
        assert chunks.buckets == 32 and len(sizes) == 32 and max(sizes) <= 1.5 * min(sizes)
        assert chunks.rows().select("chunk").distinct().count() == chunks.rows().count()
    finally:
        chunks.drop()


def test_ids_must_be_integers(spark):
    df = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    with pytest.raises(ValueError, match="integer"):
        substring_dedup.removed_digests(df)


def test_null_and_repeated_ids_against_brute_force(spark, multiset):
    """Rows of one id, and rows without an id, repeat each other; which of them stays isn't fixed, how much does."""
    rnd = random.Random(8)
    passage = "".join(rnd.choices("abcdefgh ", k=400))
    rows = [(1, passage), (1, passage), (1, passage[:300]), (None, passage + "tail"), (None, "head" + passage), (2, None), (2, ""), (0, passage[100:350])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = suffix_dedup.removed_digests(df).collect()
    assert len(got) == len(rows)
    # smaller ids first: 0 keeps all its 250 bytes, the rows of 1 together all but what stands in 0, null ids come last
    left = Counter()
    for r in got:
        left[r["doc_id"]] += r["n_bytes"] - r["n_removed"]
    assert left[0] == 250 and left[2] == 0
    best = {sum(len(d) - int(g.sum()) for d, g in list(brute_bytes([passage[100:350], *order], 100))[1:]) for order in ((passage, passage, passage[:300]), (passage[:300], passage, passage))}
    assert left[1] in best
    assert 0 < left[None] <= 8
