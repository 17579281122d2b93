from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from millrace.llm import decontaminate as D

from .conftest import WORDS


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-/:-`{-\x7f]+", lowered)


def shingles(w, size=5):
    size = min(size, len(w))
    return Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if w else Counter()


def brute(docs, items):
    for i, text in docs:
        w = tokens(text)
        for j, item in items:
            n = len(tokens(item))
            want = shingles(tokens(item))
            best = 0.0
            for k in range(len(w) - n + 1 if n else 0):
                got = shingles(w[k : k + n])
                best = max(best, sum((got & want).values()) / sum((got | want).values()))
            if best >= 0.8:
                yield i, j, round(best, 9)


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(6)
    words = [a + b for a in WORDS for b in ("", "x", "y")]
    items = [(k, " ".join(rnd.choices(words, k=rnd.randint(12, 55)))) for k in range(12)]
    items += [(50, "one two three"), (51, items[0][1].upper() + "!"), (52, items[1][1]), (53, None), (54, ""), (None, items[2][1])]
    docs = []
    for k in range(80):
        w = rnd.choice(items[:12])[1].split(" ")
        for _ in range(k % 3):
            w[rnd.choice([0, 1, -1, rnd.randrange(len(w))])] = rnd.choice(words)
        docs.append((k, " ".join(rnd.choices(words, k=rnd.randint(0, 40)) + w + rnd.choices(words, k=rnd.randint(0, 40)))))
    docs += [(100, None), (101, ""), (102, "say one, two three %% four"), (None, items[3][1]), (103, items[0][1]), (103, items[0][1]), (104, items[4][1] + " " + items[4][1])]
    return docs, items


def test_against_brute_force(spark, planted, multiset):
    docs, items = planted
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, number int, item int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = multiset(brute(docs, items))
    assert len(want) > 60 and min(w[2] for w in want) < 0.85
    for block in (32 << 20, 300):
        got = D.contaminated(df, bench, block_bytes=block).collect()
        assert multiset((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got) == want
        clean = D.without_contaminated(df, bench, block_bytes=block)
        assert clean.schema == df.schema
        left = Counter(repr((i, t)) for i, t in docs if not list(brute([(i, t)], items)))
        assert Counter(repr((r["doc_id"], r["text"])) for r in clean.collect()) == left
    at = {(r["doc_id"], r["item_id"]): r for r in got}
    for (i, j), r in at.items():
        if i is not None and j is not None and i < 100:
            w = tokens(dict(docs)[i])[r["first_word"] : r["first_word"] + r["n_words"]]
            assert len(w) == len(tokens(dict(items)[j]))


def test_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert D.contaminated(docs, none).collect() == []
    assert D.contaminated(no_docs, some).collect() == []
    assert D.without_contaminated(docs, none).count() == docs.count()
    assert D.without_contaminated(no_docs, some).collect() == []


def test_blocks_lose_no_near_fingerprint():
    rnd = random.Random(1)
    prints = np.array([rnd.getrandbits(64) for _ in range(40)], dtype=np.uint64)
    for radius in (0, 3, 16, 24):
        index = D.BlockIndex(prints, radius)
        for k, p in enumerate(prints.tolist()):
            for _ in range(20):
                q = p
                for b in rnd.sample(range(64), rnd.randint(0, radius)):
                    q ^= 1 << b
                _, found = index.candidates(np.array([q], dtype=np.uint64))
                assert k in found.tolist()


def test_block_radii():
    assert D.radii(16) == [4, 3, 3, 3] and D.radii(24) == [6, 5, 5, 5] and D.radii(3) == [0, 0, 0, 0]
    for radius in range(3, 40):
        # fingerprints beyond every block's radius differ by more than the whole radius
        assert sum(r + 1 for r in D.radii(radius)) == radius + 1
    assert len(D.masks(4)) == 2517 and len(D.masks(3)) == 697


@pytest.mark.parametrize("n", [50, 6000])  # short lists are gone through, of long ones the near values are looked up
def test_the_index_is_selective_and_right(n):
    rng = np.random.default_rng(2)
    prints, asked = (rng.integers(0, 2**64, k, dtype=np.uint64) for k in (n, 300))
    asked[:20] = prints[:20] ^ np.uint64(0x8000_0100_0010_0001)
    index = D.BlockIndex(prints, 16)
    blocks = asked.view("<u2").reshape(-1, 4)
    passed = {pair for b in range(4) for pair in zip(*(x.tolist() for x in index.looked_up(b, blocks[:, b])), strict=True)}
    assert 0.05 < len(passed) / (n * 300) < 0.075
    w, k = index.candidates(asked)
    want = {(a, b) for a in range(300) for b in np.flatnonzero(np.bitwise_count(asked[a] ^ prints) <= 16).tolist()}
    assert set(zip(w.tolist(), k.tolist(), strict=True)) == want and len(want) >= 20


def test_recall_of_edited_items():
    """Of windows of at least 0.8 the fingerprints find 99 % and more."""
    rnd = random.Random(3)
    found = edited = 0
    for n in (12, 20, 35, 60):
        items = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(n)) for _ in range(60)]
        index = D.Benchmark(items)
        for k, item in enumerate(items):
            for _ in range(4):
                w = item.split(" ")
                for _ in range(rnd.randint(0, 3)):
                    w[rnd.choice([0, 1, -2, -1, rnd.randrange(n)])] = "other"
                a, b = shingles(w), shingles(item.split(" "))
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    edited += 1
                    data = " ".join(w).encode()
                    found += k in {m[1] for m in index.matches(np.frombuffer(data, np.uint8), np.array([0, len(data)]))}
    assert edited > 400 and found >= 0.99 * edited


def test_index_of_many_items_is_a_small_multiple_of_their_text():
    rng = np.random.default_rng(4)
    vocabulary = [f"word{k}" for k in range(5000)]
    items = [" ".join(vocabulary[k] for k in rng.integers(0, 5000, n)) for n in rng.integers(10, 60, 100_000)]
    index = D.Benchmark(items)
    assert index.nbytes() < 5 * sum(map(len, items))
    data = (items[77] + " and " + items[99_999]).encode()
    assert {m[1] for m in index.matches(np.frombuffer(data, np.uint8), np.array([0, len(data)]))} >= {77, 99_999}


def test_equal_hashes_are_told_apart_by_their_bytes(spark, multiset):
    """Words of a regular build have equal polynomial hashes; item and text differ in one such word."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    words = [f"w{k}" for k in range(8)]
    text = lambda w: " ".join([*words[:4], w, *words[4:]])
    docs = [(1, text(one)), (2, text(other)), (3, text("c"))]
    items = [(10, text(one)), (11, text(other))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(df, bench).collect()
    assert multiset((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got) == multiset(brute(docs, items)) and len(got) == 2


def test_very_long_document(spark):
    rnd = random.Random(5)
    item = " ".join(f"w{rnd.randrange(1000)}" for _ in range(30))
    filler = " ".join(f"x{rnd.randrange(1000)}" for _ in range(300_000))
    df = spark.createDataFrame([(1, filler + " " + item + " " + filler), (2, filler), (3, (item + " ") * 2000)], "doc_id long, text string")
    got = D.contaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["similarity"], r["first_word"]) for r in got) == [(1, 1.0, 300_000), (3, 1.0, 0)]


def test_memory_of_a_text_that_is_all_hits():
    """Window starts are listed once each, not once for every hit that they lie over."""
    rnd = random.Random(8)
    item = " ".join(f"w{rnd.randrange(1000)}" for _ in range(400))
    index, data = D.Benchmark([item]), np.frombuffer(((item + " ") * 400).encode(), np.uint8)
    tracemalloc.start()
    found = list(index.matches(data, np.array([0, len(data)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f[:4] for f in found] == [(0, 0, 1.0, 0)]
    assert peak < 100 << 20
