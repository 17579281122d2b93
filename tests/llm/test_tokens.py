from __future__ import annotations

import bisect
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing, token_counts, tokenizer

PATH = tokenizer.default_path()
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def counter():
    return tokenizer.TokenCounter(PATH, tokenizer.whole_tokens(PATH))


def test_every_settled_character_agrees(counter):
    for c in map(chr, range(0x110000)):
        if tokenizer.SETTLED.fullmatch(c):
            text = f"a{c}b {c} {c}{c}1{c}\n {c}  x"
            assert tokenizer.encoder(PATH).ids(text) == library_ids(text), hex(ord(c))
            assert counter.count(text) == len(library_ids(text)), hex(ord(c))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'abcdeEsté²½_-—<|>\x1c\x85\xa0 漢"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_random_texts_agree(counter, text):
    assert tokenizer.encoder(PATH).ids(text) == library_ids(text)
    assert counter.count(text) == len(library_ids(text))


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", " <|endoftext|>", "<|endoftext", "it's we'll", "   x", "x   ", "\r\n\r\n"])
def test_special_strings_and_spaces(counter, text):
    assert tokenizer.encoder(PATH).ids(text) == library_ids(text)
    assert counter.count(text) == len(library_ids(text))


def test_parts_encode_as_the_whole():
    rnd = random.Random(3)
    text = "".join(rnd.choice(["a b ", " don't", "\n x", "é ", "  ", "1 2", " ñu", "² b", "<|endoftext|> c"]) for _ in range(400))
    for size in (1, 7, 100):
        cut = list(tokenizer.parts(text, size))
        assert "".join(cut) == text and len(cut) > 3
        assert [i for p in cut for i in tokenizer.encoder(PATH).ids(p)] == library_ids(text)


def test_whole_tokens_are_one_token():
    proven = sorted(tokenizer.whole_tokens(PATH))
    assert len(proven) > 40_000
    for s in random.Random(1).sample(proven, 2000):
        assert len(library_ids(s)) == 1


def test_counts(docs, no_docs, corpus, multiset):
    want = [(i, len((t or "").encode()), len(library_ids(t)), len(library_ids(t)) > 512) for i, t, _ in corpus]
    assert multiset(token_counts.token_counts(docs).collect()) == multiset(want)
    assert token_counts.token_counts(no_docs).collect() == []


def check_packing(rows, texts, capacity):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    ids = {i: [*library_ids(t), 0] for i, t in texts}
    assert set(pieces) == set(ids)
    for i, mine in pieces.items():
        mine.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert all(r["length"] == capacity for r in mine[1:]) and 0 < mine[0]["length"] <= capacity
        at = 0
        for r in mine:
            assert r["start"] == at
            part = ids[i][at : at + r["length"]]
            assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids[i])
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("capacity", [16, 64, 2048])
def test_packing(docs, corpus, capacity):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = [(r["doc_id"], r["text"]) for r in unique.collect()]
    rows = packing.pack(unique, capacity).collect()
    used = check_packing(rows, texts, capacity)
    least = -(-sum(r["length"] for r in rows) // capacity)
    assert used <= 1.15 * least + 2


def test_packing_keeps_repeated_and_null_rows(docs, no_docs, corpus):
    rows = packing.pack(docs).collect()
    assert sum(r["length"] for r in rows) == sum(len(library_ids(t)) + 1 for _, t, _ in corpus)
    assert packing.pack(no_docs).collect() == []


def best_fit_decreasing(lengths, capacity):
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return len(rooms)


def check_plan(runs, histogram, capacity):
    """The number of sequences, after every length is found in one place and no sequence is too long."""
    held, end = Counter(), 0
    for run in sorted(runs, key=lambda r: r.first):
        assert run.count > 0 and 0 < sum(run.lengths) == capacity - run.room <= capacity and run.first == end
        end += run.count
        for n in run.lengths:
            held[n] += run.count
    assert held == Counter({n: k for n, k in histogram.items() if k})
    return end


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300), st.sampled_from([(1,), (4, 16), (32, 64, 128)]))
def test_plans(lengths, groups):
    histogram = Counter(lengths)
    used = check_plan(packing.plan_packing(dict(histogram), 64, groups), histogram, 64)
    fit = best_fit_decreasing(lengths, 64)
    assert used <= 1.2 * fit + 2
    if groups == (32, 64, 128):
        assert used <= fit + 1


@pytest.mark.parametrize(("sf", "least"), [("sf0.001", 96), ("sf0.01", 481), ("sf0.1", 4936)])
def test_no_more_sequences_than_the_volume_needs(sf, least):
    enc, histogram = tokenizer.encoder(PATH), Counter()
    for (text,) in duckdb.sql(f"SELECT text FROM '/root/testdata/{sf}/documents.parquet'").fetchall():
        n = len(enc.ids(text or "")) + 1
        histogram[(n - 1) % 2048 + 1] += 1
        histogram[2048] += (n - 1) // 2048
    assert -(-sum(n * k for n, k in histogram.items()) // 2048) == least
    assert check_plan(packing.plan_packing(dict(histogram), 2048), histogram, 2048) == least
    # a corpus of a million times as many texts takes the same plan, by counts
    many = {n: k * 10**6 for n, k in histogram.items()}
    assert check_plan(packing.plan_packing(many, 2048), many, 2048) <= 1.002 * 10**6 * sum(n * k for n, k in histogram.items()) / 2048


def test_configurations_reach_the_optimum():
    """Sizes that only fit together in one way: 3 with 7, 4 with 6 and 5 with 5 fill all sequences."""
    import numpy as np

    sizes, demand = np.array([7, 6, 5, 4, 3]), np.array([10, 20, 30, 20, 10])
    mixture = packing.configurations(sizes, demand, 10)
    assert sum(times for _, times in mixture) == 45
    assert (sum(np.array(used) * times for used, times in mixture) >= demand).all()
    assert all((used * sizes).sum() <= 10 for used, _ in mixture)


def test_grouping_rounds_up_to_equal_shares():
    histogram = {100: 3, 90: 3, 80: 6, 50: 1}
    sizes, demand = packing.grouped(histogram, [100, 90, 80, 50], 4)
    assert sizes.tolist() == [100, 90, 80, 50] and demand.tolist() == [4, 4, 4, 1]
