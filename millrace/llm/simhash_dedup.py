"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import ChunkTable, opened, with_text
from millrace.llm.common import SEPARATOR, batched, frugal, saved, word_ranges
from millrace.llm.graph import components

#: The positions 1 to 63 of the perfect binary Hamming code of length 63, as bits of a fingerprint.
POSITIONS = np.arange(1, 64, dtype=np.uint64)
LOWER = np.frombuffer(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)), dtype=np.uint8)


def fingerprint(text: str | bytes | None, size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text's word shingles, repeats included."""
    raw = text.encode() if isinstance(text, str) else text or b""
    data = LOWER[np.frombuffer(raw, dtype=np.uint8)]
    starts, ends = word_ranges(data, np.zeros(0, dtype=np.int64))
    if not len(starts):
        return 0
    # words joined by single spaces: keep each word and one separator after it
    keep = ~SEPARATOR[data]
    keep[ends[:-1]] = True
    line = data[keep]
    line[SEPARATOR[line]] = 0x20
    line = line.tobytes()
    lengths = ends - starts + 1
    end = np.cumsum(lengths) - 1
    size = min(size, len(starts))
    first, last = (end - lengths + 1)[: len(starts) - size + 1], end[size - 1 :]
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(first), 1 << 16):
        some = zip(first[k : k + (1 << 16)].tolist(), last[k : k + (1 << 16)].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(line[a:b], seed) for a, b in some], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(first), bitorder="little").view("<u8")[0])


def anchors(fingerprints: np.ndarray) -> np.ndarray:
    """Every code word within two bits of each fingerprint's lower 63, in a (n, 32) array.

    The code is perfect with covering radius 1.  Two fingerprints within two bits have a point
    within one of both, and the code word nearest to that point is within two of both; so linked
    fingerprints share an anchor, and a radius of (covering radius + half the threshold) does for
    both sides what (covering radius + threshold) does for one.  The syndrome of a point is the xor
    of the positions of its set bits: flipping positions i and j with i ^ j equal to it gives a code
    word.  A code word has no other within two bits and fills its row with itself.
    """
    x = fingerprints.astype(np.uint64) & np.uint64(2**63 - 1)
    bits = (x[:, None] >> (POSITIONS - np.uint64(1))) & np.uint64(1)
    syndrome = np.bitwise_xor.reduce(bits * POSITIONS, axis=1)
    flip = lambda p: np.where(p > 0, np.uint64(1) << (np.maximum(p, 1).astype(np.uint64) - np.uint64(1)), np.uint64(0))
    pair = POSITIONS[None, :] ^ syndrome[:, None]
    # each pair once, and the single flip of the syndrome itself, whose partner is 0
    once = (pair < POSITIONS[None, :]) & (syndrome[:, None] > 0)
    out = np.repeat(x[:, None], 32, axis=1)
    rows, columns = np.nonzero(once)
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    out[rows, nth] ^= flip(POSITIONS[columns]) ^ flip(pair[rows, columns])
    return out


def spanning_links(points: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A forest that joins the points of one anchor exactly as their links do."""
    label, links = np.arange(len(points)), []
    for k in range(len(points) - 1):
        near = np.flatnonzero(np.bitwise_count(points[k + 1 :] ^ points[k]) <= distance) + k + 1
        for j in near[label[near] != label[k]].tolist():
            if label[j] != label[k]:
                links.append((k, j))
                label[label == label[j]] = label[k]
    return links


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, fingerprint as long), one for each input row."""

    def mark(batches):
        for batch in batches:
            f = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f)], ["id", "fingerprint"])

    kind = docs.schema[id_column].dataType.simpleString()
    return batched(docs).select(F.col(id_column).alias("id"), text_column).mapInArrow(frugal(mark), f"id {kind}, fingerprint long")


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (u, v) between distinct fingerprints, which connect what the links within ``distance`` connect.

    Only distinct fingerprints are replicated, each to at most 32 anchors; an anchor can hold
    2 * (1 + 63 + 63 * 62 / 2) of them and no more, so its comparison has a fixed bound.
    """
    if distance > 2:
        raise ValueError("this code covers a distance of 2 at most")

    def replicate(batches):
        for batch in batches:
            f = batch.column(0).to_numpy()
            found = anchors(f.view(np.uint64)).view(np.int64)
            code = np.broadcast_to(found[:, :1], found.shape)
            keep = np.ones(found.shape, dtype=bool)
            keep[:, 1:] = found[:, 1:] != code[:, 1:]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(f, keep.sum(axis=1))), pa.array(found[keep])], ["fingerprint", "anchor"])

    def compare(batches):
        for batch in batches:
            held, starts = batch.column(0).flatten().to_numpy(), batch.column(0).offsets.to_numpy() - batch.column(0).offsets[0].as_py()
            sizes = np.diff(starts)
            pairs = starts[:-1][sizes == 2]
            close = pairs[np.bitwise_count((held[pairs] ^ held[pairs + 1]).view(np.uint64)) <= distance]
            u, v = [held[close]], [held[close + 1]]
            for k in np.flatnonzero(sizes > 2).tolist():
                points = held[starts[k] : starts[k + 1]]
                if forest := spanning_links(points.view(np.uint64), distance):
                    a, b = np.array(forest).T
                    u.append(points[a])
                    v.append(points[b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    placed = distinct.select("fingerprint").mapInArrow(frugal(replicate), "fingerprint long, anchor long")
    met = placed.groupBy("anchor").agg(F.collect_list("fingerprint").alias("held")).where(F.size("held") > 1)
    return met.select("held").mapInArrow(frugal(compare), "u long, v long").distinct()


def labelled(marked: DataFrame, distance: int) -> DataFrame:
    """Rows (fingerprint, label): equal labels for fingerprints that links connect."""
    distinct = saved(marked.select("fingerprint").distinct(), "distinct")
    joined = components(links(distinct, distance)).withColumnRenamed("node", "fingerprint")
    return distinct.join(joined, "fingerprint", "left").select("fingerprint", F.coalesce("label", "fingerprint").alias("label"))


def near_duplicates(docs: DataFrame, distance: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, fingerprint, component_id), one for each input row, whole texts.

    Component ids are the smallest id reachable over links, null only where all ids reachable are
    null.  Null, empty and wordless texts have fingerprint zero, which links like any other; a text
    below three words is one shingle; equal rows stay apart under one component; an empty table
    gives no rows and other columns are ignored.
    """
    marked = saved(fingerprints(docs, id_column, text_column), "fingerprints")
    labels = saved(labelled(marked, distance), "labels")
    # ids are combined by fingerprint, then by label, before rows meet: a fingerprint that a third of
    # the rows share is one row here
    least = marked.groupBy("fingerprint").agg(F.min("id").alias("least"))
    least = labels.join(least, "fingerprint").groupBy("label").agg(F.min("least").alias("component_id"))
    of = labels.join(least, "label").select("fingerprint", "component_id")
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return marked.join(of, "fingerprint").select(F.col("id").alias(id_column), hexed, "component_id")


def one_of_each(docs: DataFrame, distance: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The row with the smallest id of each component, all columns; of equal ids any one, nulls last.

    Rows are told apart by their place in a chunk table, so repeated ids and rows are no matter, and
    only fingerprints and places are shuffled, no texts.
    """

    def note(data, bounds):
        return np.array([fingerprint(data[a:b].tobytes()) for a, b in pairwise(bounds.tolist())], dtype=np.uint64).tobytes()

    chunks = ChunkTable(docs, note, carry=True, id_column=id_column, text_column=text_column)

    def listed(batches):
        for batch in batches:
            for chunk, ids, notes in zip(*batch.columns, strict=True):
                n = len(ids.values)
                arrays = [pa.array([chunk.as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), ids.values, pa.array(np.frombuffer(notes.as_py(), dtype=np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["chunk", "place", "id", "fingerprint"])

    places = chunks.rows().select("chunk", "ids", "notes").mapInArrow(frugal(listed), "chunk long, place int, id long, fingerprint long")
    marked = saved(places, "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "chunk", "place")).alias("first")
    by_print = marked.groupBy("fingerprint").agg(first)
    least = labelled(marked, distance).join(by_print, "fingerprint").groupBy("label").agg(F.min("first").alias("first"))
    columns = docs.columns

    def pick(batches):
        for batch in batches:
            for c, kept in zip(opened([batch]), batch.column("places"), strict=True):
                texts = [c.data[a:b].tobytes().decode() for a, b in pairwise(c.bounds.tolist())]
                yield with_text(columns, c, texts, text_column).take(kept.values.take(pc.sort_indices(kept.values)))

    met = chunks.joined(least.select("first.chunk", "first.place"), F.col("place"), "places", "inner")
    try:
        return chunks.saved(met.mapInArrow(frugal(pick), docs.schema), "one-of-each")
    finally:
        chunks.drop()
