"""Texts in bounded chunks, and packed questions about them that pages answer.

A chunk is one row: some megabytes of whole texts, compressed, in order of document id.  Operators
that must compare every window of every text ask *pages* about a chunk's windows: a page is a range
of hashes, a question is a page's share of a chunk's distinct hashes in one packed value, and the
answer is a bit for each of them.  Equal windows of a chunk are combined before they leave it, so a
passage that a third of all texts share reaches its page once a chunk, not once a text.  Questions
and answers are shuffled; texts stay where their chunk was written, since the chunk table is
bucketed by the task that wrote it, in one file a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batched, frugal, give_back, laid_out, narrow_reads, quoted, saved, scratch
from millrace.sources.scratch import delete, hold, settings, undo

CELL_BITS = 28
CHUNK = "part int, chunk long, ids array<long>, lengths array<int>, body binary, notes binary, rest binary"
#: Bits of a chunk's number: its part, the task that wrote it, and which of the task's chunks it is.
TASK_BITS, NTH_BITS = 22, 20


def spark_hash(x: np.ndarray) -> np.ndarray:
    """What Spark's hash() gives for ints: Murmur3 of 32 bits with seed 42."""
    turned = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    h = np.uint32(42) ^ (turned(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
    h = turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return h.view(np.int32)


def even_keys(n: int) -> np.ndarray:
    """For each of n buckets or partitions the least int that Spark puts there by its hash.

    Keys by number would fall together in some buckets and leave others empty.
    """
    out, at, step = np.full(n, -1, dtype=np.int64), 0, max(1024, 4 * n)
    while (out < 0).any():
        numbers = np.arange(at, at + step)
        where, first = np.unique(spark_hash(numbers).astype(np.int64) % n, return_index=True)
        free = out[where] < 0
        out[where[free]] = numbers[first[free]]
        at += step
    return out


class ChunkTable:
    """Whole texts in chunks of about ``chunk_bytes``; one longer text is a chunk of its own.

    A task's chunks go to buckets of about ``bucket_bytes``, each to its own, so that later tasks
    are of even size.  Chunks and pages grow with the input, within bounds, so that a chunk's
    question to a page still holds several hashes when there are very many of both: 0.5 to 16 MB of
    text, and up to eight times an operator's usual number of hashes a page.

    ``note(data, bounds)`` may add a packed value that later passes read instead of working it out
    again.  With ``carry`` the other columns of ``docs`` travel with their texts.  Ids are longs.
    """

    def __init__(
        self, docs: DataFrame, note: Callable | None = None, carry: bool = False, chunk_bytes: int | None = None, bucket_bytes: int = 32 << 20,
        id_column: str = "doc_id", text_column: str = "text",
    ):
        self.spark = docs.sparkSession
        if docs.schema[id_column].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
            raise ValueError(f"{id_column!r} must be an integer column")
        sizes = docs.select(F.octet_length(F.col(quoted(text_column))).alias("n"), F.spark_partition_id().alias("task")).agg(F.sum("n"), F.max("task"))
        with narrow_reads(self.spark):
            sizes = sizes.first()
        self.total, tasks = int(sizes[0] or 0), int(sizes[1] or 0) + 1
        chunk_bytes = chunk_bytes or int(np.clip(self.total >> 15, 1 << 19, 16 << 20))
        each = max(1, -(-self.total // (tasks * bucket_bytes)))  # buckets for every task
        self.buckets = min(tasks * each, 100_000)  # Spark's limit; beyond it several share a bucket
        share, keys = max(1, -(-self.total // (tasks * each))), even_keys(self.buckets)
        self.path, self.name = scratch(self.spark, "chunks"), f"millrace_chunks_{uuid.uuid4().hex}"

        def gather(batches):
            task, nth, held, size, before = TaskContext.get().partitionId(), 0, [], 0, 0

            def row():
                part = int(keys[(task * each + before // share % each) % len(keys)])
                return packed(part, (((part << TASK_BITS) + task) << NTH_BITS) + nth, held, note)

            for batch in batches:
                batch_bounds = laid_out(batch.column(1))[1]
                at = 0
                while at < batch.num_rows:
                    room = max(1, chunk_bytes - size)
                    to = max(at + 1, int(np.searchsorted(batch_bounds, batch_bounds[at] + room, side="right")) - 1)
                    held.append(batch.slice(at, to - at))
                    size += int(batch_bounds[to] - batch_bounds[at])
                    at = to
                    if size >= chunk_bytes or at < batch.num_rows:
                        yield row()
                        nth, held, before, size = nth + 1, [], before + size, 0
            if held:
                yield row()

        others = [c for c in docs.columns if c != text_column] if carry else []
        rest = [F.col(quoted(c)).alias(f"rest{k}") for k, c in enumerate(others)]
        frame = batched(docs).select(F.col(quoted(id_column)).cast("long").alias("id"), F.col(quoted(text_column)).alias("text"), *rest)
        writer = frame.mapInArrow(frugal(gather), CHUNK).write.bucketBy(self.buckets, "part").option("path", self.path)
        hold(self.name, self._gone)
        # bodies are compressed already, and large values should not pass a codec's buffers again; a row
        # group is what a task holds at once, writing and reading
        options = {"compression": "uncompressed", "parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4}
        with narrow_reads(self.spark):
            writer.format("parquet").options(**options).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def pages(self, items: int, page_items: int) -> int:
        """Pages for so many hashes, ``page_items`` or, of very many, up to eight times as many on each."""
        return max(1, -(-items // int(np.clip(items >> 12, page_items, 8 * page_items))))

    def answered(self, answers: DataFrame) -> DataFrame:
        """The chunks with their answers (page, blob); only the answers move."""
        return self.joined(answers, F.struct("page", "blob"), "answers", "left")

    def joined(self, rows: DataFrame, value, name: str, how: str) -> DataFrame:
        """The chunks with a list of the values that ``rows`` have for each; for plans that ``saved`` runs."""
        part = F.shiftright("chunk", TASK_BITS + NTH_BITS).cast("int").alias("part")
        moved = rows.select(part, "chunk", value.alias(name)).repartition(self.buckets, "part")
        return self.rows().join(moved.groupBy("part", "chunk").agg(F.collect_list(name).alias(name)), ["part", "chunk"], how)

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        """``saved``, with joins by part and chunk resting on the buckets by part alone."""
        with settings(self.spark, spark_sql_requireAllClusterKeysForCoPartition="false"):
            return saved(df, name)

    def _gone(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            delete(self.spark, self.path)

    def drop(self) -> None:
        undo(self.name)
        undo(self.path)


def packed(part: int, chunk: int, held: list[pa.RecordBatch], note: Callable | None) -> pa.RecordBatch:
    rows = pa.concat_batches(held)
    rows = rows.take(pc.sort_indices(rows.column(0), null_placement="at_end"))
    data, bounds = laid_out(rows.column(1))
    body = zstandard.ZstdCompressor(level=1).compress(data.tobytes())
    ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(0))
    absent = rows.column(1).is_null().to_numpy(zero_copy_only=False)  # a null text has length -1
    lengths = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.array(np.where(absent, -1, np.diff(bounds)).astype(np.int32)))
    notes = pa.array([note(data, bounds) if note else None], pa.binary())
    rest = None
    if rows.num_columns > 2:
        others = pa.RecordBatch.from_arrays(rows.columns[2:], rows.schema.names[2:])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, others.schema) as stream:
            stream.write_batch(others)
        rest = sink.getvalue().to_pybytes()
    names = ["part", "chunk", "ids", "lengths", "body", "notes", "rest"]
    arrays = [pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), ids, lengths, pa.array([body], pa.binary()), notes, pa.array([rest], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names)


class Chunk:
    """One chunk row: document ids, bytes laid end to end, bounds of the texts, which are null, notes, answers by page, other columns."""

    def __init__(self, chunk, ids: pa.Array, data: np.ndarray, bounds: np.ndarray, absent: np.ndarray, notes: bytes | None, answers: dict[int, bytes], rest: bytes | None):
        self.chunk, self.ids, self.data, self.bounds, self.absent = chunk, ids, data, bounds, absent
        self.notes, self.answers, self._rest = notes, answers, rest

    @property
    def rest(self) -> pa.RecordBatch:
        with pa.ipc.open_stream(self._rest) as stream:
            return stream.read_next_batch()


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        names = batch.schema.names
        for k in range(batch.num_rows):
            ids = batch.column(names.index("ids"))[k].values
            lengths = batch.column(names.index("lengths"))[k].values.to_numpy()
            body = batch.column(names.index("body"))[k].as_py()
            bounds = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0), dtype=np.int64)])
            raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=int(bounds[-1])) if bounds[-1] else b""
            answers = batch.column(names.index("answers"))[k].as_py() if "answers" in names else None
            answered = {a["page"]: a["blob"] for a in answers or ()}
            chunk, notes, rest = (batch.column(names.index(c))[k].as_py() for c in ("chunk", "notes", "rest"))
            yield Chunk(chunk, ids, np.frombuffer(raw, dtype=np.uint8), bounds, lengths < 0, notes, answered, rest)


def located(hashes: np.ndarray, pages: int) -> np.ndarray:
    """The page and the cell in it of each hash, as one sortable number."""
    page = (hashes >> np.uint64(CELL_BITS)) % np.uint64(pages)
    return (page << np.uint64(CELL_BITS)) | (hashes & np.uint64((1 << CELL_BITS) - 1))


def page_of(cells: np.ndarray) -> np.ndarray:
    """The pages of ``located`` numbers."""
    return (cells >> np.uint64(CELL_BITS)).astype(np.int64)


def ranged(hashes: np.ndarray, pages: int) -> np.ndarray:
    """Pages as ranges of the hashes' upper half, so that sorted hashes lie page by page."""
    return (((hashes >> np.uint64(32)) * np.uint64(pages)) >> np.uint64(32)).astype(np.int64)


def by_page(page: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(page, start, end) of the stretches of sorted page numbers."""
    if len(page):
        starts = np.concatenate([[0], np.flatnonzero(np.diff(page)) + 1, [len(page)]])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield int(page[a]), a, b


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one compressed value; the first is sorted and stored as steps."""
    parts = [len(columns[0]).to_bytes(4, "little")]
    for k, c in enumerate(columns):
        if c.dtype == bool:
            parts.append(np.packbits(c).tobytes())
            continue
        if k == 0:
            c = np.diff(c, prepend=c.dtype.type(0))
        # planes of equal bytes compress where whole numbers do not
        parts.append(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for k, kind in enumerate(kinds):
        kind = np.dtype(kind)
        if kind == bool:
            size = -(-n // 8)
            out.append(np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n).astype(bool))
        else:
            size = n * kind.itemsize
            c = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n).T).view(kind).ravel()
            out.append(np.cumsum(c, dtype=kind) if k == 0 else c)
        at += size
    return out


#: Tasks that answer, at most; each works on its pages one after the other.
MOST_TASKS = 1 << 15


def replies(chunks: DataFrame, question: Callable, pages: int, reply: Callable) -> DataFrame:
    """Rows (page, chunk, blob): what pages answer to what chunks ask.

    ``question`` yields (page, blob) for one opened chunk, and ``reply`` gives a blob or None for
    each of one page's blobs.  There are as many tasks as pages, up to ``MOST_TASKS``, and each page
    has its own: a page is bounded work, and small questions can be long work.
    """
    slots = even_keys(min(pages, MOST_TASKS))

    def put(batches):
        for chunk in opened(batches):
            got = list(question(chunk))
            if got:
                asked, blobs = zip(*got, strict=True)
                arrays = [pa.array(slots[np.array(asked) % len(slots)], pa.int32()), pa.array(asked, pa.int32()), pa.array([chunk.chunk] * len(got), pa.int64()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["slot", "page", "chunk", "blob"])

    def decide(key, rows):
        rows = rows.combine_chunks()
        asking = rows.column("chunk").to_pylist()
        blobs = reply(asking, rows.column("blob").to_pylist())
        keep = [k for k, b in enumerate(blobs) if b is not None]
        give_back()
        return pa.table({
            "page": pa.array([key[1].as_py()] * len(keep), pa.int32()),
            "chunk": pa.array([asking[k] for k in keep], pa.int64()),
            "blob": pa.array([blobs[k] for k in keep], pa.binary()),
        })

    asked = chunks.mapInArrow(frugal(put), "slot int, page int, chunk long, blob binary")
    return asked.repartition(len(slots), "slot").groupBy("slot", "page").applyInArrow(decide, "page int, chunk long, blob binary")


def planes(*flags: np.ndarray) -> bytes | None:
    """Flags of equal length as one answer, or none if all are unset."""
    return b"".join(np.packbits(f).tobytes() for f in flags) if any(f.any() for f in flags) else None


def bits(answers: dict[int, bytes], pages: np.ndarray, plane: int = 0, first_page: int = 0) -> np.ndarray:
    """The answered bit of each of a chunk's sorted distinct items, by their pages (no answer: 0)."""
    out = np.zeros(len(pages), dtype=bool)
    for page, a, b in by_page(pages):
        if first_page + page in answers:
            size = -(-(b - a) // 8)
            raw = np.frombuffer(answers[first_page + page], np.uint8, size, plane * size)
            out[a:b] = np.unpackbits(raw, count=b - a).astype(bool)
    return out


def numbered(passes: list[DataFrame]) -> DataFrame:
    """Several passes' answers in one table; ``sorted_out`` tells them apart again."""
    n = len(passes)
    return reduce(DataFrame.union, (p.selectExpr(f"page * {n} + {k} as page", "chunk", "blob") for k, p in enumerate(passes)))


def sorted_out(answers: dict[int, bytes], n: int) -> list[dict[int, bytes]]:
    return [{p // n: b for p, b in answers.items() if p % n == k} for k in range(n)]


def with_text(columns: list[str], chunk: Chunk, texts: list[str], text_column: str) -> pa.RecordBatch:
    """Rows with other texts, but for null ones, from a chunk that carries the other columns."""
    at, others = columns.index(text_column), list(chunk.rest.columns) if len(columns) > 1 else []
    return pa.RecordBatch.from_arrays([*others[:at], pa.array(texts, pa.string(), mask=chunk.absent), *others[at:]], columns)
