"""Scratch tables, byte and word hashing, and bounded work units shared by the operators.

Scratch tables live under the folder that ``spark.checkpoint.dir`` names, which every executor sees.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import scratch, settings, undo

WORD = r"[^\x20\x09-\x0D]+"
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def narrow_reads(spark: SparkSession):
    """For plans that run inside: Parquet readers hold hundreds of texts at a time, not thousands."""
    return settings(spark, spark_sql_parquet_columnarReaderBatchSize="512")


BATCH_BYTES = 4 << 20


def batched(docs: DataFrame) -> DataFrame:
    """``docs``, after the session's Arrow batches are bounded to 4 MB if they weren't already.

    A batch stands in the executor's memory twice, in Java and in Python, for each task at a time.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", docs.sparkSession.conf
    if not re.fullmatch(r"\d+b", held := conf.get(key)) or int(held[:-1]) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return docs


def give_back() -> None:
    """Return freed memory of this Python worker to the system; workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def frugal(work):
    """A function over Arrow batches that gives memory back when its partition ends."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that nothing reads any more."""
    for t in tables:
        undo(t._scratch)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name for ``F.col``, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a column, from one columnar scan."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalising bijection on 64-bit words, in place, so that all bits depend on all bits."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return x


class RangeHash:
    """Hash of any element range of an array from one prefix sum (arithmetic mod 2**64).

    Equal ranges have equal hashes, which is all it is for: it says where ranges meet and which are
    worth a look.  Different ranges of a regular build can have equal hashes whatever the seed, so
    what is equal is decided by ``digests`` or by the bytes themselves.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(2**61, 2**63, dtype=np.uint64)) * 8 % 2**64 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            m = max(n, 1 << 16)
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(m, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums for ``between``; bytes are first replaced by random codes."""
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        out[1:] = self.codes[values] if values.dtype == np.uint8 else values
        out[1:] *= self.up[: len(values)]
        np.cumsum(out[1:], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for arrays of starts and ends."""
        return mixed((prefix[end] - prefix[start]) * self.down[start])

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """Hash of each run of ``size`` values, by its start."""
        n = len(prefix) - size
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mixed((prefix[size:] - prefix[:-size]) * self.down[:n])


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 128 bits of the SHA-256 of each data[start:end], as two columns."""
    out, sha = np.empty((len(starts), 2), dtype="<u8"), hashlib.sha256
    for k in range(0, len(starts), 1 << 16):  # in parts, since each digest is an object at first
        some = zip(starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist(), strict=True)
        raw = b"".join([sha(data[a:b]).digest() for a, b in some])
        out[k : k + (1 << 16)] = np.frombuffer(raw, dtype="<u8").reshape(-1, 4)[:, :2]
    return np.ascontiguousarray(out[:, 0]), np.ascontiguousarray(out[:, 1])


def laid_out(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column laid end to end, and the bounds of its texts (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column, limit: int = 1 << 20):
    """(bytes, bounds, first, last) of runs of an Arrow column's texts with about ``limit`` bytes each.

    Working arrays are many times as large as the text, so batches are worked on in such parts.
    """
    data, bounds = laid_out(column)
    k = 0
    while k < len(column):
        end = max(k + 1, int(np.searchsorted(bounds, bounds[k] + limit, side="right")) - 1)
        yield data[bounds[k] : bounds[end]], bounds[k : end + 1] - bounds[k], k, end
        k = end


def word_ranges(
    data: np.ndarray, doc_starts: np.ndarray, separator: np.ndarray = SEPARATOR
) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words in texts laid end to end; none crosses a text's start."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = ~separator[data]
    first = np.ones(len(data), dtype=bool)
    first[1:] = ~inside[:-1]
    first[doc_starts[doc_starts < len(data)]] = True
    last = np.ones(len(data), dtype=bool)
    last[:-1] = first[1:] | ~inside[1:]
    return np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[bytes, np.ndarray]:
    """The words joined by single spaces, and where each begins in that.

    Where a text's first word follows the last of the text before at once, no space stands between.
    """
    keep = ~separator[data]
    after = ends[ends < len(data)]
    keep[after] = True
    line = data[keep]
    line[separator[line]] = 0x20
    length = ends - starts
    length[: len(after)] += separator[data[after]]
    return line.tobytes(), np.cumsum(length) - length


def word_hashes(
    hasher: RangeHash, data: np.ndarray, doc_starts: np.ndarray, separator: np.ndarray = SEPARATOR, reaches: tuple[int, ...] = (1 << 40,), part: int = 1 << 20
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Byte starts and ends of words, and for each reach the hashes of the words' first so many bytes.

    Words are hashed in parts of about ``part`` bytes, so one very long text needs little more memory.
    """
    starts, ends = word_ranges(data, doc_starts, separator)
    out = [np.empty(len(starts), dtype=np.uint64) for _ in reaches]
    k = 0
    while k < len(starts):
        a = starts[k]
        to = max(k + 1, int(np.searchsorted(ends, a + part, side="right")))
        prefix = hasher.prefix(data[a : ends[to - 1]])
        for column, reach in zip(out, reaches, strict=True):
            column[k:to] = hasher.between(prefix, starts[k:to] - a, np.minimum(starts[k:to] + reach, ends[k:to]) - a)
        k = to
    return starts, ends, out
