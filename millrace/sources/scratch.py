"""What a query leaves behind: files in the shared folder of ``spark.checkpoint.dir``, tables, settings.

Results are lazy and read such files when they are used, so the files stay until ``release`` or the
end of a ``workspace``:

    with workspace():
        queries["q"](spark, folder).write.parquet(target)
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_held: dict[str, Callable[[], None]] = {}


def hold(name: str, undo: Callable[[], None]) -> None:
    """Remember how to undo something; a second undo of one name replaces the first."""
    _held[name] = undo


def undo(name: str) -> None:
    """Undo now what ``hold`` remembers under the name, if anything."""
    action = _held.pop(name, None)
    if action:
        action()


def release(but: frozenset[str] = frozenset()) -> None:
    """Undo everything, the last first, but what is named in ``but``."""
    for name in [n for n in reversed(_held) if n not in but]:
        undo(name)


def held() -> frozenset[str]:
    return frozenset(_held)


@contextmanager
def workspace() -> Iterator[None]:
    """What queries leave behind while this is open goes when it closes."""
    before = held()
    try:
        yield
    finally:
        release(before)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the plans that run inside, then the caller's again; underscores stand for dots."""
    names = {key.replace("_", "."): value for key, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path that all executors see; a local one only where Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hold(path, lambda: delete(spark, path))
    return path
