"""Helpers that the operators of this subpackage share.

Nothing here depends on the rest of the library, and nothing else in the
library imports this subpackage.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Only where that is unset and the master
    is local (tests, a notebook) a temporary folder is made and set; executors
    of a cluster could not see it, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="barspark-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_live: list[Scratch] = []


def release_tables() -> None:
    """Delete all tables that operators of this session wrote and results may read.

    For long sessions: call it when no result of this subpackage is needed any more.
    """
    while _live:
        _live.pop()._at_exit()


class Scratch:
    """Tables of one operator run in the shared folder.

    ``table`` writes a DataFrame as Parquet and returns the reread table: the
    lineage is cut, and the files outlive any executor. ``drop`` deletes those
    that the final plan does not read; the others are deleted when the driver
    ends (its session may be stopped by then), or by ``release_tables`` once their results are no longer wanted.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/barspark/{label}-{uuid.uuid4().hex}"
        self._kept: set[str] = set()
        # Hadoop's own handles, which a stopped session leaves usable
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        _live.append(self)
        atexit.register(self._at_exit)

    def path(self, name: str) -> str:
        self._kept.add(name)
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")
            self._kept.discard(name)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*(self._kept - set(names)))

    def _delete(self, path: str) -> None:
        """Delete a folder by Hadoop's file system, so that remote stores work."""
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self._conf).delete(where, True)

    def _at_exit(self) -> None:
        try:
            if self._kept:
                self._delete(self.root)
                self._kept.clear()
        except Exception:  # noqa: BLE001  the JVM may be gone by now
            pass


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than space, tab, LF, VT, FF and CR, as UTF-8.

    ``bytes.split`` splits at exactly those six.
    """
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, twice) over uint64."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(seed & _MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few and not too long texts are Python strings at a time.

    A batch has at most ``rows`` rows and ``most_bytes`` of text, or one row.
    """
    for batch in batches:
        ends = None
        if batch.nbytes > most_bytes:
            texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type)]
            each = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts)
            ends = np.cumsum(each) if texts else None
        at = 0
        while at < batch.num_rows:
            n = rows
            if ends is not None:
                before = ends[at - 1] if at else 0
                n = min(rows, max(1, int(np.searchsorted(ends, before + most_bytes, "right")) - at))
            yield batch.slice(at, n)
            at += n
    release_memory()


@contextmanager
def small_batches(spark: SparkSession, most_bytes: int) -> Iterator[None]:
    """What is written within sends its rows to Python in Arrow batches of about ``most_bytes``, or one row.

    By default Spark fills 10,000 rows or 64 MB, which the JVM and the worker
    hold at once for each task. A smaller setting of the session stays, and the
    session's own is restored afterwards.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    jvm = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    if jvm.byteStringAsBytes(before) > most_bytes:
        spark.conf.set(key, f"{most_bytes}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_memory() -> None:
    """Hand what this task freed back to the system before the worker idles."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


class Memo(dict):
    """A dict that forgets everything once it holds ``most`` entries.

    Bounds what a worker keeps however large the vocabulary grows.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def room(self, new: int) -> None:
        if len(self) + new > self.most:
            self.clear()
