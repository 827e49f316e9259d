"""Shared pieces of the training-data operators: session helpers, scratch tables, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = str(4 << 20)  #: rows that a Python worker gets at once; long documents count by their bytes
BROADCAST_ROWS = 250_000  #: a counted table of a few longs a row is broadcast up to so many rows (about 25 MB)
_SHIPPED: set[str] = set()
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, and bound what their Python workers get at once."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) != ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    zipped = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(zipped, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(zipped))
    _SHIPPED.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Without one a single machine uses a folder of its own; a cluster may not."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp()}"
        spark.sparkContext.setCheckpointDir(named)
    return named


def trim(spark: SparkSession) -> bool:
    """Lets the driver's JVM give back what its C library holds free: threads that come and go, compilers' among them,
    leave much of it behind in a long session. False where the JVM has no such command."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        lang = jvm.java.lang
        (invoke,) = (m for m in lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = new(lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        given[2], given[3] = new(lang.Object, 0), new(lang.String, 0)
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared scratch folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    trim(spark)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for dropped(): how many tables stored() has written so far."""
    return len(_WRITTEN)


def dropped(spark: SparkSession, start: int, stop: int) -> None:
    """Deletes the tables that stored() wrote between two marks; nothing may read them any more."""
    for i in range(start, stop):
        if _WRITTEN[i]:
            at = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN[i])
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            _WRITTEN[i] = ""


def settle(spark: SparkSession) -> None:
    """Lets the executors' JVMs collect their garbage and give free heap back to the system, before a step whose memory
    is that of its Python workers: a heap that has grown stays as it is otherwise. Which executors get a task is up to Spark."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).where("done is not null").toArrow()


def held(table_: DataFrame) -> DataFrame:
    """A stored table of a few longs a row, with a broadcast hint if a count shows that it is small."""
    return F.broadcast(table_) if table_.count() <= BROADCAST_ROWS else table_


def batch_words(column) -> list[bytes]:
    """Raw UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


_CLEAR: dict[str, object] = {}
TRIM, MMAP, ARENAS = -1, -3, -8  #: fixed values: options of the C library's mallopt


def claim(owner: str) -> None:
    """Empties the word tables of other operators in this Python worker, which Spark may use for many stages, and gives
    free memory back. From then on arrays of a megabyte or more are mapped on their own, so that they go back too."""
    import pyarrow as pa

    for name, clear in list(_CLEAR.items()):
        if name != owner:
            clear()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has these
        c = ctypes.CDLL(None)
        c.mallopt(MMAP, 1 << 20)
        c.mallopt(TRIM, 1 << 20)
        c.mallopt(ARENAS, 1)
        c.malloc_trim(0)
    if not _POOL:
        pa.set_memory_pool(pa.system_memory_pool())
        _POOL.append(True)


_POOL: list[bool] = []


class HashCache(dict):
    """word -> 64-bit hash; holds at most `limit` words, so its memory is bounded whatever the corpus."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h


WORDS = HashCache()
_CLEAR["words"] = WORDS.clear


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
