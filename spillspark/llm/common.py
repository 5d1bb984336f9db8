"""What the corpus operators share: written intermediate tables and batches.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir`` (the cluster's shared folder). A folder of our own is
chosen only where that setting is missing, as in tests.
"""

from __future__ import annotations

import gc
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space of the word rule: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
SLAB = 1 << 20
#: Share of the heap it may take beyond which the driver collects garbage between jobs.
HEAP_SHARE = 0.5


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it.

    On a cluster the package is installed or shipped with the job, and the
    driver's path does no harm there.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH", ""), root]))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Where none is set a folder of our own is taken in local mode, as in tests;
    on a cluster, whose machines don't see each other's folders, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return base


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    spare(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of what finished jobs leave on the driver.

    Their plans, broadcasts and shuffles are dropped when the driver collects
    garbage, which it would put off until its heap is at the limit; a whole
    collection also hands the heap's unused part back. What the JVM's compilers
    freed stays with the allocator until it is trimmed.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> str | None:
    """Hand freed memory outside the driver's heap back to the system; None where its JVM can't."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    types, args = gateway.new_array(jvm.Class, len(kinds)), gateway.new_array(jvm.Object, len(kinds))
    try:
        for k, kind in enumerate(kinds):
            types[k] = jvm.Class.forName(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, args)
    except Py4JJavaError:
        return None


def spare(spark: SparkSession) -> None:
    """``release`` where the driver's heap has grown beyond ``HEAP_SHARE`` of its limit.

    An operator that plans dozens of jobs makes garbage faster than young
    collections take it, and the heap grows towards its limit although little of it is in use.
    """
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        release(spark)


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct: nothing that is added beside it can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; null counts as empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slabs(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLAB) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``size`` bytes of ``column``.

    A row is never split; a row larger than ``size`` comes alone.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = byte_column(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + size, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads a hash over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


LONG_WORD = 256


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words [start, end) of ``raw``: eight bytes at a time, mixed in turn.

    Words of more than ``LONG_WORD`` bytes go through BLAKE2b.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    out = mix(np.uint64(seed) ^ mix(size.astype(np.uint64)))
    long = np.flatnonzero(size > LONG_WORD)
    key = seed.to_bytes(8, "little")
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8, key=key).digest(), "little")
    # The eight bytes from every place on, and what is kept of them where fewer are left.
    eights = np.ndarray(len(raw) + 1, "<u8", np.r_[raw, np.zeros(8, np.uint8)], strides=(1,))
    kept = np.r_[np.uint64(0), ~np.uint64(0) >> (8 * np.arange(7, -1, -1)).astype(np.uint64)]
    words = np.flatnonzero(size <= LONG_WORD)
    place, left = start[words], size[words]
    while len(words):
        eight = eights[place] & kept[np.minimum(left, 8)]
        out[words] = mix(out[words] * np.uint64(0x9E3779B97F4A7C15) ^ eight)
        more = np.flatnonzero(left > 8)
        words, place, left = words[more], place[more] + 8, left[more] - 8
    return out


def word_bounds(word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each stretch of true values, and offsets per document.

    ``at`` holds the documents' bounds; a stretch ends with its document.
    """
    if not len(word):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    change = np.empty(len(word) + 1, bool)
    np.not_equal(word[1:], word[:-1], out=change[1:-1])
    change[0] = change[-1] = True
    change[at] = True
    place = np.flatnonzero(change)
    start = place[:-1][word[place[:-1]]]
    end = place[1:][word[place[1:] - 1]]
    return start, end, np.searchsorted(start, at)
