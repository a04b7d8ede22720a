"""Shared pieces of the training-data operators: table access, shared scratch tables, byte kernels.

The byte kernels work on one flat ``uint8`` buffer of many texts, so a Python worker touches a text a
constant number of times whatever its length; ``slices`` bounds the buffer a worker holds at once.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Text bytes that a Python worker handles at once (a longer single text is handled alone).
SLICE_BYTES = 1 << 19
_M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Arrow batches of a bounded size, and workers that can import this package."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    env = spark.sparkContext.environment
    if ROOT not in (env.get("PYTHONPATH", "") + ":" + os.environ.get("PYTHONPATH", "")).split(":"):
        env["PYTHONPATH"] = ROOT + (":" + env["PYTHONPATH"] if env.get("PYTHONPATH") else "")


def scratch(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode (tests)."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    if not top:
        top = os.path.join(tempfile.gettempdir(), "bitempo-checkpoints")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/bitempo-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str = "t") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables written by ``keep`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def slices(lengths: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths add up to about ``most`` (one row at least)."""
    ends = np.cumsum(lengths, dtype=np.int64)
    i, n, base = 0, len(lengths), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield i, j
        base, i = int(ends[j - 1]), j


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]] if len(off) else buf, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial hash modulo 2**64 over a buffer: the hash of any span in constant time.

    Byte values go through a random table first. Spans hash alike iff equal, up to 64-bit collisions.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, buf: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        codes = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        n = len(buf) + 1
        if seed not in self._powers or len(self._powers[seed][0]) < n:
            size = max(n, SLICE_BYTES + 1024)
            self._powers[seed] = (_powers(base, size), _powers(pow(base, -1, 1 << 64), size))
        self.up, self.down = (p[:n] for p in self._powers[seed])
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(codes[buf] * self.up[: n - 1], out=self.sums[1:])
        if n > SLICE_BYTES + 1024:
            del self._powers[seed]  # the tables of one very long text are not kept

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(pow(base, done, 1 << 64))
        done += k
    return out


def tidy() -> None:
    """Give freed memory back at the end of a task: idle workers stay beside the executor's heap."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidily(run):
    """A worker function that tidies up after its last batch."""

    def tidied(batches):
        yield from run(batches)
        tidy()

    return tidied


def rows(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tokens(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the maximal runs of bytes for which the table ``inside`` holds, text by text."""
    own = inside[buf]
    if not own.any():
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(buf), bool)
    before[1:] = own[:-1]
    start = np.flatnonzero(own & (~before | edge[:-1]))
    after = np.zeros(len(buf), bool)
    after[:-1] = own[1:]
    end = np.flatnonzero(own & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def grams(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first word) of every run of ``k`` words within a text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    return mix(h[at]), at


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of what is no longer referenced (tables written by ``keep`` stay)."""
    import gc
    import time

    for _ in range(2):  # Python's references go first, and only then the JVM's
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()


def connected(links: DataFrame) -> DataFrame:
    """(doc_id, label) of every end of a link: label is the smallest id that links reach.

    A round takes the least label beside each document, hands it to the document's own label as well (so that whole
    trees of labels join, not only their edges), and looks labels up for themselves. Labels only fall and rounds go
    on until none does; a chain of 100,000 links needs about 20.
    """
    from pyspark.sql import functions as F

    both = keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = keep(both.groupBy("a").agg(F.min("b").alias("n")).select(F.col("a").alias("doc_id"), F.least("a", "n").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.doc_id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.doc_id == near.a).select("doc_id", "label", F.least("label", "near").alias("low"))
        hooks = step.groupBy(F.col("label").alias("root")).agg(F.min("low").alias("hook"))
        step = step.join(hooks, step.doc_id == hooks.root, "left").select("doc_id", "label", F.least("low", "hook").alias("low"))
        up = labels.select(F.col("doc_id").alias("low"), F.col("label").alias("up"))
        step = keep(step.join(up, "low").select("doc_id", F.col("label").alias("old"), F.col("up").alias("label")), "step")
        changed = step.where("old <> label").limit(1).count()
        labels = step.select("doc_id", "label")
        if not changed:
            return labels
