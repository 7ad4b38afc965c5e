"""Helpers shared by the training-data operators: shared storage, word hashing in numpy, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass holds at once; a longer single document is a pass of its own.
CHUNK_BYTES = 2_000_000

_MASKS = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


_OWN: dict[str, str] = {}

#: For files of the local file system: Hadoop sets the permissions of each file and of its checksum by starting a process, chmod, from the executor's JVM.
#: Until that process has loaded its program it shares the JVM's memory, so that what adds up processes counts the JVM twice. The plain file system starts none.
_PLAIN = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a temporary folder of this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="eventweave-")
        folder = _OWN[app]
    return folder.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, its lineage ends, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **_PLAIN).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete the files that save() wrote for df, once nothing reads them any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checked(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table of ids as a broadcast side, if it is counted to have at most that many rows; a larger one is joined by a shuffle."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def crc_mod(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def text_chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row count, bytes, offsets): whole documents of about CHUNK_BYTES together. A null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=texts.offset + n + 1)[texts.offset :]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        j = min(j, n)
        yield i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and for each document the index of its first word (n+1 entries)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | cut[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | cut[1:])) + 1
    low = np.zeros(n + 8, dtype=np.uint8)
    np.take(_LOWER, data, out=low[:n])
    view = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=low.data, strides=(1,))
    length = ends - starts
    h = view[starts] & _MASKS[np.minimum(length, 8)]
    h ^= length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mix(h)
    rest = np.flatnonzero(length > 8)
    at = 8
    while len(rest):
        part = view[starts[rest] + at] & _MASKS[np.minimum(length[rest] - at, 8)]
        h[rest] = mix(h[rest] * np.uint64(0xD6E8FEB86659FD93) + part)
        at += 8
        rest = rest[length[rest] > at]
    return h, np.searchsorted(starts, offsets)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as edges (a long, b long): rows (node, component), the component being its smallest node.

    Alternating large-star and small-star rounds: every round moves each edge towards the smallest neighbour, so the
    number of edges never grows and a long chain shrinks by about half in each round. A node of very many edges is
    met by a grouped minimum (combined before the shuffle) and a join that adaptive execution can split; no group is
    ever collected. Every round is written to the shared folder, so lost executors cost one round at most.
    """
    spark = edges.sparkSession
    e = save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges"
    )
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        done = save(small.where("u <> v").distinct(), "cc-edges")
        stars = done.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
        if stars and done.select("v").distinct().join(done.select("u").distinct(), F.col("v") == F.col("u"), "left_semi").limit(1).count() == 0:
            drop_saved(e)
            break
        drop_saved(e)
        e = done
    nodes = done.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(done.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
