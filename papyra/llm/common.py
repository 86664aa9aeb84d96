"""Pieces that the training-data operators share: tables, stashes, hashing."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these; Python's bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where a local session names none (tests, a laptop) is a temporary one made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    if "dir" not in _own_dir:
        _own_dir["dir"] = tempfile.mkdtemp(prefix="papyra-")
        atexit.register(shutil.rmtree, _own_dir["dir"], ignore_errors=True)
    return "file://" + _own_dir["dir"]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Stash:
    """Intermediate tables in the shared folder.

    put() writes a frame as Parquet and reads it back, which cuts its lineage: a lost
    executor costs no more than the tasks it was running.  A name that no later plan
    reads can be dropped; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/papyra-{label}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")

    def release(self) -> None:
        """Free the shuffle files of plans that have ended.

        Spark deletes a shuffle when the driver's garbage collector meets it, by default
        every half hour; an operator of several big stages cannot wait for that.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _end(self) -> None:
        if self.root.startswith("file:///"):  # the session may be gone before the folder
            shutil.rmtree(self.root.removeprefix("file://"), ignore_errors=True)
            return
        try:
            _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session has gone already
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def buckets(spark: SparkSession) -> int:
    """How many groups packed rows are dealt into: they follow the session's own sizing."""
    return max(32, 2 * shuffle_partitions(spark))


def hash52(text: Column) -> Column:
    """52 bits of md5 (DuckDB can compute the same)."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def doc_hash(col: Column) -> Column:
    """52 bits of md5 of an id's decimal text."""
    return hash52(F.coalesce(col.cast("string"), F.lit("")))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def hash_sample(df: DataFrame, key: Column, rows: int, wanted: int) -> DataFrame:
    """About `wanted` of the `rows` rows of df, those with the least hashes: a filter, so no task gathers them."""
    return df if rows <= wanted else df.where(doc_hash(key) < int(wanted / rows * (1 << 52)))


def byte_lengths(column) -> list[int]:
    """Of an Arrow column of binaries; a null has none."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def slices(lengths, most: int = 4 << 20, rows: int = 4096):
    """Ranges of consecutive rows that hold about `most` bytes, one row at least."""
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and (held + n > most or i - start >= rows):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


@functools.cache
def keep_memory() -> None:
    """Lets this process keep the memory of large arrays for the next ones, where the C library can be told so."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, for the words met so far; bounded, so that memory is too."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


_BLOCKS, _FAN_IN = 64, 128


def popular_hashes(texts: DataFrame, hashes, bits: int, factor: float = 3.0, least: float = 32.0) -> np.ndarray:
    """Packed flags: which values of the first `bits` bits of a hash count several times the mean.

    texts: one binary column; hashes: texts -> their hashes.  All rows are counted.  The
    counters are 2^bits; tasks' counters are added up in a tree, _FAN_IN at a time, so what
    one task gathers, what reaches the driver (a byte each) and what is broadcast (a bit
    each) has a bound that does not grow with the rows.
    """
    import math

    import pyarrow as pa

    size = (1 << bits) // _BLOCKS

    def packed(block: int, counts: np.ndarray):
        import zstandard

        return block, zstandard.ZstdCompressor(level=1).compress(counts.tobytes())

    def count(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            column = batch.column(0)
            for a, b in slices(byte_lengths(column), 1 << 19):  # what fits a core's cache
                found = hashes([x or b"" for x in column[a:b].to_pylist()])
                np.add.at(counts, (found >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        rows = [packed(i, x.astype(np.int64)) for i, x in enumerate(np.split(counts, _BLOCKS))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "counts"])

    def total(t: pa.Table) -> tuple[int, np.ndarray]:
        import zstandard

        out, unpack = np.zeros(size, np.int64), zstandard.ZstdDecompressor()
        for x in t.column("counts").to_pylist():
            out += np.frombuffer(unpack.decompress(x), np.int64)
        return t.column("block")[0].as_py(), out

    def add(t: pa.Table) -> pa.Table:
        block, counts = packed(*total(t))
        return pa.table([pa.array([block], pa.int32()), t.column("part").slice(0, 1).combine_chunks(), pa.array([counts], pa.binary())], ["block", "part", "counts"])

    def end(t: pa.Table) -> pa.Table:
        block, counts = total(t)
        scale = np.minimum(255, np.round(6 * np.log2(1.0 + counts))).astype(np.uint8)
        return pa.table([pa.array([block], pa.int32()), pa.array([int(counts.sum())], pa.int64()), pa.array([scale.tobytes()], pa.binary())], ["block", "total", "scale"])

    sums = texts.mapInArrow(count, "block int, counts binary").withColumn("part", F.spark_partition_id())
    for _ in range(2):
        sums = sums.withColumn("part", F.floor(F.col("part") / _FAN_IN).cast("int")).groupBy("block", "part").applyInArrow(add, "block int, part int, counts binary")
    sums = sums.groupBy("block").applyInArrow(end, "block int, total long, scale binary").collect()
    scale = np.zeros((_BLOCKS, size), np.uint8)
    for r in sums:
        scale[r["block"]] = np.frombuffer(r["scale"], np.uint8)
    mean = sum(r["total"] for r in sums) / (1 << bits)
    return np.packbits(scale.ravel() > 6 * math.log2(1 + max(least, factor * mean)))


def flagged(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes popular_hashes() has flagged."""
    bits = int(len(flags) * 8).bit_length() - 1
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
