"""Helpers shared by the training-data operators: shared-folder tables and word hashing inside tasks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a worker's word cache may hold before it is emptied.
CACHE_WORDS = 200_000
#: Width of word shingles where no contract says otherwise.
SHINGLE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A temporary one where it is unset in local mode (tests); on a cluster that is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given


#: Folders and tables that this process wrote for its own use, in order.
_WRITTEN: list[str] = []


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts lineage and survives lost executors. `discard` removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, column: str) -> DataFrame:
    """As `stored`, as a table bucketed by a column into spark.sql.shuffle.partitions buckets."""
    spark, name = df.sparkSession, f"{what}_{uuid.uuid4().hex}"
    _WRITTEN.append(name)
    df.write.bucketBy(partitions(spark), column).option("compression", "uncompressed").saveAsTable(name)
    return spark.table(name)


def written() -> int:
    """How much was written so far; `discard` takes it for `since`."""
    return len(_WRITTEN)


def discard(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Remove what `stored` and `bucketed` wrote since then, but for the files of one DataFrame. Results that read it must have been written."""
    kept = {str(Path(f).parent.name) for f in but.inputFiles()} if but is not None else set()
    for what in _WRITTEN[since:]:
        if "/" not in what:
            spark.sql(f"DROP TABLE IF EXISTS {what}")
        elif what.rsplit("/", 1)[1] not in kept:
            path = spark._jvm.org.apache.hadoop.fs.Path(what)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _WRITTEN[since:]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(table: DataFrame, mb: int = 32) -> int:
    """How many tasks a stored table is dealt to: one for each `mb` of its files, spark.sql.shuffle.partitions at least."""
    spark, size = table.sparkSession, 0
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(partitions(spark), -(-size // (mb << 20)))


def crc_mod(key, mod: int):
    """crc32 of the id as text, modulo `mod`."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % mod


_KEPT: dict[str, object] = {}


def kept_in_worker(owner: str, make: Callable[[], object]) -> object:
    """One object per Python worker, for tasks of one operator that follow each other; another operator's is let go."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = make()
    return _KEPT[owner]


def nothing_kept() -> None:
    """Let go of what tasks of another operator kept in this Python worker, and give the memory back, where the C library can: workers stay for the operators that follow."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; emptied when it holds CACHE_WORDS entries."""

    def __init__(self):
        nothing_kept()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a UTF-8 text with A-Z lower-cased; bytes.split() splits at exactly these six."""
    return text.lower().split()


def hashed(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit multipliers that depend on `salt` only."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


def shingles(word_hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """One 64-bit hash per run of `width` words, in text order; with fewer words, one for the whole run; none for none."""
    n = len(word_hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(width, n)
    total = np.full(n - width + 1, width, np.uint64)
    for j, c in enumerate(seeds(width, 7)):
        total += word_hashes[j : n - width + 1 + j] * c
    return mixed(total)


def shingle_set(text: bytes | None, cache: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingles(hashed(words_of(text), cache), width)) if text else np.empty(0, np.uint64)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def row_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Gather row tuples into record batches of `size` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
