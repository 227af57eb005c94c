"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
GOLD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of the column as text, modulo; -1 where it is null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod, F.lit(-1))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a folder of its own only where that is unset and driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints", "doclens")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def released(*tables: DataFrame) -> None:
    """Removes tables that `written` made and nothing reads any more."""
    for df in tables:
        if (name := getattr(df, "written_path", None)) is not None:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def texts(batch: pa.RecordBatch, column: int | str) -> list[str]:
    """The column's strings; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def octets(batch: pa.RecordBatch, column: int | str) -> list[bytes]:
    """The column's strings as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], dict[str, list]], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow with a function from a batch to columns; done is called at the end of a partition."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict(f(batch), schema=arrow)
        if done is not None:
            done()

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """Word (UTF-8 bytes) to its 64-bit hash, computed on first use. Bounded: emptied beyond `most` words, which costs time only."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    h = words[: n - size + 1].copy()
    for i in range(1, size):
        h = mix(h * GOLD + words[i : n - size + 1 + i])
    return mix(h + np.uint64(size))


def runs_of(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    return zip(at.tolist(), [*at[1:].tolist(), len(values)])


def trim() -> None:
    """Hands memory that a worker no longer needs back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value; bytes of equal weight stand together, which compresses well."""
    out = [np.uint32(len(arrays)).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        kind = a.dtype.str.encode()
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        out += [np.array([len(kind), len(a)], np.uint32).tobytes(), kind, planes]
    return _pack.compress(b"".join(out))


def unpacked(value: bytes) -> list[np.ndarray]:
    raw = memoryview(_unpack.decompress(value))
    count, at, out = int(np.frombuffer(raw[:4], np.uint32)[0]), 4, []
    for _ in range(count):
        k, n = (int(x) for x in np.frombuffer(raw[at : at + 8], np.uint32))
        kind = np.dtype(bytes(raw[at + 8 : at + 8 + k]).decode())
        at += 8 + k
        size = n * kind.itemsize
        planes = np.frombuffer(raw[at : at + size], np.uint8).reshape(kind.itemsize, n) if n else np.zeros((kind.itemsize, 0), np.uint8)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += size
    return out
