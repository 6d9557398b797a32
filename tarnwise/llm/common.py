"""What the text operators share: tables in the shared folder, bitmaps of bounded size, vectorised word hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Bytes of text that one vectorised step holds; longer texts are cut at white space.
SLICE = 1 << 20


#: Bytes of an Arrow batch between the JVM and a Python worker, whatever the rows' width.
BATCH_BYTES = 8 << 20
#: Python workers keep little of what they have freed, and one thread each.
LEAN = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "1000000", "OPENBLAS_NUM_THREADS": "1"}


def ship(spark: SparkSession) -> None:
    """Let Python workers that start later import this package where it is not installed, and bound the batches they get."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    for name, value in LEAN.items():
        env.setdefault(name, value)
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def whole_number(df: DataFrame, *names: str) -> None:
    """Ids are compared as longs: a checked precondition of the operators that say so."""
    kinds = dict(df.dtypes)
    for name in names:
        if kinds[name] not in ("tinyint", "smallint", "int", "bigint", "void"):
            raise TypeError(f"{name} is {kinds[name]}; this operator takes whole numbers as ids, so number the rows first")


_HELD: dict[str, object] = {}


def trim() -> None:
    """Gives memory that this process no longer uses back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def claim(key: str) -> None:
    """Drops what held() keeps under another key."""
    if _HELD and key not in _HELD:
        _HELD.clear()
        _POW.clear()
        gc.collect()
        trim()


def lean(key: str) -> Callable[[Callable], Callable]:
    """A mapInArrow function that begins without other operators' tables and gives its memory back at the end of a task."""

    def wrap(run: Callable) -> Callable:
        @functools.wraps(run)
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim(key)
            yield from run(batches)
            trim()

        return task

    return wrap


def held(key: str, make: Callable[[], object]) -> object:
    """make(), kept in this process until another key is claimed: a worker lives through many stages, and holds the tables of one."""
    claim(key)
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Unset, a folder of this machine will do in local mode only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file:///tmp/checkpoints"
    return f"{top.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bitmap(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """One-hash Bloom filter of a long column as 2**bits bits; whatever df holds, 2**bits / 64 rows reach the driver at most."""
    slot = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    rows = (
        df.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}), {64 - bits}) & 63 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return out.view(np.uint64)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxhash64_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """What Spark's xxhash64() gives for a long column, as uint64."""
    with np.errstate(over="ignore"):
        rot = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
        h = np.uint64(seed) + _P5 + np.uint64(8)
        h = rot(h ^ (rot(x.astype(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def in_bitmap(words: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which longs the bitmap() may hold."""
    slot = xxhash64_long(x.view(np.uint64) if x.dtype != np.uint64 else x) >> np.uint64(64 - (len(words) * 64).bit_length() + 1)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        m = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up, down = np.ones(m, np.uint64), np.ones(m, np.uint64)
            up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
            _POW[:] = [np.cumprod(up), np.cumprod(down)]
    return _POW[0], _POW[1]


#: A-Z to a-z, white space \x09-\x0D to a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def cut(data: bytes, most: int = SLICE) -> Iterator[bytes]:
    """data, with no white space but spaces, in parts of about `most` bytes that end at a space; one word is never cut."""
    at = 0
    while len(data) - at > most:
        to = data.rfind(b" ", at, at + most)
        to = data.find(b" ", at + most) if to < 0 else to
        if to < 0:
            break
        yield data[at : to + 1]
        at = to + 1
    yield data[at:]


def words_in(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of data between spaces. A hash depends on the word's bytes alone."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ink = np.empty(len(a) + 2, np.int8)
    ink[0] = ink[-1] = 0
    ink[1:-1] = a != 32
    step = np.diff(ink)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _powers(len(a) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(a) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
        return start, end, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def slices(texts: list[bytes], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `most` bytes, or one long text."""
    at, size = 0, 0
    for k, x in enumerate(texts):
        if size and size + len(x) > most:
            yield at, k
            at, size = k, 0
        size += len(x) + 1
    if at < len(texts):
        yield at, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes and the lengths in bytes of the words of all texts, one after another, and the number of words of each text."""
    parts, sizes, counts = [], [], np.zeros(len(texts), np.int64)
    for lo, hi in slices(texts):
        if hi - lo == 1:
            for part in cut(texts[lo]):
                start, end, h = words_in(part)
                parts.append(h)
                sizes.append(end - start)
                counts[lo] += len(h)
            continue
        start, end, h = words_in(b" ".join(texts[lo:hi]))
        ends = np.cumsum([len(x) + 1 for x in texts[lo:hi]])
        counts[lo:hi] = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
        parts.append(h)
        sizes.append(end - start)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([none[0], *parts]), np.concatenate([none[1], *sizes]), counts
