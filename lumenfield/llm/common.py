"""What the text operators share: reading tables, tables in the shared folder, and packed exchanges.

A packed exchange moves arrays, not rows: a map task groups what it has for a bucket into one
zstd-compressed payload, Spark shuffles ``(bucket, kind, payload)`` rows, and the task that owns a
bucket unpacks all of them. All of it is ordinary DataFrame work, so a lost executor costs a rerun of
its tasks and nothing else.
"""

from __future__ import annotations

import contextlib
import ctypes
import io
import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenfield.session import checkpointed, shared_dir, ship  # noqa: F401

#: Schema of a packed exchange.
PACKED = "bucket int, kind int, payload binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows, as one text may be long; and the package where they are handled."""
    ship(spark)
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame) -> DataFrame:
    """df as a zstd parquet table in the shared folder, which goes with free() or when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: all that was made of them must be stored itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def joined(many: DataFrame, one: DataFrame, key: str, total: int, most: int = 10_000) -> DataFrame:
    """many joined with one, which has each key once and in n the number of its rows in many, of total rows in all.

    Keys of more than a ``most``-th of all rows are fewer than ``most``: they are broadcast, so none is one task's.
    """
    line = max(1000, total // most)
    hot = F.broadcast(one.where(F.col("n") > line))  # fewer than most rows, as all have more than total / most
    rest = many.join(hot.select(key), key, "left_anti").join(one.where(F.col("n") <= line), key)
    return many.join(hot, key).unionByName(rest).drop("n")


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed payload."""
    out = io.BytesIO()
    for name, a in sorted(arrays.items()):
        a = np.ascontiguousarray(a)
        head = f"{name} {a.dtype.str} {a.nbytes}\n".encode()
        out.write(head)
        out.write(a.tobytes())
    raw = out.getvalue()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(payload: bytes) -> dict[str, np.ndarray]:
    raw = pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), codec="zstd", asbytes=True)
    out, at = {}, 0
    while at < len(raw):
        end = raw.index(b"\n", at)
        name, kind, size = raw[at:end].decode().split(" ")
        out[name] = np.frombuffer(raw, np.dtype(kind), int(size) // np.dtype(kind).itemsize, end + 1)
        at = end + 1 + int(size)
    return out


def packed_rows(rows: Iterable[tuple[int, int, bytes]], batch: int = 64) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(itertools.islice(rows, batch)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), PACKED_ARROW.types, strict=True)], schema=PACKED_ARROW)


def split_by(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) for each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b] : cuts[b + 1]]


def exchanged(df: DataFrame, n: int) -> DataFrame:
    """Each bucket's rows next to each other in one partition."""
    return df.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")


def by_bucket(f: Callable[[int, list[tuple[int, bytes]]], Iterable]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """A mapInArrow function that calls f with each bucket's (kind, payload) list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator:
        rows = ((b, k, p) for x in batches for b, k, p in zip(*(x.column(i).to_pylist() for i in range(3)), strict=True))
        for bucket, group in itertools.groupby(rows, key=lambda r: r[0]):
            yield from f(bucket, [(k, p) for _, k, p in group])
            release()

    return run


def release() -> None:
    """Give freed memory back to the system, which else stays with a worker that lives on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """f, with what it has freed given back at a task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator:
        yield from f(batches)
        release()

    return run


def unpack_all(items: list[tuple[int, bytes]], kind: int) -> dict[str, np.ndarray]:
    """The arrays of one kind, put together; {} if there are none."""
    parts = [unpack(p) for k, p in items if k == kind]
    return {name: np.concatenate([x[name] for x in parts]) for name in parts[0]} if parts else {}


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    """A bucket in 0..n-1 for each integer id."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


#: Slices in which arrays of tasks are put together.
SLICES = 16
#: Bits for each number in a filter; bits of a filter at least and at most, which bounds what is broadcast to 16 MB.
BITS, FILTER_LOG2 = 16, (16, 27)


def slices(df: DataFrame, merge: Callable) -> list[tuple[int, bytes]]:
    """(slice, payload) of packed rows of tasks, whose bucket is a slice, put together by ``merge``: SLICES rows at most."""
    out = exchanged(df, min(partitions(df.sparkSession), SLICES)).mapInArrow(by_bucket(merge), PACKED)
    return [(r["bucket"], bytes(r["payload"])) for r in out.collect()]


def _probes(x: np.ndarray, log2: int) -> list[np.ndarray]:
    h = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return [(h >> np.uint64(64 - log2)).astype(np.int64), (h & np.uint64((1 << log2) - 1)).astype(np.int64)]


def _marked(log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << log2, bool)
        for b in batches:
            for i in _probes(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), log2):
                on[i] = True
        yield from packed_rows((k, 0, pack(b=np.packbits(x))) for k, x in enumerate(np.split(on, SLICES)) if x.any())

    return run


def _either(bucket: int, items: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    yield from packed_rows([(bucket, 0, pack(b=np.bitwise_or.reduce([unpack(p)["b"] for _, p in items])))])


def filter_of(numbers: DataFrame) -> tuple[bytes, int]:
    """(bits, logarithm of their number) of a Bloom filter of a column of longs.

    It only spares work: with more numbers than it is made for it lets others pass, so what it lets pass must be compared.
    """
    least, most = FILTER_LOG2
    log2 = min(max((BITS * numbers.count()).bit_length(), least), most)
    out = np.zeros((SLICES, (1 << log2) // SLICES // 8), np.uint8)
    for k, payload in slices(numbers.mapInArrow(_marked(log2), PACKED), _either):
        out[k] = unpack(payload)["b"]
    return pack(b=out.ravel()), log2


def filter_bits(held: bytes) -> np.ndarray:
    return unpack(held)["b"]


def in_filter(on: np.ndarray, x: np.ndarray, log2: int) -> np.ndarray:
    """Which of the unsigned numbers may be in the filter."""
    i, j = _probes(x, log2)
    hit = lambda k: (on[k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & np.uint8(1)
    return (hit(i) & hit(j)).astype(bool)
