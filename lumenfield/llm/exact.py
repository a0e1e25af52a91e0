"""Exact dedup with an extendible-hash index on shared files.

An entry stands for one distinct normalised text of a map task; its key is a 64-bit hash. Owners have ranges of keys, equal in
their leading bits. In a range a directory over the next bits says which bucket a key is in: where a bucket holds more than its
capacity it is split in two by its next bit, and where that bit is beyond the directory's depth the directory doubles; a bucket
that is overfull still gets a directory of its own over the bits that follow, until no bit is left. The owner's task goes through its
buckets in order, chains the texts of one key, and compares their bytes: an entry's class is its key and its link in that key's
chain. Buckets with their texts are a file of each owner in the shared folder, from which rows get their classes back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lumenfield.llm import common as c

U = np.uint64
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bits that one directory can have; an overfull bucket beyond them has a directory of its own.
STEP = 12
#: Bits of an entry's number that count entries in a task.
LOCAL = 40
ENTRY = "row_id long, entry long, key long, sha binary, n_chars long, norm binary"
_ENTRY = pa.schema([("row_id", pa.int64()), ("entry", pa.int64()), ("key", pa.int64()), ("sha", pa.binary()), ("n_chars", pa.int64()), ("norm", pa.binary())])
PAGE = "bucket long, key long, link int, entry long, norm binary"
_PAGE = pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("link", pa.int32()), ("entry", pa.int64()), ("norm", pa.binary())])


def key_of(norm: bytes) -> int:
    return xxhash.xxh64_intdigest(norm)


def digest_of(norm: bytes) -> bytes:
    return hashlib.sha256(norm).digest()


def _entries(key: Callable[[bytes], int], digest: Callable[[bytes], bytes], hold: int = 1 << 26):
    """A row for each row, with its entry's number; norm only with the first row of an entry. Past ``hold`` bytes a task forgets what it saw, which costs a further entry only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[bytes, int]] = {}
        held, last = 0, TaskContext.get().partitionId() << LOCAL
        for batch in batches:
            out = tuple([] for _ in _ENTRY)
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                norm = text.encode().translate(None, SPACE)
                sha = digest(norm)
                known, entry = seen.get(sha, (None, 0))
                first = None
                if known != norm:
                    if held > hold:
                        seen, held = {}, 0
                    last += 1
                    first, entry = norm, last
                    seen[sha] = norm, entry
                    held += len(norm) + 200
                # Keys are kept in the order of unsigned numbers.
                for col, x in zip(out, (i, entry, key(norm) - (1 << 63), sha, len(text), first), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _ENTRY.types, strict=True)], schema=_ENTRY)

    return run


def directory(counts: dict[int, int], depth: int, capacity: int) -> tuple[int, np.ndarray]:
    """(global depth, bucket of each place): doubling from one bucket until none that can be split is overfull.

    ``counts`` has the number of entries by the first ``depth`` bits of their keys.
    """
    fine = np.zeros(1 << depth, np.int64)
    for k, v in counts.items():
        fine[k] = v
    sums = np.append(0, np.cumsum(fine))
    size = lambda prefix, d: int(sums[(prefix + 1) << (depth - d)] - sums[prefix << (depth - d)])
    g, places = 0, [(0, 0)]  # each place: (prefix, local depth) of its bucket
    while over := [b for b in dict.fromkeys(places) if b[1] < depth and size(*b) > capacity]:
        for prefix, d in over:
            if d == g:  # the directory doubles
                places = [b for b in places for _ in range(2)]
                g += 1
            width = 1 << (g - d)
            at = prefix * width
            places[at : at + width] = [(prefix * 2, d + 1)] * (width // 2) + [(prefix * 2 + 1, d + 1)] * (width // 2)
    number = {b: k for k, b in enumerate(dict.fromkeys(places))}
    return g, np.array([number[b] for b in places], np.int64)


def bucket_starts(keys: np.ndarray, skip: int, capacity: int) -> list[int]:
    """Where buckets begin in sorted unsigned keys that are equal in their first ``skip`` bits."""
    depth = min(STEP, 64 - skip)
    if len(keys) <= capacity or depth == 0 or keys[0] == keys[-1]:
        return [0]
    prefix = ((keys << U(skip)) >> U(64 - depth)).astype(np.int64)
    g, places = directory(dict(zip(*(x.tolist() for x in np.unique(prefix, return_counts=True)), strict=True)), depth, capacity)
    bucket = places[prefix >> (depth - g)]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
    out = []
    for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
        deeper = b - a > capacity and prefix[a] == prefix[b - 1]
        out += [a + x for x in bucket_starts(keys[a:b], skip + depth, capacity)] if deeper else [a]
    return out


def _heads(capacity: int, bits: int):
    """Sorted keys of whole owners in, the first key of each bucket out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(parts: list[np.ndarray]) -> pa.RecordBatch:
            keys = np.concatenate(parts)
            starts = bucket_starts(keys.view(U) ^ U(1 << 63), bits, capacity)
            return pa.RecordBatch.from_arrays([pa.array(keys[starts])], names=["key"])

        held, owner = [], None
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            mine = keys >> (64 - bits) if bits else np.zeros(len(keys), np.int64)
            cuts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            for i, j in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
                if held and mine[i] != owner:
                    yield told(held)
                    held = []
                held.append(keys[i:j])
                owner = mine[i]
        if held:
            yield told(held)

    return run


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages sorted by key, a bucket's head before its pages. Each key's chain holds its distinct texts, told apart by bytes."""
    last, chain, bucket = None, [], 0
    for batch in batches:
        out = tuple([] for _ in _PAGE)
        for key, head, entry, norm in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if head:
                bucket = key  # a bucket is named by its first key
                continue
            if key != last:
                last, chain = key, []
            if norm not in chain:
                chain.append(norm)
            for col, x in zip(out, (bucket, key, chain.index(norm), entry, norm), strict=True):
                col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _PAGE.types, strict=True)], schema=_PAGE)


def index(entries: DataFrame, capacity: int) -> DataFrame:
    """bucket, key, link, entry, norm: the index's files, one of each owner task, in the order of buckets and keys."""
    n = c.partitions(entries.sparkSession)
    bits = max(0, (4 * n - 1).bit_length())  # some owners for each task
    pages = entries.where("norm is not null").select("key", F.lit(False).alias("head"), "entry", "norm")
    owner = lambda d: d.withColumn("owner", F.shiftright("key", 64 - bits) if bits else F.lit(0))
    keys = owner(pages.select("key")).repartition(n, "owner").sortWithinPartitions("key").select("key")
    heads = keys.mapInArrow(_heads(capacity, bits), "key long").select("key", F.lit(True).alias("head"), F.lit(None).cast("long").alias("entry"), F.lit(None).cast("binary").alias("norm"))
    both = owner(pages.unionAll(heads)).repartition(n, "owner").sortWithinPartitions("key", F.desc("head")).select("key", "head", "entry", "norm")
    return c.stored(both.mapInArrow(_chains, PAGE))


def exact_groups(docs: DataFrame, capacity: int = 4096, key: Callable[[bytes], int] = key_of, digest: Callable[[bytes], bytes] = digest_of) -> DataFrame:
    """Groups of rows whose texts are equal without the characters of ``[\\x20\\x09-\\x0D]``.

    ``docs`` needs doc_id and text; other columns are ignored. A null text counts as empty; empty texts
    are equal. Returns for each row doc_id, keep_id (of the group's row with the most code points, then
    the smallest doc_id, null ids last), group_size, kept, text_sha256 (of the normalised text). Rows that
    repeat a doc_id count one by one, and each row with the group's keep_id has kept set. An empty table gives an empty one.
    Texts are equal if their bytes are: ``key`` and ``digest`` may give different texts the same number.
    """
    spark = docs.sparkSession
    c.small_batches(spark)
    entries = c.stored(docs.select(F.col("doc_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text")).mapInArrow(_entries(key, digest), ENTRY))
    classes = index(entries, capacity).select("entry", "key", "link")
    # A task's rows of one text are summed up under its entry, and a class has an entry of each task at most: no hot text is one task's.
    rows = entries.select("entry", "row_id", "sha", "n_chars")
    best = F.max(F.struct(F.col("n_chars").alias("n"), F.bitwise_not("row_id").alias("i")))
    of_entry = rows.groupBy("entry").agg(best.alias("best"), F.count("*").alias("size")).join(classes, "entry")
    of_class = of_entry.groupBy("key", "link").agg(F.max("best").alias("best"), F.sum("size").alias("group_size"))
    kept = of_entry.select("entry", "key", "link").join(of_class, ["key", "link"]).select("entry", F.bitwise_not("best.i").alias("keep_id"), "group_size")
    out = rows.join(kept, "entry")
    return out.select(F.col("row_id").alias("doc_id"), "keep_id", "group_size", F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(c.table(spark, sf_dir, "documents"))


ORACLE = r"""
with x as (select doc_id, coalesce(text, '') as raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
y as (select *, first_value(doc_id) over (partition by norm order by length(raw) desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from x)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from y
"""
