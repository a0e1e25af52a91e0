"""SimHash near-dedup by anchor-point covering.

The 64 bits are cut into blocks. If two fingerprints differ in ``bits`` bits at most, they differ in
``bits // blocks`` at most in some block. In each block a covering code supplies the anchors: the Hamming
code of length 15 on the block's first bits, any value on its others. Its covering radius is 1, so each
fingerprint has a home anchor within 1; it is replicated to every anchor within 1 plus the block's
threshold, and so meets there each fingerprint that is near it and at home there. Pairs are compared per
anchor, in bounded steps, and a task sends a forest of the links it finds, never all pairs.

Only distinct fingerprints take part: copies share one. Components come from links by alternating
large-star and small-star steps, which keep stars' centres as keys that tasks pre-aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lumenfield.llm import common as c

U = np.uint64
SEED = 42
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 hashes of word shingles, repeats included; none without words."""
    ws = (text or "").encode().lower().split()  # ASCII white space and A-Z only, as the bytes say
    if not ws:
        return np.zeros(0, np.uint64)
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws])
    k = min(words, len(ws))
    starts = np.append(0, ends[:-1])[: len(ws) - k + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """SimHash of hashes: the bits that over half of them have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of the hashes of word shingles; 0 without words."""
    return majority(hashes(text, words))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return run


#: Parity checks of the Hamming code of length 15: column i is i + 1, so a syndrome names the bit to flip.
_CODE = 15


def _syndromes() -> np.ndarray:
    """The syndrome of each 15-bit value."""
    x = np.arange(1 << _CODE)
    out = np.zeros(1 << _CODE, np.int64)
    for i in range(_CODE):
        out ^= np.where((x >> i) & 1, i + 1, 0)
    return out


def _flips(width: int, most: int) -> np.ndarray:
    """All values of width bits with most 1 bits at most."""
    return np.array([sum(1 << i for i in s) for k in range(most + 1) for s in combinations(range(width), k)], np.int64)


def cover(values: np.ndarray, width: int, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home anchor of each value, rows, anchors): anchors within 1 + near of values, the home among them.

    Anchors are words of width bits whose first 15 are in the Hamming code. A word within r of a value is
    the value with r bits flipped: it is an anchor if the syndrome is then 0.
    """
    syndrome = _syndromes()
    low = values & ((1 << _CODE) - 1)
    s = syndrome[low]
    home = values ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)
    flips = _flips(width, 1 + near)
    flip_s = syndrome[flips & ((1 << _CODE) - 1)]
    rows, anchors = [], []
    for want in range(16):  # flips that turn syndrome `want` to 0
        ok, f = np.flatnonzero(s == want), flips[flip_s == want]
        rows.append(np.repeat(ok, len(f)))
        anchors.append((values[ok][:, None] ^ f[None, :]).ravel())
    return home, np.concatenate(rows), np.concatenate(anchors)


def block_plan(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _replicas(n: int, bits: int, blocks: int):
    near = bits // blocks
    step = max(1 << 6, 1 << 18 >> 3 * near)  # a fingerprint has some eight times the replicas with each bit more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                every = b.column(0).to_numpy(zero_copy_only=False)
                for i in range(0, len(every), step):
                    fp = every[i : i + step].view(np.uint64)
                    for k, (shift, width) in enumerate(block_plan(blocks)):
                        value = ((fp >> U(shift)) & U((1 << width) - 1)).astype(np.int64)
                        home, row, anchor = cover(value, width, near)
                        key = anchor * blocks + k
                        for bucket, j in c.split_by(c.bucket_of(key, n), n):
                            at = anchor[j] == home[row[j]]
                            yield bucket, 0, c.pack(k=key[j], f=fp[row[j]], h=at)

        yield from c.packed_rows(rows())

    return run


def _compare(bits: int, step: int = 1 << 21):
    def one(bucket: int, items: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        x = c.unpack_all(items, 0)
        order = np.argsort(x["k"], kind="stable")
        key, fp, home = x["k"][order], x["f"][order], x["h"][order].astype(bool)
        hk, hf = key[home], fp[home]
        left, right = np.searchsorted(hk, key, "left"), np.searchsorted(hk, key, "right")
        some = right > left
        key, fp, left, count = key[some], fp[some], left[some], (right - left)[some]
        a, b = [], []
        ends = np.cumsum(count)
        at, total = 0, int(ends[-1]) if len(ends) else 0
        while at < total:  # pairs number at .. at + step
            stop = min(at + step, total)
            pair = np.arange(at, stop)
            row = np.searchsorted(ends, pair, "right")
            other = hf[left[row] + pair - (ends[row] - count[row])]
            mine = fp[row]
            near = (np.bitwise_count(mine ^ other) <= bits) & (mine != other)
            if near.any():
                a.append(mine[near])
                b.append(other[near])
                if sum(map(len, a)) > step:
                    fa, fb = forest(np.concatenate(a), np.concatenate(b))
                    a, b = [fa], [fb]
            at = stop
        if a:
            fa, fb = forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64))], schema=LINK)

    return c.by_bucket(one)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what a-b connects, one for each node but each component's least."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = code[: len(a)], code[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        np.minimum.at(root, before, root)  # a tree's new minimum reaches its old root
        root = np.minimum(root, root[root])
        while (up := root[root]) is not None and (up != root).any():
            root = up
        if (before == root).all():
            break
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


#: Links that one task may hold, 16 bytes each; more are contracted by steps over all tasks.
ONE_TASK = 1 << 20


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars that a task's links make."""
    held = [[x.to_numpy(zero_copy_only=False).astype(np.int64) for x in b.columns] for b in batches]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held, strict=True)))], names=["u", "v"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, root (the least node that it reaches) for the nodes of links a-b.

    Links that one task can hold make their stars there. More of them go through large-star and small-star steps, until a step
    changes nothing. The result is the same.
    """
    edges = c.stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if edges.count() <= one_task:
        out = c.stored(edges.repartition(1).mapInArrow(_contracted, "u long, v long"))
        c.free(edges)
        return out.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        # Large star: each larger neighbour of a node gets the node's least neighbour.
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = c.stored(c.joined(both, least, "u", 2 * edges.count()).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # Small star: each smaller neighbour and the node itself get the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = c.joined(large, low, "u", large.count()).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        small = c.stored(small)
        same = edges.count() == small.count() and small.join(edges, ["u", "v"], "left_anti").isEmpty()  # both have each edge once
        c.free(edges, large)
        edges = small
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def chosen_blocks(n: int) -> int:
    """Blocks for n fingerprints: two need some 690 replicas of each in place of 50, but have 2**28 anchors in place of 2**17, so that fewer are compared at one."""
    return 3 if n < 10**8 else 2


def linked(prints: DataFrame, total: int, bits: int, blocks: int | None = None) -> DataFrame:
    """a, b: forests that connect, of the total distinct longs fp of ``prints``, what differs in ``bits`` bits at most."""
    n = c.partitions(prints.sparkSession)
    # Few bytes mean many replicas, so tasks are set here rather than merged by size.
    homes = prints.select("fp").repartition(n, "fp").mapInArrow(c.trimmed(_replicas(n, bits, blocks or chosen_blocks(total))), c.PACKED)
    return c.exchanged(homes, n).mapInArrow(_compare(bits), "a long, b long")


def near_groups(docs: DataFrame, words: int = 4, bits: int = 4, blocks: int | None = None) -> DataFrame:
    """Fingerprints and near-duplicate components.

    ``docs`` needs doc_id and text; other columns are ignored. Returns for each row doc_id, fingerprint (16
    hex digits) and component_id: the smallest doc_id reachable over links of ``bits`` differing bits at
    most. A text with fewer words than a shingle is one shingle; one without words, or null, has
    fingerprint zero and is linked like any other. Repeated rows each come back. Rows of a null doc_id come
    back and link like others, but don't name a component unless all of it has null. Any bit count below
    ``blocks`` * 16 works, and any number of blocks gives the same links; links are never capped.
    """
    spark = docs.sparkSession
    c.small_batches(spark)
    prints = c.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(words), "doc_id long, fp long"))
    classes = c.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    total = classes.count()
    roots = components(linked(classes, total, bits, blocks))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    label = c.joined(rooted, named, "root", total).select("fp", "component_id", F.col("rows").alias("n"))
    out = c.joined(prints, label, "fp", prints.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(c.table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple[int, str | None]], words: int = 4, bits: int = 4) -> list[tuple[int, str, int]]:
    """The contract word for word, for tests."""
    import re

    prints = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sh = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        prints[d] = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))
    root = {d: d for d in prints}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(sorted(prints), 2):
        if (prints[x] ^ prints[y]).bit_count() <= bits:
            p, q = sorted((up(x), up(y)))
            root[q] = p
    return [(d, f"{f:016x}", up(d)) for d, f in prints.items()]
