"""Groups of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, none missed.

Pairs come from SimHash fingerprints of the shingles by the anchors of ``simhash``, at a wider distance than a
link of fingerprints has there, and are verified on whole sets. Texts that are similar may have fingerprints farther apart
than any covering reaches, so an exact way follows for the links that are left, among texts that are not connected yet.

For it shingles are put in one order, rare ones first. Two sets that are similar enough share one of the first
n - ceil(0.8 n) + 1 shingles of each, so only these prefixes meet, by shingle; how rare a shingle is comes
from counts by hash, which decide about the number of candidates and never about the result. First each text of
a shingle's group is verified against the group's first text. Then come rounds: in each group, members of
different components are compared by size, by place and by parities, which bound how far two sets are apart; of
the pairs that may be similar a group sends a forest, never all of them; these are verified, and those that
fail are not proposed again. It ends when no group has a pair left that may join two components.
A large group is cut into cells of bounded size, each pair of its parts in one of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lumenfield.llm import common as c
from lumenfield.llm import simhash

U = np.uint64
WORDS = 5
#: Least similarity, as a fraction.
SHARE = (4, 5)
#: Bits in which fingerprints of candidates may differ, and the blocks of their covering code: the most that a threshold of two bits a block allows.
BITS, BLOCKS = 8, 3
#: Bits of the hashes that shingles are counted by.
COUNTED = 20
#: Bits of a shingle's hash that prefixes meet by; sets are compared by all 64.
MET = 40
#: Classes of hashes by which candidates are sieved before whole sets are fetched, and those for sets of more than WIDE shingles.
PARITIES, MORE, WIDE = 1024, 8192, 2048
#: Forests without a common edge that a cell sends in a round, so that failures do not cost a round each.
FORESTS = 8
#: Members of a group in one part of it.
CELL = 4096


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct XXH64 hashes of word shingles, in order; a text without words has one, zero."""
    h = simhash.hashes(text, words)
    return np.unique(h) if len(h) else np.zeros(1, np.uint64)


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - COUNTED)).astype(np.int64)


def _counts(words: int):
    """One row for each slice of a task's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTED, np.int64)
        for b in batches:
            for t in b.column(1).to_pylist():
                np.add.at(total, _place(shingles(t, words)), 1)
        yield from c.packed_rows((k, 0, c.pack(n=x)) for k, x in enumerate(np.split(total, c.SLICES)) if x.any())

    return run


def _rank(bucket: int, items: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """The logarithms of a slice's counts."""
    total = sum(c.unpack(p)["n"] for _, p in items)
    yield from c.packed_rows([(bucket, 0, c.pack(r=np.log2(np.maximum(total, 1)).astype(np.uint8)))])


def need(x: np.ndarray | int, y: np.ndarray | int) -> np.ndarray | int:
    """Shingles that sets of x and y must share."""
    a, b = SHARE
    return -(-a * (x + y) // (a + b))


def _prefixes(n: int, words: int, shared, flush: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(pickle.loads(shared.value), np.uint8)

        def send(held):
            h, t, size, at = (np.concatenate(x) for x in zip(*held, strict=True))
            for bucket, i in c.split_by(c.bucket_of(h, n), n):
                yield bucket, 0, c.pack(h=h[i], t=t[i], n=size[i], at=at[i])

        def rows():
            held, count, seen = [], 0, set()
            for b in batches:
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if key in seen:
                        continue
                    seen.add(key)
                    s = shingles(text, words)
                    k = len(s) + (-SHARE[0] * len(s)) // SHARE[1] + 1  # n - ceil(0.8 n) + 1
                    first = s[np.lexsort((s, rank[_place(s)]))[:k]] >> U(64 - MET)
                    held.append((first, np.full(k, key, np.int64), np.full(k, len(s), np.int32), np.arange(k, dtype=np.int32)))
                    count += k
                if count >= flush:
                    yield from send(held)
                    held, count = [], 0
            if held:
                yield from send(held)

        yield from c.packed_rows(rows())

    return run


MEMBER = "g long, t long, n int, at int, lead long"
_MEMBER = pa.schema([("g", pa.int64()), ("t", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("lead", pa.int64())])


def _members(bucket: int, items: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Texts with a partner of a fitting size in a shingle's group; lead is the group's first text of such sizes where the two may be similar."""
    x = c.unpack_all(items, 0)
    order = np.lexsort((x["at"], x["t"], x["n"], x["h"]))
    h, t, n, at = (x[k][order] for k in ("h", "t", "n", "at"))
    new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))  # a copy in another task, or hashes that meet
    h, t, n, at = h[new], t[new], n[new].astype(np.int64), at[new].astype(np.int64)
    fits = (h[1:] == h[:-1]) & (SHARE[1] * n[:-1] >= SHARE[0] * n[1:])  # sizes ascend in a group
    keep = np.append(fits, False) | np.append(False, fits)
    h, t, n, at = h[keep], t[keep], n[keep], at[keep]
    if not len(h):
        return
    new = np.append(True, (h[1:] != h[:-1]) | (SHARE[1] * n[:-1] < SHARE[0] * n[1:]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    may = ~new & (np.minimum(n - at, n[first] - at[first]) >= need(n, n[first]))
    yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(t), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(t[first], mask=~may)], schema=_MEMBER)


def _sets(words: int, shared, log2: int):
    """The sets of texts that the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = c.filter_bits(shared.value)
        for b in batches:
            t = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            i = pa.array(np.flatnonzero(c.in_filter(on, t.view(np.uint64), log2)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(i), pa.array([shingles(x, words).tobytes() for x in b.column(1).take(i).to_pylist()], pa.binary())], names=["t", "grams"])

    return run


def _odd(s: np.ndarray, classes: int) -> bytes:
    """Whether the set has an odd number of each class of hashes."""
    return np.packbits(np.bincount((s & U(classes - 1)).astype(np.int64), minlength=classes).astype(np.uint8) & 1).tobytes()


def _traits(words: int):
    """Fingerprint, parities and size of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, sets = [], []
            for t in b.column(1).to_pylist():
                h = simhash.hashes(t, words)
                prints.append(simhash.majority(h))
                sets.append(np.unique(h) if len(h) else np.zeros(1, np.uint64))
            fp = pa.array(np.array(prints, np.uint64).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), fp, pa.array([_odd(s, PARITIES) for s in sets], pa.binary()), pa.array([_odd(s, MORE) if len(s) > WIDE else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32())], names=["t", "fp", "odd", "more", "n"])

    return run


def _apart(x: bytes, y: bytes) -> int:
    """Classes whose parities differ: no more of them than shingles that one of two sets has alone."""
    return int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum())


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities differ in no more classes than similar sets have shingles apart: none that is similar goes."""
    for b in batches:
        yes = []
        for n, m, x, y, more, also in zip(*(b.column(k).to_pylist() for k in range(2, 8)), strict=True):
            room = n + m - 2 * need(n, m)
            yes.append(_apart(x, y) <= room and not (more and also and _apart(more, also) > room))
        keep = pa.array(yes, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], schema=simhash.LINK)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs, and whether they are similar."""
    for b in batches:
        yes = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            yes.append(bool(len(np.intersect1d(x, y, assume_unique=True)) >= need(len(x), len(y))))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(yes, pa.bool_())], names=["a", "b", "yes"])


def _by_cells(f, least: int = 1 << 15):
    """A mapInArrow function that calls f with tables of whole cells, whose rows are next to each other; a cell's number is added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def cut(table: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
            keys = [table.column(k).to_numpy() for k in ("g", "lo", "hi")]
            new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            end = table.num_rows if last else int(np.flatnonzero(new)[-1])
            return table.slice(0, end).append_column("cell", pa.array((np.cumsum(new) - 1)[:end])), table.slice(end)

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= least:
                whole, rest = cut(pa.Table.from_batches(held).combine_chunks(), False)
                if whole.num_rows:
                    yield from f(whole)
                held, rows = rest.combine_chunks().to_batches(), rest.num_rows
        if rows:
            yield from f(cut(pa.Table.from_batches(held).combine_chunks(), True)[0])

    return run


def _pairs(x: pa.Table, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of members in one cell and different components whose sets may be similar as their sizes, and places in them, say.

    Members of a cell's most frequent component are not compared with each other.
    """
    cell, n, at, root = (x.column(k).to_numpy().astype(np.int64) for k in ("cell", "n", "at", "root"))
    by_root = np.lexsort((root, cell))
    first = np.flatnonzero(np.append(True, (cell[by_root][1:] != cell[by_root][:-1]) | (root[by_root][1:] != root[by_root][:-1])))
    size = np.diff(np.append(first, len(cell)))
    best = np.lexsort((-size, cell[by_root][first]))
    best = best[np.append(True, cell[by_root][first][best][1:] != cell[by_root][first][best][:-1])]
    common = root[by_root][first][best][cell]  # cells are numbered from 0
    minor = np.flatnonzero(root != common)
    key = cell << 32 | n
    lo = np.searchsorted(key, cell[minor] << 32 | need_least(n[minor]), "left")
    hi = np.searchsorted(key, cell[minor] << 32 | np.minimum(SHARE[1] * n[minor] // SHARE[0], (1 << 32) - 1), "right")
    ends = np.cumsum(hi - lo)
    for k in range(0, int(ends[-1]) if len(ends) else 0, step):
        pair = np.arange(k, min(k + step, int(ends[-1])))
        row = np.searchsorted(ends, pair, "right")
        i, j = minor[row], hi[row] - (ends[row] - pair)
        ok = (root[i] != root[j]) & ((j > i) | (root[j] == common[j]))
        i, j = i[ok], j[ok]
        ok = np.minimum(n[i] - at[i], n[j] - at[j]) >= need(n[i], n[j])
        yield i[ok], j[ok]


def need_least(n: np.ndarray) -> np.ndarray:
    """The least size of a set that can be similar to one of n."""
    return -(-SHARE[0] * n // SHARE[1])


def _open(x: pa.Table) -> Iterator[pa.RecordBatch]:
    """Members that have a pair."""
    some = np.zeros(x.num_rows, bool)
    for i, j in _pairs(x):
        some[i] = some[j] = True
    yield from x.drop_columns(["cell"]).filter(pa.array(some)).to_batches()


def _proposed(x: pa.Table) -> Iterator[pa.RecordBatch]:
    """Forests, over components, of the pairs that may be similar and have not failed."""
    odd = np.frombuffer(b"".join(x.column("odd").to_pylist()), np.uint64).reshape(x.num_rows, -1)
    more, failed = x.column("more").to_pylist(), x.column("failed").to_pylist()
    n, t, root, cell = (x.column(k).to_numpy().astype(np.int64) for k in ("n", "t", "root", "cell"))
    found = []
    for i, j in _pairs(x):
        room = n[i] + n[j] - 2 * need(n[i], n[j])
        ok = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 16):
            s = slice(k, k + (1 << 16))
            ok[s] = np.bitwise_count(odd[i[s]] ^ odd[j[s]]).sum(1) <= room[s]
        i, j, room = i[ok], j[ok], room[ok]
        for k in np.flatnonzero((n[i] > WIDE) & (n[j] > WIDE)):
            if _apart(more[i[k]], more[j[k]]) > room[k]:
                i[k] = -1
        i, j = i[i >= 0], j[i >= 0]
        again = [k for k in range(len(i)) if (f := failed[i[k]]) and int(t[j[k]]) in f]
        i, j = np.delete(i, again), np.delete(j, again)
        if found:
            i, j = np.append(found[0], i), np.append(found[1], j)
        found = _forest(i, j, root, cell)
    if found and len(found[0]):
        a, b = t[found[0]], t[found[1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], schema=simhash.LINK)


def _forest(i: np.ndarray, j: np.ndarray, root: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of members, forests over the components in a cell: FORESTS at most, no two with the same pair of members."""
    p, q = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
    order = np.lexsort((j, i, q, p, cell[i]))
    nth = np.arange(len(order))  # among the pairs of members of the same two components, of which FORESTS can be used
    new = np.append(True, (cell[i][order][1:] != cell[i][order][:-1]) | (p[order][1:] != p[order][:-1]) | (q[order][1:] != q[order][:-1]))[: len(order)]
    nth -= np.maximum.accumulate(np.where(new, nth, 0))
    left, keep = order[nth < FORESTS].tolist(), []
    nodes = [((int(cell[i[k]]), int(p[k])), (int(cell[i[k]]), int(q[k]))) for k in left]
    for _ in range(FORESTS):
        up: dict[tuple[int, int], tuple[int, int]] = {}

        def top(x, up=up):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        rest = []
        for k, (x, y) in zip(left, nodes, strict=True):
            x, y = top(x), top(y)
            if x != y:
                up[x] = y
                keep.append(k)
            else:
                rest.append(k)
        at = {k: x for k, x in zip(left, nodes, strict=True)}
        left, nodes = rest, [at[k] for k in rest]
        if not left:
            break
    return i[keep], j[keep]


def _in_cells(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", "n")


def near_prints(traits: DataFrame) -> DataFrame:
    """a, b: pairs of texts t whose fingerprints fp differ in BITS bits at most, in forests that connect what such pairs connect."""
    prints = c.stored(traits.groupBy("fp").agg(F.min("t").alias("first")))
    first = lambda fp, t: prints.select(F.col("fp").alias(fp), F.col("first").alias(t))
    links = c.stored(simhash.linked(prints, prints.count(), BITS, BLOCKS).distinct())
    across = links.withColumnsRenamed({"a": "p", "b": "q"}).join(first("p", "a"), "p").join(first("q", "b"), "q").select("a", "b")
    alike = traits.select("t", "fp").join(prints, "fp").where("t <> first").select(F.col("t").alias("a"), F.col("first").alias("b"))
    out = c.stored(across.unionAll(alike).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    c.free(prints, links)
    return out


def similar(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """node, root for the texts that are similar to another one: root is the least t that a text reaches.

    ``texts`` needs t, a long that is equal for equal texts only, and text; rows may repeat. Texts are linked
    if the Jaccard similarity of their sets of ``words``-word shingles is 0.8 or more. A text with fewer
    words is one shingle; texts without words, or null, are alike.
    """
    spark = texts.sparkSession
    c.small_batches(spark)
    n = c.partitions(spark)
    texts = texts.select("t", F.col("text").cast("string").alias("text"))

    odd = c.stored(texts.mapInArrow(c.trimmed(_traits(words)), "t long, fp long, odd binary, more binary, n int").dropDuplicates(["t"]))
    rank = np.zeros((c.SLICES, (1 << COUNTED) // c.SLICES), np.uint8)
    for k, payload in c.slices(texts.mapInArrow(c.trimmed(_counts(words)), c.PACKED), _rank):
        rank[k] = c.unpack(payload)["r"]
    shared = spark.sparkContext.broadcast(pickle.dumps(rank.tobytes()))
    members = c.stored(c.exchanged(texts.mapInArrow(c.trimmed(_prefixes(n, words, shared)), c.PACKED), n).mapInArrow(c.by_bucket(_members), MEMBER))

    def of(df: DataFrame, key: str) -> DataFrame:
        return df.select(*[F.col(x).alias(key if x == "t" else f"{key}_{x}") for x in df.columns])

    def verified(pairs: DataFrame) -> DataFrame:
        """a, b, yes."""
        some = c.stored(pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("t")))
        held, log2 = c.filter_of(some)
        kept = spark.sparkContext.broadcast(held)
        sets = c.stored(texts.mapInArrow(c.trimmed(_sets(words, kept, log2)), "t long, grams binary").dropDuplicates(["t"]).join(some, "t", "left_semi"))
        both = pairs.join(of(sets, "a"), "a").join(of(sets, "b"), "b").select("a", "b", "a_grams", "b_grams")
        out = c.stored(both.mapInArrow(c.trimmed(_verified), "a long, b long, yes boolean"))
        c.free(some, sets)
        return out

    def sieved(pairs: DataFrame) -> DataFrame:
        both = pairs.join(of(odd, "a"), "a").join(of(odd, "b"), "b").select("a", "b", "a_n", "b_n", "a_odd", "b_odd", "a_more", "b_more")
        return c.stored(both.mapInArrow(_possible, "a long, b long"))

    near = near_prints(odd)
    may = sieved(near)
    told = verified(may)
    c.free(near, may)

    root = c.stored(simhash.components(told.where("yes").select("a", "b")))
    lead = members.where("lead is not null").select(F.greatest("t", "lead").alias("a"), F.least("t", "lead").alias("b")).distinct().join(told, ["a", "b"], "left_anti")
    for x in "ab":
        lead = lead.join(root.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")), x, "left")
    may = sieved(lead.where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b"))
    more = verified(may)
    told, before = c.stored(told.unionAll(more)), told
    c.free(before, more, may, root)
    while True:
        rooted = members.join(simhash.components(told.where("yes").select("a", "b")), F.col("t") == F.col("node"), "left").select("g", "t", "n", "at", F.coalesce("root", "t").alias("root"))
        rooted = c.stored(rooted)
        parts = rooted.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("g", "n", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
        own = F.pmod(F.xxhash64("t"), F.col("parts")).cast("int")
        cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, own).alias("lo"), F.greatest(k, own).alias("hi"))))
        dealt = c.joined(rooted.withColumnRenamed("n", "size"), parts, "g", rooted.count()).select("g", "t", F.col("size").alias("n"), "at", "root", cells.alias("cell")).select("g", "cell.lo", "cell.hi", "t", "n", "at", "root")
        open_ = c.stored(_in_cells(dealt, n).mapInArrow(c.trimmed(_by_cells(_open)), "g long, lo int, hi int, t long, n int, at int, root long"))
        failed = told.where("not yes")
        failed = failed.select(F.col("a").alias("t"), F.col("b").alias("o")).union(failed.select(F.col("b").alias("t"), F.col("a").alias("o"))).groupBy("t").agg(F.collect_set("o").alias("failed"))
        rows = open_.join(odd.drop("n", "fp"), "t").join(failed, "t", "left").select("g", "lo", "hi", "t", "n", "at", "root", "odd", "more", "failed")
        pairs = c.stored(_in_cells(rows, n).mapInArrow(c.trimmed(_by_cells(_proposed, 1 << 13)), "a long, b long").distinct())
        c.free(rooted, open_)
        if pairs.isEmpty():
            c.free(pairs)
            break
        more = verified(pairs)
        told, before = c.stored(told.unionAll(more)), told
        c.free(before, more, pairs)
    out = c.stored(simhash.components(told.where("yes").select("a", "b")))
    c.free(members, odd, told)
    return out


def firsts(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row of each group of similar texts: that of the smallest doc_id, a null one only if the group has no other.

    ``docs`` needs doc_id and text. Texts, not ids, are what is grouped, so rows of a null doc_id take part like others; of
    rows that repeat a doc_id and its text one stays. A null text counts as an empty one. Texts are told apart by 64-bit hashes.
    """
    t = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.withColumn("_t", t)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("_t").alias("t")))
    classes = keyed.groupBy("_t").agg(least.alias("least"))
    rooted = classes.join(similar(keyed.select(F.col("_t").alias("t"), "text"), words), F.col("_t") == F.col("node"), "left")
    stay = rooted.groupBy(F.coalesce("root", "_t").alias("root")).agg(F.min("least").alias("least")).select(F.xxhash64("least.t", "least.id").alias("_k"), F.col("least.t").alias("_of"), F.col("least.id").alias("_id"))
    out = keyed.withColumn("_k", F.xxhash64("_t", "doc_id")).join(stay, "_k").where(F.col("_t").eqNullSafe(F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    others = [x for x in docs.columns if x not in ("doc_id", "text")]
    w = W.partitionBy("_k", "_t", "doc_id").orderBy(*(others or ["doc_id"]))
    return out.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").select(*docs.columns)
