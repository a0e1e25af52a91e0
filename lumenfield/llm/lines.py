"""Line dedup with a suffix array over line-ID sequences, built by distributed prefix doubling.

Lines get their IDs by bytes: a hash brings equal lines together, and where lines of one hash differ a link tells them apart. Each
line has a place, numbered through all texts in their order. A line that stands once ends every repeated run, so only places
of repeated lines are ranked. They are sorted over all tasks by (ID, place): a place's rank is where the places equal to it
begin in that order. Doubling joins each place's rank with that of the place h lines on, and sorts and ranks the pairs, which
ranks prefixes of 2h lines; it goes on to exactly ``min_lines``. Places of one rank are then an interval of suffixes whose
longest common prefix has min_lines lines at least. In each interval the first place stays, and the others are copies: chains of
them are the maximal repeated runs, whatever their length, as each place in a longer run is in such an interval. Deeper
ranks would order suffixes inside the intervals, which changes no run.
A long line is a passage by itself: one of ``min_words`` words is a run that counts at length 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from lumenfield.llm import common as c

MIN_LINES = 2
#: Words of a line that counts alone.
MIN_WORDS = 50
#: Bits of a place that count lines in a text, and bits for what a place is: blank, long.
LINES, KIND = 24, 2
BLANK, LONG = 1, 2


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line)


def _long(line: str, min_words: int) -> bool:
    """Whether a line has min_words words, cut at spaces."""
    if len(line) < 2 * min_words - 1:
        return False
    parts = line.split(" ")
    return len(parts) - parts.count("") >= min_words


def _doubled(min_lines: int) -> list[int]:
    """Steps between the two places whose ranks are put together: 1, 2, 4, ..., and what is left."""
    h, steps = 1, []
    while h < min_lines:
        step = min(h, min_lines - h)
        steps.append(step)
        h += step
    return steps


def _hashed(hasher: Callable[[bytes], int], min_words: int):
    """A row for each text: its lines' hashes and kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.split("\n") for t in b.column(2).to_pylist()]
            hashes = [np.array([hasher(x.encode()) for x in t], np.uint64).tobytes() for t in texts]
            kinds = [bytes(BLANK * (not x.strip(" ")) + LONG * _long(x, min_words) for x in t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(hashes, pa.binary()), pa.array(kinds, pa.binary())], names=["doc_id", "v", "n", "hashes", "kinds"])

    return run


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line: its hash and its spot, which is its place and then its kind."""
    for b in batches:
        hashes, kinds = b.column(1).to_pylist(), b.column(2).to_pylist()
        size = np.array([len(x) for x in kinds], np.int64)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64) << LINES, size) + at
        spot = place << KIND | np.frombuffer(b"".join(kinds), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(hashes), np.int64)), pa.array(spot)], names=["h", "spot"])


def _repeated(hasher: Callable[[bytes], int], n: int, held, log2: int, flush: int = 1 << 23):
    """Each of a task's distinct lines whose hash the filter holds, by bucket of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = c.filter_bits(held.value)

        def send(lines: dict[bytes, int]) -> Iterator[tuple[int, int, bytes]]:
            every = list(lines)
            h = np.array([lines[x] for x in every], np.uint64)
            ok = np.flatnonzero(c.in_filter(on, h, log2))
            for bucket, i in c.split_by(c.bucket_of(h[ok], n), n):
                some = [every[k] for k in ok[i]]
                yield bucket, 0, c.pack(h=h[ok[i]], n=np.array([len(x) for x in some], np.int64), t=np.frombuffer(b"".join(some), np.uint8))

        def rows() -> Iterator[tuple[int, int, bytes]]:
            lines, size = {}, 0
            for b in batches:
                for t in b.column(0).to_pylist():
                    for x in t.encode().split(b"\n"):
                        if x not in lines:
                            lines[x] = hasher(x)
                            size += len(x) + 100
                if size >= flush:
                    yield from send(lines)
                    lines, size = {}, 0
            if lines:
                yield from send(lines)

        yield from c.packed_rows(rows(), 16)

    return run


def _clashes(bucket: int, items: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Lines of one hash that differ, with the number of each among them."""
    found: dict[int, set[bytes]] = {}
    for _, payload in items:
        x = c.unpack(payload)
        raw, ends = x["t"].tobytes(), np.cumsum(x["n"]).tolist()
        for h, a, b in zip(x["h"].tolist(), [0, *ends], ends, strict=False):
            found.setdefault(h, set()).add(raw[a:b])
    rows = [(h, k, x) for h, lines in found.items() if len(lines) > 1 for k, x in enumerate(sorted(lines))]
    if rows:
        h, link, line = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(link, pa.int32()), pa.array(line, pa.binary())], names=["h", "link", "line"])


def _lines_of(hasher: Callable[[bytes], int], held, log2: int):
    """A row for each line whose hash the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = c.filter_bits(held.value)
        for b in batches:
            rows = [(d, v, k, x) for d, v, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for k, x in enumerate(t.encode().split(b"\n"))]
            h = np.array([hasher(r[3]) for r in rows], np.uint64)
            ok = np.flatnonzero(c.in_filter(on, h, log2))
            d, v, k, x = zip(*(rows[i] for i in ok), strict=True) if len(ok) else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(v, pa.int64()), pa.array(k, pa.int64()), pa.array(h[ok].view(np.int64)), pa.array(x, pa.binary())], names=["doc_id", "v", "at", "h", "line"])

    return run


RANK = "p int, spot long, start long, first boolean, single boolean, n long, k1 long, k2 long, z1 long, z2 long"
_RANK = pa.schema([("p", pa.int32()), ("spot", pa.int64()), ("start", pa.int64()), ("first", pa.bool_()), ("single", pa.bool_()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("z1", pa.int64()), ("z2", pa.int64())])


def _local_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (k1, k2, spot): where the rows of equal keys begin in this task, whether a row is their first and only one. At the end a row with the task's number of rows, its first and last keys."""
    p = TaskContext.get().partitionId()
    count, start, opening, last, left = 0, 0, None, None, None
    for b in batches:
        k1, k2, spot = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in b.columns)
        if not len(spot):
            continue
        new = np.append(last != (k1[0], k2[0]), (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
        starts = np.maximum.accumulate(np.where(new, np.arange(count, count + len(spot)), start))
        opening, last, start = opening or (int(k1[0]), int(k2[0])), (int(k1[-1]), int(k2[-1])), int(starts[-1])
        count += len(spot)
        if left:  # the row before, of which only now is known whether it stands alone
            spot, starts, new = (np.append(x, y) for x, y in zip(left, (spot, starts, new), strict=True))
        single = new[:-1] & new[1:]
        left = spot[-1], starts[-1], new[-1]
        yield _rank_rows(p, spot[:-1], starts[:-1], new[:-1], single)
    if left:
        yield _rank_rows(p, *(np.array([x]) for x in left), np.array([left[2]]))
        yield pa.RecordBatch.from_pylist([{"p": p, "n": count, "start": start, "k1": opening[0], "k2": opening[1], "z1": last[0], "z2": last[1]}], schema=_RANK)


def _rank_rows(p: int, spot: np.ndarray, start: np.ndarray, first: np.ndarray, single: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(spot), pa.int64())] * 5
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(spot), p, np.int32)), pa.array(spot), pa.array(start), pa.array(first.astype(bool)), pa.array(single.astype(bool)), *none], schema=_RANK)


def ranked(rows: DataFrame) -> DataFrame:
    """spot, rank, copy of the rows (k1, k2, spot) that share their keys with others; copy: with one of a lesser spot.

    A rank is the number of rows with lesser keys. Rows are sorted over all tasks, those of one key too, so that
    a frequent key is not one task's; what tasks must know of the tasks before and after them is one row of each.
    """
    spark = rows.sparkSession
    rows = c.stored(rows.select("k1", "k2", "spot"))
    told = c.stored(rows.repartitionByRange(c.partitions(spark), "k1", "k2", "spot").sortWithinPartitions("k1", "k2", "spot").mapInArrow(_local_ranks, RANK))
    ends = sorted(told.where("n is not null").collect(), key=lambda r: r["p"])  # a row of each task
    carried, base, before = [], 0, None
    for k, r in enumerate(ends):
        goes_on = before is not None and (ends[k - 1]["z1"], ends[k - 1]["z2"]) == (r["k1"], r["k2"])
        after = k + 1 < len(ends) and (ends[k + 1]["k1"], ends[k + 1]["k2"]) == (r["z1"], r["z2"])
        carried.append((r["p"], base, before if goes_on else None, r["start"] if after else None))
        before = before if goes_on and r["start"] == 0 else base + r["start"]
        base += r["n"]
    carry = spark.createDataFrame(carried, "p int, base long, before long, after long")
    out = told.where("n is null").join(F.broadcast(carry), "p")  # a row of each task
    goes_on = (F.col("start") == 0) & F.col("before").isNotNull()
    alone = F.col("single") & ~goes_on & ~F.coalesce(F.col("start") == F.col("after"), F.lit(False))
    out = c.stored(out.where(~alone).select("spot", F.when(goes_on, F.col("before")).otherwise(F.col("base") + F.col("start")).alias("rank"), (~F.col("first") | goes_on).alias("copy")))
    c.free(rows, told)
    return out


def _numbered(heads: DataFrame) -> DataFrame:
    """doc_id, v, no, first: a number for each text in order of (doc_id, v), and further ones for each 2**LINES lines; first is the text's first."""
    spark = heads.sparkSession
    size = F.ceil((F.col("n") + 1) / (1 << LINES)).cast("long")  # a place without a line ends each text
    order = c.stored(heads.select("doc_id", "v", size.alias("size")).repartitionByRange(c.partitions(spark), "doc_id", "v").withColumn("p", F.spark_partition_id()))
    sums, bases, base = sorted(order.groupBy("p").agg(F.sum("size").alias("n")).collect()), [], 0  # a row of each task
    for p, n in sums:
        bases.append((p, base))
        base += n
    if base >> (63 - LINES - KIND):
        raise ValueError("more texts than places can be numbered for")
    begin = F.sum("size").over(W.partitionBy("p").orderBy("doc_id", "v").rowsBetween(W.unboundedPreceding, -1))
    first = F.col("base") + F.coalesce(begin, F.lit(0).cast("long"))
    out = order.join(F.broadcast(spark.createDataFrame(bases, "p int, base long")), "p").select("doc_id", "v", "size", first.alias("first"))
    out = c.stored(out.select("doc_id", "v", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("size") - 1)).alias("no"), "first"))
    c.free(order)
    return out


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, hasher: Callable[[bytes], int] = line_hash) -> DataFrame:
    """doc_id, v, at, n_run: places of runs of n_run lines that have an earlier copy, in order of (doc_id, v, line); v tells texts of one doc_id apart.

    ``docs`` has doc_id, v and text, none of them null. Lines are equal if their bytes are, whatever ``hasher`` says.
    """
    spark = docs.sparkSession
    c.small_batches(spark)
    n = c.partitions(spark)
    heads = c.stored(docs.select("doc_id", "v", "text").mapInArrow(_hashed(hasher, min_words), "doc_id long, v long, n long, hashes binary, kinds binary").dropDuplicates(["doc_id", "v"]))
    numbers = _numbered(heads)
    spots = c.stored(heads.join(numbers.where("no = first"), ["doc_id", "v"]).select("first", "hashes", "kinds").mapInArrow(_spots, "h long, spot long"))
    often = c.stored(spots.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    places = c.joined(spots, often, "h", spots.count())
    held, log2 = c.filter_of(often.select("h"))
    shared = spark.sparkContext.broadcast(held)
    clash = c.stored(c.exchanged(docs.select("text").mapInArrow(_repeated(hasher, n, shared, log2), c.PACKED), n).mapInArrow(c.by_bucket(_clashes), "h long, link int, line binary"))
    place = F.shiftright("spot", KIND)
    if clash.isEmpty():
        rows = places.select(F.col("h").alias("k1"), F.lit(0).cast("long").alias("k2"), "spot")
    else:
        held, log2 = c.filter_of(clash.select("h").distinct())
        lines = docs.select("doc_id", "v", "text").mapInArrow(_lines_of(hasher, spark.sparkContext.broadcast(held), log2), "doc_id long, v long, at long, h long, line binary")
        links = lines.join(clash, ["h", "line"]).join(numbers.where("no = first"), ["doc_id", "v"]).select((F.shiftleft("first", LINES) + F.col("at")).alias("place"), "link").distinct()
        rows = places.withColumn("place", place).join(links, "place", "left").select(F.col("h").alias("k1"), F.coalesce("link", F.lit(0)).cast("long").alias("k2"), "spot")
    first = names = ranked(rows)
    c.free(heads, spots, often, clash)
    for step in _doubled(min_lines):
        # A place without a line follows each text, so no prefix reaches into the next one.
        on = names.select((F.shiftright("spot", KIND) - step).alias("place"), F.col("rank").alias("k2"), F.col("spot").bitwiseAND(BLANK).alias("blank"))
        pairs = names.withColumn("place", place).join(on, "place")
        spot = F.shiftleft(place, KIND).bitwiseOR(F.col("spot").bitwiseAND(F.col("blank")))
        two = ranked(pairs.select(F.col("rank").alias("k1"), "k2", spot.alias("spot")))
        if names is not first:
            c.free(names)
        names = two
    copies = names.where("copy").where(F.col("spot").bitwiseAND(BLANK) == 0).select(place.alias("place"), F.lit(min_lines).alias("n_run"))
    if min_lines > 1:
        copies = copies.unionAll(first.where("copy").where(F.col("spot").bitwiseAND(LONG) != 0).select(place.alias("place"), F.lit(1).alias("n_run")))
    copies = copies.withColumn("no", F.shiftright("place", LINES)).join(numbers, "no")
    out = c.stored(copies.select("doc_id", "v", (F.col("place") - F.shiftleft("first", LINES)).cast("int").alias("at"), "n_run"))
    c.free(numbers, first, *([names] if names is not first else []))
    return out


def maximal_runs(copies: DataFrame) -> DataFrame:
    """doc_id, v, runs: the text's maximal runs of lines that copies cover, as array<struct<start, end>> in order."""
    text = W.partitionBy("doc_id", "v")
    ends = copies.groupBy("doc_id", "v", "at").agg(F.max("n_run").alias("n_run")).withColumn("end", F.col("at") + F.col("n_run"))
    reach = F.max("end").over(text.orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    runs = ends.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("at")).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(text.orderBy("at"))).groupBy("doc_id", "v", "run").agg(F.min("at").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc_id", "v").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, hasher: Callable[[bytes], int] = line_hash) -> DataFrame:
    """Delete later copies of repeated runs of at least min_lines lines, and of lines of at least min_words words.

    ``docs`` needs doc_id and text. Returns all columns of docs with the lines that remain in text,
    and n_lines, n_removed. Order is by doc_id, then line, across and within documents; copies may overlap.
    Runs of blank lines only don't count. A null text stays null (0 lines); an empty one is one blank line.
    Texts that lose all lines become empty. Rows of a null doc_id neither lose lines nor cause it. Rows
    that repeat a doc_id and its text are one text and lose the same lines; other texts of that doc_id are texts of their own.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be 1 at least")
    own = F.xxhash64(F.col("text").cast("string"), F.length(F.col("text").cast("string")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("v"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    gone = maximal_runs(repeated_lines(texts, min_lines, min_words, hasher))
    # All columns of docs travel in one struct, so none of their names can clash with those used here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("v"))
    out = rows.join(gone.hint("merge"), ["doc_id", "v"], "left")  # a plan that is the same at every size
    lines = F.split(F.col("row")["text"].cast("string"), "\n", -1)  # after the join, which would else move texts twice
    starts = F.concat(F.array(F.lit(0)), F.transform("runs", lambda x: x["end"]))
    ends = F.concat(F.transform("runs", lambda x: x["start"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
    size = F.aggregate("runs", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    cut, none = F.col("runs").isNotNull(), F.lit(0).cast("long")
    made = {
        "text": F.when(cut, F.array_join(kept, "\n")).otherwise(F.col("row")["text"]),
        "n_lines": F.when(F.col("row")["text"].isNull(), none).otherwise(F.size(lines).cast("long")),
        "n_removed": F.when(cut, size.cast("long")).otherwise(none),
    }
    names = [x for x in docs.columns if x not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    return out.select(*[made.get(x, F.col("row")[x]).alias(x) for x in names])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = rf"""
with l as (select doc_id, string_split(text, chr(10)) as v from documents where text is not null),
p as (select doc_id, v, unnest(range(len(v) - {MIN_LINES} + 1)) as spot from l where len(v) >= {MIN_LINES}),
o as (select doc_id, v, unnest(range(len(v))) as spot from l),
w as (select doc_id, spot, list_slice(v, spot + 1, spot + {MIN_LINES}) as run from p
  union all select doc_id, spot, [v[spot + 1]] from o where len(list_filter(string_split(v[spot + 1], ' '), lambda x: x <> '')) >= {MIN_WORDS}),
f as (select *, row_number() over (partition by run order by doc_id, spot) as k from w where len(list_filter(run, lambda x: trim(x, ' ') <> '')) > 0),
g as (select doc_id, list_distinct(flatten(list(range(spot, spot + len(run))))) as gone from f where k > 1 group by doc_id)
select d.doc_id, case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as n_lines,
  coalesce(len(g.gone), 0) as n_removed,
  sha256(coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: not coalesce(list_contains(g.gone, i - 1), false)), chr(10)), '')) as text_sha256
from documents d left join g using (doc_id)
"""
