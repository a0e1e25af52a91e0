"""The index of exact dedup and the ranks of line dedup: what they decide, with hashes that decide nothing."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.llm import exact, lines
from tests.llm.test_text_operators import brute_lines, tuples


def test_equal_keys_and_digests_of_different_texts(spark):
    """All keys and digests are alike, so only the owners' chains can tell texts apart, and they do."""
    rows = [(1, "a b"), (2, "ab"), (3, "c"), (4, None), (5, " \n"), (6, "C"), (6, "C"), (None, "c"), (None, "x" * 100_000), (7, "c c"), (8, "c\tc ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    by = defaultdict(list)
    for d, t in rows:
        by["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), d is None, d))
    want = []
    for members in by.values():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        want += [(d, keep, len(members), d == keep) for _, _, d in members]
    for key in (lambda norm: 7, lambda norm: len(norm) % 16 << 60, exact.key_of):
        got = exact.exact_groups(docs, 2, key, lambda norm: b"same")
        assert tuples(got, "doc_id", "keep_id", "group_size", "kept") == sorted(want, key=repr)


def test_buckets_hold_their_capacity_at_any_depth():
    r = np.random.default_rng(2)
    near = np.uint64(0xABCDEF << 40) + r.integers(0, 1 << 20, 3000, dtype=np.uint64)  # equal in 44 bits
    keys = np.sort(np.concatenate([near, r.integers(0, 1 << 64, 5000, dtype=np.uint64), np.full(50, 5, np.uint64)]))
    starts = exact.bucket_starts(keys, 0, 8)
    assert starts[0] == 0 and starts == sorted(set(starts))
    for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
        assert b - a <= 8 or keys[a] == keys[b - 1]
        assert a == 0 or keys[a - 1] < keys[a]  # one key is in one bucket


def test_index_files_hold_buckets_in_order(spark):
    docs = spark.range(3000).select(F.col("id").alias("row_id"), F.concat(F.lit("t"), F.col("id") % 900).alias("text"))
    entries = docs.repartition(3).mapInArrow(exact._entries(exact.key_of, exact.digest_of), exact.ENTRY)
    pages = exact.index(exact.c.stored(entries), 16)
    sizes = pages.withColumn("file", F.input_file_name()).groupBy("bucket").agg(F.countDistinct("key").alias("k"), F.count("*").alias("n"), F.countDistinct("file").alias("files")).collect()
    assert max(x["files"] for x in sizes) == 1 and max(x["n"] for x in sizes) <= 16 and sum(x["k"] for x in sizes) == 900


@pytest.mark.parametrize("parts", [1, 5])
def test_ranks_over_tasks(spark, parts):
    r = random.Random(3)
    keys = [(r.choice([-9, 1, 1, 1, 5]), r.choice([0, 0, 2])) for _ in range(400)]
    rows = [(a, b, k) for k, (a, b) in enumerate(keys)]
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts * 4)
    try:
        got = {x["spot"]: (x["rank"], x["copy"]) for x in lines.ranked(spark.createDataFrame([*rows, (77, 0, 10**6)], "k1 long, k2 long, spot long")).collect()}
        none = lines.ranked(spark.createDataFrame([], "k1 long, k2 long, spot long")).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(keys)
    assert got == {k: (order.index(x), k != keys.index(x)) for k, x in enumerate(keys)} and none == 0


@pytest.mark.parametrize("k", range(1, 10))
def test_runs_of_one_to_nine_lines(spark, k):
    r = random.Random(k)
    texts = ["\n".join(r.choice(["a", "b", "c", "", " ", f"u{i}{j}"]) for j in range(r.randrange(1, 25))) for i in range(25)]
    rows = list(enumerate([*texts, texts[0], texts[1] + "\n" + texts[2], None, "", "\n\n\n", "a\n" * 60]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hasher = lines.line_hash if k % 2 else lambda line: len(line) % 2  # hashes that clash: bytes decide
    assert tuples(lines.dedup_lines(docs, k, 50, hasher), "doc_id", "text", "n_removed") == brute_lines(rows, k)


def test_rows_of_repeated_and_null_ids(spark):
    """Repeats of a row lose alike; other texts of its doc_id are texts of their own; rows of a null one stay and cause nothing."""
    two = "x y\nz"
    rows = [(None, two), (1, f"p\n{two}"), (2, f"{two}\nq"), (2, f"{two}\nq"), (2, f"r\n{two}"), (None, two), (3, None)]
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_lines int").repartition(2)
    got = tuples(lines.dedup_lines(docs), "doc_id", "text")
    assert got == sorted([(None, two), (None, two), (1, f"p\n{two}"), (2, "q"), (2, "q"), (2, "r"), (3, None)], key=repr)


def test_maximal_runs(spark):
    copies = spark.createDataFrame([(1, 0, 4, 2), (1, 0, 5, 2), (1, 0, 0, 1), (1, 0, 9, 3), (1, 0, 7, 1), (1, 0, 1, 1)], "doc_id long, v long, at int, n_run int")
    assert [(x["start"], x["end"]) for x in lines.maximal_runs(copies).first()["runs"]] == [(0, 2), (4, 8), (9, 12)]


def test_very_long_text(spark):
    """A text of some 20 MB and 300,000 lines among others."""
    long = "\n".join(f"line {k % 150_000} of a long text, with words to make it long enough" for k in range(300_000))
    docs = spark.createDataFrame([(1, "a"), (2, long), (3, "line 5 of a long text, with words to make it long enough\nline 6 of a long text, with words to make it long enough")], "doc_id long, text string")
    got = {x["doc_id"]: x["n_removed"] for x in lines.dedup_lines(docs).select("doc_id", "n_removed").collect()}
    assert got == {1: 0, 2: 150_000, 3: 2}
