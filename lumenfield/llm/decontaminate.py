"""Benchmark decontamination with an Aho-Corasick automaton over normalised test questions and answers."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenfield.llm import common as c

#: Bytes of a word: a-z, 0-9 and all beyond ASCII once A-Z are lower-cased; others become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 13
#: Bytes of benchmark text for one automaton, whose nodes are some dozen times that; a larger benchmark has several, one in memory at a time.
AUTOMATON_BYTES = 1 << 18
#: Bytes of documents that a task holds while several automata take turns.
CHUNK_BYTES = 1 << 26
#: A document is contaminated if at least this share of its words is hit.
SHARE = (1, 20)

HITS = "doc_id long, n_words long, n_hit long, words binary, items array<long>, spans array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("words", pa.binary()), ("items", pa.list_(pa.int64())), ("spans", _SPANS)])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def automaton(items: list[tuple[int, str | None]], window: int) -> tuple[ahocorasick.Automaton | None, list[list[int]], list[int]]:
    """(automaton, item_ids of each pattern, words of each pattern) over the windows of the items."""
    found: dict[bytes, set[int]] = defaultdict(set)
    for i, text in items:
        ws = words(text)
        for k in range(max(1, len(ws) - window + 1) if ws else 0):
            found[b" ".join(ws[k : k + window])].add(i)
    a = ahocorasick.Automaton()
    owners, sizes = [], []
    for k, (w, ids) in enumerate(found.items()):
        a.add_word(f" {w.decode('utf-8', 'surrogateescape')} ", k)
        owners.append(sorted(ids))
        sizes.append(w.count(b" ") + 1)
    if not found:
        return None, owners, sizes
    a.make_automaton()
    return a, owners, sizes


def _scan(shared, window: int):
    """A row for each row, with its columns after doc_id and text, whatever the number of automata: they take turns over some texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        only = automaton(blocks[0], window) if len(blocks) == 1 else None
        for held in _chunks(batches, 0 if only else CHUNK_BYTES):
            texts = [b.column(1).to_pylist() for b in held]
            hits = [[(None, set())] * len(t) for t in texts]
            for block in blocks:
                auto = only or automaton(block, window)
                hits = [[_either(h, found(t, *auto)) for h, t in zip(x, y, strict=True)] for x, y in zip(hits, texts, strict=True)]
            for b, t, h in zip(held, texts, hits, strict=True):
                rows = [(d, *told(x, *y)) for d, x, y in zip(b.column(0).to_pylist(), t, h, strict=True)]
                cols = zip(*rows, strict=True) if rows else [[]] * len(_HITS)
                rest = range(2, b.num_columns)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(cols, _HITS.types, strict=True)), *(b.column(k) for k in rest)], names=[*_HITS.names, *(b.schema.names[k] for k in rest)])

    return run


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.nbytes
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def found(text: str | None, auto, owners: list[list[int]], sizes: list[int]) -> tuple[np.ndarray | None, set[int]]:
    """(which words are hit or None, item_ids)."""
    ws = words(text)
    if auto is None or not ws:
        return None, set()
    joined = f" {b' '.join(ws).decode('utf-8', 'surrogateescape')} "
    ends = list(auto.iter(joined))
    if not ends:
        return None, set()
    hit = np.zeros(len(ws), bool)
    items: set[int] = set()
    gaps = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4") == 32)  # the space after word k is gaps[k + 1]
    for at, k in ends:
        last = int(np.searchsorted(gaps, at))
        hit[last - sizes[k] : last] = True
        items.update(owners[k])
    return hit, items


def _either(x: tuple[np.ndarray | None, set[int]], y: tuple[np.ndarray | None, set[int]]) -> tuple[np.ndarray | None, set[int]]:
    """What one of two automata hits in a text."""
    if x[0] is None or y[0] is None:
        return y if x[0] is None else x
    return x[0] | y[0], x[1] | y[1]


def told(text: str | None, hit: np.ndarray | None, items: set[int]):
    """(number of words, of hit words, their bits or None, item_ids, spans of hit words in the text's characters)."""
    low = (text or "").encode().translate(_TABLE)
    if hit is None:
        return len(low.split()), 0, None, [], []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    place = [m.span() for m in _WORD.finditer(low)]
    chars = np.cumsum((np.frombuffer(low, np.uint8) & 0xC0) != 0x80)  # code points up to each byte
    spans = [(int(chars[place[a][0]]) - 1, int(chars[place[b - 1][1] - 1])) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return len(hit), int(hit.sum()), np.packbits(hit).tobytes(), sorted(items), [{"start": s, "end": e} for s, e in spans]


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Where windows of benchmark items occur in documents.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored. A window is
    ``window`` consecutive words of an item, or a shorter item as a whole. Returns for each row of docs its
    doc_id, n_words, hit words (n_hit, and words: their bits), items (item_ids whose windows occur),
    spans (of hit words in the original text's characters), and in the struct row the columns to ``keep``. A null or
    empty text has no words; an item without words has no window; items that repeat count once; an empty
    benchmark hits nothing. Rows of a repeated or null doc_id come back one by one, each with the hits of its own
    text. None of this depends on the benchmark's size.
    """
    spark = docs.sparkSession
    c.small_batches(spark)
    rest = [F.struct(*keep).alias("row")] if keep else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // AUTOMATON_BYTES) or 1
    blocks = [[] for _ in range(n)]
    for k, *item in items.select(F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"), "item_id", "text").toLocalIterator():
        blocks[k].append(tuple(item))
    schema = HITS + (f", row {docs.schema['row'].dataType.simpleString()}" if keep else "")
    return docs.mapInArrow(_scan(spark.sparkContext.broadcast(blocks), window), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """find_hits() and contaminated: some word is hit, and a twentieth of the words at least."""
    return find_hits(docs, benchmark, window, keep).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE[1] >= F.col("n_words") * SHARE[0]))


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract word for word, for tests."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = []
    for i, t in items:
        w = cut(t)
        found += [(i, w[k : k + window]) for k in range(len(w) - window + 1)] if len(w) >= window else [(i, w)] if w else []
    out = []
    for d, t in docs:
        w = cut(t)
        hit, ids = set(), set()
        for i, x in found:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    ids.add(i)
        sha = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out
