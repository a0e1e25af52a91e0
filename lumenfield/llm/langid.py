"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one filter for each language in one table: a slot is a bitmask of
languages, so looking up an n-gram's slots and and-ing them gives all languages that contain it at once.
For each text and language the hits are counted (a popcount of the language's bit over the text's
n-grams), corrected for the hits that the filter's fill alone would give, and the largest count decides.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenfield.llm import bytesx as bx
from lumenfield.llm import common as c

U = np.uint64
GRAM = 6
#: Training texts of one language at most, about; those with the least hashes of doc_id.
TEXTS = 4000
#: Slots of the table, and probes for each n-gram.
SLOTS_LOG2, PROBES = 21, 2
#: An n-gram belongs to each language whose training texts have it this often.
LEAST = 2
UNKNOWN = "und"
#: Bytes whose n-grams are made at once; n-grams that a task counts before it sends them on.
STEP, HELD = 1 << 19, 1 << 21

_NORMAL = np.full(256, 32, np.uint8)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram as a number) of the GRAM-byte strings in texts, letters lower-cased and other ASCII as space.

    Those with two spaces in a row say nothing and are left out.
    """
    low = _NORMAL[buf]
    n = len(low) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = low[:n].astype(np.uint64)
    pairs = (low[:-1] == 32) & (low[1:] == 32)
    ok = ~pairs[:n]
    for k in range(1, GRAM):
        g = (g << U(8)) | low[k : n + k]
        ok &= ~pairs[k : n + k] if k < GRAM - 1 else True
    for k in range(1, GRAM):  # strings that reach into the next text
        last = off[1:-1] - k
        ok[last[(last >= 0) & (last < n)]] = False
    at = np.flatnonzero(ok)
    return np.searchsorted(off, at, "right") - 1, g[at]


def steps(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """grams() of all texts, each once, some STEP bytes at a time: one text may be longer than memory has room for its n-grams."""
    for a in range(0, max(len(buf) - GRAM + 1, 0), STEP):
        b = min(a + STEP + GRAM - 1, len(buf))
        yield grams(buf[a:b], np.clip(off, a, b) - a)


def slots(g: np.ndarray) -> list[np.ndarray]:
    h = bx.mixed(g.astype(np.uint64) + U(1))
    return [((h >> U(64 - SLOTS_LOG2 * (k + 1))) & U((1 << SLOTS_LOG2) - 1)).astype(np.int64) for k in range(PROBES)]


@dataclass
class Filters:
    """languages; words of 64 language bits for each slot; each language's false-positive rate; the default language."""

    languages: list[str]
    table: np.ndarray
    false: np.ndarray
    default: str

    def count(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, corrected hits of each text and language)."""
        n = len(off) - 1
        total = np.zeros(n, np.int64)
        hits = np.zeros((n, len(self.languages)))
        for row, g in steps(buf, off):
            total += np.bincount(row, minlength=n)
            at = slots(g)
            for w in range(self.table.shape[1]):
                word = self.table[:, w]
                mask = word[at[0]]
                for i in at[1:]:
                    mask = mask & word[i]
                for k in range(64 * w, min(64 * (w + 1), len(self.languages))):
                    hits[:, k] += np.bincount(row, (mask >> mask.dtype.type(k - 64 * w)) & mask.dtype.type(1), n)
        rate = self.false[None, :]
        return total, np.maximum(0, (hits - total[:, None] * rate) / (1 - rate))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        langs, scores = [], []
        for first, buf, off in bx.chunks(*bx.flat(texts)):
            _, hits = self.count(buf, off)
            best, sums = hits.argmax(1) if len(self.languages) else None, hits.sum(1)
            for i in range(len(off) - 1):
                text = texts[first + i].as_py()
                if not text or not any(map(str.isalpha, text)) or not self.languages:  # isalpha: the categories L*
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    langs.append(self.languages[best[i]] if sums[i] > 0 else self.default)
                    scores.append(float(hits[i, best[i]] / sums[i]) if sums[i] > 0 else 0.0)
        return langs, np.array(scores)


def build(counts: list[tuple[str, int, int]], sizes: dict[str, int]) -> Filters:
    """Filters from (language, n-gram, count); sizes: training texts by language."""
    held: dict[str, list[int]] = {k: [] for k in sizes}
    for lang, g, n in counts:
        if n >= LEAST:
            held[lang].append(g)
    return filters({k: [np.array(v, np.uint64)] for k, v in held.items()}, sizes)


def filters(held: dict[str, list[np.ndarray]], sizes: dict[str, int]) -> Filters:
    """Filters from the n-grams of each language."""
    languages = sorted(sizes)
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    table = np.zeros((1 << SLOTS_LOG2, -(-len(languages) // 64) or 1), kind)
    for k, lang in enumerate(languages):
        for g in held.get(lang, []):
            for i in slots(g):
                table[i, k // 64] |= kind(1 << (k % 64))
    fill = np.array([((table[:, k // 64] >> kind(k % 64)) & kind(1)).mean() for k in range(len(languages))])
    return Filters(languages, table, np.minimum(fill**PROBES, 0.99), max(languages, key=lambda x: (sizes[x], x), default=UNKNOWN))


def summed(parts: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of parts, in order, and the sum of each one's counts."""
    g, at = np.unique(np.concatenate([x["g"] for x in parts]), return_inverse=True)
    n = np.zeros(len(g), np.int64)
    np.add.at(n, at, np.concatenate([x["n"] for x in parts]))
    return g, n


def _gram_counts(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of n-grams by (number of the language, text), packed by bucket and language."""

    def sent(held: dict[int, list[dict[str, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for k, parts in sorted(held.items()):
            g, many = summed(parts)
            yield from c.packed_rows((b, k, c.pack(g=g[i], n=many[i])) for b, i in c.split_by(c.bucket_of(g, n), n))
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for b in batches:
            kinds = b.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(kinds).tolist():
                part = b.column(1).take(pa.array(np.flatnonzero(kinds == k)))
                for _, g in steps(*bx.flat(part)):
                    g, many = np.unique(g, return_counts=True)
                    held.setdefault(k, []).append({"g": g, "n": many})
                    size += len(g)
                    if size > HELD:
                        yield from sent(held)
                        size = 0
        yield from sent(held)

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams that a language has often enough, packed as they came."""
    rows = (r for x in batches for r in zip(*(x.column(i).to_pylist() for i in range(3)), strict=True))
    for (bucket, k), group in itertools.groupby(rows, key=lambda r: r[:2]):
        g, n = summed([c.unpack(p) for _, _, p in group])
        yield from c.packed_rows([(bucket, k, c.pack(g=g[n >= LEAST]))])


def learn(docs: DataFrame, texts: int = TEXTS) -> Filters:
    """Filters from the text and lang of docs, both not null; about ``texts`` of a language at most, of which all n-grams count."""
    c.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return build([], {})
    languages = sorted(sizes)
    share = docs.sparkSession.createDataFrame([(x, k, min(1.0, texts / sizes[x])) for k, x in enumerate(languages)], "lang string, kind int, share double")
    # A row for each language is broadcast.
    pick = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= F.col("share") * (1 << 30)).select("kind", "text")
    n = min(c.partitions(docs.sparkSession), c.SLICES)
    held: dict[str, list[np.ndarray]] = {}
    for r in c.exchanged(pick.mapInArrow(c.trimmed(_gram_counts(n)), c.PACKED), n).mapInArrow(c.trimmed(_frequent), c.PACKED).collect():  # the sample's n-grams, eight bytes each at most
        held.setdefault(languages[r["kind"]], []).append(c.unpack(bytes(r["payload"]))["g"])
    return filters(held, sizes)


def _predictions(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: Filters = pickle.loads(shared.value)
        for b in batches:
            langs, scores = filters.predict(b.column(b.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs with lang_pred and score, the share of the largest corrected count.

    Columns of these names are replaced and all others kept. A text that is null, empty or without a letter
    gets ``und`` and 0, as all do if no language was learned. A text whose n-grams no filter has gets the
    language with most training texts and 0; a tie goes to the language first in order.
    """
    c.small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(filters))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields) + "lang_pred string, score double"
    return docs.mapInArrow(c.trimmed(_predictions(shared)), schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = c.table(spark, sf_dir, "documents").withColumn("held_out", held)
    filters = learn(docs.where("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), filters).drop("text")
