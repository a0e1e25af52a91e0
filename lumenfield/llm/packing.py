"""Packing of token sequences by minimum bin slack.

What decides a packing is how many pieces there are of each length: 2048 numbers at most, whatever the
corpus. On them, bin by bin, a bitset subset-sum finds the fullest combination with the longest piece
left; it is used as often as its lengths last, and removed. Tasks number their pieces of each length, the
numbers that tasks begin at follow from their counts, so no piece is sorted and a frequent length is no hot
key; pieces are then looked up in the table of combinations.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lumenfield.llm import bytesx as bx
from lumenfield.llm import common as c

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END = 0
#: Rows of (length, task) that are broadcast at most, of some 100 bytes each.
BEGINS = 200_000
PIECE = "doc_id long, piece int, start long, length long, ids binary"
#: A task's number, and a piece's among those of its length in the task.
PART, N = "__part", "__n"
NUMBERS = f", {PART} int, {N} long"
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
#: Words, and parts of words, in each generation of what a worker remembers; bytes of the longest one it remembers.
HELD, LONG = 400_000, 48
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Texts encoded at once, and about the characters of them; longer texts are cut before white space.
TEXTS, CHARS = 512, 1 << 20
_WHITE = re.compile("[\t-\r ]")
#: Parts encoded at once.
JOINED = 500
_PART = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^0-9a-z\x80-\xff]+")
#: Letters of Latin-1, which are composed and lower-cased one to one.
_LATIN = re.compile("[\\x00-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")


def _plain(word: str) -> bool:
    """Whether all beyond ASCII are composed letters, in upper and in lower case."""
    if _LATIN.fullmatch(word):
        return True
    low = word.lower()
    return len(low) == len(word) and unicodedata.is_normalized("NFC", word) and all(x.isalpha() for x in word + low if x > "\x7f")


def parts(text: str) -> Iterator[str]:
    """The text, cut before ASCII white space into parts of about CHARS characters: the tokenizer drops it and never joins across it."""
    at = 0
    while len(text) - at > CHARS and (m := _WHITE.search(text, at + CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def groups(texts: list[str], rows: int) -> Iterator[slice]:
    """Runs of texts of rows at most, and of about CHARS characters; a longer text stands alone."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and (i - first == rows or size + len(t) > CHARS):
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    if texts:
        yield slice(first, len(texts))


class Memory:
    """A bounded dict: when the young generation is full it becomes the old one, and what is used moves up again."""

    def __init__(self) -> None:
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def missing(self, keys: set[bytes]) -> list[bytes]:
        """Those not held; those in the old generation become young."""
        if len(self.young) > HELD:
            self.young, self.old = {}, self.young
        out = []
        for k in keys.difference(self.young):
            if (v := self.old.get(k)) is None:
                out.append(k)
            else:
                self.young[k] = v
        return out


class Words:
    """Token ids by word, cut at ASCII white space: the tokenizer drops it and never joins across it.

    Words are lower-cased first, as the tokenizer does. A plain word, of composed letters, digits and ASCII
    marks without an apostrophe, is cut into parts that are each one unit of the tokenizer's own pattern. New
    parts are encoded many at once, with spaces between, and told apart by the ids that end a unit. All
    other words are encoded by themselves.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words, self.parts = Memory(), Memory()

    def alone(self, words: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def together(self, parts: list[bytes]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(parts).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(parts):
            return self.alone(parts)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not held; the longest of them are returned, the others held."""
        cut, odd = {}, []
        for w in words:
            if w.isalpha():  # ASCII letters only
                cut[w] = (w,)
            elif b"'" in w or not (w.isascii() or _plain(w.decode())):
                odd.append(w)
            else:
                cut[w] = _PART.findall(w)
        wanted = {p for ps in cut.values() for p in ps}
        new = self.parts.missing(wanted)
        young = self.parts.young
        for i in range(0, len(new), JOINED):
            young.update(zip(new[i : i + JOINED], self.together(new[i : i + JOINED]), strict=True))
        long, held = {}, self.words.young
        for w, ps in cut.items():
            (held if len(w) <= LONG else long)[w] = b"".join([young[p] for p in ps])
        for p in [p for p in new if len(p) > LONG]:
            del young[p]
        for w, ids in zip(odd, self.alone(odd), strict=True):
            (held if len(w) <= LONG else long)[w] = ids
        return long

    def units(self, units: list[bytes]) -> dict[bytes, bytes]:
        """Ids of runs of one kind, each a unit of the pattern, or words with an apostrophe; the longest are returned, the others held."""
        new = self.words.missing(set(units))
        long, held = {}, self.words.young
        odd = [u for u in new if b"'" in u]
        if odd:
            new = [u for u in new if b"'" not in u]
        for some, encode in [(new[i : i + JOINED], self.together) for i in range(0, len(new), JOINED)] + [(odd, self.alone)] * bool(odd):
            for u, ids in zip(some, encode(some), strict=True):
                (held if len(u) <= LONG else long)[u] = ids
        return long

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [(i, part) for i, t in enumerate(texts) for part in parts(t)]
        out: list[list[bytes]] = [[] for _ in texts]
        for some in groups([part for _, part in cut], len(cut)):
            for (i, _), ids in zip(cut[some], self.each([part for _, part in cut[some]]), strict=True):
                out[i].append(ids)
        return [b"".join(x) for x in out]

    def each(self, texts: list[str]) -> list[bytes]:
        """As ids(), of all texts at once."""
        whole, fine, coarse = [], [], []
        for i, t in enumerate(texts):
            # What a special token may be in, or is not in the normal form NFC, is encoded as a whole.
            latin = t.isascii() or _LATIN.fullmatch(t)
            (whole if "<|" in t or not (latin or unicodedata.is_normalized("NFC", t)) else fine if latin else coarse).append(i)
        out = [b""] * len(texts)
        for i, ids in zip(whole, self.alone([texts[i].encode() for i in whole]), strict=True):
            out[i] = ids
        for group, cut, learn in ((fine, _kinds, self.units), (coarse, lambda part: ~_SPACE[part] * np.uint8(1), lambda words: self.learn(self.words.missing(set(words))))):
            for i, ids in zip(group, self.looked_up([texts[i].encode().lower() for i in group], cut, learn), strict=True):
                out[i] = ids
        return out

    def looked_up(self, raw: list[bytes], cut, learn) -> Iterator[bytes]:
        """Ids of each text by its runs of one kind, 0 being white space. Hashes tell runs apart, so each distinct one is looked up once."""
        off = np.append(0, np.cumsum([len(x) + 1 for x in raw]))
        buf = b"\n".join(raw) + b"\n"
        for first, part, poff in bx.chunks(np.frombuffer(buf, np.uint8) if raw else np.zeros(0, np.uint8), off, 1 << 20):
            kind = cut(part)
            edge = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
            starts = np.flatnonzero(edge & (kind > 0))
            bounds = np.append(np.flatnonzero(edge), len(part))
            ends = bounds[np.searchsorted(bounds, starts) + 1] if len(starts) else starts
            _, one, code = np.unique(bx.run_hashes(part, starts, ends), return_index=True, return_inverse=True)
            at = int(off[first])
            words = [buf[a:b] for a, b in zip((starts[one] + at).tolist(), (ends[one] + at).tolist(), strict=True)]
            long, held = learn(words), self.words.young
            each = [long[w] if w in long else held[w] for w in words] if long else list(map(held.__getitem__, words))
            size = np.fromiter(map(len, each), np.int64, len(each)) // 4
            begin = np.cumsum(size) - size
            total = np.cumsum(size[code])
            ids = np.frombuffer(b"".join(each), "<u4")[np.repeat(begin[code] - total + size[code], size[code]) + np.arange(total[-1] if len(total) else 0)].tobytes()
            at = 4 * np.append(0, total)[np.searchsorted(starts, poff)]
            for k in range(len(poff) - 1):
                yield ids[at[k] : at[k + 1]]


#: Kinds of bytes: white space, letters, digits (each stands alone), marks, and words with an apostrophe.
LETTER, DIGIT, MARK, QUOTED = 1, 2, 3, 4
_KIND = np.full(256, MARK, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = DIGIT
_KIND[97:123] = _KIND[65:91] = _KIND[128:] = LETTER


def _kinds(part: np.ndarray) -> np.ndarray:
    kind = _KIND[part]
    if (quotes := np.flatnonzero(part == 39)).size:
        edge = np.flatnonzero(np.append(True, (kind[1:] == 0) != (kind[:-1] == 0)))
        left = np.searchsorted(edge, quotes, "right") - 1
        for a, b in {(int(edge[k]), int(edge[k + 1]) if k + 1 < len(edge) else len(part)) for k in left}:
            kind[a:b] = QUOTED
    return kind


_words: dict[str, Words] = {}


def _pieces(path: str, capacity: int, end: int, numbered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words.get(path) or Words(path)
        _words[path] = words
        last = np.array([end], "<u4").tobytes()
        part, met = TaskContext.get().partitionId() if numbered else 0, Counter()
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for some in groups(texts, TEXTS):
                out = ([], [], [], [], [])
                for doc, ids in zip(docs[some], words.ids(texts[some]), strict=True):
                    ids += last
                    for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                        piece = ids[4 * at : 4 * (at + capacity)]
                        for col, x in zip(out, (doc, k, at, len(piece) // 4, piece), strict=True):
                            col.append(x)
                cols = [pa.array(x, t) for x, t in zip(out, _PIECE.types, strict=True)]
                if not numbered:
                    yield pa.RecordBatch.from_arrays(cols, schema=_PIECE)
                    continue
                n = _numbers(np.array(out[3], np.int64), met)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(n), part, np.int32)), pa.array(n)], names=[*_PIECE.names, PART, N])

    return run


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def tokenized(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, numbered: bool = False) -> DataFrame:
    """Pieces of capacity tokens at most: doc_id, piece, start, length, ids (little-endian unsigned 32-bit).

    ``docs`` needs doc_id and text; other columns are ignored. Each text's ids are followed by ``end``; null
    counts as empty, so it is one piece of that id alone. Only texts with more ids than capacity are cut.
    Repeated rows are pieces of their own; an empty table has no pieces. ``path`` is a tokenizers file.
    With ``numbered`` two more columns spare packed() a pass through Python; no row may be dropped, repeated or moved before it.
    """
    c.small_batches(docs.sparkSession, TEXTS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        c.trimmed(_pieces(path or tokenizer_path(), capacity, end, numbered)), PIECE + NUMBERS * numbered
    )


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of a combination of the available lengths that fills room best, with long pieces first."""
    reach, steps = 1, []
    full = (1 << (room + 1)) - 1
    for size in sorted((s for s in counts if s <= room), reverse=True):
        left, take = min(counts[size], room // size), 1
        while left > 0:
            now = min(take, left)
            steps.append((reach, size, now))
            reach |= (reach << (size * now)) & full
            left -= now
            take *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    out: dict[int, int] = {}
    for before, size, now in reversed(steps):
        if not before >> at & 1:  # reached only with this step
            out[size] = out.get(size, 0) + now
            at -= size * now
    return list(out.items())


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, pieces in each)]) until no piece is left."""
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    out = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        combo = {longest: 1}
        for s, n in fullest({s: n for s, n in rest.items() if n > 0}, capacity - longest):
            combo[s] = combo.get(s, 0) + n
        times = min(left[s] // n for s, n in combo.items())
        out.append((times, sorted(combo.items(), reverse=True)))
        for s, n in combo.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
    return out


def _places(table: list[tuple[int, list[tuple[int, int]]]], names: list[str]):
    """For each length the ranks at which its share of a combination begins, and what is there."""
    rows, base, used = [], 0, {}
    for times, combo in table:
        at = 0
        for size, each in combo:
            rows.append((size, used.get(size, 0), each, base, at))
            used[size] = used.get(size, 0) + times * each
            at += size * each
        base += times
    rows.sort()
    size, first, each, base_, at_ = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = size << 44 | first  # ranks are below 2**44
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "__rank"))
            i = np.searchsorted(key, length << 44 | rank, "right") - 1
            r = rank - first[i]
            cols = [b.column(b.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(base_[i] + r // each[i]), pa.array(at_[i] + r % each[i] * length)], names=[*names, "sequence_id", "offset"])

    return run


def _numbers(length: np.ndarray, met: Counter) -> np.ndarray:
    """Each one's number among those of its length, after the ones met before."""
    order = np.argsort(length, kind="stable")
    sizes, first, each = np.unique(length[order], return_index=True, return_counts=True)
    n = np.empty(len(length), np.int64)
    n[order] = np.arange(len(length)) - np.repeat(first - np.array([met[x] for x in sizes.tolist()], np.int64), each)
    met.update(dict(zip(sizes.tolist(), each.tolist(), strict=True)))
    return n


def _numbered(names: list[str]):
    """The rows with the task's number, and each one's number among those of its length in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), Counter()
        for b in batches:
            n = _numbers(b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64), met)
            cols = [b.column(b.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(n), part, np.int32)), pa.array(n)], names=[*names, PART, N])

    return run


def packed(pieces: DataFrame, capacity: int = CAPACITY, most: int = BEGINS) -> DataFrame:
    """pieces with sequence_id and offset: sequences without gaps, of capacity at most, as few as the method finds.

    ``pieces`` has length (1 to capacity); columns named sequence_id and offset are replaced, all others kept.
    Pieces of one length take their places in order of tasks, and of rows in a task. No piece gives no sequence.
    Numbers of tasks are broadcast up to ``most`` rows, which changes no result.
    """
    pieces = pieces.drop("sequence_id", "offset")
    fields = [f for f in pieces.schema.fields if f.name not in (PART, N)]
    names, schema = [f.name for f in fields], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    numbered = c.stored(pieces if {PART, N} <= set(pieces.columns) else pieces.select(*names).mapInArrow(_numbered(names), schema + NUMBERS))
    sizes = c.stored(numbered.groupBy("length", "__part").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    begin = c.stored(sizes.select("length", "__part", F.coalesce(before, F.lit(0).cast("long")).alias("__begin")))
    # A row for each length in each task; beyond ``most`` of them both sides are shuffled by length and task.
    begin = F.broadcast(begin) if begin.count() <= most else begin.hint("merge")
    ranked = numbered.join(begin, ["length", "__part"]).select(*names, (F.col("__begin") + F.col("__n")).alias("__rank"))
    return ranked.mapInArrow(_places(combinations(counts, capacity), names), schema + ", sequence_id long, offset long")


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    pieces = tokenized(c.table(spark, sf_dir, "documents"), numbered=True).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
