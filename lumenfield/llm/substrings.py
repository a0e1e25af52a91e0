"""Removal of repeated byte strings with a sparse, range-partitioned suffix array.

A suffix array over every byte would move fifty bytes for each byte of text. Here only suffixes at
*anchors* are sorted: in each ``span``-byte string the least hash among its ``gram``-byte strings is
its anchor, so equal strings have the same anchor at the same place. Four exchanges, one plan:

1. each text's anchor hashes meet by hash; those that two texts share go back to their texts;
2. texts cut the strings of shared anchors out as windows, equal windows of a bucket are merged, and
   sampled splitters range-partition them by the bytes that lead the anchor's suffix;
3. each range sorts its suffixes by multikey sort; neighbours with equal leading bytes form a class.
   A splitter is as long as the leading bytes and equal ones fall on one side, so no class crosses a
   boundary. In a class, strings are compared byte by byte and the smallest doc_id keeps each;
4. what is to go meets the texts again.

Hot strings: a bucket sends each distinct window once, so a passage in a third of all texts reaches
its range from each bucket, not from each text. Hot leads: where the bytes that lead a suffix are a
partition's share of the sampled ones or more, their many different windows would be one task's class. Such
anchors don't meet in the first exchange but always count as shared, and their windows are taken
apart into strings, each of which goes by its own hash. The sample decides about places only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenfield.llm import bytesx as bx
from lumenfield.llm import common as c

U = np.uint64
#: Fingerprint bits of an anchor that meet in the first exchange; windows are compared by bytes later.
BITS = 40
#: Kinds of packed rows.
TEXT, SHARED, WINDOW, GONE, STRING = 0, 1, 2, 3, 4
#: Windows that a task merges and sends at once.
WINDOWS = 1 << 16
#: Texts sampled at most for the splitters, which decide about balance only.
SPLITTER_TEXTS = 1000
#: Times that leading bytes stand in the sample at least if they are hot; windows that are taken apart at once.
HOT_LEADS, APART = 8, 1 << 13

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def minima(buf: np.ndarray, off: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram hashes, and for each start of a span-byte string inside a text the least in it, 0 elsewhere."""
    n, w = len(buf), span - gram + 1
    least = np.zeros(n, np.uint64)
    if n < span:
        return np.zeros(n, np.uint64), least
    h = bx.gram_hashes(buf, gram)
    m = bx.sliding(np.minimum, h, w)
    ok = np.zeros(n + 1, np.int32)  # +1 where starts begin, -1 where they end
    size = np.diff(off)
    full = size >= span
    np.add.at(ok, off[:-1][full], 1)
    np.add.at(ok, off[1:][full] - span + 1, -1)
    valid = np.cumsum(ok[:n]) > 0
    least[: len(m)] = m
    least[~valid] = 0
    return h, least


def segments(least: np.ndarray, off: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and counts of the runs of equal minima, cut after most starts and at text ends."""
    change = np.ones(len(least), bool)
    change[1:] = least[1:] != least[:-1]
    inner = off[:-1][off[:-1] < len(least)]
    change[inner] = True
    start = np.flatnonzero(change)
    size = np.diff(np.append(start, len(least)))
    keep = least[start] > 0
    start, size = start[keep], size[keep]
    pieces = -(-size // most)
    if len(pieces) and pieces.max() > 1:
        which = np.repeat(np.arange(len(start)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, size = start[which] + nth * most, np.minimum(size[which] - nth * most, most)
    return start, size


def meeting(least: np.ndarray) -> np.ndarray:
    """The number under which anchors meet. Least hashes are small ones, so they are mixed again to spread evenly."""
    return bx.mixed(least) >> U(64 - BITS)


def _hot(met: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which numbers of anchors are among the hot ones, which are in order."""
    return hot[np.minimum(np.searchsorted(hot, met), len(hot) - 1)] == met if len(hot) else np.zeros(len(met), bool)


def _anchor_rows(n: int, span: int, gram: int, hot: np.ndarray, flush: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held, count = [], 0
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for first, buf, off in bx.chunks(*bx.flat(batch.column(1))):
                    _, least = minima(buf, off, span, gram)
                    start, _ = segments(least, off, 1 << 40)
                    met = meeting(least[start])
                    rest = ~_hot(met, hot)
                    start, met = start[rest], met[rest]
                    doc = ids[first + np.searchsorted(off, start, "right") - 1]
                    held.append((met, doc))
                    count += len(start)
                    if count >= flush:
                        yield from send(held)
                        held, count = [], 0
            if count:
                yield from send(held)

        def send(held):
            f, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, f))
            f, doc = f[order], doc[order]
            new = np.ones(len(f), bool)
            new[1:] = (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])
            f, doc = f[new], doc[new]
            where = (f * U(n)) >> U(BITS)  # n is below 2**24
            cuts = np.searchsorted(where, np.arange(n + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(cuts)):
                i, j = cuts[b], cuts[b + 1]
                step = np.diff(f[i:j], prepend=U(0))
                near = doc[i:j] - doc[i:j].min()
                yield int(b), SHARED, c.pack(f=step.astype(np.uint32) if step[1:].max(initial=0) < 1 << 32 and step[0] < 1 << 32 else step, d=near.astype(np.uint32) if near.max() < 1 << 32 else near, z=doc[i:j].min(keepdims=True))

        yield from c.packed_rows(rows())

    return run


def _shared_rows(n: int):
    def one(bucket: int, items: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        fs, docs = [], []
        for _, p in items:
            x = c.unpack(p)
            fs.append(np.cumsum(x["f"].astype(np.uint64)))
            docs.append(x["d"].astype(np.int64) + x["z"][0])
        f, doc = np.concatenate(fs), np.concatenate(docs)
        order = np.lexsort((doc, f))
        f, doc = f[order], doc[order]
        start = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
        end = np.append(start[1:], len(f))
        shared = np.repeat(doc[start] != doc[end - 1], end - start)
        f, doc = f[shared], doc[shared]
        yield from c.packed_rows((b, SHARED, c.pack(f=f[i], d=doc[i])) for b, i in c.split_by(c.bucket_of(doc, n), n))

    return c.by_bucket(one)


def _text_rows(n: int, flush: int = 1 << 23):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held):
            ids = np.concatenate([x[0] for x in held])
            size = np.concatenate([np.diff(x[2]) for x in held])
            buf = np.concatenate([x[1] for x in held])
            off = np.append(0, np.cumsum(size))
            for b, i in c.split_by(c.bucket_of(ids, n), n):
                yield b, TEXT, c.pack(d=ids[i], n=size[i], t=np.concatenate([buf[off[k] : off[k + 1]] for k in i]))

        def rows():
            held, count = [], 0
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                buf, off = bx.flat(batch.column(1))
                held.append((ids, buf, off))
                count += len(buf) + 64 * len(ids)
                if count >= flush:
                    yield from send(held)
                    held, count = [], 0
            if held:
                yield from send(held)

        yield from c.packed_rows(rows(), 16)

    return run


def windows_of(buf: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A row of bytes for each start, zero beyond the end."""
    wide = np.concatenate([buf, np.zeros(width, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(wide, width)[starts]


def merged(key: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of equal bytes and size: a class number for each row, and for each class the row with the least doc."""
    rows = np.ascontiguousarray(np.concatenate([key, size.astype("<u2")[:, None].view(np.uint8)], axis=1))
    order = multikey_order(rows, np.argsort(doc, kind="stable"))
    same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
    new = np.append(True, ~same)
    cls = np.empty(len(rows), np.int64)
    cls[order] = np.cumsum(new) - 1
    return cls, order[new]


def multikey_order(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Stable order of byte rows by multikey sort: eight bytes are one key, and only rows that tie so far see the next."""
    n, width = rows.shape
    pad = -width % 8
    words = np.ascontiguousarray(np.concatenate([rows, np.zeros((n, pad), np.uint8)], axis=1) if pad else rows).view(">u8")
    order = order[np.argsort(words[order, 0].astype(np.uint64), kind="stable")]
    group = np.zeros(n, np.int64)  # by place in order: where its group of ties begins
    for k in range(words.shape[1]):
        w = words[order, k]
        new = np.append(True, (w[1:] != w[:-1]) | (group[1:] != group[:-1]))
        first = np.flatnonzero(new)
        group = np.repeat(first, np.diff(np.append(first, n)))
        size = np.diff(np.append(first, n))
        tied = np.flatnonzero(np.repeat(size, size) > 1)
        if not len(tied) or k + 1 == words.shape[1]:
            break
        rest = order[tied]
        order[tied] = rest[np.lexsort((words[rest, k + 1].astype(np.uint64), group[tied]))]
    return order


def taken_apart(doc: np.ndarray, start: np.ndarray, count: np.ndarray, body: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, bytes) of each string of windows."""
    w = np.repeat(np.arange(len(doc)), count)
    o = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
    return doc[w], start[w] + o, np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(body, span, axis=1)[w, o])


def _window_rows(n: int, span: int, gram: int, splitters: np.ndarray, hot: np.ndarray, hot_met: np.ndarray):
    most = min(span - gram + 1, 32)
    wide = span + most - 1

    def one(bucket: int, items: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        text, shared = c.unpack_all(items, TEXT), c.unpack_all(items, SHARED)
        if not text or not (shared or len(hot_met)):
            return
        ids, size, buf = text["d"], text["n"], text["t"]
        if shared:
            known, code = np.unique(shared["d"], return_inverse=True)
            wanted = np.unique((code.astype(np.uint64) << U(BITS)) | shared["f"].astype(np.uint64))
        found, held = [], 0
        for first, part, off in bx.chunks(buf, np.append(0, np.cumsum(size))):
            h, least = minima(part, off, span, gram)
            start, count = segments(least, off, most)
            row = np.searchsorted(off, start, "right") - 1
            doc = ids[first + row]
            met = meeting(least[start])
            hit = _hot(met, hot_met)
            if shared:
                at = np.minimum(np.searchsorted(known, doc), len(known) - 1)
                key = (at.astype(np.uint64) << U(BITS)) | met
                hit |= (known[at] == doc) & (wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)
            start, count, doc, row = start[hit], count[hit], doc[hit], row[hit]
            if not len(start):
                continue
            # The anchor: the first gram at or after the start that has the least hash.
            lead = np.zeros(len(start), np.int64)
            open_ = np.ones(len(start), bool)
            for o in range(span - gram + 1):
                now = open_ & (h[np.minimum(start + o, len(h) - 1)] == least[start])
                lead[now] = o
                open_ &= ~now
            body = windows_of(part, start, wide)
            body[np.arange(wide)[None, :] >= (count + span - 1)[:, None]] = 0
            found.append((doc, start - off[row], count, lead, body))
            held += len(start)
            if held >= WINDOWS:
                yield from c.packed_rows(send(bucket, found))
                found, held = [], 0
        if found:
            yield from c.packed_rows(send(bucket, found))

    def send(bucket: int, found: list[tuple]) -> Iterator[tuple[int, int, bytes]]:
        """Each distinct window of the least document that has it here; in others it goes."""
        doc, start, count, lead, body = (np.concatenate(x) for x in zip(*found, strict=True))
        cls, best = merged(body, count * 64 + lead, doc)
        later = doc > doc[best][cls]
        if later.any():
            yield bucket, GONE, c.pack(d=doc[later], s=start[later].astype(np.int32), m=(U(1) << count[later].astype(np.uint64)) - U(1))
        doc, start, count, lead, body = doc[~later], start[~later], count[~later], lead[~later], body[~later]
        grams = np.ascontiguousarray(np.take_along_axis(body, lead[:, None] + np.arange(gram)[None, :], 1)).view(f"S{gram}")[:, 0]
        apart = np.isin(grams, hot)
        for k in range(0, int(apart.sum()), APART):
            i = np.flatnonzero(apart)[k : k + APART]
            yield from strings(bucket, *taken_apart(doc[i], start[i], count[i], body[i], span))
        doc, start, count, lead, body, grams = (x[~apart] for x in (doc, start, count, lead, body, grams))
        used = np.arange(wide)[None, :] < (count + span - 1)[:, None]
        for b, i in c.split_by(np.searchsorted(splitters, grams, "right"), len(splitters) + 1):
            yield b, WINDOW, c.pack(d=doc[i], s=start[i].astype(np.int32), c=count[i].astype(np.uint8), l=lead[i].astype(np.uint8), b=body[i][used[i]])

    def strings(bucket: int, doc: np.ndarray, start: np.ndarray, body: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """Each distinct string once, with the least document that has it here and all its places there; in others it goes."""
        cls, best = merged(body, np.zeros(len(doc), np.int64), doc)
        later = doc > doc[best][cls]
        if later.any():
            yield bucket, GONE, c.pack(d=doc[later], s=start[later].astype(np.int32), m=np.ones(int(later.sum()), np.uint64))
        start, cls = start[~later], cls[~later]
        places, times = start[np.argsort(cls, kind="stable")].astype(np.int32), np.bincount(cls, minlength=len(best))
        first = np.cumsum(times) - times
        at = np.arange(len(best), dtype=np.int64) * span
        hashes = bx.run_hashes(body[best].ravel(), at, at + span)
        for b, i in c.split_by(c.bucket_of(hashes, n), n):
            each = np.repeat(first[i], times[i]) + np.arange(int(times[i].sum())) - np.repeat(np.cumsum(times[i]) - times[i], times[i])
            yield b, STRING, c.pack(d=doc[best[i]], k=times[i].astype(np.int32), s=places[each], b=body[best[i]].ravel())

    return c.by_bucket(one)


def _resolve_rows(n: int, span: int, gram: int):
    most = min(span - gram + 1, 32)
    wide = span + most - 1

    def one(bucket: int, items: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        gone = [(k, p) for k, p in items if k == GONE]
        yield from c.packed_rows((bucket, k, p) for k, p in gone)
        x = c.unpack_all(items, STRING)
        if x:
            cls, best = merged(x["b"].reshape(-1, span), np.zeros(len(x["d"]), np.int64), x["d"])
            later = np.repeat(x["d"] > x["d"][best][cls], x["k"])
            d, s = np.repeat(x["d"], x["k"])[later], x["s"][later]
            yield from c.packed_rows((b, GONE, c.pack(d=d[i], s=s[i], m=np.ones(len(i), np.uint64))) for b, i in c.split_by(c.bucket_of(d, n), n))
        x = c.unpack_all(items, WINDOW)
        if not x:
            return
        doc, start, count, lead = x["d"], x["s"], x["c"].astype(np.int64), x["l"].astype(np.int64)
        size = count + span - 1
        body = np.zeros((len(doc), wide), np.uint8)
        body[np.arange(wide)[None, :] < size[:, None]] = x["b"]
        out = [resolve(doc, start, count, lead, body, span, gram)]
        for d, s, m in out:
            yield from c.packed_rows((b, GONE, c.pack(d=d[i], s=s[i], m=m[i])) for b, i in c.split_by(c.bucket_of(d, n), n))

    return c.by_bucket(one)


def resolve(doc, start, count, lead, body, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, bits) of the strings in these windows that also start in a smaller document."""
    bits = np.zeros(len(doc), np.uint64)
    cls, best = merged(body, count * 64 + lead, doc)
    later = doc > doc[best][cls]
    bits[later] = (U(1) << count[later].astype(np.uint64)) - U(1)
    # Different windows whose suffixes lead with the same bytes may still share strings.
    grams = np.ascontiguousarray(np.take_along_axis(body[best], lead[best][:, None] + np.arange(gram)[None, :], 1))
    order = multikey_order(grams, np.arange(len(best)))
    new = np.append(True, (grams[order[1:]] != grams[order[:-1]]).any(axis=1))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    rows = order[np.repeat(size, size) > 1]
    for some in _by_group(rows, size, 20000):
        _strings(some, best, doc, count, body, span, bits)
    bits = np.where(doc == doc[best][cls], bits[best][cls], bits)  # a document may have a window twice
    keep = bits > 0
    return doc[keep], start[keep], bits[keep]


def _by_group(rows, size, most):
    """rows cut between groups of equal leading bytes, into parts of about most."""
    sizes = size[size > 1]
    ends = np.cumsum(sizes)
    at = 0
    while at < len(rows):
        k = max(int(np.searchsorted(ends, at + most, "right")) - 1, int(np.searchsorted(ends, at, "right")))
        yield rows[at : ends[k]]
        at = int(ends[k])


def _strings(rows, best, doc, count, body, span, bits) -> None:
    w = np.repeat(np.arange(len(rows)), count[best[rows]])
    o = np.arange(len(w)) - np.repeat(np.cumsum(count[best[rows]]) - count[best[rows]], count[best[rows]])
    r = best[rows][w]
    strings = np.lib.stride_tricks.sliding_window_view(body, span, axis=1)[r, o]
    d = doc[r]
    order = multikey_order(np.ascontiguousarray(strings), np.argsort(d, kind="stable"))
    new = np.append(True, (strings[order[1:]] != strings[order[:-1]]).any(axis=1))
    least = np.empty(len(order), d.dtype)
    first = np.flatnonzero(new)
    least[order] = np.repeat(d[order[first]], np.diff(np.append(first, len(order))))
    hit = least < d
    np.bitwise_or.at(bits, r[hit], U(1) << o[hit].astype(np.uint64))


def _final_rows(span: int):
    def one(bucket: int, items: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        text, gone = c.unpack_all(items, TEXT), c.unpack_all(items, GONE)
        if not text:
            return
        ids, size, buf = text["d"], text["n"], text["t"]
        order = np.argsort(ids, kind="stable")
        row = at = bits = np.zeros(0, np.int64)
        if gone:
            left, right = (np.searchsorted(ids[order], gone["d"], side) for side in ("left", "right"))
            which = np.repeat(np.arange(len(left)), right - left)  # rows of equal doc_id each lose it
            nth = np.arange(len(which)) - np.repeat(np.cumsum(right - left) - (right - left), right - left)
            row, at, bits = order[left[which] + nth], gone["s"][which], gone["m"][which]
            fits = np.flatnonzero(at + span <= size[row])
            fits = fits[np.argsort(row[fits], kind="stable")]
            row, at, bits = row[fits], at[fits], bits[fits]
        for first, part, off in bx.chunks(buf, np.append(0, np.cumsum(size))):
            n = len(off) - 1
            i, j = np.searchsorted(row, (first, first + n))
            spot, mask = off[row[i:j] - first] + at[i:j], bits[i:j]
            cover = np.zeros(len(part) + 1, np.int32)
            for b in range(32 if j > i else 0):
                on = spot[(mask >> U(b)) & U(1) > 0] + b
                np.add.at(cover, on, 1)
                np.add.at(cover, on + span, -1)
            removed = np.cumsum(cover[:-1], dtype=np.int32) > 0
            total = np.append(0, np.cumsum(removed))
            rise = removed.copy()
            rise[1:] &= ~removed[:-1]
            inner = off[:-1][off[:-1] < len(part)]
            rise[inner] = removed[inner]
            spans = np.append(0, np.cumsum(rise))
            kept, koff = part[~removed].tobytes(), off - total[off]
            yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + n]), pa.array(np.diff(off)), pa.array(np.diff(total[off])), pa.array(np.diff(spans[off])), pa.array([kept[koff[k] : koff[k + 1]] for k in range(n)], pa.binary())], schema=_RESULT)

    return c.by_bucket(one)


def _splitter_keys(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, off in bx.chunks(*bx.flat(batch.column(0))):
                h, least = minima(buf, off, span, gram)
                at = np.flatnonzero(least)[::37]
                if len(at):
                    lead = np.array([s + int(np.argmin(h[s : s + span - gram + 1])) for s in at])
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in windows_of(buf, lead, gram)], pa.binary())], names=["lead"])

    return run


def splitters(docs: DataFrame, n: int, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """n - 1 splitters and n hot ones at most, from the leading bytes of suffixes in a bounded sample of texts."""
    share = min(1.0, SPLITTER_TEXTS / max(1, docs.count()))
    pick = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))) & (F.length("text") <= 50_000)).select("text")
    rows = pick.mapInArrow(_splitter_keys(span, gram), "lead binary").collect()
    leads = np.sort(np.array([bytes(r[0]) for r in rows], f"S{gram}"))
    each, times = np.unique(leads, return_counts=True)
    hot = each[(times >= HOT_LEADS) & (times * n > len(leads))]
    return np.unique(leads[np.linspace(0, len(leads) - 1, n + 1).astype(int)[1:-1]]) if len(leads) > n else each[: n - 1], hot


def met_by(leads: np.ndarray, gram: int) -> np.ndarray:
    """The numbers under which the anchors of these leading bytes meet, in order."""
    buf = np.frombuffer(leads.astype(f"S{gram}").tobytes(), np.uint8)
    return np.unique(meeting(bx.gram_hashes(buf, gram)[::gram])) if len(leads) else np.zeros(0, np.uint64)


def numbered(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """docs with ids beyond all others for the rows that have none, and the largest id there was; None if no row lacks one."""
    none, last = docs.agg(F.count_if(F.col("doc_id").isNull()), F.max("doc_id")).first()
    if not none:
        return docs, None
    last = -1 if last is None else last
    lacking = c.checkpointed(docs.where("doc_id is null").select(F.monotonically_increasing_id().alias("k"), "text"))
    if lacking.agg(F.max("k")).first()[0] >= (1 << 63) - 1 - last:
        raise ValueError("no ids are left for rows without one")
    return docs.where("doc_id is not null").unionAll(lacking.select((F.col("k") + F.lit(last + 1)).alias("doc_id"), "text")), last


def remove_repeats(docs: DataFrame, span: int = 50, gram: int = 20, drop_text: bool = False) -> DataFrame:
    """Remove each byte covered by a span-byte string that also starts in a document with a smaller doc_id.

    ``docs`` needs doc_id (unique where not null) and text; other columns are ignored. Returns doc_id,
    n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes that remain (a cut may fall
    inside a UTF-8 sequence). A null or short text keeps all it has; strings never cross documents;
    one row comes back for each row; an empty table gives an empty one. Rows that share a doc_id must be
    repeats of one text: they don't remove from each other, and each gets the same result. A row of a null
    doc_id is a document of its own that comes after all others, and among such rows in the order they are
    read in; it comes back with its null.
    """
    if not 1 <= gram <= span - 1:
        raise ValueError("gram must be from 1 to span - 1")
    spark = docs.sparkSession
    c.small_batches(spark)
    n = c.partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs, last = numbered(docs)
    cuts, hot = splitters(docs, n, span, gram)
    hot_met = met_by(hot, gram)
    texts = docs.mapInArrow(_text_rows(n), c.PACKED)
    shared = c.exchanged(docs.mapInArrow(_anchor_rows(n, span, gram, hot_met), c.PACKED), n).mapInArrow(_shared_rows(n), c.PACKED)
    windows = c.exchanged(texts.unionAll(shared), n).mapInArrow(_window_rows(n, span, gram, cuts, hot, hot_met), c.PACKED)
    gone = c.exchanged(windows, n).mapInArrow(_resolve_rows(n, span, gram), c.PACKED)
    out = c.exchanged(texts.unionAll(gone), n).mapInArrow(_final_rows(span), RESULT)
    return out if last is None else out.withColumn("doc_id", F.when(F.col("doc_id") <= last, F.col("doc_id")))


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(c.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], span: int = 50) -> list[tuple[int, int, int, int, str]]:
    """The contract word for word, for tests."""
    texts = {d: (t or "").encode() for d, t in rows}
    least: dict[bytes, int] = {}
    for d in sorted(texts, reverse=True):
        for i in range(len(texts[d]) - span + 1):
            least[texts[d][i : i + span]] = d
    out = []
    for d, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if least[t[i : i + span]] < d:
                gone[i : i + span] = b"\1" * span
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out
