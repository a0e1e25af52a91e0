"""Ordinal regression on hashed text: cumulative links with shared weights and ordered thresholds.

P(grade <= k) = sigmoid(threshold_k - score), where score is one weighted sum of hashed features for all k.
The fit is a convex problem on a bounded sample of rated documents: accelerated proximal gradient steps
with an L1 penalty choose features, and a second fit with a small L2 penalty sets their weights.
Prediction reads each text once, with array kernels over bytes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenfield.llm import bytesx as bx
from lumenfield.llm import common as c

U = np.uint64
#: Rated rows used for a fit at most; those with the least hashes of doc_id.
SAMPLE = 8192
#: Bytes of their features that the driver reads at most.
SAMPLE_BYTES = 1 << 28
#: L1 penalties where values are shares, and where they are presence; the latter from held-out rows.
L1_SHARES, L1_PRESENCE = 1e-3, 3e-3
#: Hashed features.
DIMS_LOG2 = 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
#: A byte's class in a shape: capital, other letter or beyond ASCII, digit, or the mark itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = ord("A"), ord("a"), ord("a"), ord("0")


#: Features of a word that repeats the last one, and of one that the text has had before.
_AGAIN, _BEFORE = U(0x1234567) << U(36), U(0x89ABCDE) << U(36)
#: Bytes of the word beginnings that are features beside whole words, for languages that inflect.
STEMS = (4, 6)


def tokens(buf: np.ndarray, off: np.ndarray, shapes: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each token: lower-cased words and their stems, or else words, their repeats, and shapes of what stands between white space.

    A shape has one mark for a run of bytes of one class: ``Abc-12`` has ``Aa-0``.
    """
    low = _LOWER[buf]
    s, e = bx.runs(_WORD[low], off)
    row, h = np.searchsorted(off, s, "right") - 1, bx.run_hashes(low, s, e)
    if not shapes:
        stems = [(row[e - s > k], bx.mixed(bx.run_hashes(low, s[e - s > k], s[e - s > k] + k) + U(k))) for k in STEMS]
        row, h = (np.concatenate([x, *(y[i] for y in stems)]) for i, x in enumerate((row, h)))
    if shapes and len(buf):
        again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) + 1
        by_word = np.lexsort((h, row))
        before = by_word[1:][(h[by_word[1:]] == h[by_word[:-1]]) & (row[by_word[1:]] == row[by_word[:-1]])]
        row, h = np.concatenate([row, row[again], row[before]]), np.concatenate([h, np.full(len(again), _AGAIN), np.full(len(before), _BEFORE)])
        kind = _SHAPE[buf]
        keep = np.append(True, kind[1:] != kind[:-1])
        inner = off[:-1][off[:-1] < len(buf)]
        keep[inner] = True
        short = kind[keep]
        soff = np.searchsorted(np.flatnonzero(keep), off)
        s, e = bx.runs(~_SPACE[short], soff)
        row = np.concatenate([row, np.searchsorted(soff, s, "right") - 1])
        h = np.concatenate([h, bx.mixed(bx.run_hashes(short, s, e) + U(1))])
    return row, (h >> U(64 - DIMS_LOG2)).astype(np.int64)


def features(buf: np.ndarray, off: np.ndarray, shapes: bool, shares: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) once for each pair. A value is 1, or the root of the feature's share of its row."""
    n = len(off) - 1
    row, feature = tokens(buf, off, shapes)
    pair = np.sort((row << DIMS_LOG2) | feature)
    new = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(pair)))
    row, feature = pair[first] >> DIMS_LOG2, pair[first] & ((1 << DIMS_LOG2) - 1)
    if not shares:
        return row, feature, np.ones(len(row))
    total = np.bincount(row, count, n)
    return row, feature, np.sqrt(count / total[row])


@dataclass
class Model:
    """weights by feature, thresholds between the grades, grades in order."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray
    shapes: bool
    shares: bool

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= grades[k]) for all grades but the last, one column each."""
        return 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.grades[-1] - self.at_most(score) @ np.diff(self.grades)

    def tail(self, score: np.ndarray, grade: float) -> np.ndarray:
        """P(grade >= this grade)."""
        k = int(np.searchsorted(self.grades, grade))
        if k == 0:
            return np.ones(len(score))
        return 1 - self.at_most(score)[:, k - 1] if k < len(self.grades) else np.zeros(len(score))

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        row, feature, value = features(buf, off, self.shapes, self.shares)
        return np.bincount(row, self.weights[feature] * value, len(off) - 1)


def _loss(score: np.ndarray, y: np.ndarray, edges: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(mean negative log-likelihood, its slope by score, by the finite edges); y counts from 0, edges from -inf to inf."""
    hi, lo = edges[y + 1] - score, edges[y] - score
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    a, b = sig(hi), sig(lo)
    p = np.maximum(a - b, 1e-12)
    da, db = a * (1 - a), b * (1 - b)
    n = len(y)
    slope = (da - db) / p / n
    edge = np.zeros(len(edges))
    np.add.at(edge, y + 1, -da / p / n)
    np.add.at(edge, y, db / p / n)
    return float(-np.log(p).mean()), slope, edge[1:-1]


def fit_weights(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, n_cols: int, n_grades: int, l1: float, l2: float, steps: int, start: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by accelerated proximal gradient; thresholds stay in order by their gaps' logarithms."""
    n = len(y)
    times = lambda w: np.bincount(row, value * w[col], n)
    back = lambda g: np.bincount(col, value * g[row], n_cols)
    if start is None:
        share = np.clip(np.cumsum(np.bincount(y, minlength=n_grades))[:-1] / n, 1e-3, 1 - 1e-3)
        cut = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
        w, t = np.zeros(n_cols), np.append(cut[:1], np.log(np.maximum(np.diff(cut), 1e-3)))
    else:
        w, t = start
    edges_of = lambda t: np.concatenate([[-np.inf], np.cumsum(np.append(t[:1], np.exp(t[1:]))), [np.inf]])
    v = np.random.default_rng(1).random(n_cols) + 0.1
    for _ in range(12):
        v = back(times(v))
        size = np.linalg.norm(v) or 1.0
        v /= size
    step = 1 / (0.3 * size / n + l2 + 1e-9)
    zw, zt, k = w, t, 1.0
    for _ in range(steps):
        edges = edges_of(zt)
        _, slope, edge = _loss(times(zw), y, edges)
        new = zw - step * (back(slope) + l2 * zw)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        after = np.cumsum(edge[::-1])[::-1]  # moving a threshold moves all after it
        grow = np.append(after[:1], after[1:] * np.exp(zt[1:]))
        new_t = zt - 1.0 * grow
        up = (1 + np.sqrt(1 + 4 * k * k)) / 2
        if np.dot(zw - new, new - w) > 0:  # restart where momentum points uphill
            up, k = 1.0, 1.0
        zw, zt = new + (k - 1) / up * (new - w), new_t
        w, t, k = new, new_t, up
    return w, t


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], shapes: bool, shares: bool, l1: float | None = None, steps: int = 300) -> Model:
    """A model from (grade, features, values) of rated documents; without two grades it has no weights."""
    dims = 1 << DIMS_LOG2
    l1 = l1 or (L1_SHARES if shares else L1_PRESENCE)
    grades = np.unique([r[0] for r in rows]).astype(float) if rows else np.zeros(1)
    if len(grades) < 2:
        return Model(np.zeros(dims), np.zeros(0), grades, shapes, shares)
    y = np.searchsorted(grades, [float(r[0]) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    feature, value = (np.concatenate([r[k] for r in rows]) for k in (1, 2))
    used, col, seen = np.unique(feature, return_inverse=True, return_counts=True)
    common = seen >= 2
    keep = common[col]
    row, value, used, col = row[keep], value[keep].astype(float), used[common], (np.cumsum(common) - 1)[col[keep]]
    if not len(used):
        used, col = np.zeros(1, np.int64), col
    # Frequent features are scaled down, so that rare telling ones need no larger weights or more steps.
    scale = 1 / np.sqrt(np.bincount(col, value**2, len(used)) / len(rows) + (1e-4 if shares else 1e-2))
    value = value * scale[col]
    w, t = fit_weights(row, col, value, y, len(used), len(grades), l1, 0.0, steps)
    on = np.flatnonzero(w)
    if len(on):
        at = np.full(len(used), -1)
        at[on] = np.arange(len(on))
        keep = at[col] >= 0
        w2, t = fit_weights(row[keep], at[col[keep]], value[keep], y, len(on), len(grades), 0.0, l1 / 10, steps, (w[on], t))
        w = np.zeros(len(used))
        w[on] = w2
    weights = np.zeros(dims)
    weights[used] = w * scale
    return Model(weights, np.cumsum(np.append(t[:1], np.exp(t[1:]))), grades, shapes, shares)


def _feature_rows(shapes: bool, shares: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, buf, off in bx.chunks(*bx.flat(b.column(1))):
                row, feature, value = features(buf, off, shapes, shares)
                cuts = np.searchsorted(row, np.arange(len(off)))
                payload = [c.pack(f=feature[i:j].astype(np.int32), v=value[i:j].astype(np.float32)) for i, j in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0)[first : first + len(payload)], pa.array(payload, pa.binary())], names=["grade", "payload"])

    return run


def train(docs: DataFrame, ratings: DataFrame, grade: str, shapes: bool, shares: bool, sample: int = SAMPLE) -> Model:
    """A model of ratings' ``grade`` column (any ordered numbers) from the texts of ``sample`` rated rows at most, of SAMPLE_BYTES of features."""
    c.small_batches(docs.sparkSession)
    rated = ratings.select(F.col("doc_id").cast("long").alias("__id"), F.col(grade).cast("double").alias("__grade")).where("__id is not null and __grade is not null and not isnan(__grade)")
    rated = rated.orderBy(F.xxhash64("__id"), "__id", "__grade").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(rated), "__id").select("__grade", "text")  # sample rows at most are broadcast
    got = rows.mapInArrow(_feature_rows(shapes, shares), "grade double, payload binary")
    # Documents that repeat a rated doc_id must not swell what the driver reads, nor crowd out a grade.
    got = c.stored(got.withColumn("k", F.xxhash64("payload", "grade")))
    sizes = got.groupBy("k").agg(F.sum(F.octet_length("payload")).alias("n")).orderBy("k").limit(2 * sample).collect()
    fits = np.cumsum([r["n"] for r in sizes]) <= SAMPLE_BYTES
    last = sizes[int(fits.sum()) - 1]["k"] if fits.any() else -(1 << 63)
    chosen = got.where(F.col("k") <= last).select("grade", "payload").collect()
    c.free(got)
    read = []
    for r in sorted(chosen, key=lambda r: (r[0], bytes(r[1]))):
        x = c.unpack(bytes(r[1]))
        read.append((r[0], x["f"].astype(np.int64), x["v"].astype(float)))
    return fit(read, shapes, shares)


def _predictions(shared, tail_grade: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = pickle.loads(shared.value)
        top = model.grades[-1] if tail_grade is None else tail_grade
        for b in batches:
            score = np.zeros(b.num_rows)
            for first, buf, off in bx.chunks(*bx.flat(b.column(b.schema.get_field_index("text")))):
                score[first : first + len(off) - 1] = model.score(buf, off)
            more = [pa.array(model.expected(score)), pa.array(model.tail(score, top))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "expected_grade", "p_tail"])

    return run


def graded(docs: DataFrame, model: Model, tail_grade: float | None = None) -> DataFrame:
    """docs with expected_grade and p_tail, P(grade >= tail_grade); the top grade if that is None.

    Columns of these names are replaced and all others kept. A null or empty text has no features, so it
    gets what the thresholds alone say. Repeated rows are graded alike; an empty table gives an empty one.
    """
    c.small_batches(docs.sparkSession)
    docs = docs.drop("expected_grade", "p_tail")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields) + "expected_grade double, p_tail double"
    return docs.mapInArrow(_predictions(shared, tail_grade), schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with expected_grade, p_tail and kept, from ratings in ``labels.quality``.

    kept: the tail probability is ``threshold`` at least. Shapes and shares are used: junk is a matter of how
    much of a text looks odd. Without ratings of two grades nothing is known, and all is kept.
    """
    model = train(docs, labels, "quality", shapes=True, shares=True)
    known = len(model.grades) > 1
    return graded(docs, model).withColumn("kept", (F.col("p_tail") >= threshold) if known else F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with severity (expected grade), p_toxic and toxic, from grades in ``labels.toxic``.

    Words count by presence, as one slur in a long text is one. Without ratings of two grades nothing is toxic.
    """
    model = train(docs, labels, "toxic", shapes=False, shares=False)
    lowest = model.grades[1] if len(model.grades) > 1 else None
    out = graded(docs.drop("severity", "p_toxic"), model, lowest)
    return out.withColumnsRenamed({"expected_grade": "severity", "p_tail": "p_toxic"}).withColumn("toxic", (F.col("p_toxic") >= threshold) if lowest is not None else F.lit(False))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, c.table(spark, sf_dir, "labels")).drop("text")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, c.table(spark, sf_dir, "labels")).drop("text")
