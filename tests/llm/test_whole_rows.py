"""Rows of repeated and null doc_ids are rows like others, at every size of the benchmark."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfield.llm import bytesx, common, decontaminate, substrings


@pytest.mark.parametrize("size", [1 << 18, 300, 60])
def test_hits_do_not_depend_on_the_number_of_automata(spark, monkeypatch, size):
    r = random.Random(1)
    items = [(i, " ".join(f"w{r.randrange(900)}" for _ in range(20))) for i in range(12)]
    free = "some other words that no item has"
    texts = [items[0][1], f"{items[1][1]} {free} {items[2][1]}", free, f"{items[3][1]} {items[4][1]}", None, items[0][1]]
    rows = [(d, t) for d in (None, 7, 8) for t in texts]  # a doc_id with several texts, and many null ones
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", size)
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 500, raising=False)
    out = decontaminate.contamination(docs, bench).collect()
    got = [(x["doc_id"], x["n_words"], x["n_hit"], len(x["items"]), x["contaminated"]) for x in out]
    want = [(d, n, hit, ids, bad) for d, n, hit, ids, _, bad in decontaminate.brute_force(rows, items)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {x[2] for x in got} == {0, 20, 40}
    assert all(a["end"] < b["start"] for x in out for a, b in zip(x["spans"], x["spans"][1:], strict=False))


@pytest.mark.parametrize("first", [0, -9])
def test_repeats_go_from_rows_without_id(spark, first):
    r = random.Random(2)
    word = lambda k: " ".join(f"v{r.randrange(10**6)}" for _ in range(k))
    shared, own = word(15), [word(12) for _ in range(5)]
    rows = [(first, f"{shared} {own[0]}"), (first + 1, f"{own[1]} {shared}")]
    lacking = [f"{own[2]} {shared}", own[3], own[4], own[4], None]  # two of one text: one of them loses it
    docs = spark.createDataFrame(rows + [(None, t) for t in lacking], "doc_id long, text string").repartition(2)
    out = substrings.remove_repeats(docs).withColumn("sha", F.sha2("kept", 256)).select("doc_id", "n_bytes", "n_removed", "n_spans", "sha").collect()
    want = substrings.brute_force(rows + [(100 + k, t) for k, t in enumerate(lacking)])
    assert sorted(map(tuple, out), key=repr) == sorted([(d if d < 100 else None, *x) for d, *x in want], key=repr)
    assert substrings.remove_repeats(docs.where("doc_id is null")).count() == 5


def test_pipeline_stages_keep_clean_rows_without_id(spark, tmp_path):
    r = random.Random(5)
    word = lambda: " ".join(f"u{r.randrange(10**6)}" for _ in range(40))
    item, one, two, three = word(), word(), word(), word()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in [(None, one), (None, two), (3, two), (4, three), (4, three), (None, item), (5, item + " x")]], "doc_id long, text string, lang string, source string, n_chars long")
    tell = lambda d: sorted(((x["doc_id"], x["text"]) for x in d.collect()), key=repr)
    assert tell(corpus_pipeline.near_dedup(spark, docs, "")) == sorted([(None, one), (3, two), (4, three), (5, item + " x")], key=repr)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert tell(out) == sorted([(None, one), (None, two), (3, two), (4, three), (4, three)], key=repr)


def test_packing_of_one_length_in_many_tasks(spark):
    """Pieces of one length in several tasks, rows repeated: no place is given twice, and no gap is left."""
    from lumenfield.llm import packing

    lengths = [2048] * 60 + [5] * 41 + [700] * 30 + [2043] * 7
    pieces = spark.createDataFrame([(k % 9 or None, n) for k, n in enumerate(lengths)], "doc_id long, length long").repartition(7)
    for most in (packing.BEGINS, 3):  # broadcast, shuffled
        rows = packing.packed(pieces, most=most).collect()
        assert sorted(r["length"] for r in rows) == sorted(lengths)
        bins = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in bins.values():
            end = 0
            for at, n in sorted(places):
                assert at == end
                end += n
            assert end <= 2048
        assert len(bins) == 60 + 7 + 15


def anchoring_phrase(r: random.Random) -> str:
    """20 letters whose hash is the least of 5,000, so that they are the anchor of most strings they stand in."""
    some = ["".join(r.choice("ABCDEFGH") for _ in range(20)) for _ in range(5000)]
    hashes = bytesx.gram_hashes(np.frombuffer("".join(some).encode(), np.uint8), 20)[::20]
    return some[int(np.argmin(hashes))]


def hot_phrase_rows(count: int, seed: int = 3) -> list[tuple[int, str | None]]:
    """Texts that share a phrase of 20 bytes between neighbours of their own, some of which stand twice, also in one text; and runs of one letter."""
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    phrase = anchoring_phrase(r)
    sides = [(word(40), word(40)) for _ in range(count)]
    rows = [(k, f"{a}{phrase}{b}") for k, (a, b) in enumerate(sides)]
    rows += [(count + k, f"{word(9)}{sides[k][0]}{phrase}{sides[k + 1][1]}{word(5)}" * (1 + k % 2)) for k in range(0, count // 2, 3)]
    return rows + [(-1, "z" * 300), (10**6, "y" + "z" * 170 + "x"), (10**6 + 1, None), (10**6 + 2, "")]


@pytest.mark.parametrize("least", [1, 8, 1 << 30])
def test_hot_leads_give_the_same_result(spark, monkeypatch, least):
    """The bytes that go don't depend on which leads are hot: all (one is enough), those of the default, none."""
    rows = hot_phrase_rows(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substrings, "HOT_LEADS", least)
    if least == 1:
        real = substrings.splitters
        monkeypatch.setattr(substrings, "splitters", lambda *a: (lambda cuts, hot: (cuts, np.unique(np.append(cuts, hot))))(*real(*a)))
    else:
        assert (len(substrings.splitters(docs, 4, 50, 20)[1]) > 0) == (least == 8)
    out = substrings.remove_repeats(docs).withColumn("sha", F.sha2("kept", 256)).select("doc_id", "n_bytes", "n_removed", "n_spans", "sha").collect()
    assert sorted(map(tuple, out)) == sorted(substrings.brute_force(rows))
    assert sum(x["n_removed"] for x in out) > 1000


def test_a_hot_lead_is_not_one_buckets_class():
    """Strings around a phrase that all texts share are dealt over all buckets, a few more in none than in others."""
    n, span, gram = 16, 50, 20
    r = random.Random(5)
    phrase = anchoring_phrase(r).encode()
    texts = [bytes(r.randrange(97, 123) for _ in range(40)) + phrase + bytes(r.randrange(97, 123) for _ in range(40)) for _ in range(2000)]
    grams = np.array([phrase], f"S{gram}")
    text = common.pack(d=np.arange(2000), n=np.array([len(t) for t in texts]), t=np.frombuffer(b"".join(texts), np.uint8))
    rows = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([substrings.TEXT], pa.int32()), pa.array([text])], schema=common.PACKED_ARROW)

    def strings(hot):
        out = substrings._window_rows(n, span, gram, np.zeros(0, f"S{gram}"), hot, substrings.met_by(grams, gram))(iter([rows]))
        sizes = {}
        for batch in out:
            for bucket, kind, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if kind in (substrings.STRING, substrings.WINDOW):
                    sizes[bucket] = sizes.get(bucket, 0) + len(common.unpack(payload)["d"])
        return sizes

    assert len(strings(grams[:0])) == 1
    dealt = strings(grams)
    assert len(dealt) == n and max(dealt.values()) < 1.2 * min(dealt.values())
