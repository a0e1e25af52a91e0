"""What a task holds is bounded by steps, not by its longest text or its rows."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lumenfield.llm import bytesx, langid, packing
from lumenfield.llm import common as c


def most_mb(f) -> float:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_language_of_a_long_text_in_steps():
    words = np.random.default_rng(1).choice([b"alpha ", b"beta ", b"gamma  ", "délta ".encode(), b"x. "], 1_500_000)
    text = b"".join(words.tolist()).decode()
    f = langid.filters({"a": [np.unique(langid.grams(*bytesx.flat(pa.array(["alpha beta gamma"])))[1])], "b": [np.unique(langid.grams(*bytesx.flat(pa.array(["délta x. beta"])))[1])]}, {"a": 1, "b": 1})
    texts = pa.array(["alpha beta", None, text, "", "beta x. délta"])
    assert most_mb(lambda: f.predict(texts)) < 100  # 8 MB of text


def test_steps_give_each_gram_once(monkeypatch):
    texts = pa.array(["alpha  beta", "", None, "x" * 40, "a", "gamma délta epsilon", ""])
    row, g = langid.grams(*bytesx.flat(texts))
    for step in (1, 2, 5, 7, 64):
        monkeypatch.setattr(langid, "STEP", step)
        rows, gs = zip(*langid.steps(*bytesx.flat(texts)), strict=True)
        assert np.concatenate(rows).tolist() == row.tolist()
        assert np.concatenate(gs).tolist() == g.tolist()


def test_counts_of_grams_do_not_depend_on_steps(monkeypatch):
    """N-grams of several batches, steps and sendings are those that a language has twice in all."""
    batches = [(0, "alpha beta"), (1, "alpha"), (0, "gamma alpha"), (1, "délta délta"), (0, "once only"), (1, "gamma")] * 2 + [(0, "single passage"), (1, "another one")]
    want = {}
    for k in (0, 1):
        g, n = np.unique(langid.grams(*bytesx.flat(pa.array([t for x, t in batches if x == k])))[1], return_counts=True)
        want[k] = g[n >= langid.LEAST].tolist()
    for step, held in ((1 << 19, 1 << 21), (8, 3)):
        monkeypatch.setattr(langid, "STEP", step)
        monkeypatch.setattr(langid, "HELD", held)
        sent = []
        for part in (batches[::2], batches[1::2], []):  # three tasks
            rows = [pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([t])], names=["kind", "text"]) for k, t in part]
            sent += [r for b in langid._gram_counts(4)(iter(rows)) for r in b.to_pylist()]
        sent.sort(key=lambda r: (r["bucket"], r["kind"]))
        got = {}
        for b in langid._frequent(c.packed_rows([(r["bucket"], r["kind"], r["payload"]) for r in sent], 3)):
            for r in b.to_pylist():
                got.setdefault(r["kind"], []).extend(c.unpack(r["payload"])["g"].tolist())
        assert {k: sorted(x) for k, x in got.items()} == want


def test_ids_of_a_long_text_in_parts():
    words = np.random.default_rng(1).choice([b"alpha ", b"beta, ", b"gamma ", "délta ".encode(), b"x.\n"], 1_500_000)
    text = b"".join(words.tolist()).decode()
    w = packing.Words(packing.tokenizer_path())
    w.ids(["alpha beta"])
    assert most_mb(lambda: w.ids([text])) < 200  # 8 MB of text, 10 of ids


def test_cuts_of_a_text_change_no_id(monkeypatch):
    r = random.Random(4)
    letters = ["a", "B", "é", "É", "'", "'s", "!", "1", "½", " ", "\n", "\t", "\x1c", "\x85", "　", "<|endoftext|>", "<|", "İ", "Σ", "漢", "̀", "\0"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(2000)] + ["", "x" * 30]
    w = packing.Words(packing.tokenizer_path())
    want = [np.array(e.ids, "<u4").tobytes() for e in w.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for chars in (1, 5, 17):
        monkeypatch.setattr(packing, "CHARS", chars)
        assert all("".join(packing.parts(t)) == t for t in texts)
        assert sum(len(list(packing.parts(t))) > 2 for t in texts) > 100
        assert w.ids(texts) == want


def test_pieces_pass_through_python_once(spark, monkeypatch):
    """One Python worker for each core while texts are tokenized, as each remembers words; rows have their numbers as before."""
    plans, rows = [], []

    def stored(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df)

    kept = c.stored
    monkeypatch.setattr(c, "stored", stored)
    for query in (lambda: packing.op6_best_fit_packing(spark, "/root/testdata/sf0.001"), lambda: corpus_pipeline.pack(spark, c.table(spark, "/root/testdata/sf0.001", "documents"), "")):
        plans.clear()
        out = query()
        assert plans[0].count("MapInArrow") == 1
        assert not {"__part", "__n"} & set(out.columns)
        rows.append(sorted(out.select("doc_id", "piece", "start", "length", "sequence_id", "offset").collect()))
    docs = c.table(spark, "/root/testdata/sf0.001", "documents")
    assert rows[0] == rows[1] == sorted(packing.packed(packing.tokenized(docs)).select("doc_id", "piece", "start", "length", "sequence_id", "offset").collect())
