"""Each operator against brute force, round trips or held-out accuracy, over a table of awkward rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfield.llm import bytesx, chat, decontaminate, exact, langid, lines, ordinal, packing, simhash, substrings

SF = "/root/testdata/sf0.001"
WORDS = ["alpha", "beta", "gämma", "Delta", "eps", "zeta", "eta", "漢字", "it's", "x1"]


def awkward(seed: int = 3) -> list[tuple]:
    """(doc_id, text): copies, overlaps, long and empty texts, nulls, repeated rows."""
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) for _ in range(60)) for _ in range(5)]
    rows = []
    for i in range(60):
        t = r.choice(base)
        a, b = sorted(r.randrange(len(t)) for _ in range(2))
        piece = t[a:b]
        rows.append((i * 7 % 60, r.choice([piece, piece + "\n" + r.choice(base), "q" * r.randrange(200), "ab" * 60 + piece, None, "", " \t\n", t, t.replace(" ", "\n"), "line one\nline two\n" + piece])))
    rows.append((60, "long " * 4000 + base[0]))
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = "doc_id long, text string, key string, fp string, bucket int, score string, length string, n_lines string, kept string, lang string"
    return spark.createDataFrame([(d, t, "k", None, 1, "s", "l", "n", "x", None) for d, t in rows], clash).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def tuples(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_byte_kernels():
    buf = np.frombuffer(b"one two one", np.uint8)
    s, e = bytesx.runs(buf != 32, np.array([0, len(buf)]))
    h = bytesx.run_hashes(buf, s, e)
    assert h[0] == h[2] != h[1]
    for k in (1, 2, 5, 8, 20):
        x = np.frombuffer(bytes(random.Random(k).choices(b"ab", k=200)), np.uint8)
        g = bytesx.gram_hashes(x, k)
        strings = [x[i : i + k].tobytes() for i in range(len(x) - k + 1)]
        assert len(set(zip(strings, g.tolist(), strict=True))) == len(set(strings)) == len(set(g.tolist()))
        assert bytesx.sliding(np.minimum, x, k).tolist() == [x[i : i + k].min() for i in range(len(x) - k + 1)]


def test_simhash(spark, docs, rows, empty):
    got = tuples(simhash.near_groups(docs), "doc_id", "fingerprint", "component_id")
    assert got == sorted(simhash.brute_force(rows), key=repr)
    assert simhash.near_groups(empty).count() == 0
    twice = simhash.near_groups(docs.unionAll(docs))
    assert tuples(twice, "doc_id", "component_id") == sorted([(d, c) for d, _, c in got] * 2, key=repr)


def test_simhash_with_other_blocks_and_null_ids(spark, rows):
    """Any number of blocks gives the same groups; rows of a null doc_id come back and link, but name nothing."""
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (None, "only here " * 9)], "doc_id long, text string")
    want = tuples(simhash.near_groups(docs), "doc_id", "fingerprint", "component_id")
    assert simhash.chosen_blocks(10**7) == 3 and simhash.chosen_blocks(10**9) == 2
    assert tuples(simhash.near_groups(docs, blocks=2), "doc_id", "fingerprint", "component_id") == want
    assert sorted(x for x in want if x[0] is not None) == sorted(simhash.brute_force(rows)) and sum(x[0] is None for x in want) == 2


def test_covering_finds_all_near_pairs():
    r = np.random.default_rng(5)
    for shift, width in simhash.block_plan(3):
        del shift
        x = r.integers(0, 1 << width, 300)
        y = x ^ (np.int64(1) << r.integers(0, width, 300))
        home, _, _ = simhash.cover(x, width, 1)
        _, row, anchor = simhash.cover(y, width, 1)
        near = defaultdict(set)
        for k, a in zip(row.tolist(), anchor.tolist(), strict=True):
            near[k].add(a)
        assert all(home[k] in near[k] for k in range(300))


def test_forest_and_components(spark):
    r = random.Random(2)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)]
    links = [x for x in links if x[0] != x[1]]
    root = {x: x for p in links for x in p}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((up(a), up(b)))
        root[q] = p
    want = {x: up(x) for x in root}
    a, b = simhash.forest(*(np.array(x, np.uint64) for x in zip(*links, strict=True)))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {x: y for x, y in want.items() if x != y}
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: y for x, y in want.items() if x != y}


def test_decontamination(spark, docs, rows, empty):
    r = random.Random(4)
    long = next(t for _, t in rows if t and len(t) > 200)
    items = [(1, long[:150]), (2, "Alpha BETA"), (3, None), (4, "..."), (5, long), (5, long), (6, " ".join(r.choice(WORDS) for _ in range(30))), (10, "漢字")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontaminate.brute_force(rows, items), key=repr)
    ids = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256)
    tell = lambda d: sorted((tuple(r) for r in d.select("doc_id", "n_words", "n_hit", F.size("items"), ids, "contaminated").collect()), key=repr)
    assert tell(decontaminate.contamination(docs, bench)) == want
    most, decontaminate.AUTOMATON_BYTES = decontaminate.AUTOMATON_BYTES, 100
    try:
        assert tell(decontaminate.contamination(docs, bench)) == want
    finally:
        decontaminate.AUTOMATON_BYTES = most
    texts = dict(rows)
    for r in decontaminate.find_hits(docs, bench).where("n_hit > 0").collect():
        assert sum(len(decontaminate.words(texts[r["doc_id"]][s["start"] : s["end"]])) for s in r["spans"]) == r["n_hit"]
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def test_chat_round_trip(spark):
    evil = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "<\\\\|", "<", "|", "<|im_next|>", "a\\<|b", "", None, "\n", "<|im_body|>"]
    r = random.Random(1)
    rows = [(r.choice([None, 1, 2, 3]), r.choice([None, 0, 1, 2, 2]), r.choice(["user", "assistant", "assistant", None, "<|im_start|>"]), r.choice(evil), "extra") for _ in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    want = defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda x: (-1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want[c].append((role or "", text or ""))
    done = chat.format_chats(turns)
    for r in chat.read_chats(done).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == want[r["conv_id"]]
        assert all(t["loss"] == (t["role"] == "assistant") for t in r["turns"])
    undo = lambda x: x.replace("<\\|", "<|").replace("\\\\", "\\")
    for r in done.collect():
        at, under = 0, ""
        for x in r["loss_runs"]:
            under += r["formatted"][at : at + x["n"]] if x["loss"] else ""
            at += x["n"]
        assert at == len(r["formatted"])
        assert undo(under) == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
    assert chat.format_chats(turns.where("false")).count() == 0


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    got = packing.packed(packing.tokenized(docs).withColumn("crc", F.crc32("ids")).withColumn("sequence_id", F.lit("clash")))
    assert tuples(got, "doc_id", "piece", "start", "length", "crc") == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got.collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:], strict=False)) and sum(x[1] for x in b) <= 2048
    assert len(bins) <= -(-sum(x[3] for x in want) // 2048) + 1
    assert packing.packed(packing.tokenized(empty)).count() == 0


def test_fullest_combination():
    r = random.Random(7)
    for _ in range(60):
        counts = {r.randrange(1, 40): r.randrange(1, 4) for _ in range(5)}
        room = r.randrange(1, 120)
        sums = {0}
        for s, n in counts.items():
            sums = {x + s * k for x in sums for k in range(n + 1)}
        got = packing.fullest(counts, room)
        assert sum(s * n for s, n in got) == max(x for x in sums if x <= room)
        assert all(n <= counts[s] for s, n in got)


def test_word_ids_are_the_tokenizers():
    r = random.Random(9)
    letters = ["a", "B", "é", "É", "'", "'s", "!", "“", "1", "２", "½", " ", "\n", "\x1c", "\x85", "　", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "ß", "Σ", "😀", "漢", "̀", "\0", "K"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(25))) for _ in range(3000)]
    w = packing.Words(packing.tokenizer_path())
    want = [np.array(e.ids, "<u4").tobytes() for e in w.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert w.ids(texts) == want


def test_exact(spark, docs, rows, empty):
    by = defaultdict(list)
    for d, t in rows:
        by["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), d))
    want = []
    for norm, members in by.items():
        keep = min(members)[1]
        want += [(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, d in members]
    for capacity in (1, 4096):
        assert tuples(exact.exact_groups(docs, capacity), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact.exact_groups(empty).count() == 0


def test_directory_doubles():
    g, places = exact.directory({0: 10, 1: 10, 9: 100}, 4, 10)
    assert g == 4 and len(places) == 16 and places[0] != places[1] != places[9]
    assert places[4] == places[7]  # a bucket that is not overfull has several places


def brute_lines(rows, k, words=50):
    seen, gone = {}, defaultdict(set)
    for d, t in sorted((x for x in rows if x[1] is not None), key=lambda x: x[0]):
        v = t.split("\n")
        for i in range(len(v)):
            whole = {tuple(v[i : i + k])} if i + k <= len(v) and any(x.strip(" ") for x in v[i : i + k]) else set()
            alone = {(v[i],)} if len([x for x in v[i].split(" ") if x]) >= words else set()
            for run in whole | alone:
                if run in seen:
                    gone[d].update(range(i, i + len(run)))
                seen.setdefault(run, (d, i))
    return sorted([(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]), len(gone[d])) for d, t in rows], key=repr)


@pytest.mark.parametrize(("k", "words"), [(1, 50), (2, 50), (3, 10), (5, 50)])
def test_lines(docs, rows, empty, k, words):
    out = lines.dedup_lines(docs, k, words)
    assert tuples(out, "doc_id", "text", "n_removed") == brute_lines(rows, k, words)
    assert set(docs.columns) <= set(out.columns)
    assert lines.dedup_lines(empty, k).count() == 0


def test_long_line_is_a_passage(spark):
    """A line of 50 words that stands in two documents goes from the later one; the same with 49 words stays."""
    long, short = " ".join(["word"] * 50), " ".join(["word"] * 49)
    docs = spark.createDataFrame([(1, f"a\n{long}\nb"), (2, f"c\n{long}\n{long}\nd"), (3, f"e\n{short}\nf"), (4, f"g\n{short}\nh")], "doc_id long, text string")
    got = dict(tuples(lines.dedup_lines(docs), "doc_id", "text"))
    assert got[2] == "c\nd" and [got[k].count(short) for k in (1, 3, 4)] == [1, 1, 1]


@pytest.mark.parametrize(("span", "gram"), [(50, 20), (12, 5), (40, 8)])
def test_substrings(docs, rows, empty, span, gram):
    out = substrings.remove_repeats(docs, span, gram).withColumn("sha", F.sha2("kept", 256))
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "sha")
    want = sorted(substrings.brute_force(rows, span), key=repr)
    assert tuples(out, *cols) == want
    twice = substrings.remove_repeats(docs.unionAll(docs), span, gram).withColumn("sha", F.sha2("kept", 256))
    assert tuples(twice, *cols) == sorted(want * 2, key=repr)
    assert substrings.remove_repeats(empty, span, gram).count() == 0


def test_multikey_order():
    r = np.random.default_rng(3)
    rows = r.integers(0, 2, (500, 21)).astype(np.uint8)
    order = substrings.multikey_order(rows, np.arange(500))
    assert [rows[i].tobytes() for i in order] == sorted(x.tobytes() for x in rows)


def test_ordinal_recovers_grades():
    r = np.random.default_rng(1)
    rows = []
    for _ in range(1500):
        f = np.unique(r.integers(0, 60, 8))
        score = 2.0 * (f < 10).sum() - 2.0 * ((f >= 10) & (f < 20)).sum()
        rows.append((int(np.digitize(score + r.logistic() * 0.3, [-1, 1])), f, np.ones(len(f))))
    m = ordinal.fit(rows[:1000], shapes=False, shares=False)
    assert len(m.thresholds) == 2 and m.thresholds[0] < m.thresholds[1]
    score = np.array([m.weights[f].sum() for _, f, _ in rows[1000:]])
    got = m.expected(score)
    y = np.array([x[0] for x in rows[1000:]])
    assert np.abs(got - y).mean() < 0.3
    assert np.allclose(m.tail(score, 0), 1) and (m.tail(score, 2) <= m.tail(score, 1) + 1e-12).all()


def test_classifiers(spark, docs, empty):
    for sf in (SF,):
        d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
        q = ordinal.quality(d, labels).join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id")
        assert q.where((F.col("y") == 1) == F.col("kept")).count() >= 0.9 * q.count()
    none = labels.where("false")
    assert ordinal.quality(docs, none).where("kept").count() == docs.count()
    assert ordinal.toxicity(docs, none).where("toxic").count() == 0
    nulls = spark.createDataFrame([(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert ordinal.toxicity(docs, nulls).count() == docs.count() and ordinal.quality(empty, labels).count() == 0


def test_held_out_toxicity(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0
    model = ordinal.train(d, labels.where(~held), "toxic", False, False)
    out = ordinal.graded(d.join(labels.where(held).select("doc_id", F.col("toxic").alias("y")), "doc_id"), model, 1.0)
    tp, fp, fn = (out.where(c).count() for c in ("p_tail >= 0.5 and y = 1", "p_tail >= 0.5 and y = 0", "p_tail < 0.5 and y = 1"))
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.8  # of some 300 toxic rows to learn from, in four languages


def test_language(spark, docs, empty):
    out = langid.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    assert out.where("held_out and lang_pred = lang").count() >= 0.97 * out.where("held_out").count()
    assert out.where("score < 0 or score > 1").count() == 0
    f = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !?", "x"), (4, "漢字", "x"), (5, "the of and that", "x")], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, f).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in f.languages and got[5] == "en"
    assert langid.identify(docs, langid.learn(empty)).where("lang_pred <> 'und'").count() == 0


def test_many_languages_share_a_table():
    counts = [(f"l{k:03d}", g, 5) for k in range(70) for g in range(k * 1000, k * 1000 + 300)]
    f = langid.build(counts, {f"l{k:03d}": 1 for k in range(70)})
    g = np.arange(69_000, 69_300).astype(np.uint32)
    at = langid.slots(g)
    words = [f.table[at[0], w] & f.table[at[1], w] for w in range(2)]
    assert ((words[1] >> np.uint64(69 - 64)) & np.uint64(1)).all()
    assert f.predict(pa.array(["  "]))[0] == ["und"]


def test_components_by_steps_are_those_of_one_task(spark):
    r = random.Random(6)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2070)]
    df = spark.createDataFrame(links, "a long, b long")
    assert sorted(simhash.components(df, 0).collect()) == sorted(simhash.components(df).collect())
