"""Fine points of the contracts, each with the rows that would show a breach."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumenfield.llm import chat, langid, ordinal


def test_loss_text_comes_from_the_mask(spark):
    """What lies under loss_runs is hashed: a corrupted mask changes it, and nothing else in formatted is asked."""
    turns = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(["q", "a\\<|b é", "漢", "<|im_end|>", "x", "", "", None, "z", "<"] * 40)]
    done = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    want = "".join(t or "" for _, _, role, t in turns if role == "assistant")
    for runs in (1, 7, 64, 10**6):
        assert [r["loss_text"] for r in chat.loss_texts(done, runs).collect()] == [want]
    wrong = done.withColumn("loss_runs", F.transform("loss_runs", lambda x: F.struct(x["n"].alias("n"), (~x["loss"]).alias("loss"))))
    assert chat.loss_texts(wrong).first()["loss_text"] != want
    none = done.withColumn("loss_runs", F.filter("loss_runs", lambda x: x["n"] < 0))
    assert chat.loss_texts(none).first()["loss_text"] == ""
    plan = chat.op4_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "loss_runs" in plan


def test_only_letters_are_letters(spark):
    """A language is told where a character of Unicode's category L is, and nowhere else."""
    f = langid.build([("en", g, 2) for g in range(100)], {"en": 3})
    texts = ["½ ②", "Ⅷ", "²", "٣", "_", "12 !?", "", None, " \n", "a", "ª", "漢", "½ ② x"]
    langs, scores = f.predict(pa.array(texts, pa.string()))
    assert langs == ["und"] * 9 + ["en"] * 4 and not scores[:9].any()


def test_filters_tell_all_languages_of_a_gram():
    """The slots' and has each language that holds an n-gram, also one in which it is rare."""
    counts = [("a", g, 1000) for g in range(50)] + [("b", g, 2) for g in range(50)] + [("c", g, 1) for g in range(50)]
    f = langid.build(counts, {"a": 1, "b": 1, "c": 1})
    at = langid.slots(np.arange(50, dtype=np.uint64))
    assert ((f.table[at[0], 0] & f.table[at[1], 0]) & 0b011 == 0b011).all()
    assert not ((f.table[at[0], 0] & f.table[at[1], 0]) & 0b100).any()  # once only in its training texts


def test_counts_against_plain_sets():
    """Corrected hits are what sets of n-grams say, up to the filters' false positives, which are taken off."""
    r = random.Random(8)
    texts = {x: " ".join("".join(r.choices(letters, k=5)) for _ in range(400)) for x, letters in (("p", "abcde"), ("q", "cdefg"))}
    held = {}
    for x, t in texts.items():
        raw = np.frombuffer(t.encode(), np.uint8)
        held[x] = np.unique(langid.grams(raw, np.array([0, len(raw)]))[1])
    f = langid.filters({x: [g] for x, g in held.items()}, {"p": 1, "q": 1})
    for text in (texts["p"][:300], texts["q"][:300], "cde cdedc dcecd"):
        raw = np.frombuffer(text.encode(), np.uint8)
        off = np.array([0, len(raw)])
        g = langid.grams(raw, off)[1]
        total, hits = f.count(raw, off)
        assert total[0] == len(g)
        for k, x in enumerate(("p", "q")):
            assert abs(hits[0, k] - np.isin(g, held[x]).sum()) <= 2


def test_language_of_repeated_rows_and_ties(spark):
    f = langid.filters({"a": [np.arange(10, dtype=np.uint64)], "b": [np.arange(10, dtype=np.uint64)]}, {"a": 1, "b": 5})
    docs = spark.createDataFrame([(1, "some words"), (1, "some words"), (None, "some words"), (2, "wörter " * 200_000)], "doc_id long, text string")
    got = langid.identify(docs, f).collect()
    assert [r["lang_pred"] for r in got] == ["b"] * 4  # no n-gram known: most training texts


def test_ratings_that_are_no_numbers_say_nothing(spark):
    r = random.Random(3)
    good, bad = ["plain", "words", "of", "a", "text"], ["@@@", "###", "!!", "$$"]
    texts = [(k, " ".join(r.choices(good if k % 2 else bad, k=30))) for k in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rate = lambda odd: spark.createDataFrame([(k, float(k % 2)) for k in range(100)] + odd, "doc_id long, quality double")
    want = {x["doc_id"]: x["kept"] for x in ordinal.quality(docs, rate([])).collect()}
    assert want == {k: bool(k % 2) for k in range(200)}
    got = ordinal.quality(docs, rate([(101, float("nan")), (102, None), (None, 1.0)])).collect()
    assert {x["doc_id"]: x["kept"] for x in got} == want


def test_three_grades_and_awkward_rows_with_a_fitted_model(spark):
    """Grades in order, the expected grade near the rating on rows that were not rated; null, empty, very long, repeated rows."""
    r = random.Random(4)
    words = {0: ["zero", "nil"], 1: ["one", "uno"], 2: ["two", "dos"]}
    make = lambda g: " ".join(r.choices(words[g], k=12) + r.choices(["and", "so", "on"], k=6))
    grades = {k: r.randrange(3) for k in range(600)}
    docs = spark.createDataFrame([(k, make(g), "x") for k, g in grades.items()], "doc_id long, text string, p_tail string")
    labels = spark.createDataFrame([(k, g, g) for k, g in grades.items() if k < 400], "doc_id long, quality int, toxic int")
    for out, name in ((ordinal.quality(docs, labels), "expected_grade"), (ordinal.toxicity(docs, labels), "severity")):
        held = [(x[name], grades[x["doc_id"]]) for x in out.where("doc_id >= 400").collect()]
        assert len(held) == 200 and np.mean([abs(a - b) for a, b in held]) < 0.3
        mean = [np.mean([a for a, b in held if b == g]) for g in range(3)]
        assert mean[0] < mean[1] < mean[2]
    odd = [(None, "two dos", ""), (900, None, ""), (901, "", ""), (902, " \n", ""), (903, "dos " * 300_000, ""), (904, "two dos", ""), (904, "two dos", "")]
    more = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, p_tail string"))
    got = ordinal.quality(more, labels).where("doc_id is null or doc_id >= 900").collect()
    by = {x["doc_id"]: x for x in got}
    assert len(got) == 7 and by[900]["expected_grade"] == by[901]["expected_grade"] == by[902]["expected_grade"]
    assert by[903]["kept"] and by[904]["expected_grade"] == by[None]["expected_grade"]


def test_held_out_quality(spark):
    """Rows that neither fitted the model nor chose a penalty: a fifth of the rated rows, by hash."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(5)) == 0
    out = ordinal.quality(d, labels.where(~held)).join(labels.where(held).select("doc_id", F.col("quality").alias("y")), "doc_id")
    good, bad, kept_good, kept_bad = (out.where(x).count() for x in ("y = 1", "y = 0", "y = 1 and kept", "y = 0 and kept"))
    assert kept_good >= 0.98 * good and kept_bad <= 0.1 * bad and bad > 50
