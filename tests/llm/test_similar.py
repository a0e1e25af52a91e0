"""Groups of similar texts against all pairs, and what the pipeline's near-dedup keeps of them."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lumenfield.llm import similar, simhash


def copies(seed: int = 7) -> list[tuple]:
    """Texts and copies of them with words changed here and there, around and on both sides of the similarity."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([6, 30, 200]))]
        for _ in range(6):
            near = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 25)):
                near[r.randrange(len(near))] = word()
            rows.append((r.randrange(10**6), " ".join(near)))
    return [*rows, (10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (10**6 + 3, "a b"), (10**6 + 4, "A  b")]


def firsts(rows: list[tuple]) -> set[int]:
    """The least doc_id of each group, by all pairs."""
    sets = {d: set(similar.shingles(t).tolist()) for d, t in rows}
    root = {d: d for d in sets}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(sorted(sets), 2):
        if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
            p, q = sorted((up(x), up(y)))
            root[q] = p
    return {up(d) for d in root}


def test_near_dedup_misses_no_similar_pair(spark):
    rows = copies()
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(firsts(rows))
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), "").count() == 0


def test_hot_groups_in_cells_with_a_blunt_sieve(spark, monkeypatch):
    """Many near copies whose groups are cut into cells, and parities so few that pairs fail and rounds repeat: still all pairs' groups."""
    r = random.Random(11)
    base = [f"w{r.randrange(5000)}" for _ in range(60)]
    rows = []
    for k in range(90):
        near = list(base)
        for _ in range(r.randrange(0, 5)):
            near[r.randrange(len(near))] = f"v{r.randrange(40)}"
        rows.append((k, " ".join(near)))
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name, value in (("CELL", 16), ("PARITIES", 64), ("FORESTS", 1)):
        monkeypatch.setattr(similar, name, value)
    assert sorted(x["doc_id"] for x in similar.firsts(docs).collect()) == sorted(firsts(rows))


def test_pairs_are_those_that_sizes_and_places_allow():
    r = np.random.default_rng(4)
    cell, n, at, root = np.sort(r.integers(0, 6, 300)), r.integers(5, 30, 300), r.integers(0, 4, 300), r.integers(0, 5, 300)
    order = np.lexsort((n, cell))
    cell, n, at, root = (x[order] for x in (cell, n, at, root))
    table = pa.table({"cell": cell, "n": n, "at": at, "root": root})
    got = [tuple(sorted(p)) for i, j in similar._pairs(table, 97) for p in zip(i.tolist(), j.tolist(), strict=True)]
    want = {(i, j) for i, j in combinations(range(300), 2) if cell[i] == cell[j] and root[i] != root[j] and 5 * n[i] >= 4 * n[j] and min(n[i] - at[i], n[j] - at[j]) >= similar.need(n[i], n[j])}
    assert len(got) == len(set(got)) and set(got) == want


def test_fingerprints_give_the_first_links(spark, monkeypatch):
    """Without the exact way: the links are the similar pairs whose five-word SimHash fingerprints are near, by all pairs."""

    def no_prefixes(n, words, shared):
        def run(batches):
            for _ in batches:
                yield from ()

        return run

    r, rows = random.Random(5), []
    for k in range(80):  # one copy each, so that what is near is similar
        base = [f"w{r.randrange(5000)}" for _ in range(200)]
        near = list(base)
        for i in r.sample(range(200), 1 + k % 4):
            near[i] = f"v{r.randrange(5000)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    sets, prints = {d: set(similar.shingles(t).tolist()) for d, t in rows}, {d: simhash.fingerprint(t, 5) for d, t in rows}
    near = {(x, y) for x, y in combinations(sorted(sets), 2) if (prints[x] ^ prints[y]).bit_count() <= similar.BITS}
    like = {(x, y) for x, y in combinations(sorted(sets), 2) if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])}
    far = [p for p in near if (prints[p[0]] ^ prints[p[1]]).bit_count() > 4]
    assert near < like and far  # so that any forest of near pairs has the same groups, some of them wider than a link of op2
    texts = spark.createDataFrame(rows, "t long, text string").repartition(3)
    full = {r["node"]: r["root"] for r in similar.similar(texts).collect()}
    monkeypatch.setattr(similar, "_prefixes", no_prefixes)
    some = {r["node"]: r["root"] for r in similar.similar(texts).collect()}
    for got, pairs in ((some, near), (full, like)):
        a, b = simhash.forest(*(np.array(x) for x in zip(*pairs, strict=True)))
        want = dict(zip(a.tolist(), b.tolist(), strict=True))
        assert {n: r for n, r in got.items() if n != r} == want
    assert "SimHash near-dedup" in [n for n, _ in corpus_pipeline.STAGES]


def test_wide_links_in_three_blocks(spark):
    """Fingerprints eight bits apart, two or three of them in each block, as their covering has to join them."""
    r = random.Random(3)
    prints = [r.getrandbits(64) for _ in range(300)]
    for x in prints[:150]:
        for k in (8, 9):
            prints.append(x ^ sum(1 << i for i in r.sample(range(64), k)))
    prints = list(dict.fromkeys(prints))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = simhash.linked(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3), len(prints), similar.BITS, similar.BLOCKS).collect()
    want = [(x, y) for x, y in combinations(signed, 2) if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= similar.BITS]
    roots = lambda pairs: sorted(zip(*(x.tolist() for x in simhash.forest(*(np.array(x) for x in zip(*pairs, strict=True)))), strict=True))
    assert len(want) >= 150 and roots(want) == roots({(r["a"], r["b"]) for r in got})
