import random
import re

import numpy as np
import pyarrow as pa

from larkspur.llm import minhash as M
from larkspur.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else set()


def components(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    edges = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    comp = components({i for i, _ in rows}, edges)
    return sorted((i, len(s), comp[i], comp[i] == i) for i, s in sets)


def corpus(rng):
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocab, k=rng.randint(20, 300))
        for _ in range(rng.choice([1, 2, 3, 30])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(t) // 40, len(t) // 8])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append(" ".join(t))
    passage = " ".join(rng.choices(vocab, k=60))
    rows += [passage + " " + " ".join(rng.choices(vocab, k=rng.randint(5, 40))) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL", 4)
    monkeypatch.setattr(M, "BLOCK", 7)
    monkeypatch.setattr(M, "DENSE", 0.1)
    rows = corpus(random.Random(11))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "ONE\ttwo"), (5005, "x " * 60_000), (10, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, M.near_duplicates(df, width=4).collect()))
    assert got == brute(rows, 4, 80)
    assert M.near_duplicates(df.limit(0)).count() == 0


def test_ids_with_several_texts_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (2, "a b c d e f"), (3, "g h i j k l"), (None, "a b c d e f"), (4, "lone words here for one")]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, None: None, 4: 4} and len(got) == 6


def test_estimate():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    other = np.concatenate([base[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    low = M.minima(np.concatenate([base, other]), np.array([0, 1000, 2000]))
    sig = M.pack_bits(low & 15)
    assert abs(M.estimate(M.agreement(sig[0], sig[1])) - 800 / 1200) < 0.15
    h, before = M.shingle_sets(pa.array(["a b c d", None, "A  b\nc d", "a b"]), 4)
    assert np.diff(before).tolist() == [1, 0, 1, 1] and h[0] == h[1] != h[2]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(1000, 1000 + k) for k in range(50)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame([*edges, (7, None)], "a long, b long")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n in {x for a, b in edges if a != b for x in (a, b)}}


def test_an_id_with_three_texts_ties_all_its_classes(spark):
    texts = ["a b c d e f", "g h i j k l", "m n o p q r"]
    rows = [*enumerate(texts, 1), *[(5, t) for t in texts]]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(1, 1, True), (2, 1, False), (3, 1, False)] + [(5, 1, False)] * 3
