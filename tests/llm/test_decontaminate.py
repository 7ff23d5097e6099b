import hashlib
import random
import re

import numpy as np

from larkspur.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench, width):
    wins = {}
    for i, t in bench:
        w = fold(t)
        for k in range(max(len(w) - width, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + width]), set()).add(str(i) if i is not None else "")
    out = []
    for d, t in docs:
        w, hit, items = fold(t), set(), set()
        for n in {len(p) for p in wins}:
            for k in range(len(w) - n + 1):
                if own := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= own
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocab = ["a", "B", "c", "dé", "ff", "9", "漢"]
    text = lambda n: "".join(w + rng.choice([" ", ", ", "\n", "-"]) for w in rng.choices(vocab, k=n))
    bench = [(i, text(rng.choice([2, 5, 6, 12]))) for i in range(25)] + [(3, "a b c"), (None, "ff ff ff"), (77, None), (78, ""), (79, " .,")]
    docs = [(i, text(rng.randint(0, 90))) for i in range(150)] + [(200, None), (201, ""), (202, "zz " * 30), (203, bench[0][1]), (203, bench[0][1]), (204, text(4000)), (None, text(50))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = sorted((tuple(r) for r in D.decontaminate(d, b, 6).select(columns).collect()), key=str)
    assert got == brute(docs, bench, 6)
    monkeypatch.setattr(D, "PASS_BYTES", 100)  # several passes give the same
    assert sorted((tuple(r) for r in D.decontaminate(d, b, 6).select(columns).collect()), key=str) == got
    assert D.decontaminate(d.limit(0), b).count() == 0
    assert D.decontaminate(d, b.limit(0)).where("contaminated").count() == 0


def test_removal(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two, THREE four! And this é"), (2, None)], "doc_id long, text string")
    found = D.locate(docs, spark.createDataFrame([(1, "one two three four")], "item_id long, text string"), 3)
    got = {r[0]: r[1] for r in found.select("doc_id", D.remove_spans(found["text"], found["hits"])).collect()}
    assert got == {1: "Keep this. ! And this é", 2: None}


def test_index():
    rng = np.random.default_rng(0)
    seq = rng.integers(0, 6, 3000)
    seq[0] = seq[-1] = 0
    index = D.FMIndex(seq, 6)
    pats = rng.integers(1, 6, (50, 3))
    lo, hi = index.search(pats)
    for p, a, b in zip(pats, lo, hi):
        want = [i for i in range(len(seq) - 2) if (seq[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
