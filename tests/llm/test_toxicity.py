import random
import zlib

import naive
import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import toxicity as T


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abdeghinorst", k=rng.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(3, 150))
        y = int(i % 3 == 0)
        if y:
            words[rng.randrange(len(words))] = rng.choice(["loser", "zuckface" + rng.choice(plain), "Trash,"])
        out.append((i, " ".join(words), y))
    return out


def test_gradients():
    words, codes, before = T.words_of(pa.array(["a bb ccc dd a e", "f gg", "hh a bb " * 9]))
    vocab, model = T.Vocabulary(words), T.Model(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    start, size, text = T.windows(before)
    mask = np.arange(T.WIDTH) < size[:, None]
    cells = codes[np.minimum(start[:, None] + np.arange(T.WIDTH), len(codes) - 1)]
    y = (text % 2).astype(float)
    _, g = model.gradients(vocab, cells, mask, y)
    rng = np.random.default_rng(0)
    for k, v in g.items():
        flat = model.p[k].reshape(-1)
        for i in rng.choice(np.flatnonzero(v), min(3, np.count_nonzero(v)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-4
            up = model.gradients(vocab, cells, mask, y)[0]
            flat[i] = old - 1e-4
            down = model.gradients(vocab, cells, mask, y)[0]
            flat[i] = old
            # states are kept in single precision
            assert abs((up - down) / 2e-4 - v.reshape(-1)[i]) < 2e-3 + 0.05 * abs(v.reshape(-1)[i]), k


def test_windows_cover_every_word():
    n = np.array([0, 1, 31, 32, 33, 48, 49, 500])
    start, size, text = T.windows(np.concatenate([[0], np.cumsum(n)]))
    for t, k in enumerate(n):
        own = sorted(x for s, z, w in zip(start, size, text) if w == t for x in range(s, s + z))
        assert sorted(set(own)) == list(range(n[:t].sum(), n[:t].sum() + k))


def test_fit_and_score(spark):
    rows = corpus(900, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(10_000, None), (10_001, ""), (10_002, "?! ."), (10_003, "a " * 100_000 + "loser")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(None, 1, 1), (5, None, 0)], "doc_id long, toxic int, text int")
    model = T.fit(docs, labels)
    got = {r["doc_id"]: r for r in T.score(docs, model).collect()}
    assert len(got) == 904 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert [got[10_000 + k]["predicted"] for k in range(4)] == [0, 0, 0, 1]
    out = [(got[i]["predicted"], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in out) / len(out) > 0.95
    assert T.score(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="both kinds"):
        T.fit(docs, labels.where("toxic = 0"))


def test_a_class_of_long_texts_only_is_learned(spark):
    rows = [(i, " ".join(t.split() * 200)[:4000] if y else t[:300], y) for i, t, y in corpus(300, 4)]
    rows = [(i, t.replace(" ", " scumbag ") if y else t, y) for i, t, y in rows]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(k, None) for k in range(1000, 1400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(k, 0) for k in range(1000, 1400)], "doc_id long, toxic int")
    model = T.fit(docs, labels, toxic_docs=60, clean_docs=100, max_chars=400)
    got = {r["doc_id"]: r["predicted"] for r in T.score(docs, model).collect()}
    assert np.mean([got[i] == y for i, _, y in rows]) > 0.95


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    for v in np.unique(score):
        same = np.flatnonzero(score[order] == v)
        rank[order[same]] = same.mean() + 1
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_scores_against_a_plain_version(spark):
    model = T.Model(3)
    rng = random.Random(8)
    texts = [None, "", "!?", "a", "One two THREE", "été über 漢字 x9", *[" ".join(rng.choices(["alpha", "Beta", "g", "delta", "zz9", "été"], k=n)) for n in (31, 32, 33, 48, 49, 150)]]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(3, "a", 2.0), (None, "One two THREE", 3.0)], "doc_id long, text string, score double").repartition(2)
    got = T.score(docs, model).collect()
    assert len(got) == len(texts) + 2 and sum(r["doc_id"] == 3 for r in got) == 2
    for r in got:
        want = naive.toxicity(model.p, texts[r["doc_id"]] if r["doc_id"] is not None else texts[4])
        assert abs(r["score"] - want) < 1e-4 and r["predicted"] == int(r["score"] >= 0.5)


def test_the_network_does_what_word_counts_cannot():
    """Texts are toxic where two words meet in one order; each word alone is as frequent in clean ones."""
    rng = random.Random(2)
    plain = ["".join(rng.choices("bdfgklmnprst", k=5)) for _ in range(60)]
    texts, y = [], []
    for i in range(900):
        words = rng.choices(plain, k=rng.randint(20, 60))
        pair = ["crowz", "mothz"] if i % 2 else ["mothz", "crowz"]
        at = rng.randrange(len(words))
        words[at:at] = pair
        texts.append(" ".join(words))
        y.append(i % 2)
    y = np.array(y, float)
    model = T.train(pa.array(texts[:700]), y[:700])
    words, codes, before = T.words_of(pa.array(texts[700:]))
    vec = model.inputs(T.Vocabulary(words))
    start, size, of = T.windows(before)
    score = np.zeros(200)
    np.maximum.at(score, of, model.scores(vec, codes, start, size))
    fresh = T.Model()
    train_words, train_codes, train_before = T.words_of(pa.array(texts[:700]))
    T._evidence(fresh, T.Vocabulary(train_words), train_codes, train_before, y[:700], np.ones(700, bool))
    odds = fresh.inputs(T.Vocabulary(words))[:, [0, T.DIM]].max(1)[codes]
    start_only = np.array([odds[a:b].max() for a, b in zip(before[:-1], before[1:])])
    assert auc(score, y[700:]) > 0.9 > 0.65 > auc(start_only, y[700:])
