import random

import naive
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import language as L

STEMS = {"en": ["the", "and", "ing", "th", "wh", "er"], "fr": ["eau", "le", "é", "que", "oi", "ai"], "de": ["sch", "ein", "ü", "der", "keit", "ung"]}
SCHEMA = "doc_id long, text string, lang string, declared string, host string"


def text(rng, lang, n):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n))


def corpus(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        out.append((i, text(rng, lang, rng.randint(5, 60)), lang, lang if i % 2 else None, f"h{i % 5}.{lang}.example.{lang}"))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(600)
    odd = [(1000, None, None, "en", None), (1001, "", None, None, ""), (1002, "#### 123 --", None, None, "h"), (1003, "zqxj qxzvk " * 40, None, None, None), (1004, text(random.Random(2), "de", 40_000), "de", "xx-YY", "HOST"), (None, rows[0][1], None, None, None), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    model = L.fit(df.where("doc_id % 5 <> 0"))
    got = L.identify(df, model).collect()
    assert len(got) == 607
    by = {r["doc_id"]: r for r in got}
    held = [by[r[0]] for r in rows if r[0] % 5 == 0]
    assert np.mean([r["accepted"] and r["lang"] == rows[r["doc_id"]][2] for r in held]) > 0.98
    assert [by[k]["lang"] for k in (1000, 1001, 1002)] == ["und"] * 3 and not any(by[k]["accepted"] for k in (1000, 1001, 1002, 1003))
    assert by[1004]["lang"] == "de" and by[1004]["accepted"]
    assert L.identify(df.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="labelled"):
        L.fit(df.limit(0))


def test_prior_decides_where_the_text_does_not(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, "fr", 30), "fr", None, "a.example.fr") for i in range(60)] + [(100 + i, text(rng, "en", 30), "en", None, "b.example.org") for i in range(60)]
    unclear = [(500, "xqx", None, None, "a.example.fr"), (501, "xqx", None, None, "other.example.org"), (502, "xqx", None, "en-GB", None)]
    df = spark.createDataFrame(rows + unclear, SCHEMA)
    got = {r["doc_id"]: r for r in L.identify(df, L.fit(df)).where(F.col("doc_id") >= 500).collect()}
    assert (got[500]["lang"], got[501]["lang"], got[502]["lang"]) == ("fr", "en", "en")


def test_every_labelled_language_has_a_model(spark):
    rng = random.Random(6)
    words = {f"l{chr(97 + k // 10)}{chr(97 + k % 10)}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(rng.choices(words[x], k=40)), x, None, None) for i, x in enumerate([x for x in words for _ in range(3)])]
    rows.append((10_000, rows[-1][1], None, rows[-1][2], None))
    df = spark.createDataFrame(rows, SCHEMA)
    model = L.fit(df)
    assert model.names == sorted(words)
    got = {r["doc_id"]: (r["lang"], r["accepted"]) for r in L.identify(df, model).collect()}
    assert all(got[r[0]] == (r[2] or rows[-2][2], True) for r in rows)


def test_a_language_of_long_texts_only_has_a_model(spark):
    rng = random.Random(7)
    rows = [(i, text(rng, x, 400 if x == "fr" else 20), x, None, None) for i, x in enumerate(["en", "fr", "de"] * 20)]
    df = spark.createDataFrame([*rows, (900, "", "xx", None, None)], SCHEMA)
    model = L.fit(df, max_chars=400)
    assert model.names == ["de", "en", "fr"]
    got = {r["doc_id"]: (r["lang"], r["accepted"]) for r in L.identify(df, model).collect()}
    assert all(got[r[0]] == (r[2], True) for r in rows)


def test_against_a_plain_version(spark):
    rng = random.Random(12)
    rows = corpus(90, 12)
    odd = [(500, None, None, "en", "h1.en.example.en"), (501, "12 34", None, None, "h1.en.example.en"), (502, text(rng, "fr", 4) + " " + text(rng, "en", 4), None, "DE-at", "New.example.en"), (503, "qqzz xxqj", None, "fr", None), (504, text(rng, "de", 3), None, "xx", "  "), (505, text(rng, "de", 3), None, " en", "H0.fr.example.FR"), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumn("fits", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    got = sorted(((r["doc_id"], r["lang"], r["confidence"], r["accepted"]) for r in L.identify(df, L.fit(df.where("doc_id % 2 = 0 and doc_id < 400"))).collect()), key=lambda r: r[:2])
    # the repeated row stands twice in the sample's table, once in the sample
    want = naive.languages([(t, x) for i, t, x, _, _ in rows if i % 2 == 0], [(t, d, h) for _, t, _, d, h in rows + odd])
    want = sorted(((r[0], *w) for r, w in zip(rows + odd, want)), key=lambda r: r[:2])
    assert [(a[0], a[1], a[3]) for a in got] == [(b[0], b[1], b[3]) for b in want]
    assert max(abs(a[2] - b[2]) for a, b in zip(got, want)) < 1e-5
