import random

import naive
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from larkspur.llm import runtime, toxicity

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choices(["the", "and", "ing", "th", "er", "on"], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = sentence(rng, rng.randint(20, 80)).split()
        if toxic:
            words.insert(rng.randrange(len(words)), "scumbag")
        rows.append((i, " ".join(words), "en", f"src{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    base = rows[1][1].split()
    bench = sentence(rng, 14)
    rows += [(1001, " ".join(base), "en", None, 0), (1002, " ".join(base[:-1] + ["zz"]), "en", "src0", 0), (1003, sentence(rng, 30) + " " + bench + " " + sentence(rng, 30), "en", "src1", 0)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "#### 12 ##", "en", "s", 0), (2003, sentence(rng, 40), "en", "s", 0), (2003, "and other ther and on the thing and so on", "en", "s", 0), (None, sentence(rng, 25), "en", "s", 0), (2004, sentence(rng, 9000), "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


def test_stages(spark, tables):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = C.drop_toxic(spark, docs, d)
    got = ids(clean)
    assert clean.columns == docs.columns and {i for i in range(0, 400, 4)}.isdisjoint(got) and set(got) >= {i for i in range(400) if i % 4} | {1001, 2000, None}
    known = runtime.materialize(C.drop_unknown_language(spark, clean, d), "t")
    assert sorted(set(got) - set(ids(known)), key=str) == [2000, 2001, 2002]
    once = runtime.materialize(C.drop_near_duplicates(spark, known, d), "t")
    assert once.columns == docs.columns and set(ids(known)) - set(ids(once)) == {1001, 1002} and ids(once).count(2003) == 1
    last = C.drop_benchmark(spark, once, d)
    assert set(ids(once)) - set(ids(last)) == {1003}
    pieces = C.pack(spark, last, d).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r["doc_id"] for r in pieces} == set(ids(last)) and all(r["n"] == r["m"] for r in pieces)


def test_empty(spark, tables, tmp_path):
    d, _ = tables
    none = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, none, d).count() == 0


def test_without_ids(spark, monkeypatch):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).union(spark.createDataFrame([(None, "n")], "doc_id long, text string"))
    dropped = spark.range(5000).where("id % 3 = 0")
    want = [i for i in range(5000) if i % 3] + [None]
    assert ids(runtime.without_ids(docs, dropped)) == sorted(want, key=str)
    monkeypatch.setattr(runtime, "FILTER_BITS_EACH", 0)
    monkeypatch.setattr(runtime, "FILTER_HASHES", 1)
    assert ids(runtime.without_ids(docs, dropped)) == sorted(want, key=str)


def test_every_stage_against_a_plain_version(spark, tables):
    """What run() keeps and packs, stage by stage, from the rows that the plain version of the stage before kept."""
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    kept = [r for r in rows if naive.toxicity(model.p, r[1]) < 0.5]
    once = {i: [t for j, t, _, _, _ in kept if j == i] for i, *_ in kept}
    train = [(naive.sampled(t), x) for i, t, x, _, _ in kept if t and x and i is not None and len(once[i]) == 1]  # of a repeated id one row stands in the sample
    assert len(train) < 600
    judged = naive.languages(train, [(t, None, s) for _, t, _, s, _ in kept])
    any_row: dict = {}
    for r, (_, _, ok) in zip(kept, judged):
        any_row[r[0]] = any_row.get(r[0], False) or ok
    kept = [r for r in kept if r[0] is None or any_row[r[0]]]
    single = {r[0]: r[1] for r in kept if r[0] is not None and sum(x[0] == r[0] for x in kept) == 1}
    comp = naive.components(single, 5, 80)
    doubled = {r[0] for r in kept} - set(single)
    kept = [r for r in kept if r[0] in doubled or comp[r[0]] == r[0]]
    bench = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    kept = [r for r in kept if not naive.has_window(r[1], bench, 10)]
    tok = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got: dict = {}
    for r in C.run(spark, d).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {r[0] for r in kept}
    for i, own in got.items():
        own.sort(key=lambda r: r["start"])
        texts = [r[1] for r in kept if r[0] == i]
        wants = [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
        assert any([(r["start"], naive.crc(w[r["start"] : r["start"] + r["length"]])) for r in own] == [(r["start"], r["ids_crc32"]) for r in own] and sum(r["length"] for r in own) == len(w) for w in wants)
        assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0 for r in own)
    assert len({r["sequence_id"] for own in got.values() for r in own}) == sum(map(len, got.values()))
