import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import embeddings as E


def brute(ids, x, threshold=0.95):
    ok = [v is not None and len(v) == 24 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x]
    u = np.array([np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else np.zeros(24) for v, k in zip(x, ok)])
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    comp = np.array(ids)
    while True:
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    return sorted((ids[i], int(link[i].sum()), int(comp[i]), bool(comp[i] == ids[i])) for i in range(len(ids)))


def data(rng):
    rows = []
    for _ in range(60):
        base = rng.standard_normal(24)
        rows += [(base + rng.standard_normal(24) * s * np.linalg.norm(base) / 24**0.5).tolist() for s in rng.choice([0.05, 0.15, 0.25], rng.integers(1, 12))]
    base = rng.standard_normal(24)
    rows += [(base + rng.standard_normal(24) * 0.1).tolist() for _ in range(80)] + [rows[3]] * 4 + [[2 * c for c in rows[3]]]
    return [[float(np.float32(c)) for c in v] for v in rows]


def test_against_brute_force(spark, monkeypatch):
    for name, few in (("MEMBERS", 16), ("VISITORS", 24), ("CELLS", 64)):
        monkeypatch.setattr(E, name, few)
    x = data(np.random.default_rng(5))
    x += [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] + [1.0] * 23, [1.0] * 23, [1e-30] * 24, [1e30] * 24]
    ids = [3 * i + 7 for i in range(len(x))]
    df = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, weight int").repartition(4)
    want = brute(ids, x)
    for reach in (0.5, 0.3):
        got = sorted(map(tuple, E.near_duplicates(df, reach=reach).collect()))
        if reach == 0.5:
            assert got == want  # no link can be missed
    links = lambda rows: sum(r[1] for r in rows)
    assert links(got) >= 0.99 * links(want) and all(a[1] <= b[1] for a, b in zip(got, want))


def test_empty_and_invalid(spark):
    schema = "vec_id long, embedding array<double>"
    assert E.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None), (2, [0.0, 0.0]), (None, [1.0, 2.0])]
    assert sorted(map(tuple, E.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]
    one = [(4, [1.0, 2.0]), (4, [1.0, 2.0])]
    assert sorted(map(tuple, E.near_duplicates(spark.createDataFrame(one, schema)).collect())) == [(4, 1, 4, True)] * 2


def brute_links(x, threshold=0.95):
    u = np.array(x, float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return (u @ u.T >= threshold).sum(1) - 1


def test_default_reach_finds_every_link_of_vectors_that_vary_in_few_directions(spark):
    rng = np.random.default_rng(8)
    base, plane = rng.standard_normal(64), rng.standard_normal((2, 64))
    group = base / np.linalg.norm(base) + rng.uniform(-0.7, 0.7, (900, 2)) @ (plane / np.linalg.norm(plane, axis=1, keepdims=True))
    steep = rng.standard_normal((1500, 64)) / np.arange(1, 65) ** 2
    x = np.concatenate([group, steep, rng.standard_normal((600, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in E.near_duplicates(df).collect()}
    want = brute_links(x)
    assert want.sum() > 10_000 and [got[i] for i in range(len(x))] == want.tolist()


def test_vectors_of_every_length_link(spark):
    rng = np.random.default_rng(9)
    rows = {}
    for k, dim in enumerate((8, 12)):
        base = rng.standard_normal((6, dim))
        x = np.repeat(base, 3 + k, 0) + 0.05 * rng.standard_normal((6 * (3 + k), dim))
        rows |= {100 * k + i: (v.tolist(), w) for i, (v, w) in enumerate(zip(x, brute_links(x).tolist()))}
    df = spark.createDataFrame([(i, v) for i, (v, _) in rows.items()], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in E.near_duplicates(df).collect()}
    assert got == {i: w for i, (_, w) in rows.items()}
    shared = df.withColumn("vec_id", F.col("vec_id") % 100).where("vec_id = 0 or size(embedding) = 12")
    assert sorted(r["n_links"] for r in E.near_duplicates(shared).where("vec_id = 0").collect()) == [0, rows[100][1]]
    assert all(sum(w for i, (_, w) in rows.items() if i // 100 == k) for k in (0, 1))
