import zlib

import numpy as np
import pytest

from larkspur.llm import store
from larkspur.llm.runtime import scratch

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, digest string"


def write(spark, rows):
    path = scratch(spark, "t")
    store.write_store(spark.createDataFrame(rows, SCHEMA).repartition(3), path, P.path("word_bpe_49k.json"))
    return path


def test_exact_round_trip_and_digests(spark):
    long = " ".join(f"word{i * 7919 % 1000} and" for i in range(6000))
    rows = [(5, "b c", "x"), (1, None, None), (2, "", ""), (3, long, ""), (4, long + " end", ""), (9, long, ""), (9, long, ""), (-4, "été\n  x", ""), (None, "no id", "")]
    path = write(spark, rows)
    tok = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in rows}
    at, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        want.append((i, at, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        at += len(ids[i])
    got = sorted(map(tuple, store.read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == want
    back = {(r["doc_id"], r["start"]): r["ids"] for r in store.read_ids(spark, path).collect()}
    assert back == {(w[0], w[1]): ids[w[0]] for w in want}
    assert store.verify(spark, path).count() == 0 and len(store.store_root(spark, path)) == 32
    # copies share their chunks
    assert store.chunks(spark, path).count() == store.chunks(spark, path).select("digest").distinct().count()
    assert store.chunks(spark, path).agg({"n": "sum"}).first()[0] < 1.2 * len(ids[4]) + 200


def test_empty(spark):
    path = write(spark, [])
    assert store.read_digests(spark, path).count() == 0 and store.read_ids(spark, path).count() == 0


def rewritten(spark, path, part, change):
    """The store with one of its parts changed."""
    df = spark.read.parquet(f"{path}/{part}")
    rows = [r.asDict() for r in df.collect()]
    change(rows)
    spark.createDataFrame(rows, df.schema).write.mode("overwrite").parquet(f"{path}/{part}-new")
    other = path + "-other"
    for name in ("packed", "recipes", "manifest"):
        spark.read.parquet(f"{path}/{name}-new" if name == part else f"{path}/{name}").write.mode("overwrite").partitionBy(*(["kind"] if name == "packed" else [])).parquet(f"{other}/{name}")
    return other


def flip(key, where=lambda r: True):
    def change(rows):
        r = max((r for r in rows if where(r)), key=lambda r: len(r[key]))
        r[key] = bytes([r[key][0] ^ 1]) + bytes(r[key][1:])

    return change


def swap_chunks(rows):
    r = max(rows, key=lambda r: len(r["digests"]))
    d = bytes(r["digests"])
    r["digests"] = d[16:32] + d[:16] + d[32:]


def drop_first(rows):
    del rows[0]


@pytest.mark.parametrize(
    ("part", "change"),
    [("packed", flip("data", lambda r: r["kind"] == 0)), ("packed", flip("key", lambda r: r["kind"] == 0)), ("recipes", flip("digests")), ("recipes", flip("lens")), ("recipes", flip("leaf")), ("recipes", swap_chunks), ("recipes", drop_first), ("manifest", flip("root")), ("manifest", drop_first)],
)
def test_damage_is_noticed(spark, part, change):
    path = write(spark, [(i, " ".join(f"w{i}x{j * 31 % 977}" for j in range(900)), "") for i in range(4)])
    assert store.read_digests(spark, path).count() == 4
    with pytest.raises(Exception, match="damaged|differs|no chunk"):
        store.read_digests(spark, rewritten(spark, path, part, change)).collect()


def test_chunks_are_kept_once_however_little_a_task_remembers(spark, monkeypatch):
    monkeypatch.setattr(store, "TASK_CHUNKS", 1)
    text = " ".join(f"w{j * 31 % 977}" for j in range(3000))
    path = write(spark, [(i, text, "") for i in range(30)])
    found = store.chunks(spark, path)
    assert found.count() == found.select("digest").distinct().count() > 3


def test_crc_shift():
    a, b = b"some bytes", b"more of them" * 50
    got = store.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))[0] ^ zlib.crc32(b)
    assert got == zlib.crc32(a + b)


def test_chunks_depend_on_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49000, 30_000).astype(np.uint32)
    a = store.chunk_ends(ids, np.array([len(ids)]))
    moved = np.concatenate([rng.integers(0, 49000, 77).astype(np.uint32), ids])
    b = store.chunk_ends(moved, np.array([len(moved)])) - 77
    assert len(set(a) & set(b)) > 0.9 * len(a)
    lens = np.diff(a, prepend=0)
    assert lens.max() <= store.MAX_CHUNK and lens[:-1].min() >= store.MIN_CHUNK
