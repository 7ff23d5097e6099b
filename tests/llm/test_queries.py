"""Queries with a contract, against brute force on small tables."""

import math
import zlib

import numpy as np
import pytest

from larkspur.llm import packing, url_filter

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


def test_packing_gives_back_every_document(spark):
    texts = [None, "", "one", "été " * 50, "some words and more of them " * 900]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(2, "one", 0), (None, "x", 0)], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack(docs, P.path("byte_bpe_50k.json")).collect()
    tok = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        own = own[::2] if i == 2 else own  # the repeated row
        assert [x for r in own for x in np.frombuffer(r["ids"], "<u4").tolist()] == ids
        assert all(r["length"] == 1 << r["bucket"] <= 2048 and r["doc_tokens"] == len(ids) for r in own)
        assert all(zlib.crc32(r["ids"]) == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
    assert packing.pack(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(docs, P.path("byte_bpe_50k.json"), seq_len=1000)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

URLS = {
    "http://a.NET/x": ("a.net", "/x", "net/", "block"),
    "http://net/": ("net", "/", "net/", "block"),
    "http://a.net": ("a.net", "", None, None),
    "https://example.net/en/1?q=/de/": ("example.net", "/en/1", "example.net/en/", "allow"),
    "https://b.example.net/EN/": ("b.example.net", "/EN/", "net/", "block"),
    "http://notexample.com/de/": ("notexample.com", "/de/", None, None),
    "http://x.example.com/de/#f": ("x.example.com", "/de/", "example.com/de/", "block"),
    "ftp://É.org/fr/a": ("É.org", "/fr/a", "org/fr/", "allow"),
    "http://h?x=://y": ("h", "", None, None),
    "no scheme": ("", "", None, None),
    "": ("", "", None, None),
    None: ("", "", None, None),
    "http://h#a/b": ("h", "", None, None),
}


@pytest.mark.parametrize("most", [10_000, 1])
def test_rules(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
    monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", most)
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, "http://a.NET/x", "x"), (None, "http://q.org/", "x")], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = url_filter.filter_urls(pages, rules, labels).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r["page_id"] is not None:
            host, path, rule, verdict = list(URLS.values())[r["page_id"]]
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert url_filter.filter_urls(pages.limit(0), rules, labels).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules.limit(0), labels).collect()} == {"allow"}


def test_reputation_shrinks(spark):
    urls = [f"http://bad.site.com/{i}" for i in range(60)] + [f"http://good.site.org/{i}" for i in range(60)] + ["http://new.site.com/1", "http://one.other.org/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = [(i, int(u.startswith("http://bad"))) for i, u in enumerate(urls[:120])] + [(121, 1), (5, 0), (None, 1), (7, None)]
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame(labels, "page_id long, bad int"), threshold=0.3).collect()}
    assert {got[i]["verdict"] for i in range(60)} == {"block"} and {got[i]["verdict"] for i in range(60, 120)} == {"allow"}
    assert got[121]["verdict"] == "allow"  # one bad page proves little
    assert got[120]["host_labelled"] == 0


def test_tail_of_the_posterior(spark):
    """Against sums of binomial terms (whole parameters) and a fine integral."""
    def exact(a, b, x):
        return sum(math.comb(a + b - 1, j) * x**j * (1 - x) ** (a + b - 1 - j) for j in range(a))  # share above x

    def fine(a, b, x):
        y = np.linspace(0, 1, 2_000_001)[1:-1] ** 2  # dense near 0
        f = (a - 1) * np.log(y) + (b - 1) * np.log1p(-y)
        f = np.exp(f - f.max())
        area = np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2 * np.diff(y))])
        return 1 - np.interp(x, y, area) / area[-1]

    whole = [(a, b, x) for a in (1, 2, 7, 40) for b in (1, 3, 60) for x in (0.05, 0.2, 0.9)]
    odd = [(0.9, 20.5, 0.2), (2.5, 3.7, 0.2), (0.7, 1.2, 0.6), (900.5, 4000.5, 0.2), (5000.5, 10.5, 0.2), (0.5, 9000.5, 0.2)]
    for x in {w[2] for w in whole + odd}:
        own = [(float(a), float(b)) for a, b, y in whole + odd if y == x]
        df = spark.createDataFrame(own, "a double, b double")
        got = {(r["a"], r["b"]): r["p"] for r in df.select("a", "b", url_filter.tail(df["a"], df["b"], x).alias("p")).collect()}
        for a, b in own:
            assert abs(got[a, b] - (exact(int(a), int(b), x) if (a, b, x) in [(float(p), float(q), y) for p, q, y in whole] else fine(a, b, x))) < 2e-4, (a, b, x)


def test_strength_follows_the_variation_of_hosts(spark):
    rng = np.random.default_rng(3)
    for k in (4.0, 60.0):
        p = rng.beta(k * 0.3, k * 0.7, 3000)
        df = spark.createDataFrame([(f"d{i % 5}", 40, int(rng.binomial(40, q))) for i, q in enumerate(p.tolist())], "dom string, n long, bad long")
        got = url_filter.strength(df, ["dom"], "k").first()["k"]
        assert 0.8 * k < got < 1.25 * k
    assert url_filter.strength(df.limit(0), ["dom"], "k").first()["k"] == url_filter.STRENGTH
    assert url_filter.strength(df.withColumn("bad", df["n"] * 0 + 12), ["dom"], "k").first()["k"] == url_filter.MOST_STRENGTH


def test_public_suffixes(spark):
    hosts = ["a.b.co.uk", "co.uk", "x.com.au", "a.example.com", "com", "", "co.com", "h"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = [(r["d"], r["s"]) for r in df.select(url_filter.registered_domain(df["host"]).alias("d"), url_filter.suffix(df["host"]).alias("s")).collect()]
    assert got == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("x.com.au", "com.au"), ("example.com", "com"), ("com", "com"), ("", ""), ("co.com", "com"), ("h", "h")]


def test_one_hosts_own_pages_do_not_make_its_prior(spark):
    """A large bad host next to a small good one: the small one is judged by others."""
    urls = [f"http://big.site.com/{i}" for i in range(400)] + [f"http://h{j}.other{j % 9}.com/{i}" for j in range(60) for i in range(5)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = [(i, int(i < 400)) for i in range(len(urls))]
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert {got[i] for i in range(400)} == {"block"} and {got[i] for i in range(400, len(urls))} == {"allow"}
