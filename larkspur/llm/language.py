"""Language identification by Bayesian fusion of evidence.

The text's likelihood comes from hashed byte-trigram models of each language. It is combined with the language that the
markup declares, with the address suffix, and with a prior of the host. Host priors are smoothed level by level (all
rows, suffix, registered domain, host) and are computed by grouped aggregation of the text posteriors; a row's own text
never counts in its own prior. How far a declared language can be trusted is learned from the same aggregation.

Cases: null, empty and letterless texts carry no evidence and are rejected with language "und". Null declared languages,
urls and hosts add nothing. Texts of any length are read whole. Repeated rows are each judged. An empty table gives no
rows; fit() without labelled rows that have a text raises NoLabels. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.runtime import ascii_lower, forget, map_batches, materialize, sampled_texts, sliced
from larkspur.llm.url_filter import registered_domain, suffix

#: Training documents of each language (those with the smallest hash of their id); and of how many languages the driver
#: holds the texts at a time.
SAMPLE_DOCS, SAMPLE_CHARS = 600, 8000
LANGUAGES_AT_ONCE = 64

SLOTS = 1 << 16
#: Rows that a prior of the level above counts as.
PRIOR_ROWS = 20.0
#: Weight of a trigram: neighbours overlap, so they are no independent evidence.
TEMPER = 0.2
#: Accepted where the winner has this posterior, and where the text is of known languages at all: the mean over its
#: trigrams of the best language's log-likelihood lies no further below that of the training documents. A text in two
#: known languages is accepted, noise is not.
MIN_POSTERIOR, MAX_DEVIATIONS = 0.5, 12.0

_CLASS = np.full(256, 0x20, np.uint8)
_CLASS[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_CLASS[65:91] = range(97, 123)


def trigrams(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of letters and word ends, the text of each, and the number of each text's trigrams. Everything but letters counts as a space, and runs of spaces as one."""
    from larkspur.llm.words import text_bytes

    buf, ends = text_bytes(texts)
    n = len(ends)
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    text = np.repeat(np.arange(n, dtype=np.int32), np.diff(ends, prepend=0))
    c = _CLASS[buf]
    space = c == 0x20
    keep = np.ones(len(c), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (text[1:] == text[:-1]))
    c, text = c[keep].astype(np.uint32), text[keep]
    same = text[2:] == text[:-2]
    h = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1]) * np.uint32(0x85EBCA6B) + c[2:]
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    h, text = h[same].astype(np.int64), text[2:][same]
    return h, text, np.bincount(text, minlength=n).astype(np.int64)


class NoLabels(ValueError):
    """There is nothing to learn from."""


class TextModel:
    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table, self.mean, self.spread = names, np.concatenate([table, table.max(0, keepdims=True)]), 0.0, 1.0

    def _means(self, texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, text, n = trigrams(texts)
        out = np.zeros((len(n), len(table)))
        if len(h):
            first = np.flatnonzero(np.diff(text, prepend=-1))
            for k in range(len(table)):
                out[text[first], k] = np.add.reduceat(table[k][h], first, dtype=np.float64)
        return out / np.maximum(n, 1)[:, None], n

    def mean_likelihoods(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean log-likelihood of a text's trigrams under each language, that under each trigram's best language, and the number of trigrams."""
        out, n = self._means(texts, self.table)
        return out[:, :-1], out[:, -1], n

    def best_likelihoods(self, texts) -> np.ndarray:
        return self._means(texts, self.table[-1:])[0][:, 0]


def _sample_ids(known: DataFrame, counts: dict, per_language: int) -> list[tuple]:
    """(doc_id, lang) of the per_language smallest hashes of each language in counts (lang: rows)."""
    out, share = [], {x: min(1.0, 1.5 * per_language / c) for x, c in counts.items()}
    while share:
        cuts = [(x, min((1 << 63) - 1, int(v * (1 << 64)) - (1 << 63))) for x, v in share.items()]
        some = known.join(F.broadcast(known.sparkSession.createDataFrame(cuts, "lang string, cut long")), "lang")
        found = {x: set() for x in share}
        for r in some.withColumn("h", F.xxhash64("doc_id")).where("h <= cut").select("lang", "h", "doc_id").distinct().toLocalIterator():
            found[r["lang"]].add((r["h"], r["doc_id"]))
        for x, ids in found.items():
            if len(ids) >= per_language or share[x] == 1.0:
                out += [(i, x) for _, i in sorted(ids)[:per_language]]
                del share[x]
            else:  # repeated ids, or chance
                share[x] = min(1.0, 4 * share[x])
    return out


def fit(docs: DataFrame, lang_col: str = "lang", per_language: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS) -> TextModel:
    """Trigram models from a bounded sample of labelled documents."""
    import pyarrow as pa

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.length(F.col("text").cast("string")).alias("size")).where("lang is not null and doc_id is not null and size > 0").drop("size")
    found = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    names = sorted(found)
    if not names:
        raise NoLabels("training needs labelled documents")

    def texts(block):
        ids = _sample_ids(known, {x: found[x] for x in block}, per_language)
        rows = sampled_texts(docs, docs.sparkSession.createDataFrame(ids, "doc_id long, lang string"), "lang", max_chars)
        of = {x: [] for x in block}
        for r in rows:
            of[r["lang"]].append(r["text"])
        return [pa.array(of[x], pa.string()) for x in block]

    blocks = [names[i : i + LANGUAGES_AT_ONCE] for i in range(0, len(names), LANGUAGES_AT_ONCE)]
    table = np.zeros((len(names), SLOTS), np.float32)
    for i, block in enumerate(blocks):
        samples = texts(block)
        for k, x in enumerate(samples, i * LANGUAGES_AT_ONCE):
            counts = np.bincount(trigrams(x)[0], minlength=SLOTS)
            table[k] = np.log((counts + 0.05) / (counts.sum() + 0.05 * SLOTS))
    model = TextModel(names, table)
    best = np.concatenate([model.best_likelihoods(x) for block in blocks for x in (samples if len(blocks) == 1 else texts(block))])
    low, model.mean = np.percentile(best, [25, 50]) if len(best) else (0.0, 0.0)
    model.spread = max(0.05, (model.mean - low) / 0.6745)
    return model


def text_scores(rows: DataFrame, model: TextModel) -> DataFrame:
    """rows (doc_id, text, declared, url, host) with the text replaced by logs and post array<double> (tempered log-likelihoods, and posteriors by the text alone), n_trigrams and fits."""
    known = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        forget()
        m = known.value
        for b in sliced(batches):
            mean, best, n = m.mean_likelihoods(b.column(1))
            total = mean * n[:, None] * TEMPER
            total -= total.max(1, keepdims=True)
            # short texts vary more
            fits = (n > 0) & (best >= m.mean - MAX_DEVIATIONS * np.sqrt(m.spread**2 + 4.0 / np.maximum(n, 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], _lists(total), _lists(_normal(total)), pa.array(n), pa.array(fits)], names=["doc_id", "declared", "host", "logs", "post", "n_trigrams", "fits"])

    cols = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("declared").cast("string"), F.col("host").cast("string"))
    return map_batches(cols, run, "doc_id long, declared string, host string, logs array<double>, post array<double>, n_trigrams long, fits boolean")


def _normal(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _lists(x: np.ndarray):
    import pyarrow as pa

    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def _matrix(column, n: int) -> np.ndarray:
    """A column of lists as rows of n numbers, zeros for null."""
    out = np.zeros((len(column), n))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return out


def _sums(col: str, n: int) -> list[Column]:
    return [F.sum(F.col(col)[k]).alias(f"s{k}") for k in range(n)]


def _list(n: int, prefix: str = "s") -> Column:
    return F.array(*[F.col(f"{prefix}{k}") for k in range(n)])


def identify(rows: DataFrame, model: TextModel, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """doc_id, lang, confidence, accepted, and the text's own choice text_lang: one row per input row.

    rows: doc_id, text, declared, host (any may be null). The texts are read once; everything after works on their
    likelihoods. A host, however large, is one partially aggregated group.
    """
    names, n = model.names, len(model.names)
    base = materialize(text_scores(rows, model), "language")
    base = base.withColumn("counts", F.col("n_trigrams") > 0)
    base = base.withColumn("host", F.when(F.trim("host") != "", ascii_lower(F.col("host"))))
    base = base.withColumn("said", F.regexp_extract(ascii_lower(F.coalesce("declared", F.lit(""))), r"^\s*([a-z]+)", 1))
    seen = base.where("counts and host is not null").groupBy("host").agg(F.count("*").alias("n"), *_sums("post", n))
    seen = seen.withColumn("dom", registered_domain(F.col("host"))).withColumn("suf", suffix(F.col("host")))
    up = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(n)])
    dom = up(seen, "dom", "suf")
    suf = up(dom, "suf")
    top = up(suf)
    shrink = lambda parent: [((F.col(f"s{k}") + prior_rows * F.col(parent)[k]) / (F.col("n") + prior_rows)) for k in range(n)]
    top = top.select(F.array(*[(F.coalesce(F.col(f"s{k}"), F.lit(0.0)) + 1.0) / (F.coalesce(F.col("n"), F.lit(0)) + float(n)) for k in range(n)]).alias("tm"))
    suf = suf.crossJoin(F.broadcast(top)).select("suf", F.array(*shrink("tm")).alias("sm"))
    dom = dom.join(suf, "suf").select("dom", "suf", F.array(*shrink("sm")).alias("dm"))
    hosts = seen.join(dom, ["dom", "suf"]).select("host", F.col("n").alias("hn"), _list(n).alias("hs"), "dm")
    # how often each language is declared, by the text's posterior: one small row for each declared name that is a language
    said = base.where(F.col("counts") & F.col("said").isin(*names)).groupBy("said").agg(*_sums("post", n))
    of = {r["said"]: [r[f"s{k}"] for k in range(n)] for r in said.collect()}
    trust = np.array([of.get(d, [0.0] * n) for d in names]) + 0.5 + 4.5 * np.eye(n)
    trust = np.log(trust / trust.sum(0))  # [declared][true]
    spot = {d: k for k, d in enumerate(names)}
    overall = np.array(top.first()["tm"])
    label = np.array(names, dtype=object)

    def decide(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            c = dict(zip(b.schema.names, b.columns))
            counts = c["counts"].to_numpy(zero_copy_only=False)
            logs, post = _matrix(c["logs"], n), _matrix(c["post"], n)
            own = counts.astype(float)[:, None]
            rows = c["hn"].fill_null(0).to_numpy(zero_copy_only=False).astype(float)[:, None]
            prior = (_matrix(c["hs"], n) - own * post + prior_rows * _matrix(c["dm"], n)) / np.maximum(rows - own + prior_rows, 1e-9)
            prior = np.where(c["hn"].is_valid().to_numpy(zero_copy_only=False)[:, None], prior, overall)
            logs += np.log(np.maximum(prior, 1e-9))
            said = np.array([spot.get(d, -1) for d in c["said"].to_pylist()], np.int64)
            logs[said >= 0] += trust[said[said >= 0]]
            final = _normal(logs)
            top_p = final.max(1)
            ok = counts & (top_p >= MIN_POSTERIOR) & c["fits"].to_numpy(zero_copy_only=False)
            lang = np.where(counts, label[final.argmax(1)], "und")
            alone = np.where(counts, label[post.argmax(1)], None)
            yield pa.RecordBatch.from_arrays([c["doc_id"], pa.array(lang, pa.string()), pa.array(top_p), pa.array(ok), pa.array(alone, pa.string())], names=["doc_id", "lang", "confidence", "accepted", "text_lang"])

    # rows without a host find none: keys of their own spread them, and Spark splits a host with very many rows
    base = base.withColumn("host", F.coalesce("host", F.concat(F.lit("\0"), F.pmod(F.xxhash64("doc_id", "logs"), F.lit(1 << 20)).cast("string"))))
    joined = base.join(hosts, "host", "left").select("doc_id", "logs", "post", "counts", "fits", "said", "hn", "hs", "dm")
    return map_batches(joined, decide, "doc_id long, lang string, confidence double, accepted boolean, text_lang string")
