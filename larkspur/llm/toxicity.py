"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word is the concatenation of a word embedding and of the maximum over embeddings of its character n-grams (3 to 5
bytes, with marks at the word's ends); both embedding tables are hashed. Windows of WIDTH words overlap by half and
cover the whole text; each is read in both directions, its states are pooled by attention, and a text's score is that
of its highest window. Labels are per document, so training picks the highest window of a toxic document anew in every
epoch and the highest ones of clean documents as counter-examples.

The first component of each embedding starts at the smoothed log-odds of its words or n-grams in the training sample.

Cases: null, empty and wordless texts score 0. Texts of any length are scored whole. Repeated rows are each scored. An
empty table gives no rows; without labels of both kinds fit() raises NoLabels. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.runtime import forget, materialize, sampled_texts, with_columns_by_batch

#: Labelled documents of label 1 and of label 0 in the training sample (those with the smallest hash of their id); longer
#: ones than SAMPLE_CHARS only fill it up, by pieces.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1500, 3000, 6000

WIDTH, STRIDE = 32, 16
WORD_SLOTS, CHAR_SLOTS = 1 << 15, 1 << 17
DIM, HIDDEN, ATTEND = 4, 8, 8


class Vocabulary:
    """Hashed word and n-gram slots of distinct words."""

    def __init__(self, words: list[bytes]):
        n = np.fromiter(map(len, words), np.int64, len(words)) + 2
        raw = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
        ends = np.cumsum(n)
        first = ends - n
        power = np.uint64(0x9E3779B97F4A7C15)
        at = np.arange(len(raw)) - np.repeat(first, n)
        mult = np.cumprod(np.full(int(n.max()) if len(n) else 1, power, np.uint64))
        self.word = self._mix(np.add.reduceat(raw * mult[at], first) if len(words) else np.zeros(0, np.uint64)) % np.uint64(WORD_SLOTS)
        self.word = self.word.astype(np.int64)
        of_size = [np.maximum(n - k + 1, 0) for k in (3, 4, 5)]
        self.count = of_size[0] + of_size[1] + of_size[2]  # at least one: ^w$
        self.first = np.cumsum(self.count) - self.count
        self.gram = np.empty(int(self.count.sum()), np.int32)
        for k, base in ((3, self.first), (4, self.first + of_size[0]), (5, self.first + of_size[0] + of_size[1])):
            h = np.full(len(raw), k, np.uint64)
            for j in range(k):
                h[: len(raw) - j] = h[: len(raw) - j] * power + raw[j:]
            ok = np.flatnonzero(at + k <= np.repeat(n, n))
            self.gram[np.repeat(base, n)[ok] + at[ok]] = (self._mix(h[ok]) % np.uint64(CHAR_SLOTS)).astype(np.int32)

    @staticmethod
    def _mix(h):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def some(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n-gram slots, their counts and first places for some of the words."""
        count = self.count[which]
        first = np.cumsum(count) - count
        return self.gram[np.repeat(self.first[which] - first, count) + np.arange(int(count.sum()))], count, first


def words_of(texts):
    """Distinct words (bytes), each word's number, and the number of words before each text."""
    from larkspur.llm.words import ALNUM, spans, text_bytes, word_array

    buf, ends = text_bytes(texts)
    start, end, before = spans(buf, ends, ALNUM)
    coded = word_array(buf, start, end).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), before


def windows(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of each window, and the text it is of. Starts are STRIDE apart, the last window ends with the text."""
    n = np.diff(before)
    count = np.where(n == 0, 0, np.maximum(0, -(-(n - WIDTH) // STRIDE)) + 1)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = np.maximum(0, np.minimum(k * STRIDE, n[text] - WIDTH))
    return before[text] + start, np.minimum(WIDTH, n[text]), text


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


class NoLabels(ValueError):
    """There is nothing to learn from."""


class Model:
    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        f = lambda *s, k=0.3: (g.standard_normal(s) * k).astype(np.float32)
        d, h = 2 * DIM, HIDDEN
        self.p = {"word": f(WORD_SLOTS, DIM, k=0.05), "char": f(CHAR_SLOTS, DIM, k=0.05), "att": f(2 * h, ATTEND), "att_v": f(ATTEND), "out": f(2 * h), "out_b": np.full(1, -1.0, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": f(d, 3 * h), f"h{side}": f(h, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}

    def inputs(self, vocab: Vocabulary) -> np.ndarray:
        """Vectors of distinct words."""
        char = np.empty((len(vocab.word), DIM), np.float32)
        for i in range(0, len(char), 20_000):
            gram, _, first = vocab.some(np.arange(i, min(len(char), i + 20_000)))
            char[i : i + 20_000] = np.maximum.reduceat(self.p["char"][gram], first)
        return np.concatenate([self.p["word"][vocab.word], char], 1)

    def scores(self, vectors: np.ndarray, words: np.ndarray, start: np.ndarray, size: np.ndarray, block: int = 4096) -> np.ndarray:
        """Score of each window; words: each word's row of vectors."""
        side = {s: np.concatenate([vectors @ self.p[f"x{s}"] + self.p[f"b{s}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for s in "fb"}
        out = np.empty(len(start), np.float32)
        for i in range(0, len(start), block):
            idx, mask = self._cells(words, start[i : i + block], size[i : i + block], len(vectors))
            states = np.empty((len(idx), WIDTH, 2 * HIDDEN), np.float32)
            for s, steps in (("f", range(WIDTH)), ("b", range(WIDTH - 1, -1, -1))):
                h = np.zeros((len(idx), HIDDEN), np.float32)
                put = slice(0, HIDDEN) if s == "f" else slice(HIDDEN, None)
                for t in steps:
                    new = self._step(side[s][idx[:, t]], h, self.p[f"h{s}"])[0]
                    h = new if mask is None else np.where(mask[:, t, None], new, h)
                    states[:, t, put] = h
            out[i : i + block] = self._pool(states, mask)[0]
        return out

    @staticmethod
    def _cells(words, start, size, pad):
        at = start[:, None] + np.arange(WIDTH)
        if (size == WIDTH).all():
            return words[at], None
        mask = np.arange(WIDTH) < size[:, None]
        return np.where(mask, words[np.minimum(at, len(words) - 1)], pad), mask

    @staticmethod
    def _step(x, h, u):
        hu = h @ u
        zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        return n + z * (h - n), z, r, n, hu[:, 2 * HIDDEN :]

    def _pool(self, states, mask):
        a = np.tanh(states @ self.p["att"])
        e = a @ self.p["att_v"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        w = np.exp(e - e.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        ctx = (w[:, :, None] * states).sum(1)
        return _sigmoid(ctx @ self.p["out"] + self.p["out_b"]), a, w, ctx

    def gradients(self, vocab: Vocabulary, cells: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy of windows (word numbers, with a mask) and its gradients."""
        p, n_win = self.p, len(cells)
        which, inv = np.unique(cells[mask], return_inverse=True)
        local = np.full(cells.shape, len(which))
        local[mask] = inv
        gram, count, first = vocab.some(which)
        rows = p["char"][gram]
        char = np.maximum.reduceat(rows, first)
        x = np.concatenate([np.concatenate([p["word"][vocab.word[which]], char], 1), np.zeros((1, 2 * DIM), np.float32)])
        states, saved = np.zeros((n_win, WIDTH, 2 * HIDDEN), np.float32), {}
        sides = (("f", range(WIDTH), slice(0, HIDDEN)), ("b", range(WIDTH - 1, -1, -1), slice(HIDDEN, None)))
        for s, steps, put in sides:
            proj = x @ p[f"x{s}"] + p[f"b{s}"]
            h, kept = np.zeros((n_win, HIDDEN), np.float32), []
            for t in steps:
                new, z, r, n, hn = self._step(proj[local[:, t]], h, p[f"h{s}"])
                kept.append((t, h, z, r, n, hn))
                h = np.where(mask[:, t, None], new, h)
                states[:, t, put] = h
            saved[s] = kept
        prob, a, w, ctx = self._pool(states, mask)
        loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dlogit = (prob - y) / n_win
        g["out"], g["out_b"] = ctx.T @ dlogit, dlogit.sum(keepdims=True)
        dctx = dlogit[:, None] * p["out"]
        dstates = w[:, :, None] * dctx[:, None]
        dw = (states * dctx[:, None]).sum(2)
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        g["att_v"] = np.einsum("nt,ntk->k", de, a)
        da = de[:, :, None] * p["att_v"] * (1 - a * a)
        g["att"] = np.einsum("nti,ntk->ik", states, da)
        dstates += da @ p["att"].T
        dx = np.zeros_like(x)
        for s, _, put in sides:
            u, dproj = p[f"h{s}"], np.zeros((len(x), 3 * HIDDEN), np.float32)
            dh = np.zeros((n_win, HIDDEN), np.float32)
            for t, h, z, r, n, hn in reversed(saved[s]):
                dh += dstates[:, t, put]
                m = mask[:, t, None]
                d = np.where(m, dh, 0)
                dn = d * (1 - z) * (1 - n * n)
                dz = d * (h - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                dhu = np.concatenate([dz, dr, dn * r], 1)
                g[f"h{s}"] += h.T @ dhu
                np.add.at(dproj, local[:, t], np.concatenate([dz, dr, dn], 1))
                dh = np.where(m, d * z, dh) + dhu @ u.T
            g[f"x{s}"], g[f"b{s}"] = x.T @ dproj, dproj[:-1].sum(0)
            dx += dproj @ p[f"x{s}"].T
        np.add.at(g["word"], vocab.word[which], dx[:-1, :DIM])
        hit = rows == np.repeat(char, count, 0)
        np.add.at(g["char"], gram, hit * np.repeat(dx[:-1, DIM:], count, 0))
        return loss, g


def train(texts, toxic: np.ndarray, epochs: int = 6, steps: int = 600, batch: int = 96, rate: float = 0.01, seed: int = 7) -> Model:
    """Fit a model to whole texts (an Arrow array) and their 0/1 labels, in so many epochs and steps at least; the last third goes slower.

    Windows are chosen once an epoch; with few of them, an epoch goes over them several times.
    """
    words, codes, before = words_of(texts)
    vocab = Vocabulary(words)
    start, size, text = windows(before)
    model = Model(seed)
    _evidence(model, vocab, codes, before, toxic, _originals(codes, before))
    rng = np.random.default_rng(seed)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    y_win = toxic[text].astype(np.float32)
    t = 0
    for epoch in range(epochs):
        vec = model.inputs(vocab)
        if epoch:
            now = model.scores(vec, codes, start, size)
        else:  # before any training: the strongest evidence in the window
            best = np.maximum(vec[:, 0], vec[:, DIM])[codes]
            now = np.array([best[a : a + n].max() for a, n in zip(start.tolist(), size.tolist())], np.float32)
        order = np.lexsort((-now, text))
        rank = np.empty(len(order), np.int64)
        head = np.searchsorted(text[order], np.arange(len(toxic)))
        rank[order] = np.arange(len(order)) - head[text[order]]
        chosen = np.flatnonzero((rank == 0) | (y_win == 0) & ((rank == 1) | (rng.random(len(text)) < len(toxic) / max(1, len(text)))))
        passes = max(1, -(-steps // (epochs * max(1, -(-len(chosen) // batch)))))
        for i in range(0, passes * len(chosen), batch):
            if i % len(chosen) < batch:
                rng.shuffle(chosen)
            part = chosen[np.arange(i, min(i + batch, passes * len(chosen))) % len(chosen)]
            mask = np.arange(WIDTH) < size[part, None]
            cells = codes[np.minimum(start[part, None] + np.arange(WIDTH), len(codes) - 1)]
            _, g = model.gradients(vocab, cells, mask, y_win[part])
            t += 1
            pace = rate * (0.3 if epoch >= 2 * epochs / 3 else 1.0)
            for k, v in g.items():
                m, s = state[k]
                if k in ("word", "char"):  # only rows that had a gradient move
                    r = np.flatnonzero(np.any(v, 1))
                    m[r] = 0.9 * m[r] + 0.1 * v[r]
                    s[r] = 0.99 * s[r] + 0.01 * v[r] ** 2
                    model.p[k][r] -= (0.1 * pace * m[r] / (np.sqrt(s[r]) + 1e-6)).astype(np.float32)
                else:
                    m[:] = 0.9 * m + 0.1 * v
                    s[:] = 0.99 * s + 0.01 * v**2
                    model.p[k] -= (pace * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return model


def _originals(codes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """False for a text that shares a band of minimum hashes of its four-word shingles with an earlier one: copies are no evidence of their own."""
    pair = np.zeros(max(0, len(codes) - 3), np.uint64)
    for k in range(4):
        pair = Vocabulary._mix(pair + codes[k : k + len(pair)].astype(np.uint64) + np.uint64(1))
    seen, keep = set(), np.ones(len(before) - 1, bool)
    for d, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist())):
        own = pair[a : max(a, b - 3)]
        if not len(own):
            continue
        low = [int((Vocabulary._mix(own * np.uint64(2 * k + 1) + np.uint64(k))).min()) for k in range(12)]
        bands = {(k, low[k], low[k + 1]) for k in range(0, 12, 2)}
        keep[d] = not bands & seen
        seen |= bands
    return keep


def _evidence(model: Model, vocab: Vocabulary, codes, before, toxic, keep) -> None:
    toxic_n, clean_n = (toxic * keep).sum(), ((1 - toxic) * keep).sum()
    least = max(4, 0.008 * toxic_n)
    tallies = {"word": np.zeros((2, WORD_SLOTS)), "char": np.zeros((2, CHAR_SLOTS))}
    for d in np.flatnonzero(keep).tolist():
        own = np.unique(codes[before[d] : before[d + 1]])
        if len(own):
            tallies["word"][int(toxic[d]), np.unique(vocab.word[own])] += 1
            tallies["char"][int(toxic[d]), np.unique(vocab.some(own)[0])] += 1
    for name, (good, bad) in tallies.items():
        odds = np.log((bad + 1) / (toxic_n + 2)) - np.log((good + 1) / (clean_n + 2))
        model.p[name][:, 0] = np.where(bad >= least, np.clip(odds, -3, 3), np.clip(odds, -3, 0)) / 2


def held_out(doc_id):
    """True for rows that training never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, toxic_docs: int = SAMPLE_TOXIC, clean_docs: int = SAMPLE_CLEAN, max_chars: int = SAMPLE_CHARS) -> Model:
    """Train on a bounded sample of labelled documents with a text, outside the held-out fifth; those over max_chars only fill up the sample. A document labelled twice counts as toxic if one label says so."""
    import pyarrow as pa

    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.col("text").cast("string")).alias("size")).where("size > 0").groupBy("doc_id").agg(F.min("size").alias("size"))
    known = materialize(marks.where(~held_out(F.col("doc_id"))).join(size, "doc_id").select("doc_id", "toxic", (F.col("size") > max_chars).alias("long")), "labelled")
    some = lambda y, most: known.where(F.col("toxic") == y).orderBy("long", F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "toxic")
    rows = sampled_texts(docs, some(0, clean_docs).union(some(1, toxic_docs)), "toxic", max_chars)
    toxic = np.array([r["toxic"] for r in rows], float)
    if not 0 < toxic.sum() < len(toxic):
        raise NoLabels("training needs labels of both kinds")
    return train(pa.array([r["text"] for r in rows], pa.string()), toxic)


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and __score, in a map over the scan."""
    known = docs.sparkSession.sparkContext.broadcast(model.p)
    place = docs.columns.index("text")

    def run(b):
        import pyarrow as pa

        from larkspur.llm.toxicity import Model, Vocabulary, windows, words_of

        forget()
        net = Model.__new__(Model)
        net.p = known.value
        words, codes, before = words_of(b.column(place))
        out = np.zeros(b.num_rows)
        if len(codes):
            start, size, text = windows(before)
            np.maximum.at(out, text, net.scores(net.inputs(Vocabulary(words)), codes, start, size))
        return [pa.array(out)]

    return with_columns_by_batch(docs, run, "__score double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted: one row per document."""
    scored = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
