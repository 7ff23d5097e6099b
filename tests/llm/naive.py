"""Slow, plain versions of what operators compute, word by word and pair by pair."""

import math
import re

import numpy as np

from larkspur.llm import language as L
from larkspur.llm import toxicity as T

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


# ---- language
def trigrams(text):
    c = []
    for x in lower(text).encode():
        x = x if 97 <= x <= 122 or x >= 128 else 32
        if not (x == 32 and c and c[-1] == 32):
            c.append(x)
    out = []
    for a, b, d in zip(c, c[1:], c[2:]):
        h = (((a * 0x9E3779B1 + b) & M32) * 0x85EBCA6B + d) & M32
        out.append((((h ^ (h >> 15)) * 0x2C1B3C6D) & M32) >> 16)
    return out


def sampled(text, most=L.SAMPLE_CHARS, pieces=4):
    """What of a text stands in a training sample."""
    if len(text) <= most:
        return text
    piece = most // pieces - 1
    return "\n".join(text[int((len(text) - piece) * (k / (pieces - 1))) :][:piece] for k in range(pieces))


def domain_and_suffix(host):
    parts = host.split(".")
    return ".".join(parts[-2:]), parts[-1]


def languages(train, rows):
    """(lang, confidence, accepted) of rows (text, declared, host) by models of train (text, lang); at most a sample's size of either kind."""
    names = sorted({x for _, x in train})
    table = {}
    for x in names:
        counts: dict = {}
        for text, lang in train:
            if lang == x:
                for h in trigrams(text):
                    counts[h] = counts.get(h, 0) + 1
        total = sum(counts.values()) + 0.05 * L.SLOTS
        table[x] = lambda h, counts=counts, total=total: float(np.float32(math.log((counts.get(h, 0) + 0.05) / total)))
    best = lambda text: (lambda t: sum(max(table[x](h) for x in names) for h in t) / max(1, len(t)))(trigrams(text))
    low, mean = np.percentile([best(t) for t, _ in train], [25, 50])
    spread = max(0.05, (mean - low) / 0.6745)
    logs, posts, sizes = [], [], []
    for text, _, _ in rows:
        t = trigrams(text)
        logs.append([sum(table[x](h) for h in t) * L.TEMPER for x in names])
        posts.append(softmax(logs[-1]))
        sizes.append(len(t))
    hosts = [lower(h) if h and h.strip() else None for _, _, h in rows]
    sums: dict = {}
    for key in (lambda h: ("host", h), lambda h: ("dom", domain_and_suffix(h)[0]), lambda h: ("suf", domain_and_suffix(h)[1]), lambda h: ("all",)):
        for h, p, n in zip(hosts, posts, sizes):
            if h is not None and n:
                s = sums.setdefault(key(h), [0, [0.0] * len(names)])
                s[0] += 1
                s[1] = [a + b for a, b in zip(s[1], p)]
    n, s = sums.get(("all",), (0, [0.0] * len(names)))
    overall = [(v + 1) / (n + len(names)) for v in s]

    def shrunk(key, parent):
        n, s = sums[key]
        return [(v + L.PRIOR_ROWS * m) / (n + L.PRIOR_ROWS) for v, m in zip(s, parent)]

    said = [(m[1] if (m := re.match(r"\s*([a-z]+)", lower(d))) else "") for _, d, _ in rows]
    trust = [[0.5 + 4.5 * (a == b) for b in names] for a in names]
    for d, p, n in zip(said, posts, sizes):
        if d in names and n:
            trust[names.index(d)] = [a + b for a, b in zip(trust[names.index(d)], p)]
    column = [sum(t[k] for t in trust) for k in range(len(names))]
    out = []
    for (text, _, _), log, post, n, host, d in zip(rows, logs, posts, sizes, hosts, said):
        prior = overall
        if host is not None and ("host", host) in sums:
            dom, suf = domain_and_suffix(host)
            up = shrunk(("dom", dom), shrunk(("suf", suf), overall))
            hn, hs = sums["host", host]
            own = 1 if n else 0
            prior = [(v - own * p + L.PRIOR_ROWS * m) / max(hn - own + L.PRIOR_ROWS, 1e-9) for v, p, m in zip(hs, post, up)]
        final = softmax([v + math.log(max(p, 1e-9)) + (math.log(trust[names.index(d)][k] / column[k]) if d in names else 0) for k, (v, p) in enumerate(zip(log, prior))])
        top = max(final)
        fits = n > 0 and best(text) >= mean - L.MAX_DEVIATIONS * math.sqrt(spread**2 + 4.0 / max(n, 1))
        out.append((names[final.index(top)] if n else "und", top, bool(n and top >= L.MIN_POSTERIOR and fits)))
    return out


# ---- toxicity
def _mix(h):
    h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & M64
    return h ^ (h >> 29)


def _vector(p, word):
    power, raw = 0x9E3779B97F4A7C15, b"^" + word + b"$"
    h = 0
    for i, c in enumerate(raw):
        h = (h + c * pow(power, i + 1, 1 << 64)) & M64
    own = p["word"][_mix(h) % T.WORD_SLOTS]
    grams = []
    for k in (3, 4, 5):
        for i in range(len(raw) - k + 1):
            h = k
            for c in raw[i : i + k]:
                h = (h * power + c) & M64
            grams.append(p["char"][_mix(h) % T.CHAR_SLOTS])
    return np.concatenate([own, np.max(grams, 0)])


def toxicity(p, text):
    """A text's score by the network with parameters p, one word and one window after the other."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", lower(text).encode())
    if not words:
        return 0.0
    vec = {w: _vector(p, w) for w in set(words)}
    sig = lambda x: 1 / (1 + np.exp(-x))
    n, H = len(words), T.HIDDEN
    starts = [0] if n <= T.WIDTH else [*range(0, n - T.WIDTH, T.STRIDE), n - T.WIDTH]
    best = 0.0
    for a in starts:
        own = words[a : a + T.WIDTH]
        sides = []
        for s, order in (("f", own), ("b", own[::-1])):
            h, states = np.zeros(H), []
            for w in order:
                x, hu = vec[w] @ p[f"x{s}"] + p[f"b{s}"], h @ p[f"h{s}"]
                z, r = sig(x[:H] + hu[:H]), sig(x[H : 2 * H] + hu[H : 2 * H])
                new = np.tanh(x[2 * H :] + r * hu[2 * H :])
                h = new + z * (h - new)
                states.append(h)
            sides.append(states if s == "f" else states[::-1])
        states = np.concatenate([np.array(x) for x in sides], 1)
        w = np.array(softmax(list(np.tanh(states @ p["att"]) @ p["att_v"])))
        best = max(best, float(sig((w[:, None] * states).sum(0) @ p["out"] + p["out_b"])[0]))
    return best


# ---- near duplicates, benchmark windows
def components(texts, width, percent):
    """Smallest id reachable by links, for texts by id (one each): all pairs are compared."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()
    comp = {i: i for i in texts}
    ids = sorted(texts)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while True:
        old = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == old:
            return comp


def has_window(text, items, width):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    own = words(text)
    for item in items:
        w = words(item)
        for k in range(max(len(w) - width, 0) + 1 if w else 0):
            p = w[k : k + width]
            if any(own[i : i + len(p)] == p for i in range(len(own) - len(p) + 1)):
                return True
    return False


def crc(ids):
    import zlib

    return zlib.crc32(np.array(ids, "<u4").tobytes())

