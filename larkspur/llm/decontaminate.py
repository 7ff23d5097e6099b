"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded slice of documents. Its words are numbered by the benchmark's vocabulary; words outside it can
lie in no occurrence, so only runs of known words that are long enough for some window enter the index. The index
holds the Burrows-Wheeler transform of the runs as a wavelet matrix and a sample of the suffix positions. All windows
are searched backwards together, occurrences are located by walking to a sampled position, and their words are merged
into removal spans.

Cases: null and wordless texts have no words and no hits. Items without words have no windows. Items with the same id
count once; a null item_id counts as the empty string. Repeated documents are judged each. Texts of any length are
searched whole. Empty tables give no rows, or rows without hits. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.runtime import map_batches, materialize, sliced, with_columns_by_batch

#: Benchmark text of one pass over the documents: some 8 times as many bytes in the driver and in every Python worker. A
#: larger benchmark takes several passes, each over all documents and each written before the next one starts.
PASS_BYTES = 8 << 20

SAMPLE = 8
FOUND = "doc_id long, text string, n_words long, hits array<struct<start:int,end:int>>, items array<string>"


class Wavelet:
    """Wavelet matrix over numbers below `sigma`: ranks of many symbols at many places at once."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(seq) - self.ones[-1][-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] among the first upto[i] entries."""
        lo, hi = np.zeros_like(upto), upto
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = self.ones[k][lo], self.ones[k][hi]
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo


class FMIndex:
    """FM-index of runs of symbols 1..sigma-1, separated by 0. A search never crosses a separator."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        n = len(seq)
        sep = seq == 0
        m = int(sep.sum())
        key = seq.astype(np.int64) + m
        key[sep] = np.arange(m)  # separators differ from each other, so a comparison ends there
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[:-step] = rank[step:] + 1
            key = rank * (n + 1) + nxt
            order = np.argsort(key, kind="stable")
            sk = key[order]
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum(sk[1:] != sk[:-1])
            rank = new
            if n == 0 or rank[order[-1]] == n - 1:
                break
            step *= 2
        self.bwt = seq[order - 1]
        self.wavelet = Wavelet(self.bwt, sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])[:sigma].astype(np.int64)
        self.n = n
        known = (order % sample == 0) | (self.bwt == 0)  # where a run starts, a walk must end
        self.sampled = known
        self.at = np.cumsum(known) - 1
        self.position = order[known]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 row of each pattern (rows of an integer matrix)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            r = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.before[c] + r[: len(c)], self.before[c] + r[len(c) :]
            dead = live[lo[live] >= hi[live]]
            hi[dead] = lo[dead]
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffixes by their rows."""
        out, walk, rows = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        steps = 0
        while len(walk):
            done = self.sampled[rows]
            out[walk[done]] = self.position[self.at[rows[done]]] + steps
            walk, rows = walk[~done], rows[~done]
            c = self.bwt[rows]
            rows = self.before[c] + self.wavelet.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """Windows of benchmark items over the items' vocabulary, in flat arrays.

    by_length: number of words -> (distinct windows, one a row; where each one's items start; items of all, by number).
    """

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        import pyarrow as pa

        from larkspur.llm.words import ALNUM, spans, text_bytes, word_array

        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        item = np.array([number[name] for name, _ in items], np.int32)
        buf, ends = text_bytes(pa.array([t for _, t in items], pa.string()))
        start, end, before = spans(buf, ends, ALNUM)
        coded = word_array(buf, start, end).dictionary_encode()
        self.vocabulary = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
        self.sigma = len(self.vocabulary) + 1
        n = np.diff(before)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(np.minimum(n[n > 0], width)).tolist():
            own = np.flatnonzero(n >= width if size == width else n == size)
            count = n[own] - size + 1
            first = np.repeat(before[own] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            matrix = codes[first[:, None] + np.arange(size)]
            who = np.repeat(item[own], count)
            order = np.lexsort((who, *matrix.T[::-1]))
            matrix, who = matrix[order], who[order]
            new = np.ones(len(matrix), bool)
            new[1:] = (matrix[1:] != matrix[:-1]).any(1)
            keep = new.copy()
            keep[1:] |= who[1:] != who[:-1]
            at = np.concatenate([np.flatnonzero(new[keep]), [int(keep.sum())]])
            self.by_length[size] = (matrix[new], at.astype(np.int32), who[keep])


def find(texts, phrases: Phrases):
    """Occurrences of the phrases in a shard: n_words of each text, merged hit spans (text, first word, last word + 1), and (text, item) pairs; also the words' byte spans."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from larkspur.llm.words import ALNUM, spans, text_bytes, word_array

    buf, ends = text_bytes(texts)
    start, end, before = spans(buf, ends, ALNUM)
    n_words = np.diff(before)
    hit = np.zeros(len(start) + 1, np.int64)
    items: set[tuple[int, str]] = set()
    if phrases.by_length and len(start):
        code = pc.fill_null(pc.index_in(word_array(buf, start, end), value_set=phrases.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        known = code > 0
        begins = known.copy()
        begins[1:] &= ~known[:-1]
        firsts = before[:-1][before[:-1] < len(code)]
        begins[firsts] = known[firsts]
        run = np.cumsum(begins) - 1
        size = np.bincount(run[known], minlength=int(begins.sum()))
        keep = known.copy()
        keep[known] = size[run[known]] >= min(phrases.by_length)
        place = np.flatnonzero(keep)
        if len(place):
            gap = np.flatnonzero(np.diff(run[place])) + 1
            seq = np.insert(code[place], gap, 0)
            seq = np.concatenate([[0], seq, [0]])
            word_of = np.concatenate([[-1], np.insert(place, gap, -1), [-1]])
            index = FMIndex(seq, phrases.sigma)
            there = np.bincount(seq, minlength=phrases.sigma) > 0
            for n, (matrix, first, owners) in phrases.by_length.items():
                likely = np.flatnonzero(there[matrix].all(1))  # all words occur in the shard
                lo, hi = index.search(matrix[likely].astype(np.int64))
                found = np.flatnonzero(hi > lo)
                which, count = likely[found], (hi - lo)[found]
                rows = np.repeat(lo[found] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                at = word_of[index.locate(rows)]
                np.add.at(hit, at, 1)
                np.add.at(hit, at + n, -1)
                doc = np.searchsorted(before, at, side="right") - 1
                for d, p in np.unique(np.stack([doc, np.repeat(which, count)], 1), axis=0).tolist():
                    items.update((d, phrases.names[k]) for k in owners[first[p] : first[p + 1]].tolist())
    marked = np.cumsum(hit)[:-1] > 0
    edge = np.zeros(len(marked) + 1, bool)
    edge[before] = True
    inside = marked.copy()
    head, tail = inside.copy(), inside.copy()
    if len(marked):
        head[1:] &= ~marked[:-1] | edge[1:-1]
        tail[:-1] &= ~marked[1:] | edge[1:-1]
    a, b = np.flatnonzero(head), np.flatnonzero(tail) + 1
    doc = np.searchsorted(before, a, side="right") - 1
    return n_words, (doc, a - before[doc], b - before[doc], start[a], end[b - 1] if len(b) else b), items, buf, ends


def _passes(spark, bench: DataFrame, key: list[str], width: int):
    """The benchmark's phrases, a broadcast for each pass. bench: item_id, text."""
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = 1 + int(total) // PASS_BYTES
    for k in range(passes):
        part = bench if passes == 1 else bench.where(F.pmod(F.xxhash64(*key), F.lit(passes)) == k)
        yield spark.sparkContext.broadcast(Phrases([tuple(r) for r in part.toLocalIterator()], width))


def locate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, text, n_words, hits (merged spans in words), items (ids with an occurrence, sorted as strings): one row per document, without a shuffle."""
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>").alias("hits"), F.from_json(F.lit("[]"), "array<string>").alias("items"))
    for k, block in enumerate(_passes(docs.sparkSession, bench, ["item_id", "text"], width)):
        out = map_batches(materialize(out, "located") if k else out, _searcher(block), FOUND)
    return out


def _searcher(block):
    def run(batches):
        import pyarrow as pa

        from larkspur.llm.decontaminate import find

        phrases = block.value
        for b in sliced(batches):
            n_words, (doc, a, z, _, _), items, _, _ = find(b.column(1), phrases)
            old_hits, old_items = b.column(3).to_pylist(), b.column(4).to_pylist()
            hits: dict[int, list] = {}
            for d, x, y in zip(doc.tolist(), a.tolist(), z.tolist()):
                hits.setdefault(d, []).append((x, y))
            names: dict[int, set] = {}
            for d, name in items:
                names.setdefault(d, set()).add(name)
            new_hits, new_items = [], []
            for d in range(b.num_rows):
                merged: list = []
                for x, y in sorted([(h["start"], h["end"]) for h in old_hits[d]] + hits.get(d, [])):
                    if merged and x <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], y)
                    else:
                        merged.append({"start": x, "end": y})
                new_hits.append(merged)
                new_items.append(sorted(names.get(d, set()) | set(old_items[d])))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(new_hits, span), pa.array(new_items, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "hits", "items"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits: one row per document."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + (h["end"] - h["start"]))
    return locate(docs, benchmark, width).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "hits"
    )


def contaminated_flag(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """All columns of docs and __contaminated (an occurrence of some window), in a map over the scan."""
    bench = benchmark.select(F.lit("").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    names, place = docs.columns, docs.columns.index("text")
    out, hit = docs, F.lit(False)
    for k, block in enumerate(_passes(docs.sparkSession, bench, ["text"], width)):
        out = with_columns_by_batch(materialize(out, "flagged") if k else out, _flagger(block, place), f"__hit{k} boolean")
        hit = hit | F.col(f"__hit{k}")
    return out.select(*[out[c] for c in names], hit.alias("__contaminated"))


def _flagger(block, place: int):
    def run(b):
        import pyarrow as pa

        from larkspur.llm.decontaminate import find

        flags = np.zeros(b.num_rows, bool)
        flags[find(b.column(place), block.value)[1][0]] = True
        return [pa.array(flags)]

    return run


_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def remove_spans(text, hits):
    """The text without the words of its hit spans (columns)."""
    import pyspark.sql.functions as f

    @f.pandas_udf("string")
    def cut(texts, spans_):
        import re

        word = re.compile(_WORD)

        def one(t, hs):
            if t is None or hs is None or not len(hs):
                return t
            at = [m.span() for m in word.finditer(t)]
            out, last = [], 0
            for h in hs:
                out.append(t[last : at[h["start"]][0]])
                last = at[h["end"] - 1][1]
            return "".join(out) + t[last:]

        return texts.combine(spans_, one)

    return cut(text, hits)
