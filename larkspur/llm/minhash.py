"""MinHash near-duplicates with b-bit signatures.

Each text becomes the set of its distinct word shingles. Texts with equal sets form one class at once, whatever their
number. Of each class one representative is compared: HASHES minima over the set give BANDS band keys; signatures keep
BITS low bits of each minimum, packed. Two classes that share a band are candidates; the share of equal b-bit values,
corrected for chance collisions, estimates their similarity, and pairs that cannot be similar by a wide margin go.
What remains is confirmed exactly on the full sets.

Groups are never paired off in full. In every round each band's group is compared with one member of it, chosen anew;
what is confirmed merges components, and groups within one component are done. What then still lies in different
components of a group is compared signature by signature in square blocks. Where few pairs remain they are confirmed one
by one; where many do, the full sets come to the block and only spanning links leave it.

Cases: texts without words (null, empty, white space) have an empty set and link with nothing. A text with fewer words
than a shingle is one shingle. Repeated rows (same doc_id) are each returned; documents with equal sets share a class.
A null doc_id belongs to no component. Texts of any length are read whole. An empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.components import connected_components
from larkspur.llm.runtime import by_filters, drop_path, forget, id_filter, map_batches, materialize, scratch, sliced

HASHES, ROWS, BITS = 150, 5, 4
BANDS = HASHES // ROWS
#: Groups of up to SMALL rows are paired by a join (at most SMALL / 2 pairs a row), larger ones in blocks of BLOCK rows.
SMALL, BLOCK = 32, 1024
#: Bytes of text whose shingles a worker holds at once.
SLICE = 1 << 20
#: Standard deviations that an estimate may lie below the threshold.
MARGIN = 4.5

SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary"


def shingle_sets(texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes, sorted and distinct within each text, and the number before each text."""
    import xxhash

    from larkspur.llm.words import NONSPACE, spans, text_bytes, word_array

    buf, ends = text_bytes(texts)
    start, end, before = spans(buf, ends, NONSPACE)
    coded = word_array(buf, start, end).dictionary_encode()
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    word = words[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    n = np.diff(before)
    # hashes of width words from each place on; those that leave their text are dropped
    h = np.full(len(word), 0x27D4EB2F165667C5, np.uint64)
    left = np.repeat(before[1:], n) - np.arange(len(word))
    for k in range(width):
        ok = left > k
        w = np.zeros(len(word), np.uint64)
        w[: len(word) - k] = word[k:]
        mixed = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        h = np.where(ok, mixed, h)
    size = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    at = np.arange(len(word)) - np.repeat(before[:-1], n)
    keep = at < np.repeat(size, n)
    h = h[keep]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    text = np.repeat(np.arange(len(n)), size)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[first], text[first]
    return h, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(n)))]).astype(np.int64)


def minima(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """HASHES minima of each set (all ones for an empty one)."""
    rng = np.random.default_rng(20_240_501)
    mult = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.full((len(before) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(before))
    first = before[:-1][full]
    if len(h):
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(((h * mult[k]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def pack_bits(low: np.ndarray) -> np.ndarray:
    """Rows of BITS-bit values, packed into bytes."""
    bits = (low[:, :, None] >> np.arange(BITS, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(len(low), -1), axis=1)


_POP = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal b-bit values of packed signatures (broadcast over leading axes)."""
    x = a ^ b
    # a value differs if any of its bits does: fold the bits of each nibble together, then count
    x = x | (x >> 1)
    x = (x | (x >> 2)) & 0x11
    return 1.0 - _POP[x].sum(-1, dtype=np.int32) / HASHES


def estimate(share: np.ndarray) -> np.ndarray:
    """Similarity by the share of equal values, corrected for chance collisions."""
    c = 1.0 / (1 << BITS)
    return (share - c) / (1.0 - c)


def least_estimate(threshold: float) -> float:
    c = 1.0 / (1 << BITS)
    p = threshold + (1 - threshold) * c
    return threshold - MARGIN * float(np.sqrt(p * (1 - p) / HASHES)) / (1 - c)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), bands, signature: one row per document, by a map over the scan."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        from larkspur.llm.minhash import BANDS, ROWS, SLICE, minima, pack_bits, shingle_sets

        forget()
        for b in sliced(batches, most=SLICE):
            h, before = shingle_sets(b.column(1), width)
            low = minima(h, before)
            raw = memoryview(h.tobytes())
            digests = [hashlib.blake2b(raw[8 * x : 8 * y], digest_size=16).digest() for x, y in zip(before[:-1].tolist(), before[1:].tolist())]
            keys = np.zeros((len(low), BANDS), np.uint64)
            for k in range(ROWS):
                keys = (keys ^ low[:, k::ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                keys ^= keys >> np.uint64(31)
            keys = keys * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)
            sig = pack_bits(low)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(before)), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.astype(np.int64).reshape(-1))), pa.array([x.tobytes() for x in sig], pa.binary())],
                names=["doc_id", "n_shingles", "digest", "bands", "signature"],
            )

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SKETCH)


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, hashes (the whole set, 8 bytes each, sorted) of the documents in ids, and of a few others by chance.

    A filter of bounded size lets the documents in question through; the texts of the rest never move.
    """

    def run(batches):
        import pyarrow as pa

        from larkspur.llm.minhash import SLICE, shingle_sets

        forget()
        for b in sliced(batches, most=SLICE):
            h, before = shingle_sets(b.column(1), width)
            raw = memoryview(h.tobytes())
            for i in range(0, b.num_rows, 500):
                part = list(zip(before[i : i + 500].tolist(), before[i + 1 : i + 501].tolist()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 500), pa.array([bytes(raw[8 * x : 8 * y]) for x, y in part], pa.binary())], names=["doc_id", "hashes"])

    return by_filters(docs, [id_filter(ids)], lambda held: held, run, "doc_id long, hashes binary")


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of documents whose full sets have 100 * intersection >= percent * union.

    Each pair first meets the set of b and then, moved once more, that of a; a frequent a (many pairs) is a skewed key
    that Spark splits, and its set is not copied into the shuffle.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    path = scratch(docs.sparkSession, "sets")
    sets = materialize(full_sets(docs, ids, width), "sets", path)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                least, most = min(len(u), len(v)), max(len(u), len(v))
                if 100 * least < percent * most:
                    keep.append(False)
                    continue
                both = np.concatenate([u, v])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb")), "b")
    met = met.join(sets.join(pairs.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")), "a")
    found = materialize(map_batches(met.select("a", "b", "ha", "hb"), run, "a long, b long").distinct(), "links")
    drop_path(docs.sparkSession, path)
    return found


def _plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """a, b, similar (estimate): pairs whose sizes and signatures allow the similarity."""
    least = least_estimate(percent / 100)

    def run(batches):
        import pyarrow as pa

        from larkspur.llm.minhash import agreement, estimate

        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            y = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            est = estimate(agreement(x, y))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(est)], names=["a", "b", "similar"]).filter(pa.array(est >= least))

    side = lambda k: reps.select(F.col("doc_id").alias(k), F.col("signature").alias(f"s{k}"), F.col("n_shingles").alias(f"n{k}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return map_batches(met.select("a", "b", "sa", "sb"), run, "a long, b long, similar double")


def _near(u, v, bu, bv, cu, cv, nu, nv, iu, iv, band: int, same: bool, percent: int, least: float):
    """Index pairs of two blocks that lie in different components, may be similar, and share no band before this one."""
    first, second = [], []
    for i in range(len(u)):
        ok = np.flatnonzero((cv != cu[i]) & (100 * np.minimum(nu[i], nv) >= percent * np.maximum(nu[i], nv)) & ((iv > iu[i]) if same else True))
        if len(ok):
            ok = ok[estimate(agreement(u[i], v[ok])) >= least]
        if len(ok):
            equal = bv[ok] == bu[i]
            ok = ok[bu[i][equal.argmax(1)] == band]
            first.append(np.full(len(ok), i))
            second.append(ok)
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(first), np.concatenate(second)


def _blocks(rows, lo: int, hi: int):
    left = rows if lo == hi else rows[rows.k == lo]
    right = rows if lo == hi else rows[rows.k == hi]
    array = lambda r: (np.frombuffer(b"".join(r.signature), np.uint8).reshape(len(r), -1), np.stack(r.bands.to_list()), r.comp.to_numpy(), r.n.to_numpy(), r.id.to_numpy())
    return left, right, array


#: A unit gives back up to DENSE pairs for each of its rows; beyond that its rows' full sets are compared in place.
DENSE = 2

CROSS = "band long, lo int, hi int, dense boolean, a long, b long"


def _cross_units(groups: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What may be similar in each band group across components: pairs, and the units in which pairs are too many.

    groups: band, id, comp, n, signature, bands. A group is dealt into blocks of about BLOCK rows by a hash of the id;
    each pair of blocks is one unit of work, so a task holds two blocks however large the group is. A pair belongs to
    the first band it shares. What comes out is at most DENSE times what goes in.
    """
    least = least_estimate(percent / 100)
    size = groups.groupBy("band").agg(F.count("*").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("band", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    mixed = groups.join(size, "band")
    few = mixed.where(F.col("m") <= SMALL).select("band", "id", "comp")
    met = few.alias("x").join(few.alias("y"), "band").where("x.id < y.id and x.comp <> y.comp").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    small = _plausible(met, groups.select(F.col("id").alias("doc_id"), "signature", F.col("n").alias("n_shingles")).dropDuplicates(["doc_id", "signature"]), percent)
    small = small.select(F.lit(0).cast("long").alias("band"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(False).alias("dense"), "a", "b")
    dealt = mixed.where(F.col("m") > SMALL).withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block k takes part in the units (k, j) and (j, k)
    units = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("band", F.least("k", "j").alias("lo"), F.greatest("k", "j").alias("hi"), "k", "id", "comp", "n", "signature", "bands")

    def run(key, rows):
        import pandas as pd

        from larkspur.llm.minhash import DENSE, _blocks, _near

        band, lo, hi = (int(x) for x in key)
        left, right, array = _blocks(rows, lo, hi)
        out = {"band": [], "lo": [], "hi": [], "dense": [], "a": [], "b": []}
        if len(left) and len(right):
            (u, bu, cu, nu, iu), (v, bv, cv, nv, iv) = array(left), array(right)
            i, j = _near(u, v, bu, bv, cu, cv, nu, nv, iu, iv, band, lo == hi, percent, least)
            dense = len(i) > DENSE * (len(left) + len(right))
            if dense:
                a = np.unique(np.concatenate([iu[np.unique(i)], iv[np.unique(j)]]))
                b = a
            else:
                a, b = np.minimum(iu[i], iv[j]), np.maximum(iu[i], iv[j])
            out = {"band": np.full(len(a), band), "lo": lo, "hi": hi, "dense": dense, "a": a, "b": b}
        return pd.DataFrame(out)

    found = units.groupBy("band", "lo", "hi").applyInPandas(run, CROSS)
    return materialize(found.union(small), "cross"), units


def _dense_links(found: DataFrame, units: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Exact links in the units with too many pairs: their rows come with their full sets; out come spanning links only."""
    least = least_estimate(percent / 100)
    rows = found.where("dense").select("band", "lo", "hi", F.col("a").alias("id"))
    sets = materialize(full_sets(docs, rows.select("id").distinct(), width), "sets")
    joined = units.join(rows, ["band", "lo", "hi", "id"]).join(sets.withColumnRenamed("doc_id", "id"), "id")

    def run(key, rows):
        import pandas as pd

        from larkspur.llm.minhash import _blocks, _near

        band, lo, hi = (int(x) for x in key)
        left, right, array = _blocks(rows, lo, hi)
        links = []
        if len(left) and len(right):
            (u, bu, cu, nu, iu), (v, bv, cv, nv, iv) = array(left), array(right)
            up = {c: c for c in {*cu.tolist(), *cv.tolist()}}

            def root(x):
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            su = [np.frombuffer(x, np.uint64) for x in left.hashes]
            sv = [np.frombuffer(x, np.uint64) for x in right.hashes]
            for i, j in zip(*(x.tolist() for x in _near(u, v, bu, bv, cu, cv, nu, nv, iu, iv, band, lo == hi, percent, least))):
                p, q = root(int(cu[i])), root(int(cv[j]))
                if p == q:
                    continue
                both = np.concatenate([su[i], sv[j]])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    up[max(p, q)] = min(p, q)
                    links.append((int(iu[i]), int(iv[j])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return materialize(joined.groupBy("band", "lo", "hi").applyInPandas(run, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept: one row per document row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = materialize(sketches(docs, width), "sketch")
    filled = sketch.where("n_shingles > 0 and doc_id is not null")
    # equal sets are one class, known by its smallest id
    classes = materialize(filled.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "signature", "n_shingles")
    placed = materialize(filled.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep"), "placed")
    members = materialize(placed.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")), "members")
    # an id whose rows differ in text ties all their classes together
    several = members.where("rep <> other").select("doc_id", F.col("rep").alias("a"))
    edges = materialize(placed.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "ties")
    bands = classes.select(F.explode("bands").alias("band"), F.col("rep").alias("id")).distinct()
    # only groups with company matter
    crowded = bands.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band")
    bands = materialize(bands.join(crowded, "band"), "bands")
    comp = materialize(connected_components(edges), "components")
    tried = None

    def state():
        known = bands.join(comp, bands["id"] == comp["node"], "left")
        return known.select("band", "id", F.coalesce("component", "id").alias("comp"))

    for k in range(rounds):
        # one member of each group, another one each time, stands for it; every other document of another component
        # is compared with the most similar of those it meets
        order = F.struct((F.xxhash64("id", F.lit(k)) if k else F.col("id")).alias("h"), F.col("id"), F.col("comp"))
        now = state()
        hubs = now.groupBy("band").agg(F.min(order).alias("hub"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("band", F.col("hub.id").alias("a"), F.col("hub.comp").alias("ac"))
        pairs = now.join(hubs, "band").where("comp <> ac").select("a", F.col("id").alias("b")).distinct()
        best = _plausible(pairs, reps, percent).groupBy("b").agg(F.max(F.struct("similar", (-F.col("a")).alias("na"))).alias("top"))
        pairs = best.select((-F.col("top.na")).alias("a"), "b")
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.union(pairs)
        edges = edges.union(confirm(pairs, docs, width, percent))
        comp = materialize(connected_components(edges), "components")
    full = classes.select(F.col("rep").alias("id"), "signature", F.col("n_shingles").alias("n"), "bands")
    found, units = _cross_units(materialize(state().join(full, "id"), "state"), percent)
    rest = found.where("not dense").select("a", "b").distinct()
    if tried is not None:
        rest = rest.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    rest = materialize(rest, "pairs")
    last = [confirm(rest, docs, width, percent)] if not rest.isEmpty() else []
    if not found.where("dense").isEmpty():
        last.append(_dense_links(found, units, docs, width, percent))
    for x in last:
        edges = edges.union(x)
    if last:
        comp = materialize(connected_components(edges), "components")
    members = members.join(comp, members["rep"] == comp["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    out = sketch.select("doc_id", "n_shingles").join(members, "doc_id", "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
