"""Near-duplicate embeddings by inverted lists and product quantisation.

Coarse centroids split the vectors into lists; a vector's residual to its centroid is coded in SUBSPACES parts of one
byte each. A vector visits, beside its own list, every list whose border lies near enough for a linked vector to be
across it. In a list, table-lookup distances between the visitor and the codes discard what cannot be linked (a code's
own error is known, so nothing linked is discarded), and the exact cosine in double precision decides about the rest.

Equal vectors are one row with a weight, however many there are. Neighbouring lists form a tile; a visitor is sent to a
tile once, with the numbers of the lists that it visits there, and a tile is worked on in blocks of bounded size. A link
counts for both sides although perhaps only one visits the other: the visitor always counts it, the other side where
it does not visit the visitor's list. Blocks give back sums and roots of what hangs together, never pairs.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of
each length are indexed apart and link among themselves. Repeated rows count as other vectors. Rows of one vec_id with
different vectors share a component. A null vec_id has component null and is kept. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.components import connected_components
from larkspur.llm.runtime import map_batches, materialize

#: Vectors (those with the smallest hashes of their key) to fit centroids and codes on: so many, or SAMPLE_EACH for each
#: list where that is more. Lists grow with the root of the number of vectors, so both stay small beside the input.
SAMPLE_VECTORS, SAMPLE_EACH = 20_000, 8
SUBSPACES, CODES = 8, 256
#: A visit reaches across a border by this share of the greatest distance between linked vectors. One of two linked
#: vectors lies within half of that distance of the border between their lists, so at 0.5 no link can be missed, however
#: the vectors are spread. Less would miss links wherever near copies differ in few directions.
REACH = 0.5
#: Members and visitors of a block of work, about; and the table-lookup distances that are held at once.
MEMBERS, VISITORS, CELLS = 8192, 16_384, 1 << 20


def list_count(n: int) -> int:
    """Lists for n vectors: as many as a list has members."""
    return int(max(1, n**0.5))


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = 0.5 * (c * c).sum(1)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmax(x[i : i + 4096] @ c.T - half, 1)
    return out


class Index:
    """Coarse centroids, in tiles of neighbours, and residual codes of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, tiles: int = 1, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.width = -(-self.dim // SUBSPACES)
        x = sample.astype(np.float32)
        self.centroids = _kmeans(x, lists, rng, 4)
        self.half = 0.5 * (self.centroids**2).sum(1)
        few = len(self.centroids)
        self.tile = np.arange(few) if 2 * tiles > few else _nearest(self.centroids, _kmeans(self.centroids, tiles, rng))
        r = self._parts(x - self.centroids[_nearest(x, self.centroids)])
        books = [_kmeans(np.ascontiguousarray(r[:, s]), CODES, rng) for s in range(SUBSPACES)]
        most = max(len(b) for b in books)
        self.books = np.stack([np.concatenate([b, np.repeat(b[:1], most - len(b), 0)]) for b in books])

    def _parts(self, r: np.ndarray) -> np.ndarray:
        full = np.zeros((len(r), SUBSPACES * self.width), np.float32)
        full[:, : self.dim] = r
        return full.reshape(len(r), SUBSPACES, self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and the distance between each vector and its decoded form."""
        x = x.astype(np.float32)
        near = _nearest(x, self.centroids)
        r = self._parts(x - self.centroids[near])
        codes = np.stack([_nearest(np.ascontiguousarray(r[:, s]), self.books[s]) for s in range(SUBSPACES)], 1).astype(np.uint8)
        back = self.books[np.arange(SUBSPACES), codes]
        return near, codes, np.sqrt(((r - back) ** 2).sum((1, 2)))

    def visits(self, x: np.ndarray, near: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list) of all visits: to those lists whose border with the vector's own is at most `reach` away."""
        x = x.astype(np.float32)
        who, where = [], []
        step = max(16, (1 << 21) // len(self.centroids))
        for i in range(0, len(x), step):
            own, home = np.arange(len(x[i : i + step])), near[i : i + step]
            side = x[i : i + step] @ self.centroids.T - self.half
            gap = np.sqrt(np.maximum(0, 2 * (self.half[home][:, None] + self.half - self.centroids[home] @ self.centroids.T)))
            near_border = side[own, home][:, None] - side <= reach * gap + 1e-5
            near_border[own, home] = True
            a, b = np.nonzero(near_border)
            who.append(a + i)
            where.append(b)
        return np.concatenate(who), np.concatenate(where)

    def tables(self, x: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances of the residuals' parts to all codes of a list: subspace x code x vector."""
        r = self._parts(x.astype(np.float32) - self.centroids[cell]).transpose(1, 2, 0)
        return (self.books**2).sum(2)[:, :, None] + (r**2).sum(1)[:, None] - 2 * self.books @ r

    @staticmethod
    def lookup(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of coded members (rows) to vectors (columns), by table lookups."""
        out = tables[0].take(codes[:, 0], 0)
        for s in range(1, len(tables)):
            out += tables[s].take(codes[:, s], 0)
        return out


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    kind = df.schema[vec_col].dataType.elementType
    single = isinstance(kind, T.FloatType)

    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            vec, key, dim = [], [], []
            for v in b.column(1):
                raw = None
                if v.is_valid and len(v):
                    a = v.values
                    if not a.null_count:
                        x = a.to_numpy(zero_copy_only=False).astype(np.float64)
                        if np.isfinite(x).all() and x.any():
                            raw = (x + 0.0).astype("<f4" if single else "<f8").tobytes()
                vec.append(raw)
                key.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
                dim.append(None if raw is None else len(v))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vec, pa.binary()), pa.array(key, pa.binary()), pa.array(dim, pa.int32())], names=["vec_id", "vec", "key", "dim"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col)), run, "vec_id long, vec binary, key binary, dim int"), "<f4" if single else "<f8"


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _flat(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binaries in a row, and how many each has."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
    size = np.dtype(kind).itemsize
    n = np.diff(offs) // size
    return (np.frombuffer(column.buffers()[2], kind, int(n.sum()), int(offs[0])) if n.sum() else np.zeros(0, kind)), n


def _rows(column, kind) -> np.ndarray:
    x, n = _flat(column, kind)
    return x.reshape(len(n), -1)


def _binaries(x: np.ndarray, counts: np.ndarray):
    """Numbers as binaries of so many numbers each."""
    import pyarrow as pa

    offs = np.concatenate([[0], np.cumsum(counts)]) * x.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hang together what a and b (nodes, pair by pair) tie; parent holds every node's root, the smallest of its class."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart]))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


CODED = "id long, weight long, vec binary, cell int, tile int, codes binary, err float, visits binary, guests array<struct<tile:int,lists:binary>>"
UNIT_OUT = "id long, links long, root long"


def _parts(reps: DataFrame, n: int, kind: str, threshold: float, reach: float) -> DataFrame:
    """id, links and root of the linked among n distinct vectors (key, id, weight, vec) of one length, a row for each block."""
    spark = reps.sparkSession
    lists = list_count(n)
    most = max(SAMPLE_VECTORS, SAMPLE_EACH * lists)
    share = min(1.0, most / n)
    sample = reps.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("key", "vec").limit(2 * most).toArrow().sort_by("key")
    if not sample.num_rows:
        sample = reps.select("key", "vec").limit(1).toArrow()
    index = spark.sparkContext.broadcast(Index(_unit(_rows(sample.column("vec"), kind)), lists, -(-n // MEMBERS)))
    far = float(np.sqrt(2 - 2 * threshold)) + 1e-6

    def encode(batches):
        import pyarrow as pa

        ix = index.value
        for b in batches:
            for i in range(0, b.num_rows, 4000):
                part = b.slice(i, 4000)
                x = _unit(_rows(part.column(2), kind))
                cell, codes, err = ix.encode(x)
                who, where = ix.visits(x, cell, reach * far)
                tile = ix.tile[where]
                order = np.lexsort((tile, who))
                first = np.flatnonzero(np.diff(who[order], prepend=-1) | np.diff(tile[order], prepend=-1))
                guests = pa.StructArray.from_arrays([pa.array(tile[order][first].astype(np.int32)), _binaries(where[order].astype(np.int32), np.diff(first, append=len(order)))], names=["tile", "lists"])
                offs = np.concatenate([[0], np.cumsum(np.bincount(who[order][first], minlength=len(x)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell.astype(np.int32)), pa.array(ix.tile[cell].astype(np.int32)), _binaries(codes, np.full(len(x), SUBSPACES)), pa.array(err, pa.float32()), _binaries(where.astype(np.int32), np.bincount(who, minlength=len(x))), pa.ListArray.from_arrays(pa.array(offs), guests)],
                    names=["id", "weight", "vec", "cell", "tile", "codes", "err", "visits", "guests"],
                )

    coded = materialize(map_batches(reps.select("id", "weight", "vec"), encode, CODED), "coded")
    come = coded.select(F.explode("guests").alias("g"), "id", "weight", "vec", "cell").select("g.tile", "g.lists", "id", "weight", "vec", "cell")
    members = coded.groupBy("tile").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("mbs"))
    guests = come.groupBy("tile").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("vbs"))
    blocks = members.join(guests, "tile")
    spot = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    here = coded.withColumnRenamed("visits", "lists").join(blocks, "tile").select("tile", spot("mbs").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("vbs") - 1)).alias("vb"), F.lit(True).alias("member"), "id", "weight", "vec", "cell", "lists", "codes", "err")
    come = come.join(blocks, "tile").select("tile", F.explode(F.sequence(F.lit(0), F.col("mbs") - 1)).alias("mb"), spot("vbs").alias("vb"), F.lit(False).alias("member"), "id", "weight", "vec", "cell", "lists", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("err"))

    def work(key, block):
        import pyarrow as pa

        ix = index.value
        m, v = block.filter(block["member"]), block.filter(pa.compute.invert(block["member"]))
        empty = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not m.num_rows or not v.num_rows:
            return empty
        m = m.sort_by("cell")
        (mx, vx), ((mid, mw, home_m), (vid, vw, home_v)) = (_unit(_rows(t["vec"], kind)) for t in (m, v)), ([t[c].to_numpy() for c in ("id", "weight", "cell")] for t in (m, v))
        codes, limit = _rows(m["codes"], np.uint8), (far + m["err"].to_numpy() + 1e-4) ** 2
        visited, count = _flat(v["lists"], np.int32)
        order = np.argsort(visited, kind="stable")
        guest, visited = np.repeat(np.arange(len(count)), count)[order], visited[order]
        goes, count = _flat(m["lists"], np.int32)
        goes = np.sort(np.repeat(np.arange(len(count)), count) * np.int64(len(ix.centroids)) + goes)
        nodes, node = np.unique(np.concatenate([vid, mid]), return_inverse=True)
        node_v, node_m = node[: len(vid)], node[len(vid) :]
        parent, links = np.arange(len(nodes)), np.zeros(len(nodes))
        cells, start = np.unique(home_m, return_index=True)
        for cell, lo, hi in zip(cells.tolist(), start.tolist(), [*start[1:].tolist(), len(home_m)]):
            a, b = np.searchsorted(visited, [cell, cell + 1])
            step = max(16, CELLS // (hi - lo))
            for k in range(a, b, step):
                who = guest[k : min(b, k + step)]
                may = ix.lookup(ix.tables(vx[who], cell), codes[lo:hi]) <= limit[lo:hi, None]
                if np.count_nonzero(may) > 0.02 * may.size:
                    j, i = np.nonzero(may & (mx[lo:hi] @ vx[who].T >= threshold))
                    j, i = j + lo, who[i]
                else:
                    j, i = np.nonzero(may)
                    j, i = j + lo, who[i]
                    ok = np.einsum("ij,ij->i", mx[j], vx[i]) >= threshold
                    j, i = j[ok], i[ok]
                other = node_v[i] != node_m[j]
                j, i = j[other], i[other]
                if not len(i):
                    continue
                links += np.bincount(node_v[i], weights=mw[j], minlength=len(nodes))
                _merge(parent, node_v[i], node_m[j])
                away = home_v[i] != cell  # a member counts the guests whose lists it does not visit itself
                if away.any():
                    j, i = j[away], i[away]
                    back = j * np.int64(len(ix.centroids)) + home_v[i]
                    lost = goes[np.minimum(np.searchsorted(goes, back), len(goes) - 1)] != back
                    links += np.bincount(node_m[j[lost]], weights=vw[i[lost]], minlength=len(nodes))
        hit = np.flatnonzero((links > 0) | (parent != np.arange(len(nodes))))
        if not len(hit):
            return empty
        return pa.table({"id": nodes[hit], "links": links[hit].astype(np.int64), "root": nodes[parent[hit]]})

    return materialize(here.unionByName(come).groupBy("tile", "mb", "vb").applyInArrow(work, UNIT_OUT), "parts")


def near_duplicates(df: DataFrame, threshold: float = 0.95, reach: float = REACH, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of df."""
    spark = df.sparkSession
    vectors, kind = _vectors(df, id_col, vec_col)
    vectors = materialize(vectors, "vectors")
    good = vectors.where("dim is not null and vec_id is not null")
    reps = materialize(good.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("vec").alias("vec"), F.first("dim").alias("dim")), "distinct")
    sizes = sorted((r["dim"], r["count"]) for r in reps.groupBy("dim").count().collect())
    parts = spark.createDataFrame([], UNIT_OUT + ", dim int")
    for dim, n in sizes:
        if n > 1:
            parts = parts.union(_parts(reps.where(F.col("dim") == dim).drop("dim"), n, kind, threshold, reach).withColumn("dim", F.lit(dim)))
    sums = parts.groupBy("id", "dim").agg(F.sum("links").alias("links"))
    comp = connected_components(parts.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = reps.select("key", "id", "dim", "weight").join(sums, ["id", "dim"], "left").join(comp, reps["id"] == comp["node"], "left")
    classes = classes.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = vectors.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("key"))).select("vec_id", "key").join(classes, "key", "left")
    own = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))
