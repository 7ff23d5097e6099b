"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document where its content says so, so copies and near copies share chunks.
A chunk's address is the BLAKE2b-128 digest of its ids; each address is stored once. A document's recipe lists its
chunks and their lengths; its leaf is a hash of both. A Merkle manifest (leaf with id, place and size; root of each
recipe file; root of the store) makes every part verifiable, and reading verifies: chunks against their addresses,
leaves against the recipes, roots against the stored manifest.

Layout below the store's path, all Parquet so that any file system that Spark knows will do:
  packed/kind=0   digest, n, data (ids, little-endian, 2 bytes where the vocabulary allows, else 4): unique chunks
  packed/kind=1   recipes as they left the encoder
  recipes         doc_id, start, n_tokens, lens, digests, leaf, part: ascending doc_id, file by file
  manifest        part, n_docs, n_tokens, root

Cases: a null text is empty, an empty text has the end id only. Repeated document rows are each stored (their
chunks once) and follow one another in order of their content. Texts of any length are kept whole. An empty table
gives an empty store. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.runtime import map_batches, sliced
from larkspur.llm.tokens import tokenizer_json

MIN_CHUNK, MAX_CHUNK, MEAN_BITS, WINDOW = 64, 2048, 8, 16
#: Addresses that a task remembers; what it forgets goes to the shuffle again and is dropped there.
TASK_CHUNKS = 200_000
#: Bytes of text that are encoded at once: each distinct piece of them is looked up once.
SLICE = 6 << 20
PACKED = "kind int, key binary, doc_id long, n long, lens binary, data binary"


def gear(vocab: int = 1 << 16):
    """A fixed pseudo-random 32-bit number for each id (mixed by multiplication and shifts)."""
    import numpy as np

    x = np.arange(vocab, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def chunk_ends(ids, doc_ends):
    """Ends of all chunks. The rolling hash of the last WINDOW ids decides, MIN_CHUNK and MAX_CHUNK bound a chunk, a document's end ends its last one."""
    import numpy as np

    h = gear()[ids & 0xFFFF]
    for step in (1, 2, 4, 8):  # after these, h holds the last 16 ids
        h[step:] += h[:-step].copy() << np.uint32(step)
    marks = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out, i, at = [], 0, 0
    marks = marks.tolist()
    marks.append(1 << 60)
    for end in doc_ends.tolist():
        while True:
            while marks[i] < at + MIN_CHUNK:
                i += 1
            cut = min(marks[i], at + MAX_CHUNK)
            if cut >= end:
                break
            out.append(cut)
            at = cut
        out.append(end)
        at = end
    return np.array(out, np.int64)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, partitions: int | None = None) -> None:
    """Encode documents and write their store to path.

    Chunks that a task has seen before stay behind, so a frequent chunk reaches the shuffle at most once a task; the
    shuffle by address then brings equal chunks together and one of each is written.
    """
    spark = docs.sparkSession
    js = tokenizer_json(tokenizer_path)

    def encode_docs(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        from larkspur.llm.store import chunk_ends, leaf_of
        from larkspur.llm.tokens import encode

        seen = set()
        for b in sliced(batches, most=SLICE):
            if len(seen) > TASK_CHUNKS:
                seen.clear()
            ids, n = encode(b.column(1), js, end_id)
            doc_ends = np.cumsum(n)
            ends = chunk_ends(ids, doc_ends)
            lens = np.diff(ends, prepend=0)
            wide = len(ids) and int(ids.max()) > 0xFFFF
            raw = memoryview((ids if wide else ids.astype("<u2")).tobytes())
            unit = 4 if wide else 2
            digests, new, new_len = [], [], []
            at = 0
            for k, e in enumerate(ends.tolist()):
                piece = raw[at * unit : e * unit]
                d = hashlib.blake2b(piece, digest_size=16, person=b"ids4" if wide else b"ids2").digest()
                digests.append(d)
                if d not in seen:
                    seen.add(d)
                    new.append((d, bytes(piece)))
                    new_len.append(int(lens[k]))
                at = e
            for i in range(0, len(new), 4000):
                part = new[i : i + 4000]
                m = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * m, pa.int32()), pa.array([x[0] for x in part], pa.binary()), pa.nulls(m, pa.int64()), pa.array(new_len[i : i + 4000], pa.int64()), pa.nulls(m, pa.binary()), pa.array([x[1] for x in part], pa.binary())],
                    names=["kind", "key", "doc_id", "n", "lens", "data"],
                )
            bounds = [0, *(np.searchsorted(ends, doc_ends) + 1).tolist()]
            l4 = lens.astype("<u4")
            recipes = [(b"".join(digests[x:y]), l4[x:y].tobytes()) for x, y in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * len(recipes), pa.int32()), pa.array([leaf_of(*r) for r in recipes], pa.binary()), b.column(0), pa.array(n, pa.int64()), pa.array([r[1] for r in recipes], pa.binary()), pa.array([r[0] for r in recipes], pa.binary())],
                names=["kind", "key", "doc_id", "n", "lens", "data"],
            )

    def keep_once(batches):  # equal addresses are neighbours
        import pyarrow as pa
        import pyarrow.compute as pc

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(1)
            new = pa.concat_arrays([pa.array([keys[0].as_py() != last]), pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))])
            last = keys[-1].as_py()
            yield b.filter(pc.or_(new, pc.equal(b.column(0), 1)))

    encoded = map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), encode_docs, PACKED)
    # equal addresses meet by their hash; a recipe's key differs from row to row, repeated documents are salted apart
    salt = F.when(F.col("kind") == 1, F.xxhash64("doc_id")).otherwise(F.xxhash64("key"))
    dealt = (encoded.repartition(partitions, salt) if partitions else encoded.repartition(salt)).sortWithinPartitions("kind", "key")
    map_batches(dealt, keep_once, PACKED).write.partitionBy("kind").parquet(f"{path}/packed")
    packed = spark.read.schema("key binary, doc_id long, n long, lens binary, data binary, kind int").parquet(f"{path}/packed")
    recipes = packed.where("kind = 1").select("doc_id", F.col("n").alias("n_tokens"), "lens", F.col("data").alias("digests"), F.col("key").alias("leaf"))
    ordered = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "leaf").withColumn("part", F.spark_partition_id())
    ordered.write.parquet(f"{path}/ordered")
    ordered = spark.read.schema("doc_id long, n_tokens long, lens binary, digests binary, leaf binary, part int").parquet(f"{path}/ordered")
    # one row per recipe file: ids before it
    sums = ordered.groupBy("part").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n_docs"))
    before = sums.withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "leaf").rowsBetween(Window.unboundedPreceding, -1)
    started = ordered.withColumn("__in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before.select("part", "base"), "part")
    started.select("doc_id", (F.col("base") + F.col("__in")).alias("start"), "n_tokens", "lens", "digests", "leaf", "part").write.parquet(f"{path}/recipes")
    manifest(spark, path).write.parquet(f"{path}/manifest")


RECIPES = "doc_id long, start long, n_tokens long, lens binary, digests binary, leaf binary, part int"


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    packed = spark.read.schema("key binary, doc_id long, n long, lens binary, data binary, kind int").parquet(f"{path}/packed")
    return packed.where("kind = 0").select(F.col("key").alias("digest"), "n", "data")


def leaf_of(digests: bytes, lens: bytes) -> bytes:
    """Hash of a recipe: its chunks' addresses and lengths."""
    import hashlib

    return hashlib.blake2b(len(digests).to_bytes(8, "little") + digests + lens, digest_size=16).digest()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, n_docs, n_tokens, root: a Merkle root over the recipes of each file, in document order. `store_root` combines them.

    Leaves are computed anew from the recipes; one that differs from the stored leaf raises an error.
    """

    def hashed(batches):
        import hashlib

        import pyarrow as pa

        from larkspur.llm.store import leaf_of

        for b in batches:
            node = []
            for doc_id, start, n, digests, lens, leaf in zip(*(b.column(k).to_pylist() for k in range(1, 7))):
                if leaf_of(digests, lens) != leaf:
                    raise ValueError(f"the recipe of document {doc_id} at {start} is damaged")
                node.append(hashlib.blake2b(leaf + f"{doc_id}:{start}:{n}".encode(), digest_size=32).digest())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], b.column(6), pa.array(node, pa.binary())], names=["part", "doc_id", "start", "n_tokens", "leaf", "node"])

    def fold(batches):
        import pyarrow as pa

        from larkspur.llm.store import MerkleRange

        now, tree, docs, tokens, out = None, None, 0, 0, []
        for b in batches:
            for part, n, node in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(5).to_pylist()):
                if part != now:
                    if tree is not None:
                        out.append((now, docs, tokens, tree.root()))
                    now, tree, docs, tokens = part, MerkleRange(), 0, 0
                tree.add(node)
                docs += 1
                tokens += n
        if tree is not None:
            out.append((now, docs, tokens, tree.root()))
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "n_docs", "n_tokens", "root"])

    rows = map_batches(recipes(spark, path).select("part", "doc_id", "start", "n_tokens", "digests", "lens", "leaf"), hashed, "part int, doc_id long, start long, n_tokens long, leaf binary, node binary")
    rows = rows.repartition(F.col("part")).sortWithinPartitions("part", "start", F.col("doc_id").asc_nulls_first(), "leaf")
    return map_batches(rows, fold, "part int, n_docs long, n_tokens long, root binary")


class MerkleRange:
    """A Merkle root of leaves added in order, in logarithmic memory."""

    def __init__(self):
        self.stack = []

    def add(self, leaf: bytes) -> None:
        import hashlib

        node = (0, leaf)
        while self.stack and self.stack[-1][0] == node[0]:
            node = (node[0] + 1, hashlib.blake2b(b"\x01" + self.stack.pop()[1] + node[1], digest_size=32).digest())
        self.stack.append(node)

    def root(self) -> bytes:
        import hashlib

        out = b""
        for _, x in reversed(self.stack):
            out = hashlib.blake2b(b"\x01" + x + out, digest_size=32).digest() if out else x
        return out


def store_root(spark: SparkSession, path: str) -> bytes:
    """One root over the roots of all recipe files (as many rows as files)."""
    tree = MerkleRange()
    for r in spark.read.parquet(f"{path}/manifest").orderBy("part").toLocalIterator():
        tree.add(bytes(r["root"]))
    return tree.root()


MANIFEST = "part int, n_docs long, n_tokens long, root binary"


def verify(spark: SparkSession, path: str) -> DataFrame:
    """part, stored: recipe files that the manifest lacks or has too many, or whose number of documents, of ids or whose root differs; empty if all recipes are whole."""
    fields = ["n_docs", "n_tokens", "root"]
    stored = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("part", *[F.col(c).alias(f"s_{c}") for c in fields])
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    return manifest(spark, path).join(stored, "part", "full").where(~same).select("part", F.col("s_root").alias("stored"))


class Damaged(ValueError):
    """The store is not what was written."""


def check(spark: SparkSession, path: str) -> None:
    """Raise Damaged if a recipe or the manifest is."""
    bad = verify(spark, path).first()
    if bad is not None:
        raise Damaged(f"recipe file {bad['part']} differs from the manifest")


PLACES = "doc_id long, start long, n_tokens long, seq int, digest binary, n long, after long"


def places(recs: DataFrame) -> DataFrame:
    """One row for each chunk of each recipe: seq, digest, n, and how many of the document's ids come after it."""

    def unroll(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            digs, lens = b.column(4).to_pylist(), [np.frombuffer(x, "<u4").astype(np.int64) for x in b.column(3).to_pylist()]
            if not digs:
                continue
            count = np.fromiter(map(len, lens), np.int64, len(lens))
            flat = np.concatenate(lens)
            who = np.repeat(np.arange(len(lens)), count)
            first = np.cumsum(count) - count
            run = np.cumsum(flat)
            ends = run[first + count - 1]
            payload = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(flat), [None, pa.py_buffer(b"".join(digs))]).cast(pa.binary())
            take = pa.array(who)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array((np.arange(len(flat)) - first[who]).astype(np.int32)), payload, pa.array(flat), pa.array(ends[who] - run)], names=["doc_id", "start", "n_tokens", "seq", "digest", "n", "after"]
            )

    return map_batches(recs.select("doc_id", "start", "n_tokens", "lens", "digests"), unroll, PLACES)


def checked(chunk_rows: DataFrame) -> DataFrame:
    """digest, n, crc32 of the chunk's ids as little-endian uint32; raises where the data do not have their address."""

    def run(batches):
        import hashlib
        import zlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            crc = []
            for d, n, x in zip(*(c.to_pylist() for c in b.columns)):
                wide = len(x) == 4 * n
                if len(x) not in (2 * n, 4 * n) or hashlib.blake2b(x, digest_size=16, person=b"ids4" if wide else b"ids2").digest() != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
                crc.append(zlib.crc32(x if wide else np.frombuffer(x, "<u2").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crc, pa.int64())], names=["digest", "n", "crc"])

    return map_batches(chunk_rows.select("digest", "n", "data"), run, "digest binary, n long, crc long")


def crc_shift(crc, n_bytes):
    """CRC-32 values as they count in a message with n_bytes more behind them (linear over GF(2)); numpy arrays."""
    import numpy as np

    op = np.zeros(32, np.uint64)  # appends one zero bit
    op[0] = 0xEDB88320
    op[1:] = np.uint64(1) << np.arange(31, dtype=np.uint64)

    def times(mat, vec):
        out = np.zeros_like(vec)
        for i in range(32):
            out ^= np.where(vec >> np.uint64(i) & np.uint64(1), mat[i], np.uint64(0))
        return out

    out = crc.astype(np.uint64)
    for _ in range(3):
        op = times(op, op)
    left = n_bytes.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        if odd.any():
            out[odd] = times(op, out[odd])
        op = times(op, op)
        left >>= np.uint64(1)
    return out.astype(np.int64)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: the manifest and every stored chunk are verified, then each document's checksum follows from its recipe.

    Checksums of parts combine to that of the whole, so chunk data never move; addresses and lengths do. A damaged
    chunk, recipe or manifest, a chunk that a recipe names and the store lacks, and a gap between documents raise errors.
    """
    check(spark, path)

    def shift(batches):
        import pyarrow as pa

        from larkspur.llm.store import crc_shift

        for b in batches:
            if b.num_rows:
                moved = crc_shift(b.column(4).to_numpy(), b.column(5).to_numpy() * 4)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(moved)], names=["doc_id", "start", "n_tokens", "n", "crc"])

    seen = checked(chunks(spark, path)).select("digest", F.col("n").alias("long"), "crc")
    at = places(recipes(spark, path)).join(seen, "digest", "left")
    missing = F.when(F.col("crc").isNull() | (F.col("long") != F.col("n")), F.raise_error(F.concat(F.lit("no chunk "), F.hex("digest")))).otherwise(F.col("crc"))
    moved = map_batches(at.select("doc_id", "start", "n_tokens", "n", missing.cast("long").alias("crc"), "after"), shift, "doc_id long, start long, n_tokens long, n long, crc long")
    out = moved.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("__n"))
    whole = F.when(F.col("__n") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a recipe is not whole")))
    return out.select("doc_id", "start", "n_tokens", whole.cast("long").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array of long): documents put together again from their chunks."""
    at = places(recipes(spark, path)).join(chunks(spark, path).select("digest", "data"), "digest")
    lists = at.groupBy("doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "data"))).alias("parts"))

    def build(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids = [np.concatenate([np.frombuffer(p["data"], "<u4" if len(p["data"]) == 4 * p["n"] else "<u2").astype(np.int64) for p in parts]) for parts in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return map_batches(lists.select("doc_id", "start", "parts"), build, "doc_id long, start long, ids array<long>")
