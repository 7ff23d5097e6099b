"""Shared folder, lineage cuts and worker-side caches used by the operators."""

from __future__ import annotations

import io
import sys
import tempfile
import types
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in a local session without that setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='larkspur-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/larkspur-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: a lineage cut that survives the loss of executors."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def worker_cache() -> dict:
    """A dict that outlives tasks in a Python worker."""
    mod = sys.modules.setdefault("_larkspur_worker_cache", types.ModuleType("_larkspur_worker_cache"))
    return mod.__dict__.setdefault("store", {})


def forget() -> None:
    """Free what earlier tasks of other operators left in this Python worker."""
    worker_cache().clear()


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on between tasks and would keep its peak."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that they need no installed copy."""
    sc = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    if sc.applicationId in _shipped or not package.is_dir():
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    where = sc._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark, 'code')}/{package.name}.zip")
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where)
    out.write(data.getvalue())
    out.close()
    sc.addPyFile(where.toString())
    _shipped.add(sc.applicationId)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), after which the worker's memory is given back."""
    ship(df.sparkSession)

    def released(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(released, schema)


#: Bytes of one Arrow batch between the JVM and a Python worker; each is held several times over at both ends.
BATCH_BYTES = "2m"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_BYTES unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, BATCH_BYTES)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes of text that a worker takes up at once.
SLICE_BYTES = 2 << 20


def sliced(batches, column: str = "text", most: int = SLICE_BYTES):
    """Record batches joined and cut so that `column` holds about `most` bytes at most, or one row."""
    import numpy as np
    import pyarrow as pa

    def cut(held):
        b = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        total = np.cumsum(np.concatenate([_byte_lengths(x.column(x.schema.get_field_index(column))) for x in held]))
        start = 0
        while start < b.num_rows:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
            yield b.slice(start, end - start)
            start = end

    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        n = int(_byte_lengths(b.column(b.schema.get_field_index(column))).sum())
        if held and size + n > most:
            yield from cut(held)
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield from cut(held)


def _byte_lengths(arr):
    import numpy as np
    import pyarrow.compute as pc

    if arr.null_count == len(arr):
        return np.zeros(len(arr), np.int64)
    return pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)


#: Pieces that stand for a text over the bound of a sample, evenly spread from its start to its end.
PIECES = 4


def sampled_texts(docs: DataFrame, ids: DataFrame, key: str, max_chars: int) -> list:
    """Rows (key, text) of the documents in ids (doc_id, key), without empty texts, in order of a hash of the id. Of a text over max_chars there are PIECES pieces of as many characters together at most.

    ids is a sample of stated size; only it is broadcast, and only its texts travel. Where rows of one id differ, the
    text with the smallest hash stands for it, picked by an aggregate that starts on the map side: no more rows reach
    the driver than ids has, however often an id is repeated.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size, piece = F.length("text"), max(1, max_chars // PIECES - 1)
    cut = F.concat_ws("\n", *[F.substr("text", (F.lit(1) + F.floor((size - piece) * (k / (PIECES - 1)))).cast("int"), F.lit(piece)) for k in range(PIECES)])
    text = F.when(size <= max_chars, F.col("text")).otherwise(cut).alias("text")
    found = own.join(F.broadcast(ids), "doc_id").where(size >= 1).select("doc_id", key, F.xxhash64("text").alias("t"), text)
    rows = found.groupBy("doc_id", key).agg(F.min(F.struct("t", "text")).alias("one")).select(F.xxhash64("doc_id").alias("h"), "doc_id", key, F.col("one.text").alias("text")).collect()
    return sorted(rows, key=lambda r: (r["h"], r["doc_id"], r[key]))


def with_columns_by_batch(df: DataFrame, f, fields: str, column: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """df with more columns that f computes from slices of record batches (f(batch) -> list of Arrow arrays); all other columns pass through."""
    from pyspark.sql import types as T

    new = T._parse_datatype_string(fields)
    schema = T.StructType([*df.schema.fields, *new.fields])
    names = schema.names

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches, column, most):
            yield pa.RecordBatch.from_arrays([*b.columns, *f(b)], names=names)

    return map_batches(df, run, schema)


#: Bits of an id filter: this many for each id, and at most 32 MB in all. A full filter only lets more through.
FILTER_BITS_EACH, FILTER_BITS_MOST, FILTER_HASHES = 16, 1 << 28, 3


def id_filter(ids: DataFrame):
    """A Bloom filter of bounded size over the ids of a one-column DataFrame, as a numpy array of 64-bit words."""
    import numpy as np

    n = ids.count()
    bits = 1 << 16
    while bits < min(FILTER_BITS_MOST, FILTER_BITS_EACH * n):
        bits *= 2
    words = np.zeros(bits // 64, np.int64)
    spot = F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(bits)) for k in range(FILTER_HASHES)]))
    cells = ids.toDF("id").select(spot.alias("s")).groupBy(F.expr("cast(s div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(cast(1 as bigint), cast(s % 64 as int)))").alias("v"))
    for batch in cells.toArrow().to_batches():
        words[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return words


def by_filters(docs: DataFrame, tests: list, keep, then=None, schema=None) -> DataFrame:
    """Rows of docs for which keep(one boolean array for each filter) holds. tests: filters as from id_filter; a null id is in none.

    then(batches), with its schema, goes on with what is kept in the same Python worker; a second map would double
    the workers that are alive.
    """
    import numpy as np

    names = docs.columns
    spots = [F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(k)), F.lit(64 * len(w))).alias(f"__s{i}_{k}") for i, w in enumerate(tests) for k in range(FILTER_HASHES)]
    known = [docs.sparkSession.sparkContext.broadcast(w) for w in tests]
    n = len(names)

    def passed(batches):
        import pyarrow as pa

        for b in batches:
            inside = []
            for i, w in enumerate(known):
                bits = w.value.view(np.uint64)
                ok = b.column(n).is_valid().to_numpy(zero_copy_only=False).copy()
                for k in range(FILTER_HASHES):
                    s = b.column(n + 1 + i * FILTER_HASHES + k).to_numpy(zero_copy_only=False).astype(np.int64)
                    ok &= (bits[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                inside.append(ok)
            yield pa.RecordBatch.from_arrays(b.columns[:n], names=names).filter(pa.array(keep(*inside)))

    run = passed if then is None else lambda batches: then(passed(batches))
    return map_batches(docs.select(*[docs[c] for c in names], F.col("doc_id").alias("__id"), *spots), run, schema or docs.schema)


def without_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in dropped (one column of ids). Texts do not move, but for about one row in a hundred.

    A filter over the dropped ids settles the rows it does not hold. A second one, over the ids that the first holds by
    chance, settles most others; only rows in both are joined.
    """
    dropped = dropped.toDF("doc_id")
    first = id_filter(dropped)
    chance = by_filters(docs.select(F.col("doc_id").cast("long").alias("doc_id")), [first], lambda a: a).distinct().join(dropped, "doc_id", "left_anti")
    second = id_filter(chance)
    sure = by_filters(docs, [first], lambda a: ~a)
    doubt = by_filters(docs, [first, second], lambda a, b: a & b)
    return sure.union(doubt.join(dropped, doubt["doc_id"].cast("long") == dropped["doc_id"], "left_anti"))
