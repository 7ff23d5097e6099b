"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two, largest first and at most
`seq_len`; a piece is a whole sequence. Pieces of equal length form a bucket, so a batch from one bucket
needs no padding and no sequence crosses documents.

Cases: a null text is empty; an empty text has only the end id and is one piece of length 1. Repeated rows
are packed each. Texts of any length are packed whole. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.runtime import map_batches, sliced
from larkspur.llm.tokens import tokenizer_json

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def binary_lengths(n: int, seq_len: int) -> list[int]:
    """Powers of two that add up to n: seq_len as often as it fits, then the set bits of the rest from the highest."""
    rest = n % seq_len
    return [seq_len] * (n // seq_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, seq_len: int = 2048) -> DataFrame:
    """doc_id, start, length, ids (little-endian uint32), doc_tokens, bucket (log2 of length), sequence_id, offset: one row per piece.

    The cut is a map over the scan: no shuffle, and a lost task is redone alone with the same ids, as the
    sequence id holds the partition's number and the row's place in it.
    """
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    js = tokenizer_json(tokenizer_path)

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        from larkspur.llm.packing import binary_lengths
        from larkspur.llm.tokens import encode

        for b in sliced(batches):
            ids, n = encode(b.column(1), js, end_id)
            lens = [binary_lengths(int(x), seq_len) for x in n]
            count = np.fromiter(map(len, lens), np.int64, len(lens))
            flat = np.array([y for x in lens for y in x], np.int64)
            ends = np.cumsum(flat)
            doc_start = np.cumsum(n) - n
            offs = np.concatenate([[0], ends * 4]).astype(np.int64)
            payload = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(flat), [None, pa.py_buffer(offs), pa.py_buffer(ids.astype("<u4"))])
            for i in range(0, len(flat), 20_000):
                s = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(len(n)), count)[s]), pa.array((ends - flat - np.repeat(doc_start, count))[s]), pa.array(flat[s]), payload.slice(i, 20_000).cast(pa.binary()), pa.array(np.repeat(n, count)[s])], names=["doc_id", "start", "length", "ids", "doc_tokens"]
                ).set_column(0, "doc_id", b.column(0).take(pa.array(np.repeat(np.arange(len(n)), count)[s])))

    pieces = map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, PIECES)
    return pieces.select("*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
