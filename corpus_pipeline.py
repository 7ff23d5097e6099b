"""A corpus pipeline: toxicity, language, near-duplicates, benchmark decontamination, packing.

Each stage works on all rows that the one before kept and, but for the last, returns the columns of documents. Texts
stay where they are: stages pass rows through a map, or drop ids by filters of bounded size.

Cases: rows with null or empty texts pass the first, third and fourth stage and are rejected by the language stage. A
null doc_id is kept wherever the text allows. Repeated rows of an id are one document after the third stage. Without
labels of both kinds the toxicity stage keeps all, without labelled languages the language stage does. Empty tables
give no rows. Extra columns of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, language, minhash, packing, toxicity
from larkspur.llm.queries import table, vocabulary
from larkspur.llm.runtime import materialize, without_ids

#: A passage of this many words is what the benchmark stage looks for.
BENCHMARK_WORDS = 10


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 stay."""
    try:
        model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    except toxicity.NoLabels:
        return docs
    return toxicity.with_scores(docs, model).where(F.col("__score") < 0.5).drop("__score")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; an id goes if all its rows are rejected."""
    try:
        model = language.fit(docs)
    except language.NoLabels:
        return docs
    rows = docs.select("doc_id", "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
    judged = materialize(language.identify(rows, model).select("doc_id", "accepted"), "judged")
    rejected = judged.where("doc_id is not null").groupBy("doc_id").agg(F.max("accepted").alias("any")).where("not any").select("doc_id")
    return without_ids(docs, rejected)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest id stays, and one row of it."""
    found = materialize(minhash.near_duplicates(docs, width=5, percent=80), "groups").where("doc_id is not null")
    kept = without_ids(docs, found.where("not kept").select("doc_id").distinct())
    repeated = found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    once = without_ids(kept, repeated)
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*[c for c in kept.columns])
    return once.union(again)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window stay."""
    flagged = decontaminate.contaminated_flag(docs, table(spark, sf_dir, "benchmark"), BENCHMARK_WORDS)
    return flagged.where("not __contaminated").drop("__contaminated")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("minhash", drop_near_duplicates), ("decontaminate", drop_benchmark), ("packing", pack)]

#: A network's scores are beyond SQL; a test holds what run() gives against plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
