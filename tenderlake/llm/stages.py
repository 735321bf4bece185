"""Stages of the corpus pipeline: each applies one operator's decisions to the
documents it is given and returns their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm.common import WORD, prepare, read_table, written
from tenderlake.llm.mixing import mix_sources
from tenderlake.llm.packing import pack_documents
from tenderlake.llm.quality import score_quality
from tenderlake.llm.secrets import redact_documents
from tenderlake.llm.simhash import simhash_classes

SHINGLE, MAX_BITS = 3, 2


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.3 or more, as they are."""
    return score_quality(docs, read_table(spark, sf_dir, "labels"), row=True).filter("predicted = 1").select("row.*")


def keep_one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the least id (null ids last, then by
    the text's hash); of rows that repeat id and text one stays."""
    prepare(spark)
    keys = ["_k1", "_k2"]
    keyed = docs.withColumns({"_k1": F.xxhash64("doc_id", "text"), "_k2": F.xxhash64(F.lit(1), "text", "doc_id")})
    classes = simhash_classes(keyed, shingle=SHINGLE, max_bits=MAX_BITS, keep=tuple(keys))
    first = classes.groupBy("class_fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *keys)).alias("m")).select("m._k1", "m._k2")
    return keyed.join(written(first, "stage-kept"), keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    prepare(spark)
    return redact_documents(docs)


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for every whole copy of a document that it takes, and one
    for the run of words it takes besides (single-spaced).  The mix is decided
    on narrow rows; texts move once, to meet their decision."""
    prepare(spark)
    keys = ["_k1", "_k2"]
    keyed = docs.withColumns({"_k1": F.xxhash64("doc_id", "text"), "_k2": F.xxhash64(F.lit(1), "text", "doc_id")})
    m = mix_sources(keyed, keep=keys).filter("taken > 0")
    all_words = F.col("part_words") == F.col("size")
    # rows that repeat id and text are one decision: their whole copies, and the few runs at a shard's edge
    m = m.groupBy(*keys).agg(
        F.sum(F.col("full") + F.when(all_words, 1).otherwise(0)).cast("int").alias("_whole"),
        F.array_sort(F.collect_list(F.when(~all_words & (F.col("part_words") > 0), F.struct(
            (F.col("part_start") + 1).cast("int").alias("start"), F.col("part_words").cast("int").alias("words"))))).alias("_runs"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    # a run on the circle may pass the document's end and go on at its start
    cut = F.transform("_runs", lambda r: F.concat_ws(" ", F.slice(F.concat(words, words), r["start"], r["words"])))
    texts = F.when(F.size("_runs") > 0, F.concat(F.array_repeat("text", F.col("_whole")), cut)).otherwise(F.array_repeat("text", F.col("_whole")))
    out = (keyed.join(written(m, "stage-mix"), keys).dropDuplicates(keys)
           .withColumn("_copy", F.explode(texts)).drop("text").withColumnRenamed("_copy", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    prepare(spark)
    return pack_documents(docs)
