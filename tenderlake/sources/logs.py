"""Operation log as JSON lines: writer, and a typed reader for batch and stream.

One line an operation: timestamp, level, component, system, version,
correlation id and the operation's fields.  Lines that do not parse keep their
text in ``_corrupt`` and are told apart by ``split_corrupt``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake import schemas as S

LOG_SCHEMA = ("timestamp string, level string, component string, system string, version string, correlation_id string, "
              "event_id bigint, user_id bigint, operation string, duration_ms double, success boolean, status_code int, "
              "tokens bigint, documents bigint, cache_hit boolean, context map<string,string>, _corrupt string")


def write_log(log: DataFrame, path: str, component: str = "rag_engine", system: str = "tenderlake") -> None:
    """``log`` (an operation log) as JSON lines."""
    out = log.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.when(F.col("success"), F.lit("info")).otherwise(F.lit("error")).alias("level"),
        F.lit(component).alias("component"), F.lit(system).alias("system"), F.lit(S.ENGINE_VERSION).alias("version"),
        F.concat(F.lit("req_"), F.col("event_id").cast("string")).alias("correlation_id"),
        "event_id", "user_id", "operation", "duration_ms", "success", "status_code", "tokens", "documents", "cache_hit", "context")
    out.write.mode("overwrite").json(path)


def _typed(lines: DataFrame) -> DataFrame:
    rows = lines.select(F.from_json("value", LOG_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}).alias("j")).select("j.*")
    return rows.withColumn("ts", F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).drop("timestamp")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.read.text(path))


def stream_log(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return _typed(spark.readStream.option("maxFilesPerTrigger", max_files).text(path))


def split_corrupt(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, lines that did not parse)."""
    return log.filter(F.col("_corrupt").isNull()).drop("_corrupt"), log.filter(F.col("_corrupt").isNotNull()).select("_corrupt")
