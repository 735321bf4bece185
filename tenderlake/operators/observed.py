"""The engine's own operation log (S12): every operator run leaves a log row.

An ``Observation`` counts the rows an operator gives while its action runs (no
second pass over the data); the run's duration, its outcome and the counts are
appended to the log as a JSON line of ``sources.logs``, which ``read_log`` and
the reports (A1, A3, A9, S13) read like any other operation log.  A run that
fails is logged with its error and raised again.  Log rows are one a run: they
grow with runs, not with data.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions.text import word_count
from tenderlake.sources.logs import write_log

RUN_SCHEMA = ("event_id bigint, user_id bigint, ts timestamp_ntz, operation string, duration_ms double, success boolean, status_code int, "
              "tokens bigint, documents bigint, cache_hit boolean, context map<string,string>")


class ObservedLog:
    """Runs operators and logs them under ``path`` (a folder in storage that
    driver and executors share)."""

    def __init__(self, spark: SparkSession, path: str, user_id: int | None = None):
        self.spark, self.path, self.user_id = spark, path.rstrip("/"), user_id

    def run(self, operation: str, df: DataFrame, target: str, text_col: str | None = None, hit: Column | None = None,
            mode: str = "overwrite", **metrics: Column) -> DataFrame:
        """Write ``df`` to ``target`` (Parquet), log the run, and read the result back.

        ``documents`` is the number of rows; ``tokens`` the words of
        ``text_col``; ``cache_hit`` whether all rows fulfil ``hit``; ``metrics``
        are further aggregates, kept in the log's context."""
        seen = Observation(f"{operation}-{uuid.uuid4().hex}")
        counts = {"_rows": F.count(F.lit(1)), **metrics}
        if text_col is not None:
            counts["_tokens"] = F.coalesce(F.sum(word_count(F.col(text_col)).cast("bigint")), F.lit(0).cast("bigint"))
        if hit is not None:
            counts["_hits"] = F.count_if(hit)
        began, t0 = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), time.monotonic()
        try:
            df.observe(seen, *[c.alias(n) for n, c in counts.items()]).write.mode(mode).parquet(target)
        except Exception as e:
            self._append(operation, began, t0, False, {"error_type": type(e).__name__, "error": str(e).split("\n", 1)[0][:1000]})
            raise
        got = seen.get
        context = {n: str(got[n]) for n in metrics} | {"target": target}
        self._append(operation, began, t0, True, context, got["_rows"], got.get("_tokens"),
                     None if hit is None else got["_rows"] > 0 and got["_hits"] == got["_rows"])
        return self.spark.read.schema(df.schema).parquet(target)

    def _append(self, operation, began, t0, success, context, rows=None, tokens=None, hit=None) -> None:
        event = uuid.uuid4().int >> 65  # 63 bits: a number of the run's own
        row = (event, self.user_id, began, operation, (time.monotonic() - t0) * 1000.0, success, 200 if success else 500, tokens, rows, hit, context)
        # ts has no zone: it is UTC, whatever the session's zone
        log = self.spark.createDataFrame([row], RUN_SCHEMA).coalesce(1)
        write_log(log, f"{self.path}/run={event}")
