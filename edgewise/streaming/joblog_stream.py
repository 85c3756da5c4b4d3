"""Streaming twins of the job-log operators (Structured Streaming).

* ``first_arrivals_stream`` and ``request_outcomes_stream`` are stateful aggregations
  in update mode: the state store keeps one row per key and day, and each micro-batch
  appends its changed rows to a log table in shared storage (``foreachBatch``,
  idempotent per batch id). The answer merges that log with associative aggregates.
* ``distinct_arrivals_stream`` deduplicates within the watermark in append mode: a key
  is forgotten once the watermark has passed its first record by the delay.
* ``matched_stream`` joins two streams, requests and outcomes, each with a watermark of
  its own, on the key and a time range, as a left outer join in append mode: a request
  without an outcome is emitted when the watermark shows that none can come.

Watermarks bound every state. Records later than the watermark are dropped by Spark and
counted (``late_rows`` of the :class:`Run` that the functions append to ``runs``); feed a
source in time order, or with a delay that covers its disorder, and none are. A run reads
all files that are there and ends; the next one resumes from the checkpoint, so a folder
may be fed slice by slice (``queries`` does).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def _append_log(log_path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.withColumn("batch_id", F.lit(batch_id))
        # overwrite this batch's partition only: a replayed batch rewrites it
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(log_path))
    return write


@dataclass
class Run:
    """What one run of a stream did: batches, rows dropped as late, and the rows of state left at its end."""
    batches: int = 0
    late_rows: int = 0
    state_rows: int = 0


def _run(stream: DataFrame, log_path: str, checkpoint: str, mode: str = "update", runs: list[Run] | None = None) -> None:
    # the log exists, with its schema, before the first record arrives
    empty = stream.sparkSession.createDataFrame([], stream.schema).withColumn("batch_id", F.lit(-1))
    empty.write.mode("append").parquet(log_path)
    q = (stream.writeStream.outputMode(mode)
         .foreachBatch(_append_log(log_path))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if runs is not None:
        done = Run()
        for p in q.recentProgress:
            states = p["stateOperators"]
            done.batches += 1
            done.late_rows += sum(s["numRowsDroppedByWatermark"] for s in states)
            done.state_rows = sum(s["numRowsTotal"] for s in states)
        runs.append(done)


def events_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 4) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .parquet(path))


def first_arrivals_stream(spark: SparkSession, source: str, schema, key: str = "user_id",
                          log_path: str | None = None, files_per_batch: int = 4, ts: str = "ts",
                          tie: str = "event_id", watermark: str | None = None, runs: list[Run] | None = None) -> DataFrame:
    """First (ts, tie) per key over a stream of event files.

    Without ``watermark`` the state holds a row per key for good. With it the
    state holds a row per key and day, and a day goes once the watermark has
    passed it; the first arrival is then the least of the days in the log.
    """
    log_path = log_path or scratch_path(spark, "arrivals-log")
    ev = events_stream(spark, source, schema, files_per_batch)
    keys = [F.col(key).alias("name")]
    if watermark:
        ev = ev.withColumn("_ets", F.col(ts).cast("timestamp")).withWatermark("_ets", watermark)
        keys.append(F.window("_ets", "1 day").alias("_w"))
    agg = ev.groupBy(*keys).agg(F.min(F.struct(F.col(ts).alias("t"), F.col(tie).alias("k"))).alias("_f"))
    _run(agg.select("name", "_f"), log_path, log_path + "-checkpoint", runs=runs)
    log = spark.read.schema(agg.select("name", "_f").schema).parquet(log_path)
    return (log.groupBy("name").agg(F.min("_f").alias("_f"))
            .select("name", F.col("_f.t").alias("first_ts"), F.col("_f.k").alias(tie)))


def request_outcomes_stream(spark: SparkSession, source: str, schema, watermark: str = "2 days",
                            log_path: str | None = None, files_per_batch: int = 4,
                            runs: list[Run] | None = None) -> DataFrame:
    """Per (user, day): first signup and the outcome code (200 purchase, 400 error)."""
    log_path = log_path or scratch_path(spark, "outcomes-log")
    ev = (events_stream(spark, source, schema, files_per_batch)
          .withColumn("ets", F.col("ts").cast("timestamp"))
          .withWatermark("ets", watermark))
    agg = ev.groupBy("user_id", F.window("ets", "1 day").alias("w")).agg(
        F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("request_ts"),
        F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"),
        F.max((F.col("event_type") == "error").cast("int")).alias("failed"))
    agg = agg.select("user_id", F.to_date(F.col("w.start")).alias("day"),
                     "request_ts", "bought", "failed")
    _run(agg, log_path, log_path + "-checkpoint", runs=runs)
    log = spark.read.schema(agg.schema).parquet(log_path)
    merged = log.groupBy("user_id", "day").agg(
        F.min("request_ts").alias("request_ts"), F.max("bought").alias("bought"),
        F.max("failed").alias("failed"))
    code = (F.when(F.col("bought") == 1, F.lit(200))
            .when(F.col("failed") == 1, F.lit(400)))
    return (merged.where(F.col("request_ts").isNotNull())
            .select("user_id", "day", "request_ts", code.alias("result_code")))


def distinct_arrivals_stream(spark: SparkSession, source: str, schema, keys: list[str], watermark: str, ts: str = "ts",
                             log_path: str | None = None, files_per_batch: int = 4, runs: list[Run] | None = None) -> DataFrame:
    """The distinct values of ``keys`` in a stream of event files, with bounded state.

    ``keys`` are columns of the source, or "day", the day of ``ts``. A value is kept for the
    watermark's delay after its first record; one that comes back later is a new arrival and a
    row of its own in the log (``keys`` without "day" may so appear once for each spell).
    """
    log_path = log_path or scratch_path(spark, "distinct-log")
    ev = (events_stream(spark, source, schema, files_per_batch)
          .withColumn("_ets", F.col(ts).cast("timestamp")).withWatermark("_ets", watermark))
    if "day" in keys:
        ev = ev.withColumn("day", F.to_date("_ets"))
    seen = ev.select(*keys, "_ets").dropDuplicatesWithinWatermark(keys).select(*keys)
    _run(seen, log_path, log_path + "-checkpoint", "append", runs)
    return spark.read.schema(seen.schema).parquet(log_path).select(*keys)


def match_streams(requests: DataFrame, outcomes: DataFrame, key: str, within: str, watermark: str,
                  request_ts: str = "request_ts", outcome_ts: str = "outcome_ts") -> DataFrame:
    """Requests left outer joined with the outcomes of their key that come within ``within`` after them.

    Both are streams. State: a request stays until the watermark has passed it by ``within``, an
    outcome until the watermark has passed it.
    """
    r = requests.withWatermark(request_ts, watermark)
    o = outcomes.withColumnRenamed(key, "_okey").withWatermark(outcome_ts, watermark)
    soon = (F.col(outcome_ts) >= F.col(request_ts)) & (F.col(outcome_ts) <= F.col(request_ts) + F.expr(f"INTERVAL {within}"))
    return r.join(o, (F.col(key) == F.col("_okey")) & soon, "leftOuter").drop("_okey")


def matched_stream(spark: SparkSession, request_source: str, request_schema, outcome_source: str, outcome_schema,
                   key: str, within: str = "6 hours", watermark: str = "1 hour", request_ts: str = "request_ts",
                   outcome_ts: str = "outcome_ts", code: str = "result_code", log_path: str | None = None,
                   files_per_batch: int = 1000, runs: list[Run] | None = None) -> DataFrame:
    """Each request that is settled, with its first outcome: the earliest, of several at once the smallest code.

    A request is settled by an outcome, or once the watermark has passed it by ``within``.
    """
    log_path = log_path or scratch_path(spark, "matched-log")
    sides = [events_stream(spark, path, schema, files_per_batch).withColumn(ts, F.col(ts).cast("timestamp"))
             for path, schema, ts in ((request_source, request_schema, request_ts), (outcome_source, outcome_schema, outcome_ts))]
    pairs = match_streams(*sides, key, within, watermark, request_ts, outcome_ts)
    _run(pairs, log_path, log_path + "-checkpoint", "append", runs)
    log = spark.read.schema(pairs.schema).parquet(log_path)
    own = [c for c in sides[0].columns]
    first = F.min(F.when(F.col(outcome_ts).isNotNull(), F.struct(F.col(outcome_ts).alias("t"), F.col(code).alias("c"))))
    return log.groupBy(*own).agg(first.alias("_f")).select(*own, F.col("_f.t").alias(outcome_ts), F.col("_f.c").alias(code))
