"""Stage-log CSV source.

A stage log has the header ``Action,Date,Time`` (optionally ``Run`` first),
one stamp per line with the date and the wall-clock time in separate
columns, and blank separator lines between blocks appended later.  Without
a ``Run`` column the run name is taken from the file name
``<run>-<yyyy-mm-dd>.csv``.  Returns ``(run, action, ts)``; blank lines,
all-empty rows and repeated header lines are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The stamp names a run records, in order.
ACTIONS = ["start creation", "finish creation", "start execution",
           "finish execution", "start deletion", "finish deletion"]
# stage -> (start action, finish action)
STAGES = {"creation": ("start creation", "finish creation"),
          "execution": ("start execution", "finish execution"),
          "deletion": ("start deletion", "finish deletion")}

_FILE_RUN = r"^(.*)-\d{4}-\d{2}-\d{2}\.csv$"


def read_stage_log(spark: SparkSession, path: str, with_run_column: bool = True) -> DataFrame:
    if with_run_column:
        raw = (spark.read.option("header", True)
               .schema("Run string, Action string, Date string, Time string").csv(path))
        run = F.col("Run")
    else:
        raw = (spark.read.option("header", True)
               .schema("Action string, Date string, Time string").csv(path)
               .withColumn("_file", F.col("_metadata.file_name")))
        run = F.regexp_extract(F.col("_file"), _FILE_RUN, 1)
    rows = raw.where(F.col("Action").isNotNull() & (F.col("Action") != "Action")
                     & F.col("Date").isNotNull() & F.col("Time").isNotNull())
    ts = F.to_timestamp_ntz(F.concat_ws(" ", F.col("Date"), F.col("Time")))
    return rows.select(run.alias("run"), F.col("Action").alias("action"), ts.alias("ts"))


def write_stage_log(stamps: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``(run, action, ts)`` stamps in the log layout (Run column first).

    Stamps of one run are kept together; an empty separator row precedes the
    stamps taken after execution started, as in an appended log.
    """
    second_block = F.col("action").isin(ACTIONS[3:])
    body = stamps.select(
        F.col("run").alias("Run"), F.col("action").alias("Action"),
        F.date_format("ts", "yyyy-MM-dd").alias("Date"),
        F.date_format("ts", "HH:mm:ss.SSSSSS").alias("Time"),
        F.when(second_block, 2).otherwise(0).alias("_block"), F.col("ts").alias("_ts"))
    seps = (stamps.where(second_block).select("run").distinct()
            .select(F.col("run").alias("Run"), F.lit(None).cast("string").alias("Action"),
                    F.lit(None).cast("string").alias("Date"), F.lit(None).cast("string").alias("Time"),
                    F.lit(1).alias("_block"), F.lit(None).cast("timestamp_ntz").alias("_ts")))
    out = (body.unionByName(seps).repartition("Run")
           .sortWithinPartitions("Run", "_block", "_ts").drop("_block", "_ts"))
    out.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)
