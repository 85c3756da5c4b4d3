"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

# ship this package's task functions by value: executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: rows per Arrow batch; documents are long, so a batch stays a few MB
BATCH_ROWS = 512


def prepare_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound an Arrow batch by rows (results do not depend on it)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Spark's setting that removes a query's shuffle files when it has ended
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, codec: str = "snappy", by: str | None = None) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back (``by``: a folder for each of its values).

    Cuts the lineage at a table every executor can reread, and gives later
    joins a plain scan, whose skewed shuffle partitions AQE can split. The shuffle
    files of this step go as it ends, so that the steps of a query don't add up on disk.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`staged` that no later step reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_value(spark: SparkSession, value) -> Callable[[], object]:
    """Broadcast ``value`` pickled with this package's classes by value; the function returned gives it to a task.

    A plain broadcast names classes by their module, which executors need not have.
    """
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    ready: list = []

    def get():
        if not ready:
            ready.append(cloudpickle.loads(shared.value))
        return ready[0]
    return get


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: T.StructType) -> DataFrame:
    """Apply ``fn`` to each Arrow batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out
    prepare_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column with nulls as empty strings."""
    return [x if x is not None else "" for x in column(batch, name).to_pylist()]


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def field(df: DataFrame, name: str) -> T.StructField:
    f = df.schema[name]
    return T.StructField(name, f.dataType, True)
