"""CSV result sink.

Written by the executors (one file per partition), never through the
driver.  Map, array and struct columns cannot be stored in CSV, so they are
written as JSON text.  ``single_file`` coalesces to one task and is meant
for small results only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPLEX = (T.MapType, T.ArrayType, T.StructType)


def csv_ready(df: DataFrame) -> DataFrame:
    """Turn complex columns into JSON strings (vectors into arrays first)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "vector" or type(f.dataType).__name__ == "VectorUDT":
            from pyspark.ml.functions import vector_to_array
            c = F.to_json(vector_to_array(c))
        elif isinstance(f.dataType, _COMPLEX):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    out = csv_ready(df)
    if single_file:
        out = out.coalesce(1)
    out.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_csv(spark, path: str, schema) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
