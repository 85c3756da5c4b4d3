"""Whitespace-separated text tables (vertex / edge files).

Format: any run of blanks or tabs separates fields, leading and trailing
blanks are ignored, the first line of each file is that file's header, blank
lines are skipped.  Columns are matched by name, so files may order them
differently.  A line with too few fields ends in NULLs, one with too many is an
error.  Missing-value words become NULL.  Column types are inferred
(bigint, then double, then boolean, else string) with one aggregation pass,
or taken from ``schema``.

Everything is distributed: lines are read by Spark's text source, split
with built-in string functions, and type inference is a single global
aggregate of per-column flags; of the headers only three come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words read as a missing value (the usual defaults of
# delimited-text readers).
MISSING_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                 "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                 "nan", "null"]
TRUE_WORDS = ["True", "true", "TRUE"]
FALSE_WORDS = ["False", "false", "FALSE"]

_BLANKS = r"[ \t]+"
# a cast alone would also take "1d" and "2f"
_INTEGER = r"^[+-]?[0-9]+\z"
_NUMBER = r"(?i)^[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity)\z"


#: a separator that no line holds: the CSV reader is used only to leave out
#: the first line of each file
_WHOLE_LINE = "\u0001\u0002\u0001"


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """``(file, header)``: the names on the first line that is not blank of every file.

    A file's first block lies in one partition and its lines keep their order,
    so the first line has the smallest running number.
    """
    lines = (spark.read.text(path)
             .select("value", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("at"))
             .where((F.col("at") == 0) & (F.trim(F.regexp_replace("value", _BLANKS, " ")) != ""))
             .withColumn("n", F.monotonically_increasing_id()))
    first = lines.groupBy("file").agg(F.min_by("value", "n").alias("value"))
    return first.select("file", F.split(F.trim(F.regexp_replace("value", _BLANKS, " ")), " ").alias("header"))


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Column names, in the order of the first file's header; every file must have the same set.

    One aggregate over the headers of all files: they are the same set when the smallest and the
    largest sorted header are equal.
    """
    headers = file_headers(spark, path).withColumn("names", F.array_sort("header"))
    r = headers.agg(F.min_by("header", "file").alias("header"), F.min("names").alias("low"), F.max("names").alias("high"),
                    F.min_by("file", "names").alias("low_file"), F.max_by("file", "names").alias("high_file")).first()
    if r["header"] is None:
        raise ValueError(f"no header line in {path}")
    if r["low"] != r["high"]:
        raise ValueError(f"header {r['high']} of {r['high_file']} does not match {r['low']} of {r['low_file']}")
    if len(set(r["low"])) != len(r["low"]):
        raise ValueError(f"header {r['low']} of {r['low_file']} has a name twice")
    return list(r["header"])


def _tokens(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """One string column per name. A line with more fields than its file's header is an error."""
    lines = (spark.read.schema("value string").option("header", True).option("enforceSchema", True)
             .option("sep", _WHOLE_LINE).option("quote", "").option("escape", "")
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
             .select("value", F.col("_metadata.file_path").alias("file")))
    norm = F.trim(F.regexp_replace(F.col("value"), _BLANKS, " "))
    parts = (lines.select(norm.alias("_line"), "file").where(F.col("_line") != "")
             .select(F.split("_line", " ").alias("_t"), "file")
             .join(file_headers(spark, path), "file"))
    too_many = F.raise_error(F.concat(F.lit("more fields than the header has: "), F.array_join("_t", " ")))
    checked = F.when(F.size("_t") > F.size("header"), too_many.cast("array<string>")).otherwise(F.col("_t"))
    parts = parts.select(checked.alias("_t"), "header")
    cols = []
    for n in names:
        tok = F.get(F.col("_t"), F.array_position("header", F.lit(n)).cast("int") - 1)
        cols.append(F.when(tok.isin(MISSING_WORDS), F.lit(None)).otherwise(tok).alias(n))
    return parts.select(*cols)


def _infer(raw: DataFrame, names: list[str]) -> dict[str, T.DataType]:
    flags = []
    for n in names:
        c = F.col(n)
        present = c.isNotNull()
        flags += [
            F.max(F.when(present & ~(c.rlike(_INTEGER) & c.try_cast("bigint").isNotNull()), 1)
                  .otherwise(0)).alias(f"{n}__nl"),
            F.max(F.when(present & ~(c.rlike(_NUMBER) & c.try_cast("double").isNotNull()), 1)
                  .otherwise(0)).alias(f"{n}__nd"),
            F.max(F.when(present & ~c.isin(TRUE_WORDS + FALSE_WORDS), 1).otherwise(0)).alias(f"{n}__nb"),
            F.max(F.when(present, 1).otherwise(0)).alias(f"{n}__any"),
        ]
    row = raw.agg(*flags).first()
    out = {}
    for n in names:
        if not row[f"{n}__any"]:
            out[n] = T.StringType()
        elif not row[f"{n}__nl"]:
            out[n] = T.LongType()
        elif not row[f"{n}__nd"]:
            out[n] = T.DoubleType()
        elif not row[f"{n}__nb"]:
            out[n] = T.BooleanType()
        else:
            out[n] = T.StringType()
    return out


def _cast(c, t: T.DataType):
    if isinstance(t, T.BooleanType):
        return F.when(c.isin(TRUE_WORDS), F.lit(True)).when(c.isin(FALSE_WORDS), F.lit(False))
    return c.cast(t)


def read_whitespace_table(spark: SparkSession, path: str,
                          schema: T.StructType | str | None = None) -> DataFrame:
    """Read whitespace-separated text with a header line into a DataFrame."""
    names = header_names(spark, path)
    raw = _tokens(spark, path, names)
    if schema is not None:
        st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        types = {f.name: f.dataType for f in st.fields}
        missing = [n for n in types if n not in names]
        if missing:
            raise ValueError(f"schema columns {missing} not in header {names}")
    else:
        types = _infer(raw, names)
    return raw.select(*[_cast(F.col(n), types.get(n, T.StringType())).alias(n) for n in names])


def write_whitespace_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``df`` as tab-separated text, one header line per part file."""
    (df.write.mode(mode).option("header", True).option("sep", "\t")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("quote", "\u0000").csv(path))
