"""Catalog tables, CSV and Parquet files, literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: words that a CSV reader takes as a missing value -------------------------

NULL_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "N/A", "NA",
    "NULL", "NaN", "n/a", "nan", "null",
]


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Scan of a catalog table; stays distributed."""
    return spark.read.table(name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header row; missing-value words become NULL in every column.

    Fields are read as text first: a word such as ``nan`` would otherwise turn into a double NaN.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    df = spark.read.schema(text).option("header", True).option("escape", '"').csv(path)
    return df.select([
        F.when(~F.col(f.name).isin(NULL_WORDS), F.col(f.name)).try_cast(f.dataType).alias(f.name)
        for f in schema
    ])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row, replacing what is there; one file per task."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_stage_table(df: DataFrame, path: str) -> None:
    """Stage hand-off in Parquet, replacing what is there."""
    df.write.mode("overwrite").parquet(path)


def literal_rows(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """A few literal rows as a frame with a declared schema."""
    return spark.createDataFrame(rows, schema)


def first_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """At most ``n`` rows, the same ones on every run because the order is given."""
    return df.orderBy(*order).limit(n)
