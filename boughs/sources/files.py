"""Records in files: a JSON record a line, as text, so that Spark never guesses at types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boughs.core import DataTree
from boughs.operators.order import POS
from boughs.operators.records import DOC


def json_lines(spark: SparkSession, path: str) -> DataTree:
    """Records in the order of the files' names and of their lines.

    Lines that aren't JSON objects, and blank ones, are left out; see rejected().
    """
    lines = _lines(spark, path)
    # Spark deals large splits first, so ids alone aren't in the order of the files; within a split they go as its lines.
    pos = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return DataTree._of(lines.where(_is_object()).select(pos.alias(POS), F.col("value").alias(DOC)))


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """The lines that json_lines leaves out."""
    return _lines(spark, path).where(~_is_object())


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def _is_object():
    return F.coalesce(F.get_json_object("value", "$").startswith("{"), F.lit(False))


def json_column(df: DataFrame, column: str, order_by: str | None = None) -> DataTree:
    """A tree of the JSON objects in a column; null and other values are left out."""
    pos = F.col(order_by) if order_by else F.monotonically_increasing_id()
    return DataTree._of(df.where(F.col(column).startswith("{")).select(pos.alias(POS), F.col(column).alias(DOC)))
