"""Trees over streams.

Projections, filters, maps, assignments, pruning and groups inside lists are
stateless and run under Structured Streaming as they are. Groups of records need
state, which a watermark bounds; see windowed(). What depends on a record's place
(slices, places, positional paths) has no meaning on an endless stream.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boughs.core import DataBranch, DataTree, _Base
from boughs.operators import typed
from boughs.operators.order import POS
from boughs.operators.records import DOC
from boughs.plans import variants
from boughs.plans.schema import Schema, decode, encode
from boughs.session import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the storage that all executors share; a local master needs none, and takes a temporary one."""
    shared = shared_folder(spark)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, folder: str, glob: str, schema: T.StructType, order_by: str) -> DataTree:
    """A tree over the Parquet files of a folder, those there now and those to come."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return DataTree._of(rows.withColumn(POS, F.col(order_by)))


def json_lines(spark: SparkSession, folder: str, order_by: str | None = None) -> DataTree:
    """A tree over text files with a JSON object a line. ``order_by``: a field that orders the records."""
    lines = spark.readStream.text(folder).where(F.col("value").startswith("{"))
    pos = F.get_json_object("value", f"$.{order_by}").cast("long") if order_by else F.lit(0).cast("long")
    return DataTree._of(lines.select(pos.alias(POS), F.col("value").alias(DOC)))


def write(branch: _Base, path: str, checkpoint: str, **trigger):
    """Append a stateless branch's rows to Parquet files; ``trigger`` as for Spark, by default all there is, once."""
    out = branch.to_df().writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def run_once(branch: _Base, name: str) -> DataFrame:
    """All that is there now, through the stream and read back."""
    spark = branch.spark
    folder = _folder(spark, name)
    write(branch, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.schema(branch.to_df().schema).parquet(f"{folder}/rows")


def windowed(branch: DataBranch, time: str, width: str, aggregates: dict[str, Column], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Aggregates by time window and projection: start, the projected names, and the aggregates.

    Records that come later than ``late`` after the newest are dropped, so the
    state is that of the windows which are still open.
    """
    cursor = branch.cursor
    paths = cursor if isinstance(cursor, list) else [] if cursor is None else [cursor]
    keys = [typed.at(branch.df, p).alias(p[-1]) for p in paths]
    rows = branch.df.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    grouped = rows.groupBy(F.window("__time", width, slide), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(F.col("window.start").alias("start"), *[p[-1] for p in paths], *aggregates)


def run_complete(counted: DataFrame, spark: SparkSession) -> DataFrame:
    """The whole state after all that is there now: the last table of a stream in complete mode."""
    folder = _folder(spark, "stream-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    stream = counted.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{folder}/rows")


class SchemaLog:
    """The schema variants of a stream of records, folded batch by batch.

    Give ``update`` to foreachBatch. The state is the variants' codes, one short
    text for each, which ``dump`` and ``load`` carry over a restart.
    """

    def __init__(self, warn: Callable[[str], None] | None = None):
        self.schemas: dict[int, Schema] = {}
        self.warn = warn

    def update(self, batch: DataFrame, number: int = 0) -> None:
        rows = variants.shapes(batch).groupBy("shape").agg(F.min(POS).alias("first")).orderBy("first").select("shape")
        for row in rows.toLocalIterator():
            _, several = variants.fold(self.schemas, variants.shape_of(row[0]))
            if several and self.warn:
                self.warn(f"batch {number}: a shape fits several schemas: {variants.shape_of(row[0])}")

    def dump(self) -> str:
        return json.dumps([encode(s) for s in self.schemas.values()])

    def load(self, text: str) -> None:
        self.schemas = dict(enumerate(map(decode, json.loads(text))))
