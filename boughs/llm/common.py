"""Helpers the corpus operators share: written intermediates, sizes and prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boughs.session import shared_folder, ship_code

#: Java and Python regular expressions agree on this class: blank, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

#: Spark deletes the shuffle files of a query once it has ended. What is written isn't run again, so it needs none.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stash:
    """Intermediates written as Parquet in the shared folder, which survive lost executors.

    ``drop`` deletes what later steps no longer read. What a result still reads
    stays until the application ends, or ``clear`` is called.
    """

    _open: dict[str, SparkSession] = {}

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        Stash._open[self.root] = spark

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")

    @classmethod
    def clear(cls) -> None:
        """Delete all intermediates of this application. Results that read them must have been written before."""
        for root, spark in list(cls._open.items()):
            # A session that has been stopped can't delete any more.
            with contextlib.suppress(Exception):
                _delete(spark, root)
            cls._open.pop(root, None)


atexit.register(Stash.clear)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blocks_for(df: DataFrame, text: str = "text", block_bytes: int = 8 << 20) -> int:
    """Blocks of about ``block_bytes`` of text; at least the session's shuffle partitions."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // block_bytes))


def numbered(df: DataFrame, group: list[str], order: list[Column], fine: Column, out: str) -> DataFrame:
    """Number the rows of each group from 0, gapless, by (``fine``, ``order``).

    A group may hold a third of all rows, so no task sorts a whole one: rows are
    numbered within (group, fine), and a running sum over the counts of the few
    values of ``fine`` moves each part to its place. ``fine`` has to be a short,
    even key such as a hash prefix.
    """
    keyed = df.withColumn("__fine", fine)
    keys = [*group, "__fine"]
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__fine").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    local = keyed.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"__s{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return local.join(starts, on).withColumn(out, F.col("__start") + F.col("__row") - 1).drop("__start", "__row", "__fine", *[f"__s{i}" for i in range(len(keys))])


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Ready a session for operators in Python: whole texts go there, so an Arrow batch must hold few of them.

    Spark reads the setting when a result is computed, which is later, so it stays; a smaller one is left as it is.
    """
    ship_code(spark)
    now = int(spark.conf.get(BATCH))
    if now <= 0 or now > rows:
        spark.conf.set(BATCH, str(rows))
