"""Records that the driver holds or generates."""

from __future__ import annotations

import json
from collections.abc import Iterable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

from boughs.operators.order import POS
from boughs.operators.records import DOC

#: An iterator is taken in parts of so many records, so the driver never holds more.
PART = 50_000
KIND = f"{POS} long, {DOC} string"


def read(items: Iterable[dict], spark: SparkSession | None = None, folder: str | None = None) -> DataFrame:
    """(position, JSON) rows. A list is sent to Spark at once.

    An iterator is read once, in parts; with a ``folder`` in shared storage each
    part is written there first, so an iterator of any length will do.
    """
    spark = spark or SparkSession.active()
    if isinstance(items, list | tuple):
        for r in items:
            if not isinstance(r, dict):
                raise ValueError("records have to be dicts")
        return spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False, default=str)) for i, r in enumerate(items)], KIND)
    numbered, start, whole = iter(items), 0, []
    while part := list(islice(numbered, PART)):
        df = read(part, spark).selectExpr(f"{POS} + {start} as {POS}", DOC)
        start += len(part)
        if folder:
            df.write.mode("append").parquet(folder)
        else:
            whole.append(df)
    if folder and start:
        return spark.read.schema(KIND).parquet(folder)
    out = spark.createDataFrame([], KIND)
    for df in whole:
        out = out.unionByName(df)
    return out
