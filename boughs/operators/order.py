"""Places of rows in an order, without sorting all rows in one task and without a job before the query runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boughs.plans.paths import quoted

POS = "__pos"
#: Places up to this one, from either end, are found by a top-k; all rows are numbered for places beyond.
TOP = 100_000
#: A range of positions is to hold about so many bytes of what Spark expects the rows to have; ranges are a square number.
RANGE_BYTES, FEWEST, MOST = 64 << 20, 8, 64
#: What Spark's error says for a place that isn't there; collecting turns it into an IndexError.
NO_PLACE = "no row at place "


def _side(df: DataFrame) -> int:
    """The root of the number of ranges, from the plan's own estimate of its size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST, max(FEWEST, int((size / RANGE_BYTES) ** 0.5) + 1))


def dense(df: DataFrame, out: str = "__rn", pos: str = POS, total: str | None = None) -> DataFrame:
    """Number rows from 0 in the order of ``pos``, nulls first; ``total``: a column for the number of all rows.

    A bounded sample of positions cuts the order into ranges; rows are numbered
    within their range, and ranges start where the counts of those before end.
    Equal positions are numbered in an order that isn't defined.
    """
    side = _side(df)
    # One row: up to side * side bounds, and each side-th of them. Which positions are drawn depends on their values alone.
    drawn = df.select(F.col(pos).alias("__b")).where(F.col(pos).isNotNull()).orderBy(F.xxhash64("__b"), "__b").limit(side * side - 1)
    bounds = drawn.agg(F.sort_array(F.collect_set("__b")).alias("__fine"))
    coarse = F.filter("__fine", lambda b, i: i % side == side - 1)
    bounds = bounds.select("__fine", coarse.alias("__coarse"))
    before = lambda array: F.size(F.filter(array, lambda b: b <= F.col(pos)))
    keyed = df.crossJoin(F.broadcast(bounds)).withColumn("__c", before(F.col("__coarse")))
    part = F.col("__c") * side + before(F.slice("__fine", F.col("__c") * side + 1, F.lit(side)))
    keyed = keyed.withColumn("__range", F.when(F.col(pos).isNull(), -1).otherwise(part)).drop("__fine", "__coarse", "__c")
    counts = keyed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # One row for each range.
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__range", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy()).alias("__total"))
    local = F.row_number().over(Window.partitionBy("__range").orderBy(pos)) - 1
    found = keyed.join(F.broadcast(starts), "__range").withColumn(out, (F.col("__start") + local).cast("long"))
    return (found.withColumnRenamed("__total", total) if total else found.drop("__total")).drop("__range", "__start")


def _few(*places: int | None) -> bool:
    return all(p is None or abs(p) <= TOP for p in places)


def sliced(df: DataFrame, rows: slice) -> DataFrame:
    """Rows of a Python slice. Where both ends are near one end of the order it is a top-k; else places are needed."""
    start, stop, step = rows.start, rows.stop, 1 if rows.step is None else rows.step
    if step == 0:
        raise ValueError("slice step cannot be zero")
    first = start or 0
    if step > 0 and first == 0 and stop is None and step == 1:
        return df
    if step > 0 and first >= 0 and stop is not None and stop >= 0 and _few(stop):
        if stop <= first:
            return df.limit(0)
        top = df.orderBy(POS).limit(stop)
        if step == 1:
            return top.offset(first) if first else top
        # At most TOP rows are numbered in one task.
        place = F.row_number().over(Window.orderBy(POS)) - 1
        return top.withColumn("__rn", place).where((F.col("__rn") >= first) & ((F.col("__rn") - first) % step == 0)).drop("__rn")
    if step == 1 and first < 0 and (stop is None or stop < 0) and _few(first):
        if stop is not None and stop <= first:
            return df.limit(0)
        last = df.orderBy(F.desc(POS)).limit(-first)
        return last.offset(-stop) if stop else last
    numbered = dense(df, total="__all")
    rn, n = F.col("__rn"), F.col("__all")
    if step > 0:
        low = F.lit(first) if first >= 0 else F.greatest(n + first, F.lit(0))
        high = n if stop is None else F.lit(stop) if stop >= 0 else n + stop
        hit = (rn >= low) & (rn < high) & ((rn - low) % step == 0)
        return numbered.where(hit).drop("__rn", "__all")
    high = n - 1 if start is None else F.least(F.lit(start), n - 1) if start >= 0 else n + start
    low = F.lit(-1) if stop is None else F.lit(stop) if stop >= 0 else n + stop
    hit = (rn <= high) & (rn > low) & ((high - rn) % -step == 0)
    return numbered.where(hit).withColumn(POS, -rn).drop("__rn", "__all")


def gathered(df: DataFrame, places: list[int]) -> DataFrame:
    """Rows at the places, in their order, as often as they are named.

    A place that isn't there is an error once the query runs, an IndexError where
    the rows are collected.
    """
    if not places:
        return df.limit(0)
    asked = [(p, i) for i, p in enumerate(places)]
    if not _few(*places):
        return _picked(dense(df, total="__all"), asked, lambda p, n: F.lit(p) if p >= 0 else n + p)
    front, back = [x for x in asked if x[0] >= 0], [x for x in asked if x[0] < 0]
    out = []
    for wanted, order in ((front, F.asc(POS)), (back, F.desc(POS))):
        if wanted:
            place = lambda p: p if p >= 0 else -p - 1
            top = df.orderBy(order).limit(max(place(p) for p, _ in wanted) + 1)
            numbered = top.withColumn("__rn", (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))
            out.append(_picked(numbered, wanted, lambda p, _: F.lit(place(p))))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _picked(numbered: DataFrame, asked: list[tuple[int, int]], place: Callable[[int, Column], Column]) -> DataFrame:
    """Numbered rows at the asked places: one row packs them, at most one for each place, so that what is missing is seen."""
    fields = [c for c in numbered.columns if c not in ("__rn", "__all")]
    n = F.col("__all") if "__all" in numbered.columns else F.lit(0)
    wanted = F.array(*[place(p, n).cast("long") for p in sorted({p for p, _ in asked})])
    row = F.when(F.array_contains(wanted, F.col("__rn")), F.struct("__rn", *[F.col(quoted(c)) for c in fields]))
    packed = numbered.agg(F.collect_list(row).alias("__rows"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("__all"))
    n = F.col("__all")
    orders = F.array(*[F.struct(place(p, n).cast("long").alias("rn"), F.lit(i).cast("long").alias("i"), F.lit(p).cast("long").alias("p")) for p, i in asked])
    each = packed.select("__rows", F.explode(orders).alias("__o"))
    found = F.filter("__rows", lambda r: r["__rn"] == F.col("__o.rn"))
    there = F.when(F.size(found) == 0, F.raise_error(F.concat(F.lit(NO_PLACE), F.col("__o.p").cast("string")))).otherwise(F.lit(True))
    hit = each.where(there).select(F.col("__o.i").alias("__i"), found[0].alias("__r"))
    return hit.select(*[F.col("__i").alias(POS) if c == POS else F.col(f"__r.{quoted(c)}").alias(c) for c in fields])


def descending(col: Column, kind: T.DataType) -> Column:
    """A value whose ascending order is the descending one of ``col``, nulls last."""
    if isinstance(kind, T.IntegralType):
        turned = F.bitwise_not(col)
    elif isinstance(kind, T.FractionalType):
        turned = F.struct(~F.isnan(col.cast("double")), -col)
    elif isinstance(kind, T.DateType):
        turned = F.bitwise_not(F.unix_date(col))
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        turned = F.bitwise_not(F.unix_micros(col.cast("timestamp")))
    elif isinstance(kind, T.BooleanType):
        turned = ~col
    elif isinstance(kind, T.StringType):
        # Each half byte's complement, and an end that comes after all of them, as a text comes after those it starts with.
        turned = F.concat(F.translate(F.hex(F.encode(col, "utf-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    else:
        raise TypeError(f"no descending order for {kind.simpleString()}")
    return F.struct(col.isNull().alias("none"), turned.alias("turned"))


def beside(left: DataFrame, right: DataFrame, value: Column, out: str) -> DataFrame:
    """The left rows with the value of the right row at the same place, as far as both go."""
    other = dense(right.select(POS, value.alias(out))).select(F.col("__rn").alias("__ro"), out)
    return dense(left).join(other, F.col("__rn") == F.col("__ro")).drop("__rn", "__ro")
