"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source_size`` copies. The expected
copies are summed up along the source, one random offset is added, and a document
is emitted once for every integer the sum crosses on it.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Stash, numbered, text_or_empty

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn. ``share`` of all
    sizes is dealt by weight; a target stops at ``cap`` times its source's size
    and the excess goes to the others, again by weight. That is filling vessels
    to one common level: in order of cap per weight a source is full exactly if
    what is left for it and those after it would raise it over its cap.
    """
    everything = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = (F.row_number().over(everything) - 1) % len(weights)
    w = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    w = w.withColumn("__cap", cap * F.col("source_size").cast("double"))
    by_level = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = Window.partitionBy()
    left = share * F.sum("source_size").over(total) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    w = w.withColumn("__level", left / F.sum("__w").over(onward)).withColumn("__full", F.col("__level") * F.col("__w") >= F.col("__cap"))
    # The first source that isn't full sets the level of all that follow, where it only falls.
    level = F.max(F.when(~F.col("__full"), F.col("__level"))).over(total)
    target = F.when(F.col("__full"), F.col("__cap")).otherwise(F.least(level * F.col("__w"), F.col("__cap")))
    return w.withColumn("target", target).select("source", "source_size", "target")


def size_class(size: Column) -> Column:
    """A short text that sorts as the size does, in eight steps a doubling."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.rpad(F.substring(bits, 1, 4), 4, "0"))


def _fraction(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 12), 16, 10).cast("double") / float(16**12)


def copies(sized: DataFrame, targets: DataFrame, seed: int = 0, cap: float = MOST_COPIES) -> DataFrame:
    """Add source_size, target and copies, at most ``cap`` rounded up, to rows of (doc_id, source, size, ...).

    Documents line up by size class, then by a hash of their id: neighbours in
    the sum are of similar size, so the words taken stay near the target, and no
    task sorts a whole source.
    """
    named = targets.select(F.col("source").alias("__source"), "source_size", "target")
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"/{seed}")))
    fine = F.concat(size_class(F.col("size")), F.substring(digest, 1, 2))
    rows = numbered(rows, ["source"], [digest, F.col("size"), *[F.col(c) for c in sized.columns if c.startswith("__tie")]], fine, "__rank")
    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    start = _fraction(F.concat(F.coalesce(F.col("source"), F.lit("\x00")), F.lit(f"/{seed}")))
    crossed = F.floor(start + ratio * (F.col("__rank") + 1)) - F.floor(start + ratio * F.col("__rank"))
    return rows.withColumn("copies", F.least(crossed, F.lit(ceil(cap))).cast("long")).drop("__rank")


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, seed: int = 0, text: str = "text", cap: float = MOST_COPIES) -> DataFrame:
    """Per document doc_id, source, size, source_size, target and copies, without its text.

    Null text has size 0; a source without words has target 0 and no copies.
    Rows that repeat are documents of their own.
    """
    tie = F.xxhash64(text_or_empty(text)).alias("__tie")
    stash = Stash(docs.sparkSession, "mixing")
    sized = stash.keep(docs.select("doc_id", "source", word_count(text).alias("size"), tie), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return copies(sized, source_targets(sizes, weights, share, cap), seed, cap)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, seed: int = 0, text: str = "text", cap: float = MOST_COPIES) -> DataFrame:
    """The documents, each as often as the mix takes it, with all their columns.

    Rows that agree in doc_id, source and text are told apart by their turn, in
    the order of a hash of all their columns, so each gets the copies planned for
    one of them, the same in every run.
    """
    on = ["doc_id", "source", "__tie"]
    planned = plan(docs, weights, share, seed, text, cap).where("copies > 0")
    turn = Window.partitionBy(*on).orderBy(F.desc("copies"))
    planned = planned.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(on)], "copies", F.row_number().over(turn).alias("__pturn"))
    rest = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map" not in kind and "variant" not in kind])
    keyed = docs.withColumn("__tie", F.xxhash64(text_or_empty(text)))
    keyed = keyed.withColumn("__turn", F.row_number().over(Window.partitionBy(*on).orderBy(rest)))
    same = F.col("doc_id").eqNullSafe(F.col("__p0")) & F.col("source").eqNullSafe(F.col("__p1")) & (F.col("__tie") == F.col("__p2")) & (F.col("__turn") == F.col("__pturn"))
    joined = keyed.join(planned, same)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).drop("__copy")


def op9_sql() -> str:
    """The same over DuckDB; the excess is reshared in rounds there, by the words of the definition."""
    frac = lambda s: f"('0x' || substr(md5({s}), 1, 12))::BIGINT::DOUBLE / {16**12}.0"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 3.0 END::DOUBLE AS w FROM d GROUP BY source),
    fill AS (
        SELECT 0 AS round, source, source_size, w, false AS full_, 0.0::DOUBLE AS target FROM s
        UNION ALL
        SELECT round + 1, source, source_size, w, full_ OR share >= {MOST_COPIES} * source_size, CASE WHEN full_ OR share >= {MOST_COPIES} * source_size THEN {MOST_COPIES} * source_size::DOUBLE ELSE share END
        FROM (SELECT *, (sum(source_size) OVER () - coalesce(sum({MOST_COPIES} * source_size) FILTER (full_) OVER (), 0)) * w / nullif(sum(w) FILTER (NOT full_) OVER (), 0) AS share FROM fill)
        WHERE round < (SELECT count(*) FROM s)),
    t AS (SELECT source, source_size, target FROM fill WHERE round = (SELECT count(*) FROM s)),
    r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.target / nullif(t.source_size, 0) AS ratio,
        row_number() OVER (PARTITION BY d.source ORDER BY lpad(length(bin(d.size))::VARCHAR, 2, '0'), rpad(substr(bin(d.size), 1, 4), 4, '0'), md5(d.doc_id || '/0')) - 1 AS k,
        {frac("coalesce(d.source, chr(0)) || '/0'")} AS u
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, (size * coalesce(least(floor(u + ratio * (k + 1)) - floor(u + ratio * k), {MOST_COPIES}), 0))::BIGINT AS taken FROM r"""
