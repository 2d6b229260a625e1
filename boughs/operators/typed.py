"""Operators over typed columns. Each takes and gives a DataFrame whose rows have a position."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from boughs.functions import Native
from boughs.plans.paths import Depth, compile_path, list_prefix, quoted, replaced, step, Found
from boughs.session import ship_code

from .order import POS

Cursor = Depth | list[Depth] | None


def fields(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != POS]


def record_type(df: DataFrame) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != POS])


def record(df: DataFrame) -> Column:
    return F.struct(*[F.col(quoted(c)) for c in fields(df)])


def at(df: DataFrame, path: Depth, cross_lists: bool = True) -> Column:
    return compile_path(record_type(df), path, cross_lists).col


def arguments(df: DataFrame, cursor: Cursor) -> list[Column]:
    """What a native function gets, lists not crossed."""
    if cursor is None:
        return [record(df)]
    return [at(df, p, False) for p in (cursor if isinstance(cursor, list) else [cursor])]


def write(df: DataFrame, path: Depth, value: Column, overwrite: bool = False) -> DataFrame:
    """A value at a path; only the top field that holds it is rebuilt."""
    kind = next((f.dataType for f in df.schema.fields if f.name == path[0]), None)
    if len(path) == 1:
        return df.withColumn(path[0], value)
    if isinstance(kind, T.ArrayType) and not overwrite:
        raise ValueError(f"{path[0]} is a list; pass overwrite=True to lose it")
    below = kind if isinstance(kind, T.StructType) else None
    return df.withColumn(path[0], replaced(below, F.col(quoted(path[0])) if below else None, path[1:], value, overwrite))


def null_at(df: DataFrame, cursor: Cursor) -> Column:
    """isna over the projection: a list of several paths, and a record, is never null."""
    return F.lit(False) if cursor is None or isinstance(cursor, list) else at(df, cursor, False).isNull()


def is_boolean(df: DataFrame, col: Column) -> bool:
    return isinstance(df.select(col.alias("x")).schema["x"].dataType, T.BooleanType)


def shallow(df: DataFrame, cursor: Cursor, func: Native | Column, overwrite: bool = False) -> DataFrame:
    """Filter by a boolean column; write any other at the projection. Null counts as false."""
    value = func if isinstance(func, Column) else func(*arguments(df, cursor))
    if isinstance(value, list | tuple):
        for path, v in zip(cursor, value, strict=True):
            df = write(df, path, v, overwrite)
        return df
    if is_boolean(df, value):
        return df.where(value)
    if cursor is None:
        kind = df.select(value.alias("x")).schema["x"].dataType
        if not isinstance(kind, T.StructType):
            return df.select(POS, value.alias("value"))
        return df.select(POS, value.alias("__r")).select(POS, *[F.col(f"__r.{quoted(f.name)}") for f in kind.fields])
    if isinstance(cursor, list):
        raise TypeError("over several paths a native function gives a list of columns, or a boolean one")
    return write(df, cursor, value, overwrite)


def keep_or_map(df: DataFrame, cursor: Depth, keep: Column, value: Column, overwrite: bool = False) -> DataFrame:
    """Both at once: rows where ``keep`` is false go, and ``value`` is written where it isn't null in the others."""
    df = df.where(F.coalesce(keep, F.lit(True)))
    return write(df, cursor, F.coalesce(value, at(df, cursor, False)), overwrite)


def negated(df: DataFrame, cursor: Cursor, func: Native | Column) -> DataFrame:
    """Rows where the function isn't true; null isn't."""
    value = func if isinstance(func, Column) else func(*arguments(df, cursor))
    kind = df.select(value.alias("x")).schema["x"].dataType
    if isinstance(kind, T.StringType):
        true = value != ""
    elif isinstance(kind, T.NumericType):
        true = value != 0
    elif isinstance(kind, T.ArrayType | T.MapType):
        true = F.size(value) > 0
    else:
        true = value if isinstance(kind, T.BooleanType) else value.isNotNull()
    return df.where(~F.coalesce(true, F.lit(False)))


def deep(df: DataFrame, rules: dict[type, Callable[[Column], Column]]) -> DataFrame:
    """Rewrite every leaf whose type is among the rules, at any depth; a boolean result keeps the leaf or nulls it."""

    def leaf(col: Column, kind: T.DataType) -> Column:
        rule = next((r for t, r in rules.items() if isinstance(kind, t)), None)
        if rule is None:
            return col
        out = rule(col)
        return F.when(out, col) if is_boolean(df.sparkSession.createDataFrame([], T.StructType([T.StructField("x", kind)])), rule(F.col("x"))) else out

    def walk(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(col.isNotNull(), F.struct(*[walk(col.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(col, lambda x: walk(x, kind.elementType))
        return leaf(col, kind)

    return df.select(POS, *[walk(F.col(quoted(f.name)), f.dataType).alias(f.name) for f in record_type(df).fields])


def prune(df: DataFrame, spec: dict) -> DataFrame:
    """Only the named fields, null where there are none."""

    def cut(found: Found, names: dict) -> Column:
        parts = []
        for k, below in names.items():
            inner = step(found, (k,), False)
            parts.append((cut(inner, below) if isinstance(below, dict) else inner.col).alias(k))
        return F.struct(*parts)

    out = []
    for k, below in spec.items():
        found = compile_path(record_type(df), (k,), False)
        out.append((cut(found, below) if isinstance(below, dict) else found.col).alias(k))
    return df.select(POS, *out)


def paths(df: DataFrame, wanted: Sequence[Depth]) -> DataFrame:
    """The values by the last names, at the place of the first of equal names, with the value of the last."""
    cols: dict[str, Column] = {}
    for p in wanted:
        cols[p[-1]] = at(df, p)
    return df.select(POS, *[c.alias(n) for n, c in cols.items()])


def members(df: DataFrame) -> Column:
    """The records of a group in order. The comparison looks at positions alone, as records needn't be comparable."""
    rows = F.collect_list(F.struct(F.col(POS).alias("p"), record(df).alias("r")))
    ordered = F.array_sort(rows, lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0))
    return F.transform(ordered, lambda x: x["r"])


def group(df: DataFrame, cursor: Cursor, target: str, recurse: bool = False) -> DataFrame:
    """Groups with their records below ``target``, first seen first; a path through a list groups inside it."""
    if cursor is None:
        return df.agg(members(df).alias(target)).select(F.lit(0).cast("long").alias(POS), F.lit(None).cast("string").alias("group"), target)
    if not isinstance(cursor, list) and (n := list_prefix(record_type(df), cursor)) is not None:
        return group_inside(df, cursor, n, target, recurse)
    several = isinstance(cursor, list)
    keys = {f"__k{i}": (p[-1], at(df, p)) for i, p in enumerate(cursor if several else [cursor])}
    grouped = df.withColumns({k: c for k, (_, c) in keys.items()}).groupBy(*keys).agg(F.min(POS).alias(POS), members(df).alias("__m"))
    named = {target: F.col("__m")} | {n: F.col(k) for k, (n, _) in keys.items()} if several else {n: F.col(k) for k, (n, _) in keys.items()} | {target: F.col("__m")}
    return grouped.select(POS, *[c.alias(n) for n, c in named.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def binned(items: Column, key: Callable[[Column], Column], name: str, target: str) -> Column:
    """The items of a list in groups, first seen first: one sort of (key, place), then a slice for each group."""

    def cut(ranked: Column) -> Column:
        n = F.size(ranked)
        new = lambda j: (j == 1) | ~ranked[j - 1]["k"].eqNullSafe(ranked[j - 2]["k"])
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda j: (j <= n) & new(j))

        def groups(at: Column) -> Column:
            end = lambda g: F.coalesce(F.get(at, g + 1), n + 1)
            spans = F.array_sort(F.transform(at, lambda j, g: F.struct(ranked[j - 1]["i"].alias("i"), j.alias("from"), (end(g) - j).alias("n"))))
            held = lambda s: F.transform(F.slice(ranked, s["from"], s["n"]), lambda r: items[r["i"]])
            return F.transform(spans, lambda s: F.struct(ranked[s["from"] - 1]["k"].alias(name), held(s).alias(target)))

        return let(starts, groups)

    return let(F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))), cut)


def group_inside(df: DataFrame, path: Depth, n: int, target: str, recurse: bool) -> DataFrame:
    """Regroup the list that ``n`` names lead to, in place and without a shuffle."""
    found = compile_path(record_type(df), path[:n])

    def grouped(items: Column, element: T.DataType, rest: Depth) -> Column:
        if recurse and isinstance(element, T.StructType) and (deeper := list_prefix(element, rest)) is not None:
            below = step(Found(F.lit(None).cast(element), element), rest[:deeper])

            def regroup(x: Column) -> Column:
                inner = step(Found(x, element), rest[:deeper])
                return replaced(element, x, rest[:deeper], grouped(inner.col, below.kind.elementType, rest[deeper:]))

            return F.transform(items, regroup)
        key = lambda x: step(Found(x, element), rest).col
        return binned(items, key, rest[-1], target)

    return write(df, path[:n], F.when(found.col.isNotNull(), grouped(found.col, found.kind.elementType, path[n:])))


def summarize(df: DataFrame, cursor: Cursor, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates of groups without their records: partial sums before the shuffle, nothing collected."""
    several = cursor if isinstance(cursor, list) else [] if cursor is None else [cursor]
    keys = [at(df, p).alias(p[-1]) for p in several]
    return df.groupBy(*keys).agg(F.min(POS).alias(POS), *[c.alias(n) for n, c in aggregates.items()])


#: Groups whose states a task holds before it passes them on.
STATES = 100_000


def fold(df: DataFrame, cursor: Cursor, of: Depth, zero: Callable, step: Callable, merge: Callable, finish: Callable, returns: str, name: str) -> DataFrame:
    """Python aggregates: states by task, merged by key. A key has a row for each task, or for STATES groups of it, at most."""
    ship_code(df.sparkSession)
    several = cursor if isinstance(cursor, list) else [] if cursor is None else [cursor]
    keys = [f"__k{i}" for i in range(len(several))]
    rows = df.select(*[at(df, p).alias(k) for k, p in zip(keys, several, strict=True)], at(df, of, False).alias("__v"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    made = rows.select(F.lit(None).cast(returns).alias(name)).schema[name].dataType

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str, list] = {}
        schema = None

        def passed() -> pa.RecordBatch:
            found = list(states.values())
            columns = [pa.array([f[0][i] for f in found], schema.field(i).type) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(f[1]) for f in found], pa.binary())], names=[*keys, "__state"])

        for batch in batches:
            schema = batch.schema
            values = [c.to_pylist() for c in batch.columns]
            for *key, value in zip(*values, strict=True):
                code = repr(key)
                if code not in states:
                    states[code] = [key, zero()]
                states[code][1] = step(states[code][1], value)
            if len(states) > STATES:
                yield passed()
                states.clear()
        if states:
            yield passed()

    def merged(table: pa.Table) -> pa.Table:
        state, *rest = map(pickle.loads, table.column("__state").to_pylist())
        for other in rest:
            state = merge(state, other)
        first = table.slice(0, 1)
        return pa.Table.from_arrays([*[first.column(k) for k in keys], pa.array([finish(state)], to_arrow_type(made))], names=[*keys, name])

    kinds = kinds + ", " if kinds else ""
    found = rows.mapInArrow(partial, f"{kinds}__state binary").groupBy(*keys).applyInArrow(merged, f"{kinds}`{name}` {returns}")
    pos = F.struct(*keys) if keys else F.lit(0)
    return found.select(pos.alias(POS), *[F.col(k).alias(p[-1]) for k, p in zip(keys, several, strict=True)], name)


def _all_null(col: Column, kind: T.DataType) -> Column:
    return col.isNull() | (F.forall(col, lambda x: x.isNull()) if isinstance(kind, T.ArrayType) else F.lit(False))


def aggregate(df: DataFrame, cursor: Cursor) -> DataFrame:
    """One record with all values at the path, before the records that have none.

    The record has that path alone; as fields are columns, the others are null in it.
    Over several paths each value is a list: of VARIANT where their types differ.
    """
    if cursor is None:
        return df
    if isinstance(cursor, list):
        found = [compile_path(record_type(df), p, False) for p in cursor]
        none = reduce(lambda a, b: a & b, [f.col.isNull() for f in found])
        # A list of values holds one type: that of all, or VARIANT.
        alike = all(f.kind == found[0].kind for f in found)
        value = F.array(*[f.col if alike else as_variant(f.col, f.kind) for f in found])
        path: Depth = ("aggregated",)
        rest = df.where(none)
    else:
        one = compile_path(record_type(df), cursor, False)
        none, value, path = _all_null(one.col, one.kind), one.col, cursor
        rest = df.where(none)
        if len(cursor) == 1:
            rest = rest.drop(cursor[0])
        elif one.kind != T.NullType():
            rest = rest.withColumn(cursor[0], F.col(quoted(cursor[0])).dropFields(".".join(map(quoted, cursor[1:])))) if _siblings(df, cursor) else rest.drop(cursor[0])
    rows = F.array_sort(F.collect_list(F.struct(F.col(POS).alias("p"), value.alias("v"))), lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0))
    made = df.where(~none).agg(F.transform(rows, lambda x: x["v"]).alias("__a")).where(F.size("__a") > 0)
    nested = F.col("__a")
    for name in reversed(path[1:]):
        nested = F.struct(nested.alias(name))
    return made.select(before(df).alias(POS), nested.alias(path[0])).unionByName(rest.withColumn(POS, after()), allowMissingColumns=True)


def before(df: DataFrame) -> Column:
    """A position before all of ``df``, whatever orders it; the others take ``after``."""
    return F.struct(F.lit(0).alias("side"), F.lit(None).cast(df.schema[POS].dataType).alias("pos"))


def after() -> Column:
    return F.struct(F.lit(1).alias("side"), F.col(POS).alias("pos"))


def as_variant(col: Column, kind: T.DataType) -> Column:
    return F.to_variant_object(col) if isinstance(kind, T.StructType | T.ArrayType | T.MapType) else col.cast("variant")


def _siblings(df: DataFrame, path: Depth) -> bool:
    """Whether something is left of the top field once the path is gone."""
    kind: T.DataType = record_type(df)
    for name in path[:-1]:
        kind = next(f.dataType for f in kind.fields if f.name == name)
        if len(kind.fields) > 1:
            return True
    return False


def explode(df: DataFrame, cursor: list[Depth]) -> DataFrame:
    """One row for each item of the first path that is a list; no row for an empty list, one for null."""
    found = [compile_path(record_type(df), p) for p in cursor]
    which = next((i for i, f in enumerate(found) if isinstance(f.kind, T.ArrayType)), None)
    cols = [f.col.alias(p[-1]) for f, p in zip(found, cursor, strict=True)]
    if which is not None:
        f = found[which]
        # Null stays a row, and an empty list gives none: neither explode nor explode_outer does both.
        cols[which] = F.explode(F.when(f.col.isNull(), F.array(F.lit(None).cast(f.kind.elementType))).otherwise(f.col)).alias(cursor[which][-1])
    return df.select(POS, *cols)
