"""Operators on records of any shape, as functions of one record; they run in Arrow batches over JSON.

This is the way for data whose records differ in kind, and for plain Python
callables. Fields are read natively where a query only projects (see core.py).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boughs.plans.paths import Depth
from boughs.session import ship_code

from .order import POS

DOC = "__doc"


def look(value: object, path: Depth, cross_lists: bool = True) -> object:
    """What is at a path. Lists on the way map the rest over their items, or end it."""
    for i, name in enumerate(path):
        if isinstance(value, list):
            return [look(item, path[i:]) for item in value] if cross_lists else None
        if not isinstance(value, dict):
            return None
        value = value.get(name)
    return value


def put(record: dict, path: Depth, value: object) -> dict:
    """A record with a value at a path. Dicts on the way are copied; anything else there gives way to one."""
    out = dict(record) if isinstance(record, dict) else {}
    out[path[0]] = put(out.get(path[0]), path[1:], value) if len(path) > 1 else value
    return out


def seen_by(record: dict, cursor: Depth | list[Depth] | None) -> object:
    """What a function over the projection gets: lists on the way aren't crossed."""
    if cursor is None:
        return record
    return [look(record, p, False) for p in cursor] if isinstance(cursor, list) else look(record, cursor, False)


def shallow(cursor: Depth | list[Depth] | None, func: Callable) -> Callable[[dict], Iterable]:
    """Keep the record for True, drop it for False, write anything else at the projection."""

    def op(record: dict) -> Iterable:
        result = func(seen_by(record, cursor))
        if isinstance(result, bool):
            return (record,) if result else ()
        if cursor is None:
            return (result,)
        if not isinstance(cursor, list):
            return (put(record, cursor, result),)
        for i, path in enumerate(cursor):
            record = put(record, path, result[i])
        return (record,)

    return op


def assign(cursor: Depth | list[Depth] | None, value: object) -> Callable[[dict], Iterable]:
    def op(record: dict) -> Iterable:
        for path in [] if cursor is None else cursor if isinstance(cursor, list) else [cursor]:
            record = put(record, path, value)
        return (record,)

    return op


def deep(func: Callable) -> Callable[[dict], Iterable]:
    """Apply to every leaf: True keeps it, False nulls it, anything else takes its place."""

    def walk(node: object) -> object:
        if isinstance(node, list):
            return list(map(walk, node))
        if isinstance(node, dict):
            return {name: walk(below) for name, below in node.items()}
        result = func(node)
        if result is True:
            return node
        return None if result is False else result

    return lambda record: (walk(record),)


def prune(spec: dict) -> Callable[[dict], Iterable]:
    """Only the named fields, null where missing."""

    def cut(node: object, names: dict) -> dict:
        node = node if isinstance(node, dict) else {}
        return {k: cut(node.get(k), below) if isinstance(below, dict) else node.get(k) for k, below in names.items()}

    return lambda record: (cut(record, spec),)


def paths(wanted: list[Depth]) -> Callable[[dict], Iterable]:
    """A record of the values, by the last names; the later of two equal names wins."""
    return lambda record: ({p[-1]: look(record, p) for p in wanted},)


def group_key(value: object) -> str:
    """Values that group together have the same text: by type and content, dicts in any order."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def group_items(items: list, key: Depth, name: str, target: str, recurse: bool) -> list:
    """Items in groups, first seen first. With ``recurse`` a list below the items is grouped in turn."""
    if recurse and any(_list_before_end(item, key) for item in items):
        return [next(iter(group_inside(key, name, target, True)(item))) for item in items]
    groups: dict[str, dict] = {}
    for item in items:
        value = look(item, key)
        groups.setdefault(group_key(value), {name: value, target: []})[target].append(item)
    return list(groups.values())


def _list_before_end(value: object, path: Depth) -> bool:
    for name in path:
        if isinstance(value, list):
            return True
        if not isinstance(value, dict):
            return False
        value = value.get(name)
    return False


def crosses_list(path: Depth) -> Callable[[dict], bool]:
    return lambda record: _list_before_end(record, path)


def group_inside(path: Depth, name: str, target: str, recurse: bool) -> Callable[[object], Iterable]:
    """The record with the first list on the path grouped by what the rest of the path leads to."""

    def inner(node: object, rest: Depth) -> object:
        if not rest or not isinstance(node, dict) or rest[0] not in node:
            return node
        below = node[rest[0]]
        grouped = group_items(below, rest[1:], rest[-1] if rest[1:] else "group", target, recurse) if isinstance(below, list) else inner(below, rest[1:])
        return node | {rest[0]: grouped}

    return lambda record: (inner(record, path),)


def explode(names: list[str], cursor: list[Depth]) -> Callable[[dict], Iterable]:
    """Rows of the projected values, one for each item of the first that is a list; the others repeat.

    A record that a map has turned into a list is taken by position: a list for
    each item of its first list. Any other value stays as it is.
    """

    def op(record: object) -> Iterable:
        if not isinstance(record, dict):
            at = next((i for i, v in enumerate(record) if isinstance(v, list)), None) if isinstance(record, list) else None
            return (record,) if at is None else tuple([*record[:at], item, *record[at + 1 :]] for item in record[at])
        values = [look(record, p) for p in cursor]
        at = next((i for i, v in enumerate(values) if isinstance(v, list)), None)
        if at is None:
            return (dict(zip(names, values, strict=True)),)
        return tuple(dict(zip(names, [*values[:at], item, *values[at + 1 :]], strict=True)) for item in values[at])

    return op


def plain(value: object) -> object:
    """A value as JSON would give it back: fresh dicts and lists, text for names and for what JSON doesn't know."""
    kind = type(value)
    if kind is str or kind is int or kind is float or kind is bool or value is None:
        return value
    if isinstance(value, dict):
        return {k if type(k) is str else next(iter(json.loads(json.dumps({k: None})))): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return json.loads(json.dumps(value, default=str))


def run(df: DataFrame, op: Callable[[dict], Iterable]) -> DataFrame:
    """Apply a record operator to (position, JSON) rows. Several results of one record keep its position.

    Operators that follow each other run as one: a record is read from JSON once
    and written once, however many there are.
    """
    source, ops = getattr(df, "_record_ops", (df, ()))
    ops = (*ops, op)
    done = _passed(source, ops)
    done._record_ops = (source, ops)
    return done


def keyed(df: DataFrame, wanted: list[Depth]) -> DataFrame:
    """(position, JSON, ``__k0``, ...) rows: records with the texts of their keys, found in the pass of the operators before."""
    return _passed(*getattr(df, "_record_ops", (df, ())), wanted)


def _passed(source: DataFrame, ops: tuple, wanted: Sequence[Depth] = ()) -> DataFrame:
    ship_code(source.sparkSession)
    kind = source.schema[POS].dataType.simpleString()
    names = [f"__k{i}" for i in range(len(wanted))]

    def results(record: dict, todo: tuple) -> Iterator[object]:
        if not todo:
            yield record
            return
        for result in todo[0](record):
            yield from results(plain(result), todo[1:])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at, out, keys = [], [], [[] for _ in names]
            for i, text in enumerate(batch.column(DOC).to_pylist()):
                for result in results(json.loads(text), ops):
                    at.append(i)
                    out.append(json.dumps(result, ensure_ascii=False))
                    for found, path in zip(keys, wanted, strict=True):
                        found.append(group_key(look(result, path)))
            texts = [pa.array(column, pa.string()) for column in (out, *keys)]
            yield pa.RecordBatch.from_arrays([batch.column(POS).take(pa.array(at, pa.int64())), *texts], names=[POS, DOC, *names])

    return source.select(POS, DOC).mapInArrow(batches, f"{POS} {kind}" + "".join(f", {n} string" for n in (DOC, *names)))


def assembled(parts: dict[str, Column]) -> Column:
    """A record as JSON from the JSON of its fields. It is put together in the JVM, so that Python never holds a whole group."""
    out = [F.lit("{")]
    for name, text in parts.items():
        out += [F.lit(", " * (len(out) > 1) + json.dumps(name, ensure_ascii=False) + ": "), text]
    return F.concat(*out, F.lit("}"))


def listed() -> Column:
    """An aggregate: the JSON of a group's rows as a list, in the order of their positions."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(POS).alias("p"), F.col(DOC).alias("d")))), lambda x: x["d"])
    return F.concat(F.lit("["), F.array_join(ordered, ", "), F.lit("]"))
