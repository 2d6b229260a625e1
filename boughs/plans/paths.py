"""Depth and breadth paths, and their compilation to columns."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Depth = tuple[str, ...]


class Path:
    """Parsers for the two kinds of path; paths themselves are tuples and lists of tuples."""

    @staticmethod
    def parse_depth(path: str | Sequence[str]) -> Depth:
        """``"a.b"`` or ``("a", "b")``. A tuple's names may have dots in them."""
        if isinstance(path, str):
            return tuple(path.split("."))
        if isinstance(path, tuple) and all(isinstance(p, str) for p in path):
            return path
        raise TypeError(f"a depth path is a dotted string or a tuple of names, not {path!r}")

    @staticmethod
    def parse_breadth(paths: list) -> list:
        if isinstance(paths, list):
            return paths
        raise TypeError(f"a breadth path is a list of depth paths, not {paths!r}")


def parse_cursor(item: object) -> Depth | list[Depth]:
    """What stands second between brackets; a list in a list counts as the list."""
    if isinstance(item, list):
        flat = item[0] if len(item) == 1 and isinstance(item[0], list) else item
        return [Path.parse_depth(p) for p in Path.parse_breadth(flat)]
    return Path.parse_depth(item)


@dataclass(frozen=True)
class Found:
    """A compiled path: its column, its type, and how many lists it went through."""

    col: Column
    kind: T.DataType
    lists: int = 0


NOTHING = T.NullType()


def _null() -> Found:
    return Found(F.lit(None), NOTHING)


def _field(kind: T.StructType, name: str) -> T.DataType | None:
    return next((f.dataType for f in kind.fields if f.name == name), None)


def step(at: Found, names: Sequence[str], cross_lists: bool = True) -> Found:
    """Follow names from a column. A name that isn't there, or has nothing below it, gives null.

    A list met on the way maps the rest of the path over its elements. Over one
    list of structs that is plain field extraction, which Parquet can prune;
    lists within lists take a lambda each.
    """
    if not names:
        return at
    head, rest = names[0], names[1:]
    if isinstance(at.kind, T.StructType):
        inner = _field(at.kind, head)
        return _null() if inner is None else step(Found(at.col.getField(head), inner, at.lists), rest, cross_lists)
    if isinstance(at.kind, T.MapType) and isinstance(at.kind.keyType, T.StringType):
        return step(Found(F.try_element_at(at.col, F.lit(head)), at.kind.valueType, at.lists), rest, cross_lists)
    if isinstance(at.kind, T.VariantType):
        # What is below a VARIANT is one too. Lists inside it aren't crossed: only its rows know of them.
        return step(Found(F.try_variant_get(at.col, f"$[{json.dumps(head, ensure_ascii=False)}]", "variant"), at.kind, at.lists), rest, cross_lists)
    if isinstance(at.kind, T.ArrayType) and cross_lists:
        element = at.kind.elementType
        if isinstance(element, T.StructType):
            inner = _field(element, head)
            if inner is not None and _plain(inner, rest):
                col, kind = at.col.getField(head), inner
                for name in rest:
                    col, kind = col.getField(name), _field(kind, name)
                return Found(col, T.ArrayType(kind), at.lists + 1)
        # The type is known from the schema; the lambda compiles the same steps for each element.
        kind = step(Found(F.lit(None).cast(element), element), names).kind
        if kind == NOTHING:
            return Found(F.transform(at.col, lambda _: F.lit(None).cast("void")), T.ArrayType(NOTHING), at.lists + 1)
        return Found(F.transform(at.col, lambda x: step(Found(x, element), names).col), T.ArrayType(kind), at.lists + 1)
    return _null()


def _plain(kind: T.DataType, names: Sequence[str]) -> bool:
    for name in names:
        if not isinstance(kind, T.StructType) or (kind := _field(kind, name)) is None:
            return False
    return True


def compile_path(schema: T.StructType, path: Depth, cross_lists: bool = True) -> Found:
    kind = _field(schema, path[0])
    if kind is None:
        return _null()
    return step(Found(F.col(quoted(path[0])), kind), path[1:], cross_lists)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def list_prefix(schema: T.StructType, path: Depth) -> int | None:
    """How many names lead to the first list that has names after it; None if there is none."""
    kind: T.DataType = schema
    for i, name in enumerate(path):
        if isinstance(kind, T.ArrayType):
            return i
        if isinstance(kind, T.MapType):
            kind = kind.valueType
            continue
        kind = _field(kind, name) if isinstance(kind, T.StructType) else None
        if kind is None:
            return None
    return None


def replaced(kind: T.StructType | None, at: Column | None, path: Depth, value: Column, overwrite: bool = False) -> Column:
    """The struct ``at`` with ``value`` at ``path``. What is missing on the way, or no struct, becomes one.

    A list on the way would be lost, so that is an error unless ``overwrite``.
    """
    fields = [] if kind is None else kind.fields
    head, rest = path[0], path[1:]
    parts, seen = [], False
    for f in fields:
        own = at.getField(f.name) if at is not None else F.col(quoted(f.name))
        if f.name == head:
            seen, own = True, _below(f.dataType, own, rest, value, overwrite)
        parts.append(own.alias(f.name))
    if not seen:
        parts.append(_below(None, None, rest, value, overwrite).alias(head))
    return F.struct(*parts)


def _below(kind: T.DataType | None, at: Column | None, rest: Depth, value: Column, overwrite: bool) -> Column:
    if not rest:
        return value
    if isinstance(kind, T.StructType):
        return replaced(kind, at, rest, value, overwrite)
    if isinstance(kind, T.ArrayType) and not overwrite:
        raise ValueError(f"a list stands before {'.'.join(rest)}; pass overwrite=True to lose it")
    return replaced(None, None, rest, value, overwrite)
