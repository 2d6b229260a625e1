"""The types that schema leaves have."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable


class SchemaType:
    """Equal by structure, and hashable by it too."""

    def key(self) -> Hashable:
        raise NotImplementedError

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.key() == other.key()

    def __hash__(self) -> int:
        return hash((type(self).__name__, self.key()))

    def __repr__(self) -> str:
        return str(self)


class NullType(SchemaType):
    """None, or a missing field."""

    def key(self) -> Hashable:
        return ()

    def __str__(self) -> str:
        return "null"


class PrimitiveType(SchemaType):
    """Values of exactly one Python class: int, float and bool stay apart."""

    def __init__(self, cls: type):
        self.type = cls

    def key(self) -> Hashable:
        return self.type

    def __str__(self) -> str:
        return self.type.__name__


class DictType(SchemaType):
    """Stands for a whole branch where a difference has to name its kind."""

    def key(self) -> Hashable:
        return ()

    def __str__(self) -> str:
        return "dict"


class UnionType(SchemaType):
    """One of several types; unions in it are taken apart."""

    def __init__(self, types: Iterable[SchemaType]):
        flat: dict[SchemaType, None] = {}
        for t in types:
            flat.update(dict.fromkeys(t.types if isinstance(t, UnionType) else [t]))
        self.types = frozenset(flat)
        self._shown = list(flat)

    def key(self) -> Hashable:
        return self.types

    def __str__(self) -> str:
        return " | ".join(sorted(map(str, self._shown)))


class ListType(SchemaType):
    """Items of one type, or of one branch."""

    def __init__(self, item):
        self.item = item

    def key(self) -> Hashable:
        from .schema import Branch, encode

        return encode(self.item) if isinstance(self.item, Branch) else self.item

    def __str__(self) -> str:
        return f"list[{self.item}]"


class FunctionType(SchemaType):
    """Membership by a predicate; the same function is the same type."""

    def __init__(self, func: Callable[[object], bool]):
        self.func = func

    def key(self) -> Hashable:
        return self.func

    def __call__(self, value: object) -> bool:
        return bool(self.func(value))

    def __str__(self) -> str:
        return getattr(self.func, "__name__", "function")


class ThunkFunctionType(SchemaType):
    """Two membership predicates joined by "or" or "and", decided when called."""

    def __init__(self, left, right, op: str = "or"):
        if op not in ("or", "and"):
            raise ValueError(f"predicates are joined by 'or' or 'and', not {op!r}")
        self.left, self.right, self.op = left, right, op

    def key(self) -> Hashable:
        return (self.left, self.right, self.op)

    def __call__(self, value: object) -> bool:
        return (self.left(value) or self.right(value)) if self.op == "or" else (self.left(value) and self.right(value))

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


def combine_types(a: SchemaType, b: SchemaType) -> SchemaType:
    """The least type for values of either: equal ones stay, predicates join lazily, lists of branches merge, others unite."""
    from .schema import Branch

    if a == b:
        return a
    callable_ = (isinstance(a, FunctionType), isinstance(b, FunctionType))
    if any(callable_) and all(isinstance(x, FunctionType | ThunkFunctionType) for x in (a, b)):
        return ThunkFunctionType(a, b, "or")
    if isinstance(a, ListType) and isinstance(b, ListType) and isinstance(a.item, Branch) and isinstance(b.item, Branch):
        return ListType(a.item.union(b.item))
    # Within a union, lists of branches are one member, so the union stays small however many records there are.
    members = [*(a.types if isinstance(a, UnionType) else [a]), *(b.types if isinstance(b, UnionType) else [b])]
    lists = [m for m in members if isinstance(m, ListType) and isinstance(m.item, Branch)]
    if len(lists) > 1:
        merged = lists[0].item
        for m in lists[1:]:
            merged = merged.union(m.item)
        members = [m for m in members if m not in lists] + [ListType(merged)]
    united = UnionType(members)
    return united if len(united.types) > 1 else next(iter(united.types))
