"""Schema variants of records of any shape: shapes are found in parallel, and folded on the driver.

The driver sees distinct shapes, not records. By default a shape is folded at its
first record and all records of one shape belong to the first variant that then
fits; ``exact`` goes through the records' shapes in order, as a record's variant
may depend on what came before it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boughs.operators.order import POS
from boughs.operators.records import DOC
from boughs.session import ship_code

from .schema import Branch, Leaf, Schema, decode, encode, infer_schema
from .types import FunctionType, ListType, NullType, PrimitiveType, ThunkFunctionType


@dataclass
class Catalog:
    schemas: dict[int, Schema]
    #: Shape code to variant.
    ids_of: dict[str, int]
    #: (shape, records) that fitted several variants when they came.
    overlaps: list[tuple[str, int]]

    def ids(self, df: DataFrame) -> DataFrame:
        """(position, schema_id); a row for each distinct shape is joined."""
        spark = df.sparkSession
        table = spark.createDataFrame(list(self.ids_of.items()), "shape string, schema_id int")
        return shapes(df).join(table, "shape").select(POS, "schema_id")


#: A VARIANT's type doesn't tell whether some items of a list are null or lack a field, nor 1.0 from an integer beyond 64 bits.
_UNCLEAR = r"VARIANT|ARRAY<(?!VOID>)|DECIMAL\(\d+,0\)"
_NATIVE = "OBJECT<"


def shapes(df: DataFrame) -> DataFrame:
    """(position, shape): each record's schema as a code, which shape_of reads.

    The code is the record's VARIANT type, found in the JVM, where that tells all;
    the codes of other records, such as those that have lists with items, are made in Python.
    """
    ship_code(df.sparkSession)
    kind = F.schema_of_variant(F.try_parse_json(DOC))
    plain = kind.startswith(_NATIVE) & ~F.rlike(kind, F.lit(_UNCLEAR))
    # JSON's decimals are one kind.
    kind = F.regexp_replace(kind, r"DECIMAL\(\d+,\d+\)|FLOAT", "DOUBLE")

    @F.arrow_udf("string")
    def coded(docs: pa.Array) -> pa.Array:
        return pa.array([None if d is None else _coded(json.loads(d)) for d in docs.to_pylist()], pa.string())

    found = df.select(POS, DOC, F.coalesce(plain, F.lit(False)).alias("__plain"), kind.alias("__kind"))
    shape = F.when(F.col("__plain"), F.col("__kind")).otherwise(coded(F.when(~F.col("__plain"), F.col(DOC))))
    return found.select(POS, shape.alias("shape"))


def _coded(value: object) -> str:
    if not isinstance(value, dict):
        raise ValueError("records have to be dicts")
    return encode(infer_schema(value))


_TOKEN = re.compile(r"`(?P<quoted>(?:[^`]|``)*)`: |(?P<plain>\w+): |(?P<begins>OBJECT<)|(?P<ends>>)|, |(?P<kind>ARRAY<VOID>|[A-Z_]+)")
_SCALARS = {"BIGINT": int, "DOUBLE": float, "STRING": str, "BOOLEAN": bool}


def shape_of(code: str) -> Schema:
    """The schema that a code stands for."""
    if not code.startswith(_NATIVE):
        return decode(code)
    open_, name = [], None
    for token in _TOKEN.finditer(code):
        found, text = token.lastgroup, token[0]
        if found == "quoted":
            name = token["quoted"].replace("``", "`")
        elif found == "plain":
            name = token["plain"]
        elif found == "begins":
            open_.append((name, Branch() if open_ else Schema()))
        elif found == "ends":
            name, node = open_.pop()
            if not open_:
                return node
            open_[-1][1][name] = node
        elif found == "kind":
            open_[-1][1][name] = Leaf(ListType(NullType()) if text == "ARRAY<VOID>" else NullType() if text == "VOID" else PrimitiveType(_SCALARS[text]))
    raise ValueError(f"no shape: {code}")


def fold(catalog: dict[int, Schema], shape: Schema) -> tuple[int, bool]:
    """Put a shape into the catalog: every variant equal to it grows by it. (the first such, or a new one; whether several)"""
    fitting = [i for i, s in catalog.items() if s == shape]
    for i in fitting:
        catalog[i] = catalog[i].reconcile(shape)
    if not fitting:
        catalog[len(catalog)] = shape
        return len(catalog) - 1, False
    return fitting[0], len(fitting) > 1


def build(df: DataFrame, exact: bool = False) -> Catalog:
    found = shapes(df)
    catalog: dict[int, Schema] = {}
    ids: dict[str, int] = {}
    overlaps: dict[str, int] = {}
    if exact:
        known: dict[str, Schema] = {}
        settled: dict[str, tuple[int, int, bool]] = {}
        version = 0
        for row in found.orderBy(POS).select("shape").toLocalIterator():
            shape = known.setdefault(row[0], shape_of(row[0]))
            if settled.get(row[0], (0, -1, False))[1] != version:
                before = {i: encode(s) for i, s in catalog.items()}
                i, several = fold(catalog, shape)
                if {k: encode(s) for k, s in catalog.items()} != before:
                    version += 1
                settled[row[0]] = (i, version, several)
            i, _, several = settled[row[0]]
            ids.setdefault(row[0], i)
            if several:
                overlaps[row[0]] = overlaps.get(row[0], 0) + 1
    else:
        rows = found.groupBy("shape").agg(F.min(POS).alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first")
        order = []
        for row in rows.toLocalIterator():
            shape = shape_of(row["shape"])
            _, several = fold(catalog, shape)
            order.append((row["shape"], shape))
            if several:
                overlaps[row["shape"]] = row["n"]
        # Shapes are numbered by the finished variants, whatever they were when the shape came.
        for code, shape in order:
            ids[code] = next(i for i, s in catalog.items() if s == shape)
    return Catalog(catalog, ids, [(str(shape_of(c)), n) for c, n in overlaps.items()])


def fits(record: object, shape: dict) -> bool:
    """Whether a record has the fields of a shape, of its types. A predicate type decides on any value, null too."""
    if not isinstance(record, dict):
        return False
    for name, want in shape.items():
        value = record.get(name)
        if isinstance(want, dict):
            if not fits(value, want):
                return False
        elif isinstance(want, FunctionType | ThunkFunctionType):
            if not want(value):
                return False
        elif value is None or (want not in (None, object) and type(value) is not want):
            return False
    return True
