"""Queries over tree-structured records, planned by Spark."""

from boughs.core import DataBranch, DataTree
from boughs.functions import flatten, isna, native
from boughs.plans.paths import Path
from boughs.plans.schema import Schema, infer_schema

__all__ = ["DataBranch", "DataTree", "Path", "Schema", "flatten", "infer_schema", "isna", "native"]
