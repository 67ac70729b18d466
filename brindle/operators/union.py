"""Bag unions by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.types import type_text
from brindle.operators.cast import cast_to


def combined(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows; left's columns, then those only right has; names match without case; a type or field-id conflict is refused."""
    there = {f.name.lower(): f for f in right.schema}
    for f in left.schema:
        g = there.get(f.name.lower())
        if g is None:
            continue
        if f.dataType != g.dataType:
            raise ValueError(f"column {f.name}: {type_text(f.dataType)} and {type_text(g.dataType)} differ; cast one side")
        ids = {(x.metadata or {}).get("parquet.field.id") for x in (f, g)} - {None}
        if len(ids) > 1:
            raise ValueError(f"column {f.name}: field ids {sorted(ids)} conflict")
    named = {f.name.lower(): f.name for f in left.schema}
    right = right.select(*(F.col(f"`{f.name}`").alias(named.get(f.name.lower(), f.name)) for f in right.schema))
    return left.unionByName(right, allowMissingColumns=True)


def combined_as(left: DataFrame, right: DataFrame, schema: T.StructType, safe: bool = True) -> DataFrame:
    return cast_to(left, schema, safe).union(cast_to(right, schema, safe))


def appended(stored: DataFrame, incoming: DataFrame, safe: bool = True) -> DataFrame:
    return stored.union(cast_to(incoming, stored.schema, safe))
