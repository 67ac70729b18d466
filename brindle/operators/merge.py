"""Upsert by key: every stored row of a key is replaced by the last incoming row of that key, new keys are appended once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.cast import cast_to


def merged(stored: DataFrame, incoming: DataFrame, keys: list[str], ordinal: str | None = None, safe: bool = True) -> DataFrame:
    """stored with incoming folded in. Keys match null-safe (NaN equals NaN); incoming is cast to stored's schema first.

    ordinal: a column of incoming in arrival order; of a repeated key the greatest wins. Without it a repeated incoming key is an error,
    raised when the rows are computed, as files have no arrival order. Incoming is reduced by an aggregate (combined on the map
    side), so a hot key doesn't gather its rows, and the join may be split on hot stored keys.
    """
    known = {f.name.lower(): f.name for f in stored.schema}
    if missing := [k for k in keys if k.lower() not in known]:
        raise ValueError(f"no key column {missing}")
    keys = [known[k.lower()] for k in keys]
    cast = cast_to(incoming, stored.schema, safe)
    rest = [c for c in stored.columns if c not in keys]
    row = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(True)
    if ordinal is not None:
        order = incoming.schema[ordinal].dataType
        staged = incoming.withColumnRenamed(ordinal, "__ordinal") if ordinal not in stored.columns else incoming.withColumn("__ordinal", F.col(ordinal))
        cast = cast_to(staged, T.StructType([*stored.schema.fields, T.StructField("__ordinal", order)]), safe)
        last = F.max_by(row, F.col("__ordinal"))
        one = cast.groupBy(*keys).agg(last.alias("__row"))
    else:
        one = cast.groupBy(*keys).agg(F.any_value(row).alias("__row"), F.count(F.lit(1)).alias("__n"))
        one = one.withColumn("__row", F.when(F.col("__n") == 1, F.col("__row")).otherwise(F.raise_error(F.lit("an incoming key repeats and no ordinal column tells which row is last")).cast(one.schema["__row"].dataType))).drop("__n")
    new = one.select(*(F.col(f"`{k}`").alias(f"__key_{i}") for i, k in enumerate(keys)), "__row")
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(keys)])
    value = lambda c: F.col(f"`{c}`") if c in keys else F.when(F.col("__row").isNotNull(), F.col("__row").getField(c)).otherwise(F.col(f"`{c}`")).alias(c)
    kept = stored.join(new, on, "left").select(*map(value, stored.columns))
    have = stored.select(*(F.col(f"`{k}`").alias(f"__have_{i}") for i, k in enumerate(keys)))
    absent = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"__have_{i}")) for i, k in enumerate(keys)])
    fresh = one.join(have, absent, "left_anti").select(*(F.col(f"`{c}`") if c in keys else F.col("__row").getField(c).alias(c) for c in stored.columns))
    return kept.union(fresh)
