"""Column helpers: rounding, number texts and small lookups."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from skuflow.functions import fixed_values as fv


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half up on the binary value, alike on every engine."""
    factor = float(10 ** digits)
    return F.floor(value * factor + 0.5) / F.lit(factor)


def number_text(value: Column, digits: int = 0) -> Column:
    """``value`` with a fixed number of decimals."""
    if digits == 0:
        return F.floor(value + 0.5).cast("string")
    return half_up(value, digits).cast(f"decimal(30,{digits})").cast("string")


def signed_text(value: Column) -> Column:
    """Whole number with its sign always shown."""
    whole = F.floor(value + 0.5)
    return F.concat(F.when(whole >= 0, "+").otherwise(""), whole.cast("string"))


def abc_weight(abc_class: Column) -> Column:
    weight = F.lit(fv.ABC_OTHER)
    for letter, number in fv.ABC_WEIGHTS.items():
        weight = F.when(abc_class == letter, number).otherwise(weight)
    return weight


def high_season(month: Column) -> Column:
    return month.isin(*fv.HIGH_SEASON_MONTHS).cast("int")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(fv.SEVERITY_ORDER))
    for place, name in enumerate(fv.SEVERITY_ORDER):
        rank = F.when(severity == name, place).otherwise(rank)
    return rank


def with_values(df: DataFrame, values: Column, name: str, use: Callable[[Column], Column]) -> DataFrame:
    """``df`` with the column ``use(values)``. The values are a column first, so that their subquery stands once in the plan."""
    return df.withColumn("_values", values).withColumn(name, use(F.col("_values"))).drop("_values")


def filled(template: str, **values: Column) -> Column:
    """A text with columns in place of its names in braces; null if one of them is."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[part] if place % 2 else F.lit(part) for place, part in enumerate(parts) if part])


def one_value(df: DataFrame, aggregate: Column) -> Column:
    """An aggregate of ``df`` as a scalar subquery: one value, no join and no driver round trip."""
    return df.agg(aggregate.alias("value")).scalar()
