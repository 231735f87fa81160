"""Reading a frame under another schema: fields by name, checked conversions, zeros for what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import RANGES, unfit

FLOATS = ("float", "double")


class Refused(ValueError):
    """A conversion that no value could make good."""


def zero(kind: T.DataType) -> Column:
    """The zero of a type; nullable fields have null instead."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.BinaryType):
        return F.lit(b"")
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[(zero(f.dataType) if not f.nullable else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields])
    return F.lit(0).cast(kind)


def convertible(source: str, target: str) -> bool:
    """Whether a type may be read as another: equal, between integers (decimal(20,0) is the unsigned one), integer to float, between floats."""
    if source == target:
        return True
    if source in RANGES:
        return target in RANGES or target in FLOATS
    return source in FLOATS and target in FLOATS


def fits(column: Column, source: str, target: str) -> Column:
    """Whether each value survives the conversion; null does."""
    checked = (target in RANGES and source in RANGES) or (source, target) == ("double", "float")
    return F.coalesce(~unfit(column, target), F.lit(True)) if checked else F.lit(True)


def reconcile(df: DataFrame, target: T.StructType) -> DataFrame:
    """``df`` as ``target``: matching names converted, others dropped, missing ones zero (null if nullable).

    Refuses before any job runs if no name matches or a type can't be read as the one asked for; a value out of
    range fails the query, naming the field.
    """
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if not any(f.name in have for f in target.fields):
        raise Refused("no field of the target is in the source: " + ", ".join(sorted(have)[:6]))
    out = []
    for f in target.fields:
        if f.name not in have:
            out.append((F.lit(None).cast(f.dataType) if f.nullable else zero(f.dataType)).alias(f.name))
            continue
        source, kind, c = have[f.name], f.dataType.simpleString(), F.col(f"`{f.name}`")
        if not convertible(source, kind):
            raise Refused(f"{f.name}: {source} can't be read as {kind}")
        value = F.when(fits(c, source, kind), c.try_cast(f.dataType)).otherwise(F.raise_error(F.concat(F.lit(f"{f.name}: value out of range for {kind}: "), c.cast("string"))).cast(f.dataType)) if source != kind else c
        out.append((value if f.nullable else F.coalesce(value, zero(f.dataType))).alias(f.name))
    return df.select(*out)


def refused_rows(df: DataFrame, target: T.StructType, key: str) -> DataFrame:
    """(key, field, value) of every value that the conversion would refuse."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    bad = [
        F.when(~fits(F.col(f.name), have[f.name], f.dataType.simpleString()), F.struct(F.lit(f.name).alias("field"), F.col(f.name).cast("string").alias("value")))
        for f in target.fields if f.name in have and convertible(have[f.name], f.dataType.simpleString())
    ]
    return df.select(key, F.inline(F.array_compact(F.array(*bad))))


def union_versions(frames: list[DataFrame], target: T.StructType) -> DataFrame:
    """Frames of several schema versions under one."""
    out = reconcile(frames[0], target)
    for df in frames[1:]:
        out = out.unionByName(reconcile(df, target))
    return out


def flattened(df: DataFrame, link: str) -> DataFrame:
    """Fields of the struct ``link`` beside those of the row, level by level; where both have a name the row's own is kept.

    A page of further fields links to the next one by the same name.
    """
    while link in df.columns and isinstance(df.schema[link].dataType, T.StructType):
        inner = df.schema[link].dataType
        own = [c for c in df.columns if c != link]
        df = df.select(*[f"`{c}`" for c in own], *[F.col(f"`{link}`")[f.name].alias(f.name) for f in inner.fields if f.name not in own])
    return df


def unwrapped(df: DataFrame) -> DataFrame:
    """A frame of one struct column as that struct's fields, as often as it is one: envelopes say nothing of their own."""
    while len(df.columns) == 1 and isinstance(df.schema[0].dataType, T.StructType):
        df = df.select(f"`{df.columns[0]}`.*")
    return df
