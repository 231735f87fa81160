"""Arrays and maps: bare encoded slices, checked element conversions, entries in key order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codec

#: Elements that an encoded slice may have.
MOST = 1 << 26
#: Least and greatest of each integer type; decimal(20,0) stands for unsigned 64-bit ones.
RANGES = {f"{name}": (-(1 << bits), (1 << bits) - 1) for name, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63))} | {"decimal(20,0)": (0, (1 << 64) - 1)}
FLOAT_MAX = 3.4028234663852886e38


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _read_varint(data: bytes) -> tuple[int, int]:
    n = shift = 0
    for i, b in enumerate(data[:10]):
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            if n > MOST:
                raise ValueError(f"{n} elements are too many")
            return n, i + 1
    raise ValueError("no count")


@F.pandas_udf(T.BinaryType())
def encode_slice(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """array<bigint> as its count and a column; null stays null."""
    for s in parts:
        yield s.map(lambda a: None if a is None else _varint(len(a)) + codec.encode_ints(np.asarray(a, np.int64)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def decode_slice(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda b: None if b is None else codec.decode_ints(b, *_read_varint(b))[0].tolist())


@F.pandas_udf(T.BinaryType())
def encode_float_slice(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda a: None if a is None else _varint(len(a)) + codec.encode_floats(np.asarray(a, np.float64)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode_float_slice(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda b: None if b is None else codec.decode_floats(b, *_read_varint(b))[0].tolist())


def narrowest(a: Column) -> Column:
    """Bytes of the narrowest signed type that holds every element: 1, 2, 4 or 8."""
    within = lambda bits: F.forall(a, lambda x: x.between(-(1 << bits), (1 << bits) - 1))
    return F.when(within(7), 1).when(within(15), 2).when(within(31), 4).otherwise(8)


def literal(n: int) -> Column:
    """An integer of any size."""
    return F.lit(n) if -(1 << 63) <= n < 1 << 63 else F.lit(str(n)).cast("decimal(20,0)")


def unfit(x: Column, target: str) -> Column:
    """Whether a number is out of ``target``'s range; for float a finite one that would become infinite."""
    if target == "float":
        return ~F.isnan(x) & (F.abs(x) > FLOAT_MAX) & (F.abs(x) != float("inf"))
    low, high = RANGES[target]
    return ~x.between(literal(low), literal(high))


def first_unfit(a: Column, target: str) -> Column:
    """Index of the first element out of ``target``'s range, or null."""
    at = F.array_position(F.transform(a, lambda x: unfit(x, target)), F.lit(True))
    return F.when(at > 0, at - 1)


def converted(a: Column, target: str) -> Column:
    """The array as array<target>; an element out of range fails the query and names its index."""
    at = first_unfit(a, target)
    fail = F.raise_error(F.concat(F.lit("element "), at.cast("string"), F.lit(f" is out of range for {target}")))
    return F.when(at.isNull(), F.transform(a, lambda x: x.try_cast(target))).otherwise(fail.cast(f"array<{target}>"))


def sorted_entries(m: Column) -> Column:
    """A map's entries by key; text bytewise, numbers by value, false first."""
    return F.array_sort(F.map_entries(m))


def last_wins(entries: Column) -> Column:
    """A map of entries; of a repeated key the last stays."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    value = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, value))
