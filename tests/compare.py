"""Rows of two results as comparable values, whatever the engines call their types."""

import math


def value(x):
    if x is None or type(x).__name__ in ("NAType", "NaTType") or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    if isinstance(x, float) or type(x).__name__.startswith("float"):
        return f"{float(x):.9g}"
    return str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(value, r)) for r in df.itertuples(index=False))
