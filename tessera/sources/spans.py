"""Byte spans of encoded columns: which bytes are form, bitmap, header, base and blocks. They tile the column."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

import numpy as np

from ..functions import codec, columns
from ..functions.scalar import BLOCK
from ..session import ship
from .chunks import SECTION

NAMES = {codec.RAW: "raw", codec.FRAME: "frame", codec.DELTA: "delta", codec.CONSTANT: "constant"}
#: Blocks told apart; those after them are one span.
MOST = 64


def spans(payload: bytes, n: int) -> Iterator[tuple[str, str, int, int]]:
    """(path, kind, start, end) of each part."""
    if not n:
        return
    kind = NAMES[payload[0] & 7]
    yield "header", kind, 0, 1
    at = 1
    if kind != "raw":
        yield "base", kind, 1, 9
        at = 9
    left, k = (0 if kind == "constant" else n - (kind == "delta")), 0
    while left and k < MOST:
        size = min(left, BLOCK)
        end = at + 1 + (size * payload[at] + 7) // 8
        yield f"block[{k}]", f"{payload[at]} bits", at, end
        at, left, k = end, left - size, k + 1
    if left:
        yield f"block[{k}..]", "rest", at, len(payload)


def node_spans(kind: str, payload: bytes, n: int) -> Iterator[tuple[str, str, int, int]]:
    """(path, kind, start, end) of a node: integers block by block, other kinds' values as one span."""
    yield "form", kind, 0, 1
    at = 1
    if payload[0] == columns.ABSENT:
        return
    if payload[0] == columns.PRESENCE:
        at = 1 + (n + 7) // 8
        yield "presence", "bitmap", 1, at
        n = int(np.unpackbits(np.frombuffer(payload, np.uint8, at - 1, 1), bitorder="little")[:n].sum())
    if kind == "int":
        yield from ((path, what, at + a, at + b) for path, what, a, b in spans(payload[at:], n))
    elif at < len(payload):
        yield "values", kind, at, len(payload)


def inspect(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """(row_group, column_name, path, kind, start, end) of the chunks of :mod:`tessera.sources.chunks`."""
    ship(spark)

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = [(r.row_group, r.column_name, *s) for r in pdf.itertuples() for s in node_spans(r.kind, r.payload, r.n)]
            yield pd.DataFrame(rows, columns=["row_group", "column_name", "path", "kind", "start", "end"])

    whole = chunks.where(f"kind <> '{SECTION}'").select("row_group", "column_name", "kind", "n", "payload")
    return whole.mapInPandas(run, "row_group long, column_name string, path string, kind string, start long, end long")
