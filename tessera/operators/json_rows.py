"""JSON texts: exact inference at every level with diagnostics, rendering, and round trips that are checked."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsontext
from ..functions.arrays import sorted_entries
from ..session import ship

KINDS = ("null", "boolean", "string", "array", "object", "float", "int", "unsigned", "invalid")


def _observed(text: str) -> list[tuple]:
    """(path, kind, new, n, negative, place, offset, message) of one text."""
    try:
        seen: dict[tuple[str, str], list] = {}
        for place, (path, node) in enumerate(jsontext.walk(jsontext.parse(text))):
            negative = node.kind == "int" and node.value < 0
            if (one := seen.get((path, node.kind))) is None:
                seen[path, node.kind] = [1, negative, place, node.at]
            else:
                one[0] += 1
                one[1] |= negative
    except jsontext.Malformed as e:
        return [("$", "invalid", 1, 1, False, 0, e.offset, str(e))]
    rows, paths = [], set()
    for (path, kind), (n, negative, place, at) in seen.items():
        rows.append((path, kind, int(path not in paths), n, negative, place, len(text[:at].encode()), None))
        paths.add(path)
    return rows


def _alike(keys: list, texts: list) -> Iterator[tuple[int, int, list[int]]]:
    """(number, last, firsts) of texts that have the same paths and kinds: how many, which has the greatest key, which the least.

    A text stands by itself if its key is no integer or it is no row of JSON tokens.
    """
    groups: dict[str, list] = {}
    for k, (key, text) in enumerate(zip(keys, texts, strict=True)):
        if text is None:
            continue
        shape = jsontext.skeleton(text) if type(key) is int else None
        if shape is None:
            yield 1, k, [k]
        elif (g := groups.get(shape)) is None:
            groups[shape] = [1, k, [k]]
        else:
            g[0] += 1
            if key > keys[g[1]]:
                g[1] = k
            if key < keys[g[2][0]]:
                g[2] = [k]
            elif key == keys[g[2][0]]:
                g[2].append(k)
    yield from map(tuple, groups.values())


def summed(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(path, kind, n, negative, new, last, record, place, offset, message): :func:`observations` added up within each batch.

    Texts of one skeleton are told apart by their places alone, and only the first record's places are asked for: one text of each skeleton is parsed.
    """
    ship(texts.sparkSession)
    kind_of_key = texts.schema[key].dataType.simpleString()
    names = ["path", "kind", "n", "negative", "new", "last", "record", "place", "offset", "message"]
    types = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for number, last, firsts in _alike(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k in firsts:
                    count = number - len(firsts) + 1 if k == firsts[0] else 1
                    rows += [(path, kind, n * count, negative, new * count, last, k, place, offset, message) for path, kind, new, n, negative, place, offset, message in _observed(batch.column(1)[k].as_py())]
            arrays = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 10, types, strict=True)]
            keys = {name: batch.column(0).take(arrays[names.index(name)]) for name in ("last", "record")}
            yield pa.RecordBatch.from_arrays([keys.get(name, x) for name, x in zip(names, arrays, strict=True)], names)

    return texts.select(key, F.col(column).cast("string").alias("text_")).mapInArrow(run, f"path string, kind string, n long, negative boolean, new long, last {kind_of_key}, record {kind_of_key}, place long, offset long, message string")


def observations(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(record, path, kind, new, n, negative, place, offset, message): for each record how often a path has a kind, and where first.

    ``new`` is 1 in one row of each record and path, else 0.
    Paths go to every level: ``$.a.b``, list elements ``$.a[]``. Of a repeated key the last value counts, once. A text
    that is no JSON is one observation of kind invalid with the byte and line of the fault. Null texts are none.
    """
    ship(texts.sparkSession)
    kind_of_key = texts.schema[key].dataType.simpleString()
    names = ["record", "path", "kind", "new", "n", "negative", "place", "offset", "message"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                rows += [(k, *one) for one in _observed(text)]
            columns = list(zip(*rows, strict=True)) or [()] * 9
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(arrays[0]), *arrays[1:]], names)

    return texts.select(key, F.col(column).cast("string").alias("text_")).mapInArrow(run, f"record {kind_of_key}, path string, kind string, new long, n long, negative boolean, place long, offset long, message string")


def infer(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(path, type, nullable, conflict, n_records, first_record, first_place): what each path is, or the kinds that contradict each other.

    Any float makes a path double; an unsigned above the signed range makes it decimal(20,0) unless another value is negative.
    A path is nullable if it is null somewhere or absent from an object that could have it. Paths in order of
    (first_record, first_place) are in order of first sight. A conflict names, for each kind, its records, and the first's byte.
    """
    one = summed(texts, key, column).groupBy("path", "kind").agg(
        F.sum("n").alias("n"), F.bool_or("negative").alias("negative"), F.sum("new").alias("n_records"), F.max("last").alias("last"),
        F.min(F.struct("record", "place", "offset", "message")).alias("first"),
    )
    has = lambda k: F.bool_or(F.col("kind") == k).alias(f"is_{k}")
    said = F.concat(
        F.col("kind"), F.lit(" in records "), F.col("first.record").cast("string"), F.lit(" to "), F.col("last").cast("string"), F.lit(" from byte "), F.col("first.offset").cast("string"),
        F.coalesce(F.concat(F.lit(" ("), F.col("first.message"), F.lit(")")), F.lit("")),
    )
    details = F.array_sort(F.collect_list(F.when(F.col("kind") != "null", said)))
    got = one.groupBy("path").agg(
        *[has(k) for k in KINDS], F.bool_or("negative").alias("negative"), F.sum("n").alias("n"), F.sum("n_records").alias("n_records"), F.sum(F.when(F.col("kind") == "object", F.col("n"))).alias("objects"),
        F.min("first").alias("first"), details.alias("details"),
    )
    number = F.col("is_float") | F.col("is_int") | F.col("is_unsigned")
    families = sum((x.cast("int") for x in (number, F.col("is_boolean"), F.col("is_string"), F.col("is_array"), F.col("is_object"))), F.lit(0))
    clash = (families > 1) | F.col("is_invalid") | (~F.col("is_float") & F.col("is_unsigned") & F.col("negative"))
    kind = F.when(clash, None).when(F.col("is_float"), "double").when(F.col("is_unsigned"), "decimal(20,0)").when(F.col("is_int"), "bigint").when(F.col("is_boolean"), "boolean").when(F.col("is_string"), "string").when(F.col("is_array"), "array").when(F.col("is_object"), "struct")
    words = F.when(clash, F.concat(F.lit("type conflict at "), F.col("path"), F.lit(": "), F.array_join("details", "; "))).when(families == 0, "only ever null")
    parent = F.regexp_replace("path", r'(\.\w+|\["(?:[^"\\]|\\.)*"\]|\[\])$', "")
    # each path meets the objects above it in a window: a join with itself would read the texts twice
    holder = F.when((F.col("path") != "$") & ~F.endswith("path", F.lit("[]")), parent)
    rows = got.withColumn("at", F.explode(F.array(F.struct(F.col("path").alias("place"), F.lit(True).alias("own")), F.struct(holder.alias("place"), F.lit(False).alias("own")))))
    could = F.max(F.when(F.col("at.own"), F.col("objects"))).over(Window.partitionBy("at.place"))
    rows = rows.withColumn("could", could).where(~F.col("at.own"))
    absent = F.coalesce(F.col("n") < F.col("could"), F.lit(False))
    return rows.select("path", kind.alias("type"), (F.col("is_null") | absent).alias("nullable"), words.alias("conflict"), "n_records", F.col("first.record").alias("first_record"), F.col("first.place").alias("first_place"))


def number_text(v: Column) -> Column:
    """A finite float as JSON: plain from 1e-6 to below 1e21, else with an exponent of no leading zero. NaN and infinity fail the query."""
    s = v.cast("string")
    part = lambda i: F.regexp_extract(s, r"^-?([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$", i)
    fraction = F.when(part(2) == "0", "").otherwise(part(2))
    exponent = F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0))
    digits = F.concat(part(1), fraction)
    point, size = F.length(part(1)) + exponent, F.length(digits)
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size)))
    )
    far = F.concat(part(1), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.when(exponent < 0, "e").otherwise("e+"), exponent.cast("string"))
    wide = (v != 0) & ((F.abs(v) < F.lit(1e-6).cast("double")) | (F.abs(v) >= F.lit(1e21).cast("double")))
    text = F.concat(F.when(s.startswith("-"), "-").otherwise(""), F.when(wide, far).otherwise(plain))
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(v.isNull(), None).when(finite, text).otherwise(F.raise_error(F.concat(s, F.lit(" has no spelling in JSON"))).cast("string"))


def quoted(s: Column) -> Column:
    """A text between quotes, with <, >, & and the two line separators escaped too."""
    text = F.to_json(F.array(s))
    text = F.substring(text, F.lit(2), F.length(text) - 2)
    for raw, escaped in (("<", "u003c"), (">", "u003e"), ("&", "u0026"), (" ", "u2028"), (" ", "u2029")):
        text = F.replace(text, F.lit(raw), F.lit("\\" + escaped))
    return F.when(s.isNotNull(), text)


def spelled(c: Column, t: T.DataType) -> Column:
    """A value of any type as JSON text; null as null. Maps are in key order, their keys quoted; binaries are base64."""
    name = t.simpleString()
    if isinstance(t, T.StructType):
        fields = [F.concat(F.lit("," * (k > 0)), quoted(F.lit(f.name)), F.lit(":"), spelled(c[f.name], f.dataType)) for k, f in enumerate(t.fields)]
        out = F.concat(F.lit("{"), *fields, F.lit("}"))
    elif isinstance(t, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: spelled(x, t.elementType)), ","), F.lit("]"))
    elif isinstance(t, T.MapType):
        pair = lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(":"), spelled(e["value"], t.valueType))
        out = F.concat(F.lit("{"), F.array_join(F.transform(sorted_entries(c), pair), ","), F.lit("}"))
    elif name in ("double", "float"):
        out = number_text(c)
    elif name == "string":
        out = quoted(c)
    elif name == "binary":
        out = F.concat(F.lit('"'), F.base64(c), F.lit('"'))
    elif name == "variant":
        out = F.to_json(c)
    elif name == "date":
        out = F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    elif name.startswith("timestamp"):
        out = F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('"' if name.endswith("ntz") else 'Z"'))
    else:
        out = c.cast("string")
    return F.coalesce(F.when(c.isNotNull(), out), F.lit("null"))


def render(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, json): rows as JSON objects of the columns, in expressions alone."""
    t = T.StructType([df.schema[c] for c in columns])
    fields = [F.concat(F.lit("," * (k > 0)), quoted(F.lit(f.name)), F.lit(":"), spelled(F.col(f"`{f.name}`"), f.dataType)) for k, f in enumerate(t.fields)]
    return df.select(key, F.concat(F.lit("{"), *fields, F.lit("}")).alias("json"))


def render_table(df: DataFrame, key: str, group: str, columns: list[str]) -> DataFrame:
    """(group, json): each group's rows, in order of ``key``, as one array of objects."""
    rows = render(df, key, columns).join(df.select(key, group), key) if group != key else render(df, key, columns)
    got = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(key, "json"))).alias("rows"))
    return got.select(group, F.concat(F.lit("["), F.array_join("rows.json", ","), F.lit("]")).alias("json"))


def minified_size(text: Column) -> Column:
    """Bytes of a JSON text without white space between tokens."""
    return F.octet_length(F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|\s+', "$1"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, rows): rows that only one of two frames has, with multiplicity."""
    left = a.exceptAll(b).select(F.lit("only_first").alias("side"))
    right = b.exceptAll(a).select(F.lit("only_second").alias("side"))
    return left.unionByName(right).groupBy("side").agg(F.count("*").alias("rows"))


def verified(pairs: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """(key, path, reason) of the first difference of each row whose two JSON texts differ.

    Absent and null fields equal zeros and numbers are compared by value, so what a lossless round trip may change is no difference.
    """
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                try:
                    found = jsontext.difference(None if a is None else jsontext.parse(a), None if b is None else jsontext.parse(b))
                except jsontext.Malformed as e:
                    found = ("$", str(e))
                if found:
                    rows.append((k, *found))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], [key, "path", "reason"])

    return pairs.select(key, first, second).mapInArrow(run, f"`{key}` {pairs.schema[key].dataType.simpleString()}, path string, reason string")
