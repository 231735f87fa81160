"""One value as one message: typed rows, rows that carry their schema, and documents of no type.

The first byte says what a message is (``ROOTS``). Typed bodies hold a presence bitmap and the fields in order: integers as
zigzag varints, floats as their bytes without trailing zero bytes, texts and lists with a count before them, maps in key order;
a list of eight rows or more is a table of columns (:mod:`tessera.functions.columns`). Untyped values have a tag each, and
a uniform list of eight objects or more is a table too.
"""

from __future__ import annotations

import datetime
import decimal
import functools
import json
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators import schema
from ..session import ship
from . import columns, jsontext

#: What the first byte of a message says.
ROOTS = {1: "row", 2: "described row", 3: "document"}
TABLE_ROWS = 8
NULL, FALSE, TRUE, INT, FLOAT, TEXT, LIST, MAP, TABLE, BIG = range(10)
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)


class Damaged(ValueError):
    """Bytes that are no message."""


class Reader:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Damaged(f"the message ends within {n} bytes from byte {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self) -> int:
        out = shift = 0
        while True:
            b = self.take(1)[0]
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def count(self) -> int:
        n = self.uint()
        if n > len(self.data) * 64:
            raise Damaged(f"{n} values are more than the message can hold")
        return n

    def int(self) -> int:
        u = self.uint()
        return u >> 1 ^ -(u & 1)

    def sized(self) -> bytes:
        return self.take(self.uint())


#: Numbers of one byte.
ONE = [bytes([n]) for n in range(128)]


def uint(n: int) -> bytes:
    if n < 128:
        return ONE[n]
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def sint(n: int) -> bytes:
    return uint(n << 1 if n >= 0 else (-n << 1) - 1)


def sized(data: bytes) -> bytes:
    return uint(len(data)) + data


def float_bytes(v: float, kind: str = ">d") -> bytes:
    """A float's bytes from the sign on, without the zero bytes at its end; a size before them."""
    return sized(struct.pack(kind, v).rstrip(b"\0"))


def read_float(data: bytes, kind: str = ">d") -> float:
    return struct.unpack(kind, data.ljust(struct.calcsize(kind), b"\0"))[0]


def write(v, t: T.DataType) -> bytes:
    """The body of a value that isn't null."""
    if isinstance(t, T.StructType):
        have = sum(1 << k for k, f in enumerate(t.fields) if v[f.name] is not None)
        return have.to_bytes((len(t.fields) + 7) // 8, "little") + b"".join(write(v[f.name], f.dataType) for f in t.fields if v[f.name] is not None)
    if isinstance(t, T.ArrayType):
        if isinstance(t.elementType, T.StructType) and len(v) >= TABLE_ROWS:
            return uint(len(v)) + columns.encode(pa.array(v, to_arrow_type(t.elementType)))
        return uint(len(v)) + b"".join(b"\0" if x is None else b"\1" + write(x, t.elementType) for x in v)
    if isinstance(t, T.MapType):
        entries = sorted(dict(v).items())
        return uint(len(entries)) + b"".join(write(k, t.keyType) + (b"\0" if x is None else b"\1" + write(x, t.valueType)) for k, x in entries)
    if isinstance(t, T.StringType):
        return sized(v.encode())
    if isinstance(t, T.BinaryType):
        return sized(bytes(v))
    if isinstance(t, T.BooleanType):
        return b"\1" if v else b"\0"
    if isinstance(t, T.DoubleType):
        return float_bytes(v)
    if isinstance(t, T.FloatType):
        return float_bytes(v, ">f")
    if isinstance(t, T.DecimalType):
        return sint(int(v.scaleb(t.scale, decimal.Context(prec=60))))
    if isinstance(t, T.DateType):
        return sint(v.toordinal() - datetime.date(1970, 1, 1).toordinal())
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return sint((v.replace(tzinfo=v.tzinfo or datetime.UTC) - EPOCH) // datetime.timedelta(microseconds=1))
    if isinstance(t, T.IntegralType):
        return sint(v)
    raise schema.Refused(f"no message for {t.simpleString()}")


def writer(t: T.DataType) -> Callable:
    """:func:`write` for one type: what the type says is asked once, not for every value."""
    if isinstance(t, T.StructType):
        size, fields = (len(t.fields) + 7) // 8, [(1 << k, f.name, writer(f.dataType)) for k, f in enumerate(t.fields)]

        def struct_of(v) -> bytes:
            have, out = 0, [b""]
            for bit, name, one in fields:
                if (x := v[name]) is not None:
                    have |= bit
                    out.append(one(x))
            out[0] = have.to_bytes(size, "little")
            return b"".join(out)

        return struct_of
    if isinstance(t, T.ArrayType):
        one, table = writer(t.elementType), to_arrow_type(t.elementType) if isinstance(t.elementType, T.StructType) else None

        def list_of(v) -> bytes:
            if table is not None and len(v) >= TABLE_ROWS:
                return uint(len(v)) + columns.encode(pa.array(v, table))
            return uint(len(v)) + b"".join([b"\0" if x is None else b"\1" + one(x) for x in v])

        return list_of
    if isinstance(t, T.StringType):
        return lambda v: sized(v.encode())
    if isinstance(t, T.DoubleType):
        return float_bytes
    if isinstance(t, T.IntegralType):
        return sint
    return lambda v: write(v, t)


def reader(t: T.DataType) -> Callable:
    """:func:`read` for one type, as :func:`writer`: a value from a byte on, and the byte after it. Ends are checked by the caller."""
    if isinstance(t, T.StructType):
        size, fields = (len(t.fields) + 7) // 8, [(1 << k, f.name, reader(f.dataType)) for k, f in enumerate(t.fields)]

        def struct_of(data: bytes, at: int):
            have, at, out = int.from_bytes(data[at : at + size], "little"), at + size, {}
            for bit, name, one in fields:
                if have & bit:
                    out[name], at = one(data, at)
                else:
                    out[name] = None
            return out, at

        return struct_of
    if isinstance(t, T.ArrayType):
        one, table = reader(t.elementType), to_arrow_type(t.elementType) if isinstance(t.elementType, T.StructType) else None

        def list_of(data: bytes, at: int):
            n, at = _count_at(data, at)
            if n > len(data) * 64:
                raise Damaged(f"{n} values are more than the message can hold")
            if table is not None and n >= TABLE_ROWS:
                rows, at = columns.decode(table, data, n, at)
                return rows.to_pylist(), at
            items = []
            for _ in range(n):
                x, at = one(data, at + 1) if data[at] == 1 else (None, at + 1)
                items.append(x)
            return items, at

        return list_of
    if isinstance(t, T.StringType):

        def text_of(data: bytes, at: int):
            n, at = _count_at(data, at)
            return data[at : at + n].decode(), at + n

        return text_of
    if isinstance(t, T.DoubleType):

        def double_of(data: bytes, at: int):
            n, at = _count_at(data, at)
            return read_float(data[at : at + n]), at + n

        return double_of
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        start = EPOCH if isinstance(t, T.TimestampType) else EPOCH.replace(tzinfo=None)

        def time_of(data: bytes, at: int):
            u, at = _count_at(data, at)
            return start + datetime.timedelta(microseconds=u >> 1 ^ -(u & 1)), at

        return time_of
    if isinstance(t, T.IntegralType):

        def int_of(data: bytes, at: int):
            u, at = _count_at(data, at)
            return u >> 1 ^ -(u & 1), at

        return int_of

    def other(data: bytes, at: int):
        r = Reader(data, at)
        return read(r, t), r.at

    return other


def read(r: Reader, t: T.DataType):
    if isinstance(t, T.StructType):
        have = int.from_bytes(r.take((len(t.fields) + 7) // 8), "little")
        return {f.name: read(r, f.dataType) if have >> k & 1 else None for k, f in enumerate(t.fields)}
    if isinstance(t, T.ArrayType):
        n = r.count()
        if isinstance(t.elementType, T.StructType) and n >= TABLE_ROWS:
            rows, r.at = columns.decode(to_arrow_type(t.elementType), r.data, n, r.at)
            return rows.to_pylist()
        return [read(r, t.elementType) if r.take(1) == b"\1" else None for _ in range(n)]
    if isinstance(t, T.MapType):
        return [(read(r, t.keyType), read(r, t.valueType) if r.take(1) == b"\1" else None) for _ in range(r.count())]
    if isinstance(t, T.StringType):
        return r.sized().decode()
    if isinstance(t, T.BinaryType):
        return r.sized()
    if isinstance(t, T.BooleanType):
        return r.take(1) == b"\1"
    if isinstance(t, T.DoubleType):
        return read_float(r.sized())
    if isinstance(t, T.FloatType):
        return read_float(r.sized(), ">f")
    if isinstance(t, T.DecimalType):
        return decimal.Decimal(r.int()).scaleb(-t.scale, decimal.Context(prec=60))
    if isinstance(t, T.DateType):
        return datetime.date(1970, 1, 1) + datetime.timedelta(days=r.int())
    if isinstance(t, T.TimestampType):
        return EPOCH + datetime.timedelta(microseconds=r.int())
    if isinstance(t, T.TimestampNTZType):
        return (EPOCH + datetime.timedelta(microseconds=r.int())).replace(tzinfo=None)
    return r.int()


def write_any(node: jsontext.Node) -> bytes:
    """An untyped value: a tag, then what it holds."""
    kind, v = node.kind, node.value
    if kind in ("null", "boolean"):
        return bytes([NULL if v is None else TRUE if v else FALSE])
    if kind == "int":
        return bytes([INT]) + sint(v)
    if kind == "unsigned":
        return bytes([BIG]) + uint(v)
    if kind == "float":
        return bytes([FLOAT]) + float_bytes(v)
    if kind == "string":
        return bytes([TEXT]) + sized(v.encode("utf-8", "surrogatepass"))
    if kind == "object":
        entries = sorted(v.items())
        return bytes([MAP]) + uint(len(entries)) + b"".join(sized(k.encode("utf-8", "surrogatepass")) + write_any(x) for k, x in entries)
    if (table := _table(v)) is not None:
        return bytes([TABLE]) + table
    return bytes([LIST]) + uint(len(v)) + b"".join(map(write_any, v))


def _atom(v) -> jsontext.Node:
    """A value of :mod:`json` as a node of :mod:`jsontext`, without what it holds."""
    if isinstance(v, bool) or v is None:
        return jsontext.Node("null" if v is None else "boolean", 0, v)
    if isinstance(v, int):
        if -jsontext.INT_MAX - 1 <= v <= jsontext.INT_MAX:
            return jsontext.Node("int", 0, v)
        return jsontext.Node("unsigned", 0, v) if 0 < v <= jsontext.UINT_MAX else jsontext.Node("float", 0, float(v))
    return jsontext.Node("float" if isinstance(v, float) else "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "array", 0, v)


@functools.lru_cache(4096)
def _key(name: str) -> bytes:
    return sized(name.encode("utf-8", "surrogatepass"))


def write_plain(v) -> bytes:
    """:func:`write_any` of a value as :mod:`json` reads it."""
    kind = type(v)
    if kind is str:
        return b"\5" + sized(v.encode("utf-8", "surrogatepass"))
    if kind is int and -jsontext.INT_MAX - 1 <= v <= jsontext.INT_MAX:
        return b"\3" + sint(v)
    if kind is dict:
        return b"\7" + uint(len(v)) + b"".join([_key(k) + write_plain(v[k]) for k in sorted(v)])
    if kind is list:
        if len(v) >= TABLE_ROWS and all(type(x) is dict for x in v):
            table = _table([jsontext.Node("object", 0, {k: _atom(y) for k, y in x.items()}) for x in v])
            if table is not None:
                return bytes([TABLE]) + table
        return b"\6" + uint(len(v)) + b"".join([write_plain(x) for x in v])
    return write_any(_atom(v))


def _no_number(name: str):
    raise ValueError(name)


_load = json.JSONDecoder(parse_constant=_no_number).decode


def document(text: str) -> bytes:
    """A JSON text as an untyped message. Texts that :mod:`json` refuses or that may nest too deep are read with the place of the fault."""
    if text.count("[") + text.count("{") <= jsontext.DEPTH:
        try:
            return b"\3" + write_plain(_load(text))
        except ValueError:
            pass
    return b"\3" + write_any(jsontext.parse(text))


def _table(rows: list[jsontext.Node]) -> bytes | None:
    """A list of eight objects or more with the same keys and one atomic kind in each as columns."""
    if len(rows) < TABLE_ROWS or any(r.kind != "object" for r in rows):
        return None
    names = sorted(rows[0].value)
    types = {"int": pa.int64(), "float": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = [rows[0].value[n].kind for n in names]
    if not names or any(k not in types for k in kinds) or any(sorted(r.value) != names or [r.value[n].kind for n in names] != kinds for r in rows):
        return None
    head = uint(len(rows)) + uint(len(names)) + b"".join(sized(n.encode("utf-8", "surrogatepass")) + bytes([list(types).index(k)]) for n, k in zip(names, kinds, strict=True))
    return head + b"".join(columns.encode(pa.array([r.value[n].value for r in rows], types[k])) for n, k in zip(names, kinds, strict=True))


def read_any(r: Reader):
    """The value as Python objects."""
    tag = r.take(1)[0]
    if tag in (NULL, FALSE, TRUE):
        return (None, False, True)[tag]
    if tag == INT:
        return r.int()
    if tag == BIG:
        return r.uint()
    if tag == FLOAT:
        return read_float(r.sized())
    if tag == TEXT:
        return r.sized().decode("utf-8", "surrogatepass")
    if tag == LIST:
        return [read_any(r) for _ in range(r.count())]
    if tag == MAP:
        return {r.sized().decode("utf-8", "surrogatepass"): read_any(r) for _ in range(r.count())}
    if tag != TABLE:
        raise Damaged(f"unknown tag {tag} at byte {r.at - 1}")
    n, types = r.count(), (pa.int64(), pa.float64(), pa.string(), pa.bool_())
    names = [(r.sized().decode("utf-8", "surrogatepass"), r.take(1)[0]) for _ in range(r.count())]
    cols = []
    for _, kind in names:
        col, r.at = columns.decode(types[kind], r.data, n, r.at)
        cols.append(col.to_pylist())
    return [dict(zip((name for name, _ in names), row, strict=True)) for row in zip(*cols, strict=True)]


def _count_at(data: bytes, at: int) -> tuple[int, int]:
    b, at = data[at], at + 1
    if b < 128:
        return b, at
    out, shift = b & 127, 7
    while True:
        b, at = data[at], at + 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def _text_at(data: bytes, at: int) -> tuple[str, int]:
    n, at = _count_at(data, at)
    if at + n > len(data):
        raise Damaged(f"the message ends within {n} bytes from byte {at}")
    return data[at : at + n].decode("utf-8", "surrogatepass"), at + n


def read_plain(data: bytes, at: int):
    """:func:`read_any` by places: the value from a byte on, and the byte after it."""
    try:
        tag = data[at]
        if tag == INT:
            u, at = _count_at(data, at + 1)
            return u >> 1 ^ -(u & 1), at
        if tag == TEXT:
            return _text_at(data, at + 1)
        if tag in (MAP, LIST):
            n, at = _count_at(data, at + 1)
            if n > len(data) * 64:
                raise Damaged(f"{n} values are more than the message can hold")
            if tag == LIST:
                items = []
                for _ in range(n):
                    x, at = read_plain(data, at)
                    items.append(x)
                return items, at
            fields = {}
            for _ in range(n):
                name, at = _text_at(data, at)
                fields[name], at = read_plain(data, at)
            return fields, at
    except IndexError:
        raise Damaged(f"the message ends at byte {len(data)}") from None
    r = Reader(data, at)
    return read_any(r), r.at


def root(data: bytes) -> str:
    """What a message is, by its first byte."""
    if not data or data[0] not in ROOTS:
        raise Damaged("no message starts so")
    return ROOTS[data[0]]


def split(data: bytes) -> tuple[str, bytes, bytes]:
    """(root, section, body) of a message; the section is empty unless it is described."""
    kind = root(data)
    r = Reader(data, 1)
    section = r.sized() if kind == "described row" else b""
    return kind, section, data[r.at :]


def messages(df: DataFrame, keep: list[str], described: bool = False) -> DataFrame:
    """The columns ``keep`` and message: each row as a message, with its schema's section if ``described``."""
    ship(df.sparkSession)
    t = df.schema
    head = b"\2" + sized(schema.section(t)) if described else b"\1"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body = writer(t)
        for batch in batches:
            out = [head + body(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], [*keep, "message"])

    ddl = T.StructType([*(t[c] for c in keep), T.StructField("message", T.BinaryType())])
    return df.mapInArrow(run, ddl)


def rows(df: DataFrame, t: T.StructType | None = None, column: str = "message") -> DataFrame:
    """Typed rows of messages; without ``t`` by the section of the first, which all must share."""
    ship(df.sparkSession)
    own = None
    if t is None:
        first = df.select(column).first()
        kind, own, _ = split(bytes(first[0])) if first else ("row", b"", b"")
        if kind != "described row":
            raise schema.Refused("the messages don't say their schema")
        t = schema.schema_of(own)
    names, types = t.names, [to_arrow_type(f.dataType) for f in t.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = reader(t)
        for batch in batches:
            out = []
            for data in batch.column(0).to_pylist():
                kind, section, body = split(data)
                if kind == "document" or (own and section != own):
                    raise Damaged("a message of another root or schema")
                try:
                    row, at = one(body, 0)
                except IndexError:
                    raise Damaged(f"the message ends at byte {len(body)}") from None
                if at > len(body):
                    raise Damaged(f"the message ends before byte {at}")
                out.append(row)
                if at != len(body):
                    raise Damaged("bytes are left after the row")
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], kind) for n, kind in zip(names, types, strict=True)], names)

    return df.select(column).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in t.fields]))


def documents(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, message): JSON texts as untyped documents; a text that is no JSON fails with its byte and line, null stays null."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if text is None else document(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "message"])

    return df.select(key, column).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, message binary")


def texts(df: DataFrame, key: str, column: str = "message") -> DataFrame:
    """(key, json): documents as JSON texts, keys in order."""
    ship(df.sparkSession)
    spell = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                if data is None:
                    out.append(None)
                    continue
                if root(data) != "document":
                    raise Damaged("no document")
                out.append(spell(read_plain(data, 1)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "json"])

    return df.select(key, column).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, json string")


def from_json(df: DataFrame, key: str, column: str, t: T.StructType) -> DataFrame:
    """(message): JSON texts as described rows of a schema, as :func:`messages` writes them."""
    return messages(df.select(F.from_json(F.col(column), t).alias("row")).select("row.*"), [], described=True)
