"""Schemas as data: op codes, field ids, a self-describing section of bytes, and what may be a column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ATOMS = {
    "boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "decimal(20,0)": "uint64", "float": "float32", "double": "float64", "string": "string", "binary": "bytes",
    "date": "int32", "timestamp": "int64", "timestamp_ntz": "int64", "variant": "any",
}
LISTS = {"tinyint": "int8s", "smallint": "int16s", "int": "int32s", "bigint": "int64s", "decimal(20,0)": "uint64s", "string": "strings", "double": "float64s", "float": "float32s", "boolean": "bools", "binary": "byte_strings", "variant": "anys"}
OPS = frozenset((*ATOMS.values(), *LISTS.values(), "struct", "struct_pointer", "structs", "map", "pointer", "decimal"))
KEYS = ("string", "tinyint", "smallint", "int", "bigint", "decimal(20,0)", "boolean")
#: Fields of an object; levels that structs may nest; list columns within list columns.
MOST_FIELDS, DEPTH, LIST_DEPTH = 4080, 128, 4


class Refused(ValueError):
    """A schema that can't be written or read."""


def op_of(t: T.DataType, nullable: bool = False) -> str:
    """The op of a type. Nullable atoms and structs are pointers."""
    name = t.simpleString()
    if isinstance(t, T.StructType):
        return "struct_pointer" if nullable else "struct"
    if isinstance(t, T.MapType):
        if t.keyType.simpleString() not in KEYS or (t.keyType.simpleString() == "boolean" and t.valueType.simpleString() == "variant"):
            raise Refused(f"{t.keyType.simpleString()} can't key this map")
        return "map"
    if isinstance(t, T.ArrayType):
        if isinstance(t.elementType, T.StructType):
            return "structs"
        if (op := LISTS.get(t.elementType.simpleString())) is None:
            raise Refused(f"no lists of {t.elementType.simpleString()}")
        return op
    if isinstance(t, T.DecimalType) and name not in ATOMS:
        return "pointer" if nullable else "decimal"
    if name not in ATOMS:
        raise Refused(f"no op for {name}")
    return "pointer" if nullable and name != "variant" else ATOMS[name]


def name_hash(name: str) -> int:
    """32-bit FNV-1a of the name, its four bytes folded to one."""
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 % (1 << 32)
    return (h ^ h >> 8 ^ h >> 16 ^ h >> 24) & 255


def field_ids(schema: T.StructType) -> dict[str, int]:
    """Ids from the metadata key ``id`` first, then from the name's hash, the next free one on a clash."""
    out: dict[str, int] = {}
    for f in schema.fields:
        if "id" in f.metadata:
            if f.metadata["id"] in out.values():
                raise Refused(f"{f.name}: id {f.metadata['id']} is taken")
            out[f.name] = f.metadata["id"]
    if len(schema.fields) > MOST_FIELDS:
        raise Refused(f"{len(schema.fields)} fields")
    taken = set(out.values())
    for f in schema.fields:
        if f.name not in out:
            start = name_hash(f.name)
            free = (i % 256 for i in range(start, start + 256))
            i = next((x for x in free if x not in taken), None)
            if i is None:  # a page of further ids
                i = next(x for x in range(256, MOST_FIELDS + 257) if x not in taken)
            out[f.name] = i
            taken.add(i)
    return out


def columnable(t: T.DataType) -> bool:
    """Whether values of a type can be a column of their own."""
    return not isinstance(t, (T.MapType, T.StructType)) and (t.simpleString() in ATOMS and t.simpleString() not in ("binary", "variant"))


def transposable(t: T.StructType, lists: int = 0) -> bool:
    """Whether rows of a type can be written column by column, lists of rows within them up to four deep."""
    for f in t.fields:
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else None
        if isinstance(inner, T.StructType):
            if lists >= LIST_DEPTH or not transposable(inner, lists + 1):
                return False
        elif not columnable(f.dataType):
            return False
    return bool(t.fields)


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    op: str
    nullable: bool
    #: For structs the number of their table entry; else the Spark type as JSON.
    extra: str


def section(schema: T.StructType) -> bytes:
    """Structs hoisted into a table, the root at 0: lines of id, name, op, nullable and extra, each with its size before it."""
    table: list[T.StructType] = []
    seen: dict[str, int] = {}

    def number(t: T.StructType, depth: int) -> int:
        if depth > DEPTH:
            raise Refused("structs nest too deep")
        key = t.json()
        if key not in seen:
            seen[key] = len(table)
            table.append(t)
            for f in t.fields:
                inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
                if isinstance(inner, T.StructType):
                    number(inner, depth + 1)
        return seen[key]

    number(schema, 0)
    out = bytearray()
    put = lambda b: out.extend(len(b).to_bytes(2, "little") + b)
    put(str(len(table)).encode())
    for t in table:
        ids = field_ids(t)
        put(str(len(t.fields)).encode())
        for f in t.fields:
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            extra = str(seen[inner.json()]) if isinstance(inner, T.StructType) else f.dataType.json()
            put(f"{ids[f.name]}\t{op_of(f.dataType, f.nullable)}\t{int(f.nullable)}\t{extra}\t{f.name}".encode())
    return bytes(out)


def parse(data: bytes) -> list[list[Field]]:
    """The struct table of a section; refuses sections that are cut short, repeat an id or name what isn't there."""
    at = 0

    def take() -> str:
        nonlocal at
        size = int.from_bytes(data[at : at + 2], "little")
        if at + 2 + size > len(data) or at + 2 > len(data):
            raise Refused(f"the section ends within the entry at byte {at}")
        at += 2 + size
        return data[at - size : at].decode()

    def count() -> int:
        word = take()
        if not word.isdigit() or int(word) > len(data):
            raise Refused(f"{word!r} is no count")
        return int(word)

    table = []
    structs = count()
    for _ in range(structs):
        fields, ids = [], set()
        for _ in range(count()):
            parts = take().split("\t", 4)
            if len(parts) != 5 or not parts[0].isdigit() or parts[1] not in OPS:
                raise Refused(f"no field: {parts}")
            op = parts[1]
            if parts[0] in ids:
                raise Refused(f"id {parts[0]} comes twice")
            if op in ("struct", "structs", "struct_pointer") and not (parts[3].isdigit() and int(parts[3]) < structs):
                raise Refused(f"{parts[4]}: no struct {parts[3]}")
            ids.add(parts[0])
            fields.append(Field(int(parts[0]), parts[4], op, parts[2] == "1", parts[3]))
        table.append(fields)
    if at != len(data) or not table:
        raise Refused("bytes are left after the section")
    return table


def schema_of(data: bytes) -> T.StructType:
    """The schema that a section describes; structs that hold themselves are refused, as Spark has none."""
    table = parse(data)

    def build(i: int, above: tuple[int, ...]) -> T.StructType:
        if i in above:
            raise Refused("a struct holds itself")
        fields = []
        for f in table[i]:
            if f.op in ("struct", "struct_pointer", "structs"):
                t: T.DataType = build(int(f.extra), (*above, i))
                t = T.ArrayType(t) if f.op == "structs" else t
            else:
                t = T._parse_datatype_json_string(f.extra)
            fields.append(T.StructField(f.name, t, f.nullable, {"id": f.id}))
        return T.StructType(fields)

    return build(0, ())


def described(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """(position, name, id, op, nullable, columnable) of each field."""
    ids = field_ids(schema)
    rows = [(i, f.name, ids[f.name], op_of(f.dataType, f.nullable), f.nullable, columnable(f.dataType)) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, "position int, name string, id int, op string, nullable boolean, columnable boolean")
