import json
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import arrays, codec, columns, jsontext, message, scalar
from tessera.operators import dictionary, floats, integers, json_rows, nested, reconcile, schema
from tessera.operators.position import with_positions
from tessera.sources import chunks, corpus

LENGTHS = (0, 1, 2, 31, 32, 33, 127, 128, 129, 1000)


def shapes(n):
    r = np.random.default_rng(n)
    return {
        "tiny": r.integers(0, 100, n), "ids": np.arange(n) + 7, "times": 1_700_000_000 + np.cumsum(r.integers(10, 14, n)), "clustered": 10**12 + r.integers(-500, 501, n),
        "random": r.integers(-(2**63), 2**63 - 1, n), "zeros": np.zeros(n, np.int64), "negative": -r.integers(0, 9, n), "extremes": np.where(r.integers(0, 2, n) > 0, 2**63 - 1, -(2**63)),
    }


@pytest.mark.parametrize("n", LENGTHS)
def test_integers_survive_the_codec(n):
    for v in shapes(n).values():
        v = v.astype(np.int64)
        data = codec.encode_ints(v)
        back, at = codec.decode_ints(data, n)
        assert at == len(data) and back.tolist() == v.tolist()


@pytest.mark.parametrize("name, size", [("ids", 171), ("zeros", 3)])
def test_published_sizes(name, size):
    assert len(codec.encode_ints({"ids": np.arange(256), "zeros": np.zeros(256)}[name].astype(np.int64))) <= size


@pytest.mark.parametrize("n", LENGTHS)
def test_floats_survive_bit_for_bit(n):
    r = np.random.default_rng(n)
    odd = np.resize(np.array([math.nan, math.inf, -math.inf, -0.0, 1e300, 5e-324, 1 / 3, 2.0**60]), n)
    for v in (np.round(r.uniform(-1e4, 1e4, n), 2), r.normal(size=n), odd, np.where(np.arange(n) % 97 == 0, odd, np.round(r.uniform(0, 10, n), 1)), np.zeros(n)):
        assert codec.decode_floats(codec.encode_floats(v), n)[0].view(np.int64).tolist() == v.view(np.int64).tolist()


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_five_bit_texts(text):
    packed = codec.pack5(text)
    assert packed is None or (codec.unpack5(packed) == text and len(packed) < len(text.encode()))


def test_five_bits_save_on_prose():
    assert len(codec.pack5("the quick brown fox jumps over the lazy dog")) < 30


@given(st.lists(st.text(max_size=5), max_size=40))
@settings(max_examples=100, deadline=None)
def test_texts_survive(values):
    data = columns.encode(pa.array(values, pa.string()))
    back, at = columns.decode(pa.string(), data, len(values))
    assert back.to_pylist() == values and at == len(data)


def test_damaged_columns_are_refused():
    data = codec.encode_ints(np.arange(300, dtype=np.int64) * 77)
    with pytest.raises((ValueError, IndexError)):
        codec.decode_ints(data[:20], 300)
    with pytest.raises(ValueError):
        codec.decode_ints(b"\xff" + data[1:], 300)


def test_costs_are_the_codec_sizes(spark):
    rows = [(name, k, k // 4096, k % 4096 // 128, int(v)) for name, vals in shapes(1000).items() for k, v in enumerate(vals)]
    got = integers.transform_costs(spark.createDataFrame(rows, "column_name string, pos long, row_group long, block long, v long")).collect()
    want = {name: len(codec.encode_ints(v.astype(np.int64))) for name, v in shapes(1000).items()}
    assert {r.column_name: r.size for r in got} == want


def test_zigzag_expressions(spark):
    v = [0, -1, 1, -2, 2**62, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(x,) for x in v], "v long").withColumn("u", scalar.zigzag(F.col("v")))
    got = df.select("v", "u", scalar.unzigzag(F.col("u")).alias("back"), scalar.bit_length(F.col("u")).alias("w")).collect()
    assert all(r.back == r.v for r in got)
    assert [r.w for r in got] == [0, 1, 2, 2, 64, 64, 64]


def test_name_hash(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return (h ^ h >> 8 ^ h >> 16 ^ h >> 24) & 255

    names = ["", "a", "id", "price_cents", "created_at", "x" * 60]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", scalar.fnv8(F.col("n")).alias("h")).collect()
    assert {r.n: r.h for r in got} == {n: fnv(n) for n in names}


def test_columns_of_many_tables_have_no_bound_on_rows(spark, monkeypatch):
    from tessera.plans import registry

    few = spark.createDataFrame([("c", 36_000_000, 100_000_000)], "column_name string, n long, size long")
    monkeypatch.setattr(registry, "cells_of", lambda *a: None)
    monkeypatch.setattr(registry, "widths_of", lambda *a: None, raising=False)
    monkeypatch.setattr(integers, "costs_of", lambda widths: None, raising=False)
    monkeypatch.setattr(integers, "sizes", lambda costs: few)
    assert registry.QUERIES["cell_budget"](spark, "").first().believed  # 3.6e9 cells, 6.4e9 allowed
    n, size = F.lit(1 << 23).cast("long"), F.lit(1 << 30).cast("long")
    got = spark.range(1).select(scalar.within_budget(n, F.lit(1), size).alias("table"), scalar.cells_within_budget(n, F.lit(1), size).alias("tables")).first()
    assert (got.table, got.tables) == (False, True)


def test_positions_over_many_stretches(spark):
    df = spark.range(5000).select((F.col("id") % 37).alias("a"), F.col("id").alias("b"))
    got = with_positions(df, ["a", "b"], stretch=300).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(5000))
    assert [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in got)


def test_widths_of_rows_are_those_of_cells(spark):
    from tessera.operators.position import cells

    r = np.random.default_rng(5)
    wild = [int(x) if x % 7 else None for x in r.integers(-(2**63), 2**63 - 1, 9000)]
    df = spark.createDataFrame([(k, int(x), w) for k, (x, w) in enumerate(zip(r.integers(-50, 1000, 9000), wild, strict=True))], "k long, small int, wild long")
    rows = with_positions(df, ["k"], grouped=True)
    got, want = integers.row_widths(rows, ["k", "small", "wild"]), integers.block_widths(cells(rows, ["k", "small", "wild"]))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    # one sort by position for all columns, no cell is sorted
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort [row_group" in plan and "Sort [column_name" not in plan


def test_tasks_and_expressions_do_not_grow_with_the_rows(spark):
    from tessera.operators import position

    df = spark.range(3000).select(F.col("id").alias("a"))
    assert [position.parts(df, n) for n in (0, 36_000_000, 216_000_000)] == [1, 90, 540]
    plan = with_positions(df, ["a"], stretch=10)._jdf.queryExecution().analyzed().toString()
    assert plan.count("CASE WHEN") < 10
    assert [r.pos for r in with_positions(df, ["a"], stretch=10).orderBy("a").collect()] == list(range(3000))


def test_positions_with_null_keys_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (None, 3)], "a long, b long")
    assert sorted(r.pos for r in with_positions(df, ["a", "b"], stretch=1).collect()) == [0, 1, 2]
    assert with_positions(df.limit(0), ["a", "b"]).count() == 0


def test_decimal_exceptions_fill_forward(spark):
    v = [1 / 3, 1.25, math.nan, -0.0, 1e300, 2.5]
    rows = [("c", k, 0, 0, x) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "column_name string, pos long, row_group long, block long, v double")
    fixed = spark.createDataFrame([("c", 0, 2)], "column_name string, row_group long, exponent int")
    got = floats.decimals(df, fixed).orderBy("pos").collect()
    assert [r.is_exception for r in got] == [True, False, True, True, True, False]
    assert [r.i for r in got] == [0, 125, 125, 125, 125, 250]


def test_dictionary_of_names_is_refused(spark):
    rows = [("few", k, 0, 0, "ab"[k % 2] * 9) for k in range(100)] + [("all", k, 0, 0, f"name {k}") for k in range(100)] + [("empty", k, 0, 0, "") for k in range(100)]
    got = dictionary.decide(spark.createDataFrame(rows, "column_name string, pos long, row_group long, block long, v string")).collect()
    assert {r.column_name: r.accepted for r in got} == {"few": True, "all": False, "empty": False}


def test_layout_threshold(spark):
    df = spark.createDataFrame([(k, j) for k in (7, 8) for j in range(k)], "k long, j long")
    got = nested.layout(nested.collected(df, "k", ["j"], ["j"]), "k").collect()
    assert {r.k: r.layout for r in got} == {7: "list", 8: "table"}


def test_reconcile_refuses_before_running(spark):
    df = spark.createDataFrame([(1.5, 70000)], "x double, y long")
    with pytest.raises(reconcile.Refused):
        reconcile.reconcile(df, T.StructType([T.StructField("x", T.IntegerType())]))
    with pytest.raises(reconcile.Refused):
        reconcile.reconcile(df, T.StructType([T.StructField("z", T.IntegerType())]))
    small = T.StructType([T.StructField("y", T.ShortType())])
    with pytest.raises(Exception, match="y: value out of range"):
        reconcile.reconcile(df, small).collect()
    assert reconcile.refused_rows(df.withColumn("id", F.lit(3)), small, "id").collect()[0].value == "70000"


def test_reconcile_floats(spark):
    df = spark.createDataFrame([(1e300,), (math.inf,), (1.5,), (None,)], "x double")
    to = T.StructType([T.StructField("x", T.FloatType(), False)])
    with pytest.raises(Exception, match="out of range"):
        reconcile.reconcile(df, to).collect()
    assert [r.x for r in reconcile.reconcile(df.where("x < 1e200 OR x IS NULL OR x = double('Infinity')"), to).collect()] == [math.inf, 1.5, 0.0]


@pytest.mark.parametrize(
    "texts, name, kind, nullable, word",
    [
        (['{"id":1,"note":"hi"}', '{"id":2}'], "note", "string", True, None),
        (['{"v":1}', '{"v":2.5}', '{"v":3}'], "v", "double", False, None),
        (['{"v":18446744073709551615}'], "v", "decimal(20,0)", False, None),
        (['{"qty":1}', '{"qty":"two"}'], "qty", None, False, "type conflict"),
        (['{"v":-1}', '{"v":18446744073709551615}'], "v", None, False, "type conflict"),
        (['{"v":null}'], "v", None, True, "only ever null"),
        (['{"a":9007199254740993}'], "a", "bigint", False, None),
    ],
)
def test_json_inference(spark, texts, name, kind, nullable, word):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.path: r for r in json_rows.infer(df, "id", "t").collect()}[f"$.{name}"]
    assert (got.type, got.nullable) == (kind, nullable)
    assert (got.conflict or "").startswith(word or "") and (word or got.conflict is None)


def test_json_rendering_escapes(spark):
    df = spark.createDataFrame([(1, "a<b>& ", None)], "id long, t string, u string")
    assert json_rows.render(df, "id", ["t", "u"]).collect()[0].json == '{"t":"a\\u003cb\\u003e\\u0026\\u2028","u":null}'


def test_chunks_with_nulls_and_a_data_source(spark, tmp_path):
    rows = [(k, None if k % 3 else k * 1.25, None if k % 5 else f"t{k % 4}", k % 2 == 0) for k in range(5000)]
    df = spark.createDataFrame(rows, "k long, x double, t string, b boolean")
    path = str(tmp_path / "chunks")
    chunks.write(df, path, ["k"])
    assert chunks.read(spark, path, df.schema).exceptAll(df).count() == 0
    assert chunks.read(spark, path, df.schema).count() == 5000
    spark.dataSource.register(chunks.TesseraSource)
    got = spark.read.format("tessera").schema("t string, k long").load(path)
    assert got.columns == ["t", "k"] and got.exceptAll(df.select("t", "k")).count() == 0 and got.count() == 5000


LINES = pa.list_(pa.struct([("sku", pa.string()), ("qty", pa.int32()), ("tags", pa.map_(pa.string(), pa.int64()))]))


def values_of(t):
    """Values of an Arrow type, nulls among them."""
    if pa.types.is_map(t):
        return st.none() | st.dictionaries(values_of(t.key_type).filter(lambda x: x is not None), values_of(t.item_type), max_size=4).map(lambda d: sorted(d.items()))
    if pa.types.is_list(t):
        return st.none() | st.lists(values_of(t.value_type), max_size=12)
    if pa.types.is_struct(t):
        return st.none() | st.fixed_dictionaries({t.field(k).name: values_of(t.field(k).type) for k in range(t.num_fields)})
    of = {pa.string(): st.text(max_size=4), pa.binary(): st.binary(max_size=4), pa.int64(): st.integers(-(2**63), 2**63 - 1), pa.int32(): st.integers(-(2**31), 2**31 - 1), pa.bool_(): st.booleans(),
          pa.float64(): st.floats(allow_nan=False), pa.float32(): st.floats(width=32, allow_nan=False), pa.date32(): st.dates(), pa.decimal128(12, 3): st.decimals(-(10**8), 10**8, places=3), pa.decimal128(30, 2): st.decimals(-(10**20), 10**20, places=2)}
    return st.none() | of[t]


@pytest.mark.parametrize("t", [pa.string(), pa.binary(), pa.int32(), pa.bool_(), pa.float64(), pa.float32(), pa.date32(), pa.decimal128(12, 3), pa.decimal128(30, 2), LINES, pa.map_(pa.string(), LINES), pa.struct([("a", LINES), ("b", pa.float32())])], ids=str)
@given(data=st.data())
@settings(max_examples=40, deadline=None)
def test_columns_of_every_type_survive(t, data):
    values = data.draw(st.lists(values_of(t), max_size=20))
    arr = pa.array(values, t)
    raw = columns.encode(arr)
    back, at = columns.decode(t, raw, len(arr))
    assert at == len(raw) and back.type == t and back.to_pylist() == arr.to_pylist()
    # a part of a longer array is encoded as itself
    assert columns.encode(arr.slice(1)) == columns.encode(pa.array(values[1:], t))


@pytest.mark.parametrize("n", LENGTHS)
def test_floats32_survive_bit_for_bit(n):
    r = np.random.default_rng(n)
    odd = np.resize(np.array([0x7FC00001, 0x7F800001, 0xFFC12345, 0x80000000, 1, 0x7F800000], np.uint32), n).view(np.float32)
    cents = np.round(r.uniform(0, 100, n), 2).astype(np.float32)
    for v in (cents, r.normal(size=n).astype(np.float32), odd, np.where(np.arange(n) % 90 == 0, odd, cents)):
        data = codec.encode_floats32(v)
        back, at = codec.decode_floats32(data, n)
        assert at == len(data) and back.view(np.int32).tolist() == v.view(np.int32).tolist()
    assert n < 128 or len(codec.encode_floats32(cents)) < 2.5 * n


def test_column_damage_is_refused():
    arr = pa.array([["a", "b"], None, ["c"]], pa.list_(pa.string()))
    data = columns.encode(arr)
    for k in range(len(data)):
        with pytest.raises((ValueError, IndexError)):
            back, at = columns.decode(arr.type, data[:k], 3)
            if at != k:  # a shorter column may be read; a chunk must end where its column does
                raise ValueError
            assert back.to_pylist() == arr.to_pylist()
            raise ValueError


def test_chunks_carry_their_schema(spark, tmp_path):
    path = str(tmp_path / "described")
    df = spark.range(9000).select("id", F.array(F.struct((F.col("id") % 5).alias("a"))).alias("rows"), F.create_map(F.lit("k"), F.col("id")).alias("m"), (F.col("id") / 8).cast("float").alias("x"))
    chunks.write(df, path, ["id"])
    back = chunks.read(spark, path)
    assert [(f.name, f.dataType.simpleString()) for f in back.schema.fields] == [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    assert back.select("id", "rows", "x", F.map_entries("m")).exceptAll(df.select("id", "rows", "x", F.map_entries("m"))).count() == 0 and back.count() == 9000
    other = chunks.read_as(spark, path, T.StructType([T.StructField("x", T.DoubleType()), T.StructField("id", T.IntegerType()), T.StructField("gone", T.StringType(), False)]))
    assert other.columns == ["x", "id", "gone"] and other.where("gone = ''").agg(F.sum("id")).first()[0] == 9000 * 8999 // 2


@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_the_data_source_writes(spark, tmp_path, mode):
    path = str(tmp_path / "written")
    spark.dataSource.register(chunks.TesseraSource)
    df = spark.range(0, 10000, 1, 3).select("id", F.concat(F.lit("t"), F.col("id") % 7).alias("t"), F.array("id").alias("a"))
    df.write.format("tessera").mode("append").save(path)
    df.write.format("tessera").mode(mode).save(path)
    back = spark.read.format("tessera").load(path)
    assert back.columns == df.columns
    twice = df.unionByName(df) if mode == "append" else df
    assert back.exceptAll(twice).count() == 0 and back.count() == twice.count()


TYPED = T.StructType([
    T.StructField("i", T.LongType()), T.StructField("f", T.FloatType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("b", T.BinaryType()), T.StructField("ok", T.BooleanType()),
    T.StructField("day", T.DateType()), T.StructField("at", T.TimestampType()), T.StructField("n", T.DecimalType(20, 3)), T.StructField("l", T.ArrayType(T.IntegerType())), T.StructField("m", T.MapType(T.LongType(), T.StringType())),
    T.StructField("rows", T.ArrayType(T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.StringType())]))),
])


def test_messages_of_every_type(spark):
    import datetime
    from decimal import Decimal

    many = [(k, None if k % 2 else f"y{k}") for k in range(20)]
    when = datetime.datetime(2024, 2, 29, 12, 30, 1, 5)
    rows = [
        (-(2**63), 1.5, -0.0, "é😀", b"\x00\xff", True, datetime.date(1, 1, 1), when, Decimal("-12345678901234567.125"), [1, None, -5], {3: "c", -1: None}, many),
        (2**63 - 1, 0.1, 1e300, "", b"", False, datetime.date(9999, 12, 31), when, Decimal("0.001"), [], {}, many[:3]), tuple([None] * 12),
    ]
    df = spark.createDataFrame(rows, TYPED)
    for described in (False, True):
        got = message.messages(df, ["i"], described)
        back = message.rows(got, None if described else df.schema)
        assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]
    plain = message.messages(df, []).collect()
    assert all(message.root(r.message) == "row" for r in plain)
    assert len(plain[2].message) == 3  # root and bitmap
    with pytest.raises(message.Damaged):
        message.split(b"")
    with pytest.raises(message.Damaged):
        message.read(message.Reader(message.split(bytes(plain[0].message))[2][:10]), TYPED)


TREES = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=9) | st.dictionaries(st.text(max_size=3), x, max_size=4), max_leaves=25)


@given(TREES, st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_documents_survive(tree, indent):
    text = json.dumps(tree, indent=indent, ensure_ascii=bool(indent % 2))
    data = message.write_any(jsontext.parse(text))
    r = message.Reader(data)
    back = message.read_any(r)
    assert back == tree and r.at == len(data)
    assert jsontext.difference(jsontext.parse(text), jsontext.parse(json.dumps(back))) is None


def test_uniform_lists_are_tables():
    rows = [{"a": k, "b": f"text {k % 3}"} for k in range(200)]
    table = message.write_any(jsontext.parse(json.dumps(rows)))
    assert table[0] == message.TABLE and message.read_any(message.Reader(table)) == rows
    assert len(table) < len(message.write_any(jsontext.parse(json.dumps([*rows, {}])))) / 5


@pytest.mark.parametrize(("text", "offset", "line"), [('{"é": 1,}', 9, 1), ('[1,\n 2 3]', 7, 2), ('"a', 0, 1), ("", 0, 1), ('{"a" 1}', 5, 1), ("[01]", 2, 1), ("nul", 0, 1), ("1 2", 2, 1), ("[" * 600, 201, 1)])
def test_faults_have_a_place(text, offset, line):
    with pytest.raises(jsontext.Malformed) as e:
        jsontext.parse(text)
    assert (e.value.offset, e.value.line) == (offset, line)


@given(st.text(st.sampled_from('{}[]",:1e-.5tfn ul\\a'), max_size=14))
@settings(max_examples=500, deadline=None)
def test_the_scanner_takes_what_json_is(text):
    try:
        want = json.loads(text, parse_constant=lambda x: 1 / 0)
    except (ValueError, ZeroDivisionError):
        want = ...
    try:
        assert message.read_any(message.Reader(message.write_any(jsontext.parse(text)))) == want
    except jsontext.Malformed:
        assert want is ...


@pytest.mark.parametrize(("a", "b", "path"), [('{"a":1}', '{"a":1.0,"b":0}', None), ('{"a":{"b":null}}', "{}", None), ('{"a":[1,2]}', '{"a":[1,3]}', "$.a[1]"), ('{"a":"x"}', '{"a":""}', "$.a"), ("[]", "[0]", "$"), ("18446744073709551615", "18446744073709551614", "$"), ("9007199254740993", "9007199254740992", "$"), ('{"a":true}', '{"a":1}', "$.a")])
def test_differences_have_a_path(a, b, path):
    found = jsontext.difference(jsontext.parse(a), jsontext.parse(b))
    assert (found and found[0]) == path


def test_conflicts_name_records_and_bytes(spark):
    rows = [(1, '{"a": {"b": 1}}'), (2, '{"a": {"b": "é", "b": "x"}}'), (3, '{"a": 5}'), (4, "{"), (5, None)]
    got = {r.path: r for r in json_rows.infer(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert got["$.a"].conflict == "type conflict at $.a: int in records 3 to 3 from byte 6; object in records 1 to 2 from byte 6"
    assert "int in records 1 to 1 from byte 12; string in records 2 to 2 from byte 23" in got["$.a.b"].conflict
    assert "invalid in records 4 to 4 from byte 1 (no key at byte 1, line 1)" in got["$"].conflict
    assert got["$.a"].n_records == 3 and got["$.a.b"].first_record == 1


_ODD_TEXTS = ['{"a": 1, "b": [1.5, -2]}', '{"a": -1, "b": [1e5, -7]}', '{"a": 2, "b": ["x", null]}', "[-1-9]", "[-10.5]", "01", "00", "[1 2]", '{"a": 18446744073709551615, "a": 9}', '{"a": 99999999999999999999, "a": 3}', '"\\u12"', '{"é": -0, "b": {"c": []}}', '{"é": 0, "b": {"c": []}}', "NaN", "", "-", '{"a": 5, "b": [2.5, -2]}', "[" * 201 + "]" * 201]


def test_texts_of_one_skeleton_add_up(spark):
    """Sums of batches say what single records do, and only one text of each skeleton is read."""
    rows = [(k * 7919 % 400, _ODD_TEXTS[k % len(_ODD_TEXTS)]) for k in range(400)] + [(None, "[true]"), (3, None)]
    df = spark.createDataFrame(rows, "id long, t string").coalesce(2)
    first = F.min(F.struct("record", "place", "offset", "message")).alias("first")
    got = json_rows.summed(df, "id", "t")
    want = json_rows.observations(df, "id", "t").groupBy("path", "kind").agg(F.sum("n").alias("n"), F.bool_or("negative").alias("negative"), F.sum("new").alias("new"), F.max("record").alias("last"), first)
    assert got.count() < json_rows.observations(df, "id", "t").count()
    got = got.groupBy("path", "kind").agg(F.sum("n").alias("n"), F.bool_or("negative").alias("negative"), F.sum("new").alias("new"), F.max("last").alias("last"), first)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_texts_are_read_once(spark):
    df = json_rows.infer(spark.createDataFrame([(1, '{"a": {"b": 1}}'), (2, '{"a": {}}')], "id long, t string"), "id", "t")
    assert {r.path: r.nullable for r in df.collect()} == {"$": False, "$.a": False, "$.a.b": True}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_writers_and_readers_of_a_type():
    t = T._parse_datatype_string("id long, s struct<a: string, x: double, d: decimal(20,3), w: timestamp>, l array<struct<n: int, t: string, f: double>>, m map<string, long>, f float, b boolean, z binary, k array<int>")
    import datetime
    import decimal

    line = [{"n": k * (-1) ** k, "t": "é" * k if k % 3 else None, "f": k / 7} for k in range(9)]
    rows = [
        {"id": -5, "s": {"a": "x" * 200, "x": -0.0, "d": decimal.Decimal("-1.500"), "w": datetime.datetime(2020, 1, 2, tzinfo=datetime.UTC)}, "l": line, "m": {"b": 1, "a": None}, "f": 1.5, "b": True, "z": b"hi", "k": [1, None, 300]},
        {"id": 2**62, "s": None, "l": [line[1], None, line[3]], "m": None, "f": None, "b": None, "z": None, "k": []},
    ]
    for row in rows:
        data = message.write(row, t)
        assert message.writer(t)(row) == data
        r = message.Reader(data)
        got, at = message.reader(t)(data, 0)
        assert repr(got) == repr(message.read(r, t)) and at == r.at == len(data)


@pytest.mark.parametrize("text", [*_ODD_TEXTS, '{"b": 1, "a": [true, null, 1e400, "\\ud800", 18446744073709551615]}', str([{"k": k, "x": 1.5} for k in range(9)]).replace("'", '"'), "[" * 200 + "]" * 200])
def test_documents_by_either_reader(text):
    try:
        want = b"\3" + message.write_any(jsontext.parse(text))
    except jsontext.Malformed as e:
        with pytest.raises(jsontext.Malformed, match=str(e.line)):
            message.document(text)
        return
    assert message.document(text) == want
    got, at = message.read_plain(want, 1)
    assert at == len(want) and repr(got) == repr(message.read_any(message.Reader(want, 1)))
    for cut in range(1, len(want)):
        with pytest.raises((message.Damaged, ValueError, IndexError)):
            message.read_plain(want[:cut], 1)


@pytest.mark.parametrize(("value", "text"), [(1e-6, "0.000001"), (9.5e-7, "9.5e-7"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (-0.0, "-0"), (123.0, "123"), (0.001, "0.001"), (12345678.25, "12345678.25"), (1.5e-10, "1.5e-10"), (5e-324, "4.9e-324"), (-1.25e30, "-1.25e+30")])
def test_numbers_are_spelled(spark, value, text):
    got = spark.createDataFrame([(value,)], "v double").select(json_rows.number_text(F.col("v")).alias("t")).first().t
    assert got == text and float(got) == value


@pytest.mark.parametrize("value", [math.nan, math.inf, -math.inf])
def test_numbers_without_a_spelling_are_refused(spark, value):
    with pytest.raises(Exception, match="has no spelling in JSON"):
        spark.createDataFrame([(value,)], "v double").select(json_rows.number_text(F.col("v"))).collect()


def test_rendering_of_every_type(spark):
    row = spark.sql("SELECT 1 AS id, map(2, 'b', 1, 'a<') AS m, array(1.5D, null) AS l, named_struct('x', binary('hi'), 'y', date'2024-01-02') AS s, timestamp_ntz'2024-01-02 03:04:05.6' AS t, CAST(1.50 AS decimal(5,2)) AS d, CAST(null AS array<int>) AS n")
    assert json_rows.render(row, "id", row.columns).first().json == '{"id":1,"m":{"1":"a\\u003c","2":"b"},"l":[1.5,null],"s":{"x":"aGk=","y":"2024-01-02"},"t":"2024-01-02T03:04:05.600000","d":1.50,"n":null}'


def test_bits_of_doubles(spark):
    values = [0.0, -0.0, 1.0, -1.5, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.pi, -1e300, 0.1, 2.0**60, 2.0**-1022 * (1 - 2.0**-52), 1 / 3, 1 - 2.0**-53, 2 + 2.0**-51]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", floats.double_bits(F.col("v")).alias("b")).orderBy("k").collect()
    assert [r.b for r in got] == np.array(values).view(np.int64).tolist()


@pytest.mark.parametrize("key", ["k", "t", "x", "b", "d"])
def test_positions_in_stretches(spark, key):
    r = np.random.default_rng(2)
    rows = [(int(k) if k % 9 else None, "é" * int(k % 3) + str(k), float(k % 50) - 9, bool(k % 2), k) for k in r.integers(0, 300, 2000).tolist()]
    df = spark.createDataFrame([(*x[:4], float(i), i) for i, x in enumerate(rows)], "k long, t string, x double, b boolean, d double, i long").withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("i") % 40).cast("int")))
    got = with_positions(df, [key, "i"], stretch=100).select(key, "i", "pos", "row_group", "block").orderBy("pos").collect()
    want = df.select(key, "i").orderBy(key, "i").collect()
    assert [(x[0], x.i) for x in got] == [(x[0], x.i) for x in want] and [x.pos for x in got] == list(range(2000))
    assert with_positions(df.limit(0), [key, "i"]).count() == 0


def test_corpus(spark):
    s = corpus.receipts(spark, 300)
    assert s.where("net + vat <> gross").count() == 0
    assert corpus.fingerprint(s).first() == corpus.fingerprint(corpus.receipts(spark, 300).repartition(7)).first()
    assert corpus.fingerprint(s).first() != corpus.fingerprint(corpus.receipts(spark, 301)).first()
    assert corpus.goods(spark, 50).where("cents < 5 OR size(tags) NOT BETWEEN 1 AND 3").count() == 0
    assert corpus.readings(spark, 500).where("celsius IS NULL").count() > 20 and corpus.shops(spark, 10).select("shop").distinct().count() == 10


def test_sections_survive_and_damage_is_refused():
    line = T.StructType([T.StructField("sku", T.StringType(), False), T.StructField("qty", T.IntegerType(), True)])
    root = T.StructType([T.StructField("id", T.LongType(), False, {"id": 3}), T.StructField("lines", T.ArrayType(line)), T.StructField("first", line, True), T.StructField("tags", T.MapType(T.StringType(), T.LongType()))])
    data = schema.section(root)
    back = schema.schema_of(data)
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in back.fields] == [(f.name, f.dataType.simpleString(), f.nullable) for f in root.fields]
    assert schema.field_ids(back) == schema.field_ids(root) and schema.field_ids(root)["id"] == 3
    for k in range(len(data)):
        with pytest.raises(schema.Refused):
            schema.parse(data[:k])
    assert not schema.transposable(root) and schema.transposable(line)
    with pytest.raises(schema.Refused):
        schema.op_of(T.ArrayType(T.ArrayType(T.LongType())))
    with pytest.raises(schema.Refused):
        schema.op_of(T.MapType(T.DoubleType(), T.LongType()))


def test_ids_probe_past_clashes():
    many = T.StructType([T.StructField(f"f{k}", T.LongType()) for k in range(300)])
    ids = schema.field_ids(many)
    assert len(set(ids.values())) == 300 and max(ids.values()) < schema.MOST_FIELDS


def test_arrays(spark):
    df = spark.createDataFrame([([1, 200, 70000],), ([],), (None,), ([-128],)], "a array<long>")
    got = df.select(arrays.narrowest(F.col("a")).alias("w"), arrays.first_unfit(F.col("a"), "smallint").alias("bad"), arrays.decode_slice(arrays.encode_slice("a")).alias("back"), "a").collect()
    assert [r.w for r in got][0] == 4 and got[3].w == 1 and [r.bad for r in got][:2] == [2, None]
    assert all(r.back == r.a for r in got)
    with pytest.raises(Exception, match="element 2 is out of range"):
        df.select(arrays.converted(F.col("a"), "smallint")).collect()
    floats_ = spark.createDataFrame([([0.1, -0.0, 1e300],)], "a array<double>").select(arrays.decode_float_slice(arrays.encode_float_slice("a")).alias("b")).first().b
    assert [str(x) for x in floats_] == ["0.1", "-0.0", "1e+300"]
