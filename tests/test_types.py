import datetime as dt
import decimal

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from columnforge.errors import InvalidError, OutOfBoundsError, UnknownTypeError, UnsupportedError
from columnforge.plans import types
from columnforge.plans.schema import Schema, SchemaBuilder, last_index, require, require_same, to_spark, violations
from columnforge.plans.types import Field, Type, dictionary_of, from_c_format, infer, list_of, struct_of
from columnforge.streaming.messages import from_table

INT, TEXT = Type("int32"), Type("utf8")


def test_units_are_checked():
    for kind, unit in (("time32", "us"), ("time64", "s"), ("timestamp", "h"), ("union", "packed")):
        with pytest.raises(InvalidError):
            Type(kind, unit)


def test_predicates_of_encodings():
    nested = dictionary_of(INT, list_of(TEXT))
    assert nested.is_nested and not dictionary_of(INT, TEXT).is_nested
    ends = Type("run_end_encoded", fields=(Field("run_ends", INT, False), Field("values", struct_of(Field("a", INT)))))
    assert ends.is_nested
    with pytest.raises(InvalidError):
        dictionary_of(TEXT, TEXT)


def test_strides():
    assert [Type(k).stride for k in ("bool", "int16", "float64", "utf8", "date32", "date64")] == [1, 2, 8, 1, 4, 8]
    assert struct_of().stride == 0
    for t in (Type("null"), Type("float16"), Type("decimal128", precision=3, scale=1)):
        with pytest.raises(UnsupportedError):
            t.stride


def test_c_formats_back_and_forth():
    for t in [Type(k) for k in (*types.SIGNED, *types.UNSIGNED, "float32", "float64", "bool", "date32", "date64", "binary", "utf8")] + [Type("time32", "s"), Type("time64", "ns"), Type("timestamp", "ms"), Type("timestamp", "ns", "Asia/Tokyo")]:
        assert from_c_format(t.c_format()) == t
    for text in ("+l", "q", ""):
        with pytest.raises(UnsupportedError):
            from_c_format(text)
    with pytest.raises(InvalidError):
        from_c_format("tsx")
    with pytest.raises(UnsupportedError):
        Type("float16").c_format()


def test_fields():
    f = Field("a", INT).with_metadata({types.EXTENSION_NAME: "uuid", types.EXTENSION_METADATA: "v1"})
    assert (f.extension_name, f.extension_metadata) == ("uuid", "v1")
    assert f.with_name("b").name == "b" and not f.with_nullable(False).nullable and f.with_type(TEXT).type == TEXT
    ordered = Field("d", dictionary_of(INT, TEXT), ordered=True)
    assert ordered.dict_is_ordered and not Field("d", INT, ordered=True).dict_is_ordered
    assert ordered == Field("d", dictionary_of(INT, TEXT)) and not ordered.contains(Field("d", dictionary_of(INT, TEXT)))


def test_schema_lookups():
    s = SchemaBuilder().add("a", INT).add("b", TEXT, False, {"k": "v"}).add("a", TEXT).finish()
    assert s.index("a") == 2 and s.index("c") is None and s.field(1).metadata == (("k", "v"),)
    with pytest.raises(OutOfBoundsError):
        s.field(3)
    assert s.contains(s) and not s.contains(Schema(s.fields[:2]))
    read = Schema.from_arrow(pa.schema([pa.field("x", pa.int8(), metadata={"k": "v"})], {"origin": "test"}))
    assert read.metadata == {"origin": "test"} and read.fields[0].metadata == (("k", "v"),)


def test_inference():
    assert [infer(v).kind for v in (True, "a", b"a", 1.5, dt.datetime(2020, 1, 1))] == ["bool", "utf8", "binary", "float64", "date64"]
    with pytest.raises(UnknownTypeError):
        infer(1)


def test_widening(spark):
    """Every type that Spark lacks comes in with its values."""
    day = dt.date(2021, 1, 2)
    table = pa.table(
        {
            "u8": pa.array([255, None], pa.uint8()),
            "u64": pa.array([2**64 - 1, 0], pa.uint64()),
            "f16": pa.array([1.5, None], pa.float16()),
            "d64": pa.array([day, None], pa.date64()),
            "t32": pa.array([dt.time(1, 2, 3), None], pa.time32("s")),
            "ns": pa.array([1_234_567_891, None], pa.timestamp("ns")),
            "s": pa.array([day, None]).cast(pa.timestamp("s")),
            "zoned": pa.array([0, None], pa.timestamp("ms", "America/New_York")),
            "fsb": pa.array([b"123", None], pa.binary(3)),
            "view": pa.array(["a", None], pa.string_view()),
            "coded": pa.array(["x", "x"]).dictionary_encode(),
            "ree": pa.RunEndEncodedArray.from_arrays([2], ["r"]),
            "fixed": pa.array([[1, 2], None], pa.list_(pa.uint16(), 2)),
            "big": pa.array([["a", None], []], pa.large_list(pa.large_string())),
            "nest": pa.array([{"a": [1, 2]}, None], pa.struct([("a", pa.list_(pa.uint8()))])),
            "map": pa.array([[("k", 1)], None], pa.map_(pa.string(), pa.uint8())),
            "dec": pa.array([decimal.Decimal("1.25"), None], pa.decimal128(5, 2)),
            "void": pa.nulls(2),
        }
    )
    df = from_table(spark, table)
    first, second = df.collect()
    assert (first.u8, int(first.u64), first.f16, first.ns, bytes(first.fsb), first.view, first.coded, first.ree) == (255, 2**64 - 1, 1.5, 1_234_567_891, b"123", "a", "x", "r")
    assert first.fixed == [1, 2] and second.fixed is None and first.big == ["a", None] and second.big == []
    assert first.nest.a == [1, 2] and second.nest is None and first.map == {"k": 1} and first.dec == decimal.Decimal("1.25")
    assert first.d64.isoformat().startswith("2021-01-02") and first.zoned.timestamp() == 0 and second.zoned is None
    assert isinstance(df.schema["s"].dataType, T.TimestampNTZType) and isinstance(df.schema["zoned"].dataType, T.TimestampType)
    assert df.schema["u8"].metadata["logical"] == "UInt8" and df.schema["fsb"].metadata["logical"] == "FixedSizeBinary(3)"


def test_union_and_interval_values():
    union = pa.UnionArray.from_sparse(pa.array([0, 1], pa.int8()), [pa.array([7, 8]), pa.array(["a", "b"])], ["n", "t"])
    assert types.legalise(union).to_pylist() == [{"type_id": 0, "n": 7, "t": None}, {"type_id": 1, "n": None, "t": "b"}]
    span = pa.array([pa.MonthDayNano([1, 2, 3]), None])
    assert types.legalise(span).to_pylist() == [{"months": 1, "days": 2, "nanoseconds": 3}, None]
    assert types.legalise(pa.array([[1, 2], None, []], pa.list_view(pa.int32()))).to_pylist() == [[1, 2], None, []]
    with pytest.raises(UnsupportedError):
        types.legal_arrow(pa.decimal256(60, 2))


def test_logical_types_of_all_arrow_types():
    kinds = [pa.null(), pa.bool_(), pa.uint32(), pa.float16(), pa.date64(), pa.time32("ms"), pa.time64("ns"), pa.timestamp("s", "UTC"), pa.duration("us"), pa.month_day_nano_interval(), pa.decimal64(9, 2), pa.binary(4), pa.large_binary(), pa.string_view(), pa.list_(pa.int8()), pa.list_(pa.int8(), 3), pa.large_list(pa.int8()), pa.list_view(pa.int8()), pa.struct([("a", pa.int8())]), pa.map_(pa.string(), pa.int8()), pa.dense_union([pa.field("a", pa.int8())]), pa.dictionary(pa.int8(), pa.string()), pa.run_end_encoded(pa.int16(), pa.string())]
    for t in kinds:
        own = types.from_arrow(t)
        assert own.equals(own) and own.contains(own) and str(own)


def test_nullability(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert [tuple(r) for r in violations(df, ["k", "v"]).collect()] == [("v", 1)]
    assert violations(df, []).count() == 0
    assert require(df, ["k"]).count() == 2
    with pytest.raises(Exception, match="v: null where none is allowed"):
        require(df, ["v"]).collect()
    with pytest.raises(InvalidError):
        require_same([df, df.select("k", "k")])
    assert last_index(df.select("k", "v", "k"), "k") == 2
    assert to_spark(pa.schema([pa.field("x", pa.uint8(), False)])) == T.StructType([T.StructField("x", T.ShortType(), False, {"logical": "UInt8"})])
