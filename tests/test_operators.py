import datetime as dt
import random
from dataclasses import dataclass
from typing import Annotated

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from columnforge.errors import InvalidError, NoElementsError, OutOfBoundsError, UnknownTypeError
from columnforge.functions import layout, render
from columnforge.operators import codec, frame, nested


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(7)
    rows = [(k, rng.randrange(100) if rng.random() > 0.3 else None, "x" * rng.randrange(5) if rng.random() > 0.5 else None) for k in range(1000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k int, v int, s string").repartition(7), sorted(rows)


def test_slices_and_rows(numbers, monkeypatch):
    df, rows = numbers
    for limit in (frame.TOP_ROWS, 0):  # as a top-k, and by global index
        monkeypatch.setattr(frame, "TOP_ROWS", limit)
        for offset, length in ((0, 3), (990, 50), (5, 0), (1000, 1)):
            assert sorted(tuple(r) for r in frame.slice_rows(df, ["k"], offset, length).collect()) == rows[offset : offset + length]
        twice = frame.slice_rows(frame.slice_rows(df, ["k"], 100, 50), ["k"], 10, 5)
        assert sorted(tuple(r) for r in twice.collect()) == rows[110:115]
    with pytest.raises(OutOfBoundsError):
        frame.slice_rows(df, ["k"], -1, 2)
    assert frame.nth_row(df, ["k"], 17).first()[0] == 17 and frame.nth_row(df, ["k"], 5000).count() == 0


def test_index_and_running_sums(numbers):
    df, rows = numbers
    assert sorted((r.k, r.row_index) for r in frame.with_index(df, ["k"]).collect()) == [(k, k) for k in range(1000)]
    total, want = 0, {}
    for k, _, s in rows:
        want[k] = (total, total + len(s or ""))
        total += len(s or "")
    got = layout.offsets(df, F.octet_length("s"), ["k"], "k")
    assert {r.k: (r.begin, r.end) for r in got.collect()} == want


@pytest.mark.parametrize("density", [0, 0.1, 0.5, 0.9, 1.0])
def test_nulls_and_buffers(spark, density):
    rng = random.Random(int(density * 10))
    rows = [(k, None if rng.random() < density else rng.choice(["", "é", "🙂", "x" * 100])) for k in range(203)]
    df = spark.createDataFrame(rows, "k int, s string")
    nulls = sum(s is None for _, s in rows)
    assert {r.column: (r.rows, r.nulls) for r in frame.null_counts(df).collect()} == {"k": (203, 0), "s": (203, nulls)}
    assert {r.column: r.bytes for r in layout.validity_bytes(df, ["s"]).collect()} == {"s": 0 if nulls in (0, 203) else 26}
    bits = {r.byte: r.bits for r in layout.validity_bits(df, "s", ["k"]).collect()}
    assert all((bits[k // 8] >> (k % 8) & 1) == (s is not None) for k, s in rows)
    sizes = {r.column: (r["values"], r.offsets) for r in layout.buffer_sizes(df, {"k": 4}, ["s"]).collect()}
    assert sizes == {"k": (812, 0), "s": (sum(len((s or "").encode()) for _, s in rows), 816)}


def test_columns(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "k int, v string, w double").select("k", "v", F.col("w").alias("k"))
    assert frame.column_by_name(df, "k").first()[0] == 2.0 and frame.column_by_name(df, "none") is None
    assert [tuple(r) for r in frame.columns_by_index(df, [0, 2, 0]).collect()] == [(1, 2.0, 1)]
    with pytest.raises(OutOfBoundsError):
        frame.columns_by_index(df, [3])
    with pytest.raises(InvalidError):
        frame.typed_column(df, "v", T.BinaryType())
    with pytest.raises(InvalidError):
        frame.typed_column(df, "none", T.IntegerType())


def test_concat_and_chunks(spark):
    a, b = spark.createDataFrame([(1,), (None,)], "v int"), spark.createDataFrame([], "v int")
    assert frame.concat([a, b, a]).count() == 4
    assert sorted(tuple(r) for r in frame.chunk_stats([a, b, a], "v").collect()) == [(0, 2, 1), (2, 2, 1)]
    with pytest.raises(NoElementsError):
        frame.concat([])
    with pytest.raises(InvalidError):
        frame.concat([a, a.select(F.col("v").cast("long"))])
    with pytest.raises(InvalidError):
        frame.batch_lengths({})


def test_assemble(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType(), False)])
    assert frame.assemble({"a": [1, None], "b": ["x", "y"]}, schema, spark).count() == 2
    for bad in ({"a": [1], "b": ["x", "y"]}, {"a": [1], "b": [None]}, {}):
        with pytest.raises((InvalidError, ValueError)):
            frame.assemble(bad, schema, spark)


def test_rendering(spark):
    ts = dt.datetime(2021, 1, 1, 12, 34, 56, 789123)
    df = spark.createDataFrame([(ts, bytearray(b"a\xff"), bytearray(b"ok"), [1, None], (1, None)), (None,) * 5], "t timestamp, bad binary, good binary, l array<int>, s struct<x:int,y:string>")
    got = df.select(
        render.timestamp_string("t").alias("a"), render.timestamp_string("t", zone="America/New_York").alias("b"), render.timestamp_string("t", "yyyy").alias("c"), render.binary_string("bad").alias("d"), render.binary_string("bad", True).alias("e"),
        render.binary_string("good").alias("f"), render.list_string("l").alias("g"), render.struct_string("s", ["x", "y"]).alias("h"), render.as_string("t").alias("i"),
    ).collect()
    assert tuple(got[0])[:8] == ("2021-01-01 12:34:56.789", "2021-01-01 07:34:56.789", "2021", "<unprintable>", "61ff", "ok", "[1,null]", "{1,}")
    assert tuple(got[1]) == ("", "", "", "", "", "", "null", "", "")


def test_instants_before_1970(spark):
    df = spark.createDataFrame([(dt.datetime(1969, 12, 31, 12, 0, 0, 1500),), (dt.datetime(2040, 1, 1),)], "t timestamp_ntz")
    got = [tuple(r) for r in df.select(render.date32("t"), render.date64("t"), render.epoch("t", "s"), render.time_of_day("t", "s"), render.from_date32(render.date32("t"))).collect()]
    assert got == [(-1, -43199999, -43200, 43200, dt.date(1969, 12, 31)), (25567, 2208988800000, 2208988800, 0, dt.date(2040, 1, 1))]
    ns = spark.range(1).select(render.instant(F.lit(-1), "ns").cast("timestamp_ntz"), render.instant(F.lit(1_234_567_891), "ns").cast("timestamp_ntz")).first()
    assert tuple(ns) == (dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1970, 1, 1, 0, 0, 1, 234567))


def test_bits(spark):
    df = spark.createDataFrame([(bytearray([0b101, 0b10000000]),)], "b binary")
    assert [df.select(render.bit("b", F.lit(k))).first()[0] for k in (0, 1, 2, 7, 8, 15)] == [1, 0, 1, 0, 0, 1]
    assert tuple(spark.range(1).select(render.with_bit(F.lit(4), F.lit(1), True), render.with_bit(F.lit(6), F.lit(1), False), render.aligned(F.lit(0)), render.aligned(F.lit(65)), render.aligned(F.lit(8), 8)).first()) == (6, 4, 0, 128, 8)


def test_nested(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None)], "k int, l array<int>")
    assert [tuple(r) for r in nested.list_values(df, "l", "k").collect()] == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]
    got = df.select(nested.child_slice("l", 1, 5).alias("a"), nested.element("l", 2).alias("b"), nested.fixed_size("l", 3).alias("c")).collect()
    assert [tuple(r) for r in got] == [([2, 3], 3, True), ([], None, False), (None, None, None)]
    assert nested.build_lists(df, [], "k", "k").first()[0] == [1, 2, 3]
    wide = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "b binary")
    assert wide.select(nested.require_width(F.col("b"), 3)).count() == 2
    with pytest.raises(Exception, match="not 2 bytes wide"):
        wide.select(nested.require_width(F.col("b"), 2)).collect()


@dataclass
class Person:
    name: str
    score: float | None


@dataclass
class Sized:
    n: Annotated[int, T.ShortType()]
    t: dt.date | None
    raw: bytes


@dataclass
class Bare:
    n: int


def test_schema_of_a_class(spark):
    schema = codec.schema_of(Sized)
    assert schema == T.StructType([T.StructField("n", T.ShortType(), False), T.StructField("t", T.DateType()), T.StructField("raw", T.BinaryType(), False)])
    df = codec.encode(spark, [Sized(1, None, b"x"), Sized(2, dt.date(2020, 1, 1), b"")], schema)
    assert [r[:2] for r in codec.decode_rows(df)] == [(1, None), (2, dt.date(2020, 1, 1))]
    with pytest.raises(UnknownTypeError):
        codec.schema_of(Bare)


def test_codec(spark):
    people = [Person("a", 1.5), Person("b", None)]
    df = codec.encode(spark, people)
    assert df.columns == ["name", "score"] and list(codec.decode(df, Person)) == people
    assert codec.encode(spark, []) is None
    with pytest.raises(UnknownTypeError):
        codec.encode(spark, [{"n": 1}])
    with pytest.raises(UnknownTypeError):
        codec.encode(spark, [{"n": None}])
    with pytest.raises(InvalidError):
        list(codec.decode(df.withColumn("name", F.lit(None).cast("string")), Person))
    with pytest.raises(InvalidError):
        list(codec.decode(df.select("name"), Person))
    with pytest.raises(InvalidError):
        codec.encode(spark, [{"n": None}], T.StructType([T.StructField("n", T.IntegerType(), False)]))
    values = codec.encode_values(spark, [1, None, 3], T.IntegerType())
    assert values.columns == ["col0"] and list(codec.decode_column(values, optional=True)) == [1, None, 3]
    with pytest.raises(InvalidError):
        list(codec.decode_column(values))
    mapped = codec.encode_map(spark, {1: "a", 2: None}, T.ByteType(), T.StringType())
    assert {r.key: r.value for r in codec.decode_map(mapped).collect()} == {1: "a", 2: None}
    pairs = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k int, v string, o int")
    assert codec.decode_map(pairs, ["o"]).collect() == [(1, "new")]
    with pytest.raises(InvalidError):
        codec.decode_map(pairs)


@pytest.mark.parametrize("partitions", [8, 200])
def test_positions_of_wide_tables(spark, partitions):
    """All columns kept, at sf0.1, with small partitions coalesced at run time: each row once, at its place."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        n = lines.count()
        got = frame.with_index(lines, order)
        top = got.agg(F.count("*"), F.count_distinct("row_index"), F.min("row_index"), F.max("row_index")).first()
        assert tuple(top) == (n, n, 0, n - 1) and got.drop("row_index").exceptAll(lines).isEmpty()
        orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
        assert frame.nth_row(orders, ["o_orderkey"], 130_000).collect() == orders.orderBy("o_orderkey").offset(130_000).limit(1).collect()
        assert frame.slice_rows(lines, order, 400_000, 5).collect() == lines.orderBy(*order).offset(400_000).limit(5).collect()
        sums = frame.prefix_sums(orders.withColumn("k", F.col("o_orderkey") % 7), "k", ["o_orderkey"])
        assert sums.agg(F.count("*"), F.max("running")).first() == orders.agg(F.count("*"), F.sum(F.col("o_orderkey") % 7)).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_positions_of_odd_tables(spark):
    rows = spark.createDataFrame([(2, None), (1, None), (3, 5), (4, None)], "k int, v int")
    assert [r.running for r in frame.prefix_sums(rows, "v", ["k"]).orderBy("k").collect()] == [None, None, 5, 5]
    twice = rows.select("k", F.col("v").alias("k"))
    assert sorted((r[1] is None, r[2]) for r in frame.with_index(twice, ["k"]).collect())[0] == (False, 3)
    assert frame.with_index(rows.limit(0), ["k"]).count() == 0 and frame.slice_rows(rows, ["k"], 9, 2, top_rows=0).count() == 0
    with pytest.raises(InvalidError):
        frame.with_index(rows, ["nope"])
