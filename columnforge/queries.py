"""The catalogue of queries over the columnar operators, each with the DuckDB SQL of the same result."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from datetime import datetime

import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ColumnError, SourceError
from .functions import layout, render
from .operators import codec, frame, nested
from .plans import flightsql, types
from .plans.schema import SchemaBuilder, violations
from .plans.types import Field, Type, list_of, struct_of
from .sources import cdata, flight, ipc, shared
from .streaming import messages

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values_sql(rows: list[tuple], columns: list[str]) -> str:
    """A literal relation."""
    show = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({', '.join(columns)})"


def exchange_dir(spark: SparkSession) -> str:
    """A folder for files that are written and read again."""
    return shared.new_path(spark, "exchange")


# rows, columns, nulls


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%g') AS order_date, coalesce(o_orderstatus, '') AS status, coalesce(o_orderpriority, '') AS priority
FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 5""")
def slice_rows(spark, sf_dir):
    rows = frame.slice_rows(table(spark, sf_dir, "orders"), ["o_orderkey"], 5, 5)
    return rows.select("o_orderkey", render.timestamp_string("o_orderdate").alias("order_date"), render.as_string("o_orderstatus").alias("status"), render.as_string("o_orderpriority").alias("priority"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 3 OFFSET 12")
def slice_of_slice(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return frame.slice_rows(frame.slice_rows(rows, ["o_orderkey"], 10, 20), ["o_orderkey"], 2, 3)


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (ORDER BY event_id) = 42")
def nth_row(spark, sf_dir):
    return frame.nth_row(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["event_id"], 41)


@query("SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders")
def row_index(spark, sf_dir):
    return frame.with_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"SELECT *, row_number() OVER (ORDER BY {', '.join(_LINE_ORDER)}) - 1 AS row_index FROM lineitem")
def row_index_wide(spark, sf_dir):
    return frame.with_index(table(spark, sf_dir, "lineitem"), _LINE_ORDER)


_DEEP = "(SELECT count(*) * 9 // 10 FROM lineitem)"


@query(f"SELECT * EXCLUDE i FROM (SELECT *, row_number() OVER (ORDER BY {', '.join(_LINE_ORDER)}) - 1 AS i FROM lineitem) WHERE i >= {_DEEP} AND i < {_DEEP} + 7")
def slice_deep(spark, sf_dir):
    """A slice that begins after nine tenths of the rows, found by the global index."""
    rows = table(spark, sf_dir, "lineitem")
    return frame.slice_rows(rows, _LINE_ORDER, rows.count() * 9 // 10, 7, top_rows=0)


@query("""SELECT doc_id, text, lang, source, e - coalesce(octet_length(encode(text)), 0) AS "begin", e AS "end"
FROM (SELECT *, sum(coalesce(octet_length(encode(text)), 0)) OVER (ORDER BY doc_id)::BIGINT AS e FROM documents)""")
def offsets_wide(spark, sf_dir):
    return layout.offsets(table(spark, sf_dir, "documents"), F.octet_length("text"), ["doc_id"], "doc_id", "text", "lang", "source")


@query("SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i IN (0, 5000, 9999)")
def chunked_access(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    chunks = frame.concat([orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1")])
    return frame.with_index(chunks, ["o_orderkey"]).where(F.col("row_index").isin(0, 5000, 9999)).drop("row_index")


_HOLES = "SELECT nullif(o_orderstatus, 'F') AS status, nullif(o_orderpriority, '1-URGENT') AS priority, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price, o_orderkey FROM orders"


def _holes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("status"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"), "o_orderkey")


@query(f"""WITH h AS ({_HOLES}) SELECT 'status' AS "column", count(*) AS rows, count(*) - count(status) AS nulls FROM h
UNION ALL SELECT 'priority', count(*), count(*) - count(priority) FROM h UNION ALL SELECT 'price', count(*), count(*) - count(price) FROM h UNION ALL SELECT 'o_orderkey', count(*), count(*) - count(o_orderkey) FROM h""")
def null_counts(spark, sf_dir):
    return frame.null_counts(_holes(spark, sf_dir))


@query(f"WITH h AS ({_HOLES}) SELECT o_orderkey, status IS NULL AS status_is_null, price IS NULL AS price_is_null FROM h")
def null_mask(spark, sf_dir):
    return _holes(spark, sf_dir).select("o_orderkey", *frame.null_mask("status", "price"))


@query(f"""WITH h AS ({_HOLES}), s AS (SELECT * FROM h ORDER BY o_orderkey LIMIT 100 OFFSET 50)
SELECT 'status' AS "column", count(*) AS rows, count(*) - count(status) AS nulls FROM s UNION ALL SELECT 'price', count(*), count(*) - count(price) FROM s""")
def slice_null_counts(spark, sf_dir):
    return frame.null_counts(frame.slice_rows(_holes(spark, sf_dir), ["o_orderkey"], 50, 100), ["status", "price"])


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey < 1000
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 5000
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey >= 5000 OR o_orderkey IS NULL""")
def concat_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    return frame.concat([rows.where(k < 1000), rows.where((k >= 1000) & (k < 5000)), rows.where((k >= 5000) | k.isNull())])


@query(f"WITH h AS ({_HOLES}) SELECT (o_orderkey % 3)::INTEGER AS chunk, count(*) AS length, count(*) - count(status) AS nulls FROM h GROUP BY 1")
def chunk_stats(spark, sf_dir):
    rows = _holes(spark, sf_dir)
    return frame.chunk_stats([rows.where(f"o_orderkey % 3 = {k}") for k in range(3)], "status")


@query("SELECT o_totalprice FROM orders")
def project_by_name(spark, sf_dir):
    return frame.column_by_name(table(spark, sf_dir, "orders"), "o_totalprice")


@query("SELECT o_orderdate, o_orderkey FROM orders")
def project_by_index(spark, sf_dir):
    return frame.columns_by_index(table(spark, sf_dir, "orders"), [4, 0])


@query("SELECT o_totalprice AS o_orderkey FROM orders")
def duplicate_name_last(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("o_orderkey"))
    return frame.column_by_name(rows, "o_orderkey")


@query("SELECT o_custkey FROM orders")
def typed_column(spark, sf_dir):
    return frame.typed_column(table(spark, sf_dir, "orders"), "o_custkey", T.LongType())


@query("""SELECT 'orders' AS "column", count(*) AS length FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events""")
def batch_length_check(spark, sf_dir):
    return frame.batch_lengths({n: table(spark, sf_dir, n) for n in ("orders", "customer", "events")})


@query(f"""WITH h AS ({_HOLES}) SELECT * FROM (SELECT 'status' AS "column", count(*) - count(status) AS nulls FROM h UNION ALL SELECT 'o_orderkey', count(*) - count(o_orderkey) FROM h UNION ALL SELECT 'price', count(*) - count(price) FROM h) WHERE nulls > 0""")
def nullability_check(spark, sf_dir):
    return violations(_holes(spark, sf_dir), ["status", "price", "o_orderkey"])


# scalar conversions


@query("SELECT o_orderkey, (o_orderkey % 256)::UTINYINT::SMALLINT AS u8, (o_orderkey % 65536)::USMALLINT::INTEGER AS u16, o_custkey::UINTEGER::BIGINT AS u32, o_orderkey::UBIGINT::DECIMAL(20,0)::VARCHAR AS u64 FROM orders")
def widen_unsigned(spark, sf_dir):
    k = F.col("o_orderkey")
    kinds = [types.spark_type(t) for t in (pa.uint8(), pa.uint16(), pa.uint32(), pa.uint64())]
    return table(spark, sf_dir, "orders").select("o_orderkey", (k % 256).cast(kinds[0]).alias("u8"), (k % 65536).cast(kinds[1]).alias("u16"), F.col("o_custkey").cast(kinds[2]).alias("u32"), k.cast(kinds[3]).cast("string").alias("u64"))


@query("SELECT event_id, floor(epoch_us(ts) / 86400000000)::INTEGER AS days, strftime(ts, '%Y-%m-%d') AS day FROM events")
def date32_days(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", render.date32("ts").alias("days"), render.as_string(render.from_date32(render.date32("ts"))).alias("day"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS millis FROM events")
def date64_millis(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", render.date64("ts").alias("millis"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS seconds FROM events")
def date64_to_seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", render.epoch(render.instant(render.date64("ts"), "ms"), "s").alias("seconds"))


@query("SELECT event_id, epoch_us(ts) % 86400000000 AS micros, (epoch_us(ts) % 86400000000) // 1000 AS millis FROM events")
def time_of_day(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", render.time_of_day("ts").alias("micros"), render.time_of_day("ts", "ms").alias("millis"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us, epoch_us(ts) * 1000 AS ns FROM events")
def timestamp_units(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *(render.epoch("ts", u).alias(u) for u in ("s", "ms", "us", "ns")))


@query("SELECT event_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS from_s, make_timestamp(epoch_us(ts) // 1000 * 1000) AS from_ms, ts AS from_ns FROM events")
def unit_instants(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", *(render.instant(render.epoch("ts", u), u).cast("timestamp_ntz").alias(f"from_{u}") for u in ("s", "ms", "ns")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS text FROM events")
def timestamp_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", render.timestamp_string("ts").alias("text"))


@query("SELECT event_id, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S.%g') AS text FROM events")
def timestamp_tz_shift(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", render.timestamp_string("ts", zone="America/New_York").alias("text"))


@query(f"WITH h AS ({_HOLES}) SELECT o_orderkey, coalesce(status, '') AS status, coalesce(priority, '') AS priority FROM h")
def render_nullable(spark, sf_dir):
    return _holes(spark, sf_dir).select("o_orderkey", render.as_string("status").alias("status"), render.as_string("priority").alias("priority"))


@query("SELECT c_custkey, lower(hex(encode(c_name))) AS hex, c_name AS text FROM customer")
def binary_hex(spark, sf_dir):
    data = render.to_bytes("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", render.binary_string(data, as_hex=True).alias("hex"), render.binary_string(data).alias("text"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes, length(text)::BIGINT AS chars, text = decode(encode(text)) AS same FROM documents")
def utf8_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.char_length("text").cast("long").alias("chars"), (render.from_bytes(render.to_bytes("text")) == F.col("text")).alias("same"))


@query("SELECT c_custkey, c_name[1:3] AS v0, c_name[4:6] AS v1 FROM customer")
def fixed_binary_chunks(spark, sf_dir):
    data = render.to_bytes("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", *(render.from_bytes(nested.require_width(nested.fixed_bytes(data, 3, k), 3)).alias(f"v{k}") for k in (0, 1)))


@query("SELECT c_custkey, (ascii(c_name[2:2]) >> 3) & 1 AS bit11, (c_nationkey | 8)::INTEGER AS on3, (c_nationkey & ~1)::INTEGER AS off0 FROM customer")
def bit_access(spark, sf_dir):
    k = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", render.bit(render.to_bytes("c_name"), F.lit(11)).alias("bit11"), render.with_bit(k, F.lit(3), True).cast("int").alias("on3"), render.with_bit(k, F.lit(0), False).cast("int").alias("off0"))


@query("SELECT doc_id, ((n_chars + 63) // 64) * 64 AS aligned64, ((n_chars + 7) // 8) * 8 AS padded8 FROM documents")
def alignment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", render.aligned("n_chars").alias("aligned64"), render.aligned("n_chars", 8).alias("padded8"))


# lists, structs, maps


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'null' ELSE '[' || o_orderkey || ',' || coalesce(nullif(o_orderstatus, 'F'), 'null') || ']' END AS text FROM orders")
def list_render(spark, sf_dir):
    made = F.when(F.col("o_custkey") % 5 != 0, F.array(F.col("o_orderkey").cast("string"), F.nullif("o_orderstatus", F.lit("F"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", render.list_string(made).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE '{' || o_custkey || ',' || coalesce(nullif(o_orderstatus, 'F'), '') || '}' END AS text FROM orders")
def struct_render(spark, sf_dir):
    made = nested.build_struct({"c": F.col("o_custkey"), "s": F.nullif("o_orderstatus", F.lit("F"))}, F.col("o_custkey") % 5 != 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("s")).select("o_orderkey", render.struct_string("s", ["c", "s"]).alias("text"))


@query("SELECT vec_id, (unnest(range(len(embedding))))::INTEGER AS pos, unnest(embedding) AS value FROM embeddings")
def list_values(spark, sf_dir):
    return nested.list_values(table(spark, sf_dir, "embeddings"), "embedding", "vec_id")


@query("SELECT vec_id, unnest(range(4))::INTEGER AS pos, unnest(embedding[3:6]) AS value FROM embeddings")
def list_child_slice(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", nested.child_slice("embedding", 2, 4).alias("part"))
    return nested.list_values(rows, "part", "vec_id")


@query("SELECT vec_id, embedding[1] AS first, embedding[64] AS last, embedding[65] AS beyond FROM embeddings")
def list_element(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", nested.element("embedding", 0).alias("first"), nested.element("embedding", 63).alias("last"), nested.element("embedding", 64).alias("beyond"))


@query("SELECT vec_id, len(embedding) = 64 AS fits FROM embeddings")
def fixed_list_check(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", nested.fixed_size("embedding", 64).alias("fits"))


@query("SELECT user_id, array_to_string(list(event_type ORDER BY event_id), ',') AS kinds, count(*) AS n FROM events GROUP BY user_id")
def list_build(spark, sf_dir):
    rows = nested.build_lists(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", "kinds")
    return rows.select("user_id", F.array_join("kinds", ",").alias("kinds"), F.size("kinds").cast("long").alias("n"))


def _customers(spark, sf_dir):
    made = nested.build_struct({"name": F.col("c_name"), "nation": F.col("c_nationkey")}, F.col("c_acctbal") >= 0)
    return table(spark, sf_dir, "customer").select("c_custkey", made.alias("s"))


@query("SELECT c_custkey, struct_pack(name := c_name, nation := c_nationkey).name AS name, struct_pack(name := c_name, nation := c_nationkey).nation AS nation FROM customer")
def struct_build(spark, sf_dir):
    made = nested.build_struct({"name": F.col("c_name"), "nation": F.col("c_nationkey")})
    return table(spark, sf_dir, "customer").select("c_custkey", made.alias("s")).select("c_custkey", "s.name", "s.nation")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_name END AS name, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS nation FROM customer")
def struct_fields(spark, sf_dir):
    return _customers(spark, sf_dir).select("c_custkey", "s.*")


@query("SELECT c_custkey, c_acctbal < 0 AS is_null FROM customer")
def struct_null(spark, sf_dir):
    return _customers(spark, sf_dir).select("c_custkey", F.col("s").isNull().alias("is_null"))


@query("SELECT c_custkey, unnest(['name', 'nation']) AS key, unnest([c_name, c_nationkey::VARCHAR]) AS value FROM customer WHERE c_acctbal >= 0")
def struct_as_map(spark, sf_dir):
    rows = _customers(spark, sf_dir).where("s IS NOT NULL").select("c_custkey", nested.struct_map("s", ["name", "nation"]).alias("m"))
    return codec.explode_map(rows, "m", "c_custkey")


@query("SELECT event_id, unnest(['type', 'user']) AS key, unnest([event_type, user_id::VARCHAR]) AS value FROM events")
def map_encode(spark, sf_dir):
    made = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    return codec.explode_map(table(spark, sf_dir, "events").select("event_id", made.alias("m")), "m", "event_id")


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id")
def map_decode(spark, sf_dir):
    return codec.decode_map(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["event_id"])


# buffers


@query(f"""WITH h AS ({_HOLES}), c AS (SELECT count(*) AS n, count(status) AS a, count(price) AS b, count(o_orderkey) AS c FROM h)
SELECT 'status' AS "column", CASE WHEN a IN (0, n) THEN 0 ELSE (n + 7) // 8 END AS bytes FROM c UNION ALL SELECT 'price', CASE WHEN b IN (0, n) THEN 0 ELSE (n + 7) // 8 END FROM c UNION ALL SELECT 'o_orderkey', CASE WHEN c IN (0, n) THEN 0 ELSE (n + 7) // 8 END FROM c""")
def buf_validity_bytes(spark, sf_dir):
    return layout.validity_bytes(_holes(spark, sf_dir), ["status", "price", "o_orderkey"])


@query(f"""WITH h AS ({_HOLES}), i AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, status FROM h)
SELECT i // 8 AS byte, sum(CASE WHEN status IS NOT NULL THEN 1 << (i % 8) ELSE 0 END)::BIGINT AS bits FROM i GROUP BY 1""")
def buf_validity_bits(spark, sf_dir):
    return layout.validity_bits(_holes(spark, sf_dir), "status", ["o_orderkey"])


@query("SELECT doc_id, e - s AS begin, e AS \"end\" FROM (SELECT doc_id, octet_length(encode(text))::BIGINT AS s, sum(octet_length(encode(text))) OVER (ORDER BY doc_id)::BIGINT AS e FROM documents)")
def buf_offsets(spark, sf_dir):
    return layout.offsets(table(spark, sf_dir, "documents"), F.octet_length("text"), ["doc_id"], "doc_id")


@query("""SELECT 'text' AS "column", count(*) AS rows, sum(octet_length(encode(text)))::BIGINT AS values, 4 * (count(*) + 1) AS offsets FROM documents
UNION ALL SELECT 'lang', count(*), sum(octet_length(encode(lang)))::BIGINT, 4 * (count(*) + 1) FROM documents UNION ALL SELECT 'doc_id', count(*), 8 * count(*), 0 FROM documents""")
def buf_sizes(spark, sf_dir):
    return layout.buffer_sizes(table(spark, sf_dir, "documents"), {"doc_id": 8}, ["text", "lang"])


# types and schemas

_T = [Type(k) for k in ("null", "bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float16", "float32", "float64", "date32", "date64", "binary", "utf8", "large_binary", "large_utf8")]
_T += [Type("time32", "ms"), Type("time64", "us"), Type("timestamp", "us"), Type("timestamp", "ns", "UTC"), Type("duration", "s"), Type("interval", "month_day_nano"), Type("decimal128", precision=10, scale=2), Type("fixed_size_binary", size=3)]
_T += [list_of(Type("int32")), list_of(Type("utf8"), kind="large_list"), list_of(Type("float32"), size=4), struct_of(Field("id", Type("int32")), Field("name", Type("utf8")))]
_FLAGS = ("is_primitive", "is_numeric", "is_temporal", "is_floating", "is_integer", "is_signed", "is_unsigned", "is_dictionary_key", "is_run_ends", "is_nested", "is_variable", "is_null")
_STRINGS = (
    "Null Boolean Int8 Int16 Int32 Int64 UInt8 UInt16 UInt32 UInt64 Float16 Float32 Float64 Date32 Date64 Binary Utf8 LargeBinary LargeUtf8".split()
    + ["Time32(millisecond)", "Time64(microsecond)", "Timestamp(microsecond)", "Timestamp(nanosecond, UTC)", "Duration(second)", "Interval(month_day_nano)", "Decimal128(10, 2)", "FixedSizeBinary(3)"]
    + ["List(Int32)", "LargeList(Utf8)", "FixedSizeList(Float32, 4)", "Struct(id: Int32, name: Utf8)"]
)
_NUM = {"Int8", "Int16", "Int32", "Int64", "UInt8", "UInt16", "UInt32", "UInt64", "Float16", "Float32", "Float64", "Decimal128(10, 2)"}


def _expected_flags(s: str) -> tuple:
    signed, unsigned, floating = s in ("Int8", "Int16", "Int32", "Int64"), s.startswith("UInt"), s.startswith("Float")
    temporal = s.startswith(("Date", "Time", "Duration", "Interval"))
    return (s in _NUM or temporal, s in _NUM, temporal, floating, signed or unsigned, signed, unsigned, signed or unsigned, s in ("Int16", "Int32", "Int64"), s.startswith(("List", "LargeList", "FixedSizeList", "Struct")), s in ("Binary", "Utf8"), s == "Null")


@query(values_sql([(s, *_expected_flags(s)) for s in _STRINGS], ["type", *_FLAGS]))
def type_predicates(spark, sf_dir):
    return spark.createDataFrame([(str(t), *(getattr(t, f) for f in _FLAGS)) for t in _T], "type string, " + ", ".join(f"{f} boolean" for f in _FLAGS))


_WIDE = {"Int8": 1, "UInt8": 1, "Int16": 2, "UInt16": 2, "Float16": 2, "Int32": 4, "UInt32": 4, "Float32": 4, "Date32": 4, "Time32(millisecond)": 4, "Int64": 8, "UInt64": 8, "Float64": 8, "Date64": 8, "Time64(microsecond)": 8, "Timestamp(microsecond)": 8, "Timestamp(nanosecond, UTC)": 8, "Duration(second)": 8, "Interval(month_day_nano)": 16, "Decimal128(10, 2)": 16}


@query(values_sql([(s, _WIDE.get(s)) for s in _STRINGS], ["type", "width"]))
def type_widths(spark, sf_dir):
    return spark.createDataFrame([(str(t), t.width) for t in _T], "type string, width int")


_FORMATS = [("Int8", "c"), ("Int64", "l"), ("UInt32", "I"), ("Float64", "g"), ("Boolean", "b"), ("Date32", "tdD"), ("Date64", "tdm"), ("Time32(millisecond)", "ttm"), ("Time64(nanosecond)", "ttn"), ("Timestamp(microsecond)", "tsu"), ("Timestamp(second, Europe/Paris)", "tss:Europe/Paris"), ("Binary", "z"), ("Utf8", "u"), ("List(Int32)", "+li"), ("Struct(id: Int32, name: Utf8)", "+siu")]


@query(values_sql([(a, b, None if b.startswith("+") else a) for a, b in _FORMATS], ["type", "format", "back"]))
def c_formats(spark, sf_dir):
    kinds = [Type(k) for k in ("int8", "int64", "uint32", "float64", "bool", "date32", "date64")] + [Type("time32", "ms"), Type("time64", "ns"), Type("timestamp", "us"), Type("timestamp", "s", "Europe/Paris"), Type("binary"), Type("utf8"), list_of(Type("int32")), struct_of(Field("id", Type("int32")), Field("name", Type("utf8")))]
    return spark.createDataFrame([(str(t), f := t.c_format(), None if f.startswith("+") else str(types.from_c_format(f))) for t in kinds], "type string, format string, back string")


_INT, _TEXT = Type("int32"), Type("utf8")
_PAIRS = [
    ("same type", Field("a", _INT), Field("a", _INT), True),
    ("wider null", Field("a", _INT), Field("a", _INT, False), True),
    ("narrower null", Field("a", _INT, False), Field("a", _INT), False),
    ("other name", Field("a", _INT), Field("b", _INT), False),
    ("other type", Field("a", _INT), Field("a", Type("int64")), False),
    ("more metadata", Field("a", _INT, metadata=(("k", "v"),)), Field("a", _INT), True),
    ("less metadata", Field("a", _INT), Field("a", _INT, metadata=(("k", "v"),)), False),
    ("list wider", Field("a", list_of(_INT)), Field("a", list_of(_INT, False)), True),
    ("list narrower", Field("a", list_of(_INT, False)), Field("a", list_of(_INT)), False),
    ("struct wider", Field("a", struct_of(Field("x", _INT), Field("y", _TEXT))), Field("a", struct_of(Field("x", _INT, False), Field("y", _TEXT))), True),
    ("struct fewer", Field("a", struct_of(Field("x", _INT))), Field("a", struct_of(Field("x", _INT), Field("y", _TEXT))), False),
    ("fixed size", Field("a", list_of(_INT, size=3)), Field("a", list_of(_INT, size=4)), False),
]


@query(values_sql([(n, c) for n, _, _, c in _PAIRS], ["pair", "contained"]))
def schema_contains(spark, sf_dir):
    return spark.createDataFrame([(n, a.contains(b)) for n, a, b, _ in _PAIRS], "pair string, contained boolean")


_EQUALS = [
    ("list names", Type("list", fields=(Field("item", _INT),)), Type("list", fields=(Field("element", _INT),)), True),
    ("list null", list_of(_INT), list_of(_INT, False), False),
    ("struct names", struct_of(Field("x", _INT)), struct_of(Field("y", _INT)), True),
    ("struct types", struct_of(Field("x", _INT)), struct_of(Field("x", _TEXT)), False),
    ("union order", Type("union", "sparse", fields=(Field("a", _INT), Field("b", _TEXT)), ids=(0, 1)), Type("union", "sparse", fields=(Field("b", _TEXT), Field("a", _INT)), ids=(1, 0)), True),
    ("units", Type("timestamp", "us"), Type("timestamp", "ns"), False),
    ("zones", Type("timestamp", "us", "UTC"), Type("timestamp", "us"), False),
    ("sizes", list_of(_INT, size=3), list_of(_INT, size=3), True),
]


@query(values_sql([(n, c) for n, _, _, c in _EQUALS], ["pair", "equal"]))
def type_equals(spark, sf_dir):
    return spark.createDataFrame([(n, a.equals(b)) for n, a, b, _ in _EQUALS], "pair string, equal boolean")


# files, messages, remote batches

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


def _round(spark, df, kind, **options):
    ipc.register(spark)
    path = exchange_dir(spark)
    df.write.format(kind).mode("append").options(path=path, **options).save()
    return spark.read.format(kind).load(path)


@query(_ORDERS)
def ipc_file_roundtrip(spark, sf_dir):
    return _round(spark, table(spark, sf_dir, "orders"), "colipc")


@query(_ORDERS)
def ipc_stream_roundtrip(spark, sf_dir):
    return _round(spark, table(spark, sf_dir, "orders"), "colstream", compression="zstd")


@query("SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding) AS value FROM embeddings")
def ipc_nested_roundtrip(spark, sf_dir):
    return nested.list_values(_round(spark, table(spark, sf_dir, "embeddings"), "colipc"), "embedding", "vec_id")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey > 7000")
def ipc_projection(spark, sf_dir):
    ipc.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = exchange_dir(spark)
    table(spark, sf_dir, "orders").write.format("colipc").mode("append").save(path)
    return spark.read.format("colipc").options(columns="o_orderkey,o_orderdate", pushdown="true").load(path).where("o_orderkey > 7000")


@query("SELECT i // 1000 AS block, count(*) AS rows, min(o_orderkey) AS low, max(o_orderkey) AS high FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) GROUP BY 1")
def ipc_batch_index(spark, sf_dir):
    """Files of record batches of 1000 rows, written by tasks that have whole blocks; each batch is read as a partition of its own."""
    ipc.register(spark)
    path = exchange_dir(spark)
    rows = frame.with_index(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    whole = rows.repartition(8, F.floor(F.col("row_index") / 1000)).sortWithinPartitions("row_index").select("o_orderkey")
    whole.write.format("colipc").option("blockRows", 1000).mode("append").save(path)
    rows = spark.read.format("colipc").option("split", "batch").load(path)
    blocks = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    # a short row for each batch
    return blocks.select((F.row_number().over(Window.orderBy("low")) - 1).cast("long").alias("block"), "rows", "low", "high")


@query(_ORDERS)
def message_roundtrip(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return messages.read_streams(messages.partition_streams(orders), orders.schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def file_bytes_roundtrip(spark, sf_dir):
    return messages.from_file_bytes(spark, messages.to_file_bytes(table(spark, sf_dir, "nation")))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def cdata_roundtrip(spark, sf_dir):
    with cdata.exported_columns(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")) as columns:
        return cdata.import_columns(spark, columns)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def codec_roundtrip(spark, sf_dir):
    from .operators.samples import Nation

    rows = table(spark, sf_dir, "nation")
    return codec.encode(spark, codec.decode(rows, Nation), rows.schema)


def _served(spark, use):
    """Run `use(registry, client)` against a server of its own."""
    registry = flight.Registry(spark)
    server = flight.Server(registry)
    thread = threading.Thread(target=server.serve, daemon=True)
    thread.start()
    client = flight.Client(f"grpc://127.0.0.1:{server.port}")
    try:
        return use(registry, client)
    finally:
        client.close()
        server.shutdown()
        thread.join()


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def flight_put_get(spark, sf_dir):
    def use(registry, client):
        batches = table(spark, sf_dir, "customer").toArrow().to_batches(max_chunksize=500)
        client.do_put(flight.Descriptor(("customers",)), batches)
        got = [b for t in client.get_info(flight.Descriptor(("customers",))).tickets for b in client.do_get(t)]
        return messages.from_table(spark, pa.Table.from_batches(got))

    return _served(spark, use)


@query("SELECT r_regionkey * 2 AS r_regionkey, upper(r_name) AS r_name FROM region")
def flight_exchange(spark, sf_dir):
    def use(registry, client):
        registry.exchange = lambda b: pa.RecordBatch.from_arrays([pa.compute.multiply(b.column(0), 2), pa.compute.utf8_upper(b.column(1))], b.schema.names)
        batches = table(spark, sf_dir, "region").toArrow().to_batches(max_chunksize=2)
        return messages.from_table(spark, pa.Table.from_batches(client.do_exchange(flight.Descriptor(("x",)), batches)))

    return _served(spark, use)


@query(values_sql([("nation", 3), ("region", 2)], ["name", "columns"]))
def flight_list(spark, sf_dir):
    def use(registry, client):
        for n in ("customer", "nation", "region"):
            registry.put(n, table(spark, sf_dir, n))
        return spark.createDataFrame([(i.descriptor.name, len(i.schema)) for i in client.list_flights("%ion")], "name string, columns int")

    return _served(spark, use)


@query(values_sql([("n_nationkey", "int32"), ("n_name", "string"), ("n_regionkey", "int32")], ["name", "type"]))
def flight_schema(spark, sf_dir):
    def use(registry, client):
        registry.put("nation", table(spark, sf_dir, "nation"))
        return spark.createDataFrame([(f.name, str(f.type)) for f in client.get_schema(flight.Descriptor(("nation",)))], "name string, type string")

    return _served(spark, use)


@query(values_sql([("count", "rows of a flight", "25")], ["action", "description", "result"]))
def flight_actions(spark, sf_dir):
    def use(registry, client):
        registry.put("nation", table(spark, sf_dir, "nation"))
        registry.actions["count"] = ("rows of a flight", lambda body: [str(registry.get(body.decode()).count()).encode()])
        (kind, text), (result,) = client.list_actions()[0], client.do_action("count", b"nation")
        return spark.createDataFrame([(kind, text, result.decode())], "action string, description string, result string")

    return _served(spark, use)


# the query façade


def _views(spark, sf_dir, *names):
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
    return flightsql.Facade(spark)


_STATEMENT = "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


@query(_STATEMENT)
def sql_statement(spark, sf_dir):
    facade = _views(spark, sf_dir, "customer", "nation")
    return facade.fetch(facade.ticket(_STATEMENT))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def sql_prepared(spark, sf_dir):
    facade = _views(spark, sf_dir, "customer")
    handle = facade.prepare("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = :segment AND c_acctbal > :least")
    facade.bind(handle, {"segment": "BUILDING", "least": 5000})
    out = facade.execute(handle)
    facade.close(handle)
    return out


@query(values_sql([("nation", "TEMPORARY VIEW"), ("region", "TEMPORARY VIEW")], ["table_name", "table_type"]))
def sql_get_tables(spark, sf_dir):
    return _views(spark, sf_dir, "nation", "region").tables("%_ion", ["TEMPORARY VIEW"]).where("table_name IN ('nation', 'region')").select("table_name", "table_type")


@query(values_sql([("nation", "n_nationkey", "int"), ("nation", "n_regionkey", "int")], ["table_name", "column_name", "data_type"]))
def sql_get_columns_like(spark, sf_dir):
    return _views(spark, sf_dir, "nation").columns("nation", "n\\_%key").select("table_name", "column_name", "data_type")


@query(values_sql([("TABLE",), ("TEMPORARY VIEW",), ("VIEW",)], ["table_type"]))
def sql_table_types(spark, sf_dir):
    return flightsql.Facade(spark).table_types()


@query(values_sql([("spark_catalog",)], ["catalog_name"]))
def sql_get_catalogs(spark, sf_dir):
    return flightsql.Facade(spark).catalogs().where("catalog_name = 'spark_catalog'")


@query(values_sql([("spark_catalog", "default")], ["catalog_name", "db_schema_name"]))
def sql_get_schemas(spark, sf_dir):
    return flightsql.Facade(spark).schemas("def%")


@query(values_sql([(507, "null ordering", "nulls first when ascending"), (522, "group by", "unrelated"), (540, "unions", "union, union all")], ["info_name", "name", "value"]))
def sql_info(spark, sf_dir):
    return flightsql.Facade(spark).sql_info([507, 522, 540])


@query(values_sql([("BIGINT", 64), ("STRING", None)], ["type_name", "column_size"]))
def sql_type_info(spark, sf_dir):
    return flightsql.Facade(spark).type_info().where("type_name IN ('BIGINT', 'STRING')")


@query(values_sql([("nation", "n_regionkey", "region", "r_regionkey")], ["table_name", "column_name", "parent", "parent_column"]))
def sql_keys(spark, sf_dir):
    facade = flightsql.Facade(spark)
    facade.declare_key("region", "r_regionkey")
    facade.declare_key("nation", "n_nationkey")
    facade.declare_key("nation", "n_regionkey", "foreign", "region", "r_regionkey")
    return facade.cross_reference("region", "nation")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def sql_ingest_append(spark, sf_dir):
    facade, name = flightsql.Facade(spark), f"ingest_{uuid.uuid4().hex}"
    for _ in range(2):
        facade.ingest(table(spark, sf_dir, "region"), name, if_exists="append", temporary=True)
    return spark.table(name)


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def sql_ingest_replace(spark, sf_dir):
    facade, name = flightsql.Facade(spark), f"ingest_{uuid.uuid4().hex}"
    facade.ingest(table(spark, sf_dir, "region"), name, temporary=True)
    facade.ingest(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), name, if_exists="replace", temporary=True)
    return spark.table(name)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def sql_reader(spark, sf_dir):
    facade = _views(spark, sf_dir, "events")
    return facade.query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")


# the same operators on more kinds of data


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN nullif(o_orderstatus, 'F') END AS status, o_custkey % 3 = 0 AS no_struct, CASE WHEN o_custkey % 4 > 0 THEN 3 END AS outer_size, CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS deep FROM orders")
def ipc_nulls_roundtrip(spark, sf_dir):
    """Null values, null structs with null fields, and lists of lists, through files."""
    k = F.col("o_custkey")
    made = nested.build_struct({"status": F.nullif("o_orderstatus", F.lit("F")), "price": F.col("o_totalprice")}, k % 3 > 0)
    lists = F.when(k % 4 > 0, F.array(F.array(k, F.lit(None).cast("long")), F.lit(None).cast("array<long>"), F.array().cast("array<long>")))
    rows = _round(spark, table(spark, sf_dir, "orders").select("o_orderkey", made.alias("s"), lists.alias("l")), "colipc")
    return rows.select("o_orderkey", F.col("s.status").alias("status"), F.col("s").isNull().alias("no_struct"), F.when(F.col("l").isNotNull(), F.size("l")).alias("outer_size"), F.get(F.get("l", F.lit(0)), F.lit(0)).alias("deep"))


@query("SELECT vec_id, unnest(range(32))::INTEGER AS outer_pos, unnest(list_transform(range(32), lambda i: embedding[2 * i + 1])) AS first, unnest(list_transform(range(32), lambda i: embedding[2 * i + 2])) AS second FROM embeddings")
def list_of_lists(spark, sf_dir):
    """Pairs of neighbouring values as lists in a list, and back."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.slice("embedding", 2 * i + 1, F.lit(2)))
    rows = nested.list_values(table(spark, sf_dir, "embeddings").select("vec_id", pairs.alias("pairs")), "pairs", "vec_id")
    return rows.select("vec_id", F.col("pos").alias("outer_pos"), nested.element("value", 0).alias("first"), nested.element("value", 1).alias("second"))


def _with_offsets(offsets: list[int]) -> pa.RecordBatch:
    """Two lists over three values, with any three offsets: as read from bytes, since arrays built in memory are validated at once."""
    sound = pa.RecordBatch.from_arrays([pa.array([[1], [2, 3]], pa.list_(pa.int32()))], ["l"])
    raw, of = sound.serialize().to_pybytes(), lambda x: pa.array(x, pa.int32()).buffers()[1].to_pybytes()[:12]
    assert raw.count(of([0, 1, 3])) == 1
    return pa.ipc.read_record_batch(pa.py_buffer(raw.replace(of([0, 1, 3]), of(offsets))), sound.schema)


@query(values_sql([("child shorter than its offsets", True), ("offsets that go back", True), ("sound", False)], ["batch", "refused"]))
def ipc_bad_offsets(spark, sf_dir):
    """List offsets are checked when a batch is read."""
    rows = []
    for name, offsets in (("sound", [0, 1, 3]), ("child shorter than its offsets", [0, 1, 9]), ("offsets that go back", [0, 2, 1])):
        try:
            ipc.legal_batch(_with_offsets(offsets), None)
            rows.append((name, False))
        except SourceError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "batch string, refused boolean")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def message_take(spark, sf_dir):
    """A schema message and a message for each batch, taken one after another."""
    rows, result = table(spark, sf_dir, "supplier"), messages.Result()
    batches = rows.toArrow().to_batches(max_chunksize=40)
    result.take(messages.encode_schema(batches[0].schema))
    for batch in batches:
        header, body = messages.encode_batch(batch)
        assert header and body
        result.take(batch.serialize().to_pybytes())
    return messages.from_table(spark, pa.Table.from_batches(result.batches, result.schema))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def flight_source(spark, sf_dir):
    """The format colflight: a partition for each endpoint of a flight."""

    def use(registry, client):
        flight.register(spark)
        registry.put("customers", table(spark, sf_dir, "customer").repartition(2, "c_custkey"))
        rows = spark.read.format("colflight").options(location=client.location, flight="customers").load()
        return shared.stage(rows, "flight")

    return _served(spark, use)


@query(values_sql([("handshake", "UnsupportedError"), ("poll_info", "UnsupportedError")], ["call", "error"]))
def flight_not_offered(spark, sf_dir):
    def use(registry, client):
        return spark.createDataFrame([(name, _error(getattr(client, name))) for name in ("handshake", "poll_info")], "call string, error string")

    return _served(spark, use)


def _error(f, *args) -> str | None:
    """The name of the error that a call raises."""
    try:
        f(*args)
    except ColumnError as e:
        return type(e).__name__
    return None


@query("SELECT r_regionkey AS col0 FROM region")
def encode_values(spark, sf_dir):
    return codec.encode_values(spark, codec.decode_column(table(spark, sf_dir, "region"), "r_regionkey"), T.IntegerType())


@query("SELECT r_regionkey::BIGINT AS col0, r_name AS col1 FROM region")
def encode_map(spark, sf_dir):
    return codec.encode_map(spark, dict(codec.decode_rows(table(spark, sf_dir, "region"))), T.LongType(), T.StringType())


@query("SELECT 0 AS place, 'name' AS column_name, 'string' AS type UNION ALL SELECT 1, 'balance', 'double' UNION ALL SELECT 2, 'late', 'boolean'")
def encode_order(spark, sf_dir):
    """Columns come in the order in which names are first seen, a column of a first null included."""
    made = codec.encode(spark, [{"name": "a", "balance": None}, {"name": "b", "balance": 1.5, "late": True}])
    return spark.createDataFrame([(k, f.name, f.dataType.simpleString()) for k, f in enumerate(made.schema)], "place int, column_name string, type string")


@query(values_sql([("bare integer", "UnknownTypeError"), ("list", "UnknownTypeError"), ("nested row", "UnknownTypeError"), ("text", None), ("integer with a schema", None)], ["row", "error"]))
def encode_gate(spark, sf_dir):
    tried = [("bare integer", {"a": 1}, None), ("list", {"a": ["x"]}, None), ("nested row", {"a": {"b": "x"}}, None), ("text", {"a": "x"}, None), ("integer with a schema", {"a": 1}, T.StructType([T.StructField("a", T.LongType())]))]
    return spark.createDataFrame([(n, _error(codec.encode, spark, [row], schema)) for n, row, schema in tried], "row string, error string")


@query("SELECT n_name AS value FROM nation")
def decode_column(spark, sf_dir):
    return spark.createDataFrame([(v,) for v in codec.decode_column(table(spark, sf_dir, "nation"), "n_name", optional=True)], "value string")


@query("SELECT n_regionkey AS a, n_name AS b FROM nation")
def decode_positional(spark, sf_dir):
    """Rows by place, whatever the columns' names."""
    rows = table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").alias("n_name"))
    return spark.createDataFrame([(r[1], r[0]) for r in codec.decode_rows(rows)], "a int, b string")


@query(values_sql([("text", "Utf8"), ("flag", "Boolean"), ("real", "Float64"), ("bytes", "Binary"), ("moment", "Date64")], ["value", "type"]))
def infer_types(spark, sf_dir):
    tried = [("text", "x"), ("flag", True), ("real", 1.5), ("bytes", b"x"), ("moment", datetime(2020, 1, 1))]
    return spark.createDataFrame([(n, str(types.infer(v))) for n, v in tried], "value string, type string")


@query(values_sql([("n_nationkey", "bigint", False), ("n_name", "string", True), ("n_regionkey", "int", True)], ["column_name", "type", "nullable"]))
def class_schema(spark, sf_dir):
    from .operators.samples import Typed

    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in codec.schema_of(Typed)], "column_name string, type string, nullable boolean")


@query(values_sql([(0, "id", "Int32", False, None), (1, "name", "Utf8", True, "v"), (2, "parts", "List(Float64)", True, None)], ["place", "field", "type", "nullable", "meta"]))
def schema_builder(spark, sf_dir):
    made = SchemaBuilder().add("id", Type("int32"), False).add("name", Type("utf8"), metadata={"k": "v"}).add("parts", list_of(Type("float64"))).finish()
    return spark.createDataFrame([(k, f.name, str(f.type), f.nullable, dict(f.metadata).get("k")) for k, f in enumerate(made.fields)], "place int, field string, type string, nullable boolean, meta string")


_STRIDES = [("int8", 1), ("int64", 8), ("float32", 4), ("bool", 1), ("utf8", 1), ("date32", 4)]


@query(values_sql([*((str(Type(k)), w) for k, w in _STRIDES), ("List(Int32)", 0), ("Struct(a: Int32)", 0)], ["type", "stride"]))
def type_strides(spark, sf_dir):
    kinds = [*(Type(k) for k, _ in _STRIDES), list_of(_INT), struct_of(Field("a", _INT))]
    return spark.createDataFrame([(str(t), t.stride) for t in kinds], "type string, stride int")


_FIELDS = [
    ("same", Field("a", _INT), Field("a", _INT), True), ("name", Field("a", _INT), Field("b", _INT), False), ("type", Field("a", _INT), Field("a", _TEXT), False),
    ("null", Field("a", _INT), Field("a", _INT, False), False), ("metadata", Field("a", _INT, metadata=(("k", "v"),)), Field("a", _INT), False), ("order of a dictionary", Field("a", _INT, ordered=True), Field("a", _INT), True),
]


@query(values_sql([(n, e) for n, _, _, e in _FIELDS], ["pair", "equal"]))
def field_equality(spark, sf_dir):
    return spark.createDataFrame([(n, a == b) for n, a, b, _ in _FIELDS], "pair string, equal boolean")


@query(values_sql([("name", "b", "Int32", True, None, None), ("type", "a", "Utf8", True, None, None), ("nullable", "a", "Int32", False, None, None), ("metadata", "a", "Int32", True, "box", "v1")], ["change", "name", "type", "nullable", "extension", "extension_metadata"]))
def field_changes(spark, sf_dir):
    """Each change makes a new field; what an extension calls itself is in the metadata."""
    f = Field("a", _INT)
    made = {"name": f.with_name("b"), "type": f.with_type(_TEXT), "nullable": f.with_nullable(False), "metadata": f.with_metadata({types.EXTENSION_NAME: "box", types.EXTENSION_METADATA: "v1"})}
    assert f == Field("a", _INT)
    return spark.createDataFrame([(k, x.name, str(x.type), x.nullable, x.extension_name, x.extension_metadata) for k, x in made.items()], "change string, name string, type string, nullable boolean, extension string, extension_metadata string")


@query(values_sql([("fresh", None), ("released", "InvalidError")], ["structure", "error"]))
def cdata_release(spark, sf_dir):
    """A released structure is not read."""
    kept, gone = cdata.export_array(pa.array([1, 2])), cdata.export_array(pa.array([1, 2]))
    gone.release()
    out = spark.createDataFrame([("fresh", _error(cdata.check, kept)), ("released", _error(cdata.check, gone))], "structure string, error string")
    kept.release()
    return out


@query("""SELECT row_index, key, name, price FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, o_orderkey AS key FROM orders)
JOIN (SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS row_index, o_orderstatus AS name FROM orders) USING (row_index)
JOIN (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS row_index, o_totalprice AS price FROM orders) USING (row_index)""")
def batch_from_columns(spark, sf_dir):
    """A batch from three columns, each in an order of its own, joined by position."""
    orders = table(spark, sf_dir, "orders").withColumn("down", -F.col("o_totalprice"))
    return frame.zip_columns({"key": (orders, "o_orderkey", ["o_orderkey"]), "name": (orders, "o_orderstatus", ["o_custkey", "o_orderkey"]), "price": (orders, "o_totalprice", ["down", "o_orderkey"])}, ("key",))


@query(values_sql([("equal", None), ("unequal", "InvalidError"), ("null", "InvalidError"), ("none", "InvalidError")], ["columns", "error"]))
def batch_check(spark, sf_dir):
    a, b = (table(spark, sf_dir, "nation"), "n_name", ["n_nationkey"]), (table(spark, sf_dir, "region"), "r_name", ["r_regionkey"])
    holes = (a[0].select("n_nationkey", F.nullif("n_name", F.lit("ALGERIA")).alias("n_name"), (F.col("n_nationkey") > 3).alias("x")).withColumn("n_name", F.when(F.col("x"), F.col("n_name"))), "n_name", ["n_nationkey"])
    tried = [("equal", {"a": a, "b": a}, ()), ("unequal", {"a": a, "b": b}, ()), ("null", {"a": holes}, ("a",)), ("none", {}, ())]
    return spark.createDataFrame([(n, _error(frame.zip_columns, c, required)) for n, c, required in tried], "columns string, error string")


@query("""SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_totalprice']) AS "column", unnest(['bigint', 'string', 'double']) AS type, unnest([o_orderkey::VARCHAR, o_orderstatus, o_totalprice::VARCHAR]) AS value
FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 100)""")
def any_values(spark, sf_dir):
    return frame.any_values(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"], 100)


@query(values_sql([("rows of a statement", 3), ("unknown", -1)], ["statement", "rows"]))
def sql_update(spark, sf_dir):
    """The number of rows that a statement reports; -1 where it reports none."""
    facade, name = _views(spark, sf_dir, "region"), f"view_{uuid.uuid4().hex}"
    counted = facade.update("SELECT CAST(count(*) AS INT) FROM region WHERE r_regionkey < 3")
    made = facade.update(f"CREATE TEMPORARY VIEW {name} AS SELECT * FROM region")
    return spark.createDataFrame([("rows of a statement", counted), ("unknown", made)], "statement string, rows int")


@query(values_sql([("primary", "nation", "n_nationkey", None), ("imported", "nation", "n_regionkey", "region"), ("exported", "nation", "n_regionkey", "region")], ["kind", "table_name", "column_name", "parent"]))
def sql_all_keys(spark, sf_dir):
    facade = flightsql.Facade(spark)
    facade.declare_key("region", "r_regionkey")
    facade.declare_key("nation", "n_nationkey")
    facade.declare_key("nation", "n_regionkey", "foreign", "region", "r_regionkey")
    found = [("primary", facade.primary_keys("nation").withColumn("parent", F.lit(None).cast("string"))), ("imported", facade.imported_keys("nation")), ("exported", facade.exported_keys("region"))]
    return frame.concat([df.select(F.lit(kind).alias("kind"), "table_name", "column_name", "parent") for kind, df in found])


@query(values_sql([(c, "UnsupportedError") for c in ("begin_transaction", "begin_savepoint", "end_transaction", "end_savepoint", "substrait")] + [("fetch", "InvalidError"), ("execute", "InvalidError")], ["call", "error"]))
def sql_refused(spark, sf_dir):
    facade = flightsql.Facade(spark)
    calls = [(c, _error(getattr(facade, c))) for c in ("begin_transaction", "begin_savepoint", "end_transaction", "end_savepoint")]
    calls += [(c, _error(getattr(facade, c), x)) for c, x in (("substrait", b""), ("fetch", "nothing"), ("execute", "nothing"))]
    return spark.createDataFrame(calls, "call string, error string")


@query("SELECT true AS cancelled, true AS stopped")
def sql_cancel(spark, sf_dir):
    """A running statement is stopped by its tag."""
    facade, tag, ended = _views(spark, sf_dir, "orders"), f"tag{uuid.uuid4().hex}", []

    def run():
        try:
            facade.run_tagged("SELECT count(*) FROM range(0, 40000000000, 1, 64) WHERE id % 7 = 8", tag).collect()
        except Exception as e:
            ended.append(e)

    thread = InheritableThread(run)
    thread.start()
    found = []
    for _ in range(200):
        found += facade.cancel(tag)
        thread.join(0.1)
        if not thread.is_alive():
            break
    return spark.createDataFrame([(bool(found), len(ended) == 1)], "cancelled boolean, stopped boolean")
