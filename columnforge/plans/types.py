"""Logical types: what a column means, and the Spark type that carries it.

Spark has fewer types than the columnar format. A type without a Spark counterpart is widened losslessly, and its
name is kept in the field's metadata under LOGICAL, so that it can be checked on write and restored on export.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import types as T

from ..errors import InvalidError, UnknownTypeError, UnsupportedError

#: Fixed names: metadata keys of extension types in the columnar format.
EXTENSION_NAME, EXTENSION_METADATA = "ARROW:extension:name", "ARROW:extension:metadata"
LOGICAL = "logical"

SIGNED = ("int8", "int16", "int32", "int64")
UNSIGNED = ("uint8", "uint16", "uint32", "uint64")
FLOATS = ("float16", "float32", "float64")
DECIMALS = ("decimal32", "decimal64", "decimal128", "decimal256")
TEMPORAL = ("date32", "date64", "timestamp", "time32", "time64", "duration", "interval")
LISTS = ("list", "large_list", "list_view", "large_list_view")
NESTED = (*LISTS, "fixed_size_list", "struct", "union", "map")
PLAIN = ("null", "bool", "binary", "large_binary", "binary_view", "utf8", "large_utf8", "utf8_view", "fixed_size_binary")

_WIDTHS = {"int8": 1, "uint8": 1, "int16": 2, "uint16": 2, "float16": 2, "int32": 4, "uint32": 4, "float32": 4, "date32": 4, "time32": 4, "decimal32": 4, "decimal64": 8, "decimal128": 16, "decimal256": 32} | dict.fromkeys(
    ("int64", "uint64", "float64", "timestamp", "date64", "time64", "duration"), 8
)
_INTERVALS = {"year_month": 4, "day_time": 8, "month_day_nano": 16}
_UNITS = {"s": "second", "ms": "millisecond", "us": "microsecond", "ns": "nanosecond"}


@dataclass(frozen=True)
class Type:
    """A logical type. `fields` are a nested type's children: one of a list, the entries of a map, key and value of a dictionary, run ends and values."""

    kind: str
    unit: str | None = None
    zone: str | None = None
    size: int | None = None
    precision: int | None = None
    scale: int | None = None
    fields: tuple[Field, ...] = ()
    ids: tuple[int, ...] = ()
    sorted: bool = False

    def __post_init__(self) -> None:
        allowed = {"time32": ("s", "ms"), "time64": ("us", "ns"), "timestamp": tuple(_UNITS), "duration": tuple(_UNITS), "interval": tuple(_INTERVALS), "union": ("sparse", "dense")}.get(self.kind)
        if allowed and self.unit not in allowed:
            raise InvalidError(f"{self.kind} has no unit {self.unit!r}")

    @property
    def is_signed(self) -> bool:
        return self.kind in SIGNED

    @property
    def is_unsigned(self) -> bool:
        return self.kind in UNSIGNED

    @property
    def is_integer(self) -> bool:
        return self.is_signed or self.is_unsigned

    @property
    def is_floating(self) -> bool:
        return self.kind in FLOATS

    @property
    def is_numeric(self) -> bool:
        return self.is_integer or self.is_floating or self.kind in DECIMALS

    @property
    def is_temporal(self) -> bool:
        return self.kind in TEMPORAL

    @property
    def is_primitive(self) -> bool:
        return self.is_numeric or self.is_temporal

    @property
    def is_dictionary_key(self) -> bool:
        return self.is_integer

    @property
    def is_run_ends(self) -> bool:
        return self.kind in SIGNED[1:]

    @property
    def is_nested(self) -> bool:
        if self.kind in ("dictionary", "run_end_encoded"):
            return self.fields[1].type.is_nested
        return self.kind in NESTED

    @property
    def is_variable(self) -> bool:
        return self.kind in ("binary", "utf8")

    @property
    def is_null(self) -> bool:
        return self.kind == "null"

    @property
    def width(self) -> int | None:
        """Bytes of a primitive value."""
        return _INTERVALS[self.unit] if self.kind == "interval" else _WIDTHS.get(self.kind)

    @property
    def stride(self) -> int:
        """Bytes between the values of a column's buffer; 0 if it has none of its own."""
        if self.kind in ("bool", "binary", "utf8"):
            return 1
        if self.kind in ("struct", "list"):
            return 0
        if self.width is None or self.kind in (*DECIMALS, "float16", "duration", "interval"):
            raise UnsupportedError(f"no stride of {self}")
        return self.width

    def __str__(self) -> str:
        inner = [str(f.type) for f in self.fields]
        if self.kind == "struct":
            inner = [f"{f.name}: {f.type}" for f in self.fields]
        elif self.kind == "union":
            inner = [self.unit or "", f"{len(self.fields)} fields"]
        elif self.kind == "interval":
            inner = [self.unit or ""]
        elif self.unit:
            inner = [_UNITS[self.unit], *([self.zone] if self.zone else [])]
        elif self.kind in DECIMALS:
            inner = [str(self.precision), str(self.scale)]
        if self.size is not None:
            inner.append(str(self.size))
        name = {"bool": "Boolean"}.get(self.kind) or "".join(p[:1].upper() + p[1:] for p in self.kind.split("_"))
        name = name.replace("Uint", "UInt")
        return f"{name}({', '.join(inner)})" if inner or self.kind == "struct" else name

    def equals(self, other: Type) -> bool:
        """Equal apart from names and metadata inside; a union's members may come in any order."""
        if (self.kind, self.unit, self.zone, self.size, self.precision, self.scale, self.sorted) != (other.kind, other.unit, other.zone, other.size, other.precision, other.scale, other.sorted) or len(self.fields) != len(other.fields):
            return False
        alike = lambda a, b: a.nullable == b.nullable and a.type.equals(b.type)
        if self.kind == "union":
            theirs = dict(zip(other.ids, other.fields, strict=True))
            return all(i in theirs and alike(f, theirs[i]) for i, f in zip(self.ids, self.fields, strict=True))
        if self.kind == "dictionary":
            return all(a.type.equals(b.type) for a, b in zip(self.fields, other.fields, strict=True))
        return all(map(alike, self.fields, other.fields))

    def contains(self, other: Type) -> bool:
        """Whether every value of `other` fits; nested types field by field."""
        if self.kind == "union" and other.kind == "union" and self.unit == other.unit:
            theirs = dict(zip(other.ids, other.fields, strict=True))
            return all(i in theirs and f.contains(theirs[i]) for i, f in zip(self.ids, self.fields, strict=True))
        if self.kind == "dictionary" and other.kind == "dictionary":
            return all(a.type.contains(b.type) for a, b in zip(self.fields, other.fields, strict=True))
        if self.kind in NESTED and replace(self, fields=()) == replace(other, fields=()):
            return len(self.fields) == len(other.fields) and all(a.contains(b) for a, b in zip(self.fields, other.fields, strict=True))
        return self == other

    def c_format(self) -> str:
        """The format string of the C data interface; of nested types with their children's after it."""
        if self.kind in _C_FORMATS:
            return _C_FORMATS[self.kind]
        if self.kind in ("time32", "time64"):
            return f"tt{self.unit[0]}"
        if self.kind == "timestamp":
            return f"ts{self.unit[0]}" + (f":{self.zone}" if self.zone else "")
        if self.kind in ("struct", "list"):
            return f"+{self.kind[0]}" + "".join(f.type.c_format() for f in self.fields)
        raise UnsupportedError(f"{self} has no C format here")


@dataclass(frozen=True)
class Field:
    name: str
    type: Type
    nullable: bool = True
    metadata: tuple[tuple[str, str], ...] = ()
    ordered: bool = field(default=False, compare=False)

    @property
    def extension_name(self) -> str | None:
        return dict(self.metadata).get(EXTENSION_NAME)

    @property
    def extension_metadata(self) -> str | None:
        return dict(self.metadata).get(EXTENSION_METADATA)

    @property
    def dict_is_ordered(self) -> bool:
        return self.type.kind == "dictionary" and self.ordered

    def contains(self, other: Field) -> bool:
        """A superset: nullable where the other is, with all of its metadata, and a type that contains the other's."""
        mine = dict(self.metadata)
        return self.name == other.name and self.dict_is_ordered == other.dict_is_ordered and (self.nullable or not other.nullable) and all(mine.get(k) == v for k, v in other.metadata) and self.type.contains(other.type)

    def with_name(self, name: str) -> Field:
        return replace(self, name=name)

    def with_type(self, type_: Type) -> Field:
        return replace(self, type=type_)

    def with_nullable(self, nullable: bool) -> Field:
        return replace(self, nullable=nullable)

    def with_metadata(self, metadata: dict[str, str]) -> Field:
        return replace(self, metadata=tuple(sorted(metadata.items())))


#: Format strings of the C data interface.
_C_FORMATS = {
    "int8": "c", "int16": "s", "int32": "i", "int64": "l", "uint8": "C", "uint16": "S", "uint32": "I", "uint64": "L",
    "float32": "f", "float64": "g", "bool": "b", "date32": "tdD", "date64": "tdm", "binary": "z", "utf8": "u",
}


def from_c_format(text: str) -> Type:
    """The type of a format string without children."""
    for kind, own in _C_FORMATS.items():
        if own == text:
            return Type(kind)
    units = {"s": "s", "m": "ms", "u": "us", "n": "ns"}
    if m := re.fullmatch(r"tt([smun])", text):
        return Type("time32" if m[1] in "sm" else "time64", units[m[1]])
    if text.startswith("ts"):
        if m := re.fullmatch(r"ts([smun])(?::(.*))?", text):
            return Type("timestamp", units[m[1]], m[2] or None)
        raise InvalidError(f"{text!r}: a timestamp is written as ts, the letter of its unit, and perhaps a colon and its zone")
    raise UnsupportedError(f"no type for the format {text!r}")


def list_of(type_: Type, nullable: bool = True, kind: str = "list", size: int | None = None) -> Type:
    """A list, large list, or with a size a fixed-size list."""
    return Type("fixed_size_list" if size is not None else kind, size=size, fields=(Field("item", type_, nullable),))


def struct_of(*fields: Field) -> Type:
    return Type("struct", fields=fields)


def dictionary_of(key: Type, value: Type) -> Type:
    if not key.is_dictionary_key:
        raise InvalidError(f"{key} is no type of dictionary keys")
    return Type("dictionary", fields=(Field("key", key, False), Field("value", value)))


def from_arrow(t: pa.DataType) -> Type:
    """The logical type of a pyarrow type."""
    names = {pa.null(): "null", pa.bool_(): "bool", pa.float16(): "float16", pa.float32(): "float32", pa.float64(): "float64", pa.date32(): "date32", pa.date64(): "date64", pa.binary(): "binary", pa.large_binary(): "large_binary", pa.binary_view(): "binary_view", pa.string(): "utf8", pa.large_string(): "large_utf8", pa.string_view(): "utf8_view"}
    if t in names:
        return Type(names[t])
    if pa.types.is_integer(t):
        return Type(str(t))
    if pa.types.is_timestamp(t):
        return Type("timestamp", t.unit, t.tz)
    if pa.types.is_time(t):
        return Type("time32" if t.bit_width == 32 else "time64", t.unit)
    if pa.types.is_duration(t):
        return Type("duration", t.unit)
    if pa.types.is_interval(t):
        return Type("interval", "month_day_nano")
    if pa.types.is_decimal(t):
        return Type(f"decimal{t.bit_width}", precision=t.precision, scale=t.scale)
    if pa.types.is_fixed_size_binary(t):
        return Type("fixed_size_binary", size=t.byte_width)
    if pa.types.is_fixed_size_list(t):
        return Type("fixed_size_list", size=t.list_size, fields=(field_from_arrow(t.value_field),))
    for test, kind in ((pa.types.is_list, "list"), (pa.types.is_large_list, "large_list"), (pa.types.is_list_view, "list_view"), (pa.types.is_large_list_view, "large_list_view")):
        if test(t):
            return Type(kind, fields=(field_from_arrow(t.value_field),))
    if pa.types.is_struct(t):
        return Type("struct", fields=tuple(field_from_arrow(x) for x in t))
    if pa.types.is_map(t):
        return Type("map", fields=(Field("entries", Type("struct", fields=(field_from_arrow(t.key_field), field_from_arrow(t.item_field))), False),), sorted=t.keys_sorted)
    if pa.types.is_union(t):
        return Type("union", t.mode, fields=tuple(field_from_arrow(x) for x in t), ids=tuple(t.type_codes))
    if pa.types.is_dictionary(t):
        return Type("dictionary", fields=(Field("key", from_arrow(t.index_type), False), Field("value", from_arrow(t.value_type))))
    if pa.types.is_run_end_encoded(t):
        return Type("run_end_encoded", fields=(Field("run_ends", from_arrow(t.run_end_type), False), Field("values", from_arrow(t.value_type))))
    raise UnknownTypeError(str(t))


def field_from_arrow(f: pa.Field) -> Field:
    meta = tuple(sorted((k.decode(), v.decode()) for k, v in (f.metadata or {}).items()))
    return Field(f.name, from_arrow(f.type), f.nullable, meta, pa.types.is_dictionary(f.type) and f.type.ordered)


def legal_arrow(t: pa.DataType) -> pa.DataType:
    """The pyarrow type that Spark takes for t: widened, decoded, in microseconds."""
    if pa.types.is_unsigned_integer(t):
        return {8: pa.int16(), 16: pa.int32(), 32: pa.int64(), 64: pa.decimal128(20, 0)}[t.bit_width]
    if pa.types.is_float16(t):
        return pa.float32()
    if pa.types.is_date64(t):
        return pa.timestamp("us", "UTC")
    if pa.types.is_timestamp(t):
        return pa.int64() if t.unit == "ns" else pa.timestamp("us", t.tz)
    if pa.types.is_time(t):
        return pa.int64() if t.unit == "ns" else pa.time64("us")
    if pa.types.is_duration(t):
        return pa.int64() if t.unit == "ns" else pa.duration("us")
    if pa.types.is_interval(t):
        return pa.struct([("months", pa.int32()), ("days", pa.int32()), ("nanoseconds", pa.int64())])
    if pa.types.is_decimal(t):
        if t.precision > 38 or t.scale < 0:
            raise UnsupportedError(f"Spark has no {t}")
        return pa.decimal128(t.precision, t.scale)
    if pa.types.is_fixed_size_binary(t) or t in (pa.large_binary(), pa.binary_view()):
        return pa.binary()
    if t in (pa.large_string(), pa.string_view()):
        return pa.string()
    if pa.types.is_dictionary(t) or pa.types.is_run_end_encoded(t):
        return legal_arrow(t.value_type)
    if any(test(t) for test in (pa.types.is_list, pa.types.is_large_list, pa.types.is_fixed_size_list, pa.types.is_list_view, pa.types.is_large_list_view)):
        return pa.list_(pa.field("element", legal_arrow(t.value_type), t.value_field.nullable))
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, legal_arrow(f.type), f.nullable) for f in t])
    if pa.types.is_map(t):
        return pa.map_(legal_arrow(t.key_type), pa.field("value", legal_arrow(t.item_type), t.item_field.nullable))
    if pa.types.is_union(t):
        return pa.struct([pa.field("type_id", pa.int8()), *(pa.field(f.name, legal_arrow(f.type)) for f in t)])
    return t


def legalise(array: pa.Array | pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
    """The array with its values in legal_arrow(its type)."""
    if isinstance(array, pa.ChunkedArray):
        return pa.chunked_array([legalise(c) for c in array.chunks], legal_arrow(array.type))
    t, want = array.type, legal_arrow(array.type)
    if t == want:
        return array
    if pa.types.is_dictionary(t):
        return legalise(array.dictionary_decode())
    if pa.types.is_run_end_encoded(t):
        return legalise(pa.compute.run_end_decode(array))
    if pa.types.is_interval(t) or pa.types.is_union(t):
        return pa.array([_plain(x) for x in array.to_pylist()] if pa.types.is_interval(t) else _members(array), want)
    if pa.types.is_struct(t):
        return pa.StructArray.from_arrays([legalise(c) for c in array.flatten()], fields=list(want), mask=array.is_null())
    if pa.types.is_map(t):
        return pa.array(array.to_pylist(), want)
    if pa.types.is_list_view(t) or pa.types.is_large_list_view(t) or pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
        sizes = pa.compute.fill_null(pa.compute.list_value_length(array), 0).to_numpy(zero_copy_only=False)
        offsets = [0, *sizes.cumsum().tolist()]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), legalise(array.flatten()), type=want, mask=array.is_null())
    if want == pa.int64():  # nanoseconds stay as they are
        return array.cast(pa.int64()) if pa.types.is_timestamp(t) or pa.types.is_time(t) or pa.types.is_duration(t) else array.cast(want)
    if pa.types.is_date64(t):
        return array.cast(pa.timestamp("ms")).cast(pa.timestamp("us")).cast(want)
    return array.cast(want)


def _plain(x) -> dict | None:
    return None if x is None else {"months": x.months, "days": x.days, "nanoseconds": x.nanoseconds}


def _members(array: pa.UnionArray) -> list[dict]:
    names = [f.name for f in array.type]
    place = {code: k for k, code in enumerate(array.type.type_codes)}
    return [{"type_id": code, names[place[code]]: x} for code, x in zip(array.type_codes.to_pylist(), array.to_pylist(), strict=True)]


def spark_type(t: pa.DataType) -> T.DataType:
    """The Spark type that carries t."""
    from pyspark.sql.pandas.types import from_arrow_type

    legal = legal_arrow(t)
    if pa.types.is_timestamp(legal):
        return T.TimestampType() if legal.tz else T.TimestampNTZType()
    if pa.types.is_list(legal):
        return T.ArrayType(spark_type(legal.value_type), legal.value_field.nullable)
    if pa.types.is_struct(legal):
        return T.StructType([T.StructField(f.name, spark_type(f.type), f.nullable) for f in legal])
    if pa.types.is_map(legal):
        return T.MapType(spark_type(legal.key_type), spark_type(legal.item_type), legal.item_field.nullable)
    return from_arrow_type(legal)


def spark_field(f: pa.Field) -> T.StructField:
    """The Spark field that carries f; metadata is kept, and the logical type where Spark lacks it."""
    meta = {k.decode(): v.decode() for k, v in (f.metadata or {}).items()}
    if legal_arrow(f.type) != f.type:
        meta[LOGICAL] = str(from_arrow(f.type))
    return T.StructField(f.name, spark_type(f.type), f.nullable, meta)


def infer(value: object) -> Type:
    """The type of a Python value as the row codec sees it; bare integers have no width, so they need a declared type."""
    import datetime as dt

    for kind, name in ((bool, "bool"), (str, "utf8"), ((bytes, bytearray), "binary"), (float, "float64"), (dt.datetime, "date64")):
        if isinstance(value, kind):
            return Type(name)
    raise UnknownTypeError(f"{type(value).__name__} needs a declared type")
