"""A Bloom filter of bounded size over the keys of a table, in DataFrame functions only.

It leaves out most rows that a join by those keys would drop, before they move. It never leaves out one that the join would keep, so the join
after it decides alone. Beyond some ten million keys the filter leaves out fewer rows, and no result changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stage

#: Longs in a filter at most; 16 bits for a key below that.
WORDS = 1 << 22


class Filter:
    def __init__(self, keys: DataFrame, *columns: str) -> None:
        """Of the columns (together a key) of `keys`, a written table."""
        self.words = min(WORDS, 1 << max(6, (keys.count() * 16 // 64).bit_length()))
        # at most WORDS rows, whatever the table
        self.bits = stage(self._bit(keys, columns).groupBy("_word").agg(F.bit_or("_mask").alias("_bits")).coalesce(8), "filter")

    def _bit(self, rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        h = F.xxhash64(*columns)
        bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, k).bitwiseAND(63).cast("int"))
        return rows.withColumns({"_word": F.pmod(F.shiftrightunsigned(h, 12), F.lit(self.words).cast("long")), "_mask": bit(0).bitwiseOR(bit(6))})

    def keep(self, rows: DataFrame, *columns: str) -> DataFrame:
        """The rows whose key may be one of the table's; names that begin with _word, _mask and _bits are taken."""
        names = rows.columns
        return self._bit(rows, columns).join(F.broadcast(self.bits), "_word").where(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask")).select(*names)

    def marked(self, rows: DataFrame, name: str, *columns: str) -> DataFrame:
        """All rows, with a column that says whether their key may be one of the table's."""
        may = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
        return self._bit(rows, columns).join(F.broadcast(self.bits), "_word", "left").select(*rows.columns, may.alias(name))
