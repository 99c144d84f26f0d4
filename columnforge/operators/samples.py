"""Row classes of the queries."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Annotated

from pyspark.sql import types as T


@dataclass
class Nation:
    n_nationkey: int
    n_name: str | None
    n_regionkey: int | None


@dataclass
class Typed:
    """The same with the widths of its integers declared."""

    n_nationkey: Annotated[int, T.LongType()]
    n_name: str | None
    n_regionkey: Annotated[int, T.IntegerType()] | None
