"""A query façade in the vocabulary of SQL over remote calls: statements, catalogue relations, ingest, capabilities."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidError, UnsupportedError

#: Numbers of the capability entries.
SQL_INFO = {
    0: ("server name", "columnforge"), 1: ("server version", "1"), 3: ("read only", "false"),
    4: ("sql", "true"), 5: ("substrait", "false"), 8: ("transactions", "none"), 9: ("cancel", "true"),
    507: ("null ordering", "nulls first when ascending"), 522: ("group by", "unrelated"), 523: ("like escape", "true"),
    528: ("outer joins", "full"), 538: ("correlated subqueries", "true"), 539: ("subqueries", "comparisons, exists, in"), 540: ("unions", "union, union all"),
}


def like(pattern: str | None) -> re.Pattern:
    """A pattern of % and _, with a backslash before a literal one; None fits all."""
    if pattern is None:
        return re.compile(".*", re.DOTALL)
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            k += 1
            out += re.escape(pattern[k])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        k += 1
    return re.compile(out, re.DOTALL)


@dataclass
class Prepared:
    query: str
    handle: str = field(default_factory=lambda: uuid.uuid4().hex)
    args: dict | list | None = None


@dataclass
class Facade:
    spark: SparkSession
    prepared: dict[str, Prepared] = field(default_factory=dict)
    results: dict[str, DataFrame] = field(default_factory=dict)
    keys: list[tuple[str, str, str, str | None, str | None]] = field(default_factory=list)

    # statements

    def query(self, sql: str, args: dict | list | None = None) -> DataFrame:
        return self.spark.sql(sql, args=args) if args else self.spark.sql(sql)

    def schema(self, sql: str):
        """A query's schema, without running it."""
        return self.spark.sql(sql).schema

    def ticket(self, sql: str) -> str:
        """An opaque handle of a query's result."""
        handle = uuid.uuid4().hex
        self.results[handle] = self.query(sql)
        return handle

    def fetch(self, handle: str) -> DataFrame:
        if handle not in self.results:
            raise InvalidError(f"no result {handle!r}")
        return self.results[handle]

    def prepare(self, sql: str) -> str:
        p = Prepared(sql)
        self.prepared[p.handle] = p
        return p.handle

    def bind(self, handle: str, args: dict | list) -> None:
        self._prepared(handle).args = args

    def execute(self, handle: str) -> DataFrame:
        p = self._prepared(handle)
        return self.query(p.query, p.args)

    def close(self, handle: str) -> None:
        self._prepared(handle)
        del self.prepared[handle]

    def _prepared(self, handle: str) -> Prepared:
        if handle not in self.prepared:
            raise InvalidError(f"no prepared statement {handle!r}")
        return self.prepared[handle]

    def update(self, sql: str, args: dict | list | None = None) -> int:
        """Run a statement that changes data; -1: Spark does not tell how many rows."""
        rows = self.query(sql, args).collect()
        return int(rows[0][0]) if len(rows) == 1 and len(rows[0]) == 1 and isinstance(rows[0][0], int) else -1

    def ingest(self, df: DataFrame, table: str, if_not_exists: str = "create", if_exists: str = "fail", temporary: bool = False) -> None:
        """Bulk load: if_not_exists create or fail; if_exists fail, append or replace."""
        if if_not_exists not in ("create", "fail") or if_exists not in ("fail", "append", "replace"):
            raise InvalidError(f"no such mode: {if_not_exists}, {if_exists}")
        there = self.spark.catalog.tableExists(table)
        if not there and if_not_exists == "fail":
            raise InvalidError(f"no table {table}")
        if there and if_exists == "fail":
            raise InvalidError(f"table {table} is there already")
        if temporary:
            if there and if_exists == "append":
                df = self.spark.table(table).unionAll(df)
            df.createOrReplaceTempView(table)
        else:
            df.write.mode({"append": "append"}.get(if_exists, "overwrite") if there else "errorifexists").saveAsTable(table)

    def begin_transaction(self) -> None:
        raise UnsupportedError("transactions")

    begin_savepoint = end_transaction = end_savepoint = begin_transaction

    def substrait(self, plan: bytes) -> None:
        raise UnsupportedError("plans in another engine's format")

    def run_tagged(self, sql: str, tag: str) -> DataFrame:
        """Jobs that this thread starts from now on are of the tag's group; see cancel."""
        self.spark.sparkContext.setJobGroup(tag, sql)
        return self.query(sql)

    def cancel(self, tag: str) -> list[str]:
        """Stop the running jobs of a tag; their numbers."""
        context = self.spark.sparkContext
        active = set(context.statusTracker().getActiveJobsIds())
        found = [str(k) for k in context.statusTracker().getJobIdsForGroup(tag) if k in active]
        context.cancelJobGroup(tag)
        return found

    # catalogue

    def _relation(self, rows: list[tuple], schema: str, *order: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema).orderBy(*order)

    def catalogs(self) -> DataFrame:
        return self._relation([(c.name,) for c in self.spark.catalog.listCatalogs()], "catalog_name string", "catalog_name")

    def schemas(self, pattern: str | None = None) -> DataFrame:
        test = like(pattern)
        return self._relation([(d.catalog, d.name) for d in self.spark.catalog.listDatabases() if test.fullmatch(d.name)], "catalog_name string, db_schema_name string", "catalog_name", "db_schema_name")

    def tables(self, pattern: str | None = None, types: list[str] | None = None, include_schema: bool = False) -> DataFrame:
        test, rows = like(pattern), []
        for t in self.spark.catalog.listTables():
            kind = "TEMPORARY VIEW" if t.isTemporary else "VIEW" if t.tableType == "VIEW" else "TABLE"
            if test.fullmatch(t.name) and (types is None or kind in types):
                rows.append((t.catalog, t.namespace[0] if t.namespace else None, t.name, kind, *([self.spark.table(t.name).schema.json()] if include_schema else [])))
        schema = "catalog_name string, db_schema_name string, table_name string, table_type string" + ", table_schema string" * include_schema
        return self._relation(rows, schema, "table_name")

    def columns(self, table_pattern: str | None = None, column_pattern: str | None = None) -> DataFrame:
        a, b = like(table_pattern), like(column_pattern)
        rows = [(t.name, c.name, c.dataType, k) for t in self.spark.catalog.listTables() if a.fullmatch(t.name) for k, c in enumerate(self.spark.catalog.listColumns(t.name)) if b.fullmatch(c.name)]
        return self._relation(rows, "table_name string, column_name string, data_type string, position int", "table_name", "position")

    def table_types(self) -> DataFrame:
        return self._relation([("TABLE",), ("TEMPORARY VIEW",), ("VIEW",)], "table_type string", "table_type")

    def sql_info(self, ids: list[int] | None = None) -> DataFrame:
        return self._relation([(k, n, v) for k, (n, v) in SQL_INFO.items() if ids is None or k in ids], "info_name int, name string, value string", "info_name")

    def type_info(self) -> DataFrame:
        """Types that a column can have, and their sizes."""
        rows = [("BOOLEAN", 1), ("TINYINT", 8), ("SMALLINT", 16), ("INT", 32), ("BIGINT", 64), ("FLOAT", 32), ("DOUBLE", 64), ("DECIMAL", 38), ("STRING", None), ("BINARY", None), ("DATE", 32), ("TIMESTAMP", 64), ("TIMESTAMP_NTZ", 64)]
        return self._relation(rows, "type_name string, column_size int", "type_name")

    # declared keys

    def declare_key(self, table: str, column: str, kind: str = "primary", parent: str | None = None, parent_column: str | None = None) -> None:
        if kind not in ("primary", "foreign") or (kind == "foreign") != (parent is not None):
            raise InvalidError("a primary key, or a foreign key with its parent")
        self.keys.append((table, column, kind, parent, parent_column))

    def _keys(self) -> DataFrame:
        return self.spark.createDataFrame(self.keys, "table_name string, column_name string, kind string, parent string, parent_column string")

    def primary_keys(self, table: str) -> DataFrame:
        return self._keys().where((F.col("kind") == "primary") & (F.col("table_name") == table)).select("table_name", "column_name")

    def imported_keys(self, table: str) -> DataFrame:
        return self._keys().where((F.col("kind") == "foreign") & (F.col("table_name") == table)).drop("kind")

    def exported_keys(self, table: str) -> DataFrame:
        return self._keys().where((F.col("kind") == "foreign") & (F.col("parent") == table)).drop("kind")

    def cross_reference(self, parent: str, table: str) -> DataFrame:
        return self.imported_keys(table).where(F.col("parent") == parent)
