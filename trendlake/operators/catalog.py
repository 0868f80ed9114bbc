"""Table listing, description, existence and read-only ad-hoc SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from trendlake.sources.sinks import VERSION_SUFFIX

# Statement kinds the ad-hoc endpoint accepts.
READ_ONLY_PREFIXES = ("SELECT", "SHOW", "DESCRIBE", "WITH")
# Plan nodes that run scripts or arbitrary JVM methods; refused in ad-hoc SQL.
_REFUSED_NODES = {"ScriptTransformation", "CallMethodViaReflection", "TryReflect"}


def _shown(name: str) -> bool:
    """Versions that a published table's view points at are not listed."""
    return not VERSION_SUFFIX.search(name)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Names of the non-temporary tables, sorted."""
    names = sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary and _shown(t.name))
    return spark.createDataFrame([(n,) for n in names], "table_name string")


def list_all_tables(spark: SparkSession) -> DataFrame:
    """C1 over every catalog and database: (catalog, database, table_name), sorted."""
    found = []
    current = spark.catalog.currentCatalog()
    for catalog in sorted(c.name for c in spark.catalog.listCatalogs()):
        try:
            spark.catalog.setCurrentCatalog(catalog)
            for database in sorted(d.name for d in spark.catalog.listDatabases()):
                found += [(catalog, database, t.name) for t in spark.catalog.listTables(database) if not t.isTemporary and _shown(t.name)]
        finally:
            spark.catalog.setCurrentCatalog(current)
    return spark.createDataFrame(sorted(found), "catalog string, database string, table_name string")


def require_table(spark: SparkSession, name: str) -> None:
    """Raise ``KeyError`` when the table does not exist."""
    if not spark.catalog.tableExists(name):
        raise KeyError(f"no table or view named {name!r}")


def describe_table(spark: SparkSession, table: str | DataFrame) -> DataFrame:
    """(field, type, null, default) per column in order.  The default is the text that
    the column was declared with (``DEFAULT ...``), else NULL."""
    if isinstance(table, str):
        require_table(spark, table)
        schema = spark.table(table).schema
    else:
        schema = table.schema
    rows = [
        (f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO", f.metadata.get("CURRENT_DEFAULT"))
        for f in schema.fields
    ]
    return spark.createDataFrame(rows, "field string, type string, null string, default string")


class ReadOnlyViolation(PermissionError):
    """The statement is not a read-only query."""


def readonly_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Run a SELECT / WITH query, or a SHOW / DESCRIBE command.

    A prefix test alone would admit ``WITH ... INSERT``, and ``spark.sql`` runs
    DML eagerly.  SELECT / WITH text is therefore first parsed as the body of
    a temporary view, which only a query can be; anything else is refused
    before it runs.
    """
    if not isinstance(sql, str) or not sql.strip():
        raise ValueError("the query text is empty")
    text = sql.strip().rstrip(";").strip()
    head = text.upper()
    if not head.startswith(READ_ONLY_PREFIXES):
        raise ReadOnlyViolation("Only SELECT / SHOW / DESCRIBE / WITH queries are allowed")
    if head.startswith(("SELECT", "WITH")):
        probe = f"_readonly_probe_{uuid.uuid4().hex}"
        try:
            spark.sql(f"CREATE TEMPORARY VIEW {probe} AS {text}")
            plan = spark.table(probe)._jdf.queryExecution().analyzed().prettyJson()
            if _REFUSED_NODES & set(re.findall(r'"class"\s*:\s*"[\w.$]*?(\w+)"', plan)):
                raise ReadOnlyViolation("scripts and JVM reflection are not allowed")
        except AnalysisException as e:  # parse errors included
            if "PARSE_SYNTAX_ERROR" in str(e) or "ParseException" in type(e).__name__:
                raise ReadOnlyViolation(f"not a read-only query: {e}") from e
            raise
        finally:
            spark.catalog.dropTempView(probe)
        return spark.sql(text)
    first = head.split(None, 1)[0]
    if first not in ("SHOW", "DESCRIBE"):
        raise ReadOnlyViolation("Only SELECT / SHOW / DESCRIBE / WITH queries are allowed")
    try:
        return spark.sql(text)
    except AnalysisException as e:  # e.g. a second statement after the command
        if "PARSE_SYNTAX_ERROR" in str(e) or "ParseException" in type(e).__name__:
            raise ReadOnlyViolation(f"not a single read-only command: {e}") from e
        raise
