"""External databases by Spark's JDBC source, and which of them a process is configured for."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


class DependencyError(ImportError):
    """A driver that a connector needs is not on the class path."""


@dataclass(frozen=True)
class Dialect:
    driver: str
    url: str
    hint: str
    port: int | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    strip_semicolon: bool = False


#: SRC-01 to SRC-11; a {name} in a URL is filled from the connection's properties.
DIALECTS = {
    "sqlite": Dialect("org.sqlite.JDBC", "jdbc:sqlite:{path}", "org.xerial:sqlite-jdbc"),
    "mysql": Dialect(
        "com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", "com.mysql:mysql-connector-j", 3306,
        {"connectTimeout": "10000", "socketTimeout": "30000"},
    ),
    "postgres": Dialect("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", "org.postgresql:postgresql", 5432),
    "snowflake": Dialect("net.snowflake.client.jdbc.SnowflakeDriver", "jdbc:snowflake://{host}.snowflakecomputing.com/?db={database}", "net.snowflake:snowflake-jdbc"),
    "clickhouse": Dialect("com.clickhouse.jdbc.ClickHouseDriver", "jdbc:clickhouse://{host}:{port}/{database}", "com.clickhouse:clickhouse-jdbc", 8123),
    "oracle": Dialect("oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@{host}:{port}/{database}", "com.oracle.database.jdbc:ojdbc11", 1521, strip_semicolon=True),
    "bigquery": Dialect("com.simba.googlebigquery.jdbc.Driver", "jdbc:bigquery://{host}:443;ProjectId={database}", "a BigQuery JDBC driver"),
    "duckdb": Dialect("org.duckdb.DuckDBDriver", "jdbc:duckdb:{path}", "org.duckdb:duckdb_jdbc"),
    "mssql": Dialect("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://{host}:{port};databaseName={database}", "com.microsoft.sqlserver:mssql-jdbc", 1433),
    "presto": Dialect("com.facebook.presto.jdbc.PrestoDriver", "jdbc:presto://{host}:{port}/{database}", "com.facebook.presto:presto-jdbc", 443, {"SSL": "true"}, True),
    "hive": Dialect("org.apache.hive.jdbc.HiveDriver", "jdbc:hive2://{host}:{port}/{database}", "org.apache.hive:hive-jdbc", 10000, {"auth": "CUSTOM"}, True),
}


def driver_present(spark: SparkSession, name: str) -> bool:
    try:
        spark._jvm.java.lang.Class.forName(DIALECTS[name].driver)
    except Exception:
        return False
    return True


def jdbc_options(name: str, sql: str | None = None, table: str | None = None, **properties: str) -> dict[str, str]:
    """Options of ``spark.read.format("jdbc")``; exactly one of ``sql`` and ``table``."""
    if name not in DIALECTS:
        raise ValueError(f"unknown database kind {name}")
    if (sql is None) == (table is None):
        raise ValueError("give either sql or table")
    dialect = DIALECTS[name]
    values = {k: quote(str(v), safe=":/.-_\\") for k, v in properties.items()}
    if dialect.port and "port" not in values:
        values["port"] = str(dialect.port)
    try:
        url = dialect.url.format(**values)
    except KeyError as missing:
        raise ValueError(f"{name} needs {missing.args[0]}") from None
    out = {"url": url, "driver": dialect.driver, **dialect.options}
    for key in ("user", "password"):
        if key in properties:
            out[key] = str(properties[key])
    if sql is not None:
        out["query"] = re.sub(r";\s*\Z", "", sql.strip()) if dialect.strip_semicolon else sql
    else:
        out["dbtable"] = table
    statements = [f"USE {kind.upper()} {properties[kind]}" for kind in ("role", "warehouse") if properties.get(kind)] if name == "snowflake" else []
    if properties.get("init_sql"):
        statements.append(str(properties["init_sql"]))
    if statements:
        out["sessionInitStatement"] = "; ".join(statements)
    return out


def read_jdbc(
    spark: SparkSession, name: str, sql: str | None = None, table: str | None = None,
    partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 1, fetch_size: int = 10_000, **properties: str,
) -> DataFrame:
    """A lazy DataFrame; a partition column with bounds reads over several connections at once."""
    options = jdbc_options(name, sql, table, **properties)
    if not driver_present(spark, name):
        raise DependencyError(f"{name} needs {DIALECTS[name].hint} on the class path (spark.jars.packages)")
    reader = spark.read.format("jdbc").options(**options).option("fetchsize", fetch_size)
    if partition_column and bounds and partitions > 1:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def configured(environment: Mapping[str, str] | None = None) -> tuple[str, dict[str, str]] | None:
    """(kind, properties) of the process's database: MySQL if fully configured, else SQLite by its path."""
    env = os.environ if environment is None else environment
    mysql = {k: env.get(f"MYSQL_{k.upper()}") for k in ("host", "port", "user", "password", "database")}
    if all(mysql.values()):
        return "mysql", mysql
    if env.get("SQLITE_DB_PATH"):
        return "sqlite", {"path": env["SQLITE_DB_PATH"]}
    return None
