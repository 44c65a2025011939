"""Tables of a database over JDBC, and settings from a file and the environment."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TRUE = frozenset({"1", "true", "yes", "y", "on"})


def settings(path: str | None = None, environment: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=value lines; comments and lines without = are skipped, quotes around values dropped; the environment wins."""
    found: dict[str, str] = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, eq, value = line.strip().partition("=")
                if eq and key.strip() and not key.startswith("#"):
                    found[key.strip()] = value.strip().strip("\"'")
    return found | dict(os.environ if environment is None else environment)


def flag(values: dict[str, str], name: str, default: bool) -> bool:
    value = values.get(name, "").strip().lower()
    return value in TRUE if value else default


def connection(values: dict[str, str]) -> tuple[str, dict[str, str]]:
    """The JDBC address and properties of a SQL Server: a whole address, or server and database."""
    if values.get("DB_URL"):
        return values["DB_URL"], {}
    server, database = values.get("DB_SERVER") or "localhost", values.get("DB_NAME") or "records"
    user = values.get("DB_USER")
    options = "" if user else ";integratedSecurity=true"
    return f"jdbc:sqlserver://{server};databaseName={database};encrypt=false{options}", {"user": user, "password": values.get("DB_PASSWORD", "")} if user else {}


def read_table(spark: SparkSession, name: str, values: dict[str, str], key: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A table; by ranges of a key in several parts if a key is given. Filters and columns reach the database."""
    address, properties = connection(values)
    if key:
        return spark.read.jdbc(address, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)
    return spark.read.jdbc(address, name, properties=properties)


def write_table(df: DataFrame, name: str, values: dict[str, str], mode: str = "append") -> None:
    address, properties = connection(values)
    df.write.jdbc(address, name, mode=mode, properties=properties)
