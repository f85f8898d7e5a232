"""JDBC scans. Url, driver and credentials always come from the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    url: str,
    *,
    query: str | None = None,
    table: str | None = None,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    fetchsize: int = 10_000,
    partition_column: str | None = None,
    lower_bound: object | None = None,
    upper_bound: object | None = None,
    num_partitions: int | None = None,
) -> dict[str, str]:
    """Reader options for one scan.

    Exactly one of ``query`` and ``table``. Spark's JDBC source pushes filters and columns but not a row
    limit, so a limit belongs inside ``query``. With a partition column the scan is split over executors;
    Spark forbids that column together with the ``query`` option, so the query is then sent as a derived table.
    """
    if (query is None) == (table is None):
        raise ValueError("give exactly one of query and table")
    bounds = (partition_column, lower_bound, upper_bound, num_partitions)
    if any(b is not None for b in bounds) and any(b is None for b in bounds):
        raise ValueError("a partitioned scan needs partition_column, lower_bound, upper_bound and num_partitions")
    options: dict[str, str] = {"url": url, "fetchsize": str(fetchsize)}
    if table is not None:
        options["dbtable"] = table
    elif partition_column is not None:
        options["dbtable"] = f"({query}) src"
    else:
        options["query"] = query
    for key, value in (("user", user), ("password", password), ("driver", driver)):
        if value is not None:
            options[key] = value
    if partition_column is not None:
        options["partitionColumn"] = partition_column
        options["lowerBound"] = str(lower_bound)
        options["upperBound"] = str(upper_bound)
        options["numPartitions"] = str(num_partitions)
    return options


def read_jdbc(spark: SparkSession, url: str, **options) -> DataFrame:
    """Table or pushed-down subquery as a DataFrame; see :func:`jdbc_options`."""
    return spark.read.format("jdbc").options(**jdbc_options(url, **options)).load()
