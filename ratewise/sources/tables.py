"""Readers for the driver's parquet tables (SRC-01).

Reads are lazy: Catalyst prunes columns and pushes predicates into the
parquet scan, so callers select only what they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


_HANDLES: dict[tuple[int, str], DataFrame] = {}


class Tables:
    """Named access to the parquet tables under one directory.

    The scan handles (a file listing and a schema, no data) are kept per
    session and path, like tables registered once in a catalog; every
    query still reads the files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(f"unknown table {name!r}")
        path = f"{self.sf_dir}/{name}.parquet"
        key = (id(self.spark._jsparkSession), path)
        df = _HANDLES.get(key)
        if df is None or df.sparkSession is not self.spark:
            df = _HANDLES[key] = self.spark.read.parquet(path)
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.read(name)
        raise AttributeError(name)


def load(spark: SparkSession, path: str, tenant_id: int | None = None,
         columns: list[str] | None = None) -> DataFrame:
    """SRC-01: scan a tenant-partitioned table with the tenant filter.

    With a ``tenant_id`` partition column the filter prunes directories;
    otherwise it is pushed into the parquet reader as a row-group filter.
    """
    df = spark.read.parquet(path)
    if tenant_id is not None:
        df = df.where(F.col("tenant_id") == F.lit(tenant_id))
    if columns:
        df = df.select(*columns)
    return df
