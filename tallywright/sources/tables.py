"""Operational tables: Parquet folders or JDBC, and schema discovery."""

from __future__ import annotations

import os

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..schemas import Books

# Declared, so that no job runs to infer them.
ORDER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
}
ORDER_TABLES = tuple(ORDER_SCHEMAS)


def load_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = ORDER_TABLES) -> Books:
    """One lazy DataFrame per ``<folder>/<name>.parquet``; columns and filters reach the scan.

    Tables with a declared schema are read with it, others by the schema in their files.
    """

    def reader(name: str):
        source = spark.read.schema(ORDER_SCHEMAS[name]) if name in ORDER_SCHEMAS else spark.read
        return lambda: source.parquet(os.path.join(folder, f"{name}.parquet"))

    return Books({name: reader(name) for name in names})


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """Table of a live database, read in ``partitions`` parallel ranges of ``partition_column``.

    The driver jar and the credentials come from the caller's options, never from this package.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **options)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=bounds[0],
            upperBound=bounds[1],
            numPartitions=str(partitions),
        )
    return reader.load()


def describe_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Field list of every table, from metadata only: no data is read."""
    rows = [
        (name, position, field.name, field.dataType.simpleString(), field.nullable)
        for name, frame in sorted(tables.items())
        for position, field in enumerate(frame.schema.fields)
    ]
    return spark.createDataFrame(
        rows, "table_name string, position int, field string, type string, nullable boolean"
    )
