"""External inputs: delimited text with an explicit schema, outlines, raster cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTLINE_SCHEMA = T.StructType([
    T.StructField("region", T.StringType()),
    T.StructField("ring", T.IntegerType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
])


def read_table(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
               null_value: str = "NA") -> DataFrame:
    """Delimited file with a header. The schema is given, never inferred: inference turns
    decimal-comma longitudes into text and drops the point of latitudes. Columns bind by
    position, so the schema may carry normalised names for headers with spaces or dots."""
    return (spark.read.schema(schema).option("header", True).option("sep", sep)
            .option("nullValue", null_value).option("enforceSchema", True).csv(path))


def read_polygons(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """Outline vertices (region, ring, seq, lon, lat), optionally only the named regions; the
    name test is pushed to the Parquet scan."""
    df = spark.read.parquet(path)
    return df if names is None else df.filter(F.col("region").isin(list(names)))


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """Raster cells, one row per cell."""
    return spark.read.parquet(path)
