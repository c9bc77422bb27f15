"""Raw sources: delimited text, GeoJSON lines, and column-pruned Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delimited(spark: SparkSession, path: str, *, sep: str = ";", encoding: str = "UTF-8", columns: Sequence[str] | None = None) -> DataFrame:
    """A text table with a header, all columns as strings, so that the import decides what they are."""
    df = spark.read.csv(path, sep=sep, header=True, encoding=encoding, inferSchema=False, multiLine=False)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def geojson_lines(spark: SparkSession, path: str, properties: dict[str, str]) -> DataFrame:
    """Origin and destination of each LineString feature: its first and last vertex, and the named properties (name -> SQL type)."""
    props = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in properties.items()])
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.ArrayType(T.DoubleType())))])
    feature = T.StructType([T.StructField("geometry", geometry), T.StructField("properties", props)])
    raw = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])).json(path, multiLine=True)
    f = raw.select(F.explode("features").alias("f")).filter((F.col("f.geometry.type") == "LineString") & (F.size("f.geometry.coordinates") > 1))
    first, last = F.element_at("f.geometry.coordinates", 1), F.element_at("f.geometry.coordinates", -1)
    return f.select(
        F.get(first, F.lit(0)).alias("origin_longitude"), F.get(first, F.lit(1)).alias("origin_latitude"), F.get(last, F.lit(0)).alias("destination_longitude"), F.get(last, F.lit(1)).alias("destination_latitude"), *[F.col(f"f.properties.`{n}`") for n in properties]
    )
