"""Readers and writers. Every source has an explicit schema."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riffle import constants as C
from riffle.functions.semantics import recode


RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "rings": RINGS}


def schema_of(*columns: tuple[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in columns])


def constant_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A table of fixed values. It is a local relation, so its size is known to the optimizer."""
    kinds = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}
    columns = list(zip(*rows))
    arrays = [pa.array(values, kinds[field.dataType]) for values, field in zip(columns, schema.fields)]
    return spark.createDataFrame(pa.table(arrays, names=schema.names))


FLOW_WIDE = schema_of(
    ("masterid", "string"), ("longitude", "double"), ("latitude", "double"),
    *[(metric, "double") for metric in C.FLOW_METRICS],
)
LABELS = schema_of(("Flow Metric Name", "string"), ("Flow Metric Code", "string"), ("Flow Component", "string"))
CHANNEL_CLASS = schema_of(("masterid", "string"), ("channel_engineering_class", "string"))
CSCI_RAW = schema_of(
    ("masterid", "string"), ("sampleyear", "int"), ("fieldreplicate", "int"), ("csci", "string"),
    ("longitude", "double"), ("latitude", "double"), ("comid", "string"), ("county", "string"),
)
ASCI_RAW = schema_of(
    ("masterid", "string"), ("sampledate", "string"), ("replicate", "int"), ("result", "string"),
    ("longitude", "double"), ("latitude", "double"), ("comid", "string"), ("county", "string"),
)
PUBLISHED_LIMITS = schema_of(
    ("Hydro_endpoint", "string"), ("Bio_endpoint", "string"), ("Biol", "string"), ("Bio_threshold", "double"),
    ("Type", "string"), ("Threshold25", "double"), ("Threshold50", "double"), ("Threshold75", "double"),
)
GAGE = schema_of(("SiteNum", "string"), ("SiteName", "string"), ("Lat", "double"), ("Lon", "double"))
WATERSHED = schema_of(("HUC_12", "string"), ("rings", "rings"))
COUNTY = schema_of(("NAME_PCASE", "string"), ("rings", "rings"))
FLOW_EDGE = schema_of(("comid", "bigint"), ("to_comid", "bigint"), ("length_km", "double"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header line; the text ``NA`` is NULL.

    The header must name the columns of the schema in their order, and a value that does not fit its type ends the
    read: neither is passed over in silence.
    """
    return spark.read.schema(schema).csv(path, header=True, nullValue="NA", enforceSchema=False, mode="FAILFAST")


def read_numbered_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose first, unnamed column is a row number: it is dropped."""
    numbered = T.StructType([T.StructField("_row", T.StringType())] + schema.fields)
    # The header of that column is empty, so it cannot be compared with a name.
    return spark.read.schema(numbered).csv(path, header=True, nullValue="NA", enforceSchema=True, mode="FAILFAST").drop("_row")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV without row numbers; NULL is written as ``NA``."""
    df.write.csv(path, header=True, nullValue="NA")


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet between stages, partitioned by columns with few values."""
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def save_models(models: DataFrame, path: str) -> None:
    """One row per model: configuration keys, status, coefficients and fit statistics."""
    save_table(models, path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path)


def load_points(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Point layer kept as two coordinate columns."""
    return load_table(spark, path, schema)


def load_rings(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Polygon layer: one row per polygon, its rings as arrays of points."""
    return load_table(spark, path, schema)


def save_points(df: DataFrame, path: str, longitude: str = "longitude", latitude: str = "latitude") -> None:
    """Write the rows that have a position."""
    save_table(df.filter(F.col(longitude).isNotNull() & F.col(latitude).isNotNull()), path)


def label_dimension(labels: DataFrame, q99=C.Q99_LABEL) -> DataFrame:
    """Labels of the flow metrics, with the Q99 row added and the flow column as key.

    ``labels`` must have the columns of :data:`LABELS`. Codes outside the nine metrics get
    a NULL key and are dropped.
    """
    spark = labels.sparkSession
    named = labels.toDF("Flow_Metric_Name", "hydro_endpoints", "Flow_Component")
    extra = constant_table(spark, [q99], named.schema)
    codes = {code: column for column, code in C.METRIC_CODES.items()}
    keyed = named.unionByName(extra).withColumn("flow_metric", recode(F.col("hydro_endpoints"), codes))
    return keyed.na.drop(subset=["flow_metric"])
