"""Reading tables; NULL becomes the only missing value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes NULL, in one projection."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*[F.when(~F.isnan(name(c)), name(c)).alias(c) if c in floats else name(c) for c in df.columns]) if floats else df
