"""File sources and sinks of the experiment layer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType


def read_flows(spark: SparkSession, folder: str, schema: StructType | str | None = None, keep: list[str] | None = None) -> DataFrame:
    """All CSV files below a folder, with trimmed column names; unreadable files are skipped, ``keep`` filters labels."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("ignoreCorruptFiles", True).option("mode", "PERMISSIVE")
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(folder)
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.where(F.trim("Label").isin(keep)) if keep else df


def numeric_features(df: DataFrame, wanted: list[str] | None = None, label: str = "Label", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Numeric columns (of those wanted, if told) and the label."""
    names = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name != label and f.name not in exclude and (wanted is None or f.name in wanted)]
    return df.select(*names, *([label] if label in df.columns else []))


def cached(spark: SparkSession, config: dict, folder: str, build) -> DataFrame:
    """``build()`` written once under a path that depends on the whole config only."""
    import hashlib

    path = f"{folder}/{hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:24]}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_text(rows: DataFrame, path: str) -> None:
    """Ordered rows of one string column as one text file (small renders only)."""
    rows.coalesce(1).write.mode("overwrite").text(path)
