"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Where it is unset (tests, local runs) a temporary
folder of this process is used. Tables are Parquet, so a later stage prunes columns and a lost executor
re-reads instead of recomputing.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one of this process, in local mode only."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="wirelattice-"))
    return "file://" + _LOCAL[0]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new table of the shared folder and read again, with its lineage cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` returned, once nothing that is still to run reads it."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def deploy(spark: SparkSession) -> None:
    """Ship this package to the Python workers, once per application, so that they need no installation."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    file = Path(tempfile.mkdtemp(prefix="wirelattice-")) / f"{package.name}.zip"
    with zipfile.ZipFile(file, "w") as out:
        for p in sorted(package.rglob("*.py")):
            out.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(file))
    _SHIPPED.add(app)
