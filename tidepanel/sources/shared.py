"""Tables in the folder that driver and executors share, and names that clash with none."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset a local session gets a folder of its own; a cluster stops."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidepanel-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Let the workers import this package where they cannot already find it."""
    root = Path(__file__).resolve().parents[2]
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if any(p and Path(p).resolve() == root for p in paths):
        return
    if any(Path(p).name == "tidepanel.zip" for p in getattr(spark.sparkContext, "_python_includes", [])):
        return
    target = Path(tempfile.mkdtemp()) / "tidepanel.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted((root / "tidepanel").rglob("*.py")):
            archive.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(target))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
