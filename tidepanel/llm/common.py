"""Shared plumbing of the text operators: shared-folder tables, table readers, Arrow helpers."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+``, as a Java character class.
WORD_SPACE = r"[\x20\x09-\x0D]+"


#: Folders of the tables that ``materialize`` has written, by the frame that reads them.
_FOLDERS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a run on one machine gets a folder of its own; on a cluster that would be a folder of
    the driver alone, so the job stops.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidepanel-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` once as Parquet in the shared folder and read it back.

    The files outlive executors, so a later stage survives the loss of the one that made them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[stored] = path
    return stored


def discard(stored: DataFrame) -> None:
    """Delete the folder of a table that ``materialize`` gave and that nothing will read again."""
    path = _FOLDERS.pop(stored, None)
    if path:
        spark = stored.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def set_aside(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` with the columns that are called as one of ``names`` (in any case) renamed to ``input_<name>``.

    Where there is such a column already, more ``input_`` go before it.
    """
    wanted = {n.lower() for n in names}
    taken, renamed = wanted | {c.lower() for c in df.columns}, {}
    for column in df.columns:
        if column.lower() in wanted:
            new = f"input_{column}"
            while new.lower() in taken:
                new = f"input_{new}"
            taken.add(new.lower())
            renamed[column] = new
    return df.withColumnsRenamed(renamed)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts; one pass that sends one number."""
    row = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("n")).first()
    return int(row["n"] or 0)


def parts_for(total: int, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` units hold ``total`` units."""
    return max(least, math.ceil(total / each))


#: Partitions that an exchange is asked for at most, whatever the input: what a driver can still schedule.
MOST_PARTITIONS = 8192


def block_plan(total: int, least: int, most: int) -> tuple[int, int]:
    """(blocks, partitions) for ``total`` bytes: blocks grow from ``least`` to ``most`` bytes before partitions hold several of them."""
    each = min(max(math.ceil(total / MOST_PARTITIONS), least), max(least, most))
    blocks = parts_for(total, each)
    return blocks, min(blocks, MOST_PARTITIONS)


def column_list(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batch: pa.RecordBatch, text_col: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes, one row at least."""
    col = batch.column(batch.schema.get_field_index(text_col))
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield batch.slice(start)
