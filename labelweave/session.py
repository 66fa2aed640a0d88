"""What every job needs from its session: shared staging, broadcasts and sizing."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
import zipfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import InvalidInput

#: Most a table may weigh, by a measured estimate, before it is no longer broadcast.
BROADCAST_BYTES = 256 * 1024 * 1024
#: Bytes one input split holds.
SPLIT_BYTES = 128 * 1024 * 1024
#: Estimated cost of one row of a hash relation besides its own values.
ROW_OVERHEAD = 48


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without one: a temporary folder is then chosen and recorded in
    the session, which tests rely on.  On a cluster a folder of one machine is of no use to the
    others, so the setting is required there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise InvalidInput("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="labelweave-"))
    return context.getCheckpointDir().rstrip("/")


class Staging:
    """Intermediate tables of one run, written to the shared folder and read back.

    A written table ends the lineage, survives lost executors, keeps column pruning and gives the
    planner exact sizes.  Nothing is cached in executor memory.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.path = f"{staging_root(spark)}/labelweave-{uuid.uuid4().hex}"

    def write(self, table: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        table.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def remove(self, name: str) -> None:
        """Delete a table that nothing reads any more, and the shuffles of plans that are done.

        Spark deletes the files of a shuffle when the driver's garbage collector has found its plan,
        which a driver that makes little garbage may not do for half an hour.
        """
        path, system = _file_system_path(self.spark, f"{self.path}/{name}")
        system.delete(path, True)
        self.spark._jvm.System.gc()

    def drop(self) -> None:
        """Delete the tables of this run; frames reading them can no longer be used."""
        path, system = _file_system_path(self.spark, self.path)
        system.delete(path, True)


def _file_system_path(spark: SparkSession, path: str):
    """A path and its file system, whichever connector serves it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    path, system = _file_system_path(spark, path)
    return system.exists(path)


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    path, system = _file_system_path(spark, path)
    return [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []


def create_file(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it was there.  Of several callers one succeeds."""
    path, system = _file_system_path(spark, path)
    return not system.exists(path) and system.createNewFile(path)


def rename_file(spark: SparkSession, source: str, target: str) -> bool:
    """Move a file; False if there is none any more.  Of several callers one succeeds."""
    source, system = _file_system_path(spark, source)
    target, _ = _file_system_path(spark, target)
    system.mkdirs(target.getParent())
    return system.exists(source) and system.rename(source, target)


def delete_file(spark: SparkSession, path: str) -> None:
    path, system = _file_system_path(spark, path)
    system.delete(path, False)


def estimated_bytes(rows: int, text_bytes: int, fixed_columns: int) -> int:
    """Memory a hash relation of so many rows, text bytes and 8-byte columns needs."""
    return rows * (ROW_OVERHEAD + 8 * fixed_columns) + text_bytes


@dataclass(frozen=True)
class ClassTableSize:
    """What is known of tables with one row per class: how many rows, and how long their labels."""

    classes: int
    label_bytes: int
    budget: int = BROADCAST_BYTES

    def hint(self, table: DataFrame, value_columns: int) -> DataFrame:
        """Hint a broadcast of a table of so many 8-byte values per class, if that is small."""
        weight = estimated_bytes(self.classes, self.label_bytes, value_columns)
        return F.broadcast(table) if weight <= self.budget else table


def broadcast_if_small(
    table: DataFrame, text_column: str, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """Hint a broadcast after weighing the table; a heavier one is left to the planner."""
    rows, text = table.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum(F.octet_length(F.col(text_column).cast("string"))), F.lit(0)),
    ).first()
    weight = estimated_bytes(rows, text, len(table.columns))
    return F.broadcast(table) if weight <= budget else table


#: Bytes that meet a shuffle for each byte of text: ids, sides, and sums per term and class that
#: were combined before.  Texts and the terms of documents are not shuffled.
SHUFFLED_SHARE = 0.05


def session_conf(
    corpus_bytes: int, cores: int, shuffled_share: float = SHUFFLED_SHARE
) -> dict[str, str]:
    """Settings for a corpus of a given size.

    Partitions of about 128 MiB keep sorts and hash tables inside an executor core's share of
    memory.  Adaptive execution merges what turns out smaller and splits what turns out skewed.
    """
    partitions = max(cores, math.ceil(shuffled_share * corpus_bytes / SPLIT_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(SPLIT_BYTES),
        "spark.sql.session.timeZone": "UTC",
        # A training run compiles about 160 classes; the default cache of 100 would forget the
        # first ones before the next run could use them again.
        "spark.sql.codegen.cache.maxEntries": "1000",
    }


#: Most bytes of a batch that goes to a Python worker.  Spark counts 10,000 rows to a batch, which
#: of rows with long lists are many times as much, in the worker and in the executor beside it.
BATCH_BYTES = 16 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Measure Arrow batches by bytes; a smaller setting of the session's own is kept."""
    own = re.fullmatch(r"(\d+)b?", spark.conf.get(_BATCH_SETTING))
    if own is None or int(own[1]) > most:
        spark.conf.set(_BATCH_SETTING, f"{most}b")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    if spark.sparkContext.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="shipped-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent).as_posix())
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(spark.sparkContext.applicationId)
