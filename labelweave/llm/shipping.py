"""Make this package importable in Python workers, wherever they run."""

from __future__ import annotations

import ctypes
import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Most bytes of a batch that goes to a worker.  Spark counts 10,000 rows to a batch, which of long
#: texts are many times as much, in the worker and twice in the executor beside it.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: What a worker's tasks leave to later ones, by name.
left_behind: dict[str, object] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, as ``addPyFile`` does."""
    if spark.sparkContext.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="package-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent).as_posix())
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(spark.sparkContext.applicationId)


def _give_back() -> None:
    """Return freed memory to the system: a worker lives on, and its heap would only grow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # of the GNU library
        trim(0)


def _drop_others(keep: str | None) -> None:
    """Forget what other work left behind in this worker."""
    for name in [name for name in left_behind if name != keep]:
        del left_behind[name]


def map_arrow(table: DataFrame, function, schema: str, keep: str | None = None) -> DataFrame:
    """``mapInArrow`` with the package at hand in the workers, which hold no memory between tasks.

    Only what is left behind by the name ``keep`` stays, until tasks that keep something else.
    Batches are measured by bytes.  Spark reads that setting when a query runs, so it is made for the
    session, unless the session has a smaller one.
    """
    spark = table.sparkSession
    ship(spark)
    own = re.fullmatch(r"(\d+)b?", spark.conf.get(_BATCH_SETTING))
    if own is None or int(own[1]) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_others(keep)
        try:
            yield from function(batches)
        finally:
            _give_back()

    return table.mapInArrow(task, schema)
