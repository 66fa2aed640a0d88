"""Tables that grow by batches, each of which is stored once however often it is written.

A stream runs its last batch again after a failure, and a job is retried; both bring the rows of the
same batch id.  Every attempt writes a folder of its own and the log names the one that counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..config import InvalidInput
from .commits import MARK, CommitLog, Conflict

#: Names the folder of an attempt, so that all of them are one table with partitions.
ATTEMPT = "_attempt"


class BatchTable:
    """Rows by batch under ``path``: a folder of ``attempts`` holds data, ``log`` says which count."""

    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = ()) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.log = CommitLog(spark, self.path)
        self.partition_by = partition_by

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Store the rows of a batch; False if the batch is stored already, then nothing is written.

        Who brings a batch anew takes the place of a writer that died half way.
        """
        if not batch or MARK in batch or "/" in batch:
            raise InvalidInput(f"not a batch id: {batch!r}")
        if batch in self.log.entries():
            return False
        if not self.log.claim(batch):
            self.log.release(batch)
            if not self.log.claim(batch):
                return False
        attempt = uuid.uuid4().hex
        rows.write.mode("error").partitionBy(*self.partition_by).parquet(self._folder(attempt))
        try:
            self.log.commit(batch, attempt)
        except Conflict:
            # Two attempts at once: the one that was committed holds the batch.
            if batch not in self.log.entries():
                raise
            return False
        return True

    def _folder(self, attempt: str) -> str:
        return f"{self.path}/attempts/{ATTEMPT}={attempt}"

    def batches(self) -> list[str]:
        return list(self.log.entries())

    def read(self, schema: T.StructType | None = None) -> DataFrame | None:
        """All rows of the stored batches, None if there is none yet.

        The attempts that count are read by one scan, as partitions of a folder each.
        """
        entries = self.log.entries()
        if not entries:
            return None
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        folders = [self._folder(attempt) for attempt in entries.values()]
        rows = reader.option("basePath", f"{self.path}/attempts").parquet(*folders)
        return rows.drop(ATTEMPT)

    def append_stream(self, rows: DataFrame, name: str) -> DataStreamWriter:
        """A writer that stores every micro-batch of a stream under its number."""

        def store(batch: DataFrame, number: int) -> None:
            BatchTable(batch.sparkSession, self.path, self.partition_by).append(
                batch, f"{name}-{number:012d}"
            )

        return rows.writeStream.foreachBatch(store)

