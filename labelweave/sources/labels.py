"""The label table ``label_id, name``: reading, adding and removing labels."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import InvalidInput, NotFound
from ..functions.names import canonical_id, is_object_id
from ..functions.text import unicode_trim
from .commits import CommitLog, Conflict

#: Kinds of changes, and the folders they are kept in.
WHOLE, ADDED, REMOVED = "whole", "added", "removed"
#: Changes that readers merge at most, unless writers meet all the time.
COMPACT_AFTER = 16

LABEL = T.StructType(
    [
        T.StructField("label_id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
    ]
)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL).parquet(path)


def clean_label_names(names: DataFrame, column: str = "name") -> DataFrame:
    """Trim names of all Unicode white space; blank and null ones become null."""
    trimmed = unicode_trim(F.col(column))
    return names.withColumn(column, F.when(trimmed != "", trimmed))


def new_object_id():
    """24 random hexadecimal characters."""
    return F.substring(F.regexp_replace(F.expr("uuid()"), "-", ""), 1, 24)


def create_labels(names: DataFrame) -> DataFrame:
    """New ``label_id, name`` rows with generated ids; equal names are different labels."""
    cleaned = clean_label_names(names.select("name"))
    if cleaned.filter("name IS NULL").limit(1).count():
        raise InvalidInput("a label needs a name that is not blank")
    return cleaned.select(new_object_id().alias("label_id"), "name")


class LabelTable:
    """Labels kept in a folder as a log of added and removed rows.

    A change writes its own rows only: those added, the ids removed, or a whole table.  Readers merge
    the changes since the last whole table, which is written anew after ``COMPACT_AFTER`` changes.
    Versions are numbers that are claimed before the table is read for a change, so of two changes
    at once the second fails instead of undoing the first, and a lost executor or a failed job leaves
    the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.log = CommitLog(spark, self.path)

    def _folder(self, kind: str, version: str) -> str:
        return f"{self.path}/{kind}/version={version}"

    def _since_whole(self) -> dict[str, list[str]]:
        """Committed versions by kind, from the last whole table on."""
        found: dict[str, list[str]] = {WHOLE: [], ADDED: [], REMOVED: []}
        for version, kind in self.log.entries().items():
            if kind == WHOLE:
                found = {WHOLE: [], ADDED: [], REMOVED: []}
            found[kind].append(version)
        return found

    def _scan(self, kind: str, versions: list[str], schema: T.StructType) -> DataFrame:
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}")
        return reader.parquet(*[self._folder(kind, version) for version in versions])

    def read(self) -> DataFrame:
        changes = self._since_whole()
        versioned = T.StructType([*LABEL.fields, T.StructField("version", T.LongType())])
        parts = [self._scan(k, changes[k], versioned) for k in (WHOLE, ADDED) if changes[k]]
        if not parts:
            return self.spark.createDataFrame([], LABEL)
        labels = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
        if changes[REMOVED]:
            ids = T.StructType([LABEL["label_id"], T.StructField("version", T.LongType())])
            gone = self._scan(REMOVED, changes[REMOVED], ids).toDF("gone", "since")
            later = (F.col("label_id") == F.col("gone")) & (F.col("version") < F.col("since"))
            labels = labels.join(gone, later, "left_anti")
        return labels.select("label_id", "name")

    def _change(self, kind: str, rows_of: Callable[[], DataFrame]) -> str:
        """Commit the rows a function makes of the table as it is while the version is claimed."""
        entries = self.log.entries()
        version = f"{int(max(entries, default='0')) + 1:09d}"
        if not self.log.claim(version):
            raise Conflict(f"the labels are being changed by someone else (version {version})")
        try:
            # A writer that was given up may have left rows of this version.
            rows_of().write.mode("overwrite").parquet(self._folder(kind, version))
        except BaseException:
            self.log.release(version)
            raise
        self.log.commit(version, kind)
        return version

    def _written(self, kind: str, version: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._folder(kind, version))

    def replace(self, labels: DataFrame) -> None:
        """Make a table of ``label_id, name`` the latest version."""
        self._change(WHOLE, lambda: labels.select("label_id", "name"))

    def create(self, names: DataFrame) -> DataFrame:
        """Store new labels and return the stored rows, with the ids they got."""
        # Ids are drawn once, when they are written; what is returned is what was stored.
        version = self._change(ADDED, lambda: create_labels(names))
        self._compact_if_long()
        return self._written(ADDED, version, LABEL)

    def delete(self, ids: DataFrame) -> DataFrame:
        """Remove labels by their ids and return the removed rows."""
        seen = []

        def removed() -> DataFrame:
            seen.append(self.read())
            return delete_labels(seen[0], ids)[0].select("label_id").distinct()

        version = self._change(REMOVED, removed)
        self._compact_if_long()
        gone = self._written(REMOVED, version, T.StructType([LABEL["label_id"]]))
        return seen[0].join(gone, "label_id", "left_semi")

    def compact(self) -> None:
        """Write the merged labels as a whole table, which readers start from afterwards."""
        self._change(WHOLE, self.read)

    def _compact_if_long(self) -> None:
        changes = self._since_whole()
        if len(changes[ADDED]) + len(changes[REMOVED]) >= COMPACT_AFTER:
            # Whoever changes the labels just now will do it.
            with contextlib.suppress(Conflict):
                self.compact()

    def give_up(self) -> list[str]:
        """Let go the claims of writers that died, and return the versions they were to write."""
        claimed = self.log.claimed()
        for version in claimed:
            self.log.release(version)
        return claimed


def delete_labels(labels: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split labels into those removed by ``ids`` and those kept.

    Whether documents still refer to a label is not checked.  An id no label has is an error.
    """
    wanted = ids.select(F.col("label_id")).distinct()
    if wanted.join(labels, "label_id", "left_anti").limit(1).count():
        raise NotFound("unknown label")
    return labels.join(wanted, "label_id", "left_semi"), labels.join(
        wanted, "label_id", "left_anti"
    )


def malformed_ids(ids: DataFrame) -> DataFrame:
    """Ids that are not 24 hexadecimal characters."""
    return ids.filter(~F.coalesce(is_object_id(F.col("label_id")), F.lit(False)))


def check_object_ids(ids: DataFrame) -> DataFrame:
    """The same rows with ids in lower case."""
    if malformed_ids(ids).limit(1).count():
        raise InvalidInput("a label id is not 24 hexadecimal characters")
    return ids.withColumn("label_id", canonical_id(F.col("label_id")))
