"""Changes of a table in a folder, each of which happens once and as a whole.

A change has a key.  Its writer claims the key by creating ``claims/<key>``, writes its files, and
commits by renaming that mark to ``log/<key>~<what was written>``.  A mark can be renamed once, so a
key is committed once, whoever tries; readers see entries of the log and the files they name, never
those of a change that is not committed.  The file system must create and rename a file atomically.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import InvalidInput
from ..session import create_file, delete_file, file_names, rename_file

#: Between the key and the rest of an entry's name.
MARK = "~"


class Conflict(InvalidInput):
    """Another change came first."""


class CommitLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def entries(self) -> dict[str, str]:
        """What was written, by key, in the order of the keys."""
        found: dict[str, str] = {}
        for name in sorted(file_names(self.spark, f"{self.path}/log")):
            key, mark, written = name.partition(MARK)
            if mark:
                found.setdefault(key, written)
        return found

    def _claim_path(self, key: str) -> str:
        return f"{self.path}/claims/{key}"

    def claim(self, key: str) -> bool:
        """Whether the caller may go on to write the change."""
        if not create_file(self.spark, self._claim_path(key)):
            return False
        # Seen after the mark was made: a change that came first has left its entry by now.
        if key in self.entries():
            self.release(key)
            return False
        return True

    def claimed(self) -> list[str]:
        """Keys of changes that are being written, or whose writer died."""
        return sorted(file_names(self.spark, f"{self.path}/claims"))

    def commit(self, key: str, written: str) -> None:
        """Make the change part of the table; an error if the claim was taken away."""
        target = f"{self.path}/log/{key}{MARK}{written}"
        if not rename_file(self.spark, self._claim_path(key), target):
            raise Conflict(f"the change {key} was given up while it was written")

    def release(self, key: str) -> None:
        """Give the claim up, also that of another writer, whose commit will fail then."""
        delete_file(self.spark, self._claim_path(key))
