"""Taking in files: naming them, choosing their collection, checking metadata, storing bytes.

Every rule is an expression on the file's own row, so a batch or a stream of any size is one scan.
Uploads are rows ``file_name, content_type, requested_prefix, metadata_json, length`` and, when
bytes are to be stored, ``content``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from .batches import BatchTable

# Fixed value: most bytes one upload may have, 25 MiB.
MAX_UPLOAD_BYTES = 25 * 1024 * 1024


@dataclass(frozen=True)
class IntakeConfig:
    account: str
    region: str
    default_prefix: str | None = None
    max_bytes: int = MAX_UPLOAD_BYTES

    def __post_init__(self) -> None:
        names.check_account(self.account)
        names.check_region(self.region)


def read_files(
    spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES
) -> DataFrame:
    """Files of a folder as upload rows without metadata.

    The length is tested by the scan itself: the bytes of a larger file, which may be more than a
    row can hold, are never read, and its row has no content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.filter(F.col("length") <= max_bytes)
    large = files.filter(F.col("length") > max_bytes).select("path", "modificationTime", "length")
    return as_uploads(small.unionByName(large, allowMissingColumns=True))


def as_uploads(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("path").alias("file_name"),
        F.lit(None).cast("string").alias("content_type"),
        F.lit(None).cast("string").alias("requested_prefix"),
        F.lit(None).cast("string").alias("metadata_json"),
        "length",
        "content",
        "path",
    )


def check_uploads(uploads: DataFrame, config: IntakeConfig) -> DataFrame:
    """Add what the rules make of every upload, with ``error`` set where one is broken."""
    name = F.col("file_name")
    prefix = names.chosen_collection(F.col("requested_prefix"), config.default_prefix)
    checked = uploads.withColumns(
        {
            "safe_name": names.safe_file_name(name),
            "prefix": prefix,
            "metadata": names.parse_metadata(F.col("metadata_json")),
            "stored_type": F.coalesce(
                F.col("content_type"), F.lit(names.DEFAULT_CONTENT_TYPE)
            ),
        }
    )
    missing = name.isNull() | (names.unicode_trim(name) == "")
    error = (
        F.when(F.col("length").isNull(), "file is required")
        .when(F.col("length") > config.max_bytes, "file is too large")
        .when(missing, "file name is required")
        .when(
            F.col("metadata").isNull(), "metadata has to be one JSON object whose values are text"
        )
        .when(F.col("safe_name").isNull(), "file name is invalid")
        .otherwise(names.collection_error(F.col("prefix"), config.account, config.region))
    )
    return checked.withColumn("error", error)


def manifest(
    checked: DataFrame, config: IntakeConfig, identity: list[Column] | None = None
) -> DataFrame:
    """``collection, object_key, content_type, metadata, length, e_tag`` of uploads without error.

    ``e_tag`` is the MD5 of the stored bytes, null if only a manifest is made.

    ``identity`` columns make the keys repeatable; without them they are random.
    """
    collection = names.collection_name(F.col("prefix"), config.account, config.region)
    stored = "content" in checked.columns
    e_tag = F.md5("content") if stored else F.lit(None).cast("string")
    extra = ["content"] if stored else []
    return checked.filter("error IS NULL").select(
        collection.alias("collection"),
        names.object_key(F.col("safe_name"), *(identity or [])).alias("object_key"),
        F.col("stored_type").alias("content_type"),
        names.with_collection(F.col("metadata"), collection).alias("metadata"),
        "length",
        e_tag.alias("e_tag"),
        *extra,
    )


def rejects(checked: DataFrame) -> DataFrame:
    """``file_name, error`` of the uploads that break a rule."""
    return checked.filter("error IS NOT NULL").select("file_name", "error")


def store(manifest_rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write manifest rows, with their bytes if they carry any, one folder per collection.

    Every task writes the rows it has, so no collection, however large, is gathered in one task.
    """
    manifest_rows.write.mode(mode).partitionBy("collection").parquet(path)


def stored(spark: SparkSession, path: str) -> BatchTable:
    """The table of what was taken in, one folder per collection in every batch."""
    return BatchTable(spark, path, ("collection",))


def store_batch(manifest_rows: DataFrame, path: str, batch: str) -> bool:
    """Store the manifest rows of a batch once; False if that was done before."""
    return stored(manifest_rows.sparkSession, path).append(manifest_rows, batch)
