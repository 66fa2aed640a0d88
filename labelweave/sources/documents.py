"""Documents: one row per document with its pages in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MAX_PAGES, InvalidInput
from ..functions.names import canonical_id, is_object_id
from ..functions.text import is_one_json_value
from ..session import Staging, broadcast_if_small

TRAINING_DOCUMENT = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("pages", T.ArrayType(T.StringType(), False), False),
        T.StructField("label_id", T.StringType(), False),
    ]
)
# What a well-formed record looks like to the reader, with pages and without any.
RECORD_KINDS = tuple(
    f"OBJECT<label_id: STRING, name: STRING, pages: ARRAY<{page}>>" for page in ("STRING", "VOID")
)


def to_documents(
    table: DataFrame,
    doc_id: str,
    pages: str | Column,
    label: str | None = None,
    name: str | None = None,
) -> DataFrame:
    """Bring a table of whole documents into the shape ``doc_id, [name], pages, [label_id]``.

    ``pages`` is an array column, or a text column that then is the only page.
    """
    column = F.col(pages) if isinstance(pages, str) else pages
    kind = table.select(column.alias("pages")).schema["pages"].dataType
    if not isinstance(kind, T.ArrayType):
        column = F.array(column)
    chosen = [F.col(doc_id).alias("doc_id")]
    if name:
        chosen.append(F.col(name).alias("name"))
    chosen.append(column.alias("pages"))
    if label:
        chosen.append(F.col(label).cast("string").alias("label_id"))
    return table.select(*chosen)


def documents_from_pages(
    table: DataFrame, doc_id: str, order: str, text: str, label: str | None = None
) -> DataFrame:
    """Gather a table of single pages into documents, pages in the given order.

    Pages per document are counted first, so that no more than the page limit is ever brought
    together in one row, whatever the share of a single document.
    """
    counts = table.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n"))
    if counts.filter(F.col("n") > MAX_PAGES).limit(1).count():
        raise InvalidInput("a document has more pages than allowed")
    gathered = table.groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
        .alias("_pages"),
        *([_one_label(F.col(label).cast("string")).alias("label_id")] if label else []),
    )
    pages = F.transform("_pages", lambda p: F.coalesce(p["t"], F.lit(""))).alias("pages")
    return gathered.select("doc_id", pages, *(["label_id"] if label else []))


def _one_label(label: Column) -> Column:
    """The label that all pages of a document carry; pages that differ or lack one are an error."""
    agree = F.min(label).eqNullSafe(F.max(label)) & (F.count(label) == F.count(F.lit(1)))
    wrong = F.raise_error(F.lit("the pages of a document carry different labels or none"))
    return F.when(agree, F.min(label)).otherwise(wrong.cast("string"))


def page_counts(documents: DataFrame) -> DataFrame:
    """Number of pages of every document."""
    return documents.select("doc_id", F.size("pages").cast("bigint").alias("page_count"))


def read_training_documents(
    spark: SparkSession,
    path: str,
    format: str = "json",
    object_ids: bool = False,
    staging: Staging | None = None,
) -> DataFrame:
    """Labelled documents ``name, pages, label_id`` from JSON lines or parquet.

    The files must hold exactly these fields.  A JSON reader skips fields it was not told of and
    turns numbers into text, so the shape of every record is checked; ``object_ids`` also requires
    label ids of 24 hexadecimal characters and brings them to lower case.  Positions in the input
    have no meaning in a distributed table, so each row gets an id made from its content and a
    running number among equal rows.  The input is parsed once, into a staged table with what the
    checks found; checks and ids work on that.
    """
    staging = staging or Staging(spark)
    shaped = F.lit(True)
    wanted = set(TRAINING_DOCUMENT.names)
    if format == "json":
        lines = spark.read.text(path).filter(F.trim("value") != "")
        kind = F.schema_of_variant(F.try_parse_json("value"))
        sound = F.coalesce(kind.isin(*RECORD_KINDS), F.lit(False))
        shaped = sound & is_one_json_value(F.col("value"))
        rows = lines.select(
            F.from_json("value", TRAINING_DOCUMENT).alias("d"), shaped.alias("_shaped")
        ).select("d.*", "_shaped")
    else:
        rows = spark.read.format(format).load(path)
        if set(rows.columns) != wanted:
            raise InvalidInput(f"the table must have the fields {', '.join(sorted(wanted))}")
        rows = rows.select(
            *[F.col(f.name).cast(f.dataType.simpleString()) for f in TRAINING_DOCUMENT],
            shaped.alias("_shaped"),
        )
    missing = F.lit(False)
    for name in TRAINING_DOCUMENT.names:
        missing = missing | F.col(name).isNull()
    missing = missing | F.exists("pages", lambda p: p.isNull())
    if object_ids:
        missing = missing | ~is_object_id(F.col("label_id"))
        rows = rows.withColumn("label_id", canonical_id(F.col("label_id")))
    names = TRAINING_DOCUMENT.names
    digest = F.sha2(F.to_json(F.struct(*names)), 256).alias("_digest")
    parsed = staging.write(
        rows.select(*names, "_shaped", (~missing).alias("_complete"), digest), "parsed"
    )
    unshaped, incomplete = parsed.agg(
        F.count_if(~F.col("_shaped")), F.count_if(~F.col("_complete"))
    ).first()
    if unshaped:
        raise InvalidInput(
            f"every record must have the fields {', '.join(sorted(wanted))}, no others, "
            "and hold text in them"
        )
    if incomplete:
        raise InvalidInput("a document lacks a field or holds one of the wrong kind")
    return with_document_ids(parsed.drop("_shaped", "_complete"))


def with_document_ids(rows: DataFrame, block: int = 10_000) -> DataFrame:
    """Add ``doc_id``, stable over reruns: a digest of the row plus a number among equal rows.

    Only digests are shuffled to find the repeated ones; all other rows stay where they were read.
    Copies of one row are interchangeable, so repeated rows are rebuilt from one of them, in
    blocks of numbers that are spread over the cluster before they become rows.  A column
    ``_digest`` of the rows is used if they have one, and worked out else.
    """
    digested = rows
    if "_digest" not in rows.columns:
        digested = rows.withColumn("_digest", F.sha2(F.to_json(F.struct(*rows.columns)), 256))
    rows = digested.drop("_digest")
    repeated = (
        digested.groupBy("_digest").agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    )
    repeated = broadcast_if_small(repeated, "_digest")
    single = digested.join(repeated, "_digest", "left_anti").select(
        F.concat("_digest", F.lit("-1")).alias("doc_id"), *rows.columns
    )
    one_of_each = (
        digested.join(repeated, "_digest")
        .groupBy("_digest", "_copies")
        .agg(F.first(F.struct(*rows.columns)).alias("_row"))
    )
    blocks = one_of_each.withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / block)))
    ).repartition("_digest", "_block")
    low = F.col("_block") * block + 1
    high = F.least(F.col("_copies"), low + (block - 1))
    copies = blocks.withColumn("_copy", F.explode(F.sequence(low, high))).select(
        F.concat_ws("-", "_digest", "_copy").alias("doc_id"), "_row.*"
    )
    return single.unionByName(copies)
