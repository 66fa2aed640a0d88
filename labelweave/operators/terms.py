"""Term and document statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import document_tokens, text_blocks, with_term_counts
from ..session import Staging

#: Bytes of a document whose words are sorted in one row.  A longer document is counted block by
#: block.
BLOCK_BYTES = 4 << 20


def counted_documents(
    documents: DataFrame,
    staging: Staging | None = None,
    name: str = "counted",
    block: int = BLOCK_BYTES,
) -> DataFrame:
    """Replace ``pages`` by ``terms, total, mx``, as a staged table.

    Words are counted where they are, a block of a document at a time, in one pass over the text.
    Nearly all documents are one block, and final; the counts of the others' blocks are summed by
    document and term, so that none of their texts is ever sorted as a whole.  The same rows come
    out whatever a block holds.
    """
    staging = staging or Staging(documents.sparkSession)
    rest = [c for c in documents.columns if c != "pages"]
    blocks = documents.withColumn("pages", text_blocks(F.col("pages"), block))
    blocks = blocks.withColumns({"_row": F.monotonically_increasing_id(), "_blocks": F.size("pages")})
    rows = blocks.select(*rest, "_row", "_blocks", F.posexplode("pages").alias("_block", "pages"))
    counted = staging.write(with_term_counts(rows), name)
    whole = counted.filter("_blocks = 1").select(*rest, "terms", "total", "mx")
    cut = counted.filter("_blocks > 1")
    if cut.select("_row").isEmpty():
        return whole
    sums = cut.select("_row", F.inline("terms")).groupBy("_row", "term").agg(F.sum("cnt").alias("cnt"))
    merged = sums.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("term", "cnt"))).alias("terms"),
        F.sum("cnt").alias("total"),
        F.max("cnt").alias("mx"),
    )
    none = F.array().cast(counted.schema["terms"].dataType)
    first = cut.filter("_block = 0").select(*rest, "_row")
    found = first.join(merged, "_row", "left").select(
        *rest,
        F.coalesce("terms", none).alias("terms"),
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
        F.coalesce("mx", F.lit(0)).cast("bigint").alias("mx"),
    )
    return whole.unionByName(staging.write(found, f"{name}-merged"))


def term_counts(documents: DataFrame, staging: Staging | None = None) -> DataFrame:
    """``doc_id, term, cnt``: occurrences of every term over all pages of a document.

    With ``staging`` long documents are counted block by block.
    """
    return _counted(documents, staging).select("doc_id", F.inline("terms"))


def _counted(documents: DataFrame, staging: Staging | None) -> DataFrame:
    documents = documents.select("doc_id", "pages")
    return with_term_counts(documents) if staging is None else counted_documents(documents, staging)


def document_stats(documents: DataFrame, staging: Staging | None = None) -> DataFrame:
    """``doc_id, total, mx`` over all terms of a document, known to a vocabulary or not."""
    return _counted(documents, staging).select("doc_id", "total", "mx")


def term_count_maps(documents: DataFrame) -> DataFrame:
    """``doc_id, counts``: a map of counts per document; an empty document has an empty map."""
    counted = with_term_counts(documents.select("doc_id", "pages"))
    return counted.select("doc_id", F.map_from_entries("terms").alias("counts"))


def corpus_term_counts(documents: DataFrame) -> DataFrame:
    """``term, cnt``: occurrences over the whole corpus, summed before and after the shuffle."""
    tokens = documents.select(F.explode(document_tokens(F.col("pages"))).alias("term"))
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))


def merged_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sum two ``term, cnt`` tables."""
    return left.unionByName(right).groupBy("term").agg(F.sum("cnt").alias("cnt"))


def document_frequency(documents: DataFrame) -> DataFrame:
    """``term, df``: number of documents that hold a term at least once."""
    words = F.array_distinct(document_tokens(F.col("pages")))
    terms = documents.select(F.explode(words).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def maximum_frequency(frequency: DataFrame) -> DataFrame:
    """One row with the highest document frequency, 0 for an empty vocabulary."""
    return frequency.agg(F.coalesce(F.max("df"), F.lit(0)).cast("bigint").alias("max_df"))


def frequency_of(frequency: DataFrame, word: str) -> DataFrame:
    """The row of one word; no row when the vocabulary lacks it."""
    return frequency.filter(F.col("term") == word)


def vocabulary(frequency: DataFrame) -> DataFrame:
    """Terms in byte order."""
    return frequency.select("term").distinct().orderBy("term")


def vocabulary_size(frequency: DataFrame) -> int:
    return frequency.count()


def numbered(
    rows: DataFrame, order: list[str | Column], staging: Staging, name: str, to: str
) -> DataFrame:
    """Add the position, from 0, of every row in the total order of the given columns.

    Rows are range-partitioned and sorted; the running id Spark then hands out holds the partition
    and the place within it.  Written once, these are final, and only the number of rows of each
    partition is summed up.  No task sees more than its own range.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staging.write(ranged.withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    place = F.col("_id").bitwiseAND((1 << 33) - 1)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(*rows.columns, (F.col("_before") + place).alias(to))
    )


def term_index(frequency: DataFrame, staging: Staging) -> DataFrame:
    """Add ``term_index``, the column a term has in the sorted vocabulary.

    With a ``split_index`` column every split has a vocabulary of its own.
    """
    if "split_index" not in frequency.columns:
        return numbered(frequency, ["term"], staging, "term_index", "term_index")
    placed = numbered(frequency, ["split_index", "term"], staging, "term_index", "_place")
    first = placed.groupBy("split_index").agg(F.min("_place").alias("_first"))
    return (
        placed.join(F.broadcast(first), "split_index")
        .withColumn("term_index", F.col("_place") - F.col("_first"))
        .drop("_place", "_first")
    )


def label_ids(documents: DataFrame) -> DataFrame:
    """Distinct label ids in order."""
    return documents.select("label_id").distinct().orderBy("label_id")
