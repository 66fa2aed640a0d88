"""Joining the terms of documents with a table about terms.

This is the one join whose left side is the whole corpus.  Words are far from evenly frequent, so
a plain shuffle would send the rows of a common word to one task, and move the corpus besides.
Here the table is weighed first.  As many of its most frequent terms as a fixed budget holds are
broadcast: they answer most of the corpus without a shuffle, and since a corpus of N documents
with m distinct terms each has at most m/q terms in more than q*N documents, the frequent ones
always are few.  Only what is left, rare words by construction, is shuffled to meet the rest of
the table.

With a table of very many columns or classes the budget may end before the words become rare.  Of
those left, words in more documents than one task should take are dealt to several: their rows get
a salt, and the table's rows of such a word are repeated once for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, Staging, estimated_bytes


#: Frequencies within a sixteenth of a power of two share a band: at most 1,024 of them, so that a
#: budget is used up nearly whole.
BAND = "CAST(floor(16 * log2(CAST(greatest(docs, 1) AS DOUBLE))) AS INT)"


def term_bands(table: DataFrame, *more: Column) -> list[Row]:
    """``band, rows, text`` and any further aggregates by frequency band, frequent terms first."""
    bands = table.groupBy(F.expr(BAND).alias("band")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.octet_length("term")).alias("text"),
        F.min("docs").alias("lowest"),
        *more,
    )
    return sorted(bands.collect(), key=lambda row: -row["band"])


def broadcast_floor(bands: list[Row], columns: int, budget: int) -> int | None:
    """Lowest ``docs`` whose terms still fit the budget, 0 when all do, None when none do."""
    used, floor = 0, None
    for band in bands:
        used += estimated_bytes(band["rows"], band["text"], columns)
        if used > budget:
            return floor
        floor = band["lowest"]
    return 0


#: Rows of one word that a task of a shuffled join takes; more are dealt to several tasks.
TASK_ROWS = 1 << 20
#: Most the list of the words that are dealt out may weigh.
DEALT_BYTES = 16 * 1024 * 1024


def dealt_floor(bands: list[Row], floor: int | None, most: int) -> int | None:
    """Lowest ``docs`` of the words below ``floor`` that are dealt out, None if there are none.

    ``m`` words of a document on average leave at most ``m * documents / most`` words to deal out.
    Should their list weigh too much, the least frequent ones are left to adaptive execution.
    """
    used, lowest = 0, None
    for band in bands:
        if floor is not None and band["lowest"] >= floor:
            continue
        used += estimated_bytes(band["rows"], band["text"], 1)
        if band["lowest"] <= most or used > DEALT_BYTES:
            break
        lowest = band["lowest"]
    return lowest


def _dealt_join(tokens: DataFrame, table: DataFrame, lowest: int | None, most: int) -> DataFrame:
    """Shuffled inner join on ``term`` in which words of ``lowest`` documents on are dealt out."""
    if lowest is None:
        return tokens.join(table, "term")
    hot, shares = F.col("docs") >= lowest, F.ceil(F.col("docs") / most).cast("int")
    words = table.filter(hot).select("term", shares.alias("_shares")).distinct()
    share = F.pmod(F.xxhash64(*tokens.columns), F.col("_shares")).cast("int")
    dealt = tokens.join(F.broadcast(words), "term", "left").withColumn(
        "_share", F.coalesce(share, F.lit(0))
    )
    last = F.when(hot, shares - 1).otherwise(0)
    repeated = table.withColumn("_share", F.explode(F.sequence(F.lit(0), last)))
    return dealt.drop("_shares").join(repeated, ["term", "_share"]).drop("_share")


def join_above(
    tokens: DataFrame,
    table: DataFrame,
    floor: int | None,
    bands: list[Row] = (),
    most: int = TASK_ROWS,
) -> DataFrame:
    """Inner join on ``term``, with a broadcast of the terms in at least ``floor`` documents.

    ``bands`` are those of the table; without them no word is dealt out.
    """
    if floor == 0:
        return tokens.join(F.broadcast(table), "term")
    if floor is None:
        return _dealt_join(tokens, table, dealt_floor(bands, floor, most), most)
    frequent = table.filter(F.col("docs") >= floor)
    rest = join_below(tokens, table, floor, bands, most)
    return tokens.join(F.broadcast(frequent), "term").unionByName(rest)


def join_below(
    tokens: DataFrame, table: DataFrame, floor: int, bands: list[Row] = (), most: int = TASK_ROWS
) -> DataFrame:
    """The part of the join that is shuffled: of the terms in fewer than ``floor`` documents."""
    frequent = table.filter(F.col("docs") >= floor).select("term").distinct()
    rest = tokens.join(F.broadcast(frequent), "term", "left_anti")
    rare = table.filter(F.col("docs") < floor)
    return _dealt_join(rest, rare, dealt_floor(bands, floor, most), most)


def join_terms(
    tokens: DataFrame,
    table: DataFrame,
    budget: int = BROADCAST_BYTES,
    counted: bool = True,
    staging: Staging | None = None,
    most: int = TASK_ROWS,
) -> DataFrame:
    """Inner join on ``term`` of tokens with a staged table holding ``term`` and ``docs``.

    ``docs`` is the number of documents a term occurs in.  Where the table was fitted on other
    documents than are joined now, pass ``counted=False``: if the table is too large to travel
    whole, the frequencies are then taken from the tokens themselves.
    """
    bands = term_bands(table)
    floor = broadcast_floor(bands, len(table.columns), budget)
    if floor != 0 and not counted:
        seen = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
        recounted = table.drop("docs").join(seen, "term").select(*table.columns)
        table = (staging or Staging(tokens.sparkSession)).write(recounted, "seen_terms")
        bands = term_bands(table)
        floor = broadcast_floor(bands, len(table.columns), budget)
    return join_above(tokens, table, floor, bands, most)
