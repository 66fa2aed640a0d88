"""Ranked search of many queries over all documents, by bounds from range-maximum tables.

Documents are tokenised once; only the terms that queries ask for are kept, with their counts.
Every task turns its documents into posting lists and searches them block by block.  Over all lists
of a block stands one sparse table, whose level ``k`` names the posting of greatest impact among
``2^k`` neighbours, so the greatest impact of a term within any interval of documents takes two
look-ups.  A query keeps intervals of documents in a heap, ordered by the sum of its terms' maxima:
no document inside can score more.  The best interval is split at the document that holds its
greatest impact, until no bound reaches the tenth best score found so far.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Staging
from .arrowtext import _LOWER, hash_runs, text_buffer
from .shipping import map_arrow
from .tokens import text_parts

#: Terms of queries, with repeats, that are searched at once; more take more passes.
QUERY_TERMS = 1_000_000
#: Postings that are searched as one block.
BLOCK_POSTINGS = 1_000_000
#: An interval with fewer postings of a query is scored as a whole.
LEAF_POSTINGS = 4_096
#: Parts the lists of best documents of an item are merged in first.
MERGE_PARTS = 64
_SLICE_BYTES = 1 << 20

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[128:] = True
for _first, _last in ("09", "AZ", "az"):
    _INSIDE[ord(_first) : ord(_last) + 1] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every term: a run of ASCII letters and digits and of other characters."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = _INSIDE[data]
    begins, ends = inside[:-1].copy(), inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    ends &= ~inside[1:]
    row_starts, row_ends = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
    begins[row_starts] = inside[row_starts]
    ends[row_ends] = inside[row_ends]
    starts = np.flatnonzero(begins)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return rows, hash_runs(_LOWER[data], starts, np.flatnonzero(ends) + 1)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else []
    if not len(firsts):
        return keys, counts
    return keys[firsts], np.add.reduceat(counts, firsts)


def _list_array(values: np.ndarray, rows: np.ndarray, n: int, kind) -> pa.ListArray:
    bounds = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.astype(kind)))


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct term hashes of every text."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        n = batch.num_rows
        found = []
        for first, part, bounds in text_parts(data, offsets, _SLICE_BYTES):
            rows, hashes = terms(part, bounds)
            found.append(np.unique(np.stack([(rows + first).astype(np.uint64), hashes]), axis=1))
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.uint64)
        both = np.unique(both, axis=1)
        lists = _list_array(both[1].view(np.int64), both[0].astype(np.int64), n, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "terms"])


def _counting(vocabulary: np.ndarray):
    """Term counts of documents, for the terms of a sorted vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            n, size = batch.num_rows, len(vocabulary)
            lengths = np.zeros(n, np.int64)
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for first, part, bounds in text_parts(data, offsets, _SLICE_BYTES):
                rows, hashes = terms(part, bounds)
                lengths += np.bincount(rows + first, minlength=n)
                at = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
                asked = vocabulary[at] == hashes
                key, tf = np.unique((rows[asked] + first) * size + at[asked], return_counts=True)
                keys.append(key)
                counts.append(tf)
            key, tf = _merged(np.concatenate(keys), np.concatenate(counts))
            rows = key // size
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lengths),
                    _list_array(key % size, rows, n, np.int32),
                    _list_array(tf, rows, n, np.int64),
                ],
                ["id", "n", "terms", "tfs"],
            ).filter(pa.array(lengths > 0))

    return count


def weight(documents: int, holding: int) -> int:
    """A term's weight, from how many of the documents hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(weights, tf, n, documents: int, total_terms: int):
    """What a term brings to a document's score."""
    m = 10 + 90 * n * documents // total_terms
    return weights * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Postings:
    """Posting lists of a block of documents under one sparse table of range maxima."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> None:
        """Postings in order of document, at most one for a term and a document."""
        order = np.argsort(term, kind="stable")
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.keys = term[order].astype(np.int64) * n_docs + self.doc
        sizes = np.diff(np.concatenate((np.flatnonzero(np.diff(term[order], prepend=-1)), [len(term)])))
        levels = int(sizes.max()).bit_length() if len(sizes) else 1
        self.best = np.empty((levels, len(term)), np.int32)
        self.best[0] = np.arange(len(term))
        for level in range(1, levels):
            below, half = self.best[level - 1], 1 << (level - 1)
            self.best[level] = below
            left, right = below[:-half], below[half:]
            self.best[level, :-half] = np.where(self.impact[left] >= self.impact[right], left, right)

    def lists(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists of terms begin and end."""
        return (
            np.searchsorted(self.keys, term.astype(np.int64) * self.n_docs),
            np.searchsorted(self.keys, (term.astype(np.int64) + 1) * self.n_docs),
        )

    def bound(self, low: np.ndarray, high: np.ndarray) -> tuple[int, int]:
        """The sum of the greatest impacts of ranges, none of them empty, and their best document."""
        level = np.frexp(high - low)[1] - 1
        left, right = self.best[level, low], self.best[level, high - (1 << level)]
        best = np.where(self.impact[left] >= self.impact[right], left, right)
        impact = self.impact[best]
        return int(impact.sum()), int(self.doc[best[np.argmax(impact)]])

    def scores(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every document that ranges hold, with its score."""
        sizes = high - low
        at = np.arange(int(sizes.sum())) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        return _merged(self.doc[at], self.impact[at])


class Best:
    """The best documents of an item: higher scores first, then smaller ids, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.found = k, []

    def least(self) -> int:
        """A score below this is of no use."""
        return self.found[0][0] if len(self.found) == self.k else 1

    def add(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, 0 if doc_id is None else -doc_id)
        if len(self.found) < self.k:
            heapq.heappush(self.found, entry)
        elif entry > self.found[0]:
            heapq.heapreplace(self.found, entry)

    def rows(self) -> list[tuple[int | None, int]]:
        return [(-negative if known else None, score) for score, known, negative in self.found]


def search(postings: Postings, term: np.ndarray, ids: list, best: Best, leaf: int = LEAF_POSTINGS):
    """Add the best documents of a block for one query to those known; gives the intervals opened."""
    low, high = postings.lists(term)
    held = high > low
    term, low, high = term[held], low[held], high[held]
    heap, opened = [], 0

    def push(term, low, high):
        nonlocal opened
        held = high > low
        term, low, high = term[held], low[held], high[held]
        if not len(term):
            return
        bound, split = postings.bound(low, high)
        if bound >= best.least():
            opened += 1
            heapq.heappush(heap, (-bound, opened, split, term, low, high))

    push(term, low, high)
    while heap and -heap[0][0] >= best.least():
        _, _, split, term, low, high = heapq.heappop(heap)
        if int((high - low).sum()) <= leaf:
            docs, scores = postings.scores(low, high)
            useful = scores >= best.least()
            docs, scores = docs[useful], scores[useful]
            if len(docs) > best.k:  # the k best and what ties with the last of them
                least = np.partition(scores, len(scores) - best.k)[len(scores) - best.k]
                docs, scores = docs[scores >= least], scores[scores >= least]
            for doc, score in zip(docs.tolist(), scores.tolist(), strict=True):
                best.add(score, ids[doc])
            continue
        key = term.astype(np.int64) * postings.n_docs + split
        at = np.searchsorted(postings.keys, key)
        holds = (at < high) & (postings.keys[np.minimum(at, len(postings.keys) - 1)] == key)
        score = int(postings.impact[at[holds]].sum())
        if score >= best.least():
            best.add(score, ids[split])
        push(term, low, at)
        push(term, at + holds, high)
    return opened


@dataclass
class _Corpus:
    """What scores need besides a document: counts of documents and terms, weights of terms."""

    documents: int
    total_terms: int
    weights: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch], limit: int):
    """Documents of arrow batches in blocks of about ``limit`` postings."""

    def block():
        ids = [i for part in parts for i in part[0]]
        n, sizes, term, tf = (np.concatenate([p[k] for p in parts]) for k in range(1, 5))
        return ids, n, sizes, term, tf

    parts, held = [], 0
    for batch in batches:
        ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        lists, tfs = batch.column(2), batch.column(3)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        term, tf = lists.flatten().to_numpy(), tfs.flatten().to_numpy()
        first = 0
        while first < len(ids):
            room = bounds[first] + max(limit - held, 0)
            last = max(int(np.searchsorted(bounds, room, "right")) - 1, first + 1)
            at = slice(bounds[first], bounds[last])
            sizes = np.diff(bounds[first : last + 1])
            parts.append((ids[first:last], n[first:last], sizes, term[at], tf[at]))
            held += int(bounds[last] - bounds[first])
            first = last
            if held >= limit:
                yield block()
                parts, held = [], 0
    if parts:
        yield block()


def _searching(queries: list[np.ndarray], corpus: _Corpus, k: int, limit: int, leaf: int):
    """The best documents of every query among a task's documents."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        for ids, n, sizes, term, tf in _blocks(batches, limit):
            doc = np.repeat(np.arange(len(ids)), sizes)
            impact = impacts(corpus.weights[term], tf, n[doc], corpus.documents, corpus.total_terms)
            postings = Postings(term, doc, impact, len(ids))
            for query, found in zip(queries, best, strict=True):
                search(postings, query, ids, found, leaf)
        for number, found in enumerate(best):
            if rows := found.rows():
                docs, scores = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(rows), pa.int32()),
                        pa.array(docs, pa.int64()),
                        pa.array(scores, pa.int64()),
                    ],
                    ["item", "doc_id", "score"],
                )

    return find


def _best_of(rows: DataFrame, keys: list, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def ranked_documents(
    documents: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_column: str = "doc_id",
    item_column: str = "item_id",
    text_column: str = "text",
    staging: Staging | None = None,
    query_terms: int = QUERY_TERMS,
    block_postings: int = BLOCK_POSTINGS,
    leaf_postings: int = LEAF_POSTINGS,
) -> DataFrame:
    """``<item>, rank, <doc>, score``: the ``k`` best documents above 0 of every item.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z.
    Ids of documents are integers.  Texts that are null or hold no term are no documents, and items
    without a term have no rows.  Every row is a document of its own, also with a null or repeated
    id; of equal scores the smaller id comes first, null last.  Equal rows of ``items`` are one item;
    texts that share an id, null included, are ranked apart.  Other columns are not read.  Empty
    tables give no rows.

    What goes to the driver and to every task is bounded by ``query_terms``: the items' terms are
    taken in so many passes.  A task keeps ``k`` documents an item and one block of postings.
    """
    spark = documents.sparkSession
    staging = staging or Staging(spark)
    kind = items.schema[item_column].dataType.simpleString()
    asked = items.select(F.col(item_column).alias("id"), F.col(text_column).alias("text")).distinct()
    asked = map_arrow(asked, _query_terms, f"id {kind}, terms array<long>")
    asked = staging.write(asked.filter(F.size("terms") > 0), "items")
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    passes = max(1, math.ceil(total / query_terms))
    texts = documents.select(
        F.col(doc_column).cast("long").alias("id"), F.col(text_column).alias("text")
    )
    results = []
    for number in range(passes):
        part = asked
        if passes > 1:
            part = asked.filter(F.pmod(F.xxhash64("id", "terms"), F.lit(passes)) == number)
        rows = part.collect()
        if not rows:
            continue
        hashes = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
        vocabulary = np.unique(np.concatenate(hashes))
        queries = [np.searchsorted(vocabulary, h) for h in hashes]
        schema = "id long, n long, terms array<int>, tfs array<long>"
        counted = map_arrow(texts, _counting(vocabulary), schema)
        counted = staging.write(counted, f"counted-{number}")
        n_documents, total_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_documents:
            continue
        holding = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = np.zeros(len(vocabulary), np.int64)
        for term, count in holding:
            weights[term] = weight(n_documents, count)
        corpus = _Corpus(n_documents, total_terms, weights)
        found = map_arrow(
            counted,
            _searching(queries, corpus, k, block_postings, leaf_postings),
            "item int, doc_id long, score long",
        )
        found = staging.write(
            found.withColumn("part", F.spark_partition_id() % MERGE_PARTS), f"found-{number}"
        )
        found = _best_of(found, ["item", "part"], k).drop("rank")
        best = _best_of(found, ["item"], k)
        names = spark.createDataFrame([(n, r["id"]) for n, r in enumerate(rows)], f"at int, id {kind}")
        named = best.join(names, F.col("item") == F.col("at"))
        results.append(
            named.select(F.col("id").alias(item_column), "rank", F.col("doc_id").alias(doc_column), "score")
        )
    if not results:
        schema = f"`{item_column}` {kind}, rank int, `{doc_column}` long, score long"
        return spark.createDataFrame([], schema)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found
