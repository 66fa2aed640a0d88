"""URL filtering: rules for hosts and paths, and a character language-model ratio for the rest.

Two variable-order Markov models over bytes, one of accepted and one of rejected URLs, give every
next byte a probability that mixes all context lengths up to ``ORDER``: the counts of a context are
smoothed with the shorter context's probability in proportion to how many different bytes followed
it (Witten-Bell).  A URL's score is the difference of the two log-likelihoods per byte.  The
threshold is calibrated on URLs scored by models that have not seen them.

The counts are exact: every context and every gram, a context with the byte after it, has a name of
64 bits and a row in a table that grows with the URLs.  Distinct URLs are scored in chunks, and the
rows a chunk asks for are joined to it.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Staging
from .arrowtext import _ODD, mix, row_slices, text_buffer
from .shipping import map_arrow

ORDER = 5
#: Classes of examples: accepted URLs in two halves, then rejected ones.
KINDS = 4
#: Kinds of the accepted and the rejected model without half 0, without half 1, and of all URLs.
MODELS = ((1,), (3,), (0,), (2,), (0, 1), (2, 3))
#: Bytes of URLs that are scored together.
_SLICE = 1 << 18
#: Scores are told apart to this step when the threshold is chosen.
_STEP = 0.002


#: What comes before the first ``://``, the host, and the path.
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty without ``://``."""
    known = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(known, _PARTS, 1)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return lower, F.regexp_extract(known, _PARTS, 2)


def rule_verdict(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """``struct<rule, verdict>`` of the longest fitting rule, null if none fits.

    ``rules`` holds (verdict, host, path); of equally long rules the first one listed wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: len(r[1]) + len(r[2]))
    for verdict, rule_host, rule_path in sorted(
        ordered[::-1], key=lambda r: len(r[1]) + len(r[2])
    ):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        named = F.struct(
            F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict")
        )
        found = F.when(fits, named).otherwise(found)
    return found


def _contexts(data: np.ndarray, offsets: np.ndarray):
    """Row of every byte, and for each context length the names of its context and its gram.

    Before a URL's first byte stand ``ORDER`` bytes 0, so that beginnings are learned as such.
    """
    lengths = np.diff(offsets)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(data)) + ORDER * (rows + 1)
    padded = np.zeros(len(data) + ORDER * (len(lengths) + 1), np.uint64)
    padded[at] = data
    context = np.zeros(len(data), np.uint64)
    found = []
    for k in range(ORDER + 1):
        if k:
            context = context + (padded[at - k] + np.uint64(1)) * _ODD[k]
        seen = context + _ODD[20 + k]
        both = mix(seen + (padded[at] + np.uint64(1)) * _ODD[30])
        found.append((mix(seen).view(np.int64), both.view(np.int64)))
    return rows, found


def count_contexts(urls: DataFrame) -> DataFrame:
    """``context, both, n_0, ...``: how often each gram occurs in the URLs of each kind.

    Rows are ``kind int, url`` and, if there is a third column, how many times the URL counts.
    """

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            times = batch.column(2).to_numpy() if batch.num_columns > 2 else np.ones(len(kinds))
            data, offsets = text_buffer(batch.column(1))
            for first, last in row_slices(offsets, _SLICE):
                bounds = offsets[first : last + 1] - offsets[first]
                rows, found = _contexts(data[offsets[first] : offsets[last]], bounds)
                context, both = (np.concatenate(c) for c in zip(*found, strict=True))
                of_row = np.tile(rows, ORDER + 1)
                both, at, place = np.unique(both, return_index=True, return_inverse=True)
                n = np.zeros((KINDS, len(both)), np.int64)
                np.add.at(
                    n,
                    (kinds[first:last][of_row], place),
                    times[first:last][of_row].astype(np.int64),
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(context[at]), pa.array(both), *(pa.array(k) for k in n)],
                    ["context", "both", *names],
                )

    names = [f"n_{k}" for k in range(KINDS)]
    schema = ", ".join(f"{name} long" for name in ["context", "both", *names])
    counted = map_arrow(urls, per_task, schema)
    return counted.groupBy("context", "both").agg(*[F.sum(n).alias(n) for n in names])


def gram_table(counts: DataFrame, models: Sequence[Sequence[int]]) -> DataFrame:
    """``name, seen_0, different_0, ...`` of every gram and every context, for each model.

    A model counts the URLs of some kinds.  ``different`` is how many bytes followed a context.
    """
    seen = [sum((F.col(f"n_{k}") for k in kinds), F.lit(0)) for kinds in models]
    grams, sums = [F.col("both").alias("name")], []
    for number, n in enumerate(seen):
        grams += [n.alias(f"seen_{number}"), F.lit(0).cast("long").alias(f"different_{number}")]
        sums += [
            F.sum(n).alias(f"seen_{number}"),
            F.count_if(n > 0).alias(f"different_{number}"),
        ]
    contexts = counts.groupBy(F.col("context").alias("name")).agg(*sums)
    return counts.select(*grams).unionByName(contexts)


@dataclass
class Model:
    """Rows of a gram table, ordered by name; what has none was never seen."""

    name: np.ndarray
    seen: np.ndarray
    different: np.ndarray

    @staticmethod
    def of(rows: pa.Table, number: int) -> Model:
        name = rows["name"].to_numpy()
        order = np.argsort(name)
        columns = (rows[f"{c}_{number}"].to_numpy() for c in ("seen", "different"))
        return Model(name[order], *(c[order].astype(float) for c in columns))

    def find(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.name):
            return np.zeros(len(name)), np.zeros(len(name))
        at = np.minimum(np.searchsorted(self.name, name), len(self.name) - 1)
        known = self.name[at] == name
        return np.where(known, self.seen[at], 0), np.where(known, self.different[at], 0)


def model_tables(counts: DataFrame, kinds: Sequence[int]) -> Model:
    """The whole model of the URLs of some kinds, for tables that fit the driver."""
    return Model.of(gram_table(counts, [kinds]).toArrow(), 0)


def log_likelihood(model: Model, rows, found, n_rows: int) -> np.ndarray:
    """Natural log-likelihood of every row."""
    p = np.full(len(rows), 1 / 256)
    for context, both in found:
        n, t = model.find(context)
        joint, _ = model.find(both)
        p = np.where(n > 0, (joint + t * p) / np.maximum(n + t, 1), p)
    return np.bincount(rows, weights=np.log(p), minlength=n_rows)


def _asked(rows: pa.Table) -> pa.Table:
    """``chunk, name``: every name that the URLs of a chunk need, once."""
    data, offsets = text_buffer(rows["url"].combine_chunks())
    parts = [np.zeros(0, np.int64)]
    for first, last in row_slices(offsets, _SLICE):
        bounds = offsets[first : last + 1] - offsets[first]
        _, found = _contexts(data[offsets[first] : offsets[last]], bounds)
        parts.append(np.unique(np.concatenate([c for pair in found for c in pair])))
    names = np.unique(np.concatenate(parts))
    chunk = np.full(len(names), rows["chunk"][0].as_py(), np.int64)
    return pa.table([pa.array(chunk), pa.array(names)], ["chunk", "name"])


def _score_chunk(rows: pa.Table, grams: pa.Table) -> pa.Table:
    """``url, ratio, held_out`` of the URLs of a chunk from the rows of the grams it asked for."""
    url, half = rows["url"].combine_chunks(), rows["half"].to_numpy()
    data, offsets = text_buffer(url)
    models = [Model.of(grams, number) for number in range(len(MODELS))]
    ratios = np.zeros((len(MODELS) // 2, len(half)))
    for first, last in row_slices(offsets, _SLICE):
        bounds = offsets[first : last + 1] - offsets[first]
        of_byte, found = _contexts(data[offsets[first] : offsets[last]], bounds)
        length = np.maximum(np.diff(bounds), 1)
        own = [log_likelihood(model, of_byte, found, last - first) for model in models]
        for k in range(len(ratios)):
            ratios[k, first:last] = (own[2 * k] - own[2 * k + 1]) / length
    held_out = ratios[half, np.arange(len(half))]
    return pa.table([url, pa.array(ratios[-1]), pa.array(held_out)], ["url", "ratio", "held_out"])


def add_ratios(urls: DataFrame, grams: DataFrame, n_bytes: int) -> DataFrame:
    """``url, ratio, held_out`` of distinct rows ``url, half``: scores per byte, 0 for no URL.

    ``held_out`` is the score by the models that did not see the URL's half.
    """
    chunks = F.lit(1 + n_bytes // _SLICE)
    dealt = urls.select(F.pmod(F.xxhash64("url"), chunks).alias("chunk"), "url", "half")
    asked = dealt.groupBy("chunk").applyInArrow(_asked, "chunk long, name long")
    wanted = asked.join(grams, "name")
    return (
        dealt.groupBy("chunk")
        .cogroup(wanted.groupBy("chunk"))
        .applyInArrow(_score_chunk, "url string, ratio double, held_out double")
    )


def calibrate(scored: DataFrame, times: Column | None = None) -> float:
    """Threshold with the least mean of the two error rates, from ``ratio, rejected``.

    A row counts ``times``, else once.

    Scores are counted in steps, so the driver sees a histogram.  Of equally good thresholds the
    one nearest 0 is taken; with only one class it is 0.
    """
    times = F.lit(1) if times is None else times
    steps = scored.groupBy(F.floor(F.col("ratio") / _STEP).alias("step")).agg(
        F.sum(F.when(F.col("rejected"), times).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("rejected"), 0).otherwise(times)).alias("good"),
    )
    rows = sorted((r["step"], r["bad"], r["good"]) for r in steps.collect())
    bad, good = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not bad or not good:
        return 0.0
    candidates, lost, kept_out, above = [], 0, 0, rows[0][0]
    for step, b, g in rows:
        # A threshold anywhere between the last step below and this one blocks the same URLs.
        nearest = min(max(above, 0), step) * _STEP
        candidates.append((lost / good + (bad - kept_out) / bad, abs(nearest), nearest))
        lost, kept_out, above = lost + g, kept_out + b, step + 1
    return min(candidates)[2]


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    id_column: str = "page_id",
    url_column: str = "url",
    staging: Staging | None = None,
) -> DataFrame:
    """``<id>, host, path, rule, verdict, ratio`` for every row.

    URLs that a rule decides are the accepted and rejected examples, all of them.  The others get
    the verdict of the models: ``allow`` if the ratio reaches the threshold.  A null or empty URL
    has an empty host and path and the ratio 0.  If no rule allows, or none blocks, any URL, the
    threshold is 0.  Repeated rows are judged alike, a null id stays null, an empty table gives no
    rows, and columns other than id and URL are not read.
    """
    staging = staging or Staging(pages.sparkSession)
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("u"))

    def with_rule(table: DataFrame) -> DataFrame:
        host, path = url_parts(F.col("u"))
        table = table.select("*", host.alias("host"), path.alias("path"))
        return table.select("*", rule_verdict(F.col("host"), F.col("path"), rules).alias("found"))

    # Copies of a URL are worked on once, and count as often as they occur.
    distinct = with_rule(rows.groupBy("u").agg(F.count(F.lit(1)).alias("times")))
    distinct = staging.write(
        distinct.select(
            F.col("u").alias("url"),
            "times",
            (F.col("found.verdict") == "block").alias("rejected"),
            F.pmod(F.xxhash64("u"), F.lit(2)).cast("int").alias("half"),
        ),
        "urls",
    )
    decided = distinct.filter("rejected IS NOT NULL")
    kinds = (F.col("rejected").cast("int") * 2 + F.col("half")).cast("int").alias("kind")
    counts = staging.write(count_contexts(decided.select(kinds, "url", "times")), "contexts")
    n_bytes = distinct.agg(F.sum(F.octet_length("url"))).first()[0] or 0
    ratios = add_ratios(distinct.select("url", "half"), gram_table(counts, MODELS), n_bytes)
    ratios = staging.write(ratios, "ratios")
    held_out = ratios.join(decided, "url").select(
        F.col("held_out").alias("ratio"), "rejected", "times"
    )
    threshold = calibrate(held_out, F.col("times"))
    known = ratios.select(F.col("url").alias("u"), "ratio")
    scored = with_rule(rows).join(known, "u", "left")
    scored = scored.withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    by_model = F.when(F.col("ratio") >= threshold, "allow").otherwise("block")
    return scored.select(
        F.col("id").alias(id_column),
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), by_model).alias("verdict"),
        "ratio",
    )
