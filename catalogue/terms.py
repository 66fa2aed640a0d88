"""Queries about tokens, term counts, weights and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.functions import text
from labelweave.operators import terms as ops
from labelweave.operators.tfidf import TfIdf
from labelweave.sources.documents import page_counts

from . import sql
from .registry import query
from .tables import (
    conversations,
    corpus,
    new_documents,
    settings,
    staging,
)


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


TURNS = ("SELECT conv_id AS doc_id, text FROM conversations")
DOCS = sql.docs()


@query(
    "doc_pages",
    "SELECT conv_id AS doc_id, count(*) AS page_count, sum(length(text))::BIGINT AS characters, "
    "string_agg(md5(text), '' ORDER BY turn) AS pages_md5 FROM conversations GROUP BY conv_id",
)
def doc_pages(spark, d):
    documents = conversations(spark, d)
    sized = page_counts(documents)
    content = documents.select(
        "doc_id",
        F.aggregate("pages", F.lit(0).cast("bigint"), lambda n, p: n + F.length(p))
        .alias("characters"),
        F.array_join(F.transform("pages", lambda p: F.md5(p.cast("binary"))), "")
        .alias("pages_md5"),
    )
    return sized.join(content, "doc_id")


@query(
    "tokens_per_doc",
    sql.with_ctes(
        [*DOCS, *sql.counts()],
        "SELECT d.doc_id, coalesce(total, 0) AS tokens, coalesce(k, 0) AS distinct_terms, "
        "coalesce(chars, 0) AS characters FROM docs d LEFT JOIN st USING (doc_id) LEFT JOIN "
        "(SELECT doc_id, count(*) AS k, sum(length(term) * cnt)::BIGINT AS chars FROM tf "
        "GROUP BY doc_id) USING (doc_id)",
    ),
)
def tokens_per_doc(spark, d):
    tokens = corpus(spark, d).select(
        "doc_id", text.document_tokens(F.col("pages")).alias("t")
    )
    return tokens.select(
        "doc_id",
        F.size("t").cast("bigint").alias("tokens"),
        F.size(F.array_distinct("t")).cast("bigint").alias("distinct_terms"),
        F.aggregate("t", F.lit(0).cast("bigint"), lambda n, w: n + F.length(w))
        .alias("characters"),
    )


@query("term_frequency", sql.with_ctes([*DOCS, *sql.counts()], "SELECT doc_id, term, cnt FROM tf"))
def term_frequency(spark, d):
    return ops.term_counts(corpus(spark, d))


@query(
    "term_frequency_blocks",
    sql.with_ctes(
        [*DOCS, *sql.counts()],
        "SELECT d.doc_id, term, cnt, coalesce(total, 0) AS total, coalesce(mx, 0) AS mx FROM docs d "
        "LEFT JOIN tf USING (doc_id) LEFT JOIN st USING (doc_id)",
    ),
)
def term_frequency_blocks(spark, d):
    """Terms of documents, of which those of over a thousand bytes are counted block by block."""
    counted = ops.counted_documents(
        corpus(spark, d).select("doc_id", "pages"), staging(spark), block=1000
    )
    return counted.select("doc_id", "total", "mx", F.inline_outer("terms"))


@query(
    "term_frequency_pages",
    sql.with_ctes([("docs", TURNS), *sql.counts()], "SELECT doc_id, term, cnt FROM tf"),
)
def term_frequency_pages(spark, d):
    return ops.term_counts(conversations(spark, d))


@query(
    "corpus_term_frequency",
    sql.with_ctes([*DOCS, *sql.counts()], "SELECT term, count(*) AS cnt FROM tok GROUP BY term"),
)
def corpus_term_frequency(spark, d):
    return ops.corpus_term_counts(corpus(spark, d))


@query(
    "merged_term_frequency",
    sql.with_ctes(
        [
            ("docs", "SELECT doc_id, text FROM documents UNION ALL "
                     "SELECT conv_id, text FROM conversations"),
            *sql.counts(),
        ],
        "SELECT term, count(*) AS cnt FROM tok GROUP BY term",
    ),
)
def merged_term_frequency(spark, d):
    return ops.merged_counts(
        ops.corpus_term_counts(corpus(spark, d)), ops.corpus_term_counts(conversations(spark, d))
    )


@query(
    "tf_map_accessors",
    sql.with_ctes(
        [*DOCS, *sql.counts()],
        """SELECT d.doc_id, coalesce(k, 0) AS len, k IS NULL AS is_empty,
           coalesce(keys, '') AS keys, coalesce(total, 0)::BIGINT AS value_sum, the.cnt AS cnt_the,
           coalesce(entries, '') AS entries
           FROM docs d LEFT JOIN (SELECT doc_id, count(*)::INTEGER AS k,
             md5(string_agg(term, ' ' ORDER BY term)) AS keys,
             md5(string_agg(term || '=' || cnt, ' ' ORDER BY term)) AS entries
             FROM tf GROUP BY doc_id) USING (doc_id)
           LEFT JOIN st USING (doc_id)
           LEFT JOIN (SELECT doc_id, cnt FROM tf WHERE term = 'the') the USING (doc_id)""",
    ),
)
def tf_map_accessors(spark, d):
    counts = F.col("counts")
    empty = text.has_no_terms(counts)

    def digest(words):
        return F.when(empty, "").otherwise(
            F.md5(F.array_join(F.array_sort(words), " ").cast("binary"))
        )

    entries = F.array_sort(text.count_entries(counts))
    return ops.term_count_maps(corpus(spark, d)).select(
        "doc_id",
        text.distinct_terms(counts).alias("len"),
        empty.alias("is_empty"),
        digest(text.counted_terms(counts)).alias("keys"),
        F.aggregate(
            text.term_occurrences(counts), F.lit(0).cast("bigint"), lambda n, v: n + v
        ).alias("value_sum"),
        text.count_of(counts, "the").alias("cnt_the"),
        F.when(empty, "").otherwise(F.md5(F.array_join(F.transform(
            entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
        ), " ").cast("binary"))).alias("entries"),
    )


@query(
    "doc_term_stats",
    sql.with_ctes(
        [*DOCS, *sql.counts()],
        "SELECT doc_id, coalesce(total, 0)::BIGINT AS total, coalesce(mx, 0) AS mx FROM docs "
        "LEFT JOIN st USING (doc_id)",
    ),
)
def doc_term_stats(spark, d):
    return ops.document_stats(corpus(spark, d))


@query(
    "document_frequency",
    sql.with_ctes([*DOCS, *sql.counts()], "SELECT term, count(*) AS df FROM tf GROUP BY term"),
)
def document_frequency(spark, d):
    return ops.document_frequency(corpus(spark, d))


@query(
    "df_lookup",
    sql.with_ctes(
        [*DOCS, *sql.counts()],
        "SELECT term, count(*) AS df, (SELECT count(DISTINCT term) FROM tf) AS vocabulary "
        "FROM tf WHERE term = 'the' GROUP BY term",
    ),
)
def df_lookup(spark, d):
    frequency = staging(spark).write(ops.document_frequency(corpus(spark, d)), "df")
    return ops.frequency_of(frequency, "the").withColumn(
        "vocabulary", F.lit(ops.vocabulary_size(frequency)).cast("bigint")
    )


@query(
    "vocabulary_index",
    sql.with_ctes(
        [*DOCS, *sql.counts()],
        "SELECT term, df, row_number() OVER (ORDER BY encode(term)) - 1 AS term_index FROM "
        "(SELECT term, count(*) AS df FROM tf GROUP BY term)",
    ),
)
def vocabulary_index(spark, d):
    return ops.term_index(ops.document_frequency(corpus(spark, d)), staging(spark))


@query(
    "max_document_frequency",
    sql.with_ctes(
        [*DOCS, *sql.counts()],
        "SELECT max(df) AS max_df FROM (SELECT count(*) AS df FROM tf GROUP BY term)",
    ),
)
def max_document_frequency(spark, d):
    return ops.maximum_frequency(ops.document_frequency(corpus(spark, d)))


@query(
    "label_ids",
    "SELECT DISTINCT source AS label_id FROM documents",
)
def label_ids(spark, d):
    return ops.label_ids(corpus(spark, d, "source"))


def _register_tf(scheme: str, k: float, name: str) -> None:
    # The smoothed IDF is never zero on this data, so every weight shows.
    oracle = sql.with_ctes(
        [*sql.docs(), *sql.counts(), *sql.weighted(scheme, k)],
        "SELECT doc_id, term, round(tfw, 6) AS tf FROM tw",
    )

    @query(name, oracle)
    def weigh(spark, d):
        from labelweave.functions.text import with_term_counts
        from labelweave.operators.tfidf import exploded

        counted = with_term_counts(corpus(spark, d).select("doc_id", "pages"))
        weights = exploded(counted, settings(scheme, k=k))
        return weights.select("doc_id", "term", F.round("tf", 6).alias("tf"))


for _name, _scheme, _k in (
    ("tf_binary", "binary", 0.5),
    ("tf_raw_count", "raw_count", 0.5),
    ("tf_normalization", "normalization", 0.5),
    ("tf_double_half", "double_normalization_half", 0.5),
    ("tf_double_variable", "double_normalization_variable", 0.25),
):
    _register_tf(_scheme, _k, _name)


def _register_idf(scheme: str) -> None:
    oracle = sql.with_ctes(
        sql.fit_all(idf=scheme), "SELECT term, df, round(idf, 6) AS idf FROM idf"
    )

    @query(f"idf_{scheme}", oracle)
    def fit(spark, d):
        model = TfIdf(settings(idf=scheme)).fit(corpus(spark, d), staging(spark))
        return model.idf.select("term", "df", r6("idf"))


for _scheme in ("base", "smooth", "maximum", "probabilistic"):
    _register_idf(_scheme)

NEW = [("newdocs", "SELECT item_id AS doc_id, text FROM benchmark")]


def applied(tf: str, k: float = 0.5, prefix: str = "w_") -> list[tuple[str, str]]:
    """Unlabelled texts weighted with a vocabulary fitted on all documents."""
    return [*NEW, *sql.counts("newdocs", prefix), *sql.weighted(tf, k, prefix)]


@query(
    "tfidf_fit",
    sql.with_ctes(
        sql.fit_all("documents", "raw_count", "smooth"),
        "SELECT (SELECT n FROM nn) AS documents, count(*) AS columns, "
        "round(sum(idf), 4) AS idf_sum, max(df) AS max_df FROM idf",
    ),
)
def tfidf_fit(spark, d):
    model = TfIdf(settings(idf="smooth")).fit(corpus(spark, d), staging(spark))
    weights = model.idf_weights().join(model.document_frequency(), "term")
    return weights.agg(
        F.lit(model.documents).cast("bigint").alias("documents"),
        F.count(F.lit(1)).alias("columns"),
        F.round(F.sum("idf"), 4).alias("idf_sum"),
        F.max("df").alias("max_df"),
    )


@query(
    "tfidf_fit_transform",
    sql.with_ctes(
        sql.fit_all(),
        "SELECT doc_id, term, round(weight, 6) AS weight FROM (SELECT doc_id, term, tfw * idf AS "
        "weight FROM tw JOIN idf USING (term)) WHERE weight <> 0",
    ),
)
def tfidf_fit_transform(spark, d):
    _, features = TfIdf(settings()).fit_transform(corpus(spark, d), staging(spark))
    return features.rows.select("doc_id", "term", r6("weight"))


@query(
    "tfidf_transform",
    sql.with_ctes(
        [*sql.fit_all(tf="double_normalization_half", idf="smooth"),
         *applied("double_normalization_half")],
        "SELECT doc_id, term, round(tfw * idf, 6) AS weight FROM w_tw JOIN idf USING (term) "
        "WHERE tfw * idf <> 0",
    ),
)
def tfidf_transform(spark, d):
    model = TfIdf(settings("double_normalization_half", "smooth")).fit(
        corpus(spark, d), staging(spark)
    )
    features = model.transform(new_documents(spark, d))
    return features.rows.select("doc_id", "term", r6("weight"))


@query(
    "oov_filter",
    sql.with_ctes(
        [
            ("docs", "SELECT item_id AS doc_id, text, '' AS label_id FROM benchmark"),
            *sql.counts(),
            *sql.counts("documents", "w_"),
            ("known", "SELECT DISTINCT term FROM tf"),
        ],
        "SELECT d.doc_id, count(w.term) AS terms, count(v.term) AS known_terms FROM documents d "
        "LEFT JOIN w_tf w ON w.doc_id = d.doc_id LEFT JOIN known v ON v.term = w.term "
        "GROUP BY d.doc_id",
    ),
)
def oov_filter(spark, d):
    """How many terms of each document a vocabulary fitted on other texts knows."""
    model = TfIdf(settings("binary", "smooth")).fit(new_documents(spark, d), staging(spark))
    documents = corpus(spark, d)
    known = model.transform(documents).rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("known_terms")
    )
    held = documents.select(
        "doc_id",
        F.size(F.array_distinct(text.document_tokens(F.col("pages")))).cast("bigint")
        .alias("terms"),
    )
    return held.join(known, "doc_id", "left").select(
        "doc_id", "terms", F.coalesce("known_terms", F.lit(0)).cast("bigint").alias("known_terms")
    )


@query(
    "zero_weights",
    sql.with_ctes(
        sql.fit_all(idf="probabilistic"),
        "SELECT (SELECT count(*) FROM idf) AS columns, count(*) FILTER (weight <> 0) AS stored, "
        "count(*) FILTER (weight = 0) AS dropped FROM "
        "(SELECT tfw * idf AS weight FROM tw JOIN idf USING (term))",
    ),
)
def zero_weights(spark, d):
    """Weights of exactly zero are not stored, but their terms stay columns."""
    model, features = TfIdf(settings(idf="probabilistic")).fit_transform(
        corpus(spark, d), staging(spark)
    )
    pairs = model.document_frequency().agg(F.sum("df").alias("pairs"))
    stored = features.rows.agg(F.count(F.lit(1)).alias("stored"))
    one = F.lit(1).alias("one")
    return pairs.select(one, "pairs").join(stored.select(one, "stored"), "one").select(
        F.lit(features.columns).cast("bigint").alias("columns"),
        "stored",
        (F.col("pairs") - F.col("stored")).alias("dropped"),
    )


@query(
    "tfidf_sparse_rows",
    sql.with_ctes(
        [
            *sql.fit_all(),
            ("ix", "SELECT term, idf, row_number() OVER (ORDER BY encode(term)) - 1 AS i FROM idf"),
            ("f", "SELECT doc_id, i, tfw * idf AS w FROM tw JOIN ix USING (term) "
                  "WHERE tfw * idf <> 0"),
        ],
        "SELECT d.doc_id, count(i) AS stored, coalesce(string_agg(i::VARCHAR, ' ' ORDER BY i), '') "
        "AS indices, round(coalesce(sum(w), 0), 4) AS weight_sum FROM docs d LEFT JOIN f "
        "USING (doc_id) GROUP BY d.doc_id",
    ),
)
def tfidf_sparse_rows(spark, d):
    own = staging(spark)
    model, features = TfIdf(settings()).fit_transform(corpus(spark, d), own)
    rows = features.vectors(model.indexed_terms(own))
    return rows.select(
        "doc_id",
        F.size("indices").cast("bigint").alias("stored"),
        F.array_join(F.transform("indices", lambda i: i.cast("string")), " ").alias("indices"),
        F.round(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w), 4).alias("weight_sum"),
    )
