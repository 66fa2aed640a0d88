"""Queries about checks of the training data and about splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.config import SplitSettings
from labelweave.operators import splits as ops
from labelweave.operators import validate
from labelweave.operators.tfidf import TfIdf
from labelweave.functions.names import canonical_id, is_object_id

from . import sql
from .registry import query
from .tables import (
    SEED,
    SPLIT,
    conversations,
    corpus,
    judged_corpus,
    label_table,
    settings,
    staging,
    table,
)

JUDGED = "(SELECT d.doc_id, d.text, l.quality FROM documents d JOIN labels l USING (doc_id))"
ASSIGNED = "SELECT split_index, doc_id, label_id, is_train FROM asg"


@query("class_counts", "SELECT source AS label_id, count(*) AS n FROM documents GROUP BY source")
def class_counts(spark, d):
    return validate.class_counts(corpus(spark, d, "source"))


@query(
    "validate_training",
    "SELECT sum(n)::BIGINT AS documents, count(*) AS classes, min(n) AS smallest_class, "
    "max(n) AS largest_class, 0::BIGINT AS unlabelled, sum(length(source))::BIGINT AS label_bytes, "
    "floor(sum(n)::REAL * 0.7::REAL)::BIGINT AS train_size FROM "
    "(SELECT source, count(*) AS n FROM documents GROUP BY source)",
)
def validate_training(spark, d):
    counts = validate.class_counts(corpus(spark, d, "source"))
    return validate.training_summary(counts, SplitSettings(0.7))


@query(
    "validate_page_limit",
    "SELECT conv_id AS doc_id, count(*) AS page_count FROM conversations GROUP BY conv_id "
    "HAVING count(*) > 6",
)
def validate_page_limit(spark, d):
    return validate.oversized_documents(conversations(spark, d), limit=6)


@query(
    "validate_label_ids",
    "SELECT DISTINCT label_id FROM (SELECT substr(md5(lang || '/' || source), 1, 24) AS label_id "
    "FROM documents) WHERE label_id NOT IN (SELECT substr(md5(lang || '/' || source), 1, 24) FROM "
    "documents JOIN labels USING (doc_id) WHERE toxic = 1)",
)
def validate_label_ids(spark, d):
    """Labels of documents that a table of the labels of toxic documents does not know."""
    documents = table(spark, d, "documents").select(
        "doc_id", F.concat_ws("/", "lang", "source").alias("name")
    )
    labelled = documents.join(label_table(spark, d), "name")
    toxic = table(spark, d, "labels").filter("toxic = 1")
    known = labelled.join(toxic, "doc_id", "left_semi").select("label_id").distinct()
    return validate.unknown_label_ids(labelled, known)


_RAW_ID = "CASE WHEN lang = 'fr' THEN md5(text) ELSE upper(substr(md5(text), 1, 24)) END"


@query(
    "object_ids",
    f"SELECT doc_id, regexp_full_match({_RAW_ID}, '[0-9a-fA-F]{{24}}') AS valid, "
    f"lower({_RAW_ID}) AS label_id FROM documents",
)
def object_ids(spark, d):
    digest = F.md5(F.col("text").cast("binary"))
    raw = F.when(F.col("lang") == "fr", digest).otherwise(F.upper(F.substring(digest, 1, 24)))
    return table(spark, d, "documents").select(
        "doc_id", is_object_id(raw).alias("valid"), canonical_id(raw).alias("label_id")
    )


@query(
    "feature_shape",
    sql.with_ctes(
        sql.fit_all(idf="maximum", tf="normalization"),
        "SELECT (SELECT count(*) FROM docs) AS row_count, (SELECT count(*) FROM idf) "
        "AS column_count, count(*) AS stored, 0::BIGINT AS non_finite FROM tw JOIN idf USING (term) "
        "WHERE tfw * idf <> 0",
    ),
)
def feature_shape(spark, d):
    _, features = TfIdf(settings("normalization", "maximum")).fit_transform(
        corpus(spark, d), staging(spark)
    )
    finite = validate.is_finite(F.col("weight"))
    return features.rows.agg(
        F.lit(features.documents.count()).cast("bigint").alias("row_count"),
        F.lit(features.columns).cast("bigint").alias("column_count"),
        F.count(F.lit(1)).alias("stored"),
        F.count_if(~finite).alias("non_finite"),
    )


@query(
    "unmatched_predictions",
    "SELECT doc_id, true AS has_label, CAST(NULL AS BOOLEAN) AS has_prediction FROM documents "
    "WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def unmatched_predictions(spark, d):
    return validate.unmatched_predictions(
        corpus(spark, d), table(spark, d, "labels"), ["doc_id"]
    )


@query("repeated_ids", "SELECT conv_id AS doc_id, count(*) AS n FROM conversations "
       "GROUP BY conv_id HAVING count(*) > 1")
def repeated_ids(spark, d):
    turns = table(spark, d, "conversations").withColumnRenamed("conv_id", "doc_id")
    return validate.repeated_ids(turns)


@query(
    "split_stratified",
    sql.with_ctes([*sql.docs(), *sql.stratified(0.8, 3, SEED)], ASSIGNED),
)
def split_stratified(spark, d):
    return ops.stratified_split(corpus(spark, d), SPLIT, SEED)


@query(
    "split_stratified_judged",
    sql.with_ctes(
        [*sql.docs(JUDGED, label="quality"), *sql.stratified(0.6, 5, 2**64 - 1)], ASSIGNED
    ),
)
def split_stratified_judged(spark, d):
    return ops.stratified_split(judged_corpus(spark, d), SplitSettings(0.6, 5), 2**64 - 1)


@query("split_random", sql.with_ctes([*sql.docs(), *sql.randomly(0.7, 4, 7)], ASSIGNED))
def split_random(spark, d):
    return ops.random_split(corpus(spark, d), SplitSettings(0.7, 4), 7)


@query(
    "split_random_outside",
    sql.with_ctes([*sql.docs(), *sql.randomly(1.5, 2, 7)], ASSIGNED)
    .replace("SELECT split_index, doc_id, label_id, is_train FROM asg",
             "SELECT split_index, doc_id, label_id, is_train, 'above' AS ratio FROM asg UNION ALL "
             "SELECT split_index, doc_id, label_id, false, 'below' FROM asg"),
)
def split_random_outside(spark, d):
    """Ratios outside [0, 1] leave one side empty."""
    documents = corpus(spark, d)
    above = ops.random_split(documents, SplitSettings(1.5, 2), 7)
    below = ops.random_split(documents, SplitSettings(-0.5, 2), 7)
    return above.withColumn("ratio", F.lit("above")).unionByName(
        below.withColumn("ratio", F.lit("below"))
    )


@query("split_once", sql.with_ctes([*sql.docs(), *sql.stratified(0.8, 1, 9)], ASSIGNED))
def split_once(spark, d):
    return ops.stratified_split(corpus(spark, d), SplitSettings(repetitions=1), 9)


@query(
    "split_sizes",
    sql.with_ctes(
        [*sql.docs(label="source"), *sql.stratified(0.75, 5, SEED)],
        "SELECT split_index, count(*) FILTER (is_train) AS train_samples, "
        "count(*) FILTER (NOT is_train) AS test_samples FROM asg GROUP BY split_index",
    ),
)
def split_sizes(spark, d):
    assigned = ops.stratified_split(corpus(spark, d, "source"), SplitSettings(0.75, 5), SEED)
    return ops.split_sizes(assigned)


def _clamped(ratio: float) -> str:
    return sql.with_ctes(
        [*sql.docs(label="source"), *sql.stratified(ratio, 2, 3)],
        "SELECT split_index, label_id, count(*) FILTER (is_train) AS train_samples, "
        "count(*) FILTER (NOT is_train) AS test_samples FROM asg GROUP BY ALL",
    )


def _class_sizes(spark, d, ratio):
    assigned = ops.stratified_split(corpus(spark, d, "source"), SplitSettings(ratio, 2), 3)
    return assigned.groupBy("split_index", "label_id").agg(
        F.count_if("is_train").alias("train_samples"),
        F.count_if(~F.col("is_train")).alias("test_samples"),
    )


@query("split_clamped_low", _clamped(0.001))
def split_clamped_low(spark, d):
    return _class_sizes(spark, d, 0.001)


@query("split_clamped_high", _clamped(0.999))
def split_clamped_high(spark, d):
    return _class_sizes(spark, d, 0.999)
