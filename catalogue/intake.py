"""Queries about taking in files and keeping labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.functions import names
from labelweave.sources import intake
from labelweave.sources.documents import read_training_documents
from labelweave.sources.labels import LabelTable, clean_label_names

from .registry import query
from .tables import corpus, label_table, staging, table

ACCOUNT, REGION = "123456789012", "eu-west-1"
CONFIG = intake.IntakeConfig(ACCOUNT, REGION, "web", max_bytes=20_000)

# Last part of a path, as SQL; the test addresses hold no white space.
LAST = r"regexp_extract({}, '([^/\\]*)$', 1)"
SAFE = f"nullif(nullif(nullif({LAST.format('url')}, ''), '.'), '..')"
HOST = "regexp_extract(url, '^https?://([^/]*)', 1)"
# The first part of a host name asks for a collection; addresses without a sub-page ask for none.
ASKED = f"CASE WHEN url LIKE '%#top' THEN NULL ELSE regexp_extract({HOST}, '^([^.]*)', 1) END"
PREFIX = f"coalesce({ASKED}, 'web')"


def uploads(spark, d):
    """Web pages as files to take in, named by their address."""
    pages = table(spark, d, "pages")
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    asked = F.when(~F.col("url").like("%#top"), F.regexp_extract(host, "^([^.]*)", 1))
    secure = F.col("url").startswith("https")
    return pages.select(
        F.col("url").alias("file_name"),
        F.when(secure, F.lit("text/html")).alias("content_type"),
        asked.alias("requested_prefix"),
        F.when(
            secure,
            F.to_json(F.struct(host.alias("host"), F.lit("client").alias("bucket_name"))),
        )
        .when(F.col("url").contains("?"), F.to_json(F.struct("page_id")))
        .alias("metadata_json"),
        F.octet_length("html").cast("bigint").alias("length"),
        "page_id",
        F.col("html").cast("binary").alias("content"),
    )


ERROR = f"""CASE WHEN strlen(html) > 20000 THEN 'file is too large'
    WHEN NOT url LIKE 'https%' AND url LIKE '%?%'
      THEN 'metadata has to be one JSON object whose values are text'
    WHEN {SAFE} IS NULL THEN 'file name is invalid'
    WHEN NOT regexp_full_match({PREFIX}, '[a-z0-9]([a-z0-9-]*[a-z0-9])?')
      THEN 'invalid collection prefix'
    WHEN {PREFIX} LIKE 'xn--%' OR {PREFIX} LIKE 'sthree-%' OR {PREFIX} LIKE 'amzn-s3-demo-%'
      THEN 'reserved collection prefix'
    WHEN length({PREFIX}) + length('-{ACCOUNT}-{REGION}-an') > 63
      THEN 'collection name too long' END"""


@query(
    "intake_batches",
    f"""SELECT {PREFIX} || '-{ACCOUNT}-{REGION}-an' AS collection, count(*) AS files,
        sum(strlen(html))::BIGINT AS bytes, count(DISTINCT page_id) AS ids, 2::BIGINT AS batches
        FROM pages WHERE {ERROR} IS NULL GROUP BY ALL""",
)
def intake_batches(spark, d):
    """Uploads taken in by two batches, each of which arrives twice."""
    checked = intake.check_uploads(uploads(spark, d), CONFIG)
    rows = intake.manifest(checked, CONFIG, [F.col("page_id"), F.col("file_name")])
    path = f"{staging(spark).path}/batches"
    secure = F.col("content_type") == "text/html"
    for _ in range(2):
        intake.store_batch(rows.filter(secure), path, "secure")
        intake.store_batch(rows.filter(~secure), path, "plain")
    stored = intake.stored(spark, path)
    return stored.read().groupBy("collection").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("length").alias("bytes"),
        F.count_distinct("object_key").alias("ids"),
        F.lit(len(stored.batches())).cast("bigint").alias("batches"),
    )


@query(
    "intake_manifest",
    f"""SELECT {PREFIX} || '-{ACCOUNT}-{REGION}-an' AS collection, {SAFE} AS file_name,
        CASE WHEN url LIKE 'https%' THEN 'text/html' ELSE 'application/octet-stream' END
          AS content_type,
        CASE WHEN url LIKE 'https%' THEN {HOST} END AS host,
        {PREFIX} || '-{ACCOUNT}-{REGION}-an' AS bucket_name,
        strlen(html) AS length, md5(html) AS content_md5, true AS key_ok
        FROM pages WHERE {ERROR} IS NULL""",
)
def intake_manifest(spark, d):
    checked = intake.check_uploads(uploads(spark, d), CONFIG)
    rows = intake.manifest(checked, CONFIG, [F.col("page_id"), F.col("file_name")])
    path = f"{staging(spark).path}/collections"
    intake.store(rows, path)
    stored = spark.read.parquet(path)
    key = F.col("object_key")
    return stored.select(
        "collection",
        F.regexp_extract(key, "/(.*)$", 1).alias("file_name"),
        "content_type",
        F.try_element_at("metadata", F.lit("host")).alias("host"),
        F.element_at("metadata", "bucket_name").alias("bucket_name"),
        "length",
        F.md5("content").alias("content_md5"),
        key.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}/").alias("key_ok"),
    )


@query(
    "intake_rejects",
    f"SELECT url AS file_name, {ERROR} AS error FROM pages WHERE {ERROR} IS NOT NULL",
)
def intake_rejects(spark, d):
    return intake.rejects(intake.check_uploads(uploads(spark, d), CONFIG))


@query("safe_file_name", f"SELECT page_id, {SAFE} AS safe_name FROM pages")
def safe_file_name(spark, d):
    return table(spark, d, "pages").select(
        "page_id", names.safe_file_name(F.col("url")).alias("safe_name")
    )


@query(
    "object_key",
    f"""SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4)
        || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '/' || {SAFE} AS object_key
        FROM (SELECT *, md5('{{"page_id":' || page_id || '}}') AS h FROM pages)""",
)
def object_key(spark, d):
    safe = names.safe_file_name(F.col("url"))
    return table(spark, d, "pages").select(
        "page_id", names.object_key(safe, F.col("page_id")).alias("object_key")
    )


_WORD = "split_part(text, ' ', 1)"


@query(
    "collection_name",
    f"""SELECT item_id, p AS prefix, p || '-{ACCOUNT}-{REGION}-an' AS collection,
        CASE WHEN NOT regexp_full_match(p, '[a-z0-9]([a-z0-9-]*[a-z0-9])?')
               THEN 'invalid collection prefix'
             WHEN length(p) + {len(f"-{ACCOUNT}-{REGION}-an")} > 63
               THEN 'collection name too long' END AS error
        FROM (SELECT doc_id AS item_id, CASE WHEN lang = 'fr' THEN 'documents'
                ELSE lower({_WORD}) || '-' || source END AS p FROM documents)""",
)
def collection_name(spark, d):
    word = F.lower(F.split_part("text", F.lit(" "), F.lit(1)))
    asked = F.when(F.col("lang") != "fr", F.concat_ws("-", word, "source"))
    prefix = names.chosen_collection(asked, "documents")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"),
        prefix.alias("prefix"),
        names.collection_name(prefix, ACCOUNT, REGION).alias("collection"),
        names.collection_error(prefix, ACCOUNT, REGION).alias("error"),
    )


@query(
    "metadata_override",
    "SELECT doc_id, 'lang=' || lang || ',source=' || source AS kept, 'stored' AS bucket_name, "
    "3 AS entries FROM documents",
)
def metadata_override(spark, d):
    given = F.to_json(F.struct("lang", "source", F.col("source").alias("bucket_name")))
    metadata = names.with_collection(names.parse_metadata(given), F.lit("stored"))
    kept = F.array_sort(
        F.map_entries(F.map_filter("m", lambda k, _: k != names.COLLECTION_KEY))
    )
    return table(spark, d, "documents").select("doc_id", metadata.alias("m")).select(
        "doc_id",
        F.array_join(
            F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
        ).alias("kept"),
        F.element_at("m", names.COLLECTION_KEY).alias("bucket_name"),
        F.size("m").alias("entries"),
    )


@query(
    "metadata_parse",
    """SELECT doc_id, lang IN ('en', 'de') AS accepted,
       CASE lang WHEN 'en' THEN text WHEN 'de' THEN source END AS value FROM documents""",
)
def metadata_parse(spark, d):
    """Objects of strings are accepted, also of long ones; numbers and arrays are not."""
    given = (
        F.when(F.col("lang") == "en", F.to_json(F.struct(F.col("text").alias("value"))))
        .when(F.col("lang") == "de", F.to_json(F.struct(F.col("source").alias("value"))))
        .when(F.col("lang") == "fr", F.to_json(F.struct(F.col("n_chars").alias("value"))))
        .otherwise(F.to_json(F.array("source")))
    )
    parsed = names.parse_metadata(given)
    return table(spark, d, "documents").select("doc_id", parsed.alias("m")).select(
        "doc_id",
        F.col("m").isNotNull().alias("accepted"),
        F.try_element_at("m", F.lit("value")).alias("value"),
    )


@query(
    "label_name_trim",
    "SELECT doc_id, CASE WHEN lang = 'es' THEN NULL ELSE source END AS name FROM documents",
)
def label_name_trim(spark, d):
    space = F.lit("  \t \n")
    padded = F.when(F.col("lang") == "es", space).otherwise(F.concat(space, "source", space))
    rows = table(spark, d, "documents").select("doc_id", padded.alias("name"))
    return clean_label_names(rows)


@query(
    "hex_id",
    "SELECT doc_id, lower(hex(encode(source))) AS hex_id FROM documents",
)
def hex_id(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", names.hex_id(F.col("source").cast("binary")).alias("hex_id")
    )


@query(
    "label_scan",
    "SELECT DISTINCT substr(md5(lang || '/' || source), 1, 24) AS label_id, "
    "lang || '/' || source AS name FROM documents",
)
def label_scan(spark, d):
    return staging(spark).write(label_table(spark, d), "labels")


@query(
    "label_create",
    "SELECT lang || '/' || source AS name, count(*) AS labels, count(*) AS ids, true AS well_formed "
    "FROM documents GROUP BY ALL",
)
def label_create(spark, d):
    """A new label for every document's name; equal names become different labels."""
    given = table(spark, d, "documents").select(
        F.concat(F.lit(" "), F.concat_ws("/", "lang", "source"), F.lit("\t")).alias("name")
    )
    created = LabelTable(spark, f"{staging(spark).path}/labels").create(given)
    return created.groupBy("name").agg(
        F.count(F.lit(1)).alias("labels"),
        F.count_distinct("label_id").alias("ids"),
        F.bool_and(names.is_object_id(F.col("label_id"))).alias("well_formed"),
    )


@query(
    "label_delete",
    "SELECT DISTINCT substr(md5(lang || '/' || source), 1, 24) AS label_id, "
    "lang || '/' || source AS name, CASE WHEN lang = 'fr' THEN 'removed' ELSE 'kept' END AS state "
    "FROM documents",
)
def label_delete(spark, d):
    """Labels of one language removed from the table, which is read back after the change."""
    stored = LabelTable(spark, f"{staging(spark).path}/labels")
    given = label_table(spark, d)
    stored.replace(given)
    removed = stored.delete(given.filter("name LIKE 'fr/%'").select("label_id"))
    return removed.withColumn("state", F.lit("removed")).unionByName(
        stored.read().withColumn("state", F.lit("kept"))
    )


@query(
    "read_training_documents",
    "SELECT lang AS label_id, count(*) AS documents, count(DISTINCT doc_id) AS ids, "
    "sum(length(text))::BIGINT AS characters FROM documents GROUP BY lang",
)
def read_training(spark, d):
    """Labelled documents written as JSON lines and read back under the fixed schema."""
    path = f"{staging(spark).path}/training_documents"
    rows = corpus(spark, d).select(F.col("doc_id").cast("string").alias("name"), "pages", "label_id")
    rows.select(F.to_json(F.struct("name", "pages", "label_id")).alias("value")).write.text(path)
    documents = read_training_documents(spark, path)
    return documents.groupBy("label_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_distinct("doc_id").alias("ids"),
        F.sum(F.length(F.element_at("pages", 1))).alias("characters"),
    )
