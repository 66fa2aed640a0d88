"""The queries of this package with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, quality, word_likelihood
from .decontaminate import contaminated
from .hamming import near_duplicates
from .jaccard import jaccard_components
from .oracles import REPEATED_STRINGS, TURN_REPAIR
from .packing import pack
from .ranked import ranked_documents
from .repeats import without_repeats
from .tokens import token_counts
from .turns import repaired_conversations
from .urls import judge
from .warc import archive, read_bundles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Verdict, host and path of the rules for URLs.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

# Least id reachable by links, from a table ``nodes(id)`` and symmetric ``links(a, b)``.
_REACHED = """reached(id, other) AS (
      SELECT id, id FROM nodes
      UNION SELECT r.id, l.b FROM reached r JOIN links l ON r.other = l.a
    ), component AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)"""

_JACCARD_SQL = f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
        lambda x: x <> '') AS w FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
        ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS shingle FROM w
    ), n AS (
      SELECT doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id
    ), met AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b
      ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
    ), links AS (
      SELECT met.a, met.b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * c >= 75 * (x.n + y.n - c)
    ), nodes AS (SELECT doc_id AS id FROM documents), {_REACHED}
    SELECT doc_id, n AS n_shingles, component_id FROM n JOIN component ON id = doc_id"""

_COSINE_SQL = f"""
    WITH RECURSIVE e AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
      SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y
      ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
      WHERE list_cosine_similarity(x.v, y.v) >= 0.98
    ), nodes AS (SELECT vec_id AS id FROM embeddings), {_REACHED}
    SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id,
           vec_id = component_id AS kept
    FROM embeddings JOIN component ON id = vec_id"""


_RANKED_SQL = r"""
    WITH d AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM documents
    ), q AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark
    ), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
    c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM n),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
    w AS (
      SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
      FROM tf, c GROUP BY term, docs
    ), scored AS (
      SELECT item_id, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // l))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), c
      GROUP BY item_id, doc_id
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
      FROM scored WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into sequences of power-of-two lengths."""
    return pack(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op5_pseudo_likelihood")
def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked pseudo-likelihood of every document's words, learned from all documents."""
    return word_likelihood.score(table(spark, sf_dir, "documents"))


@query("op6_pu_quality")
def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from four of five folds."""
    model, rows = quality.train(
        table(spark, sf_dir, "documents"),
        table(spark, sf_dir, "labels"),
        in_training=language.fold("doc_id", 5) != 0,
    )
    return quality.score_features(rows, model).select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op2_hamming_duplicates", _COSINE_SQL)
def op2_hamming_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.98."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op3_simhash_decontamination")
def op3_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op4_seekable_warc",
    """
    WITH p AS (
      SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
             sha256(coalesce(html, '')) AS payload_digest
      FROM pages
    ), f AS (
      SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END
             AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
    FROM f
    """,
)
def op4_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to seekable bundles and read back from them."""
    records = read_bundles(archive(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_language_mixture")
def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three of four folds."""
    documents = table(spark, sf_dir, "documents")
    model = language.train(documents.filter(language.fold("doc_id", 4) != 2))
    found = language.predict(documents, model)
    # A row without an id is in no fold, and so is not learned from.
    held_out = F.coalesce(language.fold("doc_id", 4) == 2, F.lit(True)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


@query("op9_jaccard_join", _JACCARD_SQL)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under 0.75 Jaccard of five-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op10_url_ratio")
def op10_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op11_turn_repair", TURN_REPAIR)
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired turns of every damaged conversation."""
    return repaired_conversations(table(spark, sf_dir, "conversations"))


@query("op12_ranked_search", _RANKED_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_repeated_strings", REPEATED_STRINGS)
def op13_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 400 bytes that occur again."""
    cleaned = without_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
