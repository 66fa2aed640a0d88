import pytest
from pyspark.sql import functions as F

from labelweave.functions import text
from labelweave.operators import terms as ops

COMBINING = "café"
CASES = [
    (["The cat,cat.\tdog\n42?", "CAT! the dog 42"], {"the": 2, "cat": 3, "dog": 2, "42": 2}),
    (
        [f"CAFÉ café 東京 東京 {COMBINING} ١٢ ١٢"],
        {"café": 2, "東京": 2, COMBINING: 1, "١٢": 2},
    ),
    ([], {}),
    ([""], {}),
    ([" .?!\n\t—_ "], {}),
    (
        ["Can't re-enter? hello_world!"],
        {"can": 1, "t": 1, "re": 1, "enter": 1, "hello": 1, "world": 1},
    ),
    # Words do not cross a page break, a null page is empty, and case is folded fully.
    (["foot", "ball", None], {"foot": 1, "ball": 1}),
    (["ΟΔΟΣ İ"], {"οδος": 1, "i̇": 1}),
]


def test_counts_per_document(make_documents):
    documents = make_documents([pages for pages, _ in CASES])
    maps = {r["doc_id"]: r["counts"] for r in ops.term_count_maps(documents).collect()}
    assert maps[7] in ({"οδοσ": 1, "i̇": 1}, {"οδος": 1, "i̇": 1})
    for i, (_, expected) in enumerate(CASES[:-1]):
        assert maps[i] == expected
    long = {}
    for row in ops.term_counts(documents).collect():
        long.setdefault(row["doc_id"], {})[row["term"]] = row["cnt"]
    assert long == {i: counts for i, counts in maps.items() if counts}


def test_stats_include_empty_documents(make_documents):
    documents = make_documents([["The cat,cat.\tdog", "CAT! the"], [], [" .?! "]])
    stats = {r["doc_id"]: (r["total"], r["mx"]) for r in ops.document_stats(documents).collect()}
    assert stats == {0: (6, 3), 1: (0, 0), 2: (0, 0)}


def test_filters_on_counts_do_not_change_them(make_documents):
    documents = make_documents([["b a a"], ["c"], []])
    counted = text.with_term_counts(documents)
    rows = counted.filter("size(terms) > 1 AND mx = 2").select("doc_id", F.inline("terms"))
    assert {tuple(r) for r in rows.collect()} == {(0, "a", 2), (0, "b", 1)}


def test_corpus_counts_and_merge(make_documents):
    documents = make_documents([["The cat cat", "DOG"], [], ["cat dog dog bird"]])
    whole = ops.corpus_term_counts(documents)
    expected = {"the": 1, "cat": 3, "dog": 3, "bird": 1}
    assert {r["term"]: r["cnt"] for r in whole.collect()} == expected
    merged = ops.merged_counts(whole, whole)
    assert {r["term"]: r["cnt"] for r in merged.collect()} == {k: 2 * v for k, v in expected.items()}


def test_map_accessors(make_documents):
    counts = F.col("counts")
    row = (
        ops.term_count_maps(make_documents([["Cat cat dog"], [""]]))
        .select(
            text.count_of(counts, "cat").alias("cat"),
            text.count_of(counts, "fox").alias("fox"),
            text.distinct_terms(counts).alias("len"),
            text.has_no_terms(counts).alias("empty"),
            text.counted_terms(counts).alias("keys"),
            text.term_occurrences(counts).alias("values"),
            text.count_entries(counts).alias("entries"),
        )
        .orderBy("len")
        .collect()
    )
    assert row[0].asDict()["empty"] and row[0]["cat"] is None and row[0]["keys"] == []
    assert (row[1]["cat"], row[1]["fox"], row[1]["len"], row[1]["empty"]) == (2, None, 2, False)
    assert dict(row[1]["entries"]) == {"cat": 2, "dog": 1}
    assert sorted(row[1]["values"]) == [1, 2]


@pytest.mark.parametrize(
    "pages, expected",
    [
        ([[], ["", " .?! "]], {}),
        ([["cat cat cat"]], {"cat": 1}),
        ([["cat dog"], ["cat cat"], ["dog"]], {"cat": 2, "dog": 2}),
        ([["cat cat dog"], ["cat bird"], [], ["bird bird"]], {"cat": 2, "dog": 1, "bird": 2}),
        ([["cat dog"], ["cat dog"]], {"cat": 2, "dog": 2}),
        ([["CAFÉ café 東京 42"], ["café? 東京! 42 42"]], {"café": 2, "東京": 2, "42": 2}),
    ],
)
def test_document_frequency(make_documents, staging, pages, expected):
    frequency = ops.document_frequency(make_documents(pages))
    assert {r["term"]: r["df"] for r in frequency.collect()} == expected
    assert [r["term"] for r in ops.vocabulary(frequency).collect()] == sorted(
        expected, key=str.encode
    )
    assert ops.maximum_frequency(frequency).first()["max_df"] == max(expected.values(), default=0)
    assert ops.vocabulary_size(frequency) == len(expected)
    index = {r["term"]: r["term_index"] for r in ops.term_index(frequency, staging).collect()}
    assert index == {t: i for i, t in enumerate(sorted(expected, key=str.encode))}
    assert ops.frequency_of(frequency, "unicorn").count() == 0


def test_term_index_of_many_terms_and_splits(spark, staging):
    words = ["Z", "a", "z", "é", "東", "～", "😀"] + [f"w{i}" for i in range(500)]
    rows = [(s, w, 1) for s in range(3) for w in words[s:]]
    frequency = spark.createDataFrame(rows, "split_index int, term string, df long").repartition(5)
    got = ops.term_index(frequency, staging).collect()
    for s in range(3):
        expected = {t: i for i, t in enumerate(sorted(words[s:], key=str.encode))}
        assert {r["term"]: r["term_index"] for r in got if r["split_index"] == s} == expected


@pytest.mark.parametrize("block", [1, 9, 40, 1 << 20])
def test_long_documents_are_counted_block_by_block(spark, staging, block):
    """Pages of one word, of none, null, and one that is longer than any block, repeated ids too."""
    pages = [pages for pages, _ in CASES] + [
        ["a b c " * 50, None, "", "ΟΔΟΣ ΟΔΟΣ"], ["x" * 300, "y z" * 40], [" " * 200, "-" * 99], None,
    ]
    rows = [(i, p, "l") for i, p in enumerate(pages)] + [(0, ["a b c " * 50], "m"), (None, ["q " * 99], "n")]
    documents = spark.createDataFrame(rows, "doc_id long, pages array<string>, label string")

    def found(counted):
        return sorted(
            ((r["doc_id"], r["label"], tuple(map(tuple, r["terms"])), r["total"], r["mx"])
             for r in counted.collect()),
            key=repr,
        )

    blocks = ops.counted_documents(documents, staging, "blocks", block)
    assert found(blocks) == found(text.with_term_counts(documents))
    held = spark.read.parquet(f"{staging.path}/blocks")
    assert held.count() > len(rows) or block == 1 << 20
    if block == 40:  # no row sorts many more words than a block holds
        assert held.agg(F.max("total")).first()[0] <= 40


def _plan(table):
    return table._jdf.queryExecution().optimizedPlan().toString()


def test_long_documents_are_cut_once(make_documents):
    """Not again for every block, which costs the square of a document's blocks."""
    documents = make_documents([["a b c " * 50]])
    blocks = documents.select(text.text_blocks(F.col("pages"), 9).alias("blocks"))
    assert _plan(blocks).count("regexp_extract_all") == 1
    assert blocks.select(F.explode("blocks")).count() > 20


def test_words_are_counted_for_whole_batches(spark, make_documents):
    """No lambda is called for every word; batches of any size give the same rows."""
    pages = [["～ 😀 z Z é é"], None, [], ["b a b", "b ～"], [""], ["😀 " * 5 + "～"], ["a"]]
    documents = make_documents(pages).withColumn("sides", F.array(F.lit(True), F.lit(None)))
    counted = text.with_term_counts(documents.coalesce(1))
    assert _plan(counted).count("lambdafunction") == 1  # over the pages
    expected = []
    for i, held in enumerate(pages):
        words = [w.lower() for w in " ".join(held or []).split()]
        words = [w for w in words if w not in "～😀"]
        terms = [(w, words.count(w)) for w in sorted(set(words), key=str.encode)]
        expected.append((i, [True, None], terms, len(words), max([c for _, c in terms], default=0)))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        for most in ("1", "3", "10000"):
            spark.conf.set(setting, most)
            found = [
                (r["doc_id"], r["sides"], [tuple(t) for t in r["terms"]], r["total"], r["mx"])
                for r in counted.orderBy("doc_id").collect()
            ]
            assert found == expected
    finally:
        spark.conf.set(setting, before)


def test_words_are_found_for_whole_batches(make_documents, monkeypatch):
    """No regular expression makes an object of every word; the words are those it would find."""
    accent, beyond = "́", "\U0001d400\U00010428"
    pages = [
        [f"{accent}{accent}a{accent}b {accent} {accent}-é{accent}", f"{accent}c", "d"],
        [f"{beyond} x{beyond}😀y z", None, "Ünïcode İΣ ٣٤ ⅷ"],
        ["a", "b"], None, [], [""], [accent], ["no", "break"], ["東京 " * 30 + "ΑΣ"],
    ]
    documents = make_documents(pages)
    counted = text.with_term_counts(documents)
    assert "regexp_extract_all" not in _plan(counted)
    words = documents.select("doc_id", text.document_tokens(F.col("pages")).alias("words"))
    expected = {
        r["doc_id"]: sorted(((w, r["words"].count(w)) for w in set(r["words"])), key=lambda p: p[0].encode())
        for r in words.collect()
    }
    found = {r["doc_id"]: [tuple(t) for t in r["terms"]] for r in counted.collect()}
    assert found == expected
    # Texts are worked on in slices; any size gives the same rows.
    ranges = text.character_ranges(documents.sparkSession)
    lower = documents.select("doc_id", F.coalesce(F.array_join(F.transform("pages", text.page_text), "\n"), F.lit("")).alias("text"))
    [batch] = lower.coalesce(1).toArrow().combine_chunks().to_batches()
    for size in (1, 20, 1 << 20):
        monkeypatch.setattr(text, "SLICE_BYTES", size)
        counts = [row for part in text._counting(ranges)([batch.slice(0, 0), batch.slice(2)]) for row in part.to_pylist()]
        assert {r["doc_id"]: [(t["term"], t["cnt"]) for t in r["terms"]] for r in counts} == {
            i: terms for i, terms in expected.items() if i > 1
        }
