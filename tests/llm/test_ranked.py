import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelweave.llm.ranked import Best, Postings, ranked_documents, search, terms

from .helpers import LOWER, rows_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain_ranking(documents, items, k=10):
    """Every document scored for every item."""
    counts = [(i, Counter(plain_terms(t))) for i, t in documents]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    holding = Counter(t for _, c, _ in counts for t in c)
    found = []
    for item, text in set(items):
        scores = []
        for i, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1)))
                * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(plain_terms(text)) if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        best = sorted(scores)[:k]
        found += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(best)]
    return sorted(found, key=repr)


@given(st.lists(st.text(st.sampled_from("aZ09 _-é東{\x7f\x80\n"), max_size=12), max_size=6))
def test_terms_are_those_of_the_pattern(texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    rows, hashes = terms(np.frombuffer(b"".join(data), np.uint8), offsets)
    wanted = [(k, t) for k, text in enumerate(texts) for t in plain_terms(text)]
    assert rows.tolist() == [k for k, _ in wanted]
    names = {}
    for (_, term), h in zip(wanted, hashes.tolist(), strict=True):
        assert names.setdefault(term, h) == h
    assert len(set(names.values())) == len(names)


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=6, max_size=6), min_size=1, max_size=40),
       st.sets(st.integers(0, 5)), st.integers(1, 5), st.sampled_from([0, 3, 50]))
def test_search_finds_the_best_of_a_block(impacts, query, k, leaf):
    held = np.array(impacts)
    doc, term = np.nonzero(held)
    postings = Postings(term, doc, held[doc, term].astype(np.int64), len(held))
    ids = [(7 * d) % 41 for d in range(len(held))]
    best = Best(k)
    search(postings, np.array(sorted(query), np.int64), ids, best, leaf)
    scores = held[:, sorted(query)].sum(axis=1)
    wanted = sorted((-int(s), i) for s, i in zip(scores, ids, strict=True) if s > 0)[:k]
    assert sorted((-s, i) for i, s in best.rows()) == wanted


def test_few_intervals_are_opened_when_few_documents_matter():
    random = np.random.default_rng(1)
    held = random.integers(1, 50, (20_000, 3))
    held[777] = 5000
    doc, term = np.nonzero(held)
    postings = Postings(term, doc, held[doc, term].astype(np.int64), len(held))
    best = Best(1)
    assert search(postings, np.arange(3), list(range(len(held))), best, 0) < 10
    assert best.rows() == [(777, 15_000)]


def documents_and_items():
    words = ["alpha", "Beta", "gamma9", "délta", "東京", "x", "the", "THE", "_", "end."]
    documents = [(k, " ".join(words[(k * j + j) % 10] for j in range(k % 17))) for k in range(150)]
    documents += [(200, None), (201, ""), (202, " -- "), (None, "alpha beta"), (None, "alpha beta"),
                  (5, "alpha alpha"), (203, "rare " + "the " * 100_000), (204, "y" * 300_000)]
    items = [(1, "Alpha beta, the x"), (1, "Alpha beta, the x"), (2, "rare délta 東京"), (2, "gamma9"),
             (None, "beta?"), (3, None), (4, "..."), (5, "unknown"), (6, "the " * 50_000 + "end")]
    return documents, items


@pytest.mark.parametrize("limits", [{}, {"query_terms": 3, "block_postings": 40, "leaf_postings": 5}])
def test_whole_tables_with_odd_rows(spark, limits):
    documents, items = documents_and_items()
    docs = spark.createDataFrame([(*r, 1, 2) for r in documents], "doc_id long, text string, score int, item_id int")
    asked = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, doc_id int, terms int")
    found = ranked_documents(docs.repartition(5), asked, **limits)
    assert rows_of(found, "item_id", "rank", "doc_id", "score") == plain_ranking(documents, items)
    assert ranked_documents(docs.limit(0), asked).count() == 0
    assert ranked_documents(docs, asked.limit(0)).count() == 0


def test_the_query_over_its_tables(spark):
    from labelweave.llm.queries import op12_ranked_search

    folder = "/root/testdata/sf0.001"
    tables = [[tuple(r) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(c, "text").collect()]
              for t, c in (("documents", "doc_id"), ("benchmark", "item_id"))]
    found = rows_of(op12_ranked_search(spark, folder), "item_id", "rank", "doc_id", "score")
    assert found == plain_ranking(*tables)
