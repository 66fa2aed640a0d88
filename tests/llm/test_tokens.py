import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelweave.llm.packing import document_ids, pack, piece_lengths
from labelweave.llm.shipping import map_arrow
from labelweave.llm.tokens import RunTokens, count_udf, token_counts

from .helpers import TOKENIZER, rows_of

LIBRARY = tokenizers.Tokenizer.from_file(TOKENIZER)
TEXTS = [
    "",
    None,
    " \n\t ",
    "Don't stop: it's 12a3 O'NEIL'S",
    "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>",
    "café café 東京tower İstanbul ΣΑΣ x² €!!€",
    "x\x0by\x0cz\x00!\x1f",
    "word " * 4000,
    "w" * 9000,
]
ALPHABET = st.sampled_from(list("aBz'09!|<> \n\té́東€½İ") + ["<|endoftext|>"])


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=30).map("".join), max_size=5))
def test_counts_are_those_of_the_library(texts):
    count = count_udf(TOKENIZER, limit=16)
    assert count(pa.array(texts, pa.string())).to_pylist() == [len(ids(t)) for t in texts]


@pytest.mark.parametrize("memory", [3, 1000])
def test_runs_are_forgotten_without_harm(memory):
    table = RunTokens(TOKENIZER, memory)
    for text in ["one two three four", "two five six seven!", "one two three four"]:
        data = np.frombuffer(text.encode(), np.uint8)
        _, where, lengths = table.look_up(data, np.array([0, len(data)]))
        found = [i for w, n in zip(where, lengths, strict=True) for i in table.ids[w : w + n]]
        assert found == ids(text)


def test_token_counts_of_odd_rows(spark):
    rows = [(k, t, -1, "x") for k, t in enumerate(TEXTS)] + [(None, "a b", -1, "x"), (0, "", 0, "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes string")
    found = rows_of(token_counts(documents, TOKENIZER), *["doc_id", "n_bytes", "n_tokens", "over_limit"])
    wanted = [(i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048) for i, t, *_ in rows]
    assert found == sorted(wanted, key=repr)
    assert token_counts(documents.limit(0), TOKENIZER).count() == 0


@given(st.integers(1, 100_000))
def test_pieces_are_powers_of_two_and_whole(n):
    lengths = piece_lengths(n, 4096)
    assert sum(lengths) == n
    assert all(p & (p - 1) == 0 and p <= 4096 for p in lengths)
    assert all(p == 4096 for p in lengths if lengths.count(p) > 1)


def test_document_ids_of_a_text_in_parts(monkeypatch):
    found = dict(document_ids(pa.array(TEXTS), TOKENIZER, 2))
    assert {k: v.tolist() for k, v in found.items()} == {k: [*ids(t), 2] for k, t in enumerate(TEXTS)}


def test_packing_gives_every_id_back(spark, staging):
    rows = [(k, t, 5) for k, t in enumerate(TEXTS)] + [(None, "a b", 5), (3, TEXTS[3], 5)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    pieces = pack(documents, TOKENIZER, with_ids=True, staging=staging).toPandas()
    assert sorted(pieces.sequence_id) == list(range(len(pieces)))
    assert (pieces.offset == 0).all()
    for k, text in enumerate(TEXTS):
        own = pieces[pieces.doc_id == k].sort_values("start")
        whole = [*ids(text), 2]
        for piece in own.itertuples():
            part = list(piece.ids)
            assert part == whole[piece.start : piece.start + piece.length]
            assert piece.length & (piece.length - 1) == 0 and piece.length <= 4096
            import zlib

            assert piece.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert piece.doc_tokens == len(whole)
        copies = 2 if k == 3 else 1
        assert own.length.sum() == copies * len(whole)
    by_length = pieces.sort_values("sequence_id").length.tolist()
    assert by_length == sorted(by_length, reverse=True)
    assert pack(documents.limit(0), TOKENIZER, staging=staging).count() == 0
    with pytest.raises(ValueError):
        pack(documents, TOKENIZER, longest=1000)
    assert pack(documents.select("text", F.col("doc_id").alias("k")), TOKENIZER, "k").count() == len(pieces)


def test_a_worker_keeps_runs_only_for_tasks_that_use_them(spark):
    def names(batches):
        for batch in batches:
            from labelweave.llm.shipping import left_behind

            left_behind.setdefault("runs", 1)
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(sorted(left_behind))])], ["names"])

    def others(batches):
        for batch in batches:
            from labelweave.llm.shipping import left_behind

            yield pa.RecordBatch.from_arrays([pa.array([" ".join(sorted(left_behind))])], ["names"])

    one = spark.range(1).coalesce(1)
    assert map_arrow(one, names, "names string", keep="runs").first()[0] == "runs"
    assert map_arrow(one, others, "names string", keep="runs").first()[0] in ("", "runs")
    assert map_arrow(one, others, "names string").first()[0] == ""


def test_known_runs_are_sorted_and_held_once():
    table = RunTokens(TOKENIZER, 1000)
    for text in ["one two three four", "two five six 7!", "zero one 99"]:
        data = np.frombuffer(text.encode(), np.uint8)
        table.look_up(data, np.array([0, len(data)]))
    assert (np.diff(table.hashes.astype(object)) > 0).all()
    assert len(table.hashes) == len(table.where) == len(table.lengths) == 10
    assert table.lengths.dtype == np.int32
