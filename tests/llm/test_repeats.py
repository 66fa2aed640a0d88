import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelweave.config import InvalidInput
from labelweave.llm import repeats
from labelweave.llm.repeats import joined_spans, parse, without_repeats

from .helpers import rows_of

COLUMNS = ["doc_id", "n_bytes", "n_removed", "starts", "ends", "kept"]


def plain(rows, length):
    """Spans and the bytes that stay, from a count of all strings."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    found = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if times[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        edges = [k for k in range(len(t) + 1) if (gone[k : k + 1] or b"\0") != (gone[k - 1 : k] if k else b"\0")]
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        found.append((i, len(t), sum(gone), edges[::2], edges[1::2], kept))
    return sorted(found, key=repr)


def joined(texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    return np.frombuffer(b"".join(data), np.uint8), offsets


@settings(deadline=None)
@given(st.lists(st.text(st.sampled_from("abé"), max_size=80), max_size=5), st.integers(1, 40))
def test_every_string_is_in_one_phrase_that_its_bytes_decide(texts, length):
    data, offsets = joined(texts)
    p = parse(data, offsets, length)
    seen, phrases = {}, {}
    for row, first, last, trigger, core, whole in zip(*(p[k].tolist() for k in p), strict=True):
        text = texts[row].encode()
        union = text[first : last + length]
        assert phrases.setdefault((core, whole), (union, trigger - first)) == (union, trigger - first)
        for at in range(first, last + 1):
            string = text[at : at + length]
            assert len(string) == length and (row, at) not in seen
            seen[row, at] = string, trigger - at, core
    assert set(seen) == {
        (r, a) for r, t in enumerate(texts) for a in range(len(t.encode()) - length + 1)
    }
    by_string = {}
    for string, ahead, core in seen.values():
        assert by_string.setdefault(string, (ahead, core)) == (ahead, core)


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 20), st.integers(1, 9)), max_size=12))
def test_spans_are_joined(spans):
    row, start, size = np.array(spans, np.int64).reshape(-1, 3).T
    found = [set() for _ in range(4)]
    for r, s, e in zip(*(c.tolist() for c in joined_spans(row, start, start + size)), strict=True):
        assert not found[r] or s > max(found[r]) + 1
        found[r] |= set(range(s, e))
    wanted = [set() for _ in range(4)]
    for r, s, n in spans:
        wanted[r] |= set(range(s, s + n))
    assert found == wanted


def corpus(seed):
    """Texts that share passages, whole or changed, with copies, periods and odd rows."""
    random.seed(seed)
    passages = ["".join(random.choices("abcdeé ", k=random.randint(30, 300))) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(random.randint(1, 5)):
            part = random.choice(passages)
            if random.random() < 0.4:
                at = random.randrange(len(part))
                part = part[:at] + "XYZ"[random.randrange(3)] + part[at + random.randrange(2) :]
            at = random.randrange(len(part))
            parts.append(random.choice([part, part[at:], part[:at], str(random.random())]))
        texts.append("".join(parts))
    texts += [texts[0]] * 5 + [texts[1]] * 2 + ["", None, "a" * 500, "ab" * 300, "xyz" * 7, "q" * 30]
    texts += ["".join(p[:29] for p in passages), "".join(random.choices("abc", k=4000))]
    rows = list(enumerate(texts))
    return [*rows, (None, texts[2]), (None, texts[2]), (None, None), (3, texts[4]), (3, texts[3])]


@pytest.mark.parametrize("length", [1, 11, 24, 25, 60])
def test_texts_of_all_kinds(spark, length):
    rows = corpus(length)
    table = spark.createDataFrame(
        [(*r, 1, "x", [0]) for r in rows], "doc_id long, text string, n_bytes int, k1 string, starts array<int>"
    )
    found = rows_of(without_repeats(table.repartition(7), length), *COLUMNS)
    found = [(i, n, r, list(s), list(e), bytes(k)) for i, n, r, s, e, k in found]
    assert sorted(found, key=repr) == plain(rows, length)


def test_long_texts_are_parsed_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "_PART_BYTES", 64)
    data, offsets = joined(["short", "ab" * 150, "x" * 64, "y" * 90, ""])
    strings = Counter()
    for first_row, at, part, bounds in repeats._parts(data, offsets, 24):
        p = parse(part, bounds, 24)
        for row, first, last in zip(p["row"], p["first"], p["last"], strict=True):
            strings.update((int(row) + first_row, at + k) for k in range(int(first), int(last) + 1))
    assert set(strings.values()) == {1}
    assert set(strings) == {(r, a) for r, n in ((1, 300), (2, 64), (3, 90)) for a in range(n - 23)}


def test_empty_table_and_lengths(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert without_repeats(table).count() == 0
    with pytest.raises(InvalidInput):
        without_repeats(table, 5000)


def test_the_query_over_its_table(spark):
    from labelweave.llm.queries import op13_repeated_strings

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    wanted = [(i, n, r, len(s), hashlib.sha256(k).hexdigest()) for i, n, r, s, _, k in plain(rows, 400)]
    found = rows_of(op13_repeated_strings(spark, folder), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == sorted(wanted, key=repr)
    assert sum(r for _, _, r, _, _ in found) > 0
