import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelweave.llm import word_likelihood
from labelweave.llm.arrowtext import mix, text_buffer
from labelweave.llm.window_network import WindowNetwork

SPACES = " \t\n\v\f\r"


def plain_tokens(text):
    found, joined = [], False
    for c in text or "":
        inside = (c.isascii() and c.isalnum()) or 0xC0 <= ord(c) < 0x800
        if c in SPACES:
            joined = False
            continue
        if inside and joined:
            found[-1] += c
        else:
            found.append(c)
        joined = inside
    return found


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ 9.é東Я\n\xa0😀%", max_size=12)), max_size=5))
def test_tokens(texts):
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    rows, hashes, starts, ends = word_likelihood.tokens(data, offsets)
    raw = data.tobytes()
    found = [(r, raw[a:b].decode()) for r, a, b in zip(rows.tolist(), starts, ends, strict=True)]
    assert found == [(k, w) for k, t in enumerate(texts) for w in plain_tokens(t)]
    assert len(set(hashes.tolist())) == len({w for _, w in found})


def corpus():
    rng = random.Random(2)
    latin = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 6))) for _ in range(30)]
    greek = ["".join(rng.choices("αβγδεζ", k=rng.randrange(2, 6))) for _ in range(30)]
    chinese = [chr(0x4E00 + k) for k in range(30)]
    texts = []
    for words, between in ((latin, " "), (greek, " "), (chinese, "")):
        for _ in range(25):
            first = rng.randrange(30)  # each word has one of two followers
            own = [first := (2 * first + rng.randrange(2)) % 30 for _ in range(40)]
            texts.append(between.join(words[k] for k in own))
    return [*texts, texts[0], "", None, " \n"]


def name_of(token):
    data, offsets = text_buffer(pa.array([token]))
    return int(word_likelihood.tokens(data, offsets)[1].view(np.int64)[0])


def plain_scores(texts, network):
    """Tokens and score of every text, by a forward pass for each token."""
    rows = [plain_tokens(t) for t in texts]
    n, pairs = Counter(w for row in rows for w in row), Counter()
    for row in rows:
        for w in row:
            spelled = b" " + w.encode() + b" "
            pairs.update(zip(spelled, spelled[1:], strict=False))
    after = Counter()
    for (a, _), c in pairs.items():
        after[a] += c
    frequent = sorted(n, key=lambda w: (-n[w], name_of(w)))[: word_likelihood.FIRST_ENDING - 2]
    own = {w: 2 + k for k, w in enumerate(frequent)}

    def class_of(w):
        if w in own:
            return own[w]
        raw = w.encode()
        two = raw[-1] * 256 + (raw[-2] if len(raw) > 1 else 0) + 1
        share = int(mix(np.array([two], np.uint64))[0])
        return word_likelihood.FIRST_ENDING + share % word_likelihood.ENDINGS

    of_class = Counter()
    for w, c in n.items():
        of_class[class_of(w)] += c
    answers = []
    for row in rows:
        classes, score = [0, 0, *map(class_of, row), 1, 1], 0.0
        for k, w in enumerate(row):
            around = [classes[k], classes[k + 1], classes[k + 3], classes[k + 4]]
            hidden = network.hidden_bias + sum(
                network.places[place][c] for place, c in enumerate(around)
            )
            hidden = np.tanh(hidden.astype(float))
            g, c = divmod(classes[k + 2], 32)
            groups = np.exp(hidden @ network.group + network.group_bias)
            inside = np.exp(hidden @ network.within[g] + network.within_bias[g])
            score += math.log(groups[g] / groups.sum() * inside[c] / inside.sum())
            if w not in own:
                raw = b" " + w.encode() + b" "
                spelled = math.prod(
                    (pairs[p] + 0.5) / (after[p[0]] + 128) for p in zip(raw, raw[1:], strict=False)
                )
                others = max(of_class[class_of(w)] - 1, 1)
                score += math.log(0.05 * spelled + 0.95 * (n[w] - 1) / others)
        answers.append((len(row), score))
    return answers


def some_network(blocks, windows, class_counts):
    network = WindowNetwork.start(class_counts)
    random_ = np.random.default_rng(5)
    return WindowNetwork(
        *(w + random_.normal(0, 0.3, w.shape).astype(np.float32) for w in network.weights())
    )


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_scores_are_those_of_a_plain_forward_pass(spark, monkeypatch, block):
    monkeypatch.setattr(word_likelihood, "SLICE", 64)
    monkeypatch.setattr(word_likelihood, "BLOCK", block)
    monkeypatch.setattr(word_likelihood, "PART", 500)
    made = []

    def train(*given):
        made.append(some_network(*given))
        return made[0]

    monkeypatch.setattr(word_likelihood.window_network, "train", train)
    rng = random.Random(4)
    letters = "abcdefghijklmnop"
    many = ["".join(rng.choices(letters, k=rng.randrange(3, 9))) for _ in range(900)]
    long_word = "x" * 300 + "é" * 200
    texts = [*corpus()[::4], " ".join(many), " ".join(many[:40]), long_word, None, "", "a", "a b"]
    frame = spark.createDataFrame(
        [(k, t, 1, 1, 1) for k, t in enumerate(texts)],
        "doc_id long, text string, id int, row int, n_tokens int",
    ).repartition(3)
    found = {r["doc_id"]: r for r in word_likelihood.score(frame).collect()}
    assert len(found) == len(texts)
    for k, (n_tokens, score) in enumerate(plain_scores(texts, made[0])):
        assert found[k]["n_tokens"] == n_tokens
        assert found[k]["pseudo_log_likelihood"] == pytest.approx(score, rel=1e-4, abs=1e-6)
        assert (found[k]["per_token"] is None) == (n_tokens == 0)


def test_words_in_another_order_are_less_probable(spark):
    texts = corpus() * 3
    rng = random.Random(3)
    asked = [0, 30, 60]
    for k in asked:  # the words of a text, or its characters, in another order
        w = plain_tokens(texts[k])
        texts.append((" " if k < 60 else "").join(rng.sample(w, len(w))))
    rows = [*enumerate(texts), (None, "abc"), (None, "abc"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    answers = word_likelihood.score(frame).collect()
    found = {r["doc_id"]: r for r in answers}
    assert len(answers) == len(rows)
    assert sorted(r["n_tokens"] for r in answers if r["doc_id"] is None) == [0, 1, 1]
    for k, shuffled in zip(asked, range(len(texts) - 3, len(texts)), strict=True):
        assert found[k]["per_token"] > found[shuffled]["per_token"] + 0.2
    assert word_likelihood.score(frame.limit(0)).count() == 0
    blank = spark.createDataFrame([(k, "" if k else None) for k in range(5)], "doc_id long, text string")
    assert [r["n_tokens"] for r in word_likelihood.score(blank).collect()] == [0] * 5


def test_gradient_is_the_slope_of_the_loss():
    random_ = np.random.default_rng(0)
    network = WindowNetwork.start(random_.integers(1, 9, 1024).astype(float))
    network = WindowNetwork(*(w.astype(float) for w in network.weights()))
    context, middle = random_.integers(0, 1024, (60, 4)), random_.integers(0, 1024, 60)

    def loss():
        hidden = network._hidden(context)
        groups, inside = np.divmod(middle, 32)
        total = 0.0
        for h, g, c in zip(hidden, groups, inside, strict=True):
            a, b = h @ network.group + network.group_bias, h @ network.within[g] + network.within_bias[g]
            total += a[g] - np.log(np.exp(a).sum()) + b[c] - np.log(np.exp(b).sum())
        return -total / len(middle)

    for weight, slope in zip(network.weights(), network.gradient(context, middle), strict=True):
        flat = weight.reshape(-1)
        seen = np.flatnonzero(slope.reshape(-1))
        for k in random_.choice(seen, 12):
            kept, step = flat[k], 1e-4
            flat[k] = kept + step
            more = loss()
            flat[k] = kept - step
            less = loss()
            flat[k] = kept
            assert (more - less) / (2 * step) == pytest.approx(slope.reshape(-1)[k], rel=1e-3, abs=1e-7)


def test_texts_are_read_once_for_the_vocabulary(spark):
    rows = spark.sparkContext.accumulator(0)
    texts = spark.createDataFrame([(t,) for t in corpus()], "text string")

    def counting(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    word_likelihood.learn_vocabulary(texts.mapInArrow(counting, "text string"))
    assert rows.value == len(corpus())


def test_windows_of_a_round_are_those_of_the_whole_block():
    lengths, classes = np.array([3, 0, 4, 1]), np.arange(2, 12)
    place = np.random.default_rng(0).integers(0, 10, lengths.sum() + 4 * len(lengths))
    packed = [word_likelihood._squeezed(v) for v in (lengths, classes, place)]
    context, middle, *_ = word_likelihood._block_windows(*packed)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0]), *(pa.array([v], pa.binary()) for v in packed)],
        ["block", "lengths", "classes", "places"],
    )
    for number in range(3):
        some = slice(number, None, 3)
        own_context, own_middle = word_likelihood._training_windows(batch, 0, some)
        assert np.array_equal(own_context, context[some])
        assert np.array_equal(own_middle, middle[some])
