import zlib
from collections import Counter
from itertools import product
from math import isclose, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from recontact.llm import gru, lmscore
from recontact.llm.common import fold


def small_net(seed=0, groups=2):
    counts = np.array([50, 30, 10, 5, 3, 20, 7], dtype=float)
    net = gru.Network.new(counts, groups, 3, hidden=4, seed=seed)
    draw = np.random.default_rng(seed)
    for v in net.values.values():
        v += draw.normal(0, 0.3, v.shape).astype(np.float32)
    return net


def test_probabilities_sum_to_one_after_any_history():
    net = small_net()
    for history in ([], [1], [3, 0, 6]):
        whole = gru.scores(net, [np.array([*history, w], np.int32) for w in range(7)], 0)
        before = gru.scores(net, [np.array(history, np.int32)], 0)[0]
        assert isclose(np.exp(whole - before).sum(), 1.0, rel_tol=1e-4)


def test_state_is_carried_across_windows_and_lanes_do_not_mix():
    net, draw = small_net(), np.random.default_rng(2)
    streams = [draw.integers(0, 7, n).astype(np.int32) for n in (300, 1, 65, 64, 7, 0, 150)]
    alone = [gru.scores(net, [s], 0, steps=1000)[0] for s in streams]
    assert np.allclose(gru.scores(net, streams, 0, most=3, steps=16), alone, rtol=1e-4)


def test_gradients_by_differences():
    net, stream = small_net(), np.array([1, 3, 0, 5, 2, 2, 6, 4], np.int32)
    values = {k: v.astype(np.float64) for k, v in net.values.items()}
    exact = gru.Network(net.of_class, values)
    # One step of training on one lane moves each parameter by rate * g / sqrt(0.01 + g * g), from which g follows.
    moved = gru.train(net, [stream], 0, most=1, rate=1e-3)
    for name in ("u", "b", "cw", "ww", "x"):
        step = (net.values[name] - moved.values[name]) / 1e-3
        g = step * 0.1 / np.sqrt(np.maximum(1 - step ** 2, 1e-9)) * len(stream) ** 0.5
        for place in [(0, 1), (2, 3), (3, 0)] if values[name].ndim == 2 else [0, 5, 9]:
            def loss(delta, name=name, place=place):
                changed = {k: v.copy() for k, v in values.items()}
                changed[name][place] += delta
                return -gru.scores(gru.Network(exact.of_class, changed), [stream], 0)[0]
            assert abs((loss(1e-3) - loss(-1e-3)) / 2e-3 - g[place]) < 0.03 + 0.03 * abs(g[place]), (name, place)


def test_training_learns_order():
    counts = np.array([100, 100, 100, 100, 1], dtype=float)
    streams = [np.tile([0, 1, 2, 3], 40).astype(np.int32) for _ in range(60)]
    net = gru.Network.new(counts, 1, 4, hidden=8)
    before = gru.scores(net, streams[:1], 0)[0]
    for _ in range(3):
        net = gru.train(net, streams, 0)
    assert gru.scores(net, streams[:1], 0)[0] > 0.5 * before


def test_base_and_held_out_gain(documents):
    scored = lmscore.score(documents.withColumn("learn", fold(F.col("doc_id"), 7) != 2), "learn").collect()
    texts = {r.doc_id: lmscore.words_of(r.text) + [lmscore.END] for r in documents.collect()}
    counts = Counter(w for k, words in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in words)
    total, kinds = sum(counts.values()), len(counts)
    for r in scored:
        words = texts[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert isclose(r.base_score, sum(log10((counts[w] + 1) / (total + kinds + 1)) for w in words), rel_tol=1e-9)
    held = [r for r in scored if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("held_words", [3, 50])
def test_rare_words_are_joined_and_the_model_is_proper(spark, monkeypatch, held_words):
    monkeypatch.setattr(lmscore, "HELD_WORDS", held_words)
    words = ["Aa", "bb", "cc", "dd", "ee", "new"]
    rows = [(0, "aa bb aa cc dd", True), (1, "bb cc ee aa", True)] + [(10 + i, " ".join(p), False) for i, p in enumerate(product(words, repeat=2))]
    scored = {r.k: r for r in lmscore.score(spark.createDataFrame(rows, "k long, text string, learn boolean"), "learn", key="k").collect()}
    counts = Counter("aa bb aa cc dd bb cc ee aa".split()) + Counter([""] * 2)
    for key, text, _ in rows:
        tokens = [*text.lower().split(), ""]
        assert isclose(scored[key].base_score, sum(log10((counts[w] + 1) / (sum(counts.values()) + len(counts) + 1)) for w in tokens))
        assert scored[key].n_known == sum(counts[w] > 0 for w in tokens)
        assert scored[key].score < 0


def test_odd_rows(odd, nothing):
    rows = lmscore.score(odd, "doc_id = 4 OR doc_id IS NULL").collect()
    assert len(rows) == odd.count() and all(np.isfinite([r.score, r.base_score]).all() for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in lmscore.score(odd, "false").collect())
    assert lmscore.score(nothing, "true").collect() == []
