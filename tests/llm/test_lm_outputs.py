"""The recurrent model's outputs, laid out for the cache, are those of a plain softmax of three levels."""

import numpy as np
import pytest

from foreslate.llm import recurrent_lm as R


def _model(words, dtype=np.float64):
    counts = np.arange(words, 0, -1) ** 2 + 4
    return R.Model(R.Vocabulary(np.arange(1, words + 1).astype(np.uint64), counts, int(counts.sum()) + 50, words + 9), dtype, 4)


def _targets(model, n):
    return (np.random.default_rng(n).zipf(1.3, n) % len(model.class_of)).astype(np.int32)


def _plain(model, states, targets):
    """Log probabilities, and gradients of their negative sum by states, group, class and word tables, a target at a time."""
    w, logs = model.weights, np.zeros(len(targets))
    by_state, by = np.zeros_like(states), {k: np.zeros_like(w[k]) for k in ("group", "class", "word")}
    for i, (s, word) in enumerate(zip(states, targets)):
        c = word // model.size
        for table, into, at in ((w["group"], by["group"], c // model.wide),
                                (w["class"][c // model.wide], by["class"][c // model.wide], c % model.wide),
                                (w["word"][c], by["word"][c], word % model.size)):
            logits = table[:, :-1] @ s + table[:, -1]
            p = np.exp(logits - logits.max())
            p /= p.sum()
            logs[i] += np.log(p[at])
            p[at] -= 1
            by_state[i] += p @ table[:, :-1]
            into += np.outer(p, np.append(s, 1))
    return logs, by_state, by


@pytest.mark.parametrize("alone, chunk", [(1, 64), (10, 64), (64, 1024), (10 ** 9, 16)])
@pytest.mark.parametrize("grown", [1, 400])
def test_outputs_are_of_a_plain_softmax(monkeypatch, alone, chunk, grown):
    monkeypatch.setattr(R, "ALONE", alone)
    monkeypatch.setattr(R, "CHUNK", chunk)
    model = _model(150)
    for k in ("group", "class", "word"):  # grown weights: exponentials of their logits leave the range of floats
        model.weights[k][..., :-1] *= grown * 10
    targets = _targets(model, 700)
    states = np.random.default_rng(1).uniform(-1, 1, (len(targets), 4))
    grads = {}
    logs, by_state = model._outputs(states, targets, grads)
    want, state, by = _plain(model, states, targets)
    assert logs == pytest.approx(want) and by_state == pytest.approx(state)
    for k, (rows, g) in grads.items():
        full = np.zeros_like(by[k])
        full[rows] = g
        assert full == pytest.approx(by[k], abs=1e-8)
    assert model._outputs(states, targets, None)[0] == pytest.approx(want)


def test_scoring_takes_hardly_more_exponentials_than_there_are_logits(monkeypatch):
    model = _model(8000, np.float32)
    texts = [np.append(_targets(model, 3000 + i), 0) for i in range(30)]
    made, exp = [], np.exp
    monkeypatch.setattr(R.np, "exp", lambda x, **out: made.append(x.size) or exp(x, **out))
    model.score(texts)
    tokens = sum(map(len, texts))
    gates = 2 * model.weights["state"].shape[0]
    assert sum(made) < tokens * 1.1 * (gates + len(model.weights["group"]) + model.wide + model.size)


def test_an_update_is_one_of_whole_tables(monkeypatch):
    told = []
    for cached in (7, 1 << 15):
        monkeypatch.setattr(R, "CACHED", cached)
        model = _model(150)
        model.train([np.append(_targets(model, n), 0) for n in (40, 900, 3)])
        told.append(model.flat())
    assert told[0] == pytest.approx(told[1], rel=1e-12)


def test_words_are_found_however_their_hashes_begin():
    rng = np.random.default_rng(3)
    hashes = np.unique(np.concatenate([rng.integers(1, 1 << 64, 3000, np.uint64), np.arange(1, 300).astype(np.uint64),
                                       np.uint64((1 << 64) - 1) - np.arange(5).astype(np.uint64)]))
    known = R.Vocabulary(hashes[::2], np.arange(len(hashes[::2]), 0, -1) + 5, 10 ** 8, 10 ** 5)
    number = {int(h): i + 2 for i, h in enumerate(hashes[::2])}
    assert known.encode(hashes).tolist() == [number.get(int(h), R.RARE) for h in hashes]
    assert known.encode(np.array([0], np.uint64)).tolist() == [R.END] and len(known.encode(np.zeros(0, np.uint64))) == 0


def test_training_reads_its_own_texts():
    from foreslate.llm.blocks import NO_ID
    import zstandard

    ids, texts = [*range(40), NO_ID], [f"a b{i} c".encode() * (i % 3) for i in range(41)]
    block = ids, [len(t) for t in texts], zstandard.compress(b"".join(texts))
    every, own = R.Tokens(*block), R.Tokens(*block, training=True)
    cut = [every.hashes[a:b].tolist() for a, b in zip(every.bounds, every.bounds[1:])]
    assert [own.hashes[a:b].tolist() for a, b in zip(own.bounds, own.bounds[1:])] == [c for c, t in zip(cut, every.trained) if t]
    assert own.trained.all() and len(own.ids) == int(every.trained.sum())


@pytest.mark.parametrize("texts", [[], [b""], [b"", b"a  b" * 50, b"", b"c", b" "], [b"x y " * 9] * 30 + [b"", b"z"]])
def test_words_hashed_in_parts_are_the_same(monkeypatch, texts):
    monkeypatch.setattr(R, "HASHED", 40)
    for told, want in zip(R._hashed(texts), R.word_hashes(texts)):
        assert told.tolist() == want.tolist()
