"""The sums and orders of the recurrent model's training are those of plain numpy."""

import numpy as np
import pytest

from foreslate.llm import recurrent_lm as R


@pytest.mark.parametrize("most", [3, 500, 70_000, 400_000])
def test_order_is_the_stable_one(most):
    words = np.random.default_rng(most).integers(0, most, 20_000).astype(np.int32)
    assert np.array_equal(R._sorted(words), np.argsort(words, kind="stable"))


@pytest.mark.parametrize("sizes", [[1], [5000], [1] * 300, [1, 4000, 2, 900, 1, 1, 64], list(range(1, 120))])
def test_runs_are_summed_whole(sizes):
    rows = np.random.default_rng(1).normal(size=(sum(sizes), 4, 3))
    first = np.cumsum(sizes) - sizes
    assert np.allclose(R._runs(rows, first), np.add.reduceat(rows, first, axis=0))
    assert R._sorted(np.zeros(0, np.int32)).size == 0


def test_hashes_are_of_lower_cased_words():
    from foreslate.llm.shingles import _ODD, _PLACE, mix, word_hashes  # noqa: F401

    texts = [b"", b" \t\x0b", "One onE  two\r\nÄ \x1c \x00".encode(), b"x" * 200 + b" " + b"X" * 200, b"last"]
    hashes, bounds = word_hashes(texts)
    words = [w.lower() for t in texts for w in t.split()]
    told = []
    for w in words:
        value = sum(int(_PLACE[(i & 63) << 8 | b]) * (2 * (i >> 6) + 1 if len(words) and max(map(len, words)) > 64 else 1)
                    for i, b in enumerate(w)) + len(w)
        told.append(int(mix(np.array([value % 2 ** 64], np.uint64))[0]))
    assert hashes.tolist() == told
    assert bounds.tolist() == np.cumsum([0, *[len(t.split()) for t in texts]]).tolist()
    assert [len(x) for x in word_hashes([])] == [0, 1]
