"""The known words grow with the texts, and words that tie are no cliff."""

import numpy as np

from foreslate.llm import recurrent_lm as R


def _answers(spark, words, counts, tokens):
    row = (-1, 0, bytearray(np.asarray(counts, np.int64).tobytes()), bytearray(np.asarray(words, np.uint64).tobytes()), len(words), tokens)
    return spark.createDataFrame([row], "block bigint, part int, counts binary, offered binary, types bigint, tokens bigint")


def test_known_words_grow_with_tokens(spark):
    words, counts = np.arange(1, 50_001), np.arange(50_001, 1, -1) + 10
    sizes = [len(R.learn_vocabulary(_answers(spark, words, counts, n))) for n in (10_000, 4_000_000, 100_000_000)]
    for size, most in zip(sizes, (1024, 8000, 40_000)):
        assert 0.98 * most < size <= most + 2


def test_a_tie_is_no_cliff(spark):
    words = np.random.default_rng(0).integers(1, 1 << 62, 3000)
    known = R.learn_vocabulary(_answers(spark, words, np.full(3000, 5), 15_000))
    assert 1000 < len(known) <= 1026


def test_numbers_of_many_words():
    known = R.Vocabulary(np.arange(1, 40_001).astype(np.uint64), np.arange(40_000, 0, -1) + 5, 900_000_000, 90_000)
    assert known.encode(np.array([1, 40_000, 50_000], np.uint64)).tolist() == [2, 40_001, R.RARE]
    assert 150 < known.class_of.max() + 1 <= 201
