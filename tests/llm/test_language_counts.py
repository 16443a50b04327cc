"""A word that one language keeps has its real count in all languages."""

import numpy as np
import pytest

from foreslate.llm import language_id


def test_kept_words_have_their_counts_in_every_language(spark, monkeypatch):
    monkeypatch.setattr(language_id, "WORDS", 4)
    monkeypatch.setattr(language_id, "GRAMS", 4)
    corpus = {"en": {"the": 9, "dog": 7, "haus": 3, "x": 1}, "de": {"haus": 8, "der": 6, "dog": 2, "y": 1}}
    rows = [(w, lang) for lang, own in corpus.items() for w, n in own.items() for _ in range(n)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == ["de", "en"] and set(model.words) == {b"the", b"dog", b"haus", b"der"}
    types = 6  # of all words, the two that no language keeps too
    for word, at in model.words.items():
        real = [(corpus[lang].get(word.decode(), 0) + 0.5) / (sum(corpus[lang].values()) + 0.5 * types) for lang in model.langs]
        assert model.word_logs[at] == pytest.approx(np.log(real))
    # both languages have "<", once for each word; they keep it and its real count
    place, logs = model.grams[1]
    letters = {lang: sum(n * (len(w) + 2) for w, n in own.items()) for lang, own in corpus.items()}
    kinds = len({c for own in corpus.values() for w in own for c in f"<{w}>"})
    for i, lang in enumerate(model.langs):
        n = sum(corpus[lang].values())
        assert logs[place["<"], i] == pytest.approx(np.log((n + 0.5) / (letters[lang] + 0.5 * kinds)))
