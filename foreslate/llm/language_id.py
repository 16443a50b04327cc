"""Language ID by words first, then by shorter and shorter character n-grams.

A known word gives its log frequency in every language; an unseen word is
scored by its known 4-grams, or if it has none by its 3-grams, and so on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.store import materialize
from .common import crc_remainder, documents, python_ready, release

#: Most words and most n-grams of one length that the model keeps, over all languages together.
WORDS, GRAMS = 120_000, 40_000
LONGEST_GRAM = 4
UNKNOWN = "und"

#: Keeps letters and all bytes above ASCII; everything else becomes a space.
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_LETTERS).split()


def grams_of(word: bytes, n: int) -> list[str]:
    text = f"<{word.decode()}>"
    return [text[i:i + n] for i in range(len(text) - n + 1)]


def has_letter(text: str) -> bool:
    return bool(re.search("[A-Za-z]", text)) or any(c.isalpha() for c in text)


class Model:
    """Log frequencies: a row per word or n-gram, a column per language."""

    def __init__(self, langs: list[str], words: list[tuple], grams: list[tuple], sums: dict[int, tuple[int, dict]]):
        """``words``: (word, lang, n); ``grams``: (length, gram, lang, n), of the kept keys in every language.

        ``sums``, by length and 0 for words: how many different keys there are and how often
        each language has any, over all keys, kept or not.
        """
        self.langs = langs
        self.words, self.word_logs = self._table([(bytes(w), lang, n) for w, lang, n in words], sums.get(0))
        self.grams = {
            size: self._table([(g, lang, n) for k, g, lang, n in grams if k == size], sums.get(size))
            for size in range(1, LONGEST_GRAM + 1)
        }

    def _table(self, rows: list[tuple], sums: tuple[int, dict] | None) -> tuple[dict, np.ndarray]:
        place: dict = {}
        column = {lang: i for i, lang in enumerate(self.langs)}
        for key, _, _ in rows:
            place.setdefault(key, len(place))
        counts = np.full((len(place), len(self.langs)), 0.5)
        for key, lang, n in rows:
            counts[place[key], column[lang]] += n
        if not place:
            return place, counts
        types, totals = sums
        return place, np.log(counts / np.array([totals.get(lang, 0) + 0.5 * types for lang in self.langs]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or text is None or not has_letter(text):
            return UNKNOWN, 0.0
        known, unseen = [], []
        lookup = self.words.get
        for word, n in Counter(words_of(text)).items():
            at = lookup(word)
            if at is None:
                unseen.append((word, n))
            else:
                known.append((at, n))
        total, tokens = np.zeros(len(self.langs)), 0
        if known:
            at, n = np.array(known).T
            total += n @ self.word_logs[at]
            tokens += int(n.sum())
        places: dict[int, list[int]] = {k: [] for k in self.grams}
        weights: dict[int, list[float]] = {k: [] for k in self.grams}
        for word, n in unseen:
            for size in range(LONGEST_GRAM, 0, -1):
                table = self.grams[size][0]
                found = [p for p in map(table.get, grams_of(word, size)) if p is not None]
                if found:
                    places[size] += found
                    weights[size] += [n / len(found)] * len(found)
                    tokens += n
                    break
        for size, at in places.items():
            if at:
                total += np.array(weights[size]) @ self.grams[size][1][at]
        best = int(np.argmax(total))
        mean = total / max(tokens, 1)
        return self.langs[best], float(1 / np.exp(mean - mean[best]).sum())


def count_words(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows of ``labelled`` (text, lang); combined in the task before the shuffle."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                seen.setdefault(lang, Counter()).update(words_of(text))
            for lang, counts in seen.items():
                yield pa.record_batch([
                    pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()),
                    pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    rows = labelled.select("text", "lang").mapInArrow(count, "lang string, word binary, n bigint")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame) -> DataFrame:
    """(size, gram, lang, n) of all words, each as often as its word."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            seen: dict[tuple, int] = {}
            for lang, word, n in zip(*(batch[c].to_pylist() for c in ("lang", "word", "n"))):
                for size in range(1, LONGEST_GRAM + 1):
                    for gram in grams_of(word, size):
                        key = (size, gram, lang)
                        seen[key] = seen.get(key, 0) + n
            yield pa.record_batch([
                pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.string()),
                pa.array([k[2] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                names=["size", "gram", "lang", "n"])

    rows = words.select("lang", "word", "n").mapInArrow(count, "size int, gram string, lang string, n bigint")
    return rows.groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, groups: list[str], limit: int) -> DataFrame:
    """Rows of the highest counts of each group, at most ``limit``; rows that tie at the bound are out.

    Only the distribution of counts is gathered, never the rows themselves,
    and no group is sorted in one task.
    """
    shape = counts.groupBy(*groups, "n").count().groupBy(*groups).agg(
        F.sort_array(F.collect_list(F.struct("n", "count")), asc=False).alias("steps"))
    # running number of rows at or above each count; the last count still within the limit
    least = F.aggregate(
        "steps", F.struct(F.lit(0).cast("long").alias("rows"), F.lit(None).cast("long").alias("least")),
        lambda a, s: F.struct(
            (a["rows"] + s["count"]).alias("rows"),
            F.when(a["rows"] + s["count"] <= limit, s["n"]).otherwise(a["least"]).alias("least")),
        lambda a: a["least"])
    return counts.join(shape.select(*groups, least.alias("least")), groups).where("n >= least").drop("least")


def fit(labelled: DataFrame) -> Model:
    """Learn from all rows of ``labelled`` (text, lang), both not null."""
    python_ready(labelled.sparkSession)
    words = materialize(count_words(labelled), "words")
    grams = materialize(count_grams(words), "grams")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    share = max(1, len(langs))
    top = everywhere(words, most_frequent(words, ["lang"], WORDS // share), ["word"])
    some = everywhere(grams, most_frequent(grams, ["size", "lang"], GRAMS // share), ["size", "gram"])
    return Model(langs, _tuples(top.select("word", "lang", "n")), _tuples(some.select("size", "gram", "lang", "n")),
                 sums_of(words.select(F.lit(0).alias("size"), F.col("word").alias("key"), "lang", "n"))
                 | sums_of(grams.select("size", F.col("gram").alias("key"), "lang", "n")))


def everywhere(counts: DataFrame, kept: DataFrame, key: list[str]) -> DataFrame:
    """The counts of every key that any language keeps, in all languages."""
    return counts.join(kept.select(*key).distinct(), key, "left_semi")


def sums_of(counts: DataFrame) -> dict[int, tuple[int, dict]]:
    """For each size: the number of different keys, and each language's sum, of all (size, key, lang, n)."""
    types = {r["size"]: r["count"] for r in counts.select("size", "key").distinct().groupBy("size").count().collect()}
    totals: dict[int, dict] = {size: {} for size in types}
    for r in counts.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect():
        totals[r["size"]][r["lang"]] = r["n"]
    return {size: (types[size], totals[size]) for size in types}


def _tuples(rows: DataFrame) -> list[tuple]:
    table = rows.toArrow()  # columns are smaller on the driver than rows
    return list(zip(*(c.to_pylist() for c in table.columns)))


def _told(docs: DataFrame, model: Model, names: list[str], text_col: str) -> DataFrame:
    """(row: the named columns, lang_pred, score)."""
    spark = docs.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = packed.schema["row"].dataType.simpleString()

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            told = [shared.value.predict(t.as_py()) for t in batch["text"]]
            yield pa.record_batch([
                batch["row"], pa.array([x for x, _ in told], pa.string()), pa.array([s for _, s in told], pa.float64())],
                names=["row", "lang_pred", "score"])

    return packed.mapInArrow(predict, f"row {kind}, lang_pred string, score double")


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (replacing columns of these names).

    Null texts and texts without a letter are ``und`` with score 0, and so is
    everything when nothing was learned.  Ties go to the first language by
    name.  Repeated rows get equal answers; no rows give no rows.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return _told(docs, model, names, text_col).select("row.*", "lang_pred", "score")


def identified(docs: DataFrame, model: Model, least_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns untouched, whose text is in one of the model's languages."""
    told = _told(docs, model, docs.columns, text_col)
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows to learn from: labelled, not held out."""
    return docs.where(crc_remainder(id_col, 3) != 1).where("text is not null and lang is not null").select("text", "lang")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", "text", (crc_remainder("doc_id", 3) == 1).alias("held_out"))
    told = identify(rows, fit(learnable(docs)))
    return told.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
