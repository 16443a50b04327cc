"""Suffix dedup, Jaccard join, recurrent model, and the pipeline, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import awkward, benchmark_hits, odd_texts, repeats, similar, words_like

import corpus_pipeline
from foreslate.llm import blocks, jaccard_join, recurrent_lm, suffix_dedup
from foreslate.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"


def check_repeats(told, rows):
    want = repeats(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in told} == want
    assert all(r.kept_sha256 == hashlib.sha256(want[r.doc_id][3]).hexdigest() for r in told)


def test_suffix_dedup_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_repeats(suffix_dedup.suffix_dedup(docs.repartition(4)).collect(), [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("letters", ["ab", "a", "abcdefghij"])
def test_suffix_dedup_of_few_letters(spark, letters, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 900)
    rng = random.Random(letters)
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(n) for n in (50, 49, 120, 300)]
    texts = odd_texts() + [make(rng.randrange(200)) + rng.choice(shared) + make(rng.randrange(90)) for _ in range(40)]
    texts += [shared[2], shared[2] * 3, shared[3][40:], "é" * 60, "é" * 60]
    docs = awkward(spark, texts).repartition(3)
    check_repeats(suffix_dedup.suffix_dedup(docs).collect(), list(enumerate(texts)))


def test_sampling_in_stretches(monkeypatch):
    import zstandard

    rng = random.Random(8)
    texts = ["".join(rng.choice("abc") for _ in range(n)).encode() for n in (700, 10, 50, 0, 333)]
    packed = zstandard.ZstdCompressor().compress(b"".join(texts))

    def places() -> set:
        block = suffix_dedup.Block(list(range(len(texts))), [len(t) for t in texts], packed)
        block.sample()
        return {(s, int(a), int(h)) for h, a, f, last in zip(block.hash, block.at, block.first, block.last) for s in range(f, last + 1)}

    whole = places()
    assert len(whole) == sum(max(0, len(t) - 49) for t in texts)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 61)
    assert places() == whole


def test_suffix_dedup_of_odd_ids(spark):
    text = "once more " * 8
    docs = spark.createDataFrame([(2, text), (2, text), (None, text), (5, text), (7, None)], "doc_id bigint, text string")
    told = sorted(suffix_dedup.suffix_dedup(docs).collect(), key=str)
    assert sorted((str(r.doc_id), r.n_removed) for r in told) == [("2", 0), ("2", 0), ("5", 80), ("7", 0), ("None", 80)]
    assert suffix_dedup.suffix_dedup(docs.where("false")).count() == 0


@pytest.mark.parametrize("measure, rows", [((3, 90, 100), 768), ((5, 80, 100), 768), ((3, 90, 100), 5), ((2, 60, 100), 4)])
def test_jaccard_against_all_pairs(spark, measure, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", rows)
    monkeypatch.setattr(jaccard_join, "DENSE", 4)
    rng = random.Random(9)
    texts = odd_texts()
    for size in (8, 10, 11, 30, 100):
        base = words_like(rng, size, 400)
        for _ in range(9):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(size)] = f"e{rng.randrange(99)}"
            texts.append(" ".join(own + words_like(rng, rng.randrange(2))))
    want = similar(dict(enumerate(texts)), *measure)
    told = jaccard_join.jaccard_components(awkward(spark, texts), jaccard_join.Measure(*measure)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in told} == want
    assert any(links > 1 for _, _, links in want.values())


def test_jaccard_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (9, "A  B\nc d"), (3, None), (2, " ")], "doc_id bigint, text string")
    told = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(docs).collect())
    assert told == [("2", 0, 2, 0), ("3", 0, 3, 0), ("4", 2, 4, 2), ("4", 2, 4, 2), ("9", 2, 4, 2), ("None", 2, None, 0)]
    assert jaccard_join.jaccard_components(docs.where("false")).count() == 0
    kept = jaccard_join.without_near_copies(docs, jaccard_join.Measure())
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "4", "None"]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (201, 200), (202, 201), (203, 200)]
    told = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert told == {**{i: 0 for i in range(61)}, **{i: 200 for i in range(200, 204)}}


@pytest.fixture()
def small_model():
    rng = np.random.default_rng(0)
    known = recurrent_lm.Vocabulary(np.arange(40).astype(np.uint64), np.sort(rng.integers(5, 500, 40))[::-1], 12000, 60)
    texts = [np.append(rng.integers(1, len(known), n), 0).astype(np.int16) for n in (9, 40, 0, 7, 12)]
    return recurrent_lm.Model(known, np.float64, 4), texts


def test_gradients(small_model, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "LANES", 3)
    model, texts = small_model
    rng = np.random.default_rng(1)
    x, y, valid, _, h, _ = next(recurrent_lm.windows(texts, 4, np.float64))
    h = rng.normal(size=h.shape)
    _, grads, _ = model.gradients(x, y, valid, h)
    for name, w in model.weights.items():
        for _ in range(10):
            i = tuple(rng.integers(0, s) for s in w.shape)
            old, step = w[i], 1e-5
            w[i] = old + step
            up = model.gradients(x, y, valid, h)[0]
            w[i] = old - step
            down = model.gradients(x, y, valid, h)[0]
            w[i] = old
            assert (up - down) / (2 * step) == pytest.approx(grads[name][i], rel=1e-4, abs=1e-6)


def test_scores_are_of_whole_texts(small_model, monkeypatch):
    model, texts = small_model
    alone = [model.score([t])[0] for t in texts]
    for lanes, window in ((2, 5), (5, 32), (1, 3)):
        monkeypatch.setattr(recurrent_lm, "LANES", lanes)
        monkeypatch.setattr(recurrent_lm, "WINDOW", window)
        assert model.score(texts) == pytest.approx(alone)


def test_class_factored_softmax_sums_to_one(small_model):
    model, _ = small_model
    n = len(model.class_of)
    logs, _ = model._outputs(np.tile(np.random.default_rng(2).normal(size=4), (n, 1)), np.arange(n), None)
    assert np.exp(logs).sum() == pytest.approx(1)


def test_base_scores_and_gain(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = awkward(spark, odd_texts() + ["x" * 200, " ".join(map(str, range(3000)))], 100_000).select("doc_id", "text")
    told = {r.doc_id: r for r in recurrent_lm.score_documents(docs.unionByName(odd)).collect()}
    rows = [(r.doc_id, [*(r.text or "").encode().lower().split(), None]) for r in docs.unionByName(odd).collect()]
    count = Counter(w for i, own in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in own)
    total, types = sum(count.values()), len(count)
    for i, own in rows:
        r = told[i]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (types + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
    held = [told[i] for i, _ in rows if told[i].held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert recurrent_lm.score_documents(docs.where("false")).count() == 0


def test_pipeline_against_brute_force(spark):
    import tiktoken

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = awkward(spark, odd_texts() + ["12 34"], 100_000).select(docs.columns)
    steps = {}
    given = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = stage(spark, given, SMALL)
        assert given.columns == docs.columns
        rows = given.collect()
        steps[name] = {r.doc_id: r.text for r in rows}
        given = spark.createDataFrame(rows, docs.schema)
    texts = {r.doc_id: r.text for r in docs.unionByName(odd).collect()}
    told = steps["language_id"]
    assert set(texts) - set(told) <= set(range(100_000, 200_000)) and not {100_000, 100_001, 100_019} & set(told)
    first = {}
    for i in sorted(told):
        first.setdefault(" ".join(told[i].replace("\n", " ").replace("\t", " ").split(" ")), i)
    assert {i for i in steps["exact_dedup"] if i < 100_000} <= set(first.values())
    of = similar(steps["exact_dedup"], 5, 80, 100)
    assert set(steps["jaccard_join"]) == {i for i, (_, c, _) in of.items() if c == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hits = benchmark_hits(steps["jaccard_join"], items)
    assert set(steps["decontamination"]) == {i for i, h in hits.items() if not h[1]}
    ranks = corpus_pipeline.bpe.read_ranks(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = corpus_pipeline.STAGES[-1][1](spark, given, SMALL).collect()
    assert {r.doc_id: r.n_tokens for r in last} == {i: len(library.encode_ordinary(t)) for i, t in steps["decontamination"].items()}
    assert all(r.decoded_sha256 == hashlib.sha256(steps["decontamination"][r.doc_id].encode()).hexdigest() for r in last)
