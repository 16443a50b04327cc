"""Decontamination, BPE, token files, language ID."""

import base64
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import awkward, benchmark_hits, odd_texts, words_like

import public_tokenizers
from foreslate.llm import bpe, decontaminate, language_id, token_files

SMALL = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_decontamination_sql(spark, con):
    from compare import normal

    df = decontaminate.op1_decontamination(spark, SMALL)
    found = con.execute(decontaminate.ORACLE_SQL["op1_decontamination"])
    assert normal(df.collect(), df.columns) == normal(found.fetchall(), [d[0] for d in found.description])


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_decontamination_by_hand(spark, block_bytes):
    rng = random.Random(2)
    items = [(i, " ".join(words_like(rng, n, 6))) for i, n in enumerate((12, 25, 3, 1, 10))]
    items += [(1, None), (7, " !?"), (None, "null id item here"), (10, items[0][1].upper())]
    texts = odd_texts() + [" ".join(words_like(rng, 80, 7)) for _ in range(25)]
    texts += [f"Före {items[1][1].replace(' ', ', ')}! nach", "Null ID item: here"]
    docs = awkward(spark, texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = benchmark_hits(dict(enumerate(texts)), items)
    told = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, bench, block_bytes=block_bytes).collect()}
    assert told == want
    kept = decontaminate.decontaminate(docs, bench, "documents", block_bytes=block_bytes)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[1]}
    clean = decontaminate.decontaminate(docs, bench, "spans", block_bytes=block_bytes).collect()
    assert len(clean) == len(texts)
    for r in clean:
        if not want[r.doc_id][1]:
            assert r.text == texts[r.doc_id]
    assert [r.text for r in clean if r.doc_id == len(texts) - 2] == ["Före ! nach"]


def test_decontamination_of_nothing(spark):
    docs, bench = awkward(spark, ["a b", None]), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0
    assert [r.n_hit for r in decontaminate.contamination(docs, bench.where("false")).collect()] == [0, 0]
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, "words")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_against_library(codec, library, spark):
    rng = random.Random(3)
    letters = list("aabcdefThe  \n\n\t.,'12é中😀́²½\x1c\x85\xa0  |_-sdrtl<>")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["ab" * 4000, " " * 3000, "é" * 2500, "<|endoftext|>", "don't we'll\n\n\n  x ", " \n", "\n ", "a \n b"]
    texts += [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    for text in texts:
        ids = codec.encode(text).tolist()
        assert ids == library.encode_ordinary(text), text[:80]
        assert "".join(codec.decode(ids)) == text


def test_transducer_forgets_and_goes_on(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 20)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 10)
    monkeypatch.setattr(bpe, "LOOKAHEAD", 130)
    own = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN, held_bytes=2000)
    rng = random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice("thnerinogab") for _ in range(400)) + " of the"
        assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_utf8_machine():
    rng = random.Random(1)
    pool = [0x41, 0xC3, 0xA9, 0xE0, 0x80, 0xA0, 0xED, 0x9F, 0xBF, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xE4, 0xB8, 0xAD, 0xC0]
    for _ in range(4000):
        data = bytes(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        stream, cut = bpe.Utf8Stream(), rng.randint(0, len(data))
        assert stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.finish() == data.decode("utf-8", "replace")


def test_bpe_tables(spark, library):
    texts = odd_texts()
    docs = awkward(spark, texts)
    coded = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_documents(coded, RANKS, public_tokenizers.PATTERN)
    rows = back.collect()
    assert len(rows) == len(texts) and set(docs.columns) <= set(back.columns)
    for r in rows:
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id] or "") and r.decoded == (texts[r.doc_id] or "")
    assert bpe.encode_documents(docs.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "FILE_IDS", 700)
    told = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    library = Tokenizer.from_str(told)
    texts = odd_texts() + ["a<|endoftext|>b c", "x <|endoftext|>", "caf\u00e9, na\u00efve### \u0130x can't. A's", "\u00b2x \u2167."] + ["<|endoftext|> a  b \n c", "x\0y z"] + [f"doc {i} " * (i % 40) for i in range(120)]
    docs = awkward(spark, texts).unionByName(awkward(spark, texts[7:8], 7))
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(docs, told, path)
    rows = sorted(token_files.read_token_files(spark, path).collect())
    start, want = 0, []
    for i, text in sorted([*enumerate(texts), (7, texts[7])], key=lambda x: x[0]):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in rows] == sorted(want)
    files = [f for f in (tmp_path / "files").iterdir() if f.name.startswith("part-") and f.stat().st_size]
    assert len(files) > 5
    for name in files:
        with pa.memory_map(str(name)) as source:  # random access without a copy
            file = token_files.SequenceFile(source)
            assert len(file.ids(len(file) - 1)) == len(file.mask(len(file) - 1)) == token_files.LENGTH
            assert not file.ids(0).flags.owndata
            assert sum(int(file.mask(i).sum()) for i in range(len(file))) == sum(len(x) for _, _, x in file.documents())
    empty = f"file://{tmp_path}/none"
    token_files.write_token_files(docs.where("false"), told, empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    told = language_id.op7_language_id(spark, folder).join(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(told) == 1000 and all(0 <= r.score <= 1 for r in told)
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in told} == {True}
    held = [r for r in told if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_language_of_odd_rows(spark):
    learn = awkward(spark, ["the cat and the dog sat", "der hund und die katze", "the end of the day", "und das ende der welt"] * 3)
    model = language_id.fit(language_id.learnable(learn))
    odd = [None, "", "123 !?", "der hund", "the dog", "日本語", "²½"]
    told = {r.doc_id: r for r in language_id.identify(awkward(spark, odd), model).collect()}
    assert [told[i].lang_pred for i in range(7)] == ["und", "und", "und", "de", "en", told[5].lang_pred, "und"]
    assert told[5].lang_pred in model.langs and told[0].score == 0
    kept = language_id.identified(awkward(spark, odd), model)
    assert {3, 4} <= {r.doc_id for r in kept.collect()} <= {3, 4, 5} and kept.columns == awkward(spark, odd).columns
    nothing = language_id.fit(language_id.learnable(learn.where("false")))
    assert {r.lang_pred for r in language_id.identify(learn, nothing).collect()} == {"und"}
    assert language_id.identify(learn.where("false"), model).count() == 0


def test_most_frequent_words_are_bounded(spark):
    counts = spark.createDataFrame([("en", w, n) for w, n in zip("abcdef", (9, 7, 7, 3, 1, 1))], "lang string, word string, n bigint")
    top = lambda k: sorted(r.word for r in language_id.most_frequent(counts, ["lang"], k).collect())
    assert top(3) == ["a", "b", "c"] and top(2) == ["a"] and top(6) == list("abcdef")
