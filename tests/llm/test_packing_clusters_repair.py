"""Pattern packing, Orchard clusters and conversation repair on small hard tables."""

import hashlib
import itertools
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import normal

from foreslate.llm import conversation_repair as R, orchard_clusters as O, pattern_packing as P
from foreslate.llm.word_encoder import WordEncoder


@pytest.fixture(scope="module")
def words_json():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def sql_rows(sql, folder, *tables):
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    result = con.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


# --- packing ---------------------------------------------------------------

TEXTS = ["The cat. The CAT!", "", None, "don't we'll 's '' x_y a@b <|endoftext|> c", "é é Σσς İx \x1f\x01 ñandú###", " \n\t ",
         "word " * 3000, "w0rd 12 34.5 … “quoted” 中文 字", "a", "a", "<|startoftext|>", "́x ﬁ Ⅷ ²"]


def test_words_are_encoded_as_by_the_library(words_json):
    own = WordEncoder(words_json, held_bytes=2000)  # turns over all the time
    for _ in range(2):
        ids, starts = own.encode(pa.array(TEXTS, pa.string()))
        for text, a, b in zip(TEXTS, starts, starts[1:]):
            assert ids[a:b].tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids, text
    assert own.encode(pa.array([], pa.string()))[0].tolist() == []


def placed(histogram, length, **kw):
    """Contents of each sequence by a plan, after checking that every piece is placed once and without gaps."""
    sequences, ranks = defaultdict(list), defaultdict(list)
    for size, rank, n, sequence, each, offset in P.plan_packing(histogram, length, **kw):
        ranks[size] += range(rank, rank + n)
        for i in range(n):
            sequences[sequence + i // each].append((offset + i % each * size, size))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in histogram.items() if n}
    for own in sequences.values():
        ends = list(itertools.accumulate((s for _, s in sorted(own)), initial=0))
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= length
    return sequences


def best_fit(histogram, length):
    rooms = []
    for size in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else length) - size)
    return len(rooms)


def test_plans_place_everything_and_stay_near_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(40):
        length = int(rng.integers(1, 80))
        histogram = {int(s): int(rng.integers(0, 40)) for s in rng.integers(1, length + 1, rng.integers(0, 20))}
        used, other = len(placed(histogram, length)), best_fit(histogram, length)
        assert used <= 1.06 * other + 2
    assert placed({}, 10) == {}


def test_plans_do_not_grow_with_the_number_of_pieces():
    rng = np.random.default_rng(1)
    small = {int(s): 10 for s in rng.integers(1, 2049, 1500)}
    large = {s: n * 10_000_000 for s, n in small.items()}
    plan = P.plan_packing(large)
    assert len(plan) < 12_000 and sum(r[2] for r in plan) == sum(large.values())
    total = sum(s * n for s, n in large.items())
    assert max(r[3] + -(-r[2] // r[4]) for r in plan) <= 1.02 * math.ceil(total / 2048)


def test_least_squares_meets_its_conditions():
    rng = np.random.default_rng(2)
    a, b = rng.random((12, 30)), rng.random(12) * 10 - 2
    x = P.non_negative_least_squares(a, b)
    gradient = a.T @ (b - a @ x)
    assert (x >= 0).all() and (gradient <= 1e-6).all() and abs(gradient[x > 0]).max(initial=0) < 1e-6


def test_documents_are_packed_gapless(spark, words_json):
    rows = [(i if i < 11 else None, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, `offset` int").repartition(3)
    library = WordEncoder(words_json).tokenizer
    length = 64
    out = P.pack_documents(docs, words_json, length, keep_ids=True)
    found = out.collect()
    want = defaultdict(int)
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), length)):
            part = np.array(ids[at:at + length], "<u4").tobytes()
            want[(i, k, at, len(part) // 4, zlib.crc32(part))] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in found:
        got[(r.id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        sequences[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    assert got == want
    for own in sequences.values():
        at = 0
        for offset, size, _ in sorted(own):
            assert offset == at
            at += size
        assert at <= length
    whole = {r.sequence_id: bytes(r.ids) for r in P.assemble(out.select("sequence_id", "offset", "ids")).collect()}
    assert set(whole) == set(sequences) and all(
        whole[s] == b"".join(b for *_, b in sorted(own)) for s, own in sequences.items())
    assert P.pack_documents(docs.limit(0), words_json, length).collect() == []


# --- clusters --------------------------------------------------------------

def plain_clusters(rows, k, rounds, scale):
    """Every distance, Python's integers: {row: (cluster, distance)} and the centroids."""
    keep = [(i, [math.floor(x * scale) for x in v]) for i, v in rows]
    first = sorted(keep, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in keep:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n])] if own[n] else c for n, c in enumerate(centroids)]
    return sorted(((i if i is not None else -1, near(v)[1], near(v)[0]) for i, v in keep)), centroids


@pytest.mark.parametrize("large", [1.0, 3e5, 1e30])
def test_clusters_are_those_of_all_distances(spark, large):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.choice([-1, 0, .25, .5, 1]) * rng.choice([1, large]))) for _ in range(3)]) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[0][1])] + [(200 + i, [.5, .5, .5]) for i in range(80)]
    bad = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 0.0]),
           (904, [float("inf"), 0.0, 0.0]), (905, [])]
    table = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<float>, cluster string")
    found, centroids = O.cluster_vectors(table.repartition(5), k=6, rounds=4, dimensions=3)
    want, other = plain_clusters(rows, 6, 4, O.SCALE)
    assert [list(c) for c in centroids] == other
    got = sorted((r.id if r.id is not None else -1, r.cluster, r.distance) for r in found.collect())
    assert got == sorted((i, c, d if d <= O.LARGEST else None) for i, c, d in want)


def test_orchard_leaves_distances_out():
    rng = np.random.default_rng(5)
    groups = rng.integers(-1000, 1000, (40, 16))
    own = np.repeat(groups, 50, axis=0) + rng.integers(-9, 9, (2000, 16))
    search = O.Orchard([tuple(g) for g in groups.tolist()])
    cluster, distance, computed = search.nearest(own)
    every = ((own[:, None, :] - groups[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert computed < 0.75 * every.size


def test_few_or_no_vectors(spark):
    table = spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64)], "vec_id long, embedding array<float>")
    assert sorted((r.id, r.cluster, r.distance) for r in O.cluster_vectors(table)[0].collect()) == [(1, 0, 0), (2, 0, 0)]
    assert O.cluster_vectors(table.limit(0))[0].collect() == []


def test_cluster_query_on_hard_rows_equals_sql(spark, tmp_path):
    rng = np.random.default_rng(6)
    vectors = [rng.normal(size=64).astype("float32").tolist() for _ in range(60)] + [[0.25] * 64] * 40
    vectors += [None, [1.0] * 63, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("-inf")] * 64]
    ids = [None, *range(1, len(vectors))]
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}),
                   tmp_path / "embeddings.parquet")
    df = O.op11_orchard_clusters(spark, str(tmp_path))
    names, rows = sql_rows(O.ORACLE_SQL["op11_orchard_clusters"], tmp_path, "embeddings")
    assert normal(df.collect(), df.columns) == normal(rows, names)


# --- repair ----------------------------------------------------------------

def enumerate_repairs(symbols):
    """The least (cost, audit) of all edits of a few rows, by trying all."""
    best, n = None, len(symbols)

    def fits(said):
        said = said[1:] if said[:1] == "s" else said
        return said == "ua" * (len(said) // 2)

    def go(i, cost, audit, said, inserted):
        nonlocal best
        whole = "".join(said)
        if not (fits(whole) or fits(whole + "a") or (whole == "s")):
            return
        if i == n and fits(whole) and whole != "s" and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if inserted < 3:
            for r in "ua":
                go(i, cost + 3, audit + "I", said + [r], inserted + 1)
        if i == n:
            return
        symbol, copies = symbols[i]
        rest = "D" * (copies - 1)
        go(i + 1, cost + 4 * copies, audit + "D" + rest, said, 0)
        if symbol != "x":
            extra = 4 * (copies - 1) + (3 if symbol.isupper() else 0)
            go(i + 1, cost + extra, audit + "K" + rest, said + [symbol.lower()], 0)
            for r in "ua":
                go(i + 1, cost + 3 + extra, audit + "R" + rest, said + [r], 0)

    go(0, 0, "", [], 0)
    return best


def test_items_are_the_lightest_of_all_edits():
    rng = random.Random(7)
    for _ in range(120):
        rows = tuple((rng.choice("suaoxSUAO"), rng.choice((1, 1, 2))) for _ in range(rng.randint(0, 4)))
        items = R.block_items(rows)
        cost, audit = R.prepend(items, {g: (0, None) for g in R.GOALS})[R.START]
        assert (cost, R.flat(audit)) == enumerate_repairs(rows), rows


def test_blocks_combine_to_the_whole():
    rng = random.Random(8)
    for _ in range(40):
        rows = tuple((rng.choice("suaoxSUAO"), 1) for _ in range(rng.randint(2, 40)))
        goals = {g: (0, None) for g in R.GOALS}
        ways, cut = goals, sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(4))})
        for a, b in reversed(list(zip(cut, cut[1:]))):
            ways = R.prepend(R.block_items(rows[a:b]), ways)
        whole = R.prepend(R.block_items(rows), goals)
        assert {p: (c, R.flat(a)) for p, (c, a) in ways.items()} == {p: (c, R.flat(a)) for p, (c, a) in whole.items()}


def test_repairs_of_hard_conversations_equal_sql(spark, tmp_path):
    rng = random.Random(9)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "no", "", " \t", None, "Sure!\x0b", "é?\x85", "why?"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(50, t, rng.choice(roles[:2]), f"{t}.") for t in range(400)]          # many blocks
    rows += [(51, None, "user", "ok.")] * 200 + [(51, 3, "assistant", "ok.")] * 90  # one repeated row
    rows += [(52, None, rng.choice(roles), rng.choice(texts)) for _ in range(150)]  # null turns
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in (1, 2, 2, 5, None)]
    rows += [(53, t, None, None) for t in range(3)] + [(54, 10 * t, "user", "a" * 70_000 + ".") for t in range(3)]
    rng.shuffle(rows)
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
    table = pa.table([*columns, pa.array(["x"] * len(rows))], names=["conv_id", "turn", "role", "text", "audit"])
    pq.write_table(table, tmp_path / "conversations.parquet")
    df = R.op12_conversation_repair(spark, str(tmp_path))
    names, want = sql_rows(R.ORACLE_SQL["op12_conversation_repair"], tmp_path, "conversations")
    assert normal(df.collect(), df.columns) == normal(want, names)


def test_repaired_rows_and_no_conversations(spark):
    table = spark.createDataFrame(
        [(1, 0, "user", "Hi."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Well."), (2, 0, "user", " ")],
        "conv_id long, turn long, role string, text string")
    facts, rows = R.repair_conversations(R.turns(table), table)
    assert {r.conv_id: (r.cost, r.audit) for r in facts.collect()} == {1: (3, "KIKK"), 2: (4, "D")}
    found = sorted((r.conv_id, r.place, r.edit, r.role, r.text) for r in rows.collect())
    assert found == [(1, 0, "K", "user", "Hi."), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "Hello?"),
                     (1, 3, "K", "assistant", "Well."), (2, -1, None, None, None)]
    facts, rows = R.repair_conversations(R.turns(table.limit(0)), table.limit(0))
    assert facts.collect() == [] and rows.collect() == []
