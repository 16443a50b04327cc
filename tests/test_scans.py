"""Prior-only windows against plain loops and pandas, and their leakage guarantees."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foreslate.operators import scans as SC


def rows(n=120, entities=3, nulls=0.2, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        # entity 0 owns two thirds of the rows
        e = 0 if rng.random() < 0.66 else rng.randrange(1, entities)
        x = None if rng.random() < nulls else rng.uniform(-5, 5)
        out.append((e, 2000 + i * 3 // n, i % 20 + 1, i, x))
    return sorted(out, key=lambda r: (r[1], r[2], r[3]))


def frame(spark, data):
    return spark.createDataFrame(data, "e long, season int, week int, id long, x double")


def scan(df, rule, restart=False, parts=7):
    return SC.decayed_scan(df, entity=["e"], restart=["season"] if restart else [], order=["season", "week", "id"],
                           values={"x": rule}, parts=parts)


def loop(data, alpha, reset):
    state, final, season, out = {}, {}, {}, {}
    for e, s, w, i, x in data:
        if reset and season.get(e) != s:
            if e in season:
                final[e] = state.get(("all", e))
            season[e] = s
            state.pop(e, None)
        out[i] = (state.get(e), final.get(e))
        if x is not None:
            for k in (e, ("all", e)):
                v = state.get(k)
                state[k] = x if v is None else v + alpha * (x - v)
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_average_matches_loop_with_restart_over_any_partitions(spark, parts):
    data = rows(n=300, nulls=0.5, seed=parts)
    got = {r["id"]: (r["x__s"], r["x__e"]) for r in scan(frame(spark, data), SC.ewma(0.3), True, parts).collect()}
    for i, (now, prior) in loop(data, 0.3, True).items():
        for a, b in zip(got[i], (now, prior)):
            assert (a is None) == (b is None)
            assert a is None or a == pytest.approx(b, abs=1e-9)


def test_continuous_average_and_counts(spark):
    data = rows(seed=3)
    got = {r["id"]: r for r in scan(frame(spark, data), SC.ewma(0.25)).collect()}
    for i, (now, _) in loop(data, 0.25, False).items():
        assert got[i]["x__s"] == (None if now is None else pytest.approx(now, abs=1e-9))
    seen = {}
    for e, s, w, i, x in data:
        assert got[i]["x__n"] == seen.get(e, 0)
        seen[e] = seen.get(e, 0) + (x is not None)


def test_long_history_does_not_overflow(spark):
    data = [(1, 2000, 1, i, float(i % 7)) for i in range(5000)]
    got = {r["id"]: r["x__s"] for r in scan(frame(spark, data), SC.ewma(0.35)).collect()}
    state = None
    for _, _, _, i, x in data:
        assert got[i] == (None if state is None else pytest.approx(state, abs=1e-9))
        state = x if state is None else state + 0.35 * (x - state)


def test_bias_corrected_mean_matches_pandas(spark):
    data = rows(nulls=0.0, seed=5)
    df = scan(frame(spark, data), SC.decayed_sum(0.35)).withColumn("m", SC.bias_corrected_mean("x", 0.35))
    got = {r["id"]: r["m"] for r in df.collect()}
    pdf = pd.DataFrame(data, columns=["e", "season", "week", "id", "x"])
    want = pdf.groupby("e")["x"].transform(lambda s: s.shift(1).ewm(alpha=0.35, min_periods=1).mean())
    for i, w in zip(pdf["id"], want):
        assert got[i] == (None if pd.isna(w) else pytest.approx(w, abs=1e-9))


def test_erasing_the_future_changes_no_earlier_state(spark):
    data = rows(seed=7)
    cut = (2001, 10)
    erased = [(e, s, w, i, x if (s, w) < cut else None) for e, s, w, i, x in data]
    a = {r["id"]: r["x__s"] for r in scan(frame(spark, data), SC.ewma(0.3), True).collect()}
    b = {r["id"]: r["x__s"] for r in scan(frame(spark, erased), SC.ewma(0.3), True).collect()}
    for e, s, w, i, x in data:
        if (s, w) < cut:
            assert a[i] == b[i]


def test_asof_matches_pandas(spark):
    rng = random.Random(11)
    left = [(rng.randrange(3), rng.randrange(199901, 200230), i) for i in range(80)]
    right = sorted({(rng.randrange(3), rng.randrange(199901, 200230)) for _ in range(60)})
    right = [(k, t, float(n)) for n, (k, t) in enumerate(right)]
    got = SC.asof_backward(
        spark.createDataFrame(left, "k long, t long, id long"),
        spark.createDataFrame(right, "k long, t long, v double"), key=["k"], clock="t", values=["v"])
    got = {r["id"]: r["v"] for r in got.collect()}
    want = pd.merge_asof(
        pd.DataFrame(left, columns=["k", "t", "id"]).sort_values("t"),
        pd.DataFrame(right, columns=["k", "t", "v"]).sort_values("t"),
        on="t", by="k", allow_exact_matches=False)
    for i, v in zip(want["id"], want["v"]):
        assert got[i] == (None if pd.isna(v) else v)


def test_baseline_uses_earlier_seasons_only(spark):
    df = spark.createDataFrame(
        [(2000, 1.0, None), (2000, 3.0, None), (2001, 10.0, 5.0), (2002, 0.0, 7.0)],
        "season int, a double, b double")
    got = {r["season"]: (r["a"], r["b"]) for r in SC.prior_baseline(df, ["a", "b"]).collect()}
    assert got == {2000: (2.0, None), 2001: (2.0, 5.0), 2002: (pytest.approx(14 / 3), 5.0)}


def test_all_rules_together_with_null_keys_over_small_batches(spark):
    """One entity and null entities spread over many partitions and batches; every rule against plain loops."""
    rng = random.Random(17)
    data = [(rng.choice([None, 1, 1, 1, 2]), i // 150, i, *[None if rng.random() < 0.6 else rng.uniform(-3, 3) for _ in range(3)])
            for i in range(600)]
    rules = {"a": SC.ewma(0.2), "b": SC.decayed_sum(0.35), "c": SC.running_sum()}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(data, "e long, s int, o int, a double, b double, c double")
        found = SC.decayed_scan(df, entity=["e"], restart=["s"], order=["o"], values=rules, parts=19)
        assert found.count() == len(data)
        got = {r["o"]: r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for k, (v, rule) in enumerate(rules.items()):
        empty = None if rule.seeded else 0.0
        state = {}
        for e, s, o, *x in data:
            own = state.setdefault(e, {"s": s, "now": empty, "n": 0, "whole": empty, "entered": empty})
            if own["s"] != s:
                own.update(s=s, entered=own["whole"], now=empty, n=0)
            for name, want in (("s", own["now"]), ("n", own["n"]), ("e", own["entered"])):
                told = got[o][f"{v}__{name}"]
                assert (told is None) == (want is None) and (want is None or told == pytest.approx(want, abs=1e-9)), (v, o, name)
            if x[k] is not None:
                for name in ("now", "whole"):
                    own[name] = x[k] if own[name] is None else rule.decay * own[name] + rule.gain * x[k]
                own["n"] += 1


def test_rows_of_a_scan_cross_one_exchange_and_one_key_spreads(spark, monkeypatch):
    seen, stored = [], []
    keep = SC.materialize

    def watched(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        stored.append(keep(df, name))
        return stored[-1]

    monkeypatch.setattr(SC, "materialize", watched)
    df = spark.range(4000).selectExpr("0 AS e", "id AS o", "CAST(id AS DOUBLE) AS v", "id * 2 AS extra")
    SC.decayed_scan(df, entity=["e"], order=["o", "extra"], values={"v": SC.ewma(0.3)}, parts=8)
    assert seen[0].count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in seen[0]
    sizes = [r["count"] for r in stored[0].where("__told IS NULL").groupBy("__part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


def test_empty_scan_and_join(spark):
    df = spark.createDataFrame([], "e long, o int, v double")
    assert SC.decayed_scan(df, entity=["e"], order=["o"], values={"v": SC.ewma(0.3)}).collect() == []
    left = spark.createDataFrame([(1, 2)], "e long, o int")
    assert SC.asof_backward(left, df, key=["e"], clock="o", values=["v"]).collect() == [(1, 2, None)]
    assert SC.asof_backward(left.limit(0), df, key=["e"], clock="o", values=["v"]).collect() == []


@pytest.mark.parametrize("parts", [1, 9])
def test_asof_over_years_with_a_hot_key_equals_sql(spark, parts):
    """Two years of seconds, one key on a third of the rows, null keys and clocks, beside DuckDB."""
    import duckdb

    rng = random.Random(parts)
    key = lambda: rng.choice([1, 1, None, 2, *range(3, 9)])
    moment = lambda: pd.Timestamp("2020-01-01") + pd.Timedelta(seconds=rng.randrange(2 * 366 * 86400))
    left = pd.DataFrame([(key(), moment() if rng.random() > 0.02 else pd.NaT, i) for i in range(900)], columns=["k", "t", "id"])
    right = pd.DataFrame([(key(), moment(), None if rng.random() < 0.2 else float(i)) for i in range(400)], columns=["k", "t", "v"])
    right = right.drop_duplicates(["k", "t"])
    left.loc[:49, ["k", "t"]] = right.iloc[:50][["k", "t"]].to_numpy()  # exact matches do not count
    left["k"], right["k"] = left["k"].astype("Int64"), right["k"].astype("Int64")
    con = duckdb.connect()
    con.register("l", left)
    con.register("r", right)
    want = dict(con.execute("SELECT id, v FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t > r.t").fetchall())
    def none(x):
        if pd.isna(x):
            return None
        return x.to_pydatetime() if isinstance(x, pd.Timestamp) else x if isinstance(x, float) else int(x)

    to = lambda df, kinds: spark.createDataFrame([tuple(none(x) for x in r) for r in df.itertuples(index=False)], kinds)
    got = SC.asof_backward(to(left, "k long, t timestamp, id long"), to(right, "k long, t timestamp, v double"),
                           key=["k"], clock="t", values=["v"], parts=parts)
    got = {r["id"]: r["v"] for r in got.collect()}
    assert len(got) == 900 and got == {i: none(v) for i, v in want.items()}


@pytest.mark.parametrize("restart", [(), ("s",)])
def test_a_batch_of_one_entity_takes_few_steps_and_matches_a_loop(restart):
    """A batch inside one entity used to take one array step per row."""
    import random as r
    import time

    import numpy as np
    import pyarrow as pa

    rng, n = r.Random(3), 200_000
    x = [None if rng.random() < 0.3 else rng.uniform(-9, 9) for _ in range(n)]
    keys, seasons = [0] * (n - 5) + [1] * 5, [i // 40_000 for i in range(n)]
    table = pa.table({"e": keys, "s": seasons, "v": pa.array(x, pa.float64()), "w": pa.array(x, pa.float64())})
    rules = {"v": SC.ewma(0.3), "w": SC.decayed_sum(0.35)}
    stream, took, got = SC._Stream(["e"], restart, rules), 0.0, []
    for batch in table.to_batches(max_chunksize=10_000):
        began = time.process_time()
        got.append(stream.read(batch))
        took += time.process_time() - began
    got = {k: np.concatenate([g[k] for g in got]) for k in got[0] if k != "zone"}
    state, count, key = [float("nan"), 0.0], 0, None
    for i in range(n):
        if key != (keys[i], seasons[i] if restart else 0):
            state, count, key = [float("nan"), 0.0], 0, (keys[i], seasons[i] if restart else 0)
        if i % 997 < 3 or i > n - 20:
            np.testing.assert_allclose(got["state"][i], state, atol=1e-9)
            assert got["count"][i].tolist() == [count, count]
        if x[i] is not None:
            state = [x[i] if np.isnan(state[0]) else 0.7 * state[0] + 0.3 * x[i], 0.65 * state[1] + x[i]]
            count += 1
    assert took < 1.5


@pytest.mark.parametrize("parts", [1, 9])
def test_a_scan_writes_only_what_is_told(spark, monkeypatch, parts):
    """Columns worked out from the states stand in their place, also for rows that take in an earlier partition's."""
    stored, keep = [], SC.materialize
    monkeypatch.setattr(SC, "materialize", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    df = spark.range(400).selectExpr("id % 2 AS e", "id DIV 150 AS s", "id AS o", "CAST(CASE WHEN id % 5 > 0 THEN id END AS DOUBLE) AS v")
    rule = {"v": SC.ewma(0.3)}
    ask = dict(entity=["e"], restart=["s"], order=["o"], values=rule, parts=parts)
    whole = {r["o"]: r for r in SC.decayed_scan(df, **ask).collect()}
    told = (["both", "seen"], lambda t: [(t["state"] + t["entered"])[:, 0], t["count"][:, 0]])
    found = SC.decayed_scan(df, **ask, told=told).collect()
    assert set(found[0].asDict()) == {"e", "s", "o", "both", "seen"} and "v" not in stored[-1].columns
    assert len(found) == 400
    for r in found:
        w = whole[r["o"]]
        assert r["seen"] == w["v__n"]
        want = None if w["v__s"] is None or w["v__e"] is None else w["v__s"] + w["v__e"]
        assert (r["both"] is None) == (want is None) and (want is None or r["both"] == pytest.approx(want))
