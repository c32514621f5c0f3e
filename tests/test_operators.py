"""Single operators against hand calculation, naive loops and mutation of the future."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.operators import aggregates, events, features, inference, joins, labels, sequential
from tidebars.sources import governed
from tidebars.sources.bars import with_calendar, with_runs

START = dt.datetime(2024, 1, 2, 6, 0)


def make_bars(spark, n=200, flat=False, missing=(), closes=None):
    steps = [0.1, 0.2, -0.1, 0.0, 0.3, -0.2]
    volumes = [100, 120, 90, 150, 110, 130]
    rows, close = [], 20.0
    for i in range(n):
        before = close
        close = float(closes[i]) if closes is not None else (20.0 if flat else round(close + steps[i % 6], 6))
        if i not in missing:
            pad = 0.0 if flat else 0.2
            rows.append(("P", START + dt.timedelta(minutes=15 * i), before, max(before, close) + pad, min(before, close) - pad, close, volumes[i % 6]))
    df = spark.createDataFrame(rows, "product string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume long")
    return with_runs(with_calendar(df), 15)


def column(df, name, order="bar_id"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


def test_runs_break_at_gaps(spark):
    bars = make_bars(spark, 40, missing=(10, 11, 25))
    assert sorted(r["n"] for r in bars.groupBy("run_id").agg(F.count("*").alias("n")).collect()) == [10, 13, 14]
    assert [r for r in column(bars, "boundary_reason") if r] == [1, 2, 2]


def test_atr_is_complete_and_resets(spark):
    bars = features.prepared(make_bars(spark, 60, missing=(30,)))
    pdf = bars.orderBy("bar_id").select("run_id", "high", "low", "close", "atr20").toPandas()
    for _, g in pdf.groupby("run_id", sort=False):
        h, lo, c = (g[x].to_numpy() for x in ("high", "low", "close"))
        tr = np.maximum.reduce([h[1:] - lo[1:], abs(h[1:] - c[:-1]), abs(lo[1:] - c[:-1])])
        tr = np.concatenate([[h[0] - lo[0]], tr])
        for i, v in enumerate(g["atr20"]):
            assert math.isnan(v) if i < 19 else abs(v - tr[i - 19 : i + 1].mean()) < 1e-12


def test_flat_prices_have_null_ratios(spark):
    row = features.prepared(make_bars(spark, 70, flat=True)).withColumns(features.candles() | features.momentum()).orderBy(F.desc("bar_id")).first()
    assert row["body_to_range"] is None and row["rolling_range_position_15"] is None and row["absolute_return_1m_atr"] is None


def test_features_do_not_see_the_future(spark):
    rng = np.random.default_rng(0)
    path = (20 + rng.standard_normal(150).cumsum() * 0.05).tolist()
    changed = path[:100] + [x + 3 for x in path[100:]]
    build = lambda p: features.mlat(features.trend(features.experimental(features.vwap_state(features.prepared(make_bars(spark, 150, closes=p))))))
    names = ["atr20", "rv15", "choppiness_14", "normalized_ols_slope_30", "vwap_elasticity_30_exp", "cutler_rsi_14", "variance_ratio_60_5", "day_distance"]
    a, b = (build(p).where("bar_id < 100").orderBy("bar_id").select(*names).toPandas() for p in (path, changed))
    assert np.allclose(a.astype(float), b.astype(float), equal_nan=True)


def test_streak(spark):
    bars = features.streak(features.prepared(make_bars(spark, 7, closes=[20, 21, 22, 22, 21, 20, 21])))
    assert column(bars, "directional_streak") == [None, 1, 2, 0, -1, -2, 1]


def test_labels_first_extreme_and_reason(spark):
    closes = [20, 20.1, 20.5, 20.5, 20.2, 20.4, 20.1, 20.0, 20.3, 20.6, 20.7, 20.8]
    rows = labels.labelled(features.prepared(make_bars(spark, 12, closes=closes)), 4).orderBy("bar_id").collect()
    assert rows[0]["bars_to_high"] == 2 and rows[0]["return_ticks"] == round((20.2 - rows[0]["entry_price"]) / 0.01)
    assert [r["reason"] for r in rows][-4:] == ["insufficient_rows"] * 4 and rows[0]["reason"] == "available"
    gap = labels.labelled(features.prepared(make_bars(spark, 12, closes=closes, missing=(3,))), 4).orderBy("bar_id").first()
    assert gap["reason"] == "time_gap" and gap["return_ticks"] is None


def test_first_passage_takes_stop_on_ambiguous_bar(spark):
    bars = make_bars(spark, 20, closes=[20] * 5 + [22, 18] + [20] * 13)
    opp = spark.createDataFrame([("P", dt.date(2024, 1, 2), "P/0", "Development", 3, 4, "London", 20.0, 1, 1.0, 19.0, 21.0)], "product string, trade_date date, run_id string, research_partition string, decision_bar long, entry_bar long, entry_session string, entry_price double, side int, risk double, stop double, target double")
    out = events.first_passage(opp, bars).first()
    assert (out["exit_reason"], out["exit_bar"], out["gross_r"]) == ("target", 5, 1.0)
    both = events.first_passage(opp.withColumns({"entry_bar": F.lit(6).cast("long"), "decision_bar": F.lit(5).cast("long"), "entry_price": F.lit(20.0)}), bars).first()
    assert both["exit_reason"] == "stop" and both["ambiguous"]


def test_walk_matches_loop(spark):
    rng = np.random.default_rng(4)
    trades = [("P", dt.date(2024, 1, 1 + d), int(e), int(e + rng.integers(0, 6)), 0.5) for d in range(3) for e in sorted(set(rng.integers(0, 60, 30).tolist()))]
    df = spark.createDataFrame(trades, "product string, trade_date date, entry_bar long, exit_bar long, gross_r double")
    got = {(r["trade_date"], r["entry_bar"]) for r in events.walk_nonoverlap(df, ["product", "trade_date"]).where("taken").collect()}
    want, last = set(), {}
    for _, d, e, x, _ in trades:
        if e > last.get(d, -1):
            want.add((d, e))
            last[d] = x
    assert got == want


def test_flex_exit_equals_static_without_moves(spark):
    rng = np.random.default_rng(6)
    for _ in range(200):
        close = 100 + rng.standard_normal(15).cumsum()
        path = np.stack([close + rng.random(15), close - rng.random(15), close], axis=1)
        offset, reason, price, best, worst = sequential.flex_exit(1, 100.0, path, sequential.ExitRules(2.0, 3.0, hold=12))
        want = next(((i, "stop", 98.0) if lo <= 98 else (i, "target", 103.0) for i, (hi, lo, _) in enumerate(path[:12]) if lo <= 98 or hi >= 103), (11, "time_exit", path[11][2]))
        assert (offset, reason, price) == want and best >= 0 and worst >= 0


def test_trailing_stop_holds_from_the_next_bar():
    path = np.array([[105, 99.5, 104], [104.5, 103.1, 103.5], [103.2, 102.9, 103]], float)
    assert sequential.flex_exit(1, 100.0, path, sequential.ExitRules(5.0, 50.0, trail=2.0))[:3] == (2, "stop", 103.0)


def test_ema_rsi_by_hand():
    assert np.allclose(sequential.ema_values(np.array([1.0, 2, 3, 4]), 3)[2:], [2, 3])
    assert sequential.rsi_values(np.array([1.0, 2, 3, 4]), 2).tolist()[2:] == [100.0, 100.0] and sequential.rsi_values(np.ones(4), 2)[3] == 50.0


def test_evaluation_rules():
    p = sequential.Policy("p", target=100, daily_loss=50, drawdown=80, least_days=2, best_day_share=0.9)
    assert sequential.evaluate_account(np.array([60.0, 60.0]), p) == ("passed", 2, p.balance + 120)
    assert sequential.evaluate_account(np.array([10.0, -50.0]), p)[0:2] == ("daily_loss", 2)
    assert sequential.evaluate_account(np.array([40.0, -45.0, -40.0]), p)[0:2] == ("drawdown", 3)


def test_asof_joins(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 5, 11), ("a", 9, 12), ("b", 1, 13)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 8, "y")], "k string, u int, v string")
    nxt = {r["id"]: r["v"] for r in joins.asof_next(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert nxt == {10: "x", 11: "x", 12: None, 13: None}
    strict = {r["id"]: r["v"] for r in joins.asof_next(left, right, ["k"], "t", "u", ["v"], strict=True).collect()}
    assert strict == {10: "x", 11: "y", 12: None, 13: None}
    prior = {r["id"]: r["v"] for r in joins.asof_prior(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert prior == {10: None, 11: "x", 12: "y", 13: None}


def test_many_to_one_fails_on_repeats(spark):
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeats a key"):
        joins.validated_many_to_one(spark.createDataFrame([(1,)], "k int"), right, ["k"]).collect()


def test_range_join_equals_cross_filter(spark):
    rng = np.random.default_rng(2)
    a = [(int(i % 2), int(x), int(x + w)) for i, (x, w) in enumerate(zip(rng.integers(0, 200, 30), rng.integers(0, 40, 30), strict=True))]
    b = [(int(i % 2), int(x)) for i, x in enumerate(rng.integers(0, 240, 80))]
    got = joins.range_join(spark.createDataFrame(a, "k int, lo int, hi int"), spark.createDataFrame(b, "k int, at int"), ["k"], "lo", "hi", "at", 16)
    assert sorted((r["k"], r["lo"], r["hi"], r["at"]) for r in got.collect()) == sorted((k, lo, hi, x) for k, lo, hi in a for q, x in b if k == q and lo <= x <= hi)


def test_ranks_leave_nulls_out(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, None), (1, 7.0)], "d int, x double").withColumn("r", aggregates.average_rank(F.col("x"), ["d"]))
    assert sorted((r["x"] or 0, r["r"]) for r in df.collect() if r["x"]) == [(5.0, 1.5), (5.0, 1.5), (7.0, 3.0)] and df.where("x IS NULL").first()["r"] is None


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "fam string, i int, p double")
    q = {r["i"]: r["q"] for r in aggregates.benjamini_hochberg(df, "p", ["fam"]).collect()}
    assert np.allclose([q[i] for i in range(4)], [0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_pava_and_pbo_and_sharpe():
    assert inference.pava(np.array([1.0, 3, 2, 4]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]
    rng = np.random.default_rng(0)
    good = np.column_stack([rng.standard_normal(200) * 0.01 + 0.05, *[rng.standard_normal(200) * 0.01 for _ in range(4)]])
    assert inference.pbo(good, 6) == 0.0 and inference.deflated_sharpe(good[:, 0], 5, 0.01) > 0.99


def test_stationary_bootstrap_is_seeded():
    a, b = (inference.stationary_indices(50, 20, 0.2, 3) for _ in range(2))
    assert (a == b).all() and a.min() >= 0 and a.max() < 50


def test_gram_ridge_equals_lstsq(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 2))
    y = 1 + x @ np.array([2.0, -1.0])
    df = spark.createDataFrame([(float(a), float(b), float(v)) for (a, b), v in zip(x, y, strict=True)], "a double, b double, y double")
    assert np.allclose(inference.ridge_from_gram(*inference.gram_of(df, ["a", "b"], "y"), 0.0), [1, 2, -1])


def test_governance(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1), (dt.date(2025, 1, 1), 2)], "trade_date date, x int")
    with pytest.raises(PermissionError):
        governed.assert_unlocked(df, "2024-12-31")
    assert governed.assert_unlocked(df.where("x = 1"), "2024-12-31").count() == 1
    entry = governed.save_table(df, f"{tmp_path}/t")
    assert governed.verify_table(spark, entry) == [] and governed.verify_table(spark, entry | {"rows": 3}) == ["rows"]
    assert governed.forbidden_columns(["atr", "forward_return", "mfe_long"]) == ["forward_return", "mfe_long"]
    reader = governed.GuardedReader(spark, frozenset({"t"}), "2024-12-31")
    assert reader.read(f"{tmp_path}/t", ["trade_date", "x"], "trade_date").count() == 1 and reader.audit[-1]["rows"] == 1
    with pytest.raises(PermissionError):
        reader.schema(f"{tmp_path}/other")


def test_hash_chain_finds_changes(spark):
    records = governed.chain([{"a": i} for i in range(5)])
    rows = [(i, governed.canonical({"a": i if i != 3 else 9}), r["previous_hash"], r["record_hash"]) for i, r in enumerate(records)]
    log = spark.createDataFrame(rows, "seq long, payload string, previous_hash string, record_hash string")
    assert [r["seq"] for r in governed.broken_links(log).collect()] == [3]
    assert governed.fingerprint({"b": 1, "a": 2}) == governed.fingerprint({"a": 2, "b": 1})


def test_library_runs_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tidebars", tmp_path / "tidebars", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rolling_atr' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_zero_prices_and_volumes_give_null(spark):
    """Bars with low = 0, volume 0 or no range have NULL where a ratio or a logarithm has no value; nothing raises."""
    bars = make_bars(spark, 130, flat=True)
    bars = bars.withColumns({"low": F.when(F.col("bar_id") % 7 == 3, 0.0).otherwise(F.col("low")), "close": F.when(F.col("bar_id") == 100, 0.0).otherwise(F.col("close")), "volume": F.when(F.col("bar_id") % 11 == 5, 0).otherwise(F.col("volume"))})
    out = features.mlat(features.prepared(bars)).toPandas()
    assert len(out) == 130 and out["pk"].isna().sum() >= 18 and out["parkinson_volatility_30"].isna().all()
    rows = labels.labelled(features.prepared(bars), 4).toPandas()
    assert len(rows) == 130 and rows["return_bps"].isna().any()
    whole = features.experimental(features.trend(features.session_state(features.vwap_state(features.prepared(bars)))))
    assert whole.count() == 130 and not np.isinf(whole.select("distance_from_research_day_vwap_atr").toPandas().astype(float)).any().any()


def test_stationary_blocks():
    at = inference.stationary_indices(50, 400, 0.2, 3)
    assert at.shape == (400, 50) and at.min() >= 0 and at.max() == 49
    follows = (at[:, 1:] == (at[:, :-1] + 1) % 50).mean()
    assert abs(follows - (0.8 + 0.2 / 50)) < 0.01 and np.bincount(at.ravel()).std() < 0.2 * 400
    assert (inference.stationary_indices(1, 3, 0.5, 1) == 0).all()


def test_publish_swaps_together_or_not_at_all(spark, tmp_path):
    from tidebars.sources import governed

    for name in ("a", "b"):
        spark.range(1).write.parquet(f"file://{tmp_path}/{name}")
        spark.range(5).write.parquet(f"file://{tmp_path}/staged/{name}")
    with pytest.raises(FileNotFoundError):
        governed.publish(spark, {f"file://{tmp_path}/staged/a": f"file://{tmp_path}/a", f"file://{tmp_path}/staged/none": f"file://{tmp_path}/b"})
    assert spark.read.parquet(f"file://{tmp_path}/a").count() == spark.read.parquet(f"file://{tmp_path}/b").count() == 1
    governed.publish(spark, {f"file://{tmp_path}/staged/{n}": f"file://{tmp_path}/{n}" for n in ("a", "b")})
    assert spark.read.parquet(f"file://{tmp_path}/a").count() == spark.read.parquet(f"file://{tmp_path}/b").count() == 5


def test_text_sinks_are_held_against_their_manifest(spark, tmp_path):
    from tidebars.sources import governed

    rows = spark.createDataFrame([(2, "b,\"x\"", 0.1 + 0.2), (1, None, None), (3, "", 1e-300)], "k int, t string, x double")
    for save, load, name in ((governed.save_csv, governed.load_csv, "csv"), (governed.save_json, governed.load_json, "json")):
        entry = save(rows, f"file://{tmp_path}/{name}", ["k"])
        assert sorted(map(tuple, load(spark, entry).collect())) == sorted(map(tuple, rows.collect()))
        with pytest.raises(ValueError):
            load(spark, entry | {"rows": 4})


def test_resimulation_disagrees_with_tampered_trades(spark):
    from tidebars.operators import trades

    bars = features.prepared(make_bars(spark, 400))
    opps = events.opportunities(bars)
    found = events.first_passage(opps, bars)
    assert {r["status"]: r["n"] for r in trades.reconcile(found, trades.resimulate(opps, bars)).collect()} == {"equal": found.count()}
    wrong = found.withColumn("gross_r", F.when(F.col("decision_bar") % 10 == 0, F.col("gross_r") + 0.5).otherwise(F.col("gross_r"))).where("decision_bar % 10 <> 1")
    got = {r["status"]: r["n"] for r in trades.reconcile(wrong, trades.resimulate(opps, bars)).collect()}
    assert set(got) == {"equal", "different", "only_again"} and sum(got.values()) == found.count()


def test_gates_name_what_fails(spark):
    from tidebars.operators import evaluation

    rows = spark.createDataFrame([(1.0, None), (0.0, 2.0), (1.0, 2.0)], "a double, b double")
    gates = {"a_positive": F.col("a") > 0, "b_large": F.col("b") > 1}
    assert [r[0] for r in rows.select(evaluation.failed_gates(gates)).collect()] == [["b_large"], ["a_positive"], []]


def test_residual_ic_equals_regression_of_ranks(spark):
    from tidebars.operators import evaluation

    rng = np.random.default_rng(4)
    z = rng.standard_normal((200, 3))
    x, y = z @ [1.0, 0.5, -0.3] + rng.standard_normal(200), z @ [0.2, -0.7, 0.4] + rng.standard_normal(200)
    rows = spark.createDataFrame([(dt.date(2024, 1, 2), float(a), float(b), *map(float, c)) for a, b, c in zip(x, y, z, strict=True)], "trade_date date, x double, y double, p double, q double, r double")
    got = evaluation.residual_ic(rows, "x", "y", ["p", "q", "r"]).first()["partial_ic"]
    rank = lambda v: np.argsort(np.argsort(v)).astype(float)
    basis = np.column_stack([np.ones(200), *[rank(z[:, i]) for i in range(3)]])
    rest = [rank(v) - basis @ np.linalg.lstsq(basis, rank(v), rcond=None)[0] for v in (x, y)]
    assert math.isclose(got, np.corrcoef(*rest)[0, 1], abs_tol=1e-9)


def test_max_sharpe_p_tells_an_effect_from_the_best_of_noise():
    rng = np.random.default_rng(2)
    noise = rng.standard_normal((250, 12))
    best = int(np.argmax(noise.mean(axis=0) / noise.std(axis=0)))
    assert inference.max_sharpe_p(noise, best, 1, 400) > 0.05
    noise[:, 3] += 0.5
    assert inference.max_sharpe_p(noise, 3, 1, 400) < 0.01 and inference.max_sharpe_p(np.zeros((20, 2)), 0, 1, 50) == 1.0
