"""Every registered query of the library against its SQL, on the smallest tables; and fixture-based checks of single operators."""

from __future__ import annotations

import glob
import os

import numpy as np
import pandas as pd
import pytest

from tidebars.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df)].copy()
    for name in df:
        if pd.api.types.is_numeric_dtype(df[name]) and not pd.api.types.is_bool_dtype(df[name]) and df[name].isna().any():
            df[name] = df[name].astype(float)  # NULLs make integers floats on one side only
        if pd.api.types.is_datetime64_any_dtype(df[name]):
            df[name] = df[name].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_float_dtype(df[name]):
            df[name] = df[name].astype(float).round(6) + 0.0
        elif df[name].dtype == object:
            df[name] = df[name].astype(str).str.removesuffix(" 00:00:00")
    keys = [n for n in df if not pd.api.types.is_float_dtype(df[n])] + [n for n in df if pd.api.types.is_float_dtype(df[n])]
    return df.sort_values(keys, ignore_index=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = comparable(registry.queries()[name](spark, SF).toPandas()), comparable(duck.execute(registry.oracle_sql()[name]).df())
    assert list(got) == list(want) and len(got) == len(want)
    for column in got:
        if pd.api.types.is_float_dtype(got[column]) or pd.api.types.is_float_dtype(want[column]):
            assert np.isclose(got[column].astype(float), want[column].astype(float), rtol=1e-9, atol=2e-6, equal_nan=True).all(), column
        else:
            assert got[column].astype(str).tolist() == want[column].astype(str).tolist(), column


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0


def test_boot_prop_draws_from_all_days(spark):
    from tidebars.operators import sequential
    from tidebars.plans import research_queries
    from tidebars.sources.bars import daily_prices

    rows = daily_prices(spark, SF).where("high > low AND l_returnflag = 'N'").orderBy("trade_date").selectExpr("round(800 * (close - open) / (high - low), 2) AS pnl").toPandas()
    days = rows["pnl"].to_numpy()
    draws = [days[np.random.default_rng(1000 + i).integers(0, len(days), 120)] for i in range(2000)]
    want = pd.Series([sequential.evaluate_account(x, sequential.Policy("trailing"))[0] for x in draws]).value_counts().to_dict()
    assert {r["outcome"]: r["n"] for r in research_queries.boot_prop(spark, SF).collect()} == want


def test_hash_chain_covers_all_zones(spark):
    from pyspark.sql import functions as F

    from tidebars.operators import events
    from tidebars.plans import model_queries
    from tidebars.sources.bars import event_bars

    zones = events.gap_zones(event_bars(spark, SF)).groupBy("product", "trade_date").agg(F.count("*").alias("n")).collect()
    want = (sum(r["n"] for r in zones), len(zones))
    assert want[0] > 20 and max(r["n"] for r in zones) > 1
    assert tuple(model_queries.hash_chain(spark, SF).first()) == want


@pytest.mark.parametrize("name", ["bootstrap_ci", "boot_stationary", "headline_ci"])
def test_intervals_have_2000_replicates(spark, name):
    from tidebars.operators import inference
    from tidebars.plans import model_queries, research_queries

    if name == "headline_ci":
        rows, key, day, x = research_queries._labelled(spark, SF).groupBy("entry_session", "trade_date").agg({"return_atr": "avg"}), "entry_session", "trade_date", "avg(return_atr)"
    else:
        rows, key, day, x = model_queries._pnl(spark, SF), "account", "trade_date", "r"
    rows = rows.toPandas()
    for row in registry.queries()[name](spark, SF).collect():
        own = rows[rows[key].isna() if row[key] is None else rows[key] == row[key]].sort_values(day)[x].to_numpy(float)
        if name == "boot_stationary":
            want = np.quantile(own[inference.stationary_indices(len(own), 2000, 0.2, 11)].mean(axis=1), [0.025, 0.975])
        else:
            want = inference.bootstrap_mean_ci(own[~np.isnan(own)], 7 if name == "bootstrap_ci" else 5, 2000)
        assert np.allclose([row["lo"], row["hi"]], want, rtol=1e-12)
        if name == "bootstrap_ci":
            assert row["p"] == inference.bootstrap_p(own, 7, 2000)


def test_stream_sessions_count_every_event(spark, tmp_path):
    """Files whose times interleave, a gap of just six hours and one a microsecond shorter, events without a time or a user."""
    import duckdb

    from tidebars.plans import model_queries

    odd = "(-1, TIMESTAMP '2024-01-01 00:00:00', 9001), (-2, TIMESTAMP '2024-01-01 06:00:00', 9001), (-3, TIMESTAMP '2024-01-01 11:59:59.999999', 9001), (-4, NULL, 9001), (-5, NULL, 9002), (-6, NULL, NULL), (-7, TIMESTAMP '1969-12-31 23:59:59', NULL)"
    path = tmp_path / "events.parquet"
    path.mkdir()
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT * FROM '{SF}/events.parquet' UNION ALL SELECT i, t, u, 'click', 1.0, '{{}}' FROM (VALUES {odd}) AS x(i, t, u)")
    for i in range(3):
        con.execute(f"COPY (SELECT * FROM events WHERE abs(event_id) % 3 = {i}) TO '{path}/part-{i}.parquet' (FORMAT parquet)")
    got, want = comparable(model_queries.stream_sessions(spark, str(tmp_path)).toPandas()), comparable(con.execute(registry.oracle_sql()["stream_sessions"]).df())
    assert want["events"].sum() == 1007
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_stream_tables_stay_out_of_the_driver(spark, tmp_path):
    """Each batch's complete result is written by the executors and takes the place of the one before; the state goes, the session's settings stay."""
    from tidebars.streaming import bars as streaming

    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    before = {k: spark.conf.get(k, None) for k in streaming.STATE}
    out = streaming.run_to_table(streaming.bar_stream(streaming.tick_stream(spark, str(tmp_path)), 60))
    files = out.inputFiles()
    assert files and all(f.endswith(".parquet") and "/rows/2/" in f for f in files)  # three files, so batches 0, 1 and 2
    assert out.agg({"volume": "sum"}).first()[0] == rows.count()
    folder = files[0].removeprefix("file://").split("/rows/")[0]
    assert os.listdir(folder) == ["rows"] and os.listdir(f"{folder}/rows") == ["2"]
    assert {k: spark.conf.get(k, None) for k in streaming.STATE} == before
