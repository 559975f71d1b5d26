"""Bounds, determinism and batch = stream for the operators without an exact SQL form."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from conftest import FOLDER
from marketloom import streaming as st
from marketloom.operators import equity as eq, features as ft, models, portfolio as pf, risk
from marketloom.session import work_dir
from marketloom.sources import feeds


def test_hmm_probabilities_and_labels(tables):
    h = models.hmm_regime(tables.bars(), iters=20).toPandas()
    assert len(h) == tables.bars().select("symbol").distinct().count()
    np.testing.assert_allclose(h[["prob_bearish", "prob_sideways", "prob_bullish"]].sum(axis=1), 100, rtol=1e-9)
    assert set(h["current_regime"]) <= set(models.LABELS) and (h["confidence_pct"] <= 95.0).all()
    np.testing.assert_allclose(np.array(h["transition"].tolist()).reshape(-1, 3, 3).sum(axis=2), 1.0, rtol=1e-9)


def test_bootstrap_is_deterministic_and_ordered(tables):
    r = ft.log_returns(tables.bars())
    a, b = (risk.block_bootstrap_sharpe(r, reps=50).toPandas().sort_values("symbol").reset_index(drop=True) for _ in range(2))
    pd.testing.assert_frame_equal(a, b)
    assert (a["ci_lower"] <= a["bootstrap_mean"]).all() and (a["bootstrap_mean"] <= a["ci_upper"]).all()


def test_block_bootstrap_trades_draws_all_replicates(spark, tables):
    """The registered query against its SQL with the replicates of the reference, and the operator at the count that the SQL has."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "events", "part", "supplier", "nation", "region"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    sql = contract.oracle_sql()["block_bootstrap_trades"]
    for got, text in ((contract.queries()["block_bootstrap_trades"](spark, FOLDER), sql.replace("range(20)", "range(10000)")),
                      (risk.block_bootstrap_trades(tables.trades(), reps=20, stake=0.01), sql.replace("range(10000)", "range(20)"))):
        want, got = con.execute(text).fetchdf().set_index("strategy").sort_index(), got.toPandas().set_index("strategy").sort_index()
        assert list(got.index) == list(want.index) and len(got) > 1
        np.testing.assert_allclose(got[want.columns].to_numpy(float), want.to_numpy(float), atol=2e-5)


def test_var_percentile_and_tail_order(tables):
    r = ft.log_returns(tables.bars())
    v = risk.var_cvar(r, 0.95, method="percentile").toPandas().set_index("symbol")
    for s, g in r.toPandas().groupby("symbol"):
        np.testing.assert_allclose(v.loc[s, "var_hist"], np.percentile(g["r"], 5), rtol=1e-9)
    assert (v["cvar_hist"] <= v["var_hist"]).all() and (v["cvar_cf"] <= v["var_cf"] + 1e-12).all()


@pytest.mark.parametrize("method", ["trace", "oracle"])
def test_shrinkage_weight_in_unit_interval(tables, method):
    m = tables.base("part").select(F.col("p_brand").alias("symbol"), F.substring("p_brand", 7, 1).alias("cluster")).distinct()
    c = pf.return_covariance(ft.log_returns(tables.bars_brand()), pf.cluster_pairs(m))
    s = pf.shrinkage_covariance(c, method).toPandas()
    assert s["rho"].between(0, 1).all() and (s.loc[s["a"] == s["b"], "cov_shrunk"] > 0).all()


def test_vote_signal_bounds(tables):
    v = models.model_vote_signal(tables.bars()).toPandas()
    assert v["bull_probability_pct"].between(0, 100).all() and v["confidence"].between(0, 100).all()
    assert (v["stop_long"] < v["price"]).all() and (v["target_long"] > v["price"]).all()


def test_late_ticks_are_dropped(spark):
    rows = lambda *s: spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": pd.to_datetime(list(s)), "seq": range(len(s)), "price": 10.0, "volume": 1.0}))
    path = work_dir(spark, "late")
    rows("2024-01-01 00:05", "2024-01-01 03:00").coalesce(1).write.parquet(path)
    rows("2024-01-01 04:00").coalesce(1).write.mode("append").parquet(path)  # the watermark takes effect one batch later
    rows("2024-01-01 00:06", "2024-01-01 06:00").coalesce(1).write.mode("append").parquet(path)
    out = st.drain(st.tick_to_bar_stream(st.file_stream(spark, path, files_per_batch=1), "1 hour"), "late-out").toPandas()
    first = out[out["ts"] == pd.Timestamp("2024-01-01 00:00")]
    assert len(first) == 1 and first["volume"].iloc[0] == 1.0


def test_report_round_trip(spark, tables):
    df = tables.bars().groupBy("symbol").agg(F.struct(F.max("close").alias("hi"), F.min("close").alias("lo")).alias("range"))
    back = feeds.write_report(df, work_dir(spark, "rep"))
    assert sorted(back.select("symbol", "range.hi").collect()) == sorted(df.select("symbol", "range.hi").collect())
    js = feeds.write_report(df, work_dir(spark, "repj"), "json")
    assert js.count() == df.count() and "range" in js.first()["value"]


def test_replicates_of_groups_in_one_task_and_in_many(spark):
    """Draws by the plain formula; a group of many runs is added up over tasks, one of a single run is finished where it is, a null group stays."""
    rng = np.random.default_rng(2)
    pdf = pd.concat([pd.DataFrame({"g": g, "k": np.arange(n) + at, "v": rng.normal(size=n)}) for g, n, at in (("HOT", 3000, 0), ("A", 40, 0), ("B", 700, 90), (None, 9, 5))], ignore_index=True)
    x = (((np.arange(60)[:, None] * 1000003 + pdf["k"].to_numpy()[None, :] * 8191 + 42 * 131071) % 2147483647 + 12345) * 48271) % 2147483647
    x = (x ^ (x >> 13)) * 69621 % 2147483647
    w = np.searchsorted(risk.POISSON, x / 2147483647.0, side="right")
    assert np.array_equal(risk.replicate_weights(pdf["k"], 60, 42), w)
    want = {g: (w[:, i] @ pdf["v"].to_numpy()[i]).sum() for g, i in pdf.groupby(pdf["g"].fillna("-")).indices.items()}
    df = spark.createDataFrame(pdf, "g string, k long, v double").repartition(5)
    for gather in (True, False):
        got = risk.replicate_stats(df, "g", "k", ["v"], 60, 42, lambda t: [float(t.sum())], "total double", gather=gather).collect()
        assert len(got) == 4 and all(abs(r["total"] - want[r["g"] or "-"]) < 1e-6 for r in got)


def test_win_rate_draws_every_trade(spark):
    """A trade counts in each replicate by a draw of its own id, so other ids give another interval; a null result is no win."""
    pdf = pd.DataFrame({"strategy": "S", "trade_id": np.arange(300) * 7, "net_pnl_usd": [1.0, -1.0, None] * 100})
    w = risk.replicate_weights(pdf["trade_id"], 1000, 42)
    wr = w @ (pdf["net_pnl_usd"].to_numpy() > 0) / w.sum(1) * 100
    row = risk.bootstrap_win_rate(spark.createDataFrame(pdf, "strategy string, trade_id long, net_pnl_usd double").withColumn("net_pnl_usd", F.nanvl("net_pnl_usd", F.lit(None).cast("double")))).first()
    assert np.allclose([row["mean_pct"], row["ci_lower_pct"], row["ci_upper_pct"]], [wr.mean(), *np.quantile(wr, [0.025, 0.975])])


def test_trades_read_once_are_not_stored(spark, tables):
    """The same rows as the stored view, without writing it."""
    from marketloom.sources import _STORED, Tables

    folder = FOLDER + "/."  # a name of its own
    once = Tables(spark, folder).trades_once()
    assert once.exceptAll(tables.trades()).isEmpty() and once.count() == tables.trades().count()
    assert not any(k[1] == folder and k[2] == "trades" for k in _STORED)


def test_pre_trade_flags_count_a_day_that_crowded_chunks_split(spark, monkeypatch):
    """Orders of a day and balances as of their time by a plain walk, with chunks of few rows; rows are indexed once."""
    from marketloom import plans
    from marketloom.operators import trades as ops

    monkeypatch.setattr(plans, "SPLIT_ROWS", 40)
    monkeypatch.setattr(ops, "indexed", None)  # the day's orders need no positions of their own
    rng = np.random.default_rng(3)
    t0 = pd.Timestamp("2024-01-01")
    o = pd.DataFrame({"account": rng.choice(["a", "b"], 600, p=[0.9, 0.1]), "ts": t0 + pd.to_timedelta(rng.integers(0, 4 * 86400, 600), "s"), "order_id": np.arange(600), "entry_price": 10.0, "stop_price": 9.0, "size_usd": 500.0})
    s = pd.DataFrame({"account": rng.choice(["a", "b"], 300), "ts": t0 + pd.to_timedelta(rng.integers(0, 4 * 86400, 300), "s"), "trade_id": np.arange(300), "balance": rng.uniform(8000, 12000, 300)})
    got = ops.pre_trade_flags(spark.createDataFrame(o), spark.createDataFrame(s)).toPandas().set_index("order_id").sort_index()
    o = o.sort_values(["ts", "order_id"])
    o["n"] = o.groupby(["account", o["ts"].dt.date]).cumcount()
    want = pd.merge_asof(o, s.sort_values(["ts", "trade_id"]), on="ts", by="account").set_index("order_id").sort_index()
    assert (got["trades_today"] == want["n"]).all()
    assert np.allclose(got["balance"], want["balance"].fillna(10000.0))


def test_walk_forward_windows_and_scaled_falls_by_a_plain_walk(spark):
    """Windows whose limits are midnights, for rows at and off midnight; the scaled drawdown is taken from one pass over the test rows."""
    rng = np.random.default_rng(5)
    day = pd.date_range("2020-01-31", "2022-12-31", freq="D")
    ts = [d + pd.Timedelta(hours=int(h)) for d, h in zip(day, rng.choice([0, 0, 9], len(day)))]
    p = pd.DataFrame({"symbol": "a", "ts": ts, "r": rng.normal(0, 0.02, len(day))})
    w = risk._walk_windows(spark.createDataFrame(p), 12, 3).toPandas()
    s, e = p["ts"].min(), p["ts"].max()
    want, reduced = [], 0
    for k in range(20):
        t0, t1, t2 = (s.normalize() + pd.DateOffset(months=3 * k + m) for m in (0, 12, 15))
        if t2 <= e:
            train, test = p[p["ts"].between(t0, t1)], p[p["ts"].between(t1, t2)]
            want += [(k, "train", t) for t in train["ts"]] + [(k, "test", t) for t in test["ts"]]
            scale = np.clip(0.12 / max(train["r"].std(ddof=0) * np.sqrt(252), 1e-6), 0.1, 1.5)
            fall = lambda r: np.min(np.exp(r.cumsum() - r.cumsum().cummax()) - 1)
            reduced += abs(fall(test["r"] * scale)) < abs(fall(test["r"])) - 1e-12
    assert sorted(want) == sorted(zip(w["k"], w["part"], w["ts"]))
    got = risk.vol_scaled_walk_forward(spark.createDataFrame(p))
    assert got.first()["mdd_reduced"] == reduced and reduced > 0
    assert "scaled" not in got._jdf.queryExecution().optimizedPlan().toString().replace("oos_scaled", "").replace("mdd_scaled", "")


@pytest.mark.parametrize("most", [40, 1_000_000])
def test_reserve_split_by_a_plain_walk(spark, monkeypatch, most):
    """Trades of a long and a short account, whole and cut into chunks of few rows; capital never falls below its minimum by a loss."""
    from marketloom import plans
    from marketloom.operators import equity as ops

    monkeypatch.setattr(plans, "SPLIT_ROWS", most)
    rng = np.random.default_rng(8)
    p = pd.DataFrame({"account": rng.choice(["a", "b"], 500, p=[0.95, 0.05]), "ts": pd.Timestamp("2019-01-01") + pd.to_timedelta(rng.integers(0, 2000 * 86400, 500), "s"), "trade_id": np.arange(500), "pnl": rng.normal(-20, 300, 500)})
    df = ops.reserve_split(spark.createDataFrame(p), 0.2, 10000.0, 9900.0)
    got = df.toPandas().set_index("trade_id")
    assert len(got) == 500
    for _, g in p.sort_values(["ts", "trade_id"]).groupby("account"):
        cap, kept = 10000.0, 0.0
        for r in g.itertuples():
            cap, kept = max(9900.0, cap + (r.pnl * 0.8 if r.pnl > 0 else r.pnl)), kept + max(r.pnl, 0) * 0.2
            assert np.allclose(got.loc[r.trade_id, ["tradeable_capital", "locked_reserve", "total_balance"]].astype(float), [cap, kept, cap + kept])


@pytest.mark.parametrize("name", ["reserve_split", "combined_risk_scale"])
def test_account_queries_do_not_store_whole_trades(spark, monkeypatch, name):
    from marketloom.catalog import QUERIES
    from marketloom.sources import _STORED, Tables

    folder = FOLDER + {"reserve_split": "/./.", "combined_risk_scale": "/././."}[name]  # a name of its own
    monkeypatch.setattr(Tables, "trades", lambda self: pytest.fail("the whole trades view is written for a few columns"))
    before = set(_STORED)
    assert QUERIES[name](spark, folder).count() > 0
    assert {k[2] for k in set(_STORED) - before} <= {"results", "equity"}


def test_combined_risk_scale_of_long_series_and_repeated_ids(spark, monkeypatch):
    """Blocks of few rows give what plain windows give; equity is shuffled by account once; an id that comes twice stands for itself in each part."""
    from marketloom import plans
    from marketloom.operators import equity as ops

    rng = np.random.default_rng(4)
    n = 700
    ts = pd.Timestamp("2020-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 900 * 86400, n)), "s")
    p = pd.DataFrame({"account": rng.choice(["a", "b"], n, p=[0.9, 0.1]), "ts": ts, "trade_id": np.arange(n), "pct": rng.normal(0.02, 1, n)})
    p["balance"] = 10000 * (1 + p["pct"] / 100).groupby(p["account"]).cumprod()
    trades = spark.createDataFrame(p.rename(columns={"ts": "exit_ts", "pct": "net_pnl_pct"}))
    whole = ops.combined_risk_scale(spark.createDataFrame(p[["account", "ts", "trade_id", "balance"]]), trades, trail=0.05)
    got = whole.toPandas().sort_values("trade_id").reset_index(drop=True)
    assert len(got) == n and got["mode"].nunique() > 2 and got["halt_reason"].nunique() > 2
    monkeypatch.setattr(plans, "SPLIT_ROWS", 100)
    monkeypatch.setattr(plans, "BLOCK_ROWS", 64)
    equity = spark.createDataFrame(p[["account", "ts", "trade_id", "balance"]])
    indexed = plans.indexed(equity, ["account"], ["ts", "trade_id"], plans.time_chunk("ts", plans.BAR_CHUNK))
    for e in (equity, indexed):
        cut = ops.combined_risk_scale(e, trades, trail=0.05).toPandas().sort_values("trade_id").reset_index(drop=True)
        pd.testing.assert_frame_equal(got, cut, check_dtype=False, rtol=1e-9, atol=1e-12)
    twice = equity.unionByName(equity.where("trade_id = 5"))
    assert ops.combined_risk_scale(twice, trades, trail=0.05).where("trade_id = 5").count() == 8
    assert ops.combined_risk_scale(twice, trades, trail=0.05).where("trade_id <> 5").count() == n - 1
