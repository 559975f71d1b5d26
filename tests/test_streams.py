"""Streams that keep order in state against their batch forms: files in any order, several micro-batches, ties, late rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom import streaming as st
from marketloom.operators import equity as eq, flow, ticks as tk
from marketloom.session import work_dir
from marketloom.streaming.ordered import windows


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """Many short jobs over small tables: two partitions a shuffle."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    yield
    spark.conf.set(key, before)


def files(spark, pdf, schema, cuts, name):
    """The rows as one file per entry of cuts (masks), written one after another; each becomes a micro-batch."""
    path = work_dir(spark, name)
    for m in cuts:
        spark.createDataFrame(pdf[m], schema).coalesce(1).write.mode("append").parquet(path)
    return st.file_stream(spark, path, files_per_batch=1)


def same(got, want, keys):
    got, want = (d.sort_values(keys).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want) > 0
    pd.testing.assert_frame_equal(got[want.columns.tolist()], want, check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def ticks():
    """Three symbols, one of them with most rows, equal times, and a mark far ahead that lets the watermark pass all others."""
    rng = np.random.default_rng(3)
    parts = []
    for s, n in (("HOT", 700), ("A", 90), ("B", 7)):
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 3000, n)), unit="s")
        p = 100 * np.exp(np.cumsum(rng.normal(0, 0.001, n)))
        parts.append(pd.DataFrame({"symbol": s, "ts": ts, "seq": rng.permutation(n), "price": p, "bid": p * 0.999, "ask": p * 1.001, "bid_size": rng.integers(0, 9, n).astype(float),
                                   "ask_size": rng.integers(0, 9, n).astype(float), "volume": rng.integers(1, 50, n).astype(float)}))
    far = parts[0].iloc[:1].assign(symbol="END", ts=pd.Timestamp("2024-01-02"))
    return pd.concat([*parts, far], ignore_index=True)


SCHEMA = "symbol string, ts timestamp, seq long, price double, bid double, ask double, bid_size double, ask_size double, volume double"
CASES = {"stats": (st.rolling_tick_stats_stream, tk.rolling_tick_stats), "ofi": (st.rolling_ofi_stream, tk.rolling_ofi),
         "kyle": (lambda s, delay: st.kyle_lambda_stream(s, cap=5.0, delay=delay), lambda b: flow.kyle_lambda(b, cap=5.0)),
         "cooldown": (lambda s, delay: st.cooldown_filter_stream(s, 40, delay), lambda b: tk.cooldown_filter(b, 40))}


@pytest.mark.parametrize("name", CASES)
def test_stream_is_batch_with_files_in_the_wrong_order(spark, ticks, name):
    t, end = ticks["ts"], ticks["symbol"] == "END"
    a, b, c = t < "2024-01-01 00:15", (t >= "2024-01-01 00:15") & (t < "2024-01-01 00:35"), t >= "2024-01-01 00:35"
    stream, batch = CASES[name]
    got = st.drain(stream(files(spark, ticks, SCHEMA, [b & ~end, a & ~end, c & ~end, end], name), delay="1 hour"), name)
    want = batch(spark.createDataFrame(ticks[~end], SCHEMA))
    same(got.toPandas(), want.toPandas(), ["symbol", "ts", "seq"])


def test_rows_wait_for_the_watermark(spark, ticks):
    """Without the mark only rows at least the delay older than the newest one leave."""
    hot = ticks[ticks["symbol"] != "END"]
    out = st.drain(st.rolling_ofi_stream(files(spark, hot, SCHEMA, [hot["ts"] < "2024-01-01 00:30", hot["ts"] >= "2024-01-01 00:30"], "wait"), delay="10 minutes"), "wait").toPandas()
    assert len(out) == (hot["ts"] <= hot["ts"].max() - pd.Timedelta("10 minutes")).sum()


def test_late_rows_are_dropped(spark, ticks):
    hot, end = ticks[ticks["symbol"] == "HOT"], ticks[ticks["symbol"] == "END"]
    both = pd.concat([hot, end.assign(ts=pd.Timestamp("2024-01-01 12:00")), end], ignore_index=True)
    late = (both["symbol"] == "HOT") & (both["ts"] < "2024-01-01 00:10")
    first, mark, last = (both["symbol"] == "HOT") & ~late, both["ts"] == "2024-01-01 12:00", both["ts"] == "2024-01-02"
    got = st.drain(st.rolling_ofi_stream(files(spark, both, SCHEMA, [first, mark, late, last], "drop"), delay="1 minute"), "drop").toPandas()
    want = tk.rolling_ofi(spark.createDataFrame(both[first], SCHEMA)).toPandas()
    same(got[got["symbol"] == "HOT"], want, ["symbol", "ts", "seq"])


def test_guard_is_the_ratchet_floor(spark, tables):
    pdf = tables.equity().select("account", "ts", "trade_id", "balance").toPandas()
    mid, end = pdf["ts"].quantile(0.5), pdf.iloc[:1].assign(account="END", ts=pd.Timestamp("2100-01-01"))
    pdf = pd.concat([pdf, end], ignore_index=True)
    last = pdf["account"] == "END"
    stream = files(spark, pdf, "account string, ts timestamp, trade_id long, balance double", [(pdf["ts"] > mid) & ~last, (pdf["ts"] <= mid) & ~last, last], "guard-in")
    got = st.drain(st.equity_guard_stream(stream, delay="10000 days"), "guard").toPandas()
    same(got[["account", "trade_id", "peak", "floor", "halt"]], eq.ratchet_floor(tables.equity()).select("account", "trade_id", "peak", "floor", "halt").toPandas(), ["account", "trade_id"])


def test_guard_of_a_complete_input_has_every_row(spark):
    """The input has ended, so rows that still wait for the watermark leave too, in order and after the peak of the batches before."""
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(40), unit="h")
    pdf = pd.DataFrame({"account": ["A", None] * 20, "ts": ts, "trade_id": np.arange(40), "balance": 10000 + 50 * np.sin(np.arange(40)) * np.arange(40)})
    stream = files(spark, pdf, "account string, ts timestamp, trade_id long, balance double", [pdf["trade_id"] < 30, pdf["trade_id"] >= 30], "complete")
    got = st.drain(st.equity_guard_stream(stream, delay="12 hours"), "complete", complete=True).toPandas()
    peak = pdf.groupby("account", dropna=False)["balance"].cummax().clip(lower=10000.0)
    same(got[["trade_id", "balance", "peak"]], pdf[["trade_id", "balance"]].assign(peak=peak), ["trade_id"])


def test_no_task_of_a_stream_sees_a_whole_key(spark, monkeypatch):
    """Blocks of forty rows, each with the rows before it: the latch goes through all of them and over micro-batches."""
    monkeypatch.setattr("marketloom.plans.BLOCK_ROWS", 40)
    p = np.round(np.random.default_rng(4).normal(0, 1, 400), 3)
    pdf = pd.DataFrame({"strategy": "S", "exit_ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(400), unit="min"), "trade_id": np.arange(400), "net_pnl_pct": p})
    stream = files(spark, pdf, "strategy string, exit_ts timestamp, trade_id long, net_pnl_pct double", [pdf["trade_id"] < 150, pdf["trade_id"] >= 150], "latch-blocks")
    out = st.edge_latch(stream, delay="1 minute")
    got = st.drain(out, "latch-blocks", complete=True).toPandas()
    status, buffered = zip(*latch_rows(pdf["net_pnl_pct"]))
    same(got[["trade_id", "status", "buffered"]], pdf[["trade_id"]].assign(status=status, buffered=buffered), ["trade_id"])


def test_lead_signals_are_not_paired(spark):
    """Two thousand signals within the time to live of each of a hundred flow rows: running minima, no join of signals with flow."""
    base = pd.Timestamp("2024-01-01")
    sig = pd.DataFrame({"leader": "X", "follower": "F", "direction": "LONG", "confidence": np.arange(2000) % 997 / 1000, "lag": 1, "triggered": True, "signal_ts": base + pd.to_timedelta(np.arange(2000), unit="ms")})
    fl = pd.DataFrame({"symbol": "F", "ts": base + pd.to_timedelta(np.arange(100) * 20, unit="ms"), "seq": np.arange(100), "flow_regime": "CLEAN"})
    s = files(spark, sig, "leader string, follower string, direction string, confidence double, lag long, triggered boolean, signal_ts timestamp", [sig["lag"] == 1], "sig-many")
    f = files(spark, fl, "symbol string, ts timestamp, seq long, flow_regime string", [fl["seq"] >= 0], "flow-many")
    out = st.lead_signal_stream(s, f, "1 second", "1 minute")
    assert "Join" not in out.rows._jdf.queryExecution().analyzed().toString()
    got = st.drain(out, "lead-many", complete=True).toPandas()
    best = [sig["confidence"][max(0, 20 * i - 1000):20 * i + 1].max() for i in range(100)]
    same(got[["seq", "confidence"]], pd.DataFrame({"seq": np.arange(100), "confidence": best}), ["seq"])


def latch_rows(p):
    """Trade by trade: (status, trades in the buffer)."""
    recent, buf, streak, off, out = [], [], 0, False, []
    for x in p.tolist():
        recent = (recent + [x])[-30:]
        streak = 0 if x > 0 else streak + 1
        wins, losses = sum(v for v in recent if v > 0), -sum(v for v in recent if v < 0)
        sd = np.std(recent, ddof=1) / 100 if len(recent) > 5 else 0.0
        sr = (np.mean(recent) / 100 - 0.05 / 252) / sd * np.sqrt(252) if sd > 1e-12 else 0.0
        fails = sum(map(bool, (sum(v > 0 for v in recent) / len(recent) < 0.45, sr < 0.5, (wins / losses if losses > 1e-12 else 9.99) < 1.05, streak >= 7)))
        if off:
            buf = (buf + [int(x > 0)])[-10:]
            if len(buf) >= 10 and sum(buf) / len(buf) >= 0.52:
                off, buf = False, []
        elif len(recent) >= 5 and fails >= 3:
            off, buf = True, []
        out.append(("SUSPEND" if off else "ACTIVE", len(buf)))
    return out


def test_latch_against_a_walk_over_trades(spark):
    rng = np.random.default_rng(8)
    parts = []
    for s, n, shift in (("up", 400, 0.3), ("flat", 600, 0.0), ("down", 300, -0.4), ("few", 3, -1.0)):
        t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 50_000, n)), unit="s")
        parts.append(pd.DataFrame({"strategy": s, "exit_ts": t, "trade_id": np.arange(n), "net_pnl_pct": np.round(rng.normal(shift, 1.0, n), 3)}))
    pdf = pd.concat(parts, ignore_index=True)
    want = pd.concat([p.assign(status=[a for a, _ in r], buffered=[b for _, b in r]) for p in parts for r in [latch_rows(p["net_pnl_pct"])]])
    end = pdf.iloc[:1].assign(strategy="END", exit_ts=pd.Timestamp("2024-02-01"))
    rows, last = pd.concat([pdf, end], ignore_index=True), np.append(np.zeros(len(pdf), bool), True)
    third = rows.groupby("strategy").cumcount().to_numpy() % 3
    stream = files(spark, rows, "strategy string, exit_ts timestamp, trade_id long, net_pnl_pct double", [(third == 1) & ~last, (third == 0) & ~last, (third == 2) & ~last, last], "latch-in")
    got = st.drain(st.edge_latch(stream, delay="5 days"), "latch").toPandas()
    same(got[got["strategy"] != "END"], want[["strategy", "exit_ts", "trade_id", "status", "buffered"]], ["strategy", "trade_id"])
    assert (want["status"] == "SUSPEND").any() and (want[want["strategy"] == "flat"]["status"] == "ACTIVE").any()


def test_lead_signals_by_shuffled_files(spark):
    rng = np.random.default_rng(5)
    base = pd.Timestamp("2024-01-01")
    sig = pd.DataFrame({"leader": rng.choice(["X", "Y"], 200), "follower": rng.choice(["F", "G"], 200), "direction": "LONG", "confidence": np.round(rng.random(200), 1), "lag": 1, "triggered": rng.random(200) < 0.7,
                        "signal_ts": base + pd.to_timedelta(rng.integers(0, 3000, 200), unit="s")})
    fl = pd.DataFrame({"symbol": rng.choice(["F", "G", "H"], 300), "ts": base + pd.to_timedelta(rng.integers(0, 3000, 300), unit="s"), "seq": np.arange(300), "flow_regime": rng.choice(["CLEAN", "TOXIC"], 300)})
    far = base + pd.Timedelta("2 days")
    sig2 = pd.concat([sig, sig.iloc[:1].assign(follower="none", signal_ts=far, triggered=True)], ignore_index=True)
    fl2 = pd.concat([fl, fl.iloc[:1].assign(symbol="none", ts=far, flow_regime="CLEAN")], ignore_index=True)
    half = lambda d: [(d.index % 2 == 1) & (d.index < len(d) - 1), (d.index % 2 == 0) & (d.index < len(d) - 1), d.index == len(d) - 1]
    s = files(spark, sig2, "leader string, follower string, direction string, confidence double, lag long, triggered boolean, signal_ts timestamp", half(sig2), "sig")
    f = files(spark, fl2, "symbol string, ts timestamp, seq long, flow_regime string", half(fl2), "flow")
    got = st.drain(st.lead_signal_stream(s, f, "60 seconds", "2 hours"), "lead").toPandas()
    got = got[got["follower"] != "none"]
    both = fl[fl["flow_regime"] == "CLEAN"].merge(sig[sig["triggered"]], left_on="symbol", right_on="follower")
    both = both[(both["signal_ts"] <= both["ts"]) & (both["signal_ts"] >= both["ts"] - pd.Timedelta("60 seconds"))]
    want = both.sort_values(["confidence", "leader", "signal_ts"], ascending=[False, True, True]).groupby("seq", as_index=False).first()
    want["age_s"] = (want["ts"] - want["signal_ts"]).dt.total_seconds()
    same(got, want[["follower", "ts", "seq", "leader", "direction", "confidence", "lag", "age_s"]], ["seq"])


def test_windows():
    assert np.array_equal(windows(np.arange(4.0), 2, 2), [[1, 2], [2, 3]]) and np.isnan(windows(np.arange(2.0), 3, 2)[0, :2]).all()
