"""Block plans give the same numbers as plain windows, whatever the block size and however hot the key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from marketloom import plans
from marketloom.operators import features, risk, ticks
from marketloom.session import work_dir

def win():
    return Window.partitionBy("symbol").orderBy("ts", "seq")

CH = 5000


def chunk():
    return plans.time_chunk("ts", CH)


def frame(df, *cols):
    return df.select("symbol", "seq", *cols).toPandas().sort_values(["symbol", "seq"]).reset_index(drop=True)


@pytest.mark.parametrize("rows", [16, 50, 10000])
def test_blocked_frames(hot, rows):
    _, df = hot
    b = plans.blocked(df, ["symbol"], ["ts", "seq"], chunk(), before=12, after=7, rows=rows)
    got = b.add(a=F.avg("close").over(b.frame(10)), l=F.lag("close", 12).over(b.w), n=F.lead("x", 7).over(b.w)).done(drop_index=False)
    want = df.withColumns({"a": F.avg("close").over(win().rowsBetween(-9, 0)), "l": F.lag("close", 12).over(win()), "n": F.lead("x", 7).over(win()), "_i": F.row_number().over(win()) - 1,
                           "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    cols = ["a", "l", "n", "_i", "_n"]
    pd.testing.assert_frame_equal(frame(got, *cols), frame(want, *cols), check_dtype=False, rtol=1e-12)


def test_running_and_runs(hot):
    _, df = hot
    got = plans.running(df, ["symbol"], ["ts", "seq"], chunk(), sums={"s": "x"}, maxs={"m": "close"}, mins={"k": "close"})
    u = win().rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"s": F.sum("x").over(u), "m": F.max("close").over(u), "k": F.min("close").over(u)})
    pd.testing.assert_frame_equal(frame(got, "s", "m", "k"), frame(want, "s", "m", "k"), rtol=1e-12)
    r = plans.runs(df.withColumn("up", (F.col("x") > 25)), ["symbol"], ["ts", "seq"], chunk(), "up")
    g = r.groupBy("symbol", "_run").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("up").alias("d")).toPandas()
    assert (g["d"] == 1).all() and g["n"].sum() == df.count()


def test_order_stats_and_quantiles(hot):
    pdf, df = hot
    for col in ("x", "close"):
        got = plans.quantiles(df, ["symbol"], col, {"a": 0.05, "b": 0.5, "c": 0.97}).toPandas().set_index("symbol")
        for s, g in pdf.groupby("symbol"):
            np.testing.assert_allclose(got.loc[s, ["a", "b", "c"]].astype(float), np.quantile(g[col], [0.05, 0.5, 0.97]), rtol=1e-12)


def test_drawdown_rows(hot):
    pdf, df = hot
    r = df.withColumn("r", (F.col("x") - 25) / 1000)
    got = plans.drawdown_rows(r, ["symbol"], ["ts", "seq"], chunk(), "r")
    got = got.groupBy("symbol").agg(F.min(F.col("cum") / F.col("peak") - 1).alias("mdd")).toPandas().set_index("symbol")["mdd"]
    for s, g in pdf.groupby("symbol"):
        cum = np.exp(np.cumsum((g["x"].to_numpy() - 25) / 1000))
        np.testing.assert_allclose(got[s], (cum / np.maximum.accumulate(cum) - 1).min(), rtol=1e-9)


def test_ema_blocks_equal_unbroken_recursion(hot):
    pdf, df = hot
    for spans in ((5, 20), (2, 600)):  # short blocks for the fast average, many fading blocks for the slow one
        got = features.ema(df.select("symbol", "ts", "close"), spans).toPandas().sort_values(["symbol", "ts"])
        for n in spans:
            want = pdf.sort_values(["symbol", "ts"]).groupby("symbol")["close"].transform(lambda c: c.ewm(span=n, adjust=False).mean())
            np.testing.assert_allclose(got[f"ema{n}"].to_numpy(), want.to_numpy(), rtol=1e-12)


def test_indexed_frames_give_the_same_features(hot):
    _, df = hot
    bars = df.selectExpr("symbol", "ts", "close open", "close * 1.01 high", "close * 0.99 low", "close", "x + 1 volume").dropDuplicates(["symbol", "ts"])
    path = work_dir(df.sparkSession, "indexed")
    plans.indexed(bars, ["symbol"], ["ts"], plans.time_chunk("ts", plans.BAR_CHUNK)).write.parquet(path)
    known = df.sparkSession.read.parquet(path)
    for f in (features.technicals, features.momentum_factor, features.realized_vol_suite, features.zscore_signal):
        a, b = (f(x).drop("_i", "_n").toPandas().sort_values(["symbol", *(["ts"] if f in (features.technicals, features.zscore_signal) else [])]).reset_index(drop=True) for x in (bars, known))
        pd.testing.assert_frame_equal(a, b, rtol=1e-12)
    plan = features.zscore_signal(known)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


@pytest.mark.parametrize("seconds", [1500, 9000, 60000])
def test_cooldown_against_brute_force(hot, seconds):
    pdf, df = hot
    got = set(map(tuple, ticks.cooldown_filter(df, seconds).select("symbol", "seq").toPandas().to_numpy().tolist()))
    want = set()
    for s, g in pdf.groupby("symbol"):
        last = None
        for t, q in zip(g["ts"], g["seq"]):
            if last is None or (t - last).total_seconds() >= seconds:
                want.add((s, q))
                last = t
    assert got == want


def test_crowded_day_of_one_key_is_cut(spark, monkeypatch):
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    from marketloom import plans

    monkeypatch.setattr(plans, "SPLIT_ROWS", 1000)
    rng = np.random.default_rng(2)
    hot = pd.DataFrame({"symbol": "HOT", "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 86_400_000, 19_000)), unit="ms")})
    cold = pd.DataFrame({"symbol": "B", "ts": pd.date_range("2020-01-01", periods=1000, freq="6h")})
    pdf = pd.concat([hot, cold])
    pdf["seq"], pdf["x"] = np.arange(len(pdf)), rng.normal(size=len(pdf))
    df = spark.createDataFrame(pdf).repartition(8)
    sizes = plans._chunked(df, ["symbol"], ["ts", "seq"], plans.time_chunk("ts", plans.TICK_CHUNK)).groupBy("symbol", "_chunk").count().agg(F.max("count")).first()[0]
    assert sizes <= 1000
    got = plans.running(plans.row_index(df, ["symbol"], ["ts", "seq"], plans.time_chunk("ts", plans.TICK_CHUNK)), ["symbol"], ["ts", "seq"], plans.time_chunk("ts", plans.TICK_CHUNK),
                        sums={"s": "x"}, maxs={"m": "x"}).toPandas().sort_values(["symbol", "ts", "seq"])
    want = pdf.sort_values(["symbol", "ts", "seq"])
    by = want.groupby("symbol")["x"]
    assert (got["_i"].to_numpy() == want.groupby("symbol").cumcount().to_numpy()).all()
    assert np.allclose(got["s"], by.cumsum()) and np.allclose(got["m"], by.cummax())


@pytest.mark.parametrize("span", [0, 600, 20000])
def test_trailing_sum_of_a_busy_stretch(hot, monkeypatch, span):
    pdf, df = hot
    monkeypatch.setattr(plans, "SPLIT_ROWS", 200)
    rows = df.select("symbol", F.unix_timestamp("ts").alias("s"), F.col("x").cast("long").alias("x"), "seq")
    got = plans.trailing_sum(rows.select("symbol", "s", "x"), rows.select("symbol", "s", "seq"), ["symbol"], "s", "x", span, plans.DAY, "n").toPandas()
    assert len(got) == len(pdf)
    for s, g in pdf.assign(s=pdf["ts"].astype("int64") // 10 ** 9 if str(pdf["ts"].dtype).endswith("[ns]") else pdf["ts"].astype("int64") // 10 ** 6).groupby("symbol"):
        t, x = g["s"].to_numpy(), g["x"].to_numpy()
        want = {q: x[(t <= a) & (t >= a - span)].sum() for q, a in zip(g["seq"], t)}
        assert {r.seq: r.n for r in got[got["symbol"] == s].itertuples()} == want


def test_a_day_with_most_rows_restarts_at_its_start(spark, monkeypatch):
    """95 % of the trades of a key on one day: the scan restarts at days without a window that holds one."""
    from marketloom.operators import trades as tr

    monkeypatch.setattr(plans, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(6)
    at = np.concatenate([rng.integers(0, 86_400, 950), 86_400 * rng.integers(1, 9, 50) + 7])
    pdf = pd.DataFrame({"strategy": "S", "exit_ts": pd.Timestamp("2024-03-01") + pd.to_timedelta(np.sort(at), unit="s"), "trade_id": np.arange(1000), "net_pnl_usd": np.round(rng.normal(-5, 800, 1000), 2)})
    df = spark.createDataFrame(pdf)
    got = tr.daily_loss_lock(df, 1e5, 2.0)
    assert "day" not in "".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if x.strip(" :+-").startswith("Window") and "to_date" in x)
    got = got.toPandas().sort_values("trade_id").reset_index(drop=True)
    day = pdf["exit_ts"].dt.date
    start = 1e5 + pdf["net_pnl_usd"].cumsum().sub(pdf["net_pnl_usd"]).groupby(day).transform("first")
    pct = pdf["net_pnl_usd"].groupby(day).cumsum() / start * 100
    np.testing.assert_allclose(got["day_pnl_pct"], pct, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got["day_start"], start, rtol=1e-12)
    assert (got["locked"].to_numpy() == (pct <= -2.0).groupby(day).cummax().to_numpy()).all() and 0 < got["locked"].sum() < 1000


def test_positioned_is_index_and_running_sum_in_one_shuffle(hot, spark):
    _, df = hot
    sums = {"s": "x"}
    got = plans.positioned(df, ["symbol"], ["ts", "seq"], chunk(), sums)
    one = plans.row_index(df, ["symbol"], ["ts", "seq"], chunk())
    want = plans.running(one, ["symbol"], *plans.by_position(one, ["ts", "seq"], chunk()), sums=sums)
    pd.testing.assert_frame_equal(frame(got, "_i", "_n", "s"), frame(want, "_i", "_n", "s"), check_dtype=False, rtol=1e-12)
    odd = spark.createDataFrame([(None, 1, 1.0), ("a", 1, None), ("a", 1, 2.0), ("a", 2, 3.0)], "symbol string, ts int, x double").withColumn("ts", F.timestamp_seconds("ts"))
    rows = plans.positioned(odd, ["symbol"], ["ts", "x"], chunk(), sums).orderBy("_i").collect()
    assert [(r.symbol, r._i, r._n, r.s) for r in rows] == [("a", 0, 3, 0.0), ("a", 1, 3, 2.0), ("a", 2, 3, 5.0)]


def test_bar_view_shuffles_its_days_once(spark, tables, monkeypatch):
    """Positions and prices of the bars: the daily rows are ordered once, and high and low are not written."""
    path = tables._path("bars", tables._bars_daily, "l_suppkey", F.col("l_suppkey").cast("string"))
    text = path._jdf.queryExecution().executedPlan().toString()
    assert text.count("Window [row_number") == 1 and text.count("Sort [l_suppkey") <= 4, text
    stored = []
    monkeypatch.setattr(type(tables), "_stored", lambda self, name, build: stored.append(build().columns) or build())
    monkeypatch.setattr(type(tables), "_path", lambda self, *a: path)
    bars = tables.bars()
    assert "high" not in stored[0] and bars.columns == ["symbol", "ts", "open", "high", "low", "close", "volume", "_i", "_n"]


def test_previous_values_over_chunks_in_one_shuffle(spark):
    rng = np.random.default_rng(9)
    p = pd.DataFrame({"symbol": rng.choice(["a", "b"], 400), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.permutation(40_000)[:400], "s"), "close": rng.uniform(1, 2, 400)})
    p.loc[::7, "close"] = np.nan
    df = spark.createDataFrame(p).withColumn("close", F.nanvl("close", F.lit(None).cast("double")))
    df = df.union(spark.createDataFrame([("a", 5.0), (None, 1.0)], "symbol string, close double").select("symbol", F.lit(None).cast("timestamp"), "close"))
    got = plans.previous(df, ["symbol"], "ts", chunk(), {"c": "close", "t": "ts"})
    w = Window.partitionBy("symbol").orderBy("ts")
    want = df.where("symbol is not null").withColumns({"c": F.lag("close").over(w), "t": F.lag("ts").over(w)})
    rows = lambda d: sorted(map(repr, d.select("symbol", "ts", "close", "c", "t").collect()))
    assert rows(got) == rows(want)


def test_replicates_share_their_draws():
    """Paths of the trade bootstrap equal the draws of their formula, and a draw that many replicates make is made once."""
    rng = np.random.default_rng(3)
    n, reps, seed, m = 30_011, 9_000, 42, 2**31 - 1
    s = rng.normal(0, 0.001, n)
    table = np.stack([s, s + 0.001, s - 0.001, -np.abs(s)], axis=-1)
    table[rng.random(n) < 0.1] = risk.EMPTY
    start, length, used, first, number = risk._segments(n, reps, seed)
    mine = np.flatnonzero(used)
    keep = mine[np.isin(mine, [(first[r] + j) % len(start) for r in (0, 7, 8191, 8999) for j in range(number[r])])]
    part = np.tile(risk.EMPTY, (len(start), 1))
    part[keep] = np.stack(risk._drawn(np.concatenate([table, [risk.EMPTY]]), start[keep], length[keep]), axis=-1)
    for r in (0, 7, 8191, 8999):
        x = (r * 1000003 + np.arange(n) * 8191 + seed * 131071) % m
        x = (x + 12345) * 48271 % m
        x ^= x >> 13
        pick = table[x * 69621 % m % n]
        level = np.concatenate([[0.0], np.cumsum(pick[:, 0])])
        high = np.maximum.accumulate(np.concatenate([[-np.inf], level[:-1] + pick[:, 1]]))[:-1]
        got = risk.EMPTY
        for j in range(number[r]):
            got = risk._joined(got, part[(first[r] + j) % len(start)])
        np.testing.assert_allclose([got[0], got[3]], [level[-1], np.minimum(pick[:, 3], level[:-1] + pick[:, 2] - high).min()], atol=1e-12)
    start, length, used, first, number = risk._segments(8_640_000, 10_000, seed)  # a strategy of 43 million trades: 8.6e10 slots
    assert length[used].sum() <= m
    ends = np.concatenate([[0], np.cumsum(np.tile(length, 2))])
    assert (ends[first + number] - ends[first] == 8_640_000).all()


def test_short_series_are_sorted_where_they_meet(hot):
    """Series of one block and longer ones have the same tail figures as every series by counts, and a short series' values are sent once."""
    pdf, df = hot
    rets = plans.indexed(df.where("seq % 7 <> 3").select("symbol", "ts", (F.round("x") / 1000 - 0.02 + F.log("close") / 1e4).alias("r")), ["symbol"], ["ts"], plans.time_chunk("ts", CH))
    rows = plans.BLOCK_ROWS
    want = risk.advanced_risk(rets.drop("_i", "_n")).toPandas().sort_values("symbol").reset_index(drop=True)
    try:
        plans.BLOCK_ROWS = 1000  # one series is longer
        got = risk.advanced_risk(rets)
        plan = got._jdf.queryExecution().executedPlan().toString()
        got = got.toPandas().sort_values("symbol").reset_index(drop=True)
    finally:
        plans.BLOCK_ROWS = rows
    assert set(got["symbol"]) == {"HOT", "A", "B"} and "collect_list" in plan
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)
