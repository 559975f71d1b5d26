"""Trade statistics, attribution, sizing and pre-trade rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ANN, case, clamp, flag, is_true, lit, phi, safe_div, t_quantile
from ..plans import BLOCK_ROWS, TICK_CHUNK, _chunked, blocked, day_starts, drawdown_rows, indexed, last_rows, quantiles, running, runs, time_chunk, trailing_sum

EXIT_ORDER = ["exit_ts", "trade_id"]


def _chunk(ts: str = "exit_ts") -> Column:
    return time_chunk(ts, TICK_CHUNK)


def bucket_stats(trades: DataFrame, by: list[str]) -> DataFrame:
    """Counts, win rate, sums, mean and exact median, per-trade Sharpe, extremes and profit factor per group."""
    p, n = F.col("net_pnl_pct"), F.col("net_pnl_usd")
    a = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(flag(n > 0)) * 100).alias("win_rate_pct"), F.sum("net_pnl_usd").alias("total_net_usd"),
        F.sum("gross_pnl_usd").alias("total_gross_usd"), F.sum("fee_usd").alias("total_fees_usd"), F.sum("slippage_usd").alias("total_slip_usd"),
        F.avg("net_pnl_pct").alias("avg_net_pct"), F.avg("net_pnl_usd").alias("avg_net_usd"), F.stddev_samp("net_pnl_pct").alias("_sd"),
        F.max("net_pnl_usd").alias("best_usd"), F.min("net_pnl_usd").alias("worst_usd"),
        F.coalesce(F.sum(F.when(n > 0, n)), F.lit(0.0)).alias("_w"), F.abs(F.coalesce(F.sum(F.when(n < 0, n)), F.lit(0.0))).alias("_l"))
    a = a.withColumns({"sharpe_trade": F.when(F.col("_sd") > 1e-12, F.col("avg_net_pct") / F.col("_sd")).otherwise(0.0),
                       "profit_factor": F.col("_w") / F.greatest("_l", F.lit(1e-12))}).drop("_sd", "_w", "_l")
    return a.join(quantiles(trades, by, "net_pnl_pct", {"median_net_pct": 0.5}), by)


def attribution_by_dimension(trades: DataFrame, dims=("strategy", "symbol", "exit_reason", "regime", "direction")) -> DataFrame:
    """The same statistics for every value of every dimension in one pass (rows are stacked, partial sums combine map-side)."""
    stack = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims]))
    x = trades.select("net_pnl_usd", "net_pnl_pct", "gross_pnl_usd", "fee_usd", "slippage_usd", stack.alias("d"))
    return bucket_stats(x.select("*", "d.dimension", "d.value").where("value is not null"), ["dimension", "value"])


def attribution_time_of_day(trades: DataFrame, hours: int = 4) -> DataFrame:
    return bucket_stats(trades.withColumn("utc_from", (F.floor(F.hour("entry_ts") / hours) * hours).cast("int")), ["utc_from"])


def optimal_hours(trades: DataFrame, n: int = 3) -> DataFrame:
    """Best and worst n UTC hours per strategy by per-trade Sharpe, and the losses that avoiding the worst would save."""
    h = trades.withColumn("hour", F.hour("entry_ts")).groupBy("strategy", "hour").agg(
        F.avg("net_pnl_pct").alias("m"), F.stddev_samp("net_pnl_pct").alias("sd"), F.sum("net_pnl_usd").alias("pnl"),
        F.coalesce(F.sum(F.when(F.col("net_pnl_usd") <= 0, -F.col("net_pnl_usd"))), F.lit(0.0)).alias("losses"))
    h = h.withColumn("sharpe", F.when(F.col("sd") > 1e-12, F.col("m") / F.col("sd")).otherwise(0.0))
    p = Window.partitionBy("strategy")  # 24 rows
    h = h.withColumns({"best": F.row_number().over(p.orderBy(F.col("sharpe").desc(), "hour")), "worst": F.row_number().over(p.orderBy("sharpe", F.col("hour").desc()))})
    h = h.where((F.col("best") <= n) | (F.col("worst") <= n))
    return h.select("strategy", "hour", "sharpe", "pnl", F.when(F.col("best") <= n, "BEST").otherwise("WORST").alias("kind"),
                    F.when(F.col("best") > n, F.col("losses")).otherwise(0.0).alias("saved_if_avoided"))


SIGNALS = {
    "ofi": ("entry_ofi is not null", "abs(entry_ofi) >= 0.55"), "zscore": ("entry_zscore is not null", "abs(entry_zscore) >= 1.5"),
    "kyle_lambda": ("entry_kyle_lambda is not null", "abs(entry_kyle_lambda) >= 0.005"), "lead_lag": ("lead_lag_active is not null", "lead_lag_active"),
    "funding": ("funding_signal is not null", "funding_signal <> 'NONE'"), "maker": ("maker_order is not null", "maker_order")}


def signal_attribution(trades: DataFrame) -> DataFrame:
    """Does a signal add value: statistics with the signal present and absent, edge = difference of mean returns."""
    s = F.explode(F.array_compact(F.array(*[F.when(F.expr(ok), F.struct(F.lit(k).alias("signal"), F.expr(on).alias("present"))) for k, (ok, on) in SIGNALS.items()])))
    x = trades.select("net_pnl_usd", "net_pnl_pct", "fee_usd", s.alias("s")).select("*", "s.signal", "s.present")
    on, off = F.col("present"), ~F.col("present")
    a = x.groupBy("signal").agg(
        F.count(F.when(on, 1)).alias("n_present"), F.count(F.when(off, 1)).alias("n_absent"),
        (F.avg(F.when(on, flag(F.col("net_pnl_usd") > 0))) * 100).alias("win_rate_present"), (F.avg(F.when(off, flag(F.col("net_pnl_usd") > 0))) * 100).alias("win_rate_absent"),
        F.avg(F.when(on, F.col("net_pnl_pct"))).alias("mean_present"), F.avg(F.when(off, F.col("net_pnl_pct"))).alias("mean_absent"),
        F.coalesce(F.sum(F.when(on & (F.col("net_pnl_usd") <= 0), -F.col("net_pnl_usd"))), F.lit(0.0)).alias("losses_present"),
        F.coalesce(F.sum(F.when(off, F.col("fee_usd"))), F.lit(0.0)).alias("fees_absent"))
    z = F.lit(0.0)
    return a.select("signal", "n_present", "n_absent", "win_rate_present", "win_rate_absent", "mean_present", "mean_absent",
                    (F.coalesce("mean_present", z) - F.coalesce("mean_absent", z)).alias("edge_pct"),
                    F.when(F.col("signal") == "kyle_lambda", F.col("losses_present")).alias("blocked_losses_usd"),
                    F.when(F.col("signal") == "maker", F.col("fees_absent") * (1 - 0.01 / 0.035)).alias("fee_savings_usd"))


def cost_attribution(trades: DataFrame) -> DataFrame:
    """Gross, fees, slippage and drag, per strategy and in total (rollup)."""
    a = trades.rollup("strategy").agg(F.grouping("strategy").alias("g"), *[F.sum(c).alias(n) for c, n in (
        ("gross_pnl_usd", "gross_usd"), ("fee_usd", "fees_usd"), ("slippage_usd", "slip_usd"), ("net_pnl_usd", "net_usd"))])
    g = F.greatest("gross_usd", F.lit(1e-12))
    return a.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("strategy")).alias("strategy"), "gross_usd", "fees_usd", "slip_usd", "net_usd",
                    (F.col("fees_usd") / g * 100).alias("fee_drag_pct"), (F.col("slip_usd") / g * 100).alias("slip_drag_pct"),
                    ((F.col("fees_usd") + F.col("slip_usd")) / g * 100).alias("total_drag_pct"), (F.col("net_usd") > 0).alias("profitable"))


def trade_summary(trades: DataFrame, by: str = "strategy") -> DataFrame:
    n, p = F.col("net_pnl_usd"), F.col("net_pnl_pct")
    a = trades.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(n > 0, 1)).alias("wins"), F.count(F.when(n < 0, 1)).alias("losses"),
                               F.coalesce(F.sum(F.when(n > 0, n)), F.lit(0.0)).alias("gw"), F.abs(F.coalesce(F.sum(F.when(n < 0, n)), F.lit(0.0))).alias("gl"),
                               F.avg(F.when(n > 0, p)).alias("avg_win_pct"), F.avg(F.when(n < 0, p)).alias("avg_loss_pct"), F.max("net_pnl_usd").alias("best_usd"),
                               F.min("net_pnl_usd").alias("worst_usd"), F.avg("hold_seconds").alias("avg_hold_seconds"))
    wr = F.col("wins") / F.col("n")
    return a.select(by, "n", "wins", "losses", (wr * 100).alias("win_rate_pct"), safe_div("gw", "gl", 9999.0).alias("profit_factor"), "avg_win_pct", "avg_loss_pct",
                    (wr * F.coalesce(F.col("gw") / F.nullif("wins", F.lit(0)), F.lit(0.0)) - (1 - wr) * F.coalesce(F.col("gl") / F.nullif("losses", F.lit(0)), F.lit(0.0))).alias("expectancy_usd"),
                    "best_usd", "worst_usd", "avg_hold_seconds")


def exit_breakdown(trades: DataFrame) -> DataFrame:
    return trades.groupBy("strategy").pivot("exit_reason", ["STOP_LOSS", "TAKE_PROFIT", "TIME_STOP"]).count().fillna(0)


def quality_buckets(trades: DataFrame) -> DataFrame:
    """Win rate per quality band; inversion: the top band has the lowest win rate among bands with 3 trades or more."""
    q = F.coalesce("quality_score", F.lit(50.0))
    b = case((q >= 90, "A+"), (q >= 75, "A"), (q >= 60, "B"), (q >= 45, "C"), default="D")
    a = trades.groupBy("strategy", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("net_pnl_usd") > 0, 1)).alias("wins"), F.avg("net_pnl_pct").alias("avg_pnl_pct"))
    a = a.withColumn("win_rate_pct", F.col("wins") / F.col("n") * 100)
    w = Window.partitionBy("strategy")  # five rows
    big = F.col("n") >= 3
    worst = F.min_by(F.when(big, F.col("bucket")), F.when(big, F.struct(F.round("win_rate_pct", 1), "bucket"))).over(w)
    return a.withColumn("inversion", is_true((F.count(F.when(big, 1)).over(w) >= 2) & (worst == "A+")))


def trade_streaks(trades: DataFrame) -> DataFrame:
    t = trades.select("strategy", *EXIT_ORDER, F.signum("net_pnl_usd").cast("int").alias("sgn"))
    r = runs(t, ["strategy"], EXIT_ORDER, _chunk(), "sgn")
    g = r.groupBy("strategy", "_run").agg(F.first("sgn").alias("sgn"), F.count(F.lit(1)).alias("len"))
    size = lambda s: F.coalesce(F.max(F.when(F.col("sgn") == s, F.col("len"))), F.lit(0))
    last = F.max_by(F.struct("sgn", "len"), "_run")
    return g.groupBy("strategy").agg(size(1).alias("max_win_streak"), size(-1).alias("max_loss_streak"),
                                     F.when(last["sgn"] == -1, last["len"]).otherwise(0).alias("current_loss_streak"))


def equity_curve(trades: DataFrame, initial: float = 100000.0, key: str = "strategy") -> DataFrame:
    """Closed-trade balance on every calendar day from the first entry to the last exit, carried forward."""
    d = trades.groupBy(key, F.to_date("exit_ts").alias("day")).agg(F.sum("net_pnl_usd").alias("pnl"))
    first = trades.groupBy(key).agg(F.min(F.to_date("entry_ts")).alias("day")).withColumn("pnl", F.lit(0.0))
    d = d.unionByName(first).groupBy(key, "day").agg(F.sum("pnl").alias("pnl"))
    w = Window.partitionBy(key).orderBy("day")  # one row per calendar day
    d = d.withColumns({"balance": F.round(F.lit(initial) + F.sum("pnl").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6), "nxt": F.lead("day").over(w)})
    return d.select(key, F.explode(F.sequence("day", F.coalesce(F.date_sub("nxt", 1), "day"))).alias("day"), "balance")


def curve_metrics(curve: DataFrame, key: str = "strategy") -> DataFrame:
    w = Window.partitionBy(key).orderBy("day")  # one row per calendar day
    d = curve.withColumns({"prev": F.lag("balance").over(w), "peak": F.max("balance").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    d = d.withColumn("r", (F.col("balance") - F.col("prev")) / F.col("prev"))
    r, k = F.col("r"), math.sqrt(ANN)
    a = d.groupBy(key).agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("sd"), F.stddev_pop(F.when(r < 0, r)).alias("dsd"), F.count(F.when(r < 0, 1)).alias("dn"),
                           F.min((F.col("balance") - F.col("peak")) / F.col("peak") * 100).alias("max_drawdown_pct"), F.min_by("balance", "day").alias("b0"), F.max_by("balance", "day").alias("b1"))
    a = a.withColumn("total_return_pct", (F.col("b1") / F.col("b0") - 1) * 100)
    ds = F.when(F.col("dn") > 1, F.col("dsd")).otherwise(F.col("sd"))
    return a.select(key, safe_div("m", "sd").alias("_s"), (F.when(ds > 0, F.col("m") / ds).otherwise(0.0) * k).alias("sortino"), "max_drawdown_pct", "total_return_pct",
                    F.when(F.col("max_drawdown_pct") < 0, F.col("total_return_pct") / F.abs("max_drawdown_pct")).otherwise(0.0).alias("calmar")
                    ).withColumn("sharpe", F.col("_s") * k).drop("_s")


def kelly_parts(wr: Column, aw: Column, al: Column) -> Column:
    return wr - (1 - wr) / (aw / al)


def kelly_from_trades(trades: DataFrame, fraction: float = 0.25, max_risk_pct: float = 2.0, conf: float = 0.95) -> DataFrame:
    p = F.col("net_pnl_pct")
    a = trades.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(p > 0, 1)).alias("nw"), F.count(F.when(p < 0, 1)).alias("nl"),
                                       F.avg(F.when(p > 0, p)).alias("avg_win_pct"), F.abs(F.avg(F.when(p < 0, p))).alias("avg_loss_pct"),
                                       F.sum(F.when(p > 0, p)).alias("gw"), F.abs(F.sum(F.when(p < 0, p))).alias("gl"), F.avg("net_pnl_pct").alias("m"), F.stddev_pop("net_pnl_pct").alias("sd"))
    a = a.where("n >= 5 and nw > 0 and nl > 0").withColumn("wr", F.col("nw") / F.col("n"))
    wr, n = F.col("wr"), F.col("n")
    fk = kelly_parts(wr, F.col("avg_win_pct"), F.col("avg_loss_pct"))
    half = t_quantile((1 + conf) / 2, n - 1) * F.sqrt(wr * (1 - wr) / n)
    a = a.withColumn("full_kelly", fk)
    k = F.col("full_kelly")
    return a.select("strategy", "n", (wr * 100).alias("win_rate_pct"), (F.greatest(F.lit(0.0), wr - half) * 100).alias("ci_lower_pct"),
                    (F.least(F.lit(1.0), wr + half) * 100).alias("ci_upper_pct"), "avg_win_pct", "avg_loss_pct", (F.col("avg_win_pct") / F.col("avg_loss_pct")).alias("reward_risk"),
                    (wr * F.col("avg_win_pct") - (1 - wr) * F.col("avg_loss_pct")).alias("expected_value_pct"), (k * 100).alias("full_kelly_pct"), (k * fraction * 100).alias("fractional_kelly_pct"),
                    (F.least(F.greatest(k * fraction, F.lit(0.0)), F.lit(max_risk_pct / 100)) * 100).alias("safe_kelly_pct"),
                    case((k < 0, "NO_EDGE"), (k < 0.05, "WEAK"), (k < 0.15, "MODERATE"), default="STRONG").alias("edge"), safe_div("gw", "gl", 9999.0).alias("profit_factor"),
                    F.when(F.col("sd") > 0, F.col("m") / F.col("sd") * math.sqrt(ANN)).otherwise(0.0).alias("sharpe"),
                    (1 - phi((wr - 0.5) / F.sqrt(0.25 / n))).alias("p_value"))


def cvar_kelly(trades: DataFrame, tail: DataFrame, limit: float = 0.02, fraction: float = 0.25) -> DataFrame:
    """Kelly fraction per symbol, cut so that |CVaR| x fraction stays inside the budget. tail: output of ``risk.var_cvar``."""
    p = F.col("net_pnl_pct")
    a = trades.groupBy("symbol").agg(F.avg(flag(p > 0)).alias("wr"), F.avg(F.when(p > 0, p)).alias("aw"), F.abs(F.avg(F.when(p < 0, p))).alias("al")).where("wr > 0 and wr < 1 and al > 0")
    a = a.join(tail.select("symbol", "cvar_hist", "cvar_cf"), "symbol").withColumn("fk", kelly_parts(F.col("wr"), F.col("aw"), F.col("al")))
    a = a.withColumn("frac", F.greatest(F.lit(0.0), F.col("fk") * fraction)).withColumn("at", F.abs(F.least("cvar_hist", "cvar_cf")) * F.col("frac"))
    k = F.when(F.col("at") > limit, F.col("frac") * limit / F.col("at")).otherwise(F.col("frac"))
    return a.select("symbol", (F.col("fk") * 100).alias("full_kelly_pct"), (F.col("frac") * 100).alias("frac_kelly_pct"), (k * 100).alias("cvar_kelly_pct"),
                    F.when(F.col("fk") <= 0, 0.0).otherwise(F.least(k, F.lit(0.03)) * 100).alias("recommended_pct"),
                    case((F.col("fk") <= 0, "NEGATIVE_EDGE"), (F.col("at") > limit, "CVAR"), default="KELLY").alias("binding"))


def rolling_half_kelly(trades: DataFrame, n: int = 50, min_trades: int = 20, equity: float = 10000.0, default: float = 50.0) -> DataFrame:
    """Half-Kelly size after every trade from the last n trades, between 10 USD and 3 % of equity."""
    b = blocked(trades.select("strategy", *EXIT_ORDER, "net_pnl_pct"), ["strategy"], EXIT_ORDER, _chunk(), before=n)
    f, p = b.frame(n), F.col("net_pnl_pct")
    d = b.add(cnt=F.count(F.lit(1)).over(f), w=F.count(F.when(p > 0, 1)).over(f), aw=F.avg(F.when(p > 0, p)).over(f),
              al=F.avg(F.when(p <= 0, -p)).over(f)).done()
    pr = F.col("w") / F.col("cnt")
    bb = F.coalesce("aw", F.lit(0.01)) / F.coalesce("al", F.lit(0.01))
    half = F.greatest(F.lit(0.0), (pr * bb - (1 - pr)) / bb / 2)
    size = clamp(equity * half / 100, 10.0, equity * 0.03)
    ok = (F.col("cnt") >= min_trades) & (F.coalesce("al", F.lit(0.01)) > 0)
    return d.select("strategy", "trade_id", F.when(ok, size).otherwise(default).alias("size_usd"), (pr * 100).alias("win_rate_pct"), (F.col("cnt") >= min_trades).alias("ready"))


def position_size(orders: DataFrame, balance: float = 30000.0, risk_pct: float = 1.0, leverage: float = 1.0) -> DataFrame:
    e, s = F.col("entry_price"), F.col("stop_price")
    d0 = F.abs(e - s)
    x = orders.where((e > 0) & (s > 0) & (d0 * leverage >= 1e-10))
    m = F.when(s < e, 1.0).otherwise(-1.0)
    u = balance * risk_pct / 100 / (d0 * leverage)
    return x.select("position_id", F.when(s < e, "LONG").otherwise("SHORT").alias("direction"), F.lit(balance * risk_pct / 100).alias("dollar_risk"), u.alias("units"),
                    (u * e).alias("notional"), (u * e / balance * 100).alias("pct_of_account"), (d0 / e * 100).alias("sl_distance_pct"), (u * e / leverage).alias("margin"),
                    *[(e + k * m * d0).alias(f"target_{k}r") for k in (1, 2, 3)])


def vol_target_size(orders: DataFrame, target: float = 0.10, balance: float = 30000.0, cap: float = 3.0) -> DataFrame:
    """Needs entry_price and vol_ann."""
    raw, top = balance * target / (F.col("entry_price") * F.col("vol_ann")), balance * cap / F.col("entry_price")
    u = F.least(raw, top)
    return orders.where("vol_ann > 0 and entry_price > 0").select(
        "position_id", u.alias("units"), (u * F.col("entry_price")).alias("position_usd"), (u * F.col("entry_price") / balance * 100).alias("pct_of_account"),
        (target / F.col("vol_ann")).alias("vol_scalar"), (raw > top).alias("cap_applied"))


def execution_cost(orders: DataFrame, days: int = 1, commission_bps: float = 3.0, spread_bps: float = 2.0, eta: float = 0.1) -> DataFrame:
    """Square-root market impact. Needs size_usd, adv_usd, vol_ann."""
    x = orders.where("adv_usd > 0 and vol_ann > 0 and size_usd > 0").withColumn("dv", F.col("vol_ann") / math.sqrt(ANN))
    part = F.col("size_usd") / F.col("adv_usd")
    x = x.withColumns({"impact_bps": eta * F.col("dv") * F.sqrt(part / days) * 10000, "participation_pct": part * 100,
                       "max_capacity_usd": F.round(F.pow(0.002 / (eta * F.col("dv")), 2) * F.col("adv_usd") * days, 0)})
    t = commission_bps + spread_bps / 2 + F.col("impact_bps")
    return x.select("position_id", "participation_pct", "impact_bps", t.alias("total_cost_bps"), (F.col("size_usd") * t / 10000).alias("total_cost_usd"), "max_capacity_usd",
                    (F.col("size_usd") > F.col("max_capacity_usd") * 0.8).alias("capacity_warning"))


def portfolio_heat(positions: DataFrame, equity: float = 1e6, max_heat: float = 0.15) -> DataFrame:
    """Needs account, entry_price, stop_price, size_usd; quantity = size / entry."""
    q = F.col("size_usd") / F.col("entry_price")
    a = positions.groupBy("account").agg(F.count(F.lit(1)).alias("n_open"), (F.sum(F.abs(F.col("entry_price") - F.col("stop_price")) * F.abs(q)) / equity).alias("h"))
    h = F.col("h")
    return a.select("account", "n_open", (h * 100).alias("heat_pct"), (F.greatest(F.lit(0.0), max_heat - h) * 100).alias("remaining_heat_pct"), (h < max_heat * 0.9).alias("can_add"),
                    (h / max_heat * 100).alias("utilization_pct"), case((h < 0.05, "OFFENSIVE"), (h < 0.10, "STANDARD"), (h < 0.13, "DEFENSIVE"), default="MAXED_OUT").alias("risk_mode"))


def exposure_report(positions: DataFrame, clusters: DataFrame, capital: float, cluster_cap: float = 0.25, symbol_cap: float = 0.15, budget: float = 0.30) -> DataFrame:
    """USD by cluster, by symbol and direction, and by strategy in one grouping-sets pass; cap breaches and
    symbols held in one direction by several strategies. clusters: (symbol, cluster), a small dimension."""
    x = positions.join(clusters, "symbol", "left").withColumn("cluster", F.coalesce("cluster", F.concat(F.lit("STANDALONE_"), "symbol")))
    c = [F.col(k) for k in ("cluster", "symbol", "direction", "strategy")]
    g = x.groupingSets([[c[0]], [c[1], c[2]], [c[3]]], *c).agg(F.grouping_id().alias("gid"), F.sum("size_usd").alias("usd"), F.count_distinct("strategy").alias("n_strategies"))
    kind = case((F.col("gid") == 7, "CLUSTER"), (F.col("gid") == 9, "SYMBOL"), default="STRATEGY")
    g = g.select(kind.alias("kind"), F.coalesce("cluster", F.concat_ws("_", "symbol", "direction"), "strategy").alias("k0"), "strategy", "usd", "n_strategies")
    g = g.withColumn("key", F.when(F.col("kind") == "STRATEGY", F.col("strategy")).otherwise(F.col("k0")))
    cap = case((F.col("kind") == "CLUSTER", cluster_cap), (F.col("kind") == "SYMBOL", symbol_cap), default=budget) * capital
    return g.select("kind", "key", "usd", cap.alias("cap_usd"), (F.col("usd") / cap * 100).alias("utilization_pct"), (F.col("usd") > cap).alias("breach"),
                    ((F.col("kind") == "SYMBOL") & (F.col("n_strategies") > 1)).alias("duplicate"))


def strategy_scalar(trades: DataFrame, window: int = 20, min_trades: int = 10, halt: float = 0.0, reduce: float = 0.5, boost: float = 1.5) -> DataFrame:
    t = last_rows(trades.select("strategy", *EXIT_ORDER, "net_pnl_pct"), ["strategy"], EXIT_ORDER, window)
    p = F.col("net_pnl_pct")
    a = t.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.avg("net_pnl_pct").alias("m"), F.stddev_samp("net_pnl_pct").alias("sd"), F.avg(flag(p > 0)).alias("win_rate"),
                                  F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("w"), F.abs(F.coalesce(F.sum(F.when(p < 0, p)), F.lit(0.0))).alias("l"))
    a = a.withColumn("sharpe", F.when((F.col("n") >= 5) & (F.col("sd") > 1e-12), F.col("m") / F.col("sd")).otherwise(0.0))
    s = F.col("sharpe")
    return a.select("strategy", "sharpe", "win_rate", F.when(F.col("l") > 1e-12, F.col("w") / F.col("l")).otherwise(F.when(F.col("w") > 0, 9.9).otherwise(0.0)).alias("profit_factor"),
                    case((F.col("n") < min_trades, 1.0), (s <= halt, 0.0), (s < reduce, clamp(0.6 + (s - halt) / (reduce - halt + 1e-12) * 0.4, 0.6, 1.0)), (s > boost, 1.2), default=1.0).alias("size_scalar"))


def triple_barrier_outcomes(signals: DataFrame, k: int = 10, partial_rr: float = 1.5, partial_frac: float = 0.5, be_rr: float = 1.0, commission_pct: float = 0.1) -> DataFrame:
    """First stop / target / time exit of each signal inside its next k bars, with break-even move and partial target.
    signals: entry, stop, target, direction and ``path`` = array of the next bars (ts, high, low, close), at most k long.
    Break-even is armed before the stop is checked on the same bar, the stop before the target. One unit per signal."""
    s = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    x = signals.withColumns({"_s": s, "_d": F.greatest(F.abs(F.col("entry") - F.col("stop")), F.col("entry") * 0.002)})
    x = x.withColumns({"_p": F.col("entry") + F.col("_s") * F.col("_d") * partial_rr, "_b": F.col("entry") + F.col("_s") * F.col("_d") * be_rr})
    nul = lambda t: F.lit(None).cast(t)
    start = F.struct(F.lit(False).alias("part"), F.lit(False).alias("be"), nul("double").alias("px"), nul("string").alias("why"), nul("timestamp").alias("at"))

    def step(a, r):
        fav = F.when(F.col("_s") > 0, r["high"]).otherwise(-r["low"])  # best price of the bar, seen from the position
        adv = F.when(F.col("_s") > 0, r["low"]).otherwise(-r["high"])
        part = a["part"] | (fav >= F.col("_s") * F.col("_p"))
        be = a["be"] | (fav >= F.col("_s") * F.col("_b"))
        sl = F.when(be, F.col("entry")).otherwise(F.col("stop"))
        hit_sl, hit_tp = adv <= F.col("_s") * sl, fav >= F.col("_s") * F.col("target")
        px = F.when(hit_sl, sl).when(hit_tp, F.col("target"))
        why = F.when(hit_sl, F.when(be, "BE_EXIT").otherwise("SL_HIT")).when(hit_tp, "TP_HIT")
        nxt = F.struct(part.alias("part"), be.alias("be"), px.alias("px"), why.alias("why"), F.when(px.isNotNull(), r["ts"]).alias("at"))
        return F.when(a["why"].isNotNull(), a).otherwise(nxt)

    x = x.where(F.size("path") > 0).withColumn("_x", F.aggregate("path", start, step))
    last = F.element_at("path", -1)
    x = x.withColumns({"exit_price": F.coalesce("_x.px", last["close"]), "exit_reason": F.coalesce("_x.why", F.lit("TIME_EXIT")), "exit_at": F.coalesce("_x.at", last["ts"]), "partial": F.col("_x.part")})
    left = F.when(F.col("partial"), 1 - partial_frac).otherwise(1.0)
    booked = F.when(F.col("partial"), partial_frac).otherwise(0.0)
    raw = F.col("_s") * ((F.col("exit_price") - F.col("entry")) * left + (F.col("_p") - F.col("entry")) * booked)
    fee = (F.col("entry") + F.col("exit_price") * left + F.col("_p") * booked) * commission_pct / 100
    x = x.withColumns({"net_pct": (raw - fee) / F.col("entry") * 100, "_fee": fee / F.col("entry") * 100})
    return x.withColumn("outcome", case((F.col("net_pct") > 1e-4, "WIN"), ((F.col("exit_reason") == "BE_EXIT") | (F.abs("net_pct") <= F.col("_fee") * 1.5), "BE"), default="LOSS")
                        ).drop("_s", "_d", "_p", "_b", "_x", "_fee", "path")


def revenge_flags(trades: DataFrame, minutes: int = 15, losses: int = 3, key: str = "strategy") -> DataFrame:
    """Three losses or more within the trailing window at a trade's exit."""
    t = trades.select(key, *EXIT_ORDER, F.unix_timestamp("exit_ts").alias("s"), (F.col("net_pnl_usd") < 0).cast("int").alias("loss"))
    d = trailing_sum(t.where("loss = 1").select(key, "s", F.lit(1).cast("long").alias("loss")), t.select(key, "s", *EXIT_ORDER), [key], "s", "loss", minutes * 60, TICK_CHUNK, "recent_losses")
    return d.select(key, "trade_id", "exit_ts", "recent_losses", (F.col("recent_losses") >= losses).alias("revenge"))


def daily_loss_lock(trades: DataFrame, initial: float = 1e6, limit_pct: float = 2.0, key: str = "strategy") -> DataFrame:
    """Per trade: day profit in % of the balance at the start of the day, locked from the first breach to the day's end."""
    t = indexed(trades.select(key, *EXIT_ORDER, "net_pnl_usd"), [key], EXIT_ORDER, time_chunk("exit_ts", TICK_CHUNK))
    at = F.floor(F.col("_i") / BLOCK_ROWS).cast("long")
    t = running(t, [key], ["_i"], at, sums={"_sum": "net_pnl_usd"})
    t = day_starts(t, [key], F.to_date("exit_ts"), F.col("_sum") - F.col("net_pnl_usd"))
    t = t.withColumn("day_start", initial + F.col("_day.x")).withColumn("day_pnl_pct", (F.col("_sum") - F.col("_day.x")) / F.greatest("day_start", F.lit(1.0)) * 100)
    t = running(t, [key], ["_i"], at, maxs={"_breach": F.when(F.col("day_pnl_pct") <= -limit_pct, F.col("_i"))})
    return t.select(key, "trade_id", "exit_ts", "day_start", "day_pnl_pct", F.coalesce(F.col("_breach") >= F.col("_day.at"), F.lit(False)).alias("locked"))


def pre_trade_flags(orders: DataFrame, state: DataFrame, initial: float = 10000.0, risk_limit: float = 1.0, max_trades: int = 5, max_dd: float = 10.0) -> DataFrame:
    """Risk %, warnings and rejections of each proposed order against the account's latest balance at that time.
    orders: account, ts, order_id, entry_price, stop_price, size_usd; state: account, ts, trade_id, balance.
    The as-of lookup is a running maximum of (ts, trade_id, balance) over both streams, and the day's orders are counted in the same pass: rows are shuffled
    once; a day that a crowded chunk splits is counted on from its earlier chunks."""
    o = orders.select("account", "ts", "order_id", "entry_price", "stop_price", "size_usd", F.lit(None).cast("struct<ts:timestamp,id:bigint,balance:double>").alias("st"), F.lit(1).alias("kind"))
    s = state.select("account", "ts", F.col("trade_id").alias("order_id"), *[F.lit(None).cast("double").alias(k) for k in ("entry_price", "stop_price", "size_usd")],
                     F.struct("ts", F.col("trade_id").alias("id"), "balance").alias("st"), F.lit(0).alias("kind"))
    rows = _chunked(o.unionByName(s), ["account"], ["ts"], time_chunk("ts", TICK_CHUNK * 366)).withColumn("_day", F.to_date("ts"))
    past = (Window.unboundedPreceding, -1)
    carry = rows.groupBy("account", "_chunk").agg(F.max("st").alias("_st")).select(
        "account", "_chunk", F.max("_st").over(Window.partitionBy("account").orderBy("_chunk").rowsBetween(*past)).alias("_st"))
    # only days that begin in an earlier chunk: less than one a chunk
    days = rows.where("kind = 1").groupBy("account", "_chunk", "_day").agg(F.count(F.lit(1)).alias("_m"))
    split = days.select("account", "_chunk", "_day", F.sum("_m").over(Window.partitionBy("account", "_day").orderBy("_chunk").rowsBetween(*past)).alias("_earlier")).where("_earlier > 0")
    to_now = lambda *keys: Window.partitionBy("account", "_chunk", *keys).orderBy(*[k for k in ("_day", "ts", "kind", "order_id") if k not in keys]).rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumns({"_last": F.max("st").over(to_now()), "_seen": F.sum("kind").over(to_now("_day"))}).where("kind = 1")
    x = x.join(carry, ["account", "_chunk"]).join(F.broadcast(split), ["account", "_chunk", "_day"], "left").withColumn("last", F.greatest("_st", "_last"))
    today = F.when(F.col("ts").isNull(), 0).otherwise(F.col("_seen") - 1 + F.coalesce("_earlier", F.lit(0)))
    x = x.withColumns({"balance": F.coalesce("last.balance", F.lit(initial)), "trades_today": today.cast("int")})
    x = x.withColumn("risk_pct", F.abs(F.col("entry_price") - F.col("stop_price")) * (F.col("size_usd") / F.greatest("entry_price", F.lit(1.0))) / F.greatest("balance", F.lit(1.0)) * 100)
    dd = (F.col("balance") - initial) / initial * 100
    r = F.col("risk_pct")
    x = x.withColumns({"warnings": F.concat_ws(",", F.when((r > risk_limit) & (r <= 2 * risk_limit), "RISK"), F.when(F.col("trades_today") >= max_trades, "TRADE_COUNT")),
                       "rejections": F.concat_ws(",", F.when(r > 2 * risk_limit, "RISK"), F.when(dd <= -max_dd, "DRAWDOWN"))})
    return x.select("account", "order_id", "balance", "risk_pct", "trades_today", "warnings", "rejections", (F.col("rejections") == "").alias("approved"))


def threshold_advice(trades: DataFrame, window: int = 20, min_move: float = 0.005, ofi_floor: float = 0.20) -> DataFrame:
    """Win rate of the last 20 trades above 65 % loosens the entry thresholds, below 50 % tightens them."""
    t = last_rows(trades.select("strategy", *EXIT_ORDER, "net_pnl_usd"), ["strategy"], EXIT_ORDER, window)
    a = t.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), (F.avg(flag(F.col("net_pnl_usd") > 0)) * 100).alias("win_rate_pct")).where(F.col("n") >= window)
    adv = case((F.col("win_rate_pct") > 65, "LOOSEN"), (F.col("win_rate_pct") < 50, "TIGHTEN"), default="KEEP")
    a = a.withColumn("advice", adv)
    v = lambda lo, hi, base: case((F.col("advice") == "LOOSEN", lo), (F.col("advice") == "TIGHTEN", hi), default=base)
    return a.select("strategy", "win_rate_pct", "advice", v(max(0.001, min_move - 0.001), min(0.015, min_move + 0.001), min_move).alias("min_move_pct"),
                    v(max(0.05, ofi_floor - 0.03), min(0.45, ofi_floor + 0.03), ofi_floor).alias("ofi_floor"))
