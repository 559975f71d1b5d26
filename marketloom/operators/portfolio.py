"""Pair, factor and portfolio relations over return rows, and scenario stress."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ANN, case, clamp, safe_div
from ..plans import order_stats, quantiles

S = math.sqrt(ANN)


def factor_beta(rets: DataFrame, factors: DataFrame) -> DataFrame:
    """Beta (sample covariance over population variance), correlation and R2 of every symbol against every factor
    (factors: factor, ts, f), and the alpha share left over."""
    x = rets.select("symbol", "ts", "r").join(factors, "ts")
    a = x.groupBy("symbol", "factor").agg(F.covar_samp("r", "f").alias("cv"), F.var_pop("f").alias("vf"), F.corr("r", "f").alias("correlation"))
    a = a.withColumns({"beta": F.when(F.col("vf") > 0, F.col("cv") / F.col("vf")).otherwise(0.0), "r_squared": F.col("correlation") * F.col("correlation")})
    tot = a.groupBy("symbol").agg(F.sum("r_squared").alias("t"))
    return a.join(tot, "symbol").select("symbol", "factor", "beta", "correlation", "r_squared", F.least("t", F.lit(1.0)).alias("total_r2"), F.greatest(1 - F.col("t"), F.lit(0.0)).alias("alpha_r2"))


def cluster_pairs(members: DataFrame, diagonal: bool = True) -> DataFrame:
    """Pairs a <= b (or a < b) inside each cluster of a symbol dimension (symbol, cluster): the pairs the caller asks for."""
    b = members.select(F.col("symbol").alias("b"), "cluster")
    x = members.select(F.col("symbol").alias("a"), "cluster").join(b, "cluster")
    return x.where(F.col("a") <= F.col("b") if diagonal else F.col("a") < F.col("b"))


def pair_rows(rets: DataFrame, pairs: DataFrame, col: str = "r") -> DataFrame:
    """Aligned rows (cluster, a, b, ts, x, y): two equi-joins, output proportional to requested pairs."""
    one = rets.select(F.col("symbol").alias("a"), "ts", F.col(col).alias("x"))
    two = rets.select(F.col("symbol").alias("b"), "ts", F.col(col).alias("y"))
    return pairs.join(one, "a").join(two, ["b", "ts"])


def return_covariance(rets: DataFrame, pairs: DataFrame) -> DataFrame:
    g = pair_rows(rets, pairs).groupBy("cluster", "a", "b")
    return g.agg(F.count(F.lit(1)).alias("n"), (F.covar_samp("x", "y") * ANN).alias("cov_ann"), F.corr("x", "y").alias("correlation"))


def _full(cov: DataFrame) -> DataFrame:
    flip = cov.where("a <> b").select("cluster", F.col("b").alias("a"), F.col("a").alias("b"), "n", "cov_ann", "correlation")
    return cov.select("cluster", "a", "b", "n", "cov_ann", "correlation").unionByName(flip)


def shrinkage_covariance(cov: DataFrame, method: str = "trace") -> DataFrame:
    """Shrink each cluster's covariance towards its mean variance. ``trace``: rho = (1/T) d / (d + 1e-12) with
    d = tr S2 - (tr S)2 / N; ``oracle``: rho = ((T-2)/T tr S2 + (tr S)2) / ((T+2) d); both clipped to [0, 1]."""
    off = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    m = cov.groupBy("cluster").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("cov_ann"))).alias("tr"), F.sum(off * F.col("cov_ann") * F.col("cov_ann")).alias("tr2"),
                                   F.count(F.when(F.col("a") == F.col("b"), 1)).alias("nn"), F.min("n").alias("t"))
    d = F.col("tr2") - F.col("tr") * F.col("tr") / F.col("nn")
    if method == "trace":
        rho = (1 / F.col("t")) * d / (d + 1e-12)
    else:
        rho = ((F.col("t") - 2) / F.col("t") * F.col("tr2") + F.col("tr") * F.col("tr")) / F.greatest((F.col("t") + 2) * d, F.lit(1e-12))
    m = m.select("cluster", clamp(rho, 0.0, 1.0).alias("rho"), (F.col("tr") / F.col("nn")).alias("mv"))
    x = cov.join(m, "cluster")
    return x.select("cluster", "a", "b", "rho", ((1 - F.col("rho")) * F.col("cov_ann") + F.when(F.col("a") == F.col("b"), F.col("rho") * F.col("mv")).otherwise(0.0)).alias("cov_shrunk"))


def correlation_clusters(cov: DataFrame, thr: float = 0.7) -> DataFrame:
    """Greedy groups in symbol order: a symbol with no earlier leader above the threshold leads, others join their first leader.
    Rounds settle every symbol whose earlier neighbours are settled; the symbol table is small next to the bars."""
    from ..session import checkpointed

    edges = checkpointed(cov.where((F.col("a") < F.col("b")) & (F.abs("correlation") > thr)).select("cluster", "a", "b", "correlation"))
    nodes = cov.where("a = b").select("cluster", F.col("a").alias("s"))
    todo, leaders = nodes, None
    while True:
        live = edges.join(todo.select("cluster", F.col("s").alias("a")), ["cluster", "a"], "left_semi").join(todo.select("cluster", F.col("s").alias("b")), ["cluster", "b"], "left_semi")
        new = todo.join(live.select("cluster", F.col("b").alias("s")), ["cluster", "s"], "left_anti")
        hit = edges.join(new.select("cluster", F.col("s").alias("a")), ["cluster", "a"], "left_semi").select("cluster", F.col("b").alias("s"))
        leaders = new if leaders is None else leaders.unionByName(new)
        leaders = checkpointed(leaders)
        todo = checkpointed(todo.join(new, ["cluster", "s"], "left_anti").join(hit, ["cluster", "s"], "left_anti"))
        if todo.isEmpty():
            break
    led = edges.join(leaders.select("cluster", F.col("s").alias("a")), ["cluster", "a"], "left_semi").join(leaders.select("cluster", F.col("s").alias("b")), ["cluster", "b"], "left_anti")
    first = led.groupBy("cluster", "b").agg(F.min(F.struct("a", "correlation")).alias("l")).select("cluster", F.col("l.a").alias("leader"), "b", F.col("l.correlation").alias("c"))
    return first.groupBy("cluster", "leader").agg((F.count(F.lit(1)) + 1).alias("size"), F.avg("c").alias("avg_corr"),
                                                  F.concat_ws(",", F.array_sort(F.collect_list("b"))).alias("members"))


def portfolio_returns(rets: DataFrame, weights: DataFrame) -> DataFrame:
    """weights: (portfolio, symbol, w) -> (portfolio, ts, pr); partial sums combine before the shuffle."""
    return rets.select("symbol", "ts", "r").join(weights, "symbol").groupBy("portfolio", "ts").agg(F.sum(F.col("w") * F.col("r")).alias("pr"))


def portfolio_scan(rets: DataFrame, weights: DataFrame, rf: float = 0.04, conf: float = 0.95) -> DataFrame:
    """Score every weight vector by return, volatility, Sharpe and CVaR; flag the best per objective."""
    pr = portfolio_returns(rets, weights)
    q = quantiles(pr, ["portfolio"], "pr", {"v": 1 - conf})
    a = pr.join(q, "portfolio").groupBy("portfolio").agg((F.avg("pr") * ANN).alias("ret"), (F.stddev_pop("pr") * S).alias("vol"), (-F.avg(F.when(F.col("pr") <= F.col("v"), F.col("pr")))).alias("cvar"))
    # `best` is one row
    a = a.withColumns({"sharpe": (F.col("ret") - rf) / F.greatest("vol", F.lit(1e-12))})
    best = a.groupBy().agg(F.max_by("portfolio", "sharpe").alias("bs"), F.min_by("portfolio", "vol").alias("bv"), F.min_by("portfolio", "cvar").alias("bc"))
    p = F.col("portfolio")
    return a.crossJoin(best).select("portfolio", "ret", "vol", "sharpe", "cvar", (p == F.col("bs")).alias("best_sharpe"), (p == F.col("bv")).alias("min_vol"), (p == F.col("bc")).alias("min_cvar"))


def inverse_variance_weights(cov: DataFrame) -> DataFrame:
    """Weights proportional to 1 / variance in each cluster, and every symbol's share of the portfolio variance."""
    v = cov.where("a = b").select("cluster", F.col("a").alias("s"), (1 / F.col("cov_ann")).alias("iv"))
    w = v.join(v.groupBy("cluster").agg(F.sum("iv").alias("t")), "cluster").select("cluster", "s", (F.col("iv") / F.col("t")).alias("w"))
    x = _full(cov).join(w.select("cluster", F.col("s").alias("a"), F.col("w").alias("wa")), ["cluster", "a"]).join(w.select("cluster", F.col("s").alias("b"), F.col("w").alias("wb")), ["cluster", "b"])
    m = x.groupBy("cluster", "a").agg((F.first("wa") * F.sum(F.col("cov_ann") * F.col("wb"))).alias("mc"), F.first("wa").alias("weight"))
    t = m.groupBy("cluster").agg(F.sum("mc").alias("pv"))
    return m.join(t, "cluster").select("cluster", F.col("a").alias("symbol"), "weight", (F.col("mc") / F.col("pv") * 100).alias("risk_contribution_pct"))


# Uniform portfolio shocks; the rate shock runs evenly from -15 % to -25 % across the assets.
SHOCKS = [("GFC_2008", -0.40), ("COVID_2020", -0.35), ("DotCom_2000", -0.50), ("Flash_crash_1d", -0.08)]


def stress_shock(weights: DataFrame, rets: DataFrame) -> DataFrame:
    """Portfolio loss under each scenario, limit check, best and worst scenario, and the mean of the worst 5 % of history."""
    w = Window.partitionBy("portfolio").orderBy("symbol")  # the assets of one portfolio
    x = weights.withColumns({"k": F.row_number().over(w) - 1, "m": F.count(F.lit(1)).over(Window.partitionBy("portfolio")), "tw": F.sum("w").over(Window.partitionBy("portfolio"))})
    rate = -0.15 - 0.10 * F.col("k") / F.greatest(F.col("m") - 1, F.lit(1))
    sc = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(v).alias("shock")) for n, v in SHOCKS], F.struct(F.lit("Rate_shock_300").alias("scenario"), rate.alias("shock"))))
    p = x.select("portfolio", "w", "tw", sc.alias("s")).groupBy("portfolio", "s.scenario").agg((F.sum(F.col("w") / F.col("tw") * F.col("s.shock")) * 100).alias("pl_pct"))
    pr = portfolio_returns(rets, weights)
    st = order_stats(pr, ["portfolio"], "pr", {"v": lambda n: F.greatest(F.lit(1), F.floor(n * 0.05)) - 1}).select("portfolio", "v", F.greatest(F.lit(1), F.floor(F.col("_n") * 0.05)).alias("k"))
    h = pr.join(st, "portfolio").groupBy("portfolio").agg(F.coalesce(F.sum(F.when(F.col("pr") < F.col("v"), F.col("pr"))), F.lit(0.0)).alias("sl"), F.count(F.when(F.col("pr") < F.col("v"), 1)).alias("nl"), F.first("v").alias("v"), F.first("k").alias("k"))
    h = h.select("portfolio", ((F.col("sl") + (F.col("k") - F.col("nl")) * F.col("v")) / F.col("k") * 100).alias("historical_worst5_pct"))
    ext = p.groupBy("portfolio").agg(F.min_by("scenario", F.struct("pl_pct", "scenario")).alias("ws"), F.max_by("scenario", F.struct("pl_pct", "scenario")).alias("bs"))
    y = p.join(ext, "portfolio").join(h, "portfolio")
    return y.select("portfolio", "scenario", "pl_pct", (F.col("pl_pct") > -25).alias("within_limit"), (F.col("scenario") == F.col("ws")).alias("worst"), (F.col("scenario") == F.col("bs")).alias("best"), "historical_worst5_pct")


# Daily returns in percent of five historical crises.
CRISES = {
    "covid_crash_2020": [-0.5, -1.2, 0.3, -2.1, -3.4, -9.5, 4.9, -5.2, -4.9, -12.0, 6.0, -5.1, 1.2, -7.6, 0.8, 9.4, -3.0, 6.2, -2.5, 5.1, 3.4, -0.8, 2.3, 1.5, 3.8,
                         2.1, 1.9, 4.5, 3.1, 2.8, 1.5, 2.3, 1.1],
    "ftx_collapse_2022": [-2.0, -8.5, -3.1, -14.0, -5.2, 4.1, -3.8, -2.9, 2.5, -1.8, 1.2, 3.4, 1.8, 2.1],
    "fed_tightening_2022": [-1.5, -0.8, -2.3, 1.2, -3.1, -0.5, 0.8, -1.9, -0.7, -2.5, 1.1, -0.9, -1.8, 0.4, -3.5, 2.1, -1.2, -0.6, 0.9, -2.8, -0.3, -1.7, 0.6, -2.2,
                            -0.8, 1.5, -1.4, -0.5, 0.7, -3.1, -1.0, -0.9, 0.8, -1.6, 0.3, -2.7, -0.4, 1.2, -0.8, -1.9, -0.6, 0.5, -2.1, -0.7, 1.0, -1.5, -0.3, 0.9,
                            -1.8, -0.5, 0.8, -2.4, -0.6, 1.1, -1.3, -0.8, 0.4, -2.0, -0.9, 0.7],
    "luna_collapse_2022": [-3.5, -8.2, -15.0, -25.0, -12.0, 5.2, 3.8],
    "gfc_2008": [-3.8, -4.7, -1.2, 3.5, -8.0, -4.7, -9.0, 11.6, -7.6, -4.8, -3.0, 2.5, -1.8, -4.6, 3.6, 5.7, -6.7, -5.5, -5.3, 4.2, -3.3, -5.1, -4.7, 4.9, -3.0, 2.1,
                 1.5, 3.0, 1.8, 2.0],
}


def scenario_column(scenarios: dict) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("scenario"), F.array(*[F.lit(float(v)) for v in seq]).alias("seq")) for n, seq in scenarios.items()])


def scenario_replay(positions: DataFrame, keys: list[str], balance: float, stop_pct: float = 5.0, scenarios: dict | None = None) -> DataFrame:
    """Day-by-day balance of each position (pos_usd) under each scenario, stopping out at the stop level.
    The path (at most 60 days) is folded inside the row."""
    x = positions.select(*keys, "pos_usd", F.explode(scenario_column(scenarios or CRISES)).alias("s"))
    sl = 1 - stop_pct / 100
    start = F.struct(F.lit(1.0).alias("px"), F.lit(float(balance)).alias("bal"), F.lit(float(balance)).alias("hi"), F.lit(float(balance)).alias("lo"), F.lit(0).alias("day"), F.lit(0).alias("stop"))

    def step(a, dr):
        px = a["px"] * (1 + dr / 100)
        hit = px * 0.995 <= sl
        pnl = F.col("pos_usd") * F.when(hit, sl / a["px"] - 1).otherwise(dr / 100)
        bal = F.greatest(F.lit(0.0), a["bal"] + pnl)
        nxt = F.struct(px.alias("px"), bal.alias("bal"), F.greatest(a["hi"], bal).alias("hi"), F.least(a["lo"], bal).alias("lo"), (a["day"] + 1).alias("day"), F.when(hit, a["day"] + 1).otherwise(0).alias("stop"))
        return F.when(a["stop"] > 0, a).otherwise(nxt)

    y = x.withColumn("r", F.aggregate("s.seq", start, step)).withColumn("total_pnl_pct", (F.col("r.bal") - balance) / balance * 100)
    p = F.col("total_pnl_pct")
    return y.select(*keys, "s.scenario", F.round(F.col("r.bal") - balance, 4).alias("total_pnl_usd"), "total_pnl_pct", ((F.col("r.lo") / F.col("r.hi") - 1) * 100).alias("max_drawdown_pct"),
                    (F.col("r.stop") > 0).alias("stopped_out"), F.when(F.col("r.stop") > 0, F.col("r.stop")).alias("stop_day"), case((p > -20, "SURVIVED"), (p > -50, "SEVERELY_DAMAGED"), default="WIPED_OUT").alias("rating"))


def tail_risk_report(positions: DataFrame, balance: float) -> DataFrame:
    """All crises on each account's total exposure (capped at 100 % of the balance): worst, best, average, rating."""
    a = positions.groupBy("account").agg((F.least(F.sum("size_usd") / balance * 100, F.lit(100.0)) / 100 * balance).alias("pos_usd"))
    r = scenario_replay(a, ["account"], balance)
    g = r.groupBy("account").agg(F.min_by("scenario", F.struct("total_pnl_pct", "scenario")).alias("worst_scenario"), F.min("total_pnl_pct").alias("worst_pct"),
                                 F.max_by("scenario", F.struct("total_pnl_pct", "scenario")).alias("best_scenario"), F.max("total_pnl_pct").alias("best_pct"), F.avg("total_pnl_pct").alias("avg_pct"))
    v = F.col("avg_pct")
    return g.withColumn("tail_risk_rating", case((v < -15, "HIGH"), (v < -8, "MODERATE"), default="LOW"))


# Total shock and its length in days.
PATH_SHOCKS = [("GFC_2008", -0.55, 250), ("COVID_2020", -0.34, 23), ("RATE_SHOCK_2022", -0.22, 200), ("FLASH_CRASH", -0.09, 1), ("LUNA_SPIRAL", -0.90, 14), ("3SIGMA_10DAYS", -0.30, 10)]


def geometric_shock_path(latest: DataFrame, gamma: float = 1.5) -> DataFrame:
    """Equity under a constant daily shock: trough against the floor and the risk scalar along the path.
    latest: (account, balance, peak, floor), one row per account."""
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(t).alias("shock"), F.lit(d).alias("days")) for n, t, d in PATH_SHOCKS]))
    x = latest.select("account", "balance", "peak", "floor", s.alias("s")).select("account", "balance", "peak", "floor", "s.*")
    daily = F.col("shock") / F.greatest("days", F.lit(1))
    eq = lambda d: F.col("balance") * F.pow(1 + daily, d.cast("double"))
    den = F.greatest(F.col("peak") - F.col("floor"), F.lit(1.0))
    raw = lambda d: (eq(d) - F.col("floor")) / den
    sc = lambda d: F.when(raw(d) <= 0, 0.0).otherwise(F.least(F.pow(raw(d), F.lit(gamma)), F.lit(1.0)))
    x = x.withColumns({"trough": eq(F.col("days")), "avg_scalar": F.aggregate(F.sequence(F.lit(0), F.col("days")), F.lit(0.0), lambda a, d: a + sc(d)) / (F.col("days") + 1)})
    br = F.col("trough") < F.col("floor")
    return x.select("account", "scenario", "trough", "floor", br.alias("breached"), (F.col("trough") - F.col("floor")).alias("margin_usd"), "avg_scalar", sc(F.col("days")).alias("trough_scalar"),
                    ((F.col("balance") - F.col("trough")) / F.greatest("balance", F.lit(1.0)) * 100).alias("drawdown_pct"),
                    case((br & (F.col("shock") < -0.20), "BREACHED_GAP_RISK"), (br, "BREACHED"), default="PROTECTED").alias("verdict"))
