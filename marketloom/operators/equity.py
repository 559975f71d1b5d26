"""Equity-curve protection: every rule is a running or bounded window over (account, ts, trade_id, balance)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ANN, RF_DAILY, case, clamp, flag, is_true, safe_div
from ..plans import BAR_CHUNK, Blocks, blocked, by_position, by_series, indexed, positioned, running, time_chunk

KEY, ORDER = ["account"], ["ts", "trade_id"]


def _chunk() -> Column:
    return time_chunk("ts", BAR_CHUNK)


def _peak(equity: DataFrame, initial: float) -> DataFrame:
    """Running peak, from the highest balance so far where the frame has it (_top)."""
    if "_top" in equity.columns:
        return equity.withColumn("peak", F.greatest("_top", F.lit(initial)))
    d = running(equity, KEY, *by_position(equity, ORDER, _chunk()), maxs={"peak": "balance"})
    return d.withColumn("peak", F.greatest("peak", F.lit(initial)))


def high_water_mark(equity: DataFrame, initial: float = 10000.0) -> DataFrame:
    """Running peak, drawdown from it and the time the peak was first reached."""
    x = equity.withColumn("_s", F.struct("balance", (-F.unix_micros("ts")).alias("t")))
    d = running(x, KEY, *by_position(x, ORDER, _chunk()), maxs={"_m": "_s"})
    pk = F.greatest("_m.balance", F.lit(initial))
    return d.select("account", "ts", "trade_id", "balance", pk.alias("peak"), ((pk - F.col("balance")) / pk * 100).alias("drawdown_pct"),
                    F.when(F.col("_m.balance") > initial, F.timestamp_micros(-F.col("_m.t"))).alias("peak_since"))


# Profit milestones in percent, each locking the floor of the one before.
MILESTONES = [(5.0, 0.0), (10.0, 5.0), (20.0, 10.0), (30.0, 20.0), (50.0, 30.0), (75.0, 50.0), (100.0, 75.0), (150.0, 100.0), (200.0, 150.0)]


def milestone_floor(equity: DataFrame, initial: float = 10000.0, ladder=tuple(MILESTONES), keep: tuple = ()) -> DataFrame:
    """Highest milestone ever reached -> locked floor (none before the first), headroom and progress to the next.
    The ladder is a plan-time constant, so it is a CASE chain rather than a join. keep: further columns of the rows."""
    d = _peak(equity, initial)
    ret = (F.col("peak") / initial - 1) * 100
    rows = list(ladder)
    tier = case(*[(ret >= lvl, k + 1) for k, (lvl, _) in reversed(list(enumerate(rows)))], default=0)
    d = d.withColumn("tier", tier)
    pick = lambda f: case(*[(F.col("tier") == k, f(k)) for k in range(len(rows) + 1) if f(k) is not None])
    d = d.withColumns({"floor": F.coalesce(pick(lambda k: initial * (1 + rows[k - 1][1] / 100) if k else None), F.lit(0.0)),
                       "next_target": pick(lambda k: initial * (1 + rows[k][0] / 100) if k < len(rows) else None)})
    b, f = F.col("balance"), F.col("floor")
    return d.select("account", "ts", "trade_id", "balance", "peak", "tier", "floor", F.greatest(F.lit(0.0), b - f).alias("headroom_usd"),
                    (safe_div(F.greatest(F.lit(0.0), b - f), f) * 100).alias("headroom_pct"),
                    F.when(F.col("next_target").isNotNull(), F.least(safe_div(b - f, F.col("next_target") - f) * 100, F.lit(100.0))).otherwise(0.0).alias("progress_pct"),
                    (b < f).alias("below_floor"), *keep)


def decay(x: Column, steepness: float = 8.0) -> Column:
    return 1 - 1 / (1 + F.exp(-steepness * (x - 0.5)))


def _hit(p: float) -> Column:
    return (F.col("balance") <= F.col("peak") * (1 - p)).cast("int")


def trailing_stop_level(equity: DataFrame, p: float = 0.15, warn: float = 0.08, initial: float = 10000.0, keep: tuple = ()) -> DataFrame:
    """Stop at peak (1 - p), warning band, trigger that stays on once hit (known where the frame has _trig), proximity and size scale. keep: further columns
    of the rows."""
    d = _peak(equity, initial)
    d = d.withColumns({"stop": F.col("peak") * (1 - p), "_hit": _hit(p)})
    if "_trig" not in d.columns:
        d = running(d, KEY, *by_position(d, ORDER, _chunk()), maxs={"_trig": "_hit"})
    b = F.col("balance")
    prox = clamp(1 - (b - F.col("stop")) / (F.col("peak") - F.col("stop")), 0.0, 1.0)
    d = d.withColumns({"triggered": F.col("_trig") == 1, "proximity": prox})
    d = d.withColumns({"trailing_scale": decay(F.greatest(F.lit(0.0), (F.col("proximity") - 0.5) * 2)), "warning": (b < F.col("peak") * (1 - warn)) & ~F.col("triggered")})
    return d.select("account", "ts", "trade_id", "balance", "peak", "stop", "triggered", "warning", "proximity", "trailing_scale",
                    case((F.col("triggered"), "HALTED"), (F.col("warning"), "WARNING"), default="ACTIVE").alias("status"), *keep)


def ratchet_floor(equity: DataFrame, step: float = 0.30, lock: float = 0.60, initial: float = 10000.0) -> DataFrame:
    """Floor that rises by lock x step percent for every step percent of peak gain, and the halt below it."""
    d = _peak(equity, initial)
    gain = (F.col("peak") - initial) / initial * 100
    d = d.withColumn("floor", initial * (1 + F.floor(gain / step) * step * lock / 100))
    return d.select("account", "ts", "trade_id", "balance", "peak", "floor", ((F.col("balance") <= F.col("floor")) & (F.col("floor") > initial)).alias("halt"))


def halt_latch(floors: DataFrame, cap_pct: float = 20.0, release: float = 1.02, initial: float = 10000.0) -> DataFrame:
    """Trading halt with hysteresis (account, ts, trade_id, balance, floor): set at the floor or at a hard drawdown from the initial
    capital, cleared only above release x floor. The state is the last event so far, a running maximum over row positions."""
    d = indexed(floors, KEY, ORDER, _chunk()).drop("_n")
    b, f = F.col("balance"), F.col("floor")
    code = case((b <= f, 1), ((initial - b) / initial * 100 >= cap_pct, 2), (b > f * release, 0))
    d = running(d.withColumn("_e", F.col("_i") * 4 + code), KEY, ["_i"], F.floor(F.col("_i") / 8192).cast("long"), maxs={"_last": "_e"})
    why = F.coalesce(F.col("_last") % 4, F.lit(0))
    return d.select("account", "ts", "trade_id", "balance", "floor", (why > 0).alias("halted"), case((why == 1, "FLOOR"), (why == 2, "HARD_DRAWDOWN"), default="NONE").alias("reason"))


def convex_risk_scalar(floors: DataFrame, gamma: float = 2.0) -> DataFrame:
    """((balance - floor) / (peak - floor)) ^ gamma in [0, 1]. Needs balance, peak, floor."""
    raw = (F.col("balance") - F.col("floor")) / F.greatest(F.col("peak") - F.col("floor"), F.lit(1.0))
    return floors.withColumn("risk_scalar", F.when(raw <= 0, 0.0).otherwise(F.least(F.pow(raw, F.lit(gamma)), F.lit(1.0))))


def _blocks(equity: DataFrame, before: int) -> Blocks:
    return blocked(equity, KEY, ORDER, _chunk(), before=before)


def _velocity(b: Blocks, n: int, halt: float) -> Blocks:
    pk = F.max("balance").over(b.frame(n))
    b = b.add(velocity_pct=F.greatest(F.lit(0.0), safe_div(pk - F.col("balance"), pk) * 100))
    v = F.col("velocity_pct")
    return b.add(velocity_scale=F.when((v >= halt), 0.0).otherwise(clamp(1 - v / halt, 0.0, 1.0)))


def drawdown_velocity(equity: DataFrame, n: int = 10, halt: float = 5.0) -> DataFrame:
    d = _velocity(_blocks(equity, n), n, halt).done()
    return d.select("account", "ts", "trade_id", "velocity_pct", "velocity_scale", (F.col("velocity_scale") == 0).alias("halt"))


def equity_ma_state(equity: DataFrame, fast: int = 10, slow: int = 20, ultra: int = 50, slope: int = 5) -> DataFrame:
    """Five-state classification from moving averages and slope; size multiplier and scan interval."""
    b = _blocks(equity, max(ultra, slow + slope))
    ma = lambda n: b.full(n, F.avg("balance").over(b.frame(n)))
    a, z = F.lag("balance", slow + slope - 1).over(b.w), F.lag("balance", slow - 1).over(b.w)
    b = b.add(mf=ma(fast), ms=ma(slow), mu=ma(ultra), sl=F.when(F.col("_i") >= slow + slope - 1, (z - a) / (F.abs(a) + 1e-6) * 100))
    d = b.done()
    e, pos = F.col("balance"), F.coalesce("sl", F.lit(0.0)) > 0
    up, af, au = e >= F.col("ms"), is_true(e >= F.col("mf")), is_true(e >= F.col("mu"))
    st = case((F.col("ms").isNull(), "INSUFFICIENT_DATA"), (up & pos & af, "STRONG_UPTREND"), (up & pos, "UPTREND"), (up, "WEAKENING"), (au, "CORRECTION"), default="DOWNTREND")
    d = d.withColumn("state", st)
    s = F.col("state")
    m = lambda vals: case(*[(s == k, v) for k, v in vals.items()])
    return d.select("account", "ts", "trade_id", "state", F.col("ms").alias("ma_slow"), F.col("sl").alias("slope_slow_pct"),
                    m({"INSUFFICIENT_DATA": 1.0, "STRONG_UPTREND": 1.0, "UPTREND": 0.85, "WEAKENING": 0.5, "CORRECTION": 0.25, "DOWNTREND": 0.0}).alias("size_multiplier"),
                    m({"INSUFFICIENT_DATA": 3, "STRONG_UPTREND": 2, "UPTREND": 3, "WEAKENING": 5, "CORRECTION": 7, "DOWNTREND": 10}).alias("scan_days"))


def _vol(b: Blocks, n: int = 20) -> Blocks:
    b = b.add(_r=F.col("balance") / F.lag("balance").over(b.w) - 1)
    return b.add(vol_ann=b.full(n, F.stddev_samp("_r").over(b.frame(n)) * math.sqrt(ANN), lead=1))


def vol_target_scalar(equity: DataFrame, target: float = 0.12, lo: float = 0.25, hi: float = 2.0) -> DataFrame:
    d = _vol(_blocks(equity, 21)).done()
    v = F.col("vol_ann")
    return d.select("account", "ts", "trade_id", "vol_ann", F.when(v > 0, clamp(target / v, lo, hi)).otherwise(1.0).alias("vol_scalar"),
                    case((v.isNull(), "UNKNOWN"), (v <= 0, "LOW"), (v < target * 0.7, "LOW_VOL"), (v < target * 1.3, "NORMAL"), (v < target * 2, "HIGH_VOL"), default="EXTREME_VOL").alias("vol_label"))


def edge_monitor(trades: DataFrame, n: int = 30, min_wr: float = 0.45, min_sr: float = 0.5, min_pf: float = 1.05, max_losses: int = 7, key: str = "account") -> DataFrame:
    """Rolling win rate, Sharpe, profit factor and loss streak -> triggers -> status and size scale.
    trades: key, exit_ts, trade_id, net_pnl_pct."""
    t = trades.select(key, "exit_ts", "trade_id", "net_pnl_pct")

    def rolled(b: Blocks) -> DataFrame:
        f, p = b.frame(n), F.col("net_pnl_pct")
        d = b.add(cnt=F.count(F.lit(1)).over(f), wr=F.avg(flag(p > 0)).over(f), m=F.avg(p / 100).over(f), sd=F.stddev_samp(p / 100).over(f),
                  gw=F.coalesce(F.sum(F.when(p > 0, p)).over(f), F.lit(0.0)), gl=F.coalesce(F.sum(F.when(p < 0, -p)).over(f), F.lit(0.0)),
                  win=F.when(p > 0, F.col("_i")))
        return d.past(lw="win").done(drop_index=False).select(key, "exit_ts", "trade_id", "_i", "cnt", "wr", "m", "sd", "gw", "gl", "lw")

    d = by_series(t, [key], ["exit_ts", "trade_id"], time_chunk("exit_ts", BAR_CHUNK), n, rolled).where("cnt >= 5")
    sr = F.when((F.col("cnt") > 5) & (F.col("sd") > 1e-12), (F.col("m") - RF_DAILY) / F.col("sd") * math.sqrt(ANN)).otherwise(0.0)
    d = d.withColumns({"rolling_sharpe": sr, "profit_factor": safe_div("gw", "gl", 9.99), "loss_streak": F.col("_i") - F.coalesce("lw", F.lit(-1))})
    trig = [("WIN_RATE", F.col("wr") < min_wr), ("SHARPE", F.col("rolling_sharpe") < min_sr), ("PROFIT_FACTOR", F.col("profit_factor") < min_pf), ("LOSS_STREAK", F.col("loss_streak") >= max_losses)]
    d = d.withColumns({"triggers": F.concat_ws(",", *[F.when(c, F.lit(k)) for k, c in trig]), "nt": sum((c.cast("int") for _, c in trig), F.lit(0))})
    k = F.col("nt")
    return d.select(key, "exit_ts", "trade_id", (F.col("wr") * 100).alias("win_rate_pct"), "rolling_sharpe", "profit_factor", "loss_streak", "triggers",
                    case((k == 0, "ACTIVE"), (k == 1, "ALERT"), (k == 2, "CAUTION"), default="SUSPEND").alias("edge_status"),
                    case((k == 0, 1.0), (k == 1, 0.75), (k == 2, 0.5), default=0.0).alias("edge_scale"))


def combined_risk_scale(equity: DataFrame, trades: DataFrame, initial: float = 10000.0, target: float = 0.12, trail: float = 0.15) -> DataFrame:
    """Product of the volatility, floor, trailing, velocity and moving-average scales with the edge scale; mode and halt reason."""

    def scales(b: Blocks) -> DataFrame:
        b = _velocity(_vol(b), 10, 5.0)
        b = b.add(gate=F.when(F.col("_i") >= 20, flag(F.col("balance") >= F.avg("balance").over(b.frame(20)))).otherwise(1.0)).past(_top="balance")
        b = b.add(peak=F.greatest("_top", F.lit(initial))).add(_hit=_hit(trail)).past(_trig="_hit")
        return b.done().select("account", "ts", "trade_id", "balance", "_top", "_trig", *of_v)

    of_v = ("vol_ann", "velocity_scale", "gate")
    d = by_series(equity, KEY, ORDER, _chunk(), 21, scales)
    of_m = ("floor", "below_floor")
    d = milestone_floor(d, initial, keep=("_top", "_trig", *of_v)).select("account", "ts", "trade_id", "balance", "_top", "_trig", *of_m, *of_v)
    d = trailing_stop_level(d, trail, initial=initial, keep=(*of_m, *of_v))
    vs = F.when(F.col("vol_ann") < 1e-6, 1.2).otherwise(F.coalesce(clamp(target / F.col("vol_ann"), 0.1, 1.2), F.lit(1.0)))
    prox = clamp(1 - safe_div(F.col("balance") - F.col("floor"), F.col("peak") - F.col("floor")), 0.0, 1.0)
    fs = F.when(F.col("peak") <= F.col("floor"), 0.5).otherwise(decay(prox, 6.0))
    d = d.dropna(subset=["account", "trade_id"]).select("account", "ts", "trade_id", "below_floor", fs.alias("fs"), "trailing_scale", "triggered", vs.alias("vs"), (F.col("velocity_scale") * F.col("gate")).alias("vg"))
    one = Window.partitionBy("account", "trade_id")  # rows that share an id stand for each other in the stop and in the volatility scales
    d = d.withColumns({"_t": F.collect_list(F.struct("trailing_scale", "triggered")).over(one), "_v": F.collect_list(F.struct("vs", "vg")).over(one)})
    d = d.select("account", "ts", "trade_id", "below_floor", "fs", "_v", F.inline("_t")).select("account", "ts", "trade_id", "below_floor", "fs", "trailing_scale", "triggered", F.inline("_v"))
    e = edge_monitor(trades).select("account", "trade_id", "edge_scale", "edge_status")
    x = d.join(e, ["account", "trade_id"], "left").fillna({"edge_scale": 1.0, "edge_status": "ACTIVE"})
    x = x.withColumn("base", clamp(F.col("vs") * F.col("fs") * F.col("trailing_scale") * F.col("vg"), 0.0, 1.2))
    x = x.withColumn("final_scale", clamp(F.col("base") * F.col("edge_scale"), 0.0, 1.2))
    s = F.col("base")
    return x.select("account", "ts", "trade_id", "final_scale", case((s == 0, "HALTED"), (s < 0.25, "DEFENSIVE"), (s < 0.6, "REDUCED"), (s < 0.9, "STANDARD"), default="FULL").alias("mode"),
                    case((F.col("below_floor"), "FLOOR_BREACH"), (F.col("triggered"), "TRAILING_STOP"), (s == 0, "VELOCITY_OR_BELOW_MA"), (F.col("edge_status") == "SUSPEND", "EDGE_DEGRADED"), default="").alias("halt_reason"))


def reserve_split(trades: DataFrame, rate: float = 0.15, initial: float = 10000.0, min_balance: float = 5000.0) -> DataFrame:
    """Share of every win moves to a locked reserve; losses never push trading capital below its minimum.
    max(min, previous + x) unrolls to S + max(0, min - least S so far) with S the free running sum, so one pass of running sums and of their minimum suffices.
    trades: account, ts, trade_id, pnl."""
    x = F.col("pnl")
    t = trades.select("account", "ts", "trade_id", "pnl")
    d = positioned(t, KEY, ORDER, _chunk(), {"_sx": F.when(x > 0, x * (1 - rate)).otherwise(x), "locked_reserve": F.when(x > 0, x * rate).otherwise(0.0), "total_profit": F.when(x > 0, x).otherwise(0.0)},
                   {"_low": "_sx"})
    cap = initial + F.col("_sx") + F.greatest(F.lit(0.0), min_balance - initial - F.col("_low"))
    return d.select("account", "ts", "trade_id", cap.alias("tradeable_capital"), "locked_reserve", (cap + F.col("locked_reserve")).alias("total_balance"), "total_profit")
