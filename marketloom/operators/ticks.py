"""Tick and order-book operators (batch form; ticks: symbol, ts, seq, price, bid, ask, bid_size, ask_size, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import case, clamp, flag, is_true, safe_div
from ..plans import TICK_CHUNK, Blocks, narrow, running, tick_blocks, trailing_sum

ID = ["symbol", "ts", "seq"]


def mid() -> Column:
    return (F.col("bid") + F.col("ask")) / 2


def ofi() -> Column:
    t = F.col("bid_size") + F.col("ask_size")
    return F.when(t > 0, F.col("bid_size") / t).otherwise(0.5)


def spread_mid() -> Column:
    return F.when(mid() > 0, (F.col("ask") - F.col("bid")) / mid() * 100).otherwise(0.0)


def spread_bid() -> Column:
    return F.when(F.col("bid") > 0, (F.col("ask") - F.col("bid")) / F.col("bid") * 100).otherwise(999.0)


def tick_basics(t: DataFrame) -> DataFrame:
    return t.select(*ID, mid().alias("mid"), spread_mid().alias("spread_pct"), ofi().alias("ofi"))


def microprice(t: DataFrame) -> DataFrame:
    s = F.col("bid_size") + F.col("ask_size")
    return t.select(*ID, F.when(s > 0, (F.col("ask_size") * F.col("bid") + F.col("bid_size") * F.col("ask")) / s).otherwise(mid()).alias("microprice"))


def book_imbalance(levels: DataFrame, n: int = 5) -> DataFrame:
    """(bid - ask) / (bid + ask) over the top n levels with weight 1 / (level + 1)."""
    w = F.col("sz") / (F.col("level") + 1)
    a = levels.where(F.col("level") < n).groupBy(*ID).agg(F.sum(F.when(F.col("side") == "B", w)).alias("b"), F.sum(F.when(F.col("side") == "A", w)).alias("a"))
    b, k = F.coalesce("b", F.lit(0.0)), F.coalesce("a", F.lit(0.0))
    return a.select(*ID, F.when(b + k > 0, (b - k) / (b + k)).otherwise(0.0).alias("imbalance"))


def depth_ofi(levels: DataFrame, n: int = 3) -> DataFrame:
    a = levels.where(F.col("level") < n).groupBy(*ID).agg(F.sum(F.when(F.col("side") == "B", F.col("sz")).otherwise(0.0)).alias("b"), F.sum("sz").alias("t"))
    return a.select(*ID, F.when(F.col("t") > 0, F.col("b") / F.col("t")).otherwise(0.5).alias("depth_ofi"))


def book_state(deltas: DataFrame, as_of, depth: int = 20) -> DataFrame:
    """Live levels at a time: latest size per (symbol, side, price), zero deletes, best ``depth`` levels per side."""
    s = deltas.where(F.col("ts") <= as_of).groupBy("symbol", "side", "px").agg(F.max_by("sz", "seq").alias("sz")).where("sz > 0")
    key = F.when(F.col("side") == "B", -F.col("px")).otherwise(F.col("px"))
    w = Window.partitionBy("symbol", "side").orderBy(key)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth).select("symbol", "side", (F.col("rank") - 1).alias("level"), "px", "sz")


def spoof_walls(levels: DataFrame, ratio: float = 5.0, n: int = 10) -> DataFrame:
    """Snapshots whose largest level is at least ``ratio`` times the mean of the top n (three levels or more)."""
    a = levels.where((F.col("level") < n) & (F.col("sz") > 0)).groupBy(*ID, "side").agg(F.count(F.lit(1)).alias("m"), F.avg("sz").alias("avg"), F.max("sz").alias("mx"))
    return a.where((F.col("m") >= 3) & (F.col("mx") / F.col("avg") >= ratio)).select(*ID, "side", (F.col("mx") / F.col("avg")).alias("spoof_ratio"))


def spoof_environment(walls: DataFrame, signals: DataFrame, seconds: int = 5, count: int = 2) -> DataFrame:
    """Signals (symbol, ts, seq, direction) with two walls or more on their own side in the trailing seconds."""
    w = walls.select("symbol", "side", F.unix_micros("ts").alias("u"), F.lit(1).cast("long").alias("wall"))
    s = signals.select("symbol", F.when(F.col("direction") == "LONG", "B").otherwise("A").alias("side"), F.unix_micros("ts").alias("u"), "ts", "seq")
    d = trailing_sum(w, s, ["symbol", "side"], "u", "wall", seconds * 1_000_000, TICK_CHUNK * 1_000_000, "recent_walls")
    return d.select(*ID, "side", "recent_walls", (F.col("recent_walls") >= count).alias("spoof_environment"))


def fill_proxy_book(t: DataFrame) -> DataFrame:
    """Without a book: size min(1 + 20 |move %|, 3.5) on the side of the last mid move, 1 on the other."""
    b = tick_blocks(narrow(t, *ID, "price", "bid", "ask", "bid_size", "ask_size"), before=1).add(_m=mid())
    p = F.lag("_m").over(b.w)
    b = b.add(_d=F.col("_m") - p, _p=p)
    mv = F.least(1 + F.abs(F.col("_d") / F.col("_p")) * 100 * 20, F.lit(3.5))
    on = is_true((F.abs("_d") > 1e-10) & (F.col("_p") > 0))
    d = b.add(bs=F.when(on, F.when(F.col("_d") > 0, mv).otherwise(1.0)).otherwise(F.col("bid_size")),
              az=F.when(on, F.when(F.col("_d") > 0, 1.0).otherwise(mv)).otherwise(F.col("ask_size"))).done()
    return d.select(*ID, "price", F.col("bs").alias("bid_size"), F.col("az").alias("ask_size"))


def _stats(b: Blocks, n: int = 20) -> Blocks:
    """mean and population deviation of the last n mids (from the 10th tick), mean spread of 30, ATR of 14 moves, z."""
    b = b.add(m=mid(), sp=spread_mid())
    b = b.add(mv=F.abs(F.col("m") - F.lag("m").over(b.w)))
    f = b.frame(n)
    b = b.add(mean=b.full(10, F.avg("m").over(f)), std=b.full(10, F.stddev_pop("m").over(f)), avg_spread=b.full(10, F.avg("sp").over(b.frame(30))),
              atr=b.full(14, F.avg("mv").over(b.frame(14))), sp3=F.avg("sp").over(b.frame(3)))
    return b.add(z=F.when(F.col("std") < 1e-10, 0.0).otherwise((F.col("m") - F.col("mean")) / F.col("std")))


def _rofi(b: Blocks, n: int = 20) -> Blocks:
    f = b.frame(n)
    bs = F.coalesce(F.sum(F.when(F.col("bid_size") > 0, F.col("bid_size"))).over(f), F.lit(0.0))
    az = F.coalesce(F.sum(F.when(F.col("ask_size") > 0, F.col("ask_size"))).over(f), F.lit(0.0))
    return b.add(rofi=F.when(bs + az < 1e-10, 0.5).otherwise(bs / (bs + az)))


def rolling_tick_stats(t: DataFrame) -> DataFrame:
    return _stats(tick_blocks(t, before=31)).done().where("mean is not null").select(*ID, "mean", "std", "atr", "avg_spread", "z")


def rolling_ofi(t: DataFrame, n: int = 20) -> DataFrame:
    return _rofi(tick_blocks(narrow(t, *ID, "bid_size", "ask_size"), before=n), n).done().select(*ID, F.col("rofi").alias("ofi"))


def spread_filter(t: DataFrame, mult: float = 1.5) -> DataFrame:
    d = _stats(tick_blocks(t, before=31)).done()
    ok = F.when(F.coalesce("avg_spread", F.lit(0.0)) < 1e-8, True).otherwise(F.col("sp3") <= F.col("avg_spread") * mult)
    return d.select(*ID, F.col("sp3").alias("spread_3"), "avg_spread", ok.alias("spread_ok"))


def mean_reversion_signal(t: DataFrame, threshold: float = 1.5, ofi_min: float = 0.55, stop_mult: float = 1.5, rr: float = 1.8, cost: float = 0.10,
                          spread_mult: float = 1.5, win_rate: float = 0.55) -> DataFrame:
    """Two of three independent votes (z-score, order flow, three-tick reversal), then spread, expected value and cost filters."""
    b = _rofi(_stats(tick_blocks(t, before=31)))
    r3 = F.avg("m").over(b.frame(3))
    p3 = F.avg("m").over(b.w.rowsBetween(-5, -3))
    z, o = F.col("z"), F.col("rofi")
    b = b.add(rev_up=(z < -threshold * 0.7) & (r3 > p3), rev_dn=(z > threshold * 0.7) & (r3 < p3))
    lo = flag(z <= -threshold) + flag(o >= ofi_min) + flag(F.col("rev_up") & (F.col("_i") >= 7))
    sh = flag(z >= threshold) + flag(o <= 1 - ofi_min) + flag(F.col("rev_dn") & (F.col("_i") >= 7))
    d = b.add(lo=lo, sh=sh, stop_pct=F.col("atr") * stop_mult / F.col("m") * 100).done()
    d = d.withColumn("target_pct", F.col("stop_pct") * rr)
    d = d.withColumn("ev_pct", F.col("target_pct") * win_rate - F.col("stop_pct") * (1 - win_rate) - cost)
    side = F.when((F.col("lo") >= 2) & (F.col("lo") > F.col("sh")), "LONG").when((F.col("sh") >= 2) & (F.col("sh") > F.col("lo")), "SHORT")
    d = d.withColumn("direction", side).where((F.col("atr") >= 1e-10) & F.col("direction").isNotNull() & (F.col("sp3") <= F.col("avg_spread") * spread_mult) & (F.col("ev_pct") > 0))
    return d.select(*ID, "direction", F.greatest("lo", "sh").alias("votes"), "z", F.col("rofi").alias("ofi"), "stop_pct", "target_pct", "ev_pct")


def _streaks(t: DataFrame) -> DataFrame:
    """Length of the current run of rising / falling prices and the price before the run. The start of a run is the last
    tick that did not continue it: a running maximum over (position, price)."""
    b = tick_blocks(t, before=1)
    p = F.lag("price").over(b.w)
    d = b.add(_up=is_true(F.col("price") > p), _dn=is_true(F.col("price") < p)).done(drop_index=False)
    at = F.struct("_i", "price")
    d = running(d, ["symbol"], ["_i"], F.floor(F.col("_i") / b.rows).cast("long"), maxs={"_u": F.when(~F.col("_up"), at), "_d": F.when(~F.col("_dn"), at)})
    return d.withColumns({"up_streak": F.col("_i") - F.col("_u._i"), "down_streak": F.col("_i") - F.col("_d._i"),
                          "start_price": F.when(F.col("_up"), F.col("_u.price")).when(F.col("_dn"), F.col("_d.price"))})


def tick_streak(t: DataFrame) -> DataFrame:
    return _streaks(narrow(t, *ID, "price")).select(*ID, "up_streak", "down_streak")


def burst_signal(t: DataFrame, min_streak: int = 3, min_move: float = 0.005, ofi_floor: float = 0.20, ofi_ceiling: float = 0.80, max_spread: float = 0.25) -> DataFrame:
    d = _streaks(t).withColumns({"streak": F.greatest("up_streak", "down_streak"), "direction": F.when(F.col("up_streak") >= F.col("down_streak"), "LONG").otherwise("SHORT"),
                                 "move_pct": F.abs(F.col("price") - F.col("start_price")) / F.col("start_price") * 100, "ofi": ofi(), "spread_pct": spread_bid()})
    gate = F.when(F.col("direction") == "LONG", F.col("ofi") >= ofi_floor).otherwise(F.col("ofi") <= ofi_ceiling)
    return d.where((F.col("streak") >= min_streak) & (F.col("move_pct") >= min_move) & (F.col("spread_pct") <= max_spread) & gate
                   ).select(*ID, "direction", "streak", "move_pct", "ofi", "spread_pct")


def pullback_signal(t: DataFrame, trend: int = 3, max_pullback: float = 0.05, min_move: float = 0.01, max_spread: float = 0.25) -> DataFrame:
    """All of the ``trend`` moves before the last tick go one way, the last tick steps back a little."""
    b = tick_blocks(t, before=trend + 2)
    pr = [F.col("price")] + [F.lag("price", k).over(b.w) for k in range(1, trend + 2)]
    up = sum((flag(pr[k] > pr[k + 1]) for k in range(1, trend + 1)), F.lit(0.0))
    dn = sum((flag(pr[k] < pr[k + 1]) for k in range(1, trend + 1)), F.lit(0.0))
    b = b.add(_up=up, _dn=dn, _prev=pr[1], _start=pr[trend + 1], ofi=ofi(), spread_pct=spread_bid())
    d = b.done(drop_index=False).where(F.col("_i") >= trend + 1)
    long = F.col("_up") >= F.col("_dn")
    d = d.withColumns({"direction": F.when(long, "LONG").otherwise("SHORT"), "prior_move_pct": F.abs(F.col("_prev") - F.col("_start")) / F.col("_start") * 100,
                       "pullback_pct": F.when(long, F.col("_prev") - F.col("price")).otherwise(F.col("price") - F.col("_prev")) / F.col("_prev") * 100})
    gate = F.when(long, F.col("ofi") >= 0.20).otherwise(F.col("ofi") <= 0.80)
    return d.where((F.greatest("_up", "_dn") >= trend) & (F.col("prior_move_pct") >= min_move) & (F.col("pullback_pct") > 0) & (F.col("pullback_pct") <= max_pullback)
                   & (F.col("spread_pct") <= max_spread) & gate).select(*ID, "direction", "prior_move_pct", "pullback_pct", "ofi")


def acceleration_signal(t: DataFrame, ratio: float = 1.4, min_move: float = 0.003, max_spread: float = 0.25) -> DataFrame:
    """Three shrinking gaps between ticks (floored at 1 ms) with a move over the last five ticks."""
    b = tick_blocks(t, before=5)
    at = lambda k: F.unix_micros(F.lag("ts", k).over(b.w)) if k else F.unix_micros("ts")
    iv = [F.greatest((at(k) - at(k + 1)) / 1e6, F.lit(0.001)) for k in range(3)]
    b = b.add(g0=iv[0], g1=iv[1], g2=iv[2], _p=F.lag("price", 4).over(b.w), ofi=ofi(), spread_pct=spread_bid())
    d = b.done().where("_p is not null").withColumns({"move_pct": (F.col("price") - F.col("_p")) / F.col("_p") * 100, "accel_ratio": F.col("g2") / F.col("g0")})
    d = d.withColumn("direction", F.when(F.col("move_pct") > 0, "LONG").otherwise("SHORT"))
    gate = F.when(F.col("direction") == "LONG", F.col("ofi") >= 0.15).otherwise(F.col("ofi") <= 0.85)
    return d.where((F.col("g2") > F.col("g1")) & (F.col("g1") > F.col("g0")) & (F.col("accel_ratio") >= ratio) & (F.abs("move_pct") >= min_move) & (F.col("spread_pct") <= max_spread) & gate
                   ).select(*ID, "direction", "move_pct", "accel_ratio", "ofi")


def momentum_flip(t: DataFrame, positions: DataFrame, threshold: float = 0.06) -> DataFrame:
    """Ticks where the three-tick move runs against an open position. positions: (symbol, direction), a small dimension."""
    b = tick_blocks(narrow(t, *ID, "price"), before=2)
    p = F.lag("price", 2).over(b.w)
    d = b.add(move_pct=(F.col("price") - p) / p * 100).done().where("move_pct is not null").join(positions, "symbol")
    return d.select(*ID, "direction", "move_pct", F.when(F.col("direction") == "LONG", F.col("move_pct") < -threshold).otherwise(F.col("move_pct") > threshold).alias("flip"))


def trend_continues(t: DataFrame) -> DataFrame:
    b = tick_blocks(narrow(t, *ID, "price"), before=4)
    b = b.add(_m=F.col("price") - F.lag("price").over(b.w))
    f = b.frame(3)
    d = b.add(up=F.sum(flag(F.col("_m") > 0)).over(f), dn=F.sum(flag(F.col("_m") < 0)).over(f)).done(drop_index=False).where("_i >= 3")
    return d.select(*ID, (F.col("up") >= 2).alias("long_continues"), (F.col("dn") >= 2).alias("short_continues"))


def tick_regime(t: DataFrame, window: int = 20, vol_low: float = 0.005, vol_high: float = 0.08, bias: float = 0.6, min_move: float = 0.02) -> DataFrame:
    """DEAD / VOLATILE / TRENDING_UP / TRENDING_DOWN / RANGING over the last window + 2 ticks, with size and level multipliers."""
    n = window + 2
    b = tick_blocks(narrow(t, *ID, "price"), before=n)
    p = F.lag("price").over(b.w)
    b = b.add(_r=(F.col("price") - p) / p * 100)
    f = b.frame(n - 1)
    b = b.add(vol=F.stddev_samp("_r").over(f), up=F.sum(flag(F.col("_r") > 0)).over(f), dn=F.sum(flag(F.col("_r") < 0)).over(f), tot=F.count("_r").over(f), _first=F.first("price").over(b.frame(n)))
    d = b.done(drop_index=False)
    net = F.abs(F.col("price") - F.col("_first")) / F.col("_first") * 100
    trending = (F.greatest("up", "dn") / F.col("tot") >= bias) & (net > min_move)
    d = d.withColumn("regime", case((F.col("_i") < window - 1, "RANGING"), (F.col("vol") < vol_low, "DEAD"), (F.col("vol") > vol_high, "VOLATILE"),
                                    (trending & (F.col("up") >= F.col("dn")), "TRENDING_UP"), (trending, "TRENDING_DOWN"), default="RANGING"))
    r = F.col("regime")
    tr = r.startswith("TRENDING")
    return d.select(*ID, "regime", case((tr, 1.4), (r == "VOLATILE", 1.2), (r == "DEAD", 1.0), default=0.85).alias("tp_mult"),
                    case((tr, 0.85), (r == "VOLATILE", 1.4), default=1.0).alias("sl_mult"), case((tr, 1.0), (r == "VOLATILE", 0.5), (r == "DEAD", 0.0), default=0.9).alias("size_mult"))


def cooldown_filter(signals: DataFrame, seconds: float, key: str = "symbol") -> DataFrame:
    """Keep a signal only if the last KEPT one is at least ``seconds`` old.

    A pause of ``seconds`` restarts the rule, so the series splits into independent bursts. Inside a burst each signal
    points to the first one at least ``seconds`` later (at most 2 x ``seconds`` away, since gaps in a burst are shorter
    than that); the kept ones are those reached from the burst's first signal. Reachability is found by pointer doubling:
    log2(longest chain) equi-joins, with the lineage cut between rounds, whatever the length of a burst."""
    from ..session import checkpointed

    us = int(seconds * 1_000_000)
    b = tick_blocks(signals.select(key, "ts", "seq").withColumnRenamed(key, "symbol"), before=1)
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(b.w))
    d = b.add(start=F.coalesce(gap >= us, F.lit(True))).done(drop_index=False)
    d = running(d, ["symbol"], ["_i"], F.floor(F.col("_i") / b.rows).cast("long"), sums={"burst": F.col("start").cast("long")})
    chunk = 3600 * 1_000_000 if 2 * us < 3600 * 1_000_000 else 4 * us
    t = F.unix_micros("ts")
    home = F.floor(t / chunk).cast("long")
    homes = F.array_compact(F.array(F.struct(home.alias("b"), F.lit(True).alias("own")), F.when(t < home * chunk + 2 * us, F.struct((home - 1).alias("b"), F.lit(False).alias("own")))))
    x = d.withColumn("_h", F.explode(homes)).withColumns({"_b": F.col("_h.b"), "_own": F.col("_h.own"), "_t": t})
    w = Window.partitionBy("symbol", "burst", "_b").orderBy("_t").rangeBetween(us, 2 * us)
    x = x.withColumn("nxt", F.min("_i").over(w)).where("_own").select("symbol", "ts", "seq", "_i", "start", "nxt")
    x = checkpointed(x)
    hops = x.select("symbol", "_i", "nxt").where("nxt is not null")
    kept = x.where("start").select("symbol", "_i")
    while True:  # hops always spans 2^k kept signals; the loop ends when no chain is that long
        step = kept.join(hops, ["symbol", "_i"]).select("symbol", F.col("nxt").alias("_i"))
        kept = checkpointed(kept.unionByName(step).distinct())
        nx = hops.select("symbol", F.col("_i").alias("nxt"), F.col("nxt").alias("nn"))
        hops = checkpointed(hops.join(nx, ["symbol", "nxt"]).select("symbol", "_i", F.col("nn").alias("nxt")))
        if hops.isEmpty():
            break
    out = x.join(kept, ["symbol", "_i"]).select(F.col("symbol").alias(key), "ts", "seq")
    return out
