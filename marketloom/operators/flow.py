"""Order-flow, lead-lag, funding and open-interest signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import case, clamp, flag, is_true, safe_div
from ..plans import Blocks, blocked, last_rows, narrow, tick_blocks, time_chunk

ID = ["symbol", "ts", "seq"]
EPS = 1e-12


def _kyle(b: Blocks, n: int, cap: float) -> Blocks:
    """Covariance of price change and signed volume over the variance of signed volume, last n ticks, from 10 moves on."""
    b = b.add(_dp=F.col("price") - F.lag("price").over(b.w))
    b = b.add(_sv=F.when(F.col("_dp").isNotNull(), F.signum("_dp") * F.greatest("volume", F.lit(EPS))))
    f = b.frame(n)
    v = F.var_pop("_sv").over(f)
    lam = F.when(v < EPS, 0.0).otherwise(clamp(F.covar_samp("_dp", "_sv").over(f) / F.when(v >= EPS, v), -cap, cap))
    return b.add(lam=b.full(11, lam))


def kyle_lambda(t: DataFrame, n: int = 80, cap: float = 0.1, low: float = 0.002, high: float = 0.008, smooth: int = 50) -> DataFrame:
    """Price impact per unit of signed volume, smoothed by an average with weight 0.2 over the last 50 estimates."""
    b = _kyle(tick_blocks(narrow(t, *ID, "price", "volume"), before=n + smooth + 2), n, cap)
    hist = F.collect_list("lam").over(b.frame(smooth))  # at most `smooth` numbers
    ema = F.aggregate(F.slice(hist, 2, smooth), hist[0], lambda a, x: 0.2 * x + 0.8 * a)
    d = b.add(lambda_smooth=F.when(F.col("lam").isNotNull(), ema)).done().where("lam is not null")
    a = F.abs("lambda_smooth")
    return d.select(*ID, F.col("lam").alias("lambda_raw"), "lambda_smooth", case((a < low, "LOW"), (a < high, "CAUTION"), default="HIGH").alias("toxicity_level"))


def flow_toxicity(t: DataFrame, n: int = 60, cap: float = 0.1, high: float = 0.008, lag: int = 15) -> DataFrame:
    """0.40 impact + 0.35 persistence of moves + 0.25 size anomaly over the last n ticks; regime from a weighted history of 30 scores."""
    b = _kyle(tick_blocks(narrow(t, *ID, "price", "volume", "bid_size", "ask_size"), before=n + 33), n, cap)
    f = b.frame(n)
    prev = b.w.rowsBetween(-(n - 1), -1)
    b = b.add(_px=F.collect_list("price").over(f), _vm=F.avg("volume").over(prev), _vs=F.stddev_pop("volume").over(prev))  # at most n prices
    m = F.size("_px")
    lg = F.least(F.lit(lag), m - 1)
    step = F.greatest(F.lit(1), F.floor(lg / 5)).cast("int")
    px = lambda i: F.element_at("_px", (i + 1).cast("int"))
    third = F.floor(lg / 3).cast("int")
    start = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), m - lg - 1), step), lambda i: F.abs(px(i + third) - px(i)) > EPS)
    part = F.transform(start, lambda i: F.least(F.abs(px(i + lg) - px(i)) / F.abs(px(i + third) - px(i)), F.lit(2.0)) / 2)
    c2 = F.when(F.size(part) > 0, F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)).otherwise(0.0)
    c1 = F.least(F.abs(F.coalesce("lam", F.lit(0.0))) / (high + EPS), F.lit(1.0))
    z = (F.col("volume") - F.col("_vm")) / (F.col("_vs") + EPS)
    imb = F.abs((F.col("bid_size") - F.col("ask_size")) / (F.col("bid_size") + F.col("ask_size") + EPS))
    c3 = F.when((m >= 20) & (imb > 0.2), clamp(F.least(F.greatest(z - 2.0, F.lit(0.0)) / 3.0, F.lit(1.0)) * imb * 3.0, 0.0, 1.0)).otherwise(0.0)
    b = b.add(score=F.when(F.col("_i") >= 14, clamp(0.40 * c1 + 0.35 * c2 + 0.25 * c3, 0.0, 1.0)).otherwise(0.0))
    recent, older = F.avg("score").over(b.frame(5)), F.avg("score").over(b.w.rowsBetween(-29, -5))
    d = b.add(toxicity=F.when(older.isNull(), recent).otherwise((3 * recent + older) / 4)).done(drop_index=False).where("_i >= 14")
    x = F.col("toxicity")
    return d.select(*ID, "score", "toxicity", case((x < 0.25, "CLEAN"), (x < 0.55, "MIXED"), (x < 0.75, "TOXIC"), default="DANGEROUS").alias("flow_regime"),
                    case((x < 0.25, 1.0), (x < 0.55, 0.7), default=0.0).alias("size_scalar"))


def lead_lag(bars: DataFrame, pairs: DataFrame, window: int = 60, max_lag: int = 10, min_corr: float = 0.45, min_move: float = 0.03) -> DataFrame:
    """Best lagged correlation (follower after leader, 1 to max_lag bars) over the last ``window`` bars of each pair.
    pairs: (leader, follower, rank_gap), the ordered pairs to test. Every series is cut to its newest rows first."""
    t = last_rows(narrow(bars, "symbol", "ts", "close"), ["symbol"], ["ts"], window)
    w = Window.partitionBy("symbol").orderBy("ts")  # at most `window` rows
    t = t.withColumns({"r": F.col("close") / F.lag("close").over(w) - 1, "m3": (F.col("close") / F.lag("close", 2).over(w) - 1) * 100, "k": F.col("_rev")})
    lead = t.select(F.col("symbol").alias("leader"), "k", F.col("r").alias("x")).where("x is not null")
    foll = t.select(F.col("symbol").alias("follower"), F.col("k").alias("kf"), F.col("r").alias("y")).where("y is not null")
    move = t.where("k = 1").select(F.col("symbol").alias("leader"), F.col("m3").alias("move_pct"), F.col("ts").alias("signal_ts"))
    x = pairs.join(lead, "leader").withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).withColumn("kf", F.col("k") - F.col("lag"))
    c = x.join(foll, ["follower", "kf"]).groupBy("leader", "follower", "rank_gap", "lag").agg(F.corr("x", "y").alias("c"), F.count(F.lit(1)).alias("m")).where("m >= 10 and c is not null and not isnan(c)")
    b = c.groupBy("leader", "follower", "rank_gap").agg(F.max_by(F.struct("lag", "c"), F.struct(F.abs(F.round("c", 9)), -F.col("lag"))).alias("b"))
    b = b.select("leader", "follower", "rank_gap", F.col("b.lag").alias("lag"), F.col("b.c").alias("correlation")).join(move, "leader")
    st = F.least(F.abs("move_pct") / 0.1, F.lit(1.0))
    conf = clamp(F.abs("correlation") * st * (1 + F.col("rank_gap") * 0.3), 0.0, 1.0)
    return b.select("leader", "follower", "lag", "correlation", "move_pct", F.when(F.col("move_pct") > 0, "LONG").otherwise("SHORT").alias("direction"), conf.alias("confidence"),
                    ((F.abs("correlation") >= min_corr) & (F.abs("move_pct") >= min_move)).alias("triggered"), "signal_ts")


def active_lead_signals(signals: DataFrame, flow: DataFrame, as_of, ttl_s: float = 8.0) -> DataFrame:
    """Triggered signals younger than the limit, best one per follower, followers with clean flow only.
    flow: (symbol, flow_regime), latest row per symbol."""
    age = (F.unix_micros(as_of) - F.unix_micros("signal_ts")) / 1e6
    s = signals.where("triggered").withColumn("age_s", age).where(F.col("age_s").between(0, ttl_s))
    w = Window.partitionBy("follower").orderBy(F.col("confidence").desc(), "leader")
    s = s.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return s.join(flow.where("flow_regime = 'CLEAN'").select(F.col("symbol").alias("follower")), "follower", "left_semi").select("follower", "leader", "direction", "confidence", "lag", "age_s")


def entry_quality(x: DataFrame, block_at: float = 0.75) -> DataFrame:
    """0.4 clean flow + 0.3 regime stability + 0.3 lead-lag agreement; block reason and size scalar.
    Needs direction, toxicity, size_scalar (flow), p_dangerous, stability, transition_status, regime_scalar, lead_direction (nullable), lead_confidence."""
    agree, none = F.col("lead_direction") == F.col("direction"), F.col("lead_direction").isNull()
    ll = F.when(none, 0.7).when(agree, F.col("lead_confidence")).otherwise(1 - F.col("lead_confidence") * 0.5)
    tox = F.when(~none & ~agree, F.least("size_scalar", F.lit(0.5))).otherwise(F.col("size_scalar"))
    return x.withColumns({
        "composite_quality": clamp(0.40 * (1 - F.col("toxicity")) + 0.30 * F.col("stability") + 0.30 * ll, 0.0, 1.0),
        "block_reason": case((F.col("toxicity") >= block_at, "TOXIC_FLOW"), (F.col("transition_status") == "BLOCK", "REGIME_TRANSITION"), default=""),
        "final_scalar": clamp(tox * F.col("regime_scalar"), 0.0, 1.0)}).withColumn("approved", F.col("block_reason") == "")


def _series(df: DataFrame, before: int) -> Blocks:
    return blocked(df, ["symbol"], ["ts"], time_chunk("ts", 86400 * 30), before=before)


CARRY_MIN, EXTREME_LONG, EXTREME_SHORT, MODERATE = 0.005, 0.070, -0.035, 0.020  # percent per payment
PAYMENTS = 8760  # hourly payments per year


def funding_signal(funding: DataFrame, window: int = 48) -> DataFrame:
    """Carry, crowding and consistency of the funding rate over its last 48 observations, at every observation."""
    b = _series(funding.select("symbol", "ts", "rate"), window)
    f = b.frame(window)
    b = b.add(mean=F.avg("rate").over(f), sd=F.stddev_pop("rate").over(f) + EPS, pos=F.avg(flag(F.col("rate") > 0)).over(f), neg=F.avg(flag(F.col("rate") < 0)).over(f))
    d = b.done()
    pct = F.col("rate") * 100
    cons = clamp(1 - F.least(F.col("sd") / (F.abs("mean") + EPS), F.lit(1.0)), 0.0, 1.0)
    share = case((F.col("mean") > 0, F.col("pos")), (F.col("mean") < 0, F.col("neg")), default=1 - F.col("pos") - F.col("neg"))
    carry = F.when(F.abs(pct) >= CARRY_MIN, F.when(F.col("rate") > 0, "SHORT").otherwise("LONG"))
    d = d.withColumns({"rate_pct": pct, "rate_z": (F.col("rate") - F.col("mean")) / F.col("sd"), "consistency": cons, "carry_direction": carry})
    d = d.withColumns({
        "carry_apy_pct": F.when(F.col("carry_direction").isNotNull(), F.abs("rate_pct") * PAYMENTS).otherwise(0.0),
        "carry_quality": F.when(F.col("carry_direction").isNotNull(), share * F.col("consistency")).otherwise(0.0),
        "contrarian": case((pct >= EXTREME_LONG, "SHORT"), (pct <= EXTREME_SHORT, "LONG"), (pct >= MODERATE, "MILD_SHORT"), default="NEUTRAL"),
        "contrarian_strength": case((pct >= EXTREME_LONG, F.least((pct - EXTREME_LONG) / (EXTREME_LONG * 2), F.lit(1.0))),
                                    (pct <= EXTREME_SHORT, F.least((F.abs(pct) + EXTREME_SHORT) / (-EXTREME_SHORT * 2), F.lit(1.0))),
                                    (pct >= MODERATE, (pct - MODERATE) / (EXTREME_LONG - MODERATE)), default=0.0)})
    side = F.regexp_replace("contrarian", "MILD_", "")
    cs, cq = F.col("contrarian_strength"), F.col("carry_quality")
    both = is_true((F.col("contrarian") != "NEUTRAL") & (F.col("carry_direction") == side))
    kind = case((both, "CARRY_AND_CONTRARIAN"), (cs > 0.3, "CONTRARIAN"), (F.col("carry_direction").isNotNull() & (cq > 0.5), "CARRY"), default="NONE")
    d = d.withColumn("signal_type", kind)
    k = F.col("signal_type")
    return d.select("symbol", "ts", "rate_pct", "rate_z", "carry_direction", "carry_apy_pct", "carry_quality", "contrarian", "contrarian_strength", "consistency", "signal_type",
                    case((k.isin("CARRY_AND_CONTRARIAN", "CARRY"), F.col("carry_direction")), (k == "CONTRARIAN", side), default="NEUTRAL").alias("bias"),
                    case((k == "CARRY_AND_CONTRARIAN", F.least(cq + cs, F.lit(1.0))), (k == "CONTRARIAN", cs), (k == "CARRY", cq * 0.7), default=0.0).alias("strength"))


def oi_signal(oi: DataFrame, window: int = 60, chg: float = 0.02, spike_z: float = 2.0, price_min: float = 0.003) -> DataFrame:
    """Open-interest change against its own history, and the price / interest pattern, at every observation from the third on."""
    b = _series(oi.select("symbol", "ts", "oi_usd", "price"), window + 1)
    po, pp = F.lag("oi_usd").over(b.w), F.lag("price").over(b.w)
    b = b.add(oc=(F.col("oi_usd") - po) / F.greatest(po, F.lit(EPS)) * 100, pc=(F.col("price") - pp) / F.greatest(pp, F.lit(EPS)) * 100)
    f = b.frame(window - 1)
    d = b.add(m5=F.avg("oc").over(b.frame(5)), ma=F.avg(F.abs("oc")).over(f), sd=F.stddev_pop("oc").over(f) + EPS).done(drop_index=False).where("_i >= 2")
    oc, pc = F.col("oc"), F.col("pc")
    d = d.withColumn("oi_z", F.abs(oc - F.col("ma")) / F.col("sd"))
    big = F.col("oi_z") > spike_z
    pat = case((big & (oc > 0), "OI_SPIKE"), (big & (oc < 0), "OI_COLLAPSE"), ((oc > chg) & (pc > price_min), "BULLISH_CONFIRM"), ((oc > chg) & (pc < -price_min), "BEARISH_CONFIRM"),
               ((oc < -chg) & (pc > price_min), "SHORT_COVER"), ((oc < -chg) & (pc < -price_min), "LONG_LIQUIDATION"), default="NEUTRAL")
    d = d.withColumns({"pattern": pat, "strength": F.least(F.abs(oc) / (chg * 5), F.lit(1.0)) * F.least(F.abs(pc) / (price_min * 5), F.lit(1.0))})
    p = F.col("pattern")
    sig = case((p == "OI_SPIKE", "VOLATILITY_WARNING"), (p == "OI_COLLAPSE", "LIQUIDATION_CASCADE"), (p == "BULLISH_CONFIRM", "LONG_BIAS"), (p == "BEARISH_CONFIRM", "SHORT_BIAS"),
               (p == "SHORT_COVER", "WEAKENING_RALLY"), (p == "LONG_LIQUIDATION", "POTENTIAL_BOTTOM"), default="NEUTRAL")
    sc = case((p.isin("OI_SPIKE", "OI_COLLAPSE"), 0.3), (p.isin("BULLISH_CONFIRM", "BEARISH_CONFIRM"), 1 + F.least(F.col("strength") * 0.3, F.lit(0.3))),
              (p.isin("SHORT_COVER", "LONG_LIQUIDATION"), 0.7), default=1.0)
    return d.select("symbol", "ts", "oi_usd", oc.alias("oi_change_pct"), pc.alias("price_change_pct"), "oi_z",
                    case((F.col("m5") > chg, "RISING"), (F.col("m5") < -chg, "FALLING"), default="STABLE").alias("oi_trend"), "pattern", sig.alias("signal"), "strength",
                    clamp(sc, 0.0, 1.5).alias("size_scalar"))


def latest(df: DataFrame) -> DataFrame:
    return last_rows(df, ["symbol"], ["ts"], 1).drop("_rev")


def composite_alpha(fs: DataFrame, oi: DataFrame) -> DataFrame:
    """0.40 funding + 0.35 open interest + 0.25 agreement at the latest rows, for both intended directions."""
    x = latest(fs).select("symbol", "bias", F.col("strength").alias("fs"), "signal_type").join(
        latest(oi).select("symbol", "pattern", "signal", F.col("strength").alias("os"), F.col("size_scalar").alias("oi_scalar")), "symbol")
    x = x.withColumn("direction", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))))
    d, s = F.col("direction"), F.col("signal")
    oid = case((s == "LONG_BIAS", "LONG"), (s == "SHORT_BIAS", "SHORT"))
    fb = F.when(F.col("bias") != "NEUTRAL", F.col("bias"))
    f0 = case((F.col("signal_type") == "CARRY_AND_CONTRARIAN", F.least(F.col("fs") * 1.2, F.lit(1.0))), (F.col("signal_type").isin("CONTRARIAN", "CARRY"), F.col("fs") * 0.85), default=0.0)
    x = x.withColumns({"oi_dir": oid, "f_dir": fb})
    x = x.withColumns({
        "f_score": F.when(F.col("f_dir").isNotNull() & (F.col("f_dir") != d), f0 * 0.5).otherwise(f0),
        "o_score": case((F.col("oi_dir") == d, F.col("os")), (F.col("oi_dir").isNotNull(), -F.col("os")), ((s == "POTENTIAL_BOTTOM") & (d == "LONG"), F.col("os") * 0.6),
                        ((s == "WEAKENING_RALLY") & (d == "SHORT"), F.col("os") * 0.5), default=0.0),
        "same": is_true(F.col("f_dir") == F.col("oi_dir"))})
    agree = F.when(F.col("same"), F.when(F.col("f_dir") == d, 1.0).otherwise(0.8)).otherwise(0.0)
    x = x.withColumns({"raw": clamp(0.40 * F.col("f_score") + 0.35 * ((F.col("o_score") + 1) / 2) + 0.25 * agree, 0.0, 1.0), "anomaly": F.col("pattern").isin("OI_SPIKE", "OI_COLLAPSE"),
                       "db": case((F.col("same"), F.col("f_dir")), (F.col("f_dir").isNotNull() & (F.col("signal_type") == "CARRY_AND_CONTRARIAN"), F.col("f_dir")),
                                  (F.col("oi_dir").isNotNull() & (F.col("os") > 0.4), F.col("oi_dir")), default="NEUTRAL")})
    c = F.col("raw")
    sc = case(((c > 0.7) & (F.col("db") == d), F.least(F.col("oi_scalar") * 1.2, F.lit(1.4))), (c < 0.35, F.least("oi_scalar", F.lit(0.7))), default=F.col("oi_scalar"))
    an = F.col("anomaly")
    return x.select("symbol", "direction", F.when(an, 0.0).otherwise(c).alias("composite_alpha"), F.when(an, "NEUTRAL").otherwise(F.col("db")).alias("directional_bias"),
                    F.when(an, 0.3).otherwise(clamp(sc, 0.0, 1.5)).alias("size_scalar"),
                    case((an, "OI_ANOMALY"), ((c < 0.2) & (F.col("o_score") < -0.3), "LOW_ALPHA"), default="").alias("skip_reason"))


def carry_opportunities(fs: DataFrame, min_apy: float = 20.0, min_quality: float = 0.5) -> DataFrame:
    x = latest(fs).where((F.col("carry_apy_pct") >= min_apy) & (F.col("carry_quality") >= min_quality) & F.col("carry_direction").isNotNull())
    return x.select("symbol", "carry_direction", "carry_apy_pct", "rate_pct", "carry_quality", "signal_type").orderBy(F.col("carry_apy_pct").desc())


def funding_oi_snapshot(fs: DataFrame, oi: DataFrame) -> DataFrame:
    x = latest(fs).select("symbol", "rate_pct", "carry_apy_pct", "bias", "signal_type", "strength").join(
        latest(oi).select("symbol", "oi_usd", "oi_change_pct", "pattern", "signal"), "symbol")
    return x.orderBy(F.abs("rate_pct").desc())
