"""Price features. Per-bar features keep every bar; signals keep the last bar of each symbol."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ANN, case, clamp, flag, is_true, phi, safe_div
from ..plans import BAR_CHUNK, Blocks, affine_scan, bar_blocks, by_series, last_rows, memory, narrow, ordered_array, tail_rows, time_chunk



def _lag(b: Blocks, col: str, k: int = 1) -> Column:
    return F.lag(col, k).over(b.w)


def returns(bars: DataFrame) -> DataFrame:
    """symbol, ts, close, volume, prev close, log return lr, simple return sr, position _i, series length _n."""
    b = bar_blocks(narrow(bars, "symbol", "ts", "close", "volume"), before=1)
    b = b.add(prev=_lag(b, "close"))
    b = b.add(lr=F.log(F.col("close") / F.col("prev")), sr=F.col("close") / F.col("prev") - 1)
    return b.done(drop_index=False)


def return_rows(bars: DataFrame, kind: str = "lr") -> DataFrame:
    """Returns from the second bar on, with their own positions."""
    d = returns(bars).where("_i > 0")
    return d.select("symbol", "ts", "close", F.col(kind).alias("r"), (F.col("_i") - 1).alias("_i"), (F.col("_n") - 1).alias("_n"))


def log_returns(bars: DataFrame) -> DataFrame:
    return return_rows(bars, "lr").drop("_i", "_n")


def simple_returns(bars: DataFrame) -> DataFrame:
    return return_rows(bars, "sr").drop("_i", "_n")


def roc(bars: DataFrame, ks=(3, 5, 10, 20, 60, 120)) -> DataFrame:
    b = bar_blocks(narrow(bars, "symbol", "ts", "close"), before=max(ks))
    return b.add(**{f"roc_{k}": (F.col("close") / _lag(b, "close", k) - 1) * 100 for k in ks}).done()


def rolling_mean_std(bars: DataFrame, n: int = 20) -> DataFrame:
    b = bar_blocks(narrow(bars, "symbol", "ts", "close"), before=n - 1)
    f = b.frame(n)
    return b.add(mean=b.full(n, F.avg("close").over(f)), std=b.full(n, F.stddev_samp("close").over(f)),
                 low_n=b.full(n, F.min("close").over(f)), high_n=b.full(n, F.max("close").over(f))
                 ).done().where("mean is not null")


def _ema_step(spans, x):
    def step(s, row):
        return F.struct(*[F.coalesce(s[f"ema{k}"] + F.lit(2 / (k + 1)) * (row[x] - s[f"ema{k}"]), row[x]).alias(f"ema{k}")
                          for k in spans])
    return step


def _ema_init(spans) -> Column:
    return F.struct(*[F.lit(None).cast("double").alias(f"ema{k}") for k in spans])


def ema(bars: DataFrame, spans=(20, 50)) -> DataFrame:
    """Exponential averages at every bar, seeded with the first close. Closes are not null."""
    return _add_emas(narrow(bars, "symbol", "ts", "close"), spans).drop("_i", "_n")


def _add_emas(df: DataFrame, spans=(20, 50)) -> DataFrame:
    return affine_scan(df, ["symbol"], ["ts"], time_chunk("ts", BAR_CHUNK), "close", {f"ema{k}": 2 / (k + 1) for k in spans})


def last_emas(bars: DataFrame, spans) -> DataFrame:
    """EMA values at the last bar of each symbol, from as many bars as the longest span remembers in double precision."""
    t = tail_rows(narrow(bars, "symbol", "ts", "close"), ["symbol"], ["ts"], time_chunk("ts", BAR_CHUNK), memory(1 - 2 / (max(spans) + 1)))
    arr = t.groupBy("symbol").agg(ordered_array(["close"], "ts").alias("_a"))
    return arr.select("symbol", F.aggregate("_a", _ema_init(spans), _ema_step(spans, "close")).alias("_e")).select("symbol", "_e.*")


def _add_rsi(b: Blocks, n: int = 14) -> Blocks:
    d = F.col("close") - _lag(b, "close")
    b = b.add(_up=F.when(d > 0, d).otherwise(0.0), _dn=F.when(d < 0, -d).otherwise(0.0))
    g, l = F.avg("_up").over(b.frame(n)), F.avg("_dn").over(b.frame(n))
    return b.add(rsi=b.full(n, 100 - 100 / (1 + g / F.when(l == 0, 1e-9).otherwise(l))))


def _add_tr(b: Blocks) -> Blocks:
    p = _lag(b, "close")
    return b.add(_tr=F.when(p.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p))))


def _add_atr(b: Blocks, n: int = 14) -> Blocks:
    return b.add(atr=b.full(n, F.avg("_tr").over(b.frame(n)), lead=1))


def _add_atr_pct(b: Blocks) -> Blocks:
    """Share of the last 7 rolling ATRs at or below the current one; 100 until 34 true ranges exist."""
    share = sum((flag(_lag(b, "atr", k) <= F.col("atr")) for k in range(1, 7)), F.lit(1.0)) / 7 * 100
    return b.add(atr_percentile=F.when(F.col("atr").isNotNull(), F.when(F.col("_i") >= 34, share).otherwise(100.0)))


def _add_adx(b: Blocks, n: int = 14) -> Blocks:
    """Directional movement sums over true-range sums, then a plain n-bar mean of DX (all aligned by bar)."""
    dh, dl = F.col("high") - _lag(b, "high"), F.col("low") - _lag(b, "low")
    b = b.add(_dmu=F.when((dh > F.abs(dl)) & (dh > 0), dh).otherwise(0.0),
              _dmd=F.when((F.abs(dl) > dh) & (dl < 0), F.abs(dl)).otherwise(0.0))
    f = b.frame(n)
    tr = F.sum("_tr").over(f) + 1e-9
    b = b.add(_pdi=100 * F.sum("_dmu").over(f) / tr, _mdi=100 * F.sum("_dmd").over(f) / tr)
    b = b.add(_dx=b.full(n, F.abs(F.col("_pdi") - F.col("_mdi")) / (F.col("_pdi") + F.col("_mdi") + 1e-9) * 100, lead=1))
    return b.add(adx=b.full(2 * n - 1, F.avg("_dx").over(f), lead=1))


def _add_vol_ratio(b: Blocks, n: int = 20) -> Blocks:
    m = F.avg("volume").over(b.frame(n))
    return b.add(volume_ratio=b.full(n, F.col("volume") / F.when(m == 0, 1.0).otherwise(m)))


def _add_z(b: Blocks, n: int = 20) -> Blocks:
    f = b.frame(n)
    m, s = F.avg("close").over(f), F.stddev_samp("close").over(f)
    b = b.add(_zm=b.full(n, m), _zs=b.full(n, s))
    return b.add(z=F.when(F.col("_zs") > 0, (F.col("close") - F.col("_zm")) / F.col("_zs")))


def rsi(bars, n: int = 14) -> DataFrame:
    b = _add_rsi(bar_blocks(narrow(bars, "symbol", "ts", "close"), before=n), n)
    return b.done().where("rsi is not null").select("symbol", "ts", "rsi")


def atr(bars, n: int = 14) -> DataFrame:
    b = _add_atr(_add_tr(bar_blocks(narrow(bars, "symbol", "ts", "high", "low", "close"), before=n)), n)
    return b.done().where("atr is not null").select("symbol", "ts", "atr")


def atr_percentile(bars) -> DataFrame:
    b = _add_atr_pct(_add_atr(_add_tr(bar_blocks(narrow(bars, "symbol", "ts", "high", "low", "close"), before=21))))
    return b.done().where("atr is not null").select("symbol", "ts", "atr_percentile")


def adx(bars, n: int = 14) -> DataFrame:
    b = _add_adx(_add_tr(bar_blocks(narrow(bars, "symbol", "ts", "high", "low", "close"), before=2 * n + 1)), n)
    return b.done().where("adx is not null").select("symbol", "ts", "adx")


def volume_ratio(bars, n: int = 20) -> DataFrame:
    b = _add_vol_ratio(bar_blocks(narrow(bars, "symbol", "ts", "volume"), before=n), n)
    return b.done().where("volume_ratio is not null").select("symbol", "ts", "volume_ratio")


def technicals(bars: DataFrame) -> DataFrame:
    """All per-bar indicators of the panel: one block pass for the windows, one scan for the averages."""
    b = bar_blocks(bars, before=48)
    b = _add_z(_add_vol_ratio(_add_adx(_add_atr_pct(_add_atr(_add_tr(_add_rsi(b)))))))
    b = b.add(roc_10=(F.col("close") / _lag(b, "close", 10) - 1) * 100)
    w = b.done(drop_index=False).select("symbol", "ts", "_i", "_n", "open", "high", "low", "close", "volume", "rsi", "atr",
                                        "atr_percentile", "adx", "volume_ratio", "roc_10", "z")
    return _add_emas(w)


def technicals_panel(bars: DataFrame) -> DataFrame:
    t = technicals(bars)
    return t.where("rsi is not null").select("symbol", "ts", "ema20", "ema50", "rsi", "volume", F.date_format("ts", "yyyy-MM-dd").alias("date"))


def trend_flags(features: DataFrame) -> DataFrame:
    """Boolean conditions per bar, from the 55th bar on (features: output of ``technicals``)."""
    cl, e20, e50 = F.col("close"), F.col("ema20"), F.col("ema50")
    return features.where("_i >= 54").select(
        "symbol", "ts",
        ((cl > e20) & (e20 > e50)).alias("trend_aligned_bull"), ((cl < e20) & (e20 < e50)).alias("trend_aligned_bear"),
        F.col("rsi").between(35, 72).alias("rsi_ok_long"), F.col("rsi").between(28, 65).alias("rsi_ok_short"),
        (F.col("volume_ratio") >= 0.9).alias("vol_confirmed"), (F.col("roc_10") > 0.3).alias("momentum_strong_bull"),
        (F.col("roc_10") < -0.3).alias("momentum_strong_bear"), (F.coalesce("adx", F.lit(20.0)) >= 20).alias("adx_trending"))


def z_label(z) -> Column:
    return case((z > 2.5, "STRONG_OVERBOUGHT"), (z > 1.5, "OVERBOUGHT"), (z < -2.5, "STRONG_OVERSOLD"),
                (z < -1.5, "OVERSOLD"), default="NEUTRAL")


def zscore_signal(bars: DataFrame, n: int = 20) -> DataFrame:
    b = _add_z(bar_blocks(narrow(bars, "symbol", "ts", "close"), before=n), n)
    d = b.done().where("z is not null")
    z, m, s = F.col("z"), F.col("_zm"), F.col("_zs")
    return d.select("symbol", "ts", "z", m.alias("mean"), s.alias("std"), (m + 2 * s).alias("upper_2sigma"),
                    (m - 2 * s).alias("lower_2sigma"), z_label(z).alias("signal"),
                    ((1 - phi(z)) * 100).alias("prob_higher_pct"), (phi(z) * 100).alias("prob_lower_pct"))


def zscore_band(df: DataFrame, col: str = "z") -> DataFrame:
    a = F.abs(F.col(col))
    return df.withColumn("band", case((a > 3, "EXTREME"), (a > 2, "SIGNIFICANT"), (a > 1, "ELEVATED"), default="NORMAL"))


def multi_timeframe(bars: DataFrame) -> DataFrame:
    """Three-way confluence at the last bar, for both directions."""
    b = bar_blocks(narrow(bars, "symbol", "ts", "open", "close"), before=5)
    b = b.add(c5=_lag(b, "close", 5), c3=_lag(b, "close", 3))
    last = b.done(drop_index=False).where("_i = _n - 1 and _n >= 30").drop("_i", "_n")
    x = last.join(last_emas(bars, (5, 10, 20, 50)), "symbol")
    x = x.withColumn("dir", F.explode(F.array(F.lit(1), F.lit(-1))))
    s, cl = F.col("dir"), F.col("close")
    up = lambda a, b: s * (F.col(a) - F.col(b)) > 0
    roc5 = (cl - F.col("c5")) / F.col("c5") * 100
    daily = up("close", "ema20") & up("ema20", "ema50")
    h4 = up("close", "ema5") & up("ema5", "ema10") & (s * roc5 > 0.2)
    candle = F.when(s == 1, cl > F.col("open")).otherwise(cl <= F.col("open"))
    h1 = up("close", "c3") & candle
    x = x.withColumns({"daily_aligned": daily, "h4_aligned": h4, "h1_aligned": h1, "h4_roc5": roc5})
    n = sum((F.col(k).cast("int") for k in ("daily_aligned", "h4_aligned", "h1_aligned")), F.lit(0))
    return x.withColumn("tf_aligned", n).select(
        "symbol", F.when(s == 1, "LONG").otherwise("SHORT").alias("direction"), "daily_aligned", "h4_aligned", "h1_aligned", "h4_roc5",
        "tf_aligned", (F.col("tf_aligned") / 3).alias("mtf_score"),
        case((F.col("tf_aligned") == 3, "FULL_CONFLUENCE"), (F.col("tf_aligned") == 2, "PARTIAL_CONFLUENCE"),
             (F.col("tf_aligned") == 1, "WEAK_CONFLUENCE"), default="DIVERGENT").alias("mtf_label"),
        case((F.col("tf_aligned") == 3, 1.25), (F.col("tf_aligned") == 2, 1.0), (F.col("tf_aligned") == 1, 0.75),
             default=0.0).alias("trade_freq_boost"))


def momentum_factor(bars: DataFrame) -> DataFrame:
    """Rates of change at the last bar, acceleration, share of positive horizons, volatility-adjusted momentum."""
    t = last_rows(narrow(bars, "symbol", "ts", "close"), ["symbol"], ["ts"], 122)
    w = Window.partitionBy("symbol").orderBy("ts")  # at most 122 rows
    t = t.withColumn("lr", F.log(F.col("close") / F.lag("close").over(w)))
    at = lambda k: F.max(F.when(F.col("_rev") == k, F.col("close")))
    a = t.groupBy("symbol").agg(
        F.max("_rev").alias("n"), at(1).alias("c1"), at(6).alias("c6"), at(21).alias("c21"), at(26).alias("c26"),
        at(61).alias("c61"), F.max_by("close", F.when(F.col("_rev") <= 121, F.col("_rev"))).alias("c121"),
        F.stddev_samp(F.when(F.col("_rev") <= 60, F.col("lr"))).alias("sd60"))
    pct = lambda x, y: (F.col(x) / F.col(y) - 1) * 100
    a = a.withColumns({"roc_5": pct("c1", "c6"), "roc_20": pct("c1", "c21"), "roc_60": pct("c1", "c61"),
                       "roc_120": F.when(F.col("n") > 1, pct("c1", "c121"))})
    ks = ["roc_5", "roc_20", "roc_60", "roc_120"]
    have = sum((F.col(k).isNotNull().cast("int") for k in ks), F.lit(0))
    pos = sum((flag(F.col(k) > 0) for k in ks), F.lit(0.0))
    accel = F.when(F.col("n") > 26, pct("c1", "c21") - pct("c6", "c26")).otherwise(0.0)
    a = a.withColumns({"acceleration": accel, "alignment_pct": F.when(have > 0, pos / have * 100).otherwise(50.0)})
    vann = F.col("sd60") * math.sqrt(ANN)
    a = a.withColumns({
        "acceleration_label": case((F.col("n") <= 26, "INSUFFICIENT_DATA"), (F.col("acceleration") > 0.5, "ACCELERATING"),
                                   (F.col("acceleration") < -0.5, "DECAYING"), default="STABLE"),
        "vol_adjusted": F.when((F.col("n") > 60) & (vann > 0), F.coalesce("roc_60", F.lit(0.0)) / (vann * 100)).otherwise(0.0)})
    q = clamp(F.col("alignment_pct") * 0.6 + (F.col("vol_adjusted") * 20 + 50) * 0.4, 0.0, 100.0)
    sig = case(((F.col("acceleration_label") == "ACCELERATING") & (F.col("alignment_pct") > 75), "STRONG_MOMENTUM"),
               ((F.col("acceleration_label") == "DECAYING") | (F.col("alignment_pct") < 40), "MOMENTUM_DECAY"),
               default="MODERATE_MOMENTUM")
    return a.select("symbol", sig.alias("momentum_signal"), q.alias("momentum_quality"), *ks, "acceleration",
                    "acceleration_label", "vol_adjusted", "alignment_pct")


def vol_risk_premium(bars: DataFrame) -> DataFrame:
    r = returns(bars).where("lr is not null")
    rev = F.col("_n") - F.col("_i")
    k = math.sqrt(ANN) * 100
    a = r.groupBy("symbol").agg(F.count("lr").alias("m"), (F.stddev_samp(F.when(rev <= 20, F.col("lr"))) * k).alias("rv20"),
                                (F.stddev_samp(F.when(rev <= 60, F.col("lr"))) * k).alias("rv60"),
                                (F.stddev_samp("lr") * k).alias("rv_all"))
    a = a.where("m >= 30").withColumn("rv60", F.when(F.col("m") >= 60, F.col("rv60")).otherwise(F.col("rv20")))
    a = a.withColumn("vrp", F.col("rv_all") - F.col("rv20"))
    v = F.col("vrp")
    return a.select("symbol", "rv20", "rv60", "rv_all", "vrp",
                    case((v > 5, "ELEVATED_MEAN_REVERSION"), (v < -5, "VOL_OVERSHOOTING"), default="FAIR_VALUE").alias("vrp_regime"),
                    case((v > 5, "BUY_PROTECTION"), (v < -5, "SELL_VOL_PREMIUM"), default="NEUTRAL").alias("vrp_strategy"),
                    (F.col("rv20") < F.col("rv60")).alias("contango"))


def factor_composite(bars: DataFrame) -> DataFrame:
    x = momentum_factor(bars).join(vol_risk_premium(bars), "symbol")
    vs = case((F.col("vrp_regime") == "VOL_OVERSHOOTING", 70.0), (F.col("vrp_regime") == "ELEVATED_MEAN_REVERSION", 30.0), default=50.0)
    x = x.withColumn("factor_alpha", F.col("momentum_quality") * 0.55 + vs * 0.45)
    return x.select("symbol", "momentum_signal", "vrp_regime", "factor_alpha",
                    case((F.col("factor_alpha") > 65, "TAILWIND"), (F.col("factor_alpha") < 35, "HEADWIND"), default="MIXED").alias("reading"))


K = math.sqrt(ANN) * 100


def _vol(var) -> Column:
    return F.sqrt(F.greatest(var, F.lit(0.0))) * K


def close_close_vol(bars: DataFrame) -> DataFrame:
    return returns(bars).groupBy("symbol").agg((F.stddev_pop("lr") * K).alias("vol_ann_pct"))


def parkinson_vol(bars: DataFrame) -> DataFrame:
    hl = F.log(F.col("high") / F.col("low"))
    return bars.groupBy("symbol").agg(_vol(F.avg(hl * hl) / (4 * math.log(2))).alias("vol_ann_pct"))


def garman_klass_vol(bars: DataFrame) -> DataFrame:
    hl, co = F.log(F.col("high") / F.col("low")), F.log(F.col("close") / F.col("open"))
    return bars.groupBy("symbol").agg(_vol(F.avg(0.5 * hl * hl - (2 * math.log(2) - 1) * co * co)).alias("vol_ann_pct"))


def yang_zhang_vol(bars: DataFrame, strict: bool = False) -> DataFrame:
    """Overnight + weighted close + Rogers-Satchell variance. The close term is close-to-close by default;
    strict=True takes open-to-close as in the paper."""
    b = bar_blocks(bars, before=1)
    d = b.add(p=_lag(b, "close")).done().where("p is not null")
    u, dn, co = (F.log(F.col(k) / F.col("open")) for k in ("high", "low", "close"))
    a = d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("m"), F.var_pop(F.log(F.col("open") / F.col("p"))).alias("so"),
        F.var_pop(co if strict else F.log(F.col("close") / F.col("p"))).alias("sc"),
        F.avg(u * (u - co) + dn * (dn - co)).alias("rs"))
    k = 0.34 / (1.34 + (F.col("m") + 1) / F.greatest(F.col("m") - 1, F.lit(1)))
    return a.select("symbol", _vol(F.col("so") + k * F.col("sc") + (1 - k) * F.col("rs")).alias("vol_ann_pct"),
                    (F.sqrt(F.greatest(F.col("so"), F.lit(0.0))) * 100).alias("sigma_overnight"),
                    (F.sqrt(F.greatest(F.col("rs"), F.lit(0.0))) * 100).alias("sigma_intraday_rs"))


def realized_vol_suite(bars: DataFrame) -> DataFrame:
    """Four estimators per symbol, with their median as consensus. Terms of a bar alone are summed without a shuffle of rows; the close before it is looked up
    beside open, close and the bar's term of the Rogers-Satchell sum only."""
    hl, co = F.log(F.col("high") / F.col("low")), F.log(F.col("close") / F.col("open"))
    u, dn = F.log(F.col("high") / F.col("open")), F.log(F.col("low") / F.col("open"))
    alone = bars.groupBy("symbol").agg(F.avg(hl * hl).alias("pk"), F.avg(0.5 * hl * hl - (2 * math.log(2) - 1) * co * co).alias("gk"))
    b = bar_blocks(narrow(bars, "symbol", "ts", "open", "close", (u * (u - co) + dn * (dn - co)).alias("rst")), before=1)
    d = b.add(p=_lag(b, "close")).done()
    a = d.groupBy("symbol").agg(
        F.stddev_pop(F.log(F.col("close") / F.col("p"))).alias("cc"), F.count("p").alias("m"), F.var_pop(F.log(F.col("open") / F.col("p"))).alias("so"),
        F.avg(F.when(F.col("p").isNotNull(), F.col("rst"))).alias("rs")).join(alone, "symbol")
    k = 0.34 / (1.34 + (F.col("m") + 1) / F.greatest(F.col("m") - 1, F.lit(1)))
    a = a.select("symbol", (F.col("cc") * K).alias("close_to_close"),
                 _vol(F.col("pk") / (4 * math.log(2))).alias("parkinson"), _vol("gk").alias("garman_klass"),
                 _vol(F.col("so") + k * F.col("cc") * F.col("cc") + (1 - k) * F.col("rs")).alias("yang_zhang"))
    vals = F.array_sort(F.filter(F.array("close_to_close", "parkinson", "garman_klass", "yang_zhang"), lambda v: v > 0))
    n = F.size(vals)
    med = F.when(n == 0, 0.0).otherwise((F.get(vals, F.floor((n - 1) / 2).cast("int")) + F.get(vals, F.floor(n / 2).cast("int"))) / 2)
    a = a.withColumn("consensus_vol_pct", med)
    cv = F.col("consensus_vol_pct")
    return a.withColumns({
        "vol_label": case((cv < 10, "LOW_VOL"), (cv < 30, "NORMAL"), (cv < 60, "HIGH_VOL"), default="CRISIS_VOL"),
        "efficiency_ratio": F.when(F.col("close_to_close") > 0, F.col("close_to_close") / F.greatest("yang_zhang", F.lit(1e-9))).otherwise(1.0)})


def liquidity_regime(bars: DataFrame) -> DataFrame:
    """Amihud percentile of the last bar, volume z-score and price/volume divergence -> score and label."""
    def parts(b: Blocks) -> DataFrame:
        b = b.add(ret=F.col("close") / _lag(b, "close") - 1)
        b = b.add(am=F.when(F.col("volume") != 0, F.abs("ret") / F.col("volume")),
                  vma=b.full(30, F.avg("volume").over(b.frame(30)), lead=1), vm=b.full(20, F.avg("volume").over(b.frame(20)), lead=1),
                  vs=b.full(20, F.stddev_samp("volume").over(b.frame(20)), lead=1), c20=_lag(b, "close", 20))
        d = b.done(drop_index=False).where("ret is not null")
        last = d.where("_i = _n - 1 and _n > 10").select(
            "symbol", F.col("am").alias("am_last"), (F.col("volume") / F.greatest(F.coalesce("vma", F.lit(1.0)), F.lit(1e-6))).alias("vol_ratio"),
            F.when(F.col("_i") > 20, F.col("close") / F.col("c20") - 1).otherwise(0.0).alias("trend"),
            F.coalesce(F.when(F.col("vs") != 0, (F.col("volume") - F.col("vm")) / F.col("vs")), F.lit(0.0)).alias("volume_z"))
        pct = (d.select("symbol", "am").where("am is not null").join(last.select("symbol", "am_last"), "symbol")
               .groupBy("symbol").agg((F.avg(flag(F.col("am") < F.col("am_last") * (1 - 1e-9))) * 100).alias("amihud_pct")))
        return last.join(pct, "symbol", "left")

    x = by_series(narrow(bars, "symbol", "ts", "close", "volume"), ["symbol"], ["ts"], time_chunk("ts", BAR_CHUNK), 30, parts)
    x = x.withColumn("amihud_pct", F.coalesce("amihud_pct", F.lit(50.0)))
    x = x.withColumn("liquidity_score", clamp(50 - (F.col("amihud_pct") - 50) * 0.5 + F.col("volume_z") * 10, 0.0, 100.0))
    s = F.col("liquidity_score")
    return x.select("symbol", case((s > 65, "ABUNDANT"), (s > 40, "NORMAL"), (s > 20, "THIN"), default="STRESSED").alias("liquidity_regime"),
                    "liquidity_score", "amihud_pct", "volume_z", ((F.col("trend") > 0) & (F.col("vol_ratio") < 0.8)).alias("divergence"))


def volume_spoof_flags(bars: DataFrame) -> DataFrame:
    """Bars with volume above mean + 3 deviations and a move below half the mean move."""
    r = returns(bars).where("sr is not null").select("symbol", "ts", "volume", F.abs("sr").alias("a"))
    st = r.groupBy("symbol").agg(F.avg("volume").alias("vm"), F.stddev_samp("volume").alias("vs"), F.avg("a").alias("rm"))
    x = r.join(st, "symbol")
    return x.where("volume > vm + 3 * vs and a < rm * 0.5").select(
        "symbol", "ts", "volume", ((F.col("volume") - F.col("vm")) / F.greatest("vs", F.lit(1.0))).alias("volume_zscore"))


def volume_spoof_summary(bars: DataFrame) -> DataFrame:
    f = volume_spoof_flags(bars).groupBy("symbol").agg(F.count(F.lit(1)).alias("events"))
    x = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars")).join(f, "symbol", "left").fillna({"events": 0})
    return x.withColumn("spoof_risk_level", case((F.col("events") > 3, "HIGH"), (F.col("events") > 0, "MEDIUM"), default="LOW"))


def volume_profile(bars: DataFrame, bins: int = 50) -> DataFrame:
    """Volume by price bin; point of control and the 85 % / 15 % bins of cumulative volume.
    Each bar adds volume / bins to every bin it touches (a constant factor across bins)."""
    ext = bars.groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.max_by("close", "ts").alias("price"))
    x = bars.select("symbol", "low", "high", "volume").join(ext, "symbol").withColumn("step", (F.col("hi") - F.col("lo")) / bins)
    pos = lambda p: F.floor((F.col(p) - F.col("lo")) / F.col("step"))
    first = F.greatest(F.lit(0), pos("low") - 1).cast("int")
    final = F.least(F.lit(bins - 1), pos("high") + 1).cast("int")
    x = x.where("step > 0").withColumn("bin", F.explode(F.sequence(first, final)))
    edge = lambda k: F.col("lo") + k * F.col("step")
    x = x.where((edge(F.col("bin") + 1) >= F.col("low")) & (edge(F.col("bin")) <= F.col("high")))
    v = x.groupBy("symbol", "bin").agg((F.sum("volume") / bins).alias("v"))
    w = Window.partitionBy("symbol")  # at most `bins` rows
    v = v.withColumns({"cum": F.sum("v").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "tot": F.sum("v").over(w)})
    a = v.groupBy("symbol").agg(F.max_by("bin", F.struct("v", -F.col("bin"))).alias("poc_bin"),
                                F.min(F.when(F.col("cum") >= F.col("tot") * 0.85, F.col("bin"))).alias("vah_bin"),
                                F.min(F.when(F.col("cum") >= F.col("tot") * 0.15, F.col("bin"))).alias("val_bin"))
    a = a.join(ext, "symbol")
    mid = lambda k: F.col("lo") + (F.col(k) + 0.5) * (F.col("hi") - F.col("lo")) / bins
    return a.select("symbol", mid("poc_bin").alias("poc"), mid("vah_bin").alias("vah"), mid("val_bin").alias("val"), "price",
                    (F.col("price") > mid("poc_bin")).alias("above_poc"))
