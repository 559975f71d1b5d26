"""Price-structure patterns and setup scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import case, clamp, flag, is_true
from ..plans import bar_blocks, last_rows, narrow
from . import features as ft


def swing_points(bars: DataFrame, keep: int = 5) -> DataFrame:
    """Two-bar fractal highs and lows; newest ``keep`` of each kind, the newest three mark the zones."""
    b = bar_blocks(narrow(bars, "symbol", "ts", "high", "low"), before=2, after=2)
    h = lambda k: F.lag("high", k).over(b.w)
    l = lambda k: F.lag("low", k).over(b.w)
    around = (1, 2, -1, -2)
    top = bot = F.lit(True)
    for k in around:
        top, bot = top & (F.col("high") > h(k)), bot & (F.col("low") < l(k))
    d = b.add(_top=is_true(top), _bot=is_true(bot)).done()
    d = d.select("symbol", "ts", F.explode(F.array_compact(F.array(
        F.when(F.col("_top"), F.struct(F.lit("HIGH").alias("kind"), F.col("high").alias("price"))),
        F.when(F.col("_bot"), F.struct(F.lit("LOW").alias("kind"), F.col("low").alias("price")))))).alias("e"))
    d = last_rows(d.select("symbol", "ts", "e.kind", "e.price"), ["symbol", "kind"], ["ts"], keep)
    return d.select("symbol", "kind", "ts", "price", F.col("_rev").alias("rank"), (F.col("_rev") <= 3).alias("is_zone"))


def fair_value_gaps(bars: DataFrame, min_gap: float = 0.1, keep: int = 5) -> DataFrame:
    """Newest unfilled gaps per direction: low above the high two bars ago, or high below its low."""
    b = bar_blocks(bars, before=2)
    h2, l2 = F.lag("high", 2).over(b.w), F.lag("low", 2).over(b.w)
    d = b.add(h2=h2, l2=l2).done().where("h2 is not null")
    bull = F.col("low") > F.col("h2")
    bear = ~bull & (F.col("high") < F.col("l2"))
    top = F.when(bull, F.col("low")).otherwise(F.col("l2"))
    bottom = F.when(bull, F.col("h2")).otherwise(F.col("high"))
    gap = F.when(bull, (F.col("low") - F.col("h2")) / F.col("h2")).otherwise((F.col("l2") - F.col("high")) / F.col("l2")) * 100
    d = d.where(bull | bear).select("symbol", "ts", F.when(bull, "BULLISH").otherwise("BEARISH").alias("side"), top.alias("top"),
                                    bottom.alias("bottom"), ((top + bottom) / 2).alias("equilibrium"), gap.alias("gap_pct"),
                                    F.when(bull, F.col("close") < F.col("h2")).otherwise(F.col("close") > F.col("l2")).alias("filled"))
    d = last_rows(d.where((F.col("gap_pct") >= min_gap) & ~F.col("filled")), ["symbol", "side"], ["ts"], keep)
    return d.select("symbol", "side", "ts", "top", "bottom", "equilibrium", "gap_pct",
                    F.when(F.col("gap_pct") > 0.5, "STRONG").otherwise("MODERATE").alias("strength"), F.col("_rev").alias("rank"))


def _bias(bull, bear) -> Column:
    return case((bull > bear, "BULLISH"), (bear > bull, "BEARISH"), default="NEUTRAL")


def _count(side: str) -> Column:
    return F.count(F.when(F.col("side") == side, 1))


def fvg_bias(bars: DataFrame) -> DataFrame:
    g = fair_value_gaps(bars).groupBy("symbol").agg(_count("BULLISH").alias("b"), _count("BEARISH").alias("s"))
    return bars.select("symbol").distinct().join(g, "symbol", "left").select(
        "symbol", _bias(F.coalesce("b", F.lit(0)), F.coalesce("s", F.lit(0))).alias("fvg_bias"))


def _all_order_blocks(bars: DataFrame, lookback: int) -> DataFrame:
    t = last_rows(bars, ["symbol"], ["ts"], lookback)
    p, o = Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy("ts")  # at most `lookback` rows
    t = t.withColumns({"avg_b": F.avg(F.abs(F.col("close") - F.col("open"))).over(p), "avg_v": F.avg("volume").over(p),
                       "m": F.count(F.lit(1)).over(p), "nc": F.lead("close").over(o),
                       "price": F.max(F.when(F.col("_rev") == 1, F.col("close"))).over(p)})
    body = F.abs(F.col("close") - F.col("open")) > F.col("avg_b") * 1.5
    bull = (F.col("close") < F.col("open")) & body & (F.col("nc") > F.col("high"))
    bear = (F.col("close") > F.col("open")) & body & (F.col("nc") < F.col("low"))
    t = t.where((F.col("_rev") > 1) & (F.col("_rev") < F.col("m")) & (bull | bear))
    edge = F.when(bull, F.col("low")).otherwise(F.col("high"))
    return t.select("symbol", "ts", F.when(bull, "BULLISH").otherwise("BEARISH").alias("side"), F.greatest("open", "close").alias("ob_top"),
                    F.least("open", "close").alias("ob_bottom"), (F.col("volume") > F.col("avg_v") * 1.2).alias("institutional"),
                    (F.abs(F.col("price") - edge) / edge * 100).alias("distance_pct"))


def order_blocks(bars: DataFrame, lookback: int = 50, keep: int = 5) -> DataFrame:
    """Last opposite candle before an impulse within the lookback; nearest ``keep`` per side."""
    d = _all_order_blocks(bars, lookback)
    w = Window.partitionBy("symbol", "side").orderBy("distance_pct", "ts")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def ob_bias(bars: DataFrame, lookback: int = 50) -> DataFrame:
    g = _all_order_blocks(bars, lookback).groupBy("symbol").agg(_count("BULLISH").alias("b"), _count("BEARISH").alias("s"))
    return bars.select("symbol").distinct().join(g, "symbol", "left").select(
        "symbol", _bias(F.coalesce("b", F.lit(0)), F.coalesce("s", F.lit(0))).alias("ob_bias"))


def market_structure(bars: DataFrame, swing: int = 5, lookback: int = 100) -> DataFrame:
    """Swing extremes of the last 100 bars, trend of the last two highs and lows, break-of-structure flags."""
    t = last_rows(narrow(bars, "symbol", "ts", "high", "low", "close"), ["symbol"], ["ts"], lookback)
    w = Window.partitionBy("symbol").orderBy("ts")  # at most `lookback` rows
    f = w.rowsBetween(-swing, swing)
    inner = (F.row_number().over(w) > swing) & (F.col("_rev") > swing)
    t = t.withColumns({"sh": inner & (F.col("high") == F.max("high").over(f)), "sl": inner & (F.col("low") == F.min("low").over(f))})
    t = t.withColumns({"hr": F.sum(F.col("sh").cast("int")).over(w.rowsBetween(0, Window.unboundedFollowing)),
                       "lr": F.sum(F.col("sl").cast("int")).over(w.rowsBetween(0, Window.unboundedFollowing))})
    pick = lambda fl, r, k, px: F.max(F.when(F.col(fl) & (F.col(r) == k), F.col(px)))
    a = t.groupBy("symbol").agg(pick("sh", "hr", 1, "high").alias("h1"), pick("sh", "hr", 2, "high").alias("h2"),
                                pick("sl", "lr", 1, "low").alias("l1"), pick("sl", "lr", 2, "low").alias("l2"),
                                F.max(F.when(F.col("_rev") == 1, F.col("close"))).alias("price"))
    ok = F.col("h2").isNotNull() & F.col("l2").isNotNull()
    up, lo = F.col("h1") > F.col("h2"), F.col("l1") > F.col("l2")
    g = lambda v: F.when(ok, v)
    return a.select(
        "symbol", "price", case((~ok, "INSUFFICIENT_DATA"), (up & lo, "UPTREND"), (~up & ~lo, "DOWNTREND"), default="TRANSITION").alias("structure"),
        case((~ok, "NEUTRAL"), (up & lo, "BULLISH"), (~up & ~lo, "BEARISH"), default="NEUTRAL").alias("structure_bias"),
        g(F.col("h1")).alias("last_swing_high"), g(F.col("l1")).alias("last_swing_low"),
        is_true(ok & (F.col("price") > F.col("h1"))).alias("bos_bullish"), is_true(ok & (F.col("price") < F.col("l1"))).alias("bos_bearish"))


# Strength labels in rising order.
STRENGTHS = ["VERY_WEAK", "WEAK", "MODERATE", "STRONG", "VERY_STRONG"]


def bias_strength_label(raw) -> Column:
    """'3/4', a number or a label -> strength label; anything else is MODERATE."""
    s = F.trim(raw.cast("string"))
    parts = F.split(s, "/")
    num, den = parts[0].try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    frac = num / F.greatest(den, F.lit(1))
    v = s.try_cast("double")
    of_ratio = case(((frac >= 0.9) | (num >= 4), "VERY_STRONG"), ((frac >= 0.7) | (num >= 3), "STRONG"),
                    ((frac >= 0.5) | (num >= 2), "MODERATE"), default="WEAK")
    of_num = case((v >= 4, "VERY_STRONG"), (v >= 3, "STRONG"), (v >= 2, "MODERATE"), (v >= 1, "WEAK"), default="VERY_WEAK")
    return (F.when(s.isin(STRENGTHS), s)
            .when((F.size(parts) == 2) & num.isNotNull() & den.isNotNull(), of_ratio)
            .when(v.isNotNull() & ~F.isnan(v), of_num).otherwise(F.lit("MODERATE")))


def structure_bias(bars: DataFrame) -> DataFrame:
    """Weighted vote: gaps 1, order blocks 1, swing structure 2."""
    x = fvg_bias(bars).join(ob_bias(bars), "symbol").join(market_structure(bars).select("symbol", "structure_bias"), "symbol")
    votes = lambda side: ((F.col("fvg_bias") == side).cast("int") + (F.col("ob_bias") == side).cast("int")
                          + 2 * (F.col("structure_bias") == side).cast("int"))
    x = x.withColumns({"bullish_factors": votes("BULLISH"), "bearish_factors": votes("BEARISH")})
    bu, be = F.col("bullish_factors"), F.col("bearish_factors")
    txt = F.when(bu == be, F.lit("Contested")).otherwise(F.concat_ws("/", F.greatest(bu, be).cast("string"), (bu + be).cast("string")))
    return x.select("symbol", _bias(bu, be).alias("composite_bias"), bias_strength_label(txt).alias("bias_strength"),
                    "bullish_factors", "bearish_factors")


def setup_features(bars: DataFrame) -> DataFrame:
    """Last-bar feature row of every symbol with a directional bias: indicators, flags, strength, direction."""
    t = ft.technicals(bars).where("_i = _n - 1")
    cl, e20, e50 = F.col("close"), F.col("ema20"), F.col("ema50")
    t = t.withColumns({"bull": (cl > e20) & (e20 > e50), "bear": (cl < e20) & (e20 < e50), "adx": F.coalesce("adx", F.lit(20.0))})
    s = structure_bias(bars).where("composite_bias <> 'NEUTRAL'")
    return t.join(s, "symbol").withColumn("direction", F.when(F.col("composite_bias") == "BULLISH", "LONG").otherwise("SHORT"))


def dynamic_tp_multiplier(x: DataFrame) -> DataFrame:
    """Additive trend / momentum / strength score; 4 points or more widen the target by half."""
    long = F.col("direction") == "LONG"
    adx, roc = F.col("adx"), F.col("roc_10")
    score = (case((adx >= 25, 2), (adx >= 18, 1), default=0)
             + F.when(F.when(long, F.col("bull")).otherwise(F.col("bear")), 2).otherwise(0)
             + F.when(F.when(long, roc > 0.3).otherwise(roc < -0.3), 1).otherwise(0)
             + case((F.col("bias_strength").isin("STRONG", "VERY_STRONG"), 2), (F.col("bias_strength") == "MODERATE", 1), default=0)
             + F.when(F.col("volume_ratio") >= 0.9, 1).otherwise(0))
    return x.withColumn("tp_score", score).withColumn("tp_multiplier", F.when(F.col("tp_score") >= 4, 1.5).otherwise(1.0))


def setup_quality_score(x: DataFrame) -> DataFrame:
    """35 screener + 25 regime confidence + 20 strength + 4 checks of 5, minus 8 against the trend.
    Needs screener_score and regime_conf next to the columns of ``setup_features``."""
    long = F.col("direction") == "LONG"
    side = lambda a, b: F.when(long, a).otherwise(b)
    z, roc = F.coalesce("z", F.lit(0.0)), F.col("roc_10")
    st = F.col("bias_strength")
    x = x.withColumns({
        "screener_pts": F.least(F.lit(35.0), F.greatest(F.lit(0.0), (F.col("screener_score") - 50) / 50) * 35),
        "regime_pts": F.least(F.lit(25.0), F.col("regime_conf") / 100 * 25),
        "strength_pts": case((st == "VERY_WEAK", 5.0), (st == "WEAK", 10.0), (st == "MODERATE", 15.0),
                             (st.isin("STRONG", "VERY_STRONG"), 20.0), default=10.0),
        "check_pts": 5 * (flag(side(F.col("bull"), F.col("bear"))) + flag(F.col("adx") >= 20) + flag(side(z < 0.5, z > -0.5))
                          + flag(side(roc.between(0.3, 5.0), roc.between(-5.0, -0.3))))})
    total = (F.col("screener_pts") + F.col("regime_pts") + F.col("strength_pts") + F.col("check_pts")
             - 8 * flag(side(F.col("bear"), F.col("bull"))))
    return x.withColumn("quality_score", clamp(total, 0.0, 100.0))


def next_open_entry(bars: DataFrame, max_gap: float = 0.20) -> DataFrame:
    """Entry at the next bar's open; the close itself when there is no next bar or the gap is 20 % or more."""
    b = bar_blocks(narrow(bars, "symbol", "ts", "open", "close"), after=1)
    d = b.add(nxt=F.lead("open").over(b.w)).done()
    ok = is_true(F.abs(F.col("nxt") - F.col("close")) / F.greatest("close", F.lit(1e-6)) < max_gap)
    return d.select("symbol", "ts", "close", F.when(ok, F.col("nxt")).otherwise(F.col("close")).alias("entry"),
                    F.when(ok & (F.col("nxt") != F.col("close")), "NEXT_OPEN").otherwise("CLOSE_FALLBACK").alias("entry_type"))


def entry_levels(x: DataFrame, sl_atr_mult: float = 1.5, rr: float = 2.0, slippage_pct: float = 0.05) -> DataFrame:
    """Stop and target around the slipped entry. Needs entry, atr, atr_percentile, tp_multiplier, consensus_vol_pct, direction."""
    s = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    ap, v = F.col("atr_percentile"), F.col("consensus_vol_pct")
    base = case((ap > 80, 1.2), (ap < 25, 0.9), default=1.0)
    mult = case((v > 3.0, F.greatest(base, F.lit(1.30))), (v > 2.0, F.greatest(base, F.lit(1.15))),
                (v < 0.5, F.least(base, F.lit(0.85))), default=base)
    x = x.withColumns({"sl_multiplier": mult, "_s": s, "fill": F.col("entry") * (1 + s * slippage_pct / 100)})
    dist = F.col("atr") * sl_atr_mult
    return x.withColumns({"stop": F.col("fill") - F.col("_s") * dist * F.col("sl_multiplier"),
                          "target": F.col("fill") + F.col("_s") * dist * rr * F.col("tp_multiplier")}).drop("_s")
