"""Composite scores, labels and verdict rules."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import ANN, case, clamp, safe_div
from . import features as ft


def screener_score(bars: DataFrame) -> DataFrame:
    """Five dimensions (downside ratio 30, regime 25, momentum 20, z-score 15, volatility 10) -> 0-100 and status.
    One aggregation over the return rows: every term is conditional on the bar's distance from the end."""
    r = ft.returns(bars).withColumn("rev", F.col("_n") - F.col("_i"))
    lr, rev, k = F.col("lr"), F.col("rev"), math.sqrt(ANN)
    at = lambda j: F.max(F.when(rev == j, F.col("close")))
    a = r.groupBy("symbol").agg(
        F.count("lr").alias("m"), F.avg("lr").alias("mu"), F.stddev_samp("lr").alias("sd"),
        F.stddev_samp(F.when(lr < 0, lr)).alias("dsd"), F.count(F.when(lr < 0, 1)).alias("dn"),
        F.stddev_pop(F.when(rev <= 14, lr)).alias("sd14"), F.avg(F.when(rev <= 14, lr)).alias("mu14"),
        at(1).alias("c1"), at(4).alias("c4"), at(6).alias("c6"), at(11).alias("c11"), at(21).alias("c21"),
        F.avg(F.when(rev <= 20, F.col("close"))).alias("zm"), F.stddev_samp(F.when(rev <= 20, F.col("close"))).alias("zs")).where("m >= 20")
    dv = F.when(F.col("dn") > 1, F.col("dsd")).otherwise(F.col("sd")) * k
    pct = lambda x: F.coalesce((F.col("c1") / F.col(x) - 1) * 100, F.lit(0.0))
    a = a.withColumns({"sortino": safe_div(F.col("mu") * ANN, dv), "vr": F.col("sd14") * k / F.greatest(F.col("sd") * k, F.lit(1e-6)),
                       "roc5": pct("c6"), "roc10": pct("c11"), "roc20": pct("c21"),
                       "z": F.when(F.col("zs") != 0, (F.col("c1") - F.col("zm")) / F.col("zs")).otherwise(0.0), "vol": F.col("sd") * k * 100})
    so, mu14, r5, r10, r20, z, v = (F.col(n) for n in ("sortino", "mu14", "roc5", "roc10", "roc20", "z", "vol"))
    accel, decel = ((r5 > r10) & (r10 > 0)) | ((r5 > 0) & (r20 > 0)), (r5 < 0) & (r20 > 0)
    a = a.withColumns({
        "sortino_pts": case((so >= 1.5, 30.0), (so >= 1.0, 25.0), (so >= 0.5, 18.0), (so >= 0.0, 10.0), default=0.0),
        "regime_proxy": case(((mu14 > 0) & (F.col("vr") < 1.2), "LOW_VOL_BULLISH"), ((mu14 < 0) & (F.col("vr") > 1.5), "HIGH_VOL_BEARISH"),
                             (F.abs(mu14) < F.col("sd") * 0.3, "SIDEWAYS_CHOP"), (mu14 > 0, "MILD_BULLISH"), default="MILD_BEARISH"),
        "momentum_pts": case(((r20 > 5) & accel, 20.0), ((r20 > 2) & accel, 17.0), ((r20 > 0) & ~decel, 13.0), ((r20 > -2) & (r5 > 0), 8.0),
                             (decel, 3.0), default=0.0),
        "zscore_pts": case((z < -2, 15.0), (z < -1, 13.0), (z < 0.5, 12.0), (z < 1.5, 8.0), (z < 2.5, 3.0), default=0.0),
        "vol_pts": case((v.between(15, 30), 10.0), (v.between(10, 45), 8.0), (v.between(5, 60), 5.0), (v > 60, 0.0), default=3.0)})
    rp = F.col("regime_proxy")
    a = a.withColumn("regime_pts", case((rp == "LOW_VOL_BULLISH", 25.0), (rp == "HIGH_VOL_BEARISH", 0.0), (rp == "SIDEWAYS_CHOP", 10.0),
                                        (rp == "MILD_BULLISH", 18.0), default=5.0))
    a = a.withColumn("score", F.col("sortino_pts") + F.col("regime_pts") + F.col("momentum_pts") + F.col("zscore_pts") + F.col("vol_pts"))
    s = F.col("score")
    return a.select("symbol", "score", case((s >= 70, "READY"), (s >= 50, "MARGINAL"), default="REJECTED").alias("status"), "sortino_pts",
                    "regime_proxy", "regime_pts", "momentum_pts", "zscore_pts", "vol_pts", F.col("c1").alias("price"),
                    ((F.col("c1") / F.col("c4") - 1) * 100).alias("change_3d"))


def screener_rank(scores: DataFrame, markets: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Rank of every symbol inside its market; rank 1 is the market's top pick. markets: (symbol, market)."""
    w = Window.partitionBy("market").orderBy(F.col("score").desc(), "symbol")
    x = scores.where(F.col("score") >= min_score).join(markets, "symbol")
    x = x.withColumn("rank", F.row_number().over(w))
    return x.select("market", "symbol", "score", "status", "price", "rank", (F.col("rank") == 1).alias("top_pick"))


def composite_score(x: DataFrame) -> DataFrame:
    """50 + downside ratio + structure vote + regime + z-label + screener tilt -> 0-100 and verdict.
    Needs sortino, bullish_factors, bearish_factors, regime, z_label, screener_score."""
    s = (50 + F.least(F.col("sortino") * 5, F.lit(15.0)) + clamp((F.col("bullish_factors") - F.col("bearish_factors")) * 3.0, -15.0, 15.0)
         + case((F.col("regime").contains("TREND"), 10.0), (F.col("regime") == "MEAN_REVERTING", -5.0), default=0.0)
         + case((F.col("z_label").contains("OVERSOLD"), 7.0), (F.col("z_label").contains("OVERBOUGHT"), -7.0), default=0.0)
         + (F.col("screener_score") - 50) * 0.2)
    x = x.withColumn("composite_score", clamp(s, 0.0, 100.0))
    c = F.col("composite_score")
    return x.withColumn("verdict", case((c >= 70, "BULLISH"), (c <= 30, "BEARISH"), default="NEUTRAL"))


def signal_confidence(x: DataFrame) -> DataFrame:
    """Eight weighted scores -> 0-100, label and gate. Needs composite_score, structure_bias, kelly_edge, regime, vol_regime,
    liquidity_regime, prob_profit, n_bars, sortino."""
    sc, edge, pair = F.col("composite_score"), F.col("kelly_edge"), F.concat_ws("|", "regime", "vol_regime")
    side = case((sc > 55, "BULLISH"), (sc < 45, "BEARISH"), default="NEUTRAL")
    liq, n = F.col("liquidity_regime"), F.col("n_bars")
    parts = [
        (0.20, clamp((sc - 40) / 60, 0.0, 1.0)),
        (0.20, case((edge == "STRONG", 1.0), (edge == "MODERATE", 0.7), (edge == "NO_EDGE", 0.0), default=0.3)),
        (0.15, F.when(F.col("structure_bias") == side, 1.0).otherwise(0.4)),
        (0.15, case((pair == "LOW_VOL_BULLISH|LOW", 1.0), (pair == "LOW_VOL_BULLISH|NORMAL", 0.9), (pair == "SIDEWAYS_CHOP|NORMAL", 0.8),
                    (pair == "HIGH_VOL_BEARISH|HIGH", 0.5), (pair == "HIGH_VOL_BEARISH|CRISIS", 0.1), (pair == "SIDEWAYS_CHOP|HIGH", 0.4),
                    default=0.5)),
        (0.10, case((liq == "ABUNDANT", 1.0), (liq == "NORMAL", 0.8), (liq == "THIN", 0.4), (liq == "STRESSED", 0.0), default=0.5)),
        (0.10, clamp((F.col("prob_profit") - 40) / 60, 0.0, 1.0)),
        (0.05, case((n > 250, 1.0), (n > 60, 0.7), default=0.3)),
        (0.05, clamp((F.col("sortino") + 0.5) / 2, 0.0, 1.0))]
    x = x.withColumn("confidence", sum((w * p for w, p in parts), F.lit(0.0)) * 100)
    c = F.col("confidence")
    return x.withColumns({"confidence_label": case((c >= 75, "VERY_HIGH"), (c >= 55, "HIGH"), (c >= 40, "MODERATE"), default="LOW"),
                          "trade_gate": case((c >= 55, "OPEN"), (c >= 40, "RESTRICTED"), default="CLOSED")})


def active_strategy(x: DataFrame) -> DataFrame:
    """Needs regime, vol_regime, liquidity_regime, composite_score."""
    r, v = F.col("regime"), F.col("vol_regime")
    s = case(((r == "HIGH_VOL_BEARISH") | v.isin("HIGH", "CRISIS"), "DEFENSIVE_SHORT_ONLY"),
             ((r == "LOW_VOL_BULLISH") & (F.col("composite_score") >= 65), "TREND_FOLLOWING_LONG"),
             ((r == "SIDEWAYS_CHOP") | (F.col("liquidity_regime") == "THIN"), "MEAN_REVERSION_RANGE"), default="WAIT_FOR_CONFLUENCE")
    x = x.withColumn("active_strategy", s)
    a = F.col("active_strategy")
    return x.withColumn("strategy_sizing", case((a == "DEFENSIVE_SHORT_ONLY", 0.5), (a == "TREND_FOLLOWING_LONG", 1.0),
                                                (a == "MEAN_REVERSION_RANGE", 0.7), default=0.0))


def macro_regime(snapshot: DataFrame) -> DataFrame:
    """snapshot: (as_of, name, change_pct) with names NASDAQ, DXY, GOLD -> one row per as_of."""
    p = snapshot.groupBy("as_of").pivot("name", ["NASDAQ", "DXY", "GOLD"]).agg(F.max("change_pct"))
    n, d, g = (F.coalesce(F.col(k), F.lit(0.0)) for k in ("NASDAQ", "DXY", "GOLD"))
    p = p.select("as_of", n.alias("nasdaq_pct"), d.alias("dxy_pct"), g.alias("gold_pct"))
    n, d, g = F.col("nasdaq_pct"), F.col("dxy_pct"), F.col("gold_pct")
    p = p.withColumn("risk_score", clamp(50 + n * 3 - d * 2 - g, 0.0, 100.0))
    s = F.col("risk_score")
    return p.withColumns({"macro_regime": case(((n > 0.5) & (d < 0.3), "RISK_ON"), ((n < -0.5) | (d > 0.5), "RISK_OFF"),
                                               ((g > 1.0) & (d > 0.3), "INFLATION_FEAR"), default="TRANSITIONAL"),
                          "risk_label": case((s > 60, "RISK_ON"), (s < 40, "RISK_OFF"), default="NEUTRAL")})


def quick_verdict(x: DataFrame) -> DataFrame:
    """Needs composite_score, structure_bias, kelly_edge, expected_value."""
    ok = F.col("kelly_edge").isin("MODERATE", "STRONG")
    return x.withColumn("quick_verdict", case(
        ((F.col("kelly_edge") == "NO_EDGE") | (F.col("expected_value") < 0), "STAND CLEAR"),
        ((F.col("composite_score") >= 70) & (F.col("structure_bias") == "BULLISH") & ok, "EXECUTE LONG"),
        ((F.col("composite_score") <= 30) & (F.col("structure_bias") == "BEARISH") & ok, "EXECUTE SHORT"), default="STAND CLEAR"))


def sentiment_label(df: DataFrame, col: str = "text") -> DataFrame:
    """BULLISH / BEARISH / NEUTRAL by keyword, and the text after the last REASONING: marker."""
    up = F.upper(F.col(col))
    return df.withColumns({"sentiment": case((up.contains("BULLISH"), "BULLISH"), (up.contains("BEARISH"), "BEARISH"), default="NEUTRAL"),
                           "reasoning": F.when(F.col(col).contains("REASONING:"), F.trim(F.substring_index(F.col(col), "REASONING:", -1)))
                           .otherwise(F.col(col))})


def ownership_split(df: DataFrame) -> DataFrame:
    """insider_frac, institution_frac -> percentages; what is left is public."""
    i, n = F.round(F.coalesce("insider_frac", F.lit(0.0)) * 100, 2), F.round(F.coalesce("institution_frac", F.lit(0.0)) * 100, 2)
    return df.withColumns({"insider_pct": i, "institution_pct": n,
                           "public_pct": F.when((i > 0) | (n > 0), F.greatest(F.lit(0.0), F.round(100 - (i + n), 2))).otherwise(100.0)})
