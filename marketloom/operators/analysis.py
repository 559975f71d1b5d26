"""Rows that join what the single operators say: one decision row per symbol, and the checks of an entry at a tick."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans import last_rows
from . import features as ft, models, risk, scores, structure as st, trades as tr

KELLY_BARS = 252  # newest daily returns that stand for a trade history


def decision_row(bars: DataFrame, rets: DataFrame | None = None) -> DataFrame:
    """Per symbol what the scores need: downside ratio, structure votes, regime and volatility regime, liquidity, z label, chance of profit, edge and
    expected value of the newest returns as trades, screener score, bars. Symbols without one of the parts (too few bars) are left out."""
    rets = ft.return_rows(bars) if rets is None else rets
    kelly = last_rows(ft.return_rows(bars, "sr").select("symbol", "ts", "r", "_i", "_n"), ["symbol"], ["ts"], KELLY_BARS)
    kelly = tr.kelly_from_trades(kelly.select(F.col("symbol").alias("strategy"), (F.col("r") * 100).alias("net_pnl_pct")))
    z = last_rows(ft.zscore_signal(bars).select("symbol", "ts", "signal"), ["symbol"], ["ts"], 1)
    parts = [
        risk.quant_metrics(rets).select("symbol", "sortino"),
        st.structure_bias(bars).select("symbol", F.col("composite_bias").alias("structure_bias"), "bullish_factors", "bearish_factors"),
        models.garch_regime(bars).select("symbol", "vol_regime"),
        ft.liquidity_regime(bars).select("symbol", "liquidity_regime"),
        risk.lognormal_forecast(rets).select("symbol", F.col("prob_profit_pct").alias("prob_profit")),
        kelly.select(F.col("strategy").alias("symbol"), F.col("edge").alias("kelly_edge"), F.col("expected_value_pct").alias("expected_value")),
        z.select("symbol", F.col("signal").alias("z_label")),
        scores.screener_score(bars).select("symbol", F.col("score").alias("screener_score"), F.col("regime_proxy").alias("regime")),
        rets.groupBy("symbol").agg((F.count(F.lit(1)) + 1).alias("n_bars"))]
    x = parts[0]
    for p in parts[1:]:
        x = x.join(p, "symbol")
    return x


def tick_states(regimes: DataFrame) -> DataFrame:
    """(symbol, ts, seq, state) from `ticks.tick_regime`: 0 volatile or dead, 1 ranging, 2 trending."""
    r = F.col("regime")
    return regimes.select("symbol", "ts", "seq", F.when(r.isin("VOLATILE", "DEAD"), 0).when(r == "RANGING", 1).otherwise(2).alias("state"))


def regime_states(history: DataFrame) -> DataFrame:
    """(symbol, ts, state) from posteriors of four regimes (p0 .. p3 of `models.bayes_history`): 0 crisis or bear, 1 sideways, 2 bull."""
    p = [F.col(f"p{k}") for k in range(4)]
    top = F.greatest(*p)
    return history.select("symbol", "ts", F.when(p[0] == top, 2).when(p[1] == top, 1).otherwise(0).alias("state"))


def entry_checks(toxicity: DataFrame, transitions: DataFrame, leads: DataFrame, tape: DataFrame) -> DataFrame:
    """Input of `flow.entry_quality` for every tick: flow toxicity, the transition forecast of its symbol's regime, the strongest triggered lead signal for the
    symbol, and the side of the tape (the sign of rolling order flow) as the direction that is asked about.

    toxicity: `flow.flow_toxicity`; transitions: `models.regime_transitions`; leads: `flow.lead_lag`; tape: symbol, ts, seq, ofi (`ticks.rolling_ofi`)."""
    best = F.max_by(F.struct("direction", "confidence"), F.struct("confidence", "leader"))
    lead = leads.where("triggered").groupBy(F.col("follower").alias("symbol")).agg(best.alias("b")).select("symbol", F.col("b.direction").alias("lead_direction"), F.col("b.confidence").alias("lead_confidence"))
    t = transitions.select("symbol", F.col("p0").alias("p_dangerous"), "stability", F.col("status").alias("transition_status"), F.col("size_scalar").alias("regime_scalar"))
    x = toxicity.join(tape, ["symbol", "ts", "seq"]).join(t, "symbol").join(lead, "symbol", "left")
    return x.withColumn("direction", F.when(F.col("ofi") >= 0.5, "LONG").otherwise("SHORT"))
