"""Queries over the decision row of each symbol."""

from ..operators import analysis as an, scores as sc
from . import query
from .features import LIQ
from .models import GARCH
from .quality import SCREEN
from .structure import VOTE
from .views import phi_sql, r6, sql


def decision_features(t):
    return an.decision_row(t.bars(), t.rets())


SQ252 = "sqrt(252)"
DEC = f"""dq AS MATERIALIZED (SELECT symbol, n+1 AS n_bars, CASE WHEN abs(dd)>1e-12 THEN mu/dd ELSE 0 END AS sortino FROM (SELECT symbol, count(*) AS n, avg(r)*252 AS mu, CASE WHEN count(*) FILTER (r<0)>1 THEN stddev_pop(r) FILTER (r<0)*{SQ252} ELSE stddev_pop(r)*{SQ252} END AS dd FROM rets GROUP BY symbol) WHERE n>=10),
ds AS MATERIALIZED (WITH {VOTE} SELECT symbol, composite_bias AS structure_bias, bullish_factors AS bu, bearish_factors AS be FROM vote),
dv AS MATERIALIZED (WITH RECURSIVE {GARCH} SELECT symbol, CASE WHEN rk<10 THEN 'ULTRA_LOW' WHEN rk<30 THEN 'LOW' WHEN rk<70 THEN 'NORMAL' WHEN rk<90 THEN 'HIGH' ELSE 'CRISIS' END AS vol_regime FROM gr JOIN gm USING (symbol) WHERE n>=20),
dl AS MATERIALIZED (WITH {LIQ} SELECT symbol, liquidity_regime FROM liqr),
df AS MATERIALIZED (SELECT symbol, {phi_sql('(dr/sv)')}*100 AS prob_profit FROM (SELECT symbol, (avg(r)-stddev_samp(r)*stddev_samp(r)/2)*30 AS dr, stddev_samp(r)*sqrt(30) AS sv, count(*) AS n FROM rets GROUP BY symbol) WHERE n>=20),
dk AS MATERIALIZED (SELECT symbol, wr*aw-(1-wr)*al AS expected_value, CASE WHEN fk<0 THEN 'NO_EDGE' WHEN fk<0.05 THEN 'WEAK' WHEN fk<0.15 THEN 'MODERATE' ELSE 'STRONG' END AS kelly_edge FROM (SELECT *, wr-(1-wr)/(aw/al) AS fk FROM
 (SELECT symbol, count(*) AS n, avg((p>0)::INT) AS wr, avg(p) FILTER (p>0) AS aw, abs(avg(p) FILTER (p<0)) AS al FROM (SELECT symbol, (exp(r)-1)*100 AS p, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rv FROM rets) WHERE rv<=252 GROUP BY symbol) WHERE n>=5 AND aw IS NOT NULL AND al IS NOT NULL)),
dz AS MATERIALIZED (SELECT symbol, CASE WHEN z>2.5 THEN 'STRONG_OVERBOUGHT' WHEN z>1.5 THEN 'OVERBOUGHT' WHEN z<-2.5 THEN 'STRONG_OVERSOLD' WHEN z<-1.5 THEN 'OVERSOLD' ELSE 'NEUTRAL' END AS z_label FROM (SELECT symbol, (arg_max(close,ts)-avg(close))/stddev_samp(close) AS z, count(*) AS n
 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rv FROM bars) WHERE rv<=20 GROUP BY symbol) WHERE n=20 AND z IS NOT NULL),
dc AS MATERIALIZED (WITH {SCREEN} SELECT symbol, score AS screener_score, regime_proxy AS regime FROM screens),
dec AS (SELECT * FROM dq JOIN ds USING (symbol) JOIN dv USING (symbol) JOIN dl USING (symbol) JOIN df USING (symbol) JOIN dk USING (symbol) JOIN dz USING (symbol) JOIN dc USING (symbol)),
decs AS (SELECT *, greatest(0,least(100,50+least(sortino*5,15)+greatest(-15,least(15,(bu-be)*3))+CASE WHEN regime LIKE '%TREND%' THEN 10 WHEN regime='MEAN_REVERTING' THEN -5 ELSE 0 END
 +CASE WHEN z_label LIKE '%OVERSOLD%' THEN 7 WHEN z_label LIKE '%OVERBOUGHT%' THEN -7 ELSE 0 END+(screener_score-50)*0.2)) AS composite_score FROM dec),
conf AS (SELECT *, (0.2*greatest(0,least(1,(composite_score-40)/60))+0.2*(CASE kelly_edge WHEN 'STRONG' THEN 1 WHEN 'MODERATE' THEN 0.7 WHEN 'NO_EDGE' THEN 0 ELSE 0.3 END)
 +0.15*(CASE WHEN structure_bias=(CASE WHEN composite_score>55 THEN 'BULLISH' WHEN composite_score<45 THEN 'BEARISH' ELSE 'NEUTRAL' END) THEN 1 ELSE 0.4 END)
 +0.15*(CASE regime||'|'||vol_regime WHEN 'LOW_VOL_BULLISH|LOW' THEN 1 WHEN 'LOW_VOL_BULLISH|NORMAL' THEN 0.9 WHEN 'SIDEWAYS_CHOP|NORMAL' THEN 0.8 WHEN 'HIGH_VOL_BEARISH|HIGH' THEN 0.5 WHEN 'HIGH_VOL_BEARISH|CRISIS' THEN 0.1 WHEN 'SIDEWAYS_CHOP|HIGH' THEN 0.4 ELSE 0.5 END)
 +0.1*(CASE liquidity_regime WHEN 'ABUNDANT' THEN 1 WHEN 'NORMAL' THEN 0.8 WHEN 'THIN' THEN 0.4 ELSE 0 END)+0.1*greatest(0,least(1,(prob_profit-40)/60))+0.05*CASE WHEN n_bars>250 THEN 1 WHEN n_bars>60 THEN 0.7 ELSE 0.3 END+0.05*greatest(0,least(1,(sortino+0.5)/2)))*100 AS confidence FROM decs)"""
query("composite_score", sql("rets", f"SELECT symbol, {r6('composite_score')}, CASE WHEN composite_score>=70 THEN 'BULLISH' WHEN composite_score<=30 THEN 'BEARISH' ELSE 'NEUTRAL' END AS verdict FROM decs", DEC)
      )(lambda t: sc.composite_score(decision_features(t)).select("symbol", "composite_score", "verdict"))
query("signal_confidence", sql("rets", f"SELECT symbol, {r6('confidence')}, CASE WHEN confidence>=75 THEN 'VERY_HIGH' WHEN confidence>=55 THEN 'HIGH' WHEN confidence>=40 THEN 'MODERATE' ELSE 'LOW' END AS confidence_label, CASE WHEN confidence>=55 THEN 'OPEN' WHEN confidence>=40 THEN 'RESTRICTED' ELSE 'CLOSED' END AS trade_gate FROM conf", DEC)
      )(lambda t: sc.signal_confidence(sc.composite_score(decision_features(t))).select("symbol", "confidence", "confidence_label", "trade_gate"))
query("active_strategy", sql("rets", f"SELECT symbol, s AS active_strategy, {r6('strategy_sizing=' + chr(40) + 'CASE s WHEN ' + repr('DEFENSIVE_SHORT_ONLY') + ' THEN 0.5 WHEN ' + repr('TREND_FOLLOWING_LONG') + ' THEN 1 WHEN ' + repr('MEAN_REVERSION_RANGE') + ' THEN 0.7 ELSE 0 END);')} FROM "
      "(SELECT symbol, CASE WHEN regime='HIGH_VOL_BEARISH' OR vol_regime IN ('HIGH','CRISIS') THEN 'DEFENSIVE_SHORT_ONLY' WHEN regime='LOW_VOL_BULLISH' AND composite_score>=65 THEN 'TREND_FOLLOWING_LONG' WHEN regime='SIDEWAYS_CHOP' OR liquidity_regime='THIN' THEN 'MEAN_REVERSION_RANGE' ELSE 'WAIT_FOR_CONFLUENCE' END AS s FROM decs)", DEC)
      )(lambda t: sc.active_strategy(sc.composite_score(decision_features(t))).select("symbol", "active_strategy", "strategy_sizing"))
query("quick_verdict", sql("rets", "SELECT symbol, CASE WHEN kelly_edge='NO_EDGE' OR expected_value<0 THEN 'STAND CLEAR' WHEN composite_score>=70 AND structure_bias='BULLISH' AND kelly_edge IN ('MODERATE','STRONG') THEN 'EXECUTE LONG' "
      "WHEN composite_score<=30 AND structure_bias='BEARISH' AND kelly_edge IN ('MODERATE','STRONG') THEN 'EXECUTE SHORT' ELSE 'STAND CLEAR' END AS quick_verdict FROM decs", DEC)
      )(lambda t: sc.quick_verdict(sc.composite_score(decision_features(t))).select("symbol", "quick_verdict"))
