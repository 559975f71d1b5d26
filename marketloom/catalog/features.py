"""Queries over price features."""

from ..operators import features as f
from . import query
from .views import clamp_sql, phi_sql, r6, sdiv, sql  # noqa: F401

W = "PARTITION BY symbol ORDER BY ts"


def fr(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


query("log_returns", sql("rets", f"SELECT symbol, ts, {r6('close r')} FROM rets"))(lambda t: f.log_returns(t.bars()))
query("simple_returns", sql("rets", f"SELECT symbol, ts, {r6('close;r=exp(r)-1')} FROM rets"))(lambda t: f.simple_returns(t.bars()))
query("roc", sql("bars", "SELECT symbol, ts, " + r6("close;" + ";".join(f"roc_{k}=(close/lag(close,{k}) OVER ({W})-1)*100" for k in (3, 5, 10, 20, 60, 120))) + " FROM bars")
      )(lambda t: f.roc(t.bars()))
query("rolling_mean_std", sql("bars", f"SELECT symbol, ts, {r6('close mean std low_n high_n')} FROM (SELECT symbol, ts, close, avg(close) OVER {fr(20)} AS mean, "
      f"stddev_samp(close) OVER {fr(20)} AS std, min(close) OVER {fr(20)} AS low_n, max(close) OVER {fr(20)} AS high_n, row_number() OVER ({W}) AS n FROM bars) WHERE n>=20")
      )(lambda t: f.rolling_mean_std(t.bars()))

# exponential averages at every bar: recursion by bar number, all symbols advance together


def ema_ctes(spans) -> str:
    seed = ", ".join(f"close AS ema{k}" for k in spans)
    step = ", ".join(f"e.ema{k}+{2 / (k + 1)!r}*(n.close-e.ema{k})" for k in spans)
    return ("nb AS MATERIALIZED (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars),\n"
            f"em AS (SELECT symbol, ts, close, i, {seed} FROM nb WHERE i=1 UNION ALL SELECT n.symbol, n.ts, n.close, n.i, {step} FROM em e JOIN nb n ON n.symbol=e.symbol AND n.i=e.i+1)")


def rec(views: str, body: str, ctes: str) -> str:
    return sql(views, body, ctes).replace("WITH ", "WITH RECURSIVE ", 1)


query("ema", rec("bars", f"SELECT symbol, ts, {r6('close ema20 ema50')} FROM em", ema_ctes((20, 50))))(lambda t: f.ema(t.bars()))

FEAT = f"""fa AS (SELECT *, row_number() OVER ({W})-1 AS i, count(*) OVER (PARTITION BY symbol) AS n, close-lag(close) OVER ({W}) AS d, lag(close) OVER ({W}) AS pc,
 high-lag(high) OVER ({W}) AS dh, low-lag(low) OVER ({W}) AS dl FROM bars),
fb AS (SELECT *, CASE WHEN d>0 THEN d ELSE 0 END AS up, CASE WHEN d<0 THEN -d ELSE 0 END AS dn,
 CASE WHEN pc IS NOT NULL THEN greatest(high-low, abs(high-pc), abs(low-pc)) END AS tr,
 CASE WHEN dh>abs(dl) AND dh>0 THEN dh ELSE 0 END AS dmu, CASE WHEN abs(dl)>dh AND dl<0 THEN abs(dl) ELSE 0 END AS dmd FROM fa),
fc AS (SELECT *, avg(up) OVER {fr(14)} AS g, avg(dn) OVER {fr(14)} AS l, CASE WHEN i>=14 THEN avg(tr) OVER {fr(14)} END AS atr,
 100*sum(dmu) OVER {fr(14)}/(sum(tr) OVER {fr(14)}+1e-9) AS pdi, 100*sum(dmd) OVER {fr(14)}/(sum(tr) OVER {fr(14)}+1e-9) AS mdi,
 CASE WHEN i>=19 THEN volume/(CASE WHEN avg(volume) OVER {fr(20)}=0 THEN 1 ELSE avg(volume) OVER {fr(20)} END) END AS volume_ratio,
 CASE WHEN i>=19 THEN avg(close) OVER {fr(20)} END AS zm, CASE WHEN i>=19 THEN stddev_samp(close) OVER {fr(20)} END AS zs,
 (close/lag(close,10) OVER ({W})-1)*100 AS roc_10 FROM fb),
fd AS (SELECT *, CASE WHEN i>=13 THEN 100-100/(1+g/(CASE WHEN l=0 THEN 1e-9 ELSE l END)) END AS rsi,
 CASE WHEN i>=14 THEN abs(pdi-mdi)/(pdi+mdi+1e-9)*100 END AS dx, list(atr) OVER {fr(7)} AS atrs, CASE WHEN zs>0 THEN (close-zm)/zs END AS z FROM fc),
feat AS MATERIALIZED (SELECT * EXCLUDE (atrs), CASE WHEN atr IS NOT NULL THEN CASE WHEN i>=34 THEN len(list_filter(atrs, lambda v: v<=atr))/7.0*100 ELSE 100 END END AS atr_percentile,
 CASE WHEN i>=27 THEN avg(dx) OVER {fr(14)} END AS adx FROM fd)"""

for name in ("rsi", "atr", "atr_percentile", "adx", "volume_ratio"):
    query(name, sql("bars", f"SELECT symbol, ts, {r6(name)} FROM feat WHERE {name} IS NOT NULL", FEAT))(
        lambda t, fn=getattr(f, name): fn(t.bars()))

FEAT_EMA = FEAT + ",\n" + ema_ctes((5, 10, 20, 50))
query("technicals_panel", rec("bars", f"SELECT symbol, ts, {r6('ema20 ema50 rsi volume')}, strftime(ts,'%Y-%m-%d') AS date FROM feat JOIN em USING (symbol, ts) WHERE rsi IS NOT NULL", FEAT_EMA)
      )(lambda t: f.technicals_panel(t.bars()))
FLAGS = """SELECT symbol, ts, (c>ema20 AND ema20>ema50) AS trend_aligned_bull, (c<ema20 AND ema20<ema50) AS trend_aligned_bear, rsi BETWEEN 35 AND 72 AS rsi_ok_long,
 rsi BETWEEN 28 AND 65 AS rsi_ok_short, volume_ratio>=0.9 AS vol_confirmed, roc_10>0.3 AS momentum_strong_bull, roc_10<-0.3 AS momentum_strong_bear,
 coalesce(adx,20)>=20 AS adx_trending FROM (SELECT f.*, f.close AS c, ema20, ema50 FROM feat f JOIN em USING (symbol, ts) WHERE f.i>=54)"""
query("trend_flags", rec("bars", FLAGS, FEAT_EMA))(lambda t: f.trend_flags(f.technicals(t.bars())))
ZLAB = "CASE WHEN z>2.5 THEN 'STRONG_OVERBOUGHT' WHEN z>1.5 THEN 'OVERBOUGHT' WHEN z<-2.5 THEN 'STRONG_OVERSOLD' WHEN z<-1.5 THEN 'OVERSOLD' ELSE 'NEUTRAL' END"
query("zscore_signal", sql("bars", f"SELECT symbol, ts, {r6(f'z;mean=zm;std=zs;upper_2sigma=zm+2*zs;lower_2sigma=zm-2*zs;prob_higher_pct=(1-{phi_sql(chr(122))})*100;prob_lower_pct={phi_sql(chr(122))}*100')}, "
      f"{ZLAB} AS signal FROM feat WHERE z IS NOT NULL", FEAT))(lambda t: f.zscore_signal(t.bars()))
query("zscore_band", sql("bars", f"SELECT symbol, ts, {r6('z')}, CASE WHEN abs(z)>3 THEN 'EXTREME' WHEN abs(z)>2 THEN 'SIGNIFICANT' WHEN abs(z)>1 THEN 'ELEVATED' ELSE 'NORMAL' END AS band "
      "FROM feat WHERE z IS NOT NULL", FEAT))(lambda t: f.zscore_band(f.zscore_signal(t.bars()).select("symbol", "ts", "z")))
query("multi_timeframe", rec("bars", f"""SELECT symbol, CASE WHEN s=1 THEN 'LONG' ELSE 'SHORT' END AS direction, da AS daily_aligned, h4 AS h4_aligned, h1 AS h1_aligned, {r6('h4_roc5=roc5')},
 k AS tf_aligned, {r6('mtf_score=k/3.0')}, CASE k WHEN 3 THEN 'FULL_CONFLUENCE' WHEN 2 THEN 'PARTIAL_CONFLUENCE' WHEN 1 THEN 'WEAK_CONFLUENCE' ELSE 'DIVERGENT' END AS mtf_label,
 CASE k WHEN 3 THEN 1.25 WHEN 2 THEN 1.0 WHEN 1 THEN 0.75 ELSE 0.0 END::DOUBLE AS trade_freq_boost
 FROM (SELECT *, da::INT+h4::INT+h1::INT AS k FROM (SELECT symbol, s, roc5, (s*(c-ema20)>0 AND s*(ema20-ema50)>0) AS da, (s*(c-ema5)>0 AND s*(ema5-ema10)>0 AND s*roc5>0.2) AS h4,
 (s*(c-c3)>0 AND (CASE WHEN s=1 THEN c>o ELSE c<=o END)) AS h1 FROM (SELECT l.*, ema5, ema10, ema20, ema50, (c-c5)/c5*100 AS roc5 FROM
 (SELECT symbol, ts, close AS c, open AS o, lag(close,5) OVER ({W}) AS c5, lag(close,3) OVER ({W}) AS c3, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rev FROM bars) l
 JOIN em USING (symbol, ts) WHERE rev=1), (VALUES (1),(-1)) d(s)))""", ema_ctes((5, 10, 20, 50))))(lambda t: f.multi_timeframe(t.bars()))

MOM = """ml AS (SELECT symbol, close, ln(close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS lr, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rev, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
ma AS (SELECT symbol, max(n) AS n, max(close) FILTER (rev=1) AS c1, max(close) FILTER (rev=6) AS c6, max(close) FILTER (rev=21) AS c21, max(close) FILTER (rev=26) AS c26, max(close) FILTER (rev=61) AS c61,
 max(close) FILTER (rev=least(121,n)) AS c121, stddev_samp(lr) FILTER (rev<=60) AS sd60 FROM ml GROUP BY symbol),
mb AS (SELECT *, (c1/c6-1)*100 AS roc_5, (c1/c21-1)*100 AS roc_20, (c1/c61-1)*100 AS roc_60, (c1/c121-1)*100 AS roc_120, CASE WHEN n>26 THEN (c1/c21-1)*100-(c6/c26-1)*100 ELSE 0 END AS acceleration FROM ma),
mc AS (SELECT *, ((coalesce(roc_5,0)>0)::INT+(coalesce(roc_20,0)>0)::INT+(coalesce(roc_60,0)>0)::INT+(coalesce(roc_120,0)>0)::INT)/((roc_5 IS NOT NULL)::INT+(roc_20 IS NOT NULL)::INT+(roc_60 IS NOT NULL)::INT+(roc_120 IS NOT NULL)::INT)*100.0 AS alignment_pct,
 CASE WHEN n<=26 THEN 'INSUFFICIENT_DATA' WHEN acceleration>0.5 THEN 'ACCELERATING' WHEN acceleration<-0.5 THEN 'DECAYING' ELSE 'STABLE' END AS acceleration_label,
 CASE WHEN n>60 THEN coalesce(roc_60,0)/(sd60*sqrt(252)*100) ELSE 0 END AS vol_adjusted FROM mb),
mom AS (SELECT *, greatest(0,least(100,alignment_pct*0.6+(vol_adjusted*20+50)*0.4)) AS momentum_quality,
 CASE WHEN acceleration_label='ACCELERATING' AND alignment_pct>75 THEN 'STRONG_MOMENTUM' WHEN acceleration_label='DECAYING' OR alignment_pct<40 THEN 'MOMENTUM_DECAY' ELSE 'MODERATE_MOMENTUM' END AS momentum_signal FROM mc)"""
query("momentum_factor", sql("bars", f"SELECT symbol, momentum_signal, acceleration_label, {r6('momentum_quality roc_5 roc_20 roc_60 roc_120 acceleration vol_adjusted alignment_pct')} FROM mom", MOM)
      )(lambda t: f.momentum_factor(t.bars()))
VRP = """vl AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rev FROM rets),
va AS (SELECT symbol, stddev_samp(r) FILTER (rev<=20)*sqrt(252)*100 AS rv20, CASE WHEN count(*)>=60 THEN stddev_samp(r) FILTER (rev<=60) ELSE stddev_samp(r) FILTER (rev<=20) END*sqrt(252)*100 AS rv60,
 stddev_samp(r)*sqrt(252)*100 AS rv_all FROM vl GROUP BY symbol HAVING count(*)>=30),
vrp AS (SELECT *, rv_all-rv20 AS vrp, CASE WHEN rv_all-rv20>5 THEN 'ELEVATED_MEAN_REVERSION' WHEN rv_all-rv20<-5 THEN 'VOL_OVERSHOOTING' ELSE 'FAIR_VALUE' END AS vrp_regime FROM va)"""
query("vol_risk_premium", sql("rets", f"SELECT symbol, {r6('rv20 rv60 rv_all vrp')}, vrp_regime, CASE vrp_regime WHEN 'FAIR_VALUE' THEN 'NEUTRAL' WHEN 'VOL_OVERSHOOTING' THEN 'SELL_VOL_PREMIUM' "
      "ELSE 'BUY_PROTECTION' END AS vrp_strategy, rv20<rv60 AS contango FROM vrp", VRP))(lambda t: f.vol_risk_premium(t.bars()))
query("factor_composite", sql("rets", f"SELECT symbol, momentum_signal, vrp_regime, {r6('factor_alpha=a')}, CASE WHEN a>65 THEN 'TAILWIND' WHEN a<35 THEN 'HEADWIND' ELSE 'MIXED' END AS reading FROM "
      "(SELECT *, momentum_quality*0.55+0.45*(CASE vrp_regime WHEN 'VOL_OVERSHOOTING' THEN 70 WHEN 'ELEVATED_MEAN_REVERSION' THEN 30 ELSE 50 END) AS a FROM mom JOIN vrp USING (symbol))", MOM + ",\n" + VRP)
      )(lambda t: f.factor_composite(t.bars()))

VOLS = """vo AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars),
vx AS (SELECT symbol, stddev_pop(ln(close/p)) AS cc, sqrt(avg(ln(high/low)**2)/(4*ln(2))) AS pk, sqrt(greatest(0,avg(0.5*ln(high/low)**2-(2*ln(2)-1)*ln(close/open)**2))) AS gk,
 var_pop(ln(open/p)) AS so, avg(ln(high/open)*ln(high/close)+ln(low/open)*ln(low/close)) FILTER (p IS NOT NULL) AS rs, 0.34/(1.34+(count(p)+1)/(count(p)-1)) AS k FROM vo GROUP BY symbol),
vols AS (SELECT symbol, cc*sqrt(252)*100 AS cc, pk*sqrt(252)*100 AS pk, gk*sqrt(252)*100 AS gk, sqrt(greatest(0,so+k*cc*cc+(1-k)*rs))*sqrt(252)*100 AS yz, sqrt(so)*100 AS son, sqrt(greatest(0,rs))*100 AS srs FROM vx)"""
for name, col, fn in (("close_close_vol", "cc", f.close_close_vol), ("parkinson_vol", "pk", f.parkinson_vol), ("garman_klass_vol", "gk", f.garman_klass_vol)):
    query(name, sql("bars", f"SELECT symbol, {r6('vol_ann_pct=' + col)} FROM vols", VOLS))(lambda t, fn=fn: fn(t.bars()))
query("yang_zhang_vol", sql("bars", f"SELECT symbol, {r6('vol_ann_pct=yz;sigma_overnight=son;sigma_intraday_rs=srs')} FROM vols", VOLS))(lambda t: f.yang_zhang_vol(t.bars()))
SUITE = VOLS + """,
sv AS (SELECT symbol, cc AS close_to_close, pk AS parkinson, gk AS garman_klass, yz AS yang_zhang FROM vols),
suite AS (SELECT *, list_median(list_filter([close_to_close,parkinson,garman_klass,yang_zhang], lambda v: v>0)) AS cv FROM sv)""".replace("list_median(", "list_aggregate(").replace("lambda v: v>0))", "lambda v: v>0), 'median')")
query("realized_vol_suite", sql("bars", f"SELECT symbol, {r6('close_to_close;parkinson;garman_klass;yang_zhang;consensus_vol_pct=cv;efficiency_ratio=close_to_close/greatest(yang_zhang,1e-9)')}, "
      "CASE WHEN cv<10 THEN 'LOW_VOL' WHEN cv<30 THEN 'NORMAL' WHEN cv<60 THEN 'HIGH_VOL' ELSE 'CRISIS_VOL' END AS vol_label FROM suite", SUITE))(lambda t: f.realized_vol_suite(t.bars()))
LIQ = f"""la AS (SELECT symbol, ts, close, volume, close/lag(close) OVER ({W})-1 AS ret, lag(close,20) OVER ({W}) AS c20, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rev FROM bars),
lb AS MATERIALIZED (SELECT *, abs(ret)/nullif(volume,0) AS am, arg_max(abs(ret)/nullif(volume,0),ts) OVER (PARTITION BY symbol) AS aml, avg(volume) OVER {fr(30)} AS vma, avg(volume) OVER {fr(20)} AS vm, stddev_samp(volume) OVER {fr(20)} AS vs FROM la WHERE ret IS NOT NULL),
lc AS (SELECT symbol, volume/greatest(vma,1e-6) AS vr, close/c20-1 AS tr, coalesce((volume-vm)/nullif(vs,0),0) AS volume_z FROM lb WHERE rev=1),
ld AS (SELECT symbol, avg((am<aml*(1-1e-9))::INT)*100 AS amihud_pct FROM lb GROUP BY symbol),
liq AS (SELECT *, greatest(0,least(100,50-(amihud_pct-50)*0.5+volume_z*10)) AS liquidity_score FROM lc JOIN ld USING (symbol)),
liqr AS (SELECT *, CASE WHEN liquidity_score>65 THEN 'ABUNDANT' WHEN liquidity_score>40 THEN 'NORMAL' WHEN liquidity_score>20 THEN 'THIN' ELSE 'STRESSED' END AS liquidity_regime FROM liq)"""
query("liquidity_regime", sql("bars", f"SELECT symbol, liquidity_regime, {r6('liquidity_score amihud_pct volume_z')}, (tr>0 AND vr<0.8) AS divergence FROM liqr", LIQ))(lambda t: f.liquidity_regime(t.bars()))
SPOOF = """sa AS (SELECT symbol, ts, volume, abs(close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)-1) AS a FROM bars),
sb AS (SELECT symbol, avg(volume) AS vm, stddev_samp(volume) AS vs, avg(a) AS rm FROM sa WHERE a IS NOT NULL GROUP BY symbol),
spoof AS (SELECT symbol, ts, volume, (volume-vm)/greatest(vs,1) AS volume_zscore FROM sa JOIN sb USING (symbol) WHERE volume>vm+3*vs AND a<rm*0.5)"""
query("volume_spoof_flags", sql("bars", "SELECT symbol, count(*) AS bars, coalesce(any_value(e),0) AS events, CASE WHEN coalesce(any_value(e),0)>3 THEN 'HIGH' WHEN coalesce(any_value(e),0)>0 THEN 'MEDIUM' ELSE 'LOW' END AS spoof_risk_level "
      "FROM bars LEFT JOIN (SELECT symbol, count(*) AS e FROM spoof GROUP BY symbol) USING (symbol) GROUP BY symbol", SPOOF))(lambda t: f.volume_spoof_summary(t.bars()))
query("volume_profile", sql("bars", f"""SELECT symbol, {r6('poc=lo+(pb+0.5)*(hi-lo)/50;vah=lo+(hb+0.5)*(hi-lo)/50;val=lo+(lb+0.5)*(hi-lo)/50;price')}, price>lo+(pb+0.5)*(hi-lo)/50 AS above_poc FROM pe JOIN
 (SELECT symbol, arg_max(b, v-b*1e-9) AS pb, min(b) FILTER (cum>=tot*0.85) AS hb, min(b) FILTER (cum>=tot*0.15) AS lb FROM pc GROUP BY symbol) USING (symbol)""",
      """pe AS (SELECT symbol, min(low) AS lo, max(high) AS hi, arg_max(close,ts) AS price FROM bars GROUP BY symbol),
pb AS (SELECT symbol, b, sum(volume)/50 AS v FROM bars JOIN pe USING (symbol), range(50) g(b) WHERE lo+(b+1)*((hi-lo)/50)>=low AND lo+b*((hi-lo)/50)<=high GROUP BY symbol, b),
pc AS (SELECT *, sum(v) OVER (PARTITION BY symbol ORDER BY b) AS cum, sum(v) OVER (PARTITION BY symbol) AS tot FROM pb)"""))(lambda t: f.volume_profile(t.bars()))
