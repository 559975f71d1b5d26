"""Queries over order flow, lead-lag, funding and open interest."""

from pyspark.sql import functions as F

from ..operators import analysis as an, flow as k, models as md, ticks as tk, universe as un
from . import query
from .models import TRANS
from .views import r6, sql

W = "PARTITION BY symbol ORDER BY ts, seq"


def fr(n, p="symbol", o="ts, seq"):
    return f"(PARTITION BY {p} ORDER BY {o} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def kyle(n, cap):
    return f"""ya AS (SELECT *, price-lag(price) OVER ({W}) AS dp, row_number() OVER ({W})-1 AS i FROM ticks),
yb AS (SELECT *, sign(dp)*greatest(volume,1e-12) AS sv FROM ya),
yc AS (SELECT *, CASE WHEN i>=10 THEN CASE WHEN var_pop(sv) OVER {fr(n)}<1e-12 THEN 0 ELSE greatest({-cap},least({cap},covar_samp(dp,sv) OVER {fr(n)}/var_pop(sv) OVER {fr(n)})) END END AS lam FROM yb)"""


query("kyle_lambda", sql("ticks", f"SELECT symbol, ts, seq, {r6('lambda_raw=lam;lambda_smooth=sm')}, CASE WHEN abs(sm)<0.5 THEN 'LOW' WHEN abs(sm)<1.0 THEN 'CAUTION' ELSE 'HIGH' END AS toxicity_level FROM (SELECT *, list_reduce(h, lambda a, x: 0.2*x+0.8*a) AS sm FROM (SELECT *, list(lam) FILTER (lam IS NOT NULL) OVER {fr(50)} AS h FROM yc) WHERE lam IS NOT NULL)", kyle(80, 10.0)))(
    lambda t: k.kyle_lambda(t.ticks(), cap=10.0, low=0.5, high=1.0))
TOX = kyle(60, 10.0) + f""",
yd AS (SELECT *, list(price) OVER {fr(60)} AS px, avg(volume) OVER ({W} ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING) AS vm, stddev_pop(volume) OVER ({W} ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING) AS vs FROM yc),
ye AS (SELECT *, len(px) AS m, least(15,len(px)-1) AS lg, abs((bid_size-ask_size)/(bid_size+ask_size+1e-12)) AS imb FROM yd),
yf AS (SELECT *, list_transform(list_filter(range(0, m-lg, greatest(1,lg//5)), lambda i: abs(px[i+lg//3+1]-px[i+1])>1e-12), lambda i: least(abs(px[i+lg+1]-px[i+1])/abs(px[i+lg//3+1]-px[i+1]),2)/2) AS pt FROM ye WHERE i>=14),
yg AS (SELECT symbol, ts, seq, i, greatest(0,least(1,0.4*least(abs(coalesce(lam,0))/(1.0+1e-12),1)+0.35*coalesce(list_avg(pt),0)+0.25*CASE WHEN m>=20 AND imb>0.2 THEN greatest(0,least(1,least(greatest((volume-vm)/(vs+1e-12)-2,0)/3,1)*imb*3)) ELSE 0 END)) AS score FROM yf
 UNION ALL SELECT symbol, ts, seq, i, 0 FROM ye WHERE i<14),
tox AS (SELECT * FROM (SELECT *, (3*avg(score) OVER {fr(5)}+avg(score) OVER ({W} ROWS BETWEEN 29 PRECEDING AND 5 PRECEDING))/4 AS toxicity FROM yg) WHERE i>=14),
toxr AS (SELECT *, CASE WHEN toxicity<0.25 THEN 'CLEAN' WHEN toxicity<0.55 THEN 'MIXED' WHEN toxicity<0.75 THEN 'TOXIC' ELSE 'DANGEROUS' END AS flow_regime FROM tox)"""


def tox(t):
    return k.flow_toxicity(t.ticks(), cap=10.0, high=1.0)


query("flow_toxicity", sql("ticks", f"SELECT symbol, ts, seq, {r6('score toxicity')}, flow_regime, CASE flow_regime WHEN 'CLEAN' THEN 1.0 WHEN 'MIXED' THEN 0.7 ELSE 0 END::DOUBLE AS size_scalar FROM toxr", TOX))(tox)

LL = """ha AS (SELECT symbol, date_trunc('hour',ts)::TIMESTAMP AS ts, arg_max(price,(ts,seq)) AS close FROM ticks GROUP BY ALL),
hb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM ha) WHERE k<=60),
hc AS (SELECT symbol, ts, k, close/lag(close) OVER w-1 AS r, (close/lag(close,2) OVER w-1)*100 AS m3 FROM hb WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
hd AS (SELECT a.symbol AS leader, b.symbol AS follower, g AS lag, corr(a.r,b.r) AS c FROM hc a, hc b, range(1,11) q(g) WHERE a.symbol<b.symbol AND b.k=a.k-g AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL),
he AS (SELECT leader, follower, arg_max(lag,(abs(round(c,9)),-lag)) AS lag, arg_max(c,(abs(round(c,9)),-lag)) AS correlation FROM hd GROUP BY ALL),
hf AS (SELECT he.*, m3 AS move_pct, ts AS signal_ts, greatest(0,least(1,abs(correlation)*least(abs(m3)/0.1,1)*(1+0.2*0.3))) AS confidence, CASE WHEN m3>0 THEN 'LONG' ELSE 'SHORT' END AS direction, abs(correlation)>=0.2 AND abs(m3)>=0.03 AS triggered FROM he JOIN hc ON hc.symbol=leader AND hc.k=1)"""


def hourly(t):
    return un.bars_from_ticks(t.ticks(), "1 hour")


def pairs(t):
    """Ordered pairs of the five event series, leader first (a fixed dimension of ten rows)."""
    names = ["click", "error", "purchase", "signup", "view"]
    lit = ",".join(f"('{a}','{b}',0.2D)" for i, a in enumerate(names) for b in names[i + 1:])
    return t.spark.sql(f"SELECT * FROM VALUES {lit} AS p(leader, follower, rank_gap)")


def leads(t):
    return k.lead_lag(hourly(t), pairs(t), min_corr=0.2)


query("lead_lag", sql("ticks", f"SELECT leader, follower, lag, {r6('correlation move_pct confidence')}, direction, triggered, signal_ts FROM hf", LL))(leads)
query("active_lead_signals", sql("ticks", f"SELECT follower, leader, direction, {r6('confidence')}, lag, {r6('age_s')} FROM (SELECT *, epoch(TIMESTAMP '2024-01-31 00:00:00')-epoch(signal_ts) AS age_s, row_number() OVER (PARTITION BY follower ORDER BY confidence DESC, leader) AS rn FROM hf WHERE triggered AND epoch(TIMESTAMP '2024-01-31 00:00:00')-epoch(signal_ts) BETWEEN 0 AND 14400) "
      "WHERE rn=1 AND follower IN (SELECT symbol FROM ticks GROUP BY symbol HAVING arg_max(bid_size,(ts,seq))>30)", LL))(
    lambda t: k.active_lead_signals(leads(t), t.ticks().groupBy("symbol").agg(F.max_by("bid_size", F.struct("ts", "seq")).alias("b")).select("symbol", F.when(F.col("b") > 30, "CLEAN").otherwise("MIXED").alias("flow_regime")),
                                    F.lit("2024-01-31 00:00:00").cast("timestamp"), 14400.0))
REG = """ta AS (SELECT symbol, ts, seq, price, (price-lag(price) OVER (WW))/lag(price) OVER (WW)*100 AS r, row_number() OVER (WW) AS i FROM ticks),
tb AS (SELECT *, stddev_samp(r) OVER F21 AS v, sum((r>0)::INT) OVER F21 AS u, sum((r<0)::INT) OVER F21 AS d, count(r) OVER F21 AS c, first_value(price) OVER F22 AS f FROM ta),
states AS MATERIALIZED (SELECT symbol, i, CASE WHEN i<20 THEN 1 WHEN v<300 OR v>3000 THEN 0 WHEN greatest(u,d)/c>=0.6 AND abs(price-f)/f*100>0.02 THEN 2 ELSE 1 END AS s FROM tb)""".replace("WW", W).replace("F21", fr(21)).replace("F22", fr(22))
ENTRY = TOX + ",\n" + REG + ",\n" + TRANS + ",\n" + LL + f""",
ea AS (SELECT follower AS symbol, arg_max(direction,(confidence,leader)) AS ld, max(confidence) AS lc FROM hf WHERE triggered GROUP BY follower),
eb AS (SELECT symbol, ts, seq, CASE WHEN sum(bid_size) OVER {fr(20)}/(sum(bid_size) OVER {fr(20)}+sum(ask_size) OVER {fr(20)})>=0.5 THEN 'LONG' ELSE 'SHORT' END AS direction FROM ticks),
ec AS (SELECT symbol, ts, seq, direction, toxicity, CASE flow_regime WHEN 'CLEAN' THEN 1.0 WHEN 'MIXED' THEN 0.7 ELSE 0 END AS ss, stability AS st, size_scalar AS rs, ld, lc, CASE WHEN toxicity>=0.75 THEN 'TOXIC_FLOW' WHEN status='BLOCK' THEN 'REGIME_TRANSITION' ELSE '' END AS br FROM toxr JOIN eb USING (symbol, ts, seq) JOIN rt USING (symbol) LEFT JOIN ea USING (symbol))"""


def entries(t):
    states = an.tick_states(tk.tick_regime(t.ticks(), vol_low=300.0, vol_high=3000.0)).select("symbol", F.struct("ts", "seq").alias("ts"), "state")
    return k.entry_quality(an.entry_checks(tox(t), md.regime_transitions(states), leads(t), tk.rolling_ofi(t.ticks())))


query("entry_quality", sql("ticks", f"SELECT symbol, ts, seq, direction, {r6('composite_quality=greatest(0,least(1,0.4*(1-toxicity)+0.3*st+0.3*CASE WHEN ld IS NULL THEN 0.7 WHEN ld=direction THEN lc ELSE 1-lc*0.5 END));final_scalar=greatest(0,least(1,CASE WHEN ld IS NOT NULL AND ld<>direction THEN least(ss,0.5) ELSE ss END*rs))')}, br AS block_reason, br='' AS approved FROM ec", ENTRY))(
    lambda t: entries(t).select("symbol", "ts", "seq", "direction", "composite_quality", "final_scalar", "block_reason", "approved"))

FW = fr(48, o="ts")
FS = f"""fa AS (SELECT *, avg(rate) OVER {FW} AS mean, stddev_pop(rate) OVER {FW}+1e-12 AS sd, avg((rate>0)::INT) OVER {FW} AS pos, avg((rate<0)::INT) OVER {FW} AS neg, rate*100 AS p FROM funding),
fb AS (SELECT *, CASE WHEN abs(p)>=0.005 THEN CASE WHEN rate>0 THEN 'SHORT' ELSE 'LONG' END END AS carry_direction, greatest(0,least(1,1-least(sd/(abs(mean)+1e-12),1))) AS consistency, CASE WHEN mean>0 THEN pos WHEN mean<0 THEN neg ELSE 1-pos-neg END AS share,
 CASE WHEN p>=0.07 THEN 'SHORT' WHEN p<=-0.035 THEN 'LONG' WHEN p>=0.02 THEN 'MILD_SHORT' ELSE 'NEUTRAL' END AS contrarian, CASE WHEN p>=0.07 THEN least((p-0.07)/0.14,1) WHEN p<=-0.035 THEN least((abs(p)-0.035)/0.07,1) WHEN p>=0.02 THEN (p-0.02)/(0.07-0.02) ELSE 0 END AS cs FROM fa),
fc AS (SELECT *, CASE WHEN carry_direction IS NOT NULL THEN abs(p)*8760 ELSE 0 END AS apy, CASE WHEN carry_direction IS NOT NULL THEN share*consistency ELSE 0 END AS cq, replace(contrarian,'MILD_','') AS side FROM fb),
fd AS (SELECT *, CASE WHEN contrarian<>'NEUTRAL' AND carry_direction=side THEN 'CARRY_AND_CONTRARIAN' WHEN cs>0.3 THEN 'CONTRARIAN' WHEN carry_direction IS NOT NULL AND cq>0.5 THEN 'CARRY' ELSE 'NONE' END AS signal_type FROM fc),
fsig AS (SELECT *, CASE WHEN signal_type IN ('CARRY_AND_CONTRARIAN','CARRY') THEN carry_direction WHEN signal_type='CONTRARIAN' THEN side ELSE 'NEUTRAL' END AS bias, CASE signal_type WHEN 'CARRY_AND_CONTRARIAN' THEN least(cq+cs,1) WHEN 'CONTRARIAN' THEN cs WHEN 'CARRY' THEN cq*0.7 ELSE 0 END AS strength, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rev FROM fd)"""
query("funding_signal", sql("funding", f"SELECT symbol, ts, {r6('rate_pct=p;rate_z=(rate-mean)/sd;carry_apy_pct=apy;carry_quality=cq;contrarian_strength=cs;consistency;strength')}, carry_direction, contrarian, signal_type, bias FROM fsig", FS))(lambda t: k.funding_signal(t.funding()))
OW = fr(59, o="ts")
OS = f"""oa AS (SELECT *, (oi_usd/lag(oi_usd) OVER w-1)*100 AS oc, (price/lag(price) OVER w-1)*100 AS pc, row_number() OVER w-1 AS i FROM oi WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
ob AS (SELECT *, avg(oc) OVER {fr(5, o='ts')} AS m5, avg(abs(oc)) OVER {OW} AS ma, stddev_pop(oc) OVER {OW}+1e-12 AS sd FROM oa),
oc AS (SELECT *, abs(oc-ma)/sd AS z, least(abs(oc)/0.1,1)*least(abs(pc)/0.015,1) AS strength FROM ob WHERE i>=2),
od AS (SELECT *, CASE WHEN z>2 AND oc>0 THEN 'OI_SPIKE' WHEN z>2 AND oc<0 THEN 'OI_COLLAPSE' WHEN oc>0.02 AND pc>0.003 THEN 'BULLISH_CONFIRM' WHEN oc>0.02 AND pc<-0.003 THEN 'BEARISH_CONFIRM' WHEN oc<-0.02 AND pc>0.003 THEN 'SHORT_COVER' WHEN oc<-0.02 AND pc<-0.003 THEN 'LONG_LIQUIDATION' ELSE 'NEUTRAL' END AS pattern FROM oc),
osig AS (SELECT *, CASE pattern WHEN 'OI_SPIKE' THEN 'VOLATILITY_WARNING' WHEN 'OI_COLLAPSE' THEN 'LIQUIDATION_CASCADE' WHEN 'BULLISH_CONFIRM' THEN 'LONG_BIAS' WHEN 'BEARISH_CONFIRM' THEN 'SHORT_BIAS' WHEN 'SHORT_COVER' THEN 'WEAKENING_RALLY' WHEN 'LONG_LIQUIDATION' THEN 'POTENTIAL_BOTTOM' ELSE 'NEUTRAL' END AS signal,
 CASE WHEN pattern IN ('OI_SPIKE','OI_COLLAPSE') THEN 0.3 WHEN pattern LIKE '%CONFIRM' THEN 1+least(strength*0.3,0.3) WHEN pattern IN ('SHORT_COVER','LONG_LIQUIDATION') THEN 0.7 ELSE 1 END AS size_scalar, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rev FROM od)"""
query("oi_signal", sql("oi", f"SELECT symbol, ts, {r6('oi_usd;oi_change_pct=oc;price_change_pct=pc;oi_z=z;strength;size_scalar')}, CASE WHEN m5>0.02 THEN 'RISING' WHEN m5<-0.02 THEN 'FALLING' ELSE 'STABLE' END AS oi_trend, pattern, signal FROM osig", OS))(lambda t: k.oi_signal(t.oi()))
query("composite_alpha", sql("funding oi", f"SELECT symbol, d AS direction, {r6('composite_alpha=CASE WHEN an THEN 0 ELSE c END;size_scalar=CASE WHEN an THEN 0.3 WHEN c>0.7 AND db=d THEN least(oi_scalar*1.2,1.4) WHEN c<0.35 THEN least(oi_scalar,0.7) ELSE oi_scalar END')}, CASE WHEN an THEN 'NEUTRAL' ELSE db END AS directional_bias, CASE WHEN an THEN 'OI_ANOMALY' WHEN c<0.2 AND os<-0.3 THEN 'LOW_ALPHA' ELSE '' END AS skip_reason FROM "
      "(SELECT *, greatest(0,least(1,0.4*fsc+0.35*(os+1)/2+0.25*CASE WHEN fdir=odir THEN CASE WHEN fdir=d THEN 1 ELSE 0.8 END ELSE 0 END)) AS c, CASE WHEN fdir=odir THEN fdir WHEN fdir IS NOT NULL AND signal_type='CARRY_AND_CONTRARIAN' THEN fdir WHEN odir IS NOT NULL AND ost>0.4 THEN odir ELSE 'NEUTRAL' END AS db, pattern IN ('OI_SPIKE','OI_COLLAPSE') AS an FROM "
      "(SELECT *, CASE WHEN fdir IS NOT NULL AND fdir<>d THEN 0.5 ELSE 1 END*CASE WHEN signal_type='CARRY_AND_CONTRARIAN' THEN least(fst*1.2,1) WHEN signal_type IN ('CONTRARIAN','CARRY') THEN fst*0.85 ELSE 0 END AS fsc, CASE WHEN odir=d THEN ost WHEN odir IS NOT NULL THEN -ost WHEN signal='POTENTIAL_BOTTOM' AND d='LONG' THEN ost*0.6 WHEN signal='WEAKENING_RALLY' AND d='SHORT' THEN ost*0.5 ELSE 0 END AS os FROM "
      "(SELECT f.symbol, signal_type, f.strength AS fst, CASE WHEN bias<>'NEUTRAL' THEN bias END AS fdir, pattern, signal, o.strength AS ost, size_scalar AS oi_scalar, CASE signal WHEN 'LONG_BIAS' THEN 'LONG' WHEN 'SHORT_BIAS' THEN 'SHORT' END AS odir, d FROM fsig f JOIN osig o ON o.symbol=f.symbol, (VALUES ('LONG'),('SHORT')) q(d) WHERE f.rev=1 AND o.rev=1)))", FS + ",\n" + OS))(
    lambda t: k.composite_alpha(k.funding_signal(t.funding()), k.oi_signal(t.oi())))
query("carry_opportunities", sql("funding", f"SELECT symbol, carry_direction, {r6('carry_apy_pct=apy;rate_pct=p;carry_quality=cq')}, signal_type FROM fsig WHERE rev=1 AND apy>=20 AND cq>=0.0 AND carry_direction IS NOT NULL", FS))(lambda t: k.carry_opportunities(k.funding_signal(t.funding()), min_quality=0.0))
query("funding_oi_snapshot", sql("funding oi", f"SELECT f.symbol, {r6('rate_pct=p;carry_apy_pct=apy;strength=f.strength;oi_usd;oi_change_pct=oc')}, bias, signal_type, pattern, signal FROM fsig f JOIN osig o ON o.symbol=f.symbol WHERE f.rev=1 AND o.rev=1", FS + ",\n" + OS))(
    lambda t: k.funding_oi_snapshot(k.funding_signal(t.funding()), k.oi_signal(t.oi())))
