"""Queries over sequential and pair models."""

from pyspark.sql import functions as F

from ..operators import analysis as an, models as k, portfolio as pf
from . import query
from .features import rec
from .portfolio import members
from .views import r6, sql

import math

KAL = """kn AS MATERIALIZED (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
kf AS (SELECT symbol, 0::BIGINT AS i, close AS l, 0::DOUBLE AS v, 1::DOUBLE AS a, 0::DOUBLE AS b, 1::DOUBLE AS c, 0::DOUBLE AS g, 0::DOUBLE AS gs FROM kn WHERE i=1 UNION ALL
SELECT symbol, i, l+v+k0*y, v+k1*y, (1-k0)*(1-k0)*pa+k0*k0*1e-3, (1-k0)*(pb-k1*pa)+k0*k1*1e-3, k1*k1*pa-2*k1*pb+pc+k1*k1*1e-3, k0, gs+CASE WHEN i>n-20 THEN k0 ELSE 0 END FROM
 (SELECT *, pa/(pa+1e-3) AS k0, pb/(pa+1e-3) AS k1, close-l-v AS y FROM (SELECT n.symbol, n.i, n.n, n.close, f.l, f.v, f.gs, f.a+2*f.b+f.c+1e-5*0.25 AS pa, f.b+f.c+1e-5*0.5 AS pb, f.c+1e-5 AS pc FROM kf f JOIN kn n ON n.symbol=f.symbol AND n.i=f.i+1))),
kz AS (SELECT kf.symbol, close AS price, l, v, sqrt(a) AS sg, g, gs/20 AS ag, v/abs(l)*10000 AS bps FROM kf JOIN kn USING (symbol, i) WHERE i=n)"""
query("kalman_trend", rec("bars", f"SELECT symbol, {r6('price;level=l;trend=v;trend_bps=bps;upper_band=l+sg;lower_band=l-sg;sigma=sg;gain=g;avg_gain_20=ag')}, CASE WHEN bps>1 THEN 'BULLISH' WHEN bps<-1 THEN 'BEARISH' ELSE 'SIDEWAYS' END AS signal FROM kz", KAL))(lambda t: k.kalman_trend(t.bars()))
query("kalman_zscore", rec("bars", f"SELECT symbol, {r6('kalman_zscore=z;kalman_level=l;price;deviation_pct=(price-l)/l*100')}, CASE WHEN z>2.5 THEN 'OVERBOUGHT_SHORT' WHEN z>1.5 THEN 'ELEVATED_CAUTION' WHEN z<-2.5 THEN 'OVERSOLD_LONG' WHEN z<-1.5 THEN 'DEPRESSED_WATCH' ELSE 'NEUTRAL' END AS signal FROM (SELECT *, (price-l)/sg AS z FROM kz)", KAL))(lambda t: k.kalman_zscore(t.bars()))
OU = """oa AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rv FROM bars) WHERE rv<=60),
ob AS (SELECT symbol, arg_max(close,ts) AS price, regr_count(close,x) AS m, regr_slope(close,x) AS b, regr_intercept(close,x) AS c, sqrt((regr_syy(close,x)-regr_sxy(close,x)**2/regr_sxx(close,x))/(regr_count(close,x)-2)) AS se, stddev_samp(x) AS sx FROM oa GROUP BY symbol),
oc AS (SELECT *, b>0 AND b<1 AS ok, CASE WHEN b>0 AND b<1 THEN -ln(b) END AS kappa, CASE WHEN b>0 AND b<1 THEN c/(1-b) END AS mu, CASE WHEN b>0 AND b<1 THEN se/sqrt(1-b*b) END AS sou, (b-1)/greatest(se/(sx*sqrt(m)),1e-9) AS adf FROM ob),
od AS (SELECT *, ln(2)/kappa AS hl, (price-mu)/sou AS z, greatest(1.5,least(2.5,2/sqrt(2*kappa))) AS ez FROM oc)"""
query("ou_fit", sql("bars", f"SELECT symbol, {r6('price;kappa;mu;sigma_ou=sou;half_life=hl;ou_z=z;adf_stat=adf;entry_z=CASE WHEN ok THEN ez ELSE NULL END')}, ok AND adf<-2.89 AS is_mean_reverting, coalesce(hl BETWEEN 2 AND 200,false) AS profitable, CASE WHEN z IS NULL THEN 'HOLD' WHEN z<-ez THEN 'LONG_ENTRY' WHEN z>ez THEN 'SHORT_ENTRY' WHEN z>-0.5 AND z<0 THEN 'LONG_COVER' WHEN z<0.5 AND z>0 THEN 'SHORT_COVER' ELSE 'HOLD' END AS ou_signal FROM od", OU))(
    lambda t: k.ou_fit(t.bars()).withColumn("entry_z", F.when(F.col("kappa").isNotNull(), F.col("entry_z"))))


def pairs(t):
    return pf.cluster_pairs(members(t), diagonal=False)


PR = "pw AS MATERIALIZED (SELECT a.symbol AS a, b.symbol AS b, a.ts, a.close AS x, b.close AS y FROM bars_brand a JOIN bars_brand b ON a.ts=b.ts AND substr(a.symbol,7,1)=substr(b.symbol,7,1) AND a.symbol<b.symbol)"
query("cointegration_pairs", sql("bars_brand", f"SELECT a, b, n, {r6('hedge_ratio=hr;intercept=round(ic,5);adf_statistic=adf;spread=sp;spread_mean=sm;spread_std=sd;zscore=z;half_life=coalesce(hl,9999)')}, adf<-3.34 AS is_cointegrated, CASE WHEN z<-2 THEN 'LONG_SPREAD' WHEN z>2 THEN 'SHORT_SPREAD' WHEN z>-0.5 AND z<0 THEN 'EXIT_LONG' WHEN z>0 AND z<0.5 THEN 'EXIT_SHORT' ELSE 'HOLD' END AS signal FROM (SELECT *, (sp-sm)/sd AS z FROM (SELECT *, coalesce(CASE WHEN rb>0 AND rb<1 THEN rc/(1-rb) END, ms) AS sm, CASE WHEN rb>0 AND rb<1 THEN ln(2)/-ln(rb) END AS hl, psi/sqrt((s00-psi*s1y-phi*s2y)*q/(q-3)*s22/(det*q)) AS adf FROM pg))",
      PR + """, po AS (SELECT a, b, count(*) AS n, regr_slope(y,x) AS hr, regr_intercept(y,x) AS ic FROM pw GROUP BY ALL HAVING count(*)>=30),
ps AS (SELECT a, b, ts, y-ic-hr*x AS s FROM pw JOIN po USING (a, b)), pl AS (SELECT *, lag(s) OVER w AS l, s-lag(s) OVER w AS dy, lag(s) OVER w-lag(s,2) OVER w AS d1 FROM ps WINDOW w AS (PARTITION BY a, b ORDER BY ts)),
pm AS (SELECT a, b, count(d1) AS q, covar_pop(l,l) FILTER (d1 IS NOT NULL) AS s11, covar_pop(d1,d1) AS s22, covar_pop(l,d1) AS s12, covar_pop(l,dy) FILTER (d1 IS NOT NULL) AS s1y, covar_pop(d1,dy) AS s2y, covar_pop(dy,dy) FILTER (d1 IS NOT NULL) AS s00, regr_slope(s,l) AS rb, regr_intercept(s,l) AS rc, arg_max(s,ts) AS sp, avg(s) AS ms, stddev_samp(s) AS sd FROM pl GROUP BY ALL),
pg AS (SELECT *, (s1y*s22-s2y*s12)/det AS psi, (s2y*s11-s1y*s12)/det AS phi FROM (SELECT *, s11*s22-s12*s12 AS det FROM pm JOIN po USING (a, b)))"""))(lambda t: k.cointegration_pairs(t.bars_brand(), pairs(t)))
query("kalman_hedge", rec("bars_brand", f"SELECT a, b, {r6('beta=be;alpha=al;spread=s;spread_std=sd;spread_zscore=z')}, CASE WHEN z<-2 THEN 'LONG_SPREAD' WHEN z>2 THEN 'SHORT_SPREAD' ELSE 'HOLD' END AS signal FROM (SELECT a, b, arg_max(be,i) AS be, arg_max(al,i) AS al, arg_max(s,i) AS s, stddev_samp(s) FILTER (i>n-20) AS sd, (arg_max(s,i)-avg(s) FILTER (i>n-20))/stddev_samp(s) FILTER (i>n-20) AS z FROM hf JOIN (SELECT a, b, max(i) AS n FROM hp GROUP BY ALL) USING (a, b) WHERE i>0 GROUP BY a, b)",
      PR + """, hp AS MATERIALIZED (SELECT a, b, x, y, row_number() OVER (PARTITION BY a, b ORDER BY ts) AS i FROM pw JOIN (SELECT a, b FROM pw GROUP BY ALL HAVING count(*)>=20) USING (a, b)),
hf AS (SELECT a, b, 0::BIGINT AS i, 1::DOUBLE AS be, 0::DOUBLE AS al, 1::DOUBLE AS p, 0::DOUBLE AS o, 1::DOUBLE AS w, 0::DOUBLE AS s FROM hp WHERE i=1 UNION ALL
SELECT a, b, i, be1, al1, u0*a0+u1*a1+1e-3*k0*k0, u0*c0+u1*c1+1e-3*k0*k1, v0*c0+v1*c1+1e-3*k1*k1, y-be1*x-al1 FROM (SELECT *, a0*p+a1*o AS u0, a0*o+a1*w AS u1, c0*p+c1*o AS v0, c0*o+c1*w AS v1, be+k0*e AS be1, al+k1*e AS al1 FROM (SELECT *, 1-k0*x AS a0, -k0 AS a1, -k1*x AS c0, 1-k1 AS c1 FROM (SELECT *, (x*p+o)/(x*(x*p+o)+(x*o+w)+1e-3) AS k0, (x*o+w)/(x*(x*p+o)+(x*o+w)+1e-3) AS k1, y-x*be-al AS e FROM
 (SELECT h.a, h.b, h.i, h.x, h.y, f.be, f.al, f.p+1e-4 AS p, f.o, f.w+1e-4 AS w FROM hf f JOIN hp h ON h.a=f.a AND h.b=f.b AND h.i=f.i+1)))))"""))(lambda t: k.kalman_hedge(t.bars_brand(), pairs(t)))


def bayes_post(r, p="p"):
    out = []
    for j in range(4):
        pred = "+".join(f"{k.REGIME_A[i][j]}*greatest({p}{i},1e-9)" for i in range(4))
        z = f"(({r}-({k.REGIME_MU[j]}))/{k.REGIME_SD[j]})"
        out.append(f"greatest(({pred})*exp(-{z}*{z}/2)/{k.REGIME_SD[j] / 100 * math.sqrt(2 * math.pi)!r},1e-9)")
    return out


def label(p):
    return "CASE greatest(" + ",".join(f"{p}{j}" for j in range(4)) + ") " + " ".join(f"WHEN {p}{j} THEN '{g}'" for j, g in enumerate(k.REGIMES)) + " END"


BAY = ("bn AS MATERIALIZED (SELECT symbol, (close/lag(close) OVER w-1)*100 AS r, row_number() OVER w-1 AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),\n"
       "bf AS (SELECT symbol, 0::BIGINT AS i, 0.25::DOUBLE AS p0, 0.25::DOUBLE AS p1, 0.25::DOUBLE AS p2, 0.25::DOUBLE AS p3 FROM bn WHERE i=0 UNION ALL SELECT symbol, i, q0/(q0+q1+q2+q3), q1/(q0+q1+q2+q3), q2/(q0+q1+q2+q3), q3/(q0+q1+q2+q3) FROM (SELECT n.symbol, n.i, "
       + ", ".join(f"{e} AS q{j}" for j, e in enumerate(bayes_post("n.r", "f.p"))) + " FROM bf f JOIN bn n ON n.symbol=f.symbol AND n.i=f.i+1)),\n"
       f"bl AS (SELECT *, {label('p')} AS lb, max(i) OVER (PARTITION BY symbol) AS n FROM bf WHERE i>0),\n"
       "bz AS (SELECT symbol, lb, q0/(q0+q1+q2+q3) AS z0, q1/(q0+q1+q2+q3) AS z1, q2/(q0+q1+q2+q3) AS z2, q3/(q0+q1+q2+q3) AS z3 FROM (SELECT symbol, lb, " + ", ".join(f"{e} AS q{j}" for j, e in enumerate(bayes_post("0.0"))) + " FROM bl WHERE i=n)),\n"
       f"bq AS (SELECT *, {label('z')} AS cur FROM bz)")
query("bayes_regime", rec("bars", f"SELECT symbol, cur AS current_regime, {r6('prob_bull_trend=z0;prob_sideways_chop=z1;prob_bear_trend=z2;prob_crisis_vol=z3;confidence_pct=greatest(z0,z1,z2,z3)*100;uncertainty_pct=-(' + '+'.join(f'z{j}*ln(z{j}+1e-12)' for j in range(4)) + ')/ln(4)*100')}, "
      "(SELECT count(*) FROM bl WHERE bl.symbol=bq.symbol AND bl.lb=bq.cur AND bl.i<bl.n)+1 AS persistence, CASE cur WHEN 'BULL_TREND' THEN 1.2 WHEN 'BEAR_TREND' THEN 0.5 WHEN 'CRISIS_VOL' THEN 0 ELSE 0.8 END::DOUBLE AS sizing_multiplier FROM bq", BAY))(lambda t: k.bayes_regime(t.bars()))
GA = ",".join(map(str, k.GARCH_ALPHA))
GB = ",".join(map(str, k.GARCH_BETA))
GARCH = f"""gm AS (SELECT symbol, avg(r) AS mu, var_pop(r) AS v, count(*) AS n, kurtosis_pop(r) AS ku FROM rets GROUP BY symbol),
gs AS (SELECT symbol, avg(((r-mu)/sqrt(v))**3) AS sk FROM rets JOIN gm USING (symbol) GROUP BY symbol),
ge AS MATERIALIZED (SELECT symbol, (r-mu)*(r-mu) AS e, v, n, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM rets JOIN gm USING (symbol)),
gg AS (SELECT al, be FROM (SELECT unnest([{GA}])::DOUBLE AS al), (SELECT unnest([{GB}])::DOUBLE AS be) WHERE al+be<0.9999),
gf AS (SELECT symbol, al, be, i, v AS s2, ln(greatest(v,1e-12))+e/greatest(v,1e-12) AS l, e, v FROM ge, gg WHERE i=1 UNION ALL SELECT symbol, al, be, i, s2, l+ln(greatest(s2,1e-12))+e/greatest(s2,1e-12), e, v FROM (SELECT f.symbol, f.al, f.be, n.i, f.v*(1-f.al-f.be)+f.al*f.e+f.be*f.s2 AS s2, f.l, n.e, f.v FROM gf f JOIN ge n ON n.symbol=f.symbol AND n.i=f.i+1)),
gb AS (SELECT symbol, arg_min(al,(round(l/2,6),al,be)) AS al, arg_min(be,(round(l/2,6),al,be)) AS be, min(l/2) AS nll FROM gf JOIN gm USING (symbol) WHERE i=gm.n GROUP BY symbol),
gz AS (SELECT symbol, gb.al, gb.be, nll, arg_max(s2,i) AS cur, list(s2) AS ss FROM gf JOIN gb USING (symbol, al, be) GROUP BY symbol, gb.al, gb.be, nll),
gr AS (SELECT *, len(list_filter(ss, lambda z: z<cur))/len(ss)*100.0 AS rk FROM gz)"""
query("garch_regime", rec("rets", f"SELECT symbol, {r6('vol_annual_pct=sqrt(cur)*sqrt(252)*100;vol_percentile=rk;alpha=al;beta=be;nll')}, CASE WHEN rk<10 THEN 'ULTRA_LOW' WHEN rk<30 THEN 'LOW' WHEN rk<70 THEN 'NORMAL' WHEN rk<90 THEN 'HIGH' ELSE 'CRISIS' END AS vol_regime, CASE WHEN rk<10 THEN 1.2 WHEN rk<70 THEN 1.0 WHEN rk<90 THEN 0.6 ELSE 0 END::DOUBLE AS sizing_multiplier, exp(-n/6*(sk*sk+ku*ku/4)/2)<0.05 AS has_fat_tails FROM gr JOIN gm USING (symbol) JOIN gs USING (symbol)", GARCH))(
    lambda t: k.garch_regime(t.bars()))
HB = (1 / 300, 1 / 1200, 1 / 3600, 1 / 14400)
HAWKES = f"""wa AS (SELECT symbol, epoch_us(ts) AS u, max(epoch_us(ts)) OVER (PARTITION BY symbol) AS te FROM ticks),
wb AS (SELECT symbol, u, min(u) OVER (PARTITION BY symbol) AS u0, te FROM wa WHERE u>=te-86400*1000000::BIGINT),
wc AS MATERIALIZED (SELECT symbol, (u-u0)/1e6 AS t, (te-u0)/1e6 AS tt, row_number() OVER (PARTITION BY symbol ORDER BY u) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM wb),
wg AS (SELECT eta, be, eta*be AS al FROM (SELECT unnest([{','.join(map(str, k.HAWKES_ETA))}])::DOUBLE AS eta), (SELECT unnest([{','.join(f'{b!r}::DOUBLE' for b in HB)}]) AS be)),
wf AS (SELECT symbol, eta, be, al, i, t, 0::DOUBLE AS r, ln((1-eta)*n/tt) AS l, 1-exp(-be*(tt-t)) AS c, n, tt FROM wc, wg WHERE i=1 UNION ALL SELECT symbol, eta, be, al, i, t, r, l+ln(greatest((1-eta)*n/tt+al*r,1e-9)), c+1-exp(-be*(tt-t)), n, tt FROM (SELECT f.symbol, f.eta, f.be, f.al, x.i, x.t, (f.r+1)*exp(-f.be*(x.t-f.t)) AS r, f.l, f.c, f.n, f.tt FROM wf f JOIN wc x ON x.symbol=f.symbol AND x.i=f.i+1)),
wl AS (SELECT *, l-(1-eta)*n-eta*c AS ll, (1-eta)*n/tt AS mu, (1-eta)*n/tt+al*(r+1) AS it FROM wf WHERE i=n AND n>=10),
wz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(ll,6) DESC, eta, be) AS rn FROM wl) WHERE rn=1)"""
query("hawkes_clustering", rec("ticks", f"SELECT symbol, n AS n_events, {r6('mu;alpha=al;beta=be;branching_ratio=eta;cluster_size=1/(1-eta);intensity=it;log_likelihood=ll')}, CASE WHEN eta>0.7 AND it>mu*3 THEN 'STRONG_MOMENTUM_FLOW' WHEN eta>0.5 THEN 'CLUSTERING_DETECTED' WHEN eta<0.2 THEN 'CALM_BACKGROUND_FLOW' ELSE 'MODERATE_ACTIVITY' END AS signal FROM wz", HAWKES))(
    lambda t: k.hawkes_clustering(t.ticks(), 86400.0, HB))
query("hmm_regime")(lambda t: k.hmm_regime(t.bars()))
ONE = {"d": "greatest(exp(-0.5*(r-mu{k})**2/v{k})/sqrt(2*pi()*v{k}),1e-300) AS d{k}", "a": "(0.05::DOUBLE+0.85::DOUBLE*a{k})*n.d{k}", "b": "0.05::DOUBLE*(n.d0*b0+n.d1*b1+n.d2*b2)+0.85::DOUBLE*n.d{k}*b{k}"}


def three(text):
    return ", ".join(text.replace("{k}", str(j)) for j in range(3))


HMM = f"""ha AS MATERIALIZED (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rets),
hq AS (SELECT symbol, quantile_cont(r,0.33) AS lo, quantile_cont(r,0.66) AS hi FROM ha WHERE n>=30 GROUP BY symbol),
hm AS (SELECT symbol, coalesce(avg(r) FILTER (r<=lo),-0.001) AS mu0, coalesce(avg(r) FILTER (r>lo AND r<hi),0) AS mu1, coalesce(avg(r) FILTER (r>=hi),0.001) AS mu2, coalesce(greatest(var_pop(r) FILTER (r<=lo),1e-8),1e-4) AS v0,
 coalesce(greatest(var_pop(r) FILTER (r>lo AND r<hi),1e-8),5e-5) AS v1, coalesce(greatest(var_pop(r) FILTER (r>=hi),1e-8),1e-4) AS v2 FROM ha JOIN hq USING (symbol) GROUP BY symbol),
hd AS MATERIALIZED (SELECT symbol, i, n, r, {three(ONE['d'])} FROM ha JOIN hm USING (symbol)),
hf AS (SELECT symbol, i, d0/(d0+d1+d2) AS a0, d1/(d0+d1+d2) AS a1, d2/(d0+d1+d2) AS a2 FROM hd WHERE i=1 UNION ALL SELECT symbol, i, q0/(q0+q1+q2), q1/(q0+q1+q2), q2/(q0+q1+q2) FROM
 (SELECT n.symbol, n.i, {three(ONE['a'] + ' AS q{k}')} FROM hf f JOIN hd n ON n.symbol=f.symbol AND n.i=f.i+1)),
hb AS (SELECT symbol, i, 1::DOUBLE AS b0, 1::DOUBLE AS b1, 1::DOUBLE AS b2 FROM hd WHERE i=n UNION ALL SELECT symbol, i, q0/(q0+q1+q2), q1/(q0+q1+q2), q2/(q0+q1+q2) FROM
 (SELECT n.symbol, n.i-1 AS i, {three(ONE['b'] + ' AS q{k}')} FROM hb f JOIN hd n ON n.symbol=f.symbol AND n.i=f.i AND n.i>1)),
hg AS (SELECT symbol, i, n, r, a0, a1, a2, {three('a{k}*b{k}/(a0*b0+a1*b1+a2*b2) AS g{k}')}, {three('lead(d{k}*b{k}) OVER (PARTITION BY symbol ORDER BY i) AS e{k}')} FROM hd JOIN hf USING (symbol, i) JOIN hb USING (symbol, i)),
hx AS (SELECT symbol, j, k, sum(x/s) AS f FROM (SELECT symbol, j, k, i, [a0,a1,a2][j+1]*CASE WHEN j=k THEN 0.9 ELSE 0.05 END::DOUBLE*[e0,e1,e2][k+1] AS x, sum([a0,a1,a2][j+1]*CASE WHEN j=k THEN 0.9 ELSE 0.05 END::DOUBLE*[e0,e1,e2][k+1]) OVER (PARTITION BY symbol, i) AS s FROM hg, range(3) p(j), range(3) q(k) WHERE e0 IS NOT NULL) GROUP BY ALL),
hy AS (SELECT symbol, j, sum([g0,g1,g2][j+1]*r)/sum([g0,g1,g2][j+1]) AS mu, max(CASE WHEN i=n THEN [g0,g1,g2][j+1] END) AS g FROM hg, range(3) p(j) GROUP BY ALL),
hz AS (SELECT symbol, j, hy.mu, hy.g, greatest(sum([g0,g1,g2][j+1]*(r-hy.mu)**2)/sum([g0,g1,g2][j+1]),1e-8) AS v FROM hg JOIN hy USING (symbol) GROUP BY ALL),
ho AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mu, j)-1 AS st FROM hz)"""
query("hmm_step", rec("rets", f"SELECT symbol, st AS state, ['HIGH_VOL_BEARISH','SIDEWAYS_CHOP','LOW_VOL_BULLISH'][st+1] AS label, {r6('mean_ann_pct=mu*252*100;vol_ann_pct=sqrt(v*252)*100;probability_pct=g*100;to_0=t0;to_1=t1;to_2=t2')} FROM (SELECT o.symbol, o.st, any_value(o.mu) AS mu, any_value(o.v) AS v, any_value(o.g) AS g, {three('sum(f) FILTER (u.st={k})/sum(f) AS t{k}')} FROM ho o JOIN hx x ON x.symbol=o.symbol AND x.j=o.j JOIN ho u ON u.symbol=o.symbol AND u.j=x.k GROUP BY o.symbol, o.st)", HMM))(
    lambda t: k.hmm_step(t.bars()))
TRANS = """ra AS (SELECT * FROM (SELECT symbol, s, lead(s) OVER (PARTITION BY symbol ORDER BY i) AS x, row_number() OVER (PARTITION BY symbol ORDER BY i DESC) AS rv, count(*) OVER (PARTITION BY symbol) AS m FROM states) WHERE rv<=200 AND m>=30),
rc AS (SELECT symbol, s AS cur FROM ra WHERE rv=1), rg AS (SELECT symbol, cur, (count(*) FILTER (x=0 AND s=cur)+0.5)/(count(x) FILTER (s=cur)+1.5) AS p0, (count(*) FILTER (x=1 AND s=cur)+0.5)/(count(x) FILTER (s=cur)+1.5) AS p1, (count(*) FILTER (x=2 AND s=cur)+0.5)/(count(x) FILTER (s=cur)+1.5) AS p2 FROM ra JOIN rc USING (symbol) GROUP BY ALL),
rt AS (SELECT *, greatest(0,least(1,1-en)) AS stability, greatest(0.1,least(1,1-pow(p0/0.5,1.5))) AS size_scalar, CASE WHEN p0>=0.55 THEN 'BLOCK' WHEN p0>=0.3 OR en>=0.85 THEN 'REDUCE' ELSE 'CLEAR' END AS status FROM (SELECT *, -(p0*ln(p0)+p1*ln(p1)+p2*ln(p2))/ln(3) AS en FROM rg))"""
query("regime_transitions", rec("bars", f"SELECT symbol, cur AS state, {r6('p0 p1 p2')}, {r6('entropy_norm=en;stability;size_scalar')}, status FROM rt",
      BAY + ",\nstates AS MATERIALIZED (SELECT symbol, i, CASE greatest(p0,p1,p2,p3) WHEN p0 THEN 2 WHEN p1 THEN 1 ELSE 0 END AS s FROM bf WHERE i>0),\n" + TRANS))(
    lambda t: k.regime_transitions(an.regime_states(k.bayes_history(t.bars()))))
query("regime_composite")(lambda t: k.regime_composite(t.bars()))
query("model_vote_signal")(lambda t: k.model_vote_signal(t.bars()))
