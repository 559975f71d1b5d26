"""Queries over risk and performance aggregates."""

import math

from ..functions import RF_DAILY, z_quantile
from ..operators import features as ft, risk as k
from . import query
from .views import phi_sql, r6, sdiv, sql

S = "sqrt(252)"


def rets(t):
    return t.rets()


def sr(m, s, rf=RF_DAILY):
    return f"({sdiv(f'{m}-{rf!r}::DOUBLE', s)}*{S})"


DD = """da AS (SELECT symbol, ts, exp(sum(r) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS cum FROM rets),
db AS (SELECT symbol, cum/max(cum) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)-1 AS dd FROM da),
mdd AS (SELECT symbol, min(dd) AS mdd FROM db GROUP BY symbol)"""
query("max_drawdown", sql("rets", f"SELECT symbol, {r6('max_drawdown=mdd')} FROM mdd", DD))(lambda t: k.max_drawdown(rets(t)))
query("sharpe", sql("rets", f"SELECT symbol, {r6('sharpe=' + sr('avg(r)', 'stddev_samp(r)') + ';')} FROM rets GROUP BY symbol"))(lambda t: k.sharpe(rets(t)))

SKEW = "(avg({x}**3)-3*avg({x})*avg({x}**2)+2*avg({x})**3)/stddev_pop({x})**3"


def var_ctes(conf: float, tag: str) -> str:
    a, z = 1 - conf, z_quantile(1 - conf)
    return f"""vm{tag} AS (SELECT symbol, count(*) AS n, greatest(1,floor(count(*)*{a!r}::DOUBLE)::INT) AS kk, avg(r)+stddev_pop(r)*(({z!r})+({(z**2 - 1) / 6!r})*skp+({(z**3 - 3 * z) / 24!r})*kurtosis_pop(r)-({(2 * z**3 - 5 * z) / 36!r})*skp*skp) AS var_cf FROM rets JOIN skw USING (symbol) GROUP BY symbol, skp),
vr{tag} AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY r) AS rk FROM rets),
var{tag} AS (SELECT symbol, max(r) FILTER (rk=kk) AS var_hist, avg(r) FILTER (rk<=kk) AS cvar_hist, any_value(var_cf) AS var_cf, coalesce(avg(r) FILTER (r<=var_cf), any_value(var_cf)) AS cvar_cf FROM vr{tag} JOIN vm{tag} USING (symbol) GROUP BY symbol)"""


SK = "skw AS (SELECT symbol, avg(((r-m)/s)**3) AS skp FROM (SELECT symbol, r, avg(r) OVER (PARTITION BY symbol) AS m, stddev_pop(r) OVER (PARTITION BY symbol) AS s FROM rets) GROUP BY symbol)"
V95 = SK + ",\n" + var_ctes(0.95, "95")
query("var_cvar", sql("rets", f"SELECT symbol, {r6('var_hist cvar_hist var_cf cvar_cf')} FROM var95", V95))(lambda t: k.var_cvar(rets(t)))
query("quant_metrics", sql("rets", f"""SELECT symbol, {r6('volatility_pct=vol*100;sortino;max_drawdown_pct=mdd*100;ann_return_pct=mu*100;calmar=mu/abs(mdd);var_hist_pct=var_hist*100;cvar_hist_pct=cvar_hist*100;var_cf_pct=var_cf*100;cvar_cf_pct=cvar_cf*100;skewness=skp;excess_kurtosis=ku;omega')},
 ku>3 AS fat_tail, CASE WHEN sortino>0.5 THEN 'BULLISH' WHEN sortino<-0.2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS action FROM (SELECT *, mu/CASE WHEN dn>1 THEN dv ELSE vol END AS sortino FROM qm JOIN mdd USING (symbol) JOIN var95 USING (symbol) JOIN skw USING (symbol))""",
      DD + ",\n" + V95 + f""",
qm AS (SELECT symbol, stddev_pop(r)*{S} AS vol, avg(r)*252 AS mu, count(*) FILTER (r<0) AS dn, stddev_pop(r) FILTER (r<0)*{S} AS dv, kurtosis_pop(r) AS ku, sum(r) FILTER (r>0)/abs(sum(r) FILTER (r<0)) AS omega FROM rets GROUP BY symbol)"""))(
    lambda t: k.quant_metrics(rets(t)))
NAMES = "var_hist cvar_hist var_cf cvar_cf".split()
query("advanced_risk", sql("rets", f"SELECT symbol, {r6(';'.join(f'{n}_{c}=v{c}.{n}' for c in (95, 99) for n in NAMES))}, {r6('cdar_95=cdar;max_dd;ulcer;tail_ratio=p95/abs(p05);hi_vol_sharpe=hi;lo_vol_sharpe=lo')}, "
      "CASE WHEN ku>5 THEN 'HIGH' WHEN ku>3 THEN 'ELEVATED' ELSE 'NORMAL' END AS tail_rating, skp<-0.5 AS negative_skew FROM var95 v95 JOIN var99 v99 USING (symbol) JOIN ard USING (symbol) JOIN arq USING (symbol) JOIN arh USING (symbol) JOIN skw USING (symbol)",
      DD + ",\n" + V95 + ",\n" + var_ctes(0.99, "99") + f""",
ard AS (SELECT symbol, quantile_cont(dd,0.05) AS cdar, min(dd) AS max_dd, sqrt(avg(dd*dd)) AS ulcer FROM db GROUP BY symbol),
arq AS (SELECT symbol, quantile_cont(r,0.95) AS p95, quantile_cont(r,0.05) AS p05, kurtosis_pop(r) AS ku FROM rets GROUP BY symbol),
arv AS (SELECT * FROM (SELECT symbol, r, stddev_samp(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM rets) WHERE n>=20),
arm AS (SELECT symbol, quantile_cont(v,0.5) AS mv FROM arv GROUP BY symbol),
arh AS (SELECT symbol, {sr('avg(r) FILTER (v>=mv)', 'stddev_samp(r) FILTER (v>=mv)')} AS hi, {sr('avg(r) FILTER (v<mv)', 'stddev_samp(r) FILTER (v<mv)')} AS lo FROM arv JOIN arm USING (symbol) GROUP BY symbol)"""))(
    lambda t: k.advanced_risk(rets(t)))
LO = "la AS (SELECT symbol, r, " + ", ".join(f"lag(r,{j}) OVER w AS l{j}" for j in range(1, 13)) + """ FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
lb AS (SELECT symbol, avg(r)/stddev_samp(r) AS d, least(floor(4*pow(count(*)/100.0,2/9.0::DOUBLE)),12) AS q, """ + ", ".join(f"corr(r,l{j}) AS c{j}" for j in range(1, 13)) + """ FROM la GROUP BY symbol),
lo AS (SELECT symbol, d, q, greatest(0.05,1+2*(""" + "+".join(f"CASE WHEN {j}<=q THEN c{j}*(1-{j}/(q+1)) ELSE 0 END" for j in range(1, 13)) + ")) AS eta FROM lb)"
query("lo_adjusted_sharpe", sql("rets", f"SELECT symbol, {r6(f'raw_sharpe=d*{S};adjusted_sharpe=d*sqrt(252/eta);eta')}, q::BIGINT AS lags FROM lo", LO))(lambda t: k.lo_adjusted_sharpe(rets(t)))
BEST = (1 - k.EULER) * z_quantile(1 - 1 / 25) + k.EULER * z_quantile(1 - 1 / (25 * math.e))
TT, NU = "((sr-th)*sqrt(n-1))", "(n-1)"
DSR = SK + f""",
dsa AS (SELECT symbol, count(*) AS n, {sr('avg(r)', 'stddev_samp(r)')} AS sr, kurtosis_pop(r) AS ku FROM rets GROUP BY symbol),
dsb AS (SELECT *, {BEST!r}::DOUBLE*sqrt(greatest((1-skp*sr+(ku-1)/4*sr*sr)/n,1/n)) AS th FROM dsa JOIN skw USING (symbol)),
dsc AS (SELECT *, {TT}*(1-1/(4*{NU}))/sqrt(1+{TT}*{TT}/(2*{NU})) AS tz FROM dsb), dsr AS (SELECT *, {phi_sql('tz')} AS dsr FROM dsc)"""
query("deflated_sharpe", sql("rets", f"SELECT symbol, {r6('observed_sharpe=sr;threshold=th;probability=dsr')}, dsr>0.95 AS significant FROM dsr", DSR))(lambda t: k.deflated_sharpe(rets(t)))


def mix_sql(a, b, seed=42):
    x = f"((({a}*1000003+{b}*8191+{seed * 131071})%2147483647+12345)*48271%2147483647)"
    return f"(xor({x},{x}>>13)*69621%2147483647)"


def pois(x):
    return "CASE " + " ".join(f"WHEN {x}/2147483647.0::DOUBLE<{p!r} THEN {i}" for i, p in enumerate(k.POISSON)) + f" ELSE {len(k.POISSON)} END"


BOOT = f"""ba AS (SELECT symbol, (row_number() OVER (PARTITION BY symbol ORDER BY ts)-1)//10 AS blk, r FROM rets),
bb AS (SELECT symbol, blk, count(*) AS n, sum(r) AS s, sum(r*r) AS ss FROM ba GROUP BY ALL),
bw AS MATERIALIZED (SELECT blk, rep, {pois('x')} AS w FROM (SELECT blk, rep, {mix_sql('rep', 'blk')} AS x FROM (SELECT DISTINCT blk FROM bb), range(10000) g(rep))),
bc AS (SELECT symbol, rep, sum(w*n) AS n, sum(w*s) AS s, sum(w*ss) AS ss FROM bb JOIN bw USING (blk) WHERE w>0 GROUP BY ALL),
bd AS (SELECT symbol, {sdiv(f's/n-{RF_DAILY!r}::DOUBLE', 'sqrt(greatest((ss-s*s/n)/(n-1),0))')}*{S} AS sr FROM bc WHERE n>1),
boot AS (SELECT symbol, avg(sr) AS bm, quantile_cont(sr,0.025) AS ci_lower, quantile_cont(sr,0.975) AS ci_upper, avg((sr>0)::INT)*100 AS p0, avg((sr>1)::INT)*100 AS p1 FROM bd GROUP BY symbol)"""
query("block_bootstrap_sharpe", sql("rets", f"SELECT symbol, {r6('bootstrap_mean=bm;ci_lower;ci_upper;prob_positive_pct=p0;prob_above_1_pct=p1')} FROM boot", BOOT))(lambda t: k.block_bootstrap_sharpe(rets(t)))
TRADE_BOOT = f"""ta AS (SELECT strategy, (i-1)//5 AS blk, i, lr, n FROM (SELECT strategy, ln(1+net_pnl_pct/100*0.01) AS lr, row_number() OVER (PARTITION BY strategy ORDER BY exit_ts,trade_id) AS i, count(*) OVER (PARTITION BY strategy) AS n FROM trades)),
tc AS (SELECT strategy, blk, i, n, sum(lr) OVER w AS c FROM ta WINDOW w AS (PARTITION BY strategy, blk ORDER BY i ROWS UNBOUNDED PRECEDING)),
td AS (SELECT *, c-max(c) OVER (PARTITION BY strategy, blk ORDER BY i ROWS UNBOUNDED PRECEDING) AS d FROM tc),
te AS MATERIALIZED (SELECT strategy, blk, any_value(n) AS n, arg_max(c,i) AS s, max(c) AS h, min(c) AS l, min(d) AS f FROM td GROUP BY ALL),
tb AS (SELECT strategy, rep, blk AS slot, {mix_sql('rep', 'blk')}%ceil(n/5)::BIGINT AS pick FROM te, range(REPS) g(rep)),
tg AS (SELECT tb.strategy, rep, slot, s, h, l, f, sum(s) OVER w-s AS v FROM tb JOIN te ON te.strategy=tb.strategy AND te.blk=tb.pick WINDOW w AS (PARTITION BY tb.strategy, rep ORDER BY slot ROWS UNBOUNDED PRECEDING)),
tf AS (SELECT strategy, rep, (exp(sum(s))-1)*100 AS ret, (exp(min(least(f, v+l-p)))-1)*100 AS mdd FROM (SELECT *, coalesce(max(v+h) OVER (PARTITION BY strategy, rep ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),v+l) AS p FROM tg) GROUP BY ALL)"""
query("block_bootstrap_trades", sql("trades", f"SELECT strategy, {r6('return_p5_pct=quantile_cont(ret,0.05);return_median_pct=quantile_cont(ret,0.5);return_p95_pct=quantile_cont(ret,0.95);mdd_p5_pct=quantile_cont(mdd,0.05);mdd_median_pct=quantile_cont(mdd,0.5);ruin_pct=avg((mdd<=-25)::INT)*100;prob_positive_pct=avg((ret>0)::INT)*100')} FROM tf GROUP BY strategy",
      TRADE_BOOT.replace("REPS", "10000")))(lambda t: k.block_bootstrap_trades(t.trades(), stake=0.01))
query("bootstrap_win_rate", sql("trades", f"SELECT strategy, {r6('mean_pct=avg(wr)*100;ci_lower_pct=quantile_cont(wr,0.025)*100;ci_upper_pct=quantile_cont(wr,0.975)*100')} FROM (SELECT strategy, rep, sum(w*win)/sum(w) AS wr FROM (SELECT strategy, rep, win, {pois('x')} AS w FROM "
      f"(SELECT strategy, rep, (net_pnl_usd>0)::INT AS win, {mix_sql('rep', 'trade_id')} AS x FROM trades, range(1000) g(rep))) GROUP BY ALL) GROUP BY strategy"))(lambda t: k.bootstrap_win_rate(t.trades()))
query("win_rate_significance", sql("trades", f"""SELECT strategy, n, {r6(f'win_rate_pct=wr*100;z_stat=z;p_value=p;min_tstat={k.MIN_T!r};adjusted_p=least(p*{k.TESTS},1)')}, p<0.05 AS significant, rn AS required_n, greatest(0,rn-n) AS shortfall, abs(z)>={k.MIN_T!r}::DOUBLE AS passes_correction
 FROM (SELECT *, 1-{phi_sql('z')} AS p, CASE WHEN abs(wr-0.5)>0.001 THEN floor({k.POWER!r}::DOUBLE/(abs(wr-0.5)**2))::BIGINT+1 ELSE 99999 END AS rn FROM (SELECT *, (wr-0.5)/sqrt(0.25/n) AS z FROM (SELECT strategy, count(*) AS n, avg((net_pnl_usd>0)::INT) AS wr FROM trades GROUP BY strategy)))"""))(
    lambda t: k.win_rate_significance(t.trades()))
query("performance_gates", sql("rets trades", f"""SELECT symbol, {r6('sharpe;adjusted_sharpe=adj;max_drawdown_pct=-mdd*100;p_value=p')}, nt AS n_trades, b='' AS all_met, b AS blockers FROM
 (SELECT *, concat_ws(',', CASE WHEN NOT adj>=1.5 THEN 'sharpe_adj' END, CASE WHEN NOT -mdd<=0.25 THEN 'mdd_limit' END, CASE WHEN NOT p<0.05 THEN 'significance' END, CASE WHEN NOT nt>=200 THEN 'n_trades_200' END) AS b FROM
 (SELECT *, 1-{phi_sql('zz')} AS p FROM (SELECT *, (round(pos/n*nt)/nt-0.5)/sqrt(0.25/nt) AS zz FROM pg)))""", DD + ",\n" + LO + f""",
pt AS (SELECT symbol, count(*) AS nt FROM trades GROUP BY symbol),
pg AS (SELECT symbol, n, pos, sharpe, mdd, d*sqrt(252/eta) AS adj, nt FROM (SELECT symbol, count(*) AS n, count(*) FILTER (r>0) AS pos, {sr('avg(r)', 'stddev_samp(r)')} AS sharpe FROM rets GROUP BY symbol) JOIN mdd USING (symbol) JOIN lo USING (symbol) JOIN pt USING (symbol))"""))(
    lambda t: k.performance_gates(rets(t), t.trades()))
query("strategy_report", sql("rets trades", f"""SELECT symbol, n AS n_obs, {r6('cagr_pct=mu*100;volatility_pct=vol*100;sharpe=sr;adjusted_sharpe=adj;calmar=mu/-mdd;max_drawdown_pct=-mdd*100;dsr;ci_lower;ci_upper;t_stat;var_95_pct=var_hist*100;cvar_95_pct=cvar_hist*100;win_rate_pct;profit_factor')}, n_trades,
 kk AS checks_passed, concat_ws(',', CASE WHEN adj<1.5 THEN 'sharpe_adj' END, CASE WHEN -mdd>0.25 THEN 'mdd_limit' END, CASE WHEN n_trades<200 THEN 'n_trades_200' END, CASE WHEN dsr<=0.95 THEN 'dsr_95' END) AS blockers, CASE WHEN kk=4 THEN 'DEPLOY' WHEN kk>=2 THEN 'RESEARCH' ELSE 'DISCARD' END AS verdict
 FROM (SELECT *, (adj>=1.5)::INT+(-mdd<=0.25)::INT+(n_trades>=200)::INT+(dsr>0.95)::INT AS kk FROM (SELECT symbol, dsr.n, sr, dsr, mdd, d*sqrt(252/eta) AS adj, ci_lower, ci_upper, var_hist, cvar_hist, mu, vol, t_stat, n_trades, win_rate_pct, profit_factor
 FROM dsr JOIN mdd USING (symbol) JOIN lo USING (symbol) JOIN boot USING (symbol) JOIN var95 USING (symbol) JOIN rm USING (symbol) JOIN rt USING (symbol)))""",
      DD + ",\n" + DSR + ",\n" + LO + ",\n" + BOOT + ",\n" + var_ctes(0.95, "95") + f""",
rm AS (SELECT symbol, avg(r)*252 AS mu, stddev_pop(r)*{S} AS vol, avg(r)/(stddev_samp(r)/sqrt(count(*))) AS t_stat FROM rets GROUP BY symbol),
rt AS (SELECT symbol, count(*) AS n_trades, avg((net_pnl_pct>0)::INT)*100 AS win_rate_pct, sum(net_pnl_pct) FILTER (net_pnl_pct>0)/abs(sum(net_pnl_pct) FILTER (net_pnl_pct<0)) AS profit_factor FROM trades GROUP BY symbol)"""))(
    lambda t: k.strategy_report(rets(t), t.trades()))
WF = """ws AS (SELECT symbol, min(ts) AS s, max(ts) AS e FROM rets GROUP BY symbol),
ww AS (SELECT symbol, k, (s+to_months((3*k)::INT))::TIMESTAMP AS t0, (s+to_months((3*k+12)::INT))::TIMESTAMP AS t1, (s+to_months((3*k+15)::INT))::TIMESTAMP AS t2 FROM ws, range(60) g(k) WHERE s+to_months((3*k+15)::INT)<=e),
wr AS (SELECT w.symbol, k, r, ts, ts BETWEEN t0 AND t1 AS tr, ts BETWEEN t1 AND t2 AS te FROM ww w JOIN rets x ON x.symbol=w.symbol AND x.ts BETWEEN t0 AND t2)"""
query("rolling_walk_forward", sql("rets", f"SELECT symbol, count(*) AS n_windows, count(*) FILTER (deg>=-0.3) AS n_robust, {r6('avg_train_sharpe=avg(a);avg_test_sharpe=avg(b);wfe=' + sdiv('avg(b)', 'avg(a)') + ';')}, CASE WHEN count(*) FILTER (deg>=-0.3)>=count(*)*0.7 THEN 'ROBUST' ELSE 'NOT_ROBUST' END AS verdict FROM "
      f"(SELECT *, (b-a)/abs(a) AS deg FROM (SELECT symbol, k, avg(r) FILTER (tr)/stddev_samp(r) FILTER (tr)*{S} AS a, avg(r) FILTER (te)/stddev_samp(r) FILTER (te)*{S} AS b FROM wr GROUP BY ALL HAVING count(*) FILTER (tr)>=20 AND count(*) FILTER (te)>=5)) GROUP BY symbol", WF))(
    lambda t: k.rolling_walk_forward(rets(t)))
query("vol_scaled_walk_forward", sql("rets", f"SELECT symbol, count(*) AS n_windows, count(*) FILTER ((b-a)/abs(a)*100>=-30) AS n_robust, {r6('avg_is_sharpe=avg(a);avg_oos_raw=avg(b);avg_oos_scaled=avg(c);wfe=' + sdiv('avg(b)', 'avg(a)') + ';')}, count(*) FILTER (c>b) AS sharpe_improved, count(*) FILTER (abs(mds)<abs(mdr)-1e-12) AS mdd_reduced FROM wz GROUP BY symbol",
      WF + f""",
wx AS (SELECT symbol, k, {sr('avg(r) FILTER (tr)', 'stddev_samp(r) FILTER (tr)')} AS a, {sr('avg(r) FILTER (te)', 'stddev_samp(r) FILTER (te)')} AS b, greatest(0.1,least(1.5,0.12/(stddev_pop(r) FILTER (tr)*{S}))) AS sc, avg(r) FILTER (te) AS mt, stddev_samp(r) FILTER (te) AS st FROM wr GROUP BY ALL HAVING count(*) FILTER (tr)>=20 AND count(*) FILTER (te)>=5),
wy AS (SELECT symbol, k, sum(r) OVER w AS c1, sum(r*sc) OVER w AS c2, ts FROM wr JOIN wx USING (symbol, k) WHERE te WINDOW w AS (PARTITION BY symbol, k ORDER BY ts ROWS UNBOUNDED PRECEDING)),
wd AS (SELECT symbol, k, exp(c1-max(c1) OVER w)-1 AS d1, exp(c2-max(c2) OVER w)-1 AS d2 FROM wy WINDOW w AS (PARTITION BY symbol, k ORDER BY ts ROWS UNBOUNDED PRECEDING)),
wz AS (SELECT symbol, k, a, b, (mt*sc-{RF_DAILY!r}::DOUBLE)/(st*sc)*{S} AS c, mdr, mds FROM wx JOIN (SELECT symbol, k, min(d1) AS mdr, min(d2) AS mds FROM wd GROUP BY ALL) USING (symbol, k))"""))(lambda t: k.vol_scaled_walk_forward(rets(t)))
IO = ";".join(f"{p}_win_rate=avg((net_pnl_usd>0)::INT) FILTER ({c})*100;{p}_pf=sum(net_pnl_usd) FILTER ({c} AND net_pnl_usd>0)/abs(sum(net_pnl_usd) FILTER ({c} AND net_pnl_usd<0));{p}_return_pct=sum(net_pnl_usd) FILTER ({c})/10000*100" for p, c in (("in", "ins"), ("out", "NOT ins")))
query("in_out_sample_split", sql("trades", f"SELECT *, {r6('degradation_pct=(out_win_rate-in_win_rate)/in_win_rate*100')}, out_win_rate>=in_win_rate*0.7 AND out_pf>=1 AS is_robust FROM (SELECT strategy, count(*) FILTER (ins) AS in_trades, count(*) FILTER (NOT ins) AS out_trades, {r6(IO, 9)} FROM "
      "(SELECT *, i<=floor(n*0.7::DOUBLE) AS ins FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY entry_ts, trade_id) AS i, count(*) OVER (PARTITION BY strategy) AS n FROM trades)) GROUP BY strategy)").replace("SELECT *, CASE", "SELECT strategy, in_trades, out_trades, " + r6("in_win_rate out_win_rate in_pf out_pf in_return_pct out_return_pct") + ", CASE", 1))(
    lambda t: k.in_out_sample_split(t.trades()))
query("optimal_f", sql("trades", f"SELECT strategy, {r6('optimal_f=f;recommended=f*0.25;log_growth=gr;worst')} FROM (SELECT strategy, 0.01+arg_max(g, (round(gr,12), -g))*(0.98/99) AS f, max(gr) AS gr, any_value(worst) AS worst FROM (SELECT strategy, g, worst, avg(ln(1+(0.01+g*(0.98::DOUBLE/99))*net_pnl_pct/100/worst)) AS gr FROM trades JOIN "
      "(SELECT strategy, abs(min(net_pnl_pct/100)) AS worst FROM trades GROUP BY strategy) USING (strategy), range(100) q(g) GROUP BY ALL) GROUP BY strategy)"))(lambda t: k.optimal_f(t.trades()))
Z = {p: z_quantile(p / 100) for p in (5, 25, 50, 75, 95)}
query("lognormal_forecast", sql("rets", f"SELECT symbol, {r6('price=s0;' + ';'.join(f'price_p{p}=s0*exp(dr+sv*{z!r})' for p, z in Z.items()) + f';expected_return_pct=(exp(mu*30)-1)*100;prob_profit_pct={phi_sql(chr(40) + chr(100) + chr(114) + chr(47) + chr(115) + chr(118) + chr(41))}*100;var_pct=(exp(dr+sv*{z_quantile(1 - 0.95)!r})-1)*100;cvar_pct=(exp(mu*30)*{phi_sql(f'({z_quantile(1 - 0.95)!r}-sv)')}/{1 - 0.95!r}-1)*100')} FROM "
      "(SELECT symbol, avg(r) AS mu, arg_max(close,ts) AS s0, (avg(r)-stddev_samp(r)**2/2)*30 AS dr, stddev_samp(r)*sqrt(30) AS sv FROM rets GROUP BY symbol)"))(lambda t: k.lognormal_forecast(rets(t)))
