"""Queries over pairs, factors, portfolios and scenarios."""

from pyspark.sql import functions as F

from ..operators import equity as eq, features as ft, portfolio as k
from ..plans import last_rows
from . import query
from .equity import RT
from .views import r6, sql


def brets(t):
    return t.rets_brand()


def members(t):
    """Brands and their cluster (first digit of the brand number)."""
    return t.base("part").select(F.col("p_brand").alias("symbol"), F.substring("p_brand", 7, 1).alias("cluster")).distinct()


def cov(t):
    return k.return_covariance(brets(t), k.cluster_pairs(members(t)))


query("factor_beta", sql("brets", f"SELECT symbol, factor, {r6('beta=b;correlation=c;r_squared=c*c;total_r2=least(sum(c*c) OVER (PARTITION BY symbol),1);alpha_r2=greatest(1-sum(c*c) OVER (PARTITION BY symbol),0)')} FROM (SELECT a.symbol, f.symbol AS factor, covar_samp(a.r,f.r)/var_pop(f.r) AS b, corr(a.r,f.r) AS c FROM brets a JOIN brets f USING (ts) WHERE f.symbol IN ('Brand#11','Brand#12','Brand#13') GROUP BY ALL)"))(
    lambda t: k.factor_beta(brets(t), brets(t).where("symbol in ('Brand#11','Brand#12','Brand#13')").select(F.col("symbol").alias("factor"), "ts", F.col("r").alias("f"))))
COV = "cov AS MATERIALIZED (SELECT substr(a.symbol,7,1) AS cluster, a.symbol AS a, b.symbol AS b, count(*) AS n, covar_samp(a.r,b.r)*252 AS cov_ann, corr(a.r,b.r) AS correlation FROM brets a JOIN brets b ON a.ts=b.ts AND substr(a.symbol,7,1)=substr(b.symbol,7,1) AND a.symbol<=b.symbol GROUP BY ALL)"
query("return_covariance", sql("brets", f"SELECT cluster, a, b, n, {r6('cov_ann correlation')} FROM cov", COV))(cov)
SHR = "sh AS (SELECT cluster, sum(cov_ann) FILTER (a=b) AS tr, sum(CASE WHEN a=b THEN 1 ELSE 2 END*cov_ann*cov_ann) AS tr2, count(*) FILTER (a=b) AS nn, min(n) AS t FROM cov GROUP BY cluster)"
query("shrinkage_covariance", sql("brets", f"SELECT m AS method, cluster, a, b, {r6('rho;cov_shrunk=(1-rho)*cov_ann+CASE WHEN a=b THEN rho*tr/nn ELSE 0 END;')} FROM (SELECT 'trace' AS m, *, greatest(0,least(1,(1/t)*(tr2-tr*tr/nn)/((tr2-tr*tr/nn)+1e-12))) AS rho FROM sh UNION ALL SELECT 'oracle', *, greatest(0,least(1,((t-2)/t*tr2+tr*tr)/greatest((t+2)*(tr2-tr*tr/nn),1e-12))) FROM sh) JOIN cov USING (cluster)", COV + ", " + SHR))(
    lambda t: k.shrinkage_covariance(cov(t), "trace").withColumn("method", F.lit("trace")).unionByName(k.shrinkage_covariance(cov(t), "oracle").withColumn("method", F.lit("oracle"))))
query("correlation_clusters", sql("brets", f"SELECT cluster, leader, count(*)+1 AS size, {r6('avg_corr=avg(c)')}, string_agg(b, ',' ORDER BY b) AS members FROM (SELECT e.cluster, e.b, min(e.a) AS leader, arg_min(e.correlation, e.a) AS c FROM ed e JOIN (SELECT cluster, max_by(ls, i) AS ls FROM gr GROUP BY cluster) g ON g.cluster=e.cluster WHERE list_contains(g.ls, e.a) AND NOT list_contains(g.ls, e.b) GROUP BY e.cluster, e.b) GROUP BY cluster, leader",
      COV + """, ed AS (SELECT cluster, a, b, correlation FROM cov WHERE a<b AND abs(correlation)>0.03), nd AS (SELECT cluster, a AS s, row_number() OVER (PARTITION BY cluster ORDER BY a) AS i FROM cov WHERE a=b), el AS (SELECT cluster, b, list(a) AS prev FROM ed GROUP BY ALL),
np AS (SELECT nd.*, coalesce(prev, []) AS prev FROM nd LEFT JOIN el ON el.cluster=nd.cluster AND el.b=nd.s),
gr AS (SELECT cluster, i, [s] AS ls FROM np WHERE i=1 UNION ALL SELECT n.cluster, n.i, CASE WHEN list_has_any(n.prev, g.ls) THEN g.ls ELSE list_append(g.ls, n.s) END FROM gr g JOIN np n ON n.cluster=g.cluster AND n.i=g.i+1)""").replace("WITH ", "WITH RECURSIVE ", 1))(lambda t: k.correlation_clusters(cov(t), 0.03))
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def weights(t):
    """Ten long-only weight vectors over the brands, each summing to one."""
    n = F.expr("int(substring(symbol, 7, 2))")
    g = members(t).select("symbol", n.alias("o"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("portfolio"))
    g = g.withColumn("u", (1 + F.pmod(F.col("portfolio") * 7 + F.col("o") * 13, F.lit(11))).cast("double"))
    return g.join(g.groupBy("portfolio").agg(F.sum("u").alias("t")), "portfolio").select("portfolio", "symbol", (F.col("u") / F.col("t")).alias("w"))


WT = """wg AS (SELECT DISTINCT p_brand AS symbol, g AS portfolio, (1+(g*7+substr(p_brand,7,2)::INT*13)%11)::DOUBLE AS u FROM part, range(10) q(g)), wt AS (SELECT portfolio, symbol, u/sum(u) OVER (PARTITION BY portfolio) AS w FROM wg),
pr AS MATERIALIZED (SELECT portfolio, ts, sum(w*r) AS pr FROM brets JOIN wt USING (symbol) GROUP BY ALL)"""
query("portfolio_scan", sql("brets", f"SELECT portfolio, {r6('ret vol sharpe cvar')}, sharpe=max(sharpe) OVER () AS best_sharpe, vol=min(vol) OVER () AS min_vol, cvar=min(cvar) OVER () AS min_cvar FROM (SELECT *, (ret-0.04)/vol AS sharpe FROM (SELECT portfolio, avg(pr)*252 AS ret, stddev_pop(pr)*sqrt(252) AS vol, -avg(pr) FILTER (pr<=v) AS cvar FROM pr JOIN (SELECT portfolio, quantile_cont(pr,0.05) AS v FROM pr GROUP BY portfolio) USING (portfolio) GROUP BY portfolio))", WT))(
    lambda t: k.portfolio_scan(brets(t), weights(t)))
query("inverse_variance_weights", sql("brets", f"SELECT cluster, a AS symbol, {r6('weight=wa;risk_contribution_pct=mc/sum(mc) OVER (PARTITION BY cluster)*100')} FROM (SELECT f.cluster, f.a, any_value(x.w) AS wa, any_value(x.w)*sum(cov_ann*y.w) AS mc FROM (SELECT cluster, a, b, cov_ann FROM cov UNION ALL SELECT cluster, b, a, cov_ann FROM cov WHERE a<>b) f JOIN iv x ON x.a=f.a JOIN iv y ON y.a=f.b GROUP BY f.cluster, f.a)",
      COV + ", iv AS (SELECT a, 1/cov_ann/sum(1/cov_ann) OVER (PARTITION BY cluster) AS w FROM cov WHERE a=b)"))(lambda t: k.inverse_variance_weights(cov(t)))
SHOCK = ", ".join(f"('{n}',{v})" for n, v in k.SHOCKS)
query("stress_shock", sql("brets", f"SELECT portfolio, scenario, {r6('pl_pct=pl;historical_worst5_pct=h*100')}, pl>-25 AS within_limit, row_number() OVER (PARTITION BY portfolio ORDER BY pl, scenario)=1 AS worst, row_number() OVER (PARTITION BY portfolio ORDER BY pl DESC, scenario DESC)=1 AS best FROM sp JOIN (SELECT portfolio, avg(pr) AS h FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY pr) AS rn, count(*) OVER (PARTITION BY portfolio) AS n FROM pr) WHERE rn<=greatest(1,floor(n*0.05::DOUBLE)) GROUP BY portfolio) USING (portfolio)",
      WT + f""", wk AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY symbol)-1 AS k, count(*) OVER (PARTITION BY portfolio) AS m FROM wt),
sp AS (SELECT portfolio, scenario, sum(w*shock)*100 AS pl FROM (SELECT portfolio, w, scenario, shock FROM wk, (VALUES {SHOCK}) s(scenario, shock) UNION ALL SELECT portfolio, w, 'Rate_shock_300', -0.15-0.1*k/(m-1) FROM wk) GROUP BY ALL)"""))(lambda t: k.stress_shock(weights(t), brets(t)))
SEQ = ", ".join(f"('{n}',{d + 1},{v}::DOUBLE)" for n, seq in k.CRISES.items() for d, v in enumerate(seq))
REPLAY = f"""ra AS (SELECT *, exp(sum(ln(1+dr/100)) OVER (PARTITION BY scenario ORDER BY day ROWS UNBOUNDED PRECEDING)) AS px FROM (VALUES {SEQ}) s(scenario, day, dr)),
rb AS (SELECT *, px/(1+dr/100) AS pv, px*0.995<=0.95 AS hit FROM ra), rc AS (SELECT *, min(CASE WHEN hit THEN day END) OVER (PARTITION BY scenario) AS sd FROM rb),
rd AS (SELECT scenario, day, sd, sum(CASE WHEN day=sd THEN 0.95/pv-1 ELSE dr/100 END) OVER (PARTITION BY scenario ORDER BY day ROWS UNBOUNDED PRECEDING) AS c FROM rc WHERE sd IS NULL OR day<=sd),
rp AS (SELECT scenario, any_value(sd) AS sd, arg_max(c,day) AS c, greatest(0,max(c)) AS hi, least(0,min(c)) AS lo FROM rd GROUP BY scenario)"""
query("scenario_replay", sql("positions", f"SELECT position_id, scenario, {r6('total_pnl_usd=round(p*c,4);total_pnl_pct=p*c/1e6*100;max_drawdown_pct=((1e6+p*lo)/(1e6+p*hi)-1)*100')}, sd IS NOT NULL AS stopped_out, sd AS stop_day, CASE WHEN p*c/1e6*100>-20 THEN 'SURVIVED' WHEN p*c/1e6*100>-50 THEN 'SEVERELY_DAMAGED' ELSE 'WIPED_OUT' END AS rating FROM (SELECT position_id, size_usd*1.0017131 AS p FROM positions), rp", REPLAY))(
    lambda t: k.scenario_replay(t.positions().select("position_id", (F.col("size_usd") * 1.0017131).alias("pos_usd")), ["position_id"], 1e6))
query("tail_risk_report", sql("positions", f"SELECT account, arg_min(scenario,(l,scenario)) AS worst_scenario, {r6('worst_pct=min(l);best_pct=max(l);avg_pct=avg(l)')}, arg_max(scenario,(l,scenario)) AS best_scenario, CASE WHEN avg(l)<-15 THEN 'HIGH' WHEN avg(l)<-8 THEN 'MODERATE' ELSE 'LOW' END AS tail_risk_rating FROM (SELECT account, scenario, p*c/1e6*100 AS l FROM (SELECT account, least(sum(size_usd)/1e6*100,100)/100*1e6 AS p FROM positions GROUP BY account), rp) GROUP BY account", REPLAY))(
    lambda t: k.tail_risk_report(t.positions(), 1e6))
PSH = ", ".join(f"('{n}',{s}::DOUBLE,{d})" for n, s, d in k.PATH_SHOCKS)
query("geometric_shock_path", sql("equity", f"SELECT account, scenario, {r6('trough=tr;floor=fl;margin_usd=tr-fl;avg_scalar=av;trough_scalar=CASE WHEN tr<=fl THEN 0 ELSE least(1,pow((tr-fl)/greatest(peak-fl,1),1.5)) END;drawdown_pct=(balance-tr)/balance*100')}, tr<fl AS breached, CASE WHEN tr<fl AND shock<-0.2 THEN 'BREACHED_GAP_RISK' WHEN tr<fl THEN 'BREACHED' ELSE 'PROTECTED' END AS verdict FROM "
      "(SELECT account, scenario, any_value(shock) AS shock, any_value(balance) AS balance, any_value(peak) AS peak, any_value(fl) AS fl, arg_max(e,d) AS tr, avg(CASE WHEN e<=fl THEN 0 ELSE least(1,pow((e-fl)/greatest(peak-fl,1),1.5)) END) AS av FROM (SELECT *, balance*pow(1+shock/days,d::DOUBLE) AS e FROM "
      f"(SELECT account, balance, peak, fl FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts DESC, trade_id DESC) AS rv FROM rf) WHERE rv=1), (VALUES {PSH}) s(scenario, shock, days), range(251) g(d) WHERE d<=days) GROUP BY account, scenario)", RT))(
    lambda t: k.geometric_shock_path(last_rows(eq.ratchet_floor(t.equity()), ["account"], ["ts", "trade_id"], 1)))
