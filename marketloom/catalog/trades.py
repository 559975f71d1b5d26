"""Queries over trades, sizing and attribution."""

from pyspark.sql import functions as F

from ..functions import z_quantile
from ..operators import features as ft, risk, trades as k
from ..plans import bar_blocks
from . import query
from .risk import V95, rets
from .views import phi_sql, r6, sdiv, sql

BS = ("n, " + r6("win_rate_pct total_net_usd total_gross_usd total_fees_usd total_slip_usd avg_net_pct avg_net_usd median_net_pct best_usd worst_usd sharpe_trade profit_factor"))
BAGG = """count(*) AS n, avg((net_pnl_usd>0)::INT)*100 AS win_rate_pct, sum(net_pnl_usd) AS total_net_usd, sum(gross_pnl_usd) AS total_gross_usd, sum(fee_usd) AS total_fees_usd, sum(slippage_usd) AS total_slip_usd, avg(net_pnl_pct) AS avg_net_pct,
 avg(net_pnl_usd) AS avg_net_usd, quantile_cont(net_pnl_pct,0.5) AS median_net_pct, max(net_pnl_usd) AS best_usd, min(net_pnl_usd) AS worst_usd, CASE WHEN stddev_samp(net_pnl_pct)>1e-12 THEN avg(net_pnl_pct)/stddev_samp(net_pnl_pct) ELSE 0 END AS sharpe_trade,
 coalesce(sum(net_pnl_usd) FILTER (net_pnl_usd>0),0)/greatest(abs(coalesce(sum(net_pnl_usd) FILTER (net_pnl_usd<0),0)),1e-12) AS profit_factor"""
query("bucket_stats", sql("trades", f"SELECT symbol, {BS} FROM (SELECT symbol, {BAGG} FROM trades GROUP BY symbol)"))(lambda t: k.bucket_stats(t.trades(), ["symbol"]))
query("attribution_by_dimension", sql("trades", f"SELECT dimension, value, {BS} FROM (SELECT dimension, value, {BAGG} FROM (" + " UNION ALL ".join(f"SELECT *, '{d}' AS dimension, {d} AS value FROM trades" for d in ("strategy", "symbol", "exit_reason", "regime", "direction")) + ") GROUP BY ALL)"))(
    lambda t: k.attribution_by_dimension(t.trades()))
query("attribution_time_of_day", sql("trades", f"SELECT utc_from, {BS} FROM (SELECT hour(entry_ts)//4*4 AS utc_from, {BAGG} FROM trades GROUP BY 1)"))(lambda t: k.attribution_time_of_day(t.trades_once()))
query("optimal_hours", sql("trades", f"SELECT strategy, hour, {r6('sharpe pnl')}, CASE WHEN b<=3 THEN 'BEST' ELSE 'WORST' END AS kind, {r6('saved_if_avoided=CASE WHEN b>3 THEN losses ELSE 0 END;')} FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY sharpe DESC, hour) AS b, row_number() OVER (PARTITION BY strategy ORDER BY sharpe, hour DESC) AS w FROM "
      "(SELECT strategy, hour(entry_ts) AS hour, avg(net_pnl_pct)/stddev_samp(net_pnl_pct) AS sharpe, sum(net_pnl_usd) AS pnl, coalesce(-sum(net_pnl_usd) FILTER (net_pnl_usd<=0),0) AS losses FROM trades GROUP BY ALL)) WHERE b<=3 OR w<=3"))(lambda t: k.optimal_hours(t.trades()))
SIG = " UNION ALL ".join(f"SELECT '{n}' AS signal, {on.replace('is not null', 'IS NOT NULL')} AS present, net_pnl_usd, net_pnl_pct, fee_usd FROM trades WHERE {ok}" for n, (ok, on) in k.SIGNALS.items())
query("signal_attribution", sql("trades", f"SELECT signal, count(*) FILTER (present) AS n_present, count(*) FILTER (NOT present) AS n_absent, {r6('win_rate_present=avg((net_pnl_usd>0)::INT) FILTER (present)*100;win_rate_absent=avg((net_pnl_usd>0)::INT) FILTER (NOT present)*100;mean_present=avg(net_pnl_pct) FILTER (present);mean_absent=avg(net_pnl_pct) FILTER (NOT present);edge_pct=coalesce(avg(net_pnl_pct) FILTER (present),0)-coalesce(avg(net_pnl_pct) FILTER (NOT present),0)')}, "
      f"CASE WHEN signal='kyle_lambda' THEN {r6('a=-sum(net_pnl_usd) FILTER (present AND net_pnl_usd<=0);').removesuffix(' AS a')} END AS blocked_losses_usd, CASE WHEN signal='maker' THEN {r6('a=sum(fee_usd) FILTER (NOT present)*(1-0.01/0.035);').removesuffix(' AS a')} END AS fee_savings_usd FROM ({SIG}) GROUP BY signal"))(
    lambda t: k.signal_attribution(t.trades()))
query("cost_attribution", sql("trades", f"SELECT coalesce(strategy,'TOTAL') AS strategy, {r6('gross_usd=g;fees_usd=f;slip_usd=s;net_usd=n;fee_drag_pct=f/greatest(g,1e-12)*100;slip_drag_pct=s/greatest(g,1e-12)*100;total_drag_pct=(f+s)/greatest(g,1e-12)*100')}, n>0 AS profitable FROM (SELECT strategy, sum(gross_pnl_usd) AS g, sum(fee_usd) AS f, sum(slippage_usd) AS s, sum(net_pnl_usd) AS n FROM trades GROUP BY ROLLUP (strategy))"))(
    lambda t: k.cost_attribution(t.trades()))
query("trade_summary", sql("trades", f"SELECT strategy, n, wins, losses, {r6('win_rate_pct=wins/n*100;profit_factor=gw/gl;avg_win_pct;avg_loss_pct;expectancy_usd=wins/n*gw/wins-(1-wins/n)*gl/losses;best_usd;worst_usd;avg_hold_seconds')} FROM (SELECT strategy, count(*) AS n, count(*) FILTER (net_pnl_usd>0) AS wins, count(*) FILTER (net_pnl_usd<0) AS losses, sum(net_pnl_usd) FILTER (net_pnl_usd>0) AS gw, "
      "-sum(net_pnl_usd) FILTER (net_pnl_usd<0) AS gl, avg(net_pnl_pct) FILTER (net_pnl_usd>0) AS avg_win_pct, avg(net_pnl_pct) FILTER (net_pnl_usd<0) AS avg_loss_pct, max(net_pnl_usd) AS best_usd, min(net_pnl_usd) AS worst_usd, avg(hold_seconds) AS avg_hold_seconds FROM trades GROUP BY strategy)"))(lambda t: k.trade_summary(t.trades()))
query("exit_breakdown", sql("trades", 'SELECT strategy, count(*) FILTER (exit_reason=\'STOP_LOSS\') AS "STOP_LOSS", count(*) FILTER (exit_reason=\'TAKE_PROFIT\') AS "TAKE_PROFIT", count(*) FILTER (exit_reason=\'TIME_STOP\') AS "TIME_STOP" FROM trades GROUP BY strategy'))(lambda t: k.exit_breakdown(t.trades()))
query("quality_buckets", sql("trades", f"SELECT strategy, bucket, n, wins, {r6('avg_pnl_pct;win_rate_pct=wr')}, count(*) FILTER (n>=3) OVER (PARTITION BY strategy)>=2 AND first_value(bucket) OVER (PARTITION BY strategy ORDER BY n<3, round(wr,1), bucket)='A+' AS inversion FROM (SELECT strategy, CASE WHEN quality_score>=90 THEN 'A+' WHEN quality_score>=75 THEN 'A' WHEN quality_score>=60 THEN 'B' WHEN quality_score>=45 THEN 'C' ELSE 'D' END AS bucket, "
      "count(*) AS n, count(*) FILTER (net_pnl_usd>0) AS wins, avg(net_pnl_pct) AS avg_pnl_pct, avg((net_pnl_usd>0)::INT)*100 AS wr FROM trades GROUP BY ALL)"))(lambda t: k.quality_buckets(t.trades()))
query("trade_streaks", sql("trades", "SELECT strategy, coalesce(max(len) FILTER (g=1),0) AS max_win_streak, coalesce(max(len) FILTER (g=-1),0) AS max_loss_streak, CASE WHEN arg_max(g,last)=-1 THEN arg_max(len,last) ELSE 0 END AS current_loss_streak FROM (SELECT strategy, g, count(*) AS len, max(i) AS last FROM "
      "(SELECT *, i-row_number() OVER (PARTITION BY strategy, g ORDER BY i) AS isl FROM (SELECT strategy, sign(net_pnl_usd)::INT AS g, row_number() OVER (PARTITION BY strategy ORDER BY exit_ts, trade_id) AS i FROM trades)) GROUP BY strategy, g, isl) GROUP BY strategy"))(lambda t: k.trade_streaks(t.trades()))
CURVE = """qa AS (SELECT strategy, exit_ts::DATE AS day, net_pnl_usd AS p FROM trades UNION ALL SELECT strategy, min(entry_ts)::DATE, 0 FROM trades GROUP BY strategy),
qb AS (SELECT strategy, day, sum(p) AS p FROM qa GROUP BY ALL), qc AS (SELECT strategy, min(day) AS a, max(day) AS b FROM qb GROUP BY strategy),
qd AS (SELECT strategy, unnest(generate_series(a::TIMESTAMP,b::TIMESTAMP,INTERVAL 1 DAY))::DATE AS day FROM qc),
curve AS (SELECT d.strategy, d.day, round(100000+sum(coalesce(p,0)) OVER (PARTITION BY d.strategy ORDER BY d.day),6) AS balance FROM qd d LEFT JOIN qb b ON b.strategy=d.strategy AND b.day=d.day)"""
query("equity_curve", sql("trades", f"SELECT strategy, strftime(day,'%Y-%m-%d') AS day, {r6('balance')} FROM curve", CURVE))(lambda t: k.equity_curve(t.trades()).withColumn("day", F.date_format("day", "yyyy-MM-dd")))
query("curve_metrics", sql("trades", f"SELECT strategy, {r6('sharpe=avg(r)/stddev_pop(r)*sqrt(252);sortino=avg(r)/stddev_pop(r) FILTER (r<0)*sqrt(252);max_drawdown_pct=min(dd);total_return_pct=(arg_max(balance,day)/arg_min(balance,day)-1)*100;calmar=(arg_max(balance,day)/arg_min(balance,day)-1)*100/abs(min(dd))')} FROM "
      "(SELECT *, balance/lag(balance) OVER w-1 AS r, (balance/max(balance) OVER w-1)*100 AS dd FROM curve WINDOW w AS (PARTITION BY strategy ORDER BY day)) GROUP BY strategy", CURVE))(lambda t: k.curve_metrics(k.equity_curve(t.trades())))
Z = z_quantile(0.975)
TQ = f"({Z!r}+{(Z**3 + Z) / 4!r}/(n-1)+{(5 * Z**5 + 16 * Z**3 + 3 * Z) / 96!r}/((n-1)*(n-1)))"
query("kelly_from_trades", sql("trades", f"SELECT strategy, n, {r6(f'win_rate_pct=wr*100;ci_lower_pct=greatest(0,wr-{TQ}*sqrt(wr*(1-wr)/n))*100;ci_upper_pct=least(1,wr+{TQ}*sqrt(wr*(1-wr)/n))*100;avg_win_pct=aw;avg_loss_pct=al;reward_risk=aw/al;expected_value_pct=wr*aw-(1-wr)*al;full_kelly_pct=fk*100;fractional_kelly_pct=fk*25;safe_kelly_pct=least(greatest(fk*0.25,0),0.02)*100;profit_factor=pf;sharpe;p_value=1-' + phi_sql('zz'))}, "
      "CASE WHEN fk<0 THEN 'NO_EDGE' WHEN fk<0.05 THEN 'WEAK' WHEN fk<0.15 THEN 'MODERATE' ELSE 'STRONG' END AS edge FROM (SELECT *, wr-(1-wr)/(aw/al) AS fk, (wr-0.5)/sqrt(0.25/n) AS zz FROM (SELECT strategy, count(*) AS n, avg((net_pnl_pct>0)::INT) AS wr, avg(net_pnl_pct) FILTER (net_pnl_pct>0) AS aw, -avg(net_pnl_pct) FILTER (net_pnl_pct<0) AS al, "
      "sum(net_pnl_pct) FILTER (net_pnl_pct>0)/-sum(net_pnl_pct) FILTER (net_pnl_pct<0) AS pf, avg(net_pnl_pct)/stddev_pop(net_pnl_pct)*sqrt(252) AS sharpe FROM trades GROUP BY strategy))"))(lambda t: k.kelly_from_trades(t.trades()))
query("cvar_kelly", sql("rets trades", f"SELECT symbol, {r6('full_kelly_pct=fk*100;frac_kelly_pct=fr*100;cvar_kelly_pct=kk*100;recommended_pct=CASE WHEN fk<=0 THEN 0 ELSE least(kk,0.03)*100 END;')}, CASE WHEN fk<=0 THEN 'NEGATIVE_EDGE' WHEN w*fr>0.002 THEN 'CVAR' ELSE 'KELLY' END AS binding FROM (SELECT *, CASE WHEN w*fr>0.002 THEN fr*0.002/(w*fr) ELSE fr END AS kk FROM "
      "(SELECT *, greatest(0,fk*0.25) AS fr FROM (SELECT symbol, wr-(1-wr)/(aw/al) AS fk, abs(least(cvar_hist,cvar_cf)) AS w FROM (SELECT symbol, avg((net_pnl_pct>0)::INT) AS wr, avg(net_pnl_pct) FILTER (net_pnl_pct>0) AS aw, -avg(net_pnl_pct) FILTER (net_pnl_pct<0) AS al FROM trades GROUP BY symbol) JOIN var95 USING (symbol))))", V95))(
    lambda t: k.cvar_kelly(t.trades_once(), risk.var_cvar(rets(t)), limit=0.002))
RF = "PARTITION BY strategy ORDER BY exit_ts, trade_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW"
query("rolling_half_kelly", sql("trades", f"SELECT strategy, trade_id, {r6('size_usd=CASE WHEN c>=20 AND coalesce(al,0.01)>0 THEN greatest(10,least(300,10000*greatest(0,(p*b-(1-p))/b/2)/100)) ELSE 50 END;win_rate_pct=p*100')}, c>=20 AS ready FROM (SELECT *, w/c AS p, coalesce(aw,0.01)/coalesce(al,0.01) AS b FROM (SELECT strategy, trade_id, count(*) OVER ({RF}) AS c, count(*) FILTER (net_pnl_pct>0) OVER ({RF}) AS w, "
      f"avg(net_pnl_pct) FILTER (net_pnl_pct>0) OVER ({RF}) AS aw, avg(-net_pnl_pct) FILTER (net_pnl_pct<=0) OVER ({RF}) AS al FROM trades))"))(lambda t: k.rolling_half_kelly(t.trades()))
query("position_size", sql("positions", f"SELECT position_id, CASE WHEN s<e THEN 'LONG' ELSE 'SHORT' END AS direction, {r6('dollar_risk=300;units=u;notional=u*e;pct_of_account=u*e/30000*100;sl_distance_pct=abs(e-s)/e*100;margin=u*e/2;target_1r=e+m*abs(e-s);target_2r=e+2*m*abs(e-s);target_3r=e+3*m*abs(e-s)')} FROM (SELECT *, 300/(abs(e-s)*2) AS u, CASE WHEN s<e THEN 1 ELSE -1 END AS m FROM "
      "(SELECT position_id, entry_price AS e, CASE WHEN direction='LONG' THEN stop_price ELSE entry_price*1.03 END AS s FROM positions))"))(
    lambda t: k.position_size(t.positions().withColumn("stop_price", F.when(F.col("direction") == "LONG", F.col("stop_price")).otherwise(F.col("entry_price") * 1.03)), leverage=2.0))
def vol():
    return ((F.col("position_id") % 40) + 2) / 100


query("vol_target_size", sql("positions", f"SELECT position_id, {r6('units=u;position_usd=u*e;pct_of_account=u*e/30000*100;vol_scalar=0.1/v')}, 30000*0.1/(e*v)>30000*3.0/e AS cap_applied FROM (SELECT *, least(30000*0.1/(e*v),30000*3.0/e) AS u FROM (SELECT position_id, entry_price AS e, ((position_id%40)+2)/100 AS v FROM positions))"))(
    lambda t: k.vol_target_size(t.positions().withColumn("vol_ann", vol())))
query("execution_cost", sql("positions", f"SELECT position_id, {r6('participation_pct=s/adv*100;impact_bps=im;total_cost_bps=4+im;total_cost_usd=s*(4+im)/10000;max_capacity_usd=cap')}, s>cap*0.8 AS capacity_warning FROM (SELECT *, 0.1*dv*sqrt(s/adv)*10000 AS im, round((0.002/(0.1*dv))**2*adv,0) AS cap FROM (SELECT position_id, size_usd AS s, size_usd*(1+position_id%90) AS adv, ((position_id%40)+2)/100/sqrt(252) AS dv FROM positions))"))(
    lambda t: k.execution_cost(t.positions().withColumns({"vol_ann": vol(), "adv_usd": F.col("size_usd") * (1 + F.col("position_id") % 90)})))
query("portfolio_heat", sql("positions", f"SELECT account, n_open, {r6('heat_pct=h*100;remaining_heat_pct=greatest(0,0.15-h)*100;utilization_pct=h/0.15*100')}, h<0.15*0.9 AS can_add, CASE WHEN h<0.05 THEN 'OFFENSIVE' WHEN h<0.1 THEN 'STANDARD' WHEN h<0.13 THEN 'DEFENSIVE' ELSE 'MAXED_OUT' END AS risk_mode FROM (SELECT account, count(*) AS n_open, sum(abs(entry_price-stop_price)*size_usd/entry_price)/3e5 AS h FROM positions GROUP BY account)"))(
    lambda t: k.portfolio_heat(t.positions(), equity=3e5))
query("exposure_report", sql("positions", f"SELECT kind, key, {r6('usd;cap_usd=cap;utilization_pct=usd/cap*100')}, usd>cap AS breach, kind='SYMBOL' AND ns>1 AS duplicate FROM (SELECT *, 1.973e9*CASE kind WHEN 'CLUSTER' THEN 0.25 WHEN 'SYMBOL' THEN 0.15 ELSE 0.3 END AS cap FROM (SELECT 'CLUSTER' AS kind, 'K'||(replace(symbol,'C','')::INT%7) AS key, sum(size_usd) AS usd, count(DISTINCT strategy) AS ns FROM positions GROUP BY ALL UNION ALL "
      "SELECT 'SYMBOL', symbol||'_'||direction, sum(size_usd), count(DISTINCT strategy) FROM positions GROUP BY ALL UNION ALL SELECT 'STRATEGY', strategy, sum(size_usd), 1 FROM positions GROUP BY ALL))"))(
    lambda t: k.exposure_report(t.positions(), t.positions().select("symbol", F.concat(F.lit("K"), F.expr("string(int(substring(symbol, 2)) % 7)")).alias("cluster")).distinct(), 1.973e9))
query("strategy_scalar", sql("trades", f"SELECT strategy, {r6('sharpe=s;win_rate=wr;profit_factor=CASE WHEN l>1e-12 THEN w/l WHEN w>0 THEN 9.9 ELSE 0 END;size_scalar=CASE WHEN s<=0 THEN 0 WHEN s<0.5 THEN greatest(0.6,least(1,0.6+s/(0.5+1e-12)*0.4)) WHEN s>1.5 THEN 1.2 ELSE 1 END;')} FROM (SELECT strategy, avg(p)/stddev_samp(p) AS s, avg((p>0)::INT) AS wr, coalesce(sum(p) FILTER (p>0),0) AS w, coalesce(-sum(p) FILTER (p<0),0) AS l FROM "
      "(SELECT strategy, net_pnl_pct AS p, row_number() OVER (PARTITION BY strategy ORDER BY exit_ts DESC, trade_id DESC) AS rn FROM trades) WHERE rn<=20 GROUP BY strategy)"))(lambda t: k.strategy_scalar(t.trades_once()))


def barrier_signals(t, n=10):
    """Fade every bar at least 1.5 deviations from its 20-bar mean: stop 1 %, target 2 %, next n bars as path."""
    b = ft._add_z(bar_blocks(t.bars(), before=20, after=n))
    path = F.collect_list(F.struct("ts", "high", "low", "close")).over(b.w.rowsBetween(1, n))
    d = b.add(path=path).done().where("abs(z) >= 1.5")
    s = F.when(F.col("z") < 0, 1.0).otherwise(-1.0)
    return d.select("symbol", "ts", F.when(F.col("z") < 0, "LONG").otherwise("SHORT").alias("direction"), F.col("close").alias("entry"),
                    (F.col("close") * (1 - s * 0.01)).alias("stop"), (F.col("close") * (1 + s * 0.02)).alias("target"), "path")


query("triple_barrier_outcomes", sql("bars", f"SELECT symbol, ts, direction, {r6('entry stop target exit_price net_pct')}, exit_reason, exit_at, partial, CASE WHEN net_pct>1e-4 THEN 'WIN' WHEN exit_reason='BE_EXIT' OR abs(net_pct)<=fee*1.5 THEN 'BE' ELSE 'LOSS' END AS outcome FROM te",
      """ta AS (SELECT *, row_number() OVER w AS i, avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m, stddev_samp(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
tb AS (SELECT symbol, ts, i, close AS entry, CASE WHEN close<m THEN 1 ELSE -1 END AS s FROM ta WHERE i>=20 AND sd>0 AND abs((close-m)/sd)>=1.5),
tc AS (SELECT b.symbol, b.ts, b.entry, b.s, a.i-b.i AS j, a.ts AS jts, a.close, CASE WHEN s=1 THEN high ELSE -low END AS fav, CASE WHEN s=1 THEN low ELSE -high END AS adv, max(CASE WHEN s=1 THEN high ELSE -low END) OVER (PARTITION BY b.symbol, b.ts ORDER BY a.i) AS mf FROM tb b JOIN ta a ON a.symbol=b.symbol AND a.i BETWEEN b.i+1 AND b.i+10),
td AS (SELECT *, mf>=s*entry*(1+s*0.015) AS part, mf>=s*entry*(1+s*0.01) AS be, adv<=s*CASE WHEN mf>=s*entry*(1+s*0.01) THEN entry ELSE entry*(1-s*0.01) END AS sl, fav>=s*entry*(1+s*0.02) AS tp, max(j) OVER (PARTITION BY symbol, ts) AS lj FROM tc),
tx AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY j) AS rn FROM td WHERE sl OR tp OR j=lj),
ty AS (SELECT symbol, ts, CASE WHEN s=1 THEN 'LONG' ELSE 'SHORT' END AS direction, entry, s, entry*(1-s*0.01) AS stop, entry*(1+s*0.02) AS target, CASE WHEN sl AND be THEN entry WHEN sl THEN entry*(1-s*0.01) WHEN tp THEN entry*(1+s*0.02) ELSE close END AS exit_price,
 CASE WHEN sl AND be THEN 'BE_EXIT' WHEN sl THEN 'SL_HIT' WHEN tp THEN 'TP_HIT' ELSE 'TIME_EXIT' END AS exit_reason, jts AS exit_at, part AS partial, CASE WHEN part THEN 0.5 ELSE 0 END AS bk FROM tx WHERE rn=1),
te AS (SELECT *, (entry+exit_price*(1-bk)+entry*(1+s*0.015)*bk)*0.1/entry AS fee, (s*((exit_price-entry)*(1-bk)+entry*s*0.015*bk)-(entry+exit_price*(1-bk)+entry*(1+s*0.015)*bk)*0.1/100)/entry*100 AS net_pct FROM ty)"""))(lambda t: k.triple_barrier_outcomes(barrier_signals(t)))
query("revenge_flags", sql("trades", "SELECT strategy, trade_id, exit_ts, l AS recent_losses, l>=3 AS revenge FROM (SELECT *, (sum((net_pnl_usd<0)::INT) OVER (PARTITION BY strategy ORDER BY epoch(exit_ts)::BIGINT RANGE BETWEEN 900 PRECEDING AND CURRENT ROW))::BIGINT AS l FROM trades)"))(lambda t: k.revenge_flags(t.trades()))
query("daily_loss_lock", sql("trades", f"SELECT strategy, trade_id, exit_ts, {r6('day_start=ds;day_pnl_pct=dp')}, max((dp<=-2)::INT) OVER (PARTITION BY strategy, day ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING)=1 AS locked FROM (SELECT *, cd/greatest(ds,1)*100 AS dp FROM (SELECT *, 1e6+ct-cd AS ds FROM (SELECT *, exit_ts::DATE AS day, sum(net_pnl_usd) OVER (PARTITION BY strategy, exit_ts::DATE ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING) AS cd, "
      "sum(net_pnl_usd) OVER (PARTITION BY strategy ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING) AS ct FROM trades)))"))(lambda t: k.daily_loss_lock(t.trades()))
query("pre_trade_flags", sql("equity", f"SELECT account, trade_id AS order_id, {r6('balance=b;risk_pct=r')}, td AS trades_today, concat_ws(',', CASE WHEN r>1 AND r<=2 THEN 'RISK' END, CASE WHEN td>=5 THEN 'TRADE_COUNT' END) AS warnings, concat_ws(',', CASE WHEN r>2 THEN 'RISK' END, CASE WHEN (b-10000)/10000*100<=-10 THEN 'DRAWDOWN' END) AS rejections, "
      "concat_ws(',', CASE WHEN r>2 THEN 'RISK' END, CASE WHEN (b-10000)/10000*100<=-10 THEN 'DRAWDOWN' END)='' AS approved FROM (SELECT *, entry_price*0.002*size_usd/greatest(entry_price,1)/greatest(b,1)*100 AS r FROM (SELECT t.account, t.trade_id, t.entry_price, t.size_usd, coalesce(e.balance,10000) AS b, row_number() OVER (PARTITION BY t.account, t.entry_ts::DATE ORDER BY t.entry_ts, t.trade_id)-1 AS td "
      "FROM trades t ASOF LEFT JOIN (SELECT account, ts, arg_max(balance, trade_id) AS balance FROM equity GROUP BY ALL) e ON e.account=t.account AND e.ts<=t.entry_ts))"))(
    lambda t: k.pre_trade_flags(t.proposals(), t.equity()))
query("threshold_advice", sql("trades", f"SELECT strategy, {r6('win_rate_pct=wr')}, CASE WHEN wr>65 THEN 'LOOSEN' WHEN wr<50 THEN 'TIGHTEN' ELSE 'KEEP' END AS advice, {r6('min_move_pct=CASE WHEN wr>65 THEN 0.004 WHEN wr<50 THEN 0.006 ELSE 0.005 END;ofi_floor=CASE WHEN wr>65 THEN 0.17 WHEN wr<50 THEN 0.23 ELSE 0.2 END')} FROM (SELECT strategy, avg((net_pnl_usd>0)::INT)*100 AS wr FROM "
      "(SELECT strategy, net_pnl_usd, row_number() OVER (PARTITION BY strategy ORDER BY exit_ts DESC, trade_id DESC) AS rn FROM trades) WHERE rn<=20 GROUP BY strategy)"))(lambda t: k.threshold_advice(t.trades()))
