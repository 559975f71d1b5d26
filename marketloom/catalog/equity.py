"""Queries over equity-curve protection."""

from pyspark.sql import functions as F

from ..functions import RF_DAILY
from ..operators import equity as k
from . import query
from .views import r6, sdiv, sql

W = "PARTITION BY account ORDER BY ts, trade_id"
PK = f"pk AS (SELECT *, greatest(10000, max(balance) OVER ({W} ROWS UNBOUNDED PRECEDING)) AS peak, row_number() OVER ({W})-1 AS i FROM equity)"


def win(n):
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


query("high_water_mark", sql("equity", f"SELECT account, ts, trade_id, {r6('balance;peak;drawdown_pct=(peak-balance)/peak*100')}, CASE WHEN mx>10000 THEN min(CASE WHEN balance=mx THEN ts END) OVER (PARTITION BY account, mx ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) END AS peak_since FROM (SELECT *, max(balance) OVER ({W} ROWS UNBOUNDED PRECEDING) AS mx FROM pk)", PK))(
    lambda t: k.high_water_mark(t.equity()))
LV = [0] + [a for a, _ in k.MILESTONES]
TIER = "CASE " + " ".join(f"WHEN (peak/10000-1)*100>={a} THEN {i + 1}" for i, (a, _) in reversed(list(enumerate(k.MILESTONES)))) + " ELSE 0 END"
FLOOR = "CASE tier WHEN 0 THEN 0 " + " ".join(f"WHEN {i + 1} THEN {10000 * (1 + f / 100)}" for i, (_, f) in enumerate(k.MILESTONES)) + " END::DOUBLE"
NEXT = "CASE tier " + " ".join(f"WHEN {i} THEN {10000 * (1 + a / 100)}" for i, (a, _) in enumerate(k.MILESTONES)) + " END"
MF = PK + f""", ma AS (SELECT *, {TIER} AS tier FROM pk), mb AS (SELECT *, {FLOOR} AS fl, {NEXT} AS nx FROM ma)"""
query("milestone_floor", sql("equity", f"SELECT account, ts, trade_id, {r6('balance;peak;floor=fl;headroom_usd=greatest(0,balance-fl);headroom_pct=CASE WHEN fl>0 THEN greatest(0,balance-fl)/fl*100 ELSE 0 END;progress_pct=CASE WHEN nx IS NOT NULL THEN least((balance-fl)/(nx-fl)*100,100) ELSE 0 END')}, tier, balance<fl AS below_floor FROM mb", MF))(
    lambda t: k.milestone_floor(t.equity()))


def trail(p, w):
    return f"""ta AS (SELECT *, peak*(1-{p}) AS stop, balance<=peak*(1-{p}) AS hit FROM pk),
tb AS (SELECT *, bool_or(hit) OVER ({W} ROWS UNBOUNDED PRECEDING) AS triggered, greatest(0,least(1,1-(balance-stop)/(peak-stop))) AS proximity FROM ta),
tr AS (SELECT *, 1-1/(1+exp(-8*(greatest(0,(proximity-0.5)*2)-0.5))) AS trailing_scale, balance<peak*(1-{w}) AND NOT triggered AS warning FROM tb)"""


query("trailing_stop_level", sql("equity", f"SELECT account, ts, trade_id, {r6('balance peak stop proximity trailing_scale')}, triggered, warning, CASE WHEN triggered THEN 'HALTED' WHEN warning THEN 'WARNING' ELSE 'ACTIVE' END AS status FROM tr", PK + ",\n" + trail(0.031, 0.017)))(
    lambda t: k.trailing_stop_level(t.equity(), 0.031, 0.017))
RT = PK + ", rf AS (SELECT *, 10000*(1+floor((peak-10000)/10000*100/0.3::DOUBLE)*0.3::DOUBLE*0.6/100) AS fl FROM pk)"
query("ratchet_floor", sql("equity", f"SELECT account, ts, trade_id, {r6('balance;peak;floor=fl')}, balance<=fl AND fl>10000 AS halt FROM rf", RT))(lambda t: k.ratchet_floor(t.equity()))
query("halt_latch", sql("equity", f"SELECT account, ts, trade_id, {r6('balance;floor=fl')}, coalesce(e%4,0)>0 AS halted, CASE coalesce(e%4,0) WHEN 1 THEN 'FLOOR' WHEN 2 THEN 'HARD_DRAWDOWN' ELSE 'NONE' END AS reason FROM (SELECT *, max(ev) OVER ({W} ROWS UNBOUNDED PRECEDING) AS e FROM hb)",
      RT + f", ha AS (SELECT *, (row_number() OVER ({W})-1)*4 AS i4 FROM rf), hb AS (SELECT *, CASE WHEN balance<=fl THEN i4+1 WHEN (10000-balance)/10000*100>=2.0 THEN i4+2 WHEN balance>fl*1.02 THEN i4 END AS ev FROM ha)"))(
    lambda t: k.halt_latch(k.ratchet_floor(t.equity()).select("account", "ts", "trade_id", "balance", "floor"), 2.0))
query("convex_risk_scalar", sql("equity", f"SELECT account, ts, trade_id, {r6('risk_scalar=CASE WHEN balance<=fl THEN 0 ELSE least(1,((balance-fl)/greatest(peak-fl,1))**2) END;')} FROM rf", RT))(
    lambda t: k.convex_risk_scalar(k.ratchet_floor(t.equity())).select("account", "ts", "trade_id", "risk_scalar"))
VE = f"ve AS (SELECT *, greatest(0,(max(balance) OVER {win(10)}-balance)/max(balance) OVER {win(10)}*100) AS v FROM pk), vs AS (SELECT *, CASE WHEN v>=HH THEN 0 ELSE greatest(0,least(1,1-v/HH)) END AS velocity_scale FROM ve)"
query("drawdown_velocity", sql("equity", f"SELECT account, ts, trade_id, {r6('velocity_pct=v;velocity_scale')}, velocity_scale=0 AS halt FROM vs", PK + ",\n" + VE.replace("HH", "2.0")))(lambda t: k.drawdown_velocity(t.equity(), halt=2.0))
query("equity_ma_state", sql("equity", f"SELECT account, ts, trade_id, st AS state, {r6('ma_slow=ms;slope_slow_pct=sl')}, CASE st WHEN 'INSUFFICIENT_DATA' THEN 1.0 WHEN 'STRONG_UPTREND' THEN 1.0 WHEN 'UPTREND' THEN 0.85 WHEN 'WEAKENING' THEN 0.5 WHEN 'CORRECTION' THEN 0.25 ELSE 0 END::DOUBLE AS size_multiplier, "
      "CASE st WHEN 'INSUFFICIENT_DATA' THEN 3 WHEN 'STRONG_UPTREND' THEN 2 WHEN 'UPTREND' THEN 3 WHEN 'WEAKENING' THEN 5 WHEN 'CORRECTION' THEN 7 ELSE 10 END AS scan_days FROM (SELECT *, CASE WHEN ms IS NULL THEN 'INSUFFICIENT_DATA' WHEN balance>=ms AND coalesce(sl,0)>0 AND balance>=mf THEN 'STRONG_UPTREND' WHEN balance>=ms AND coalesce(sl,0)>0 THEN 'UPTREND' WHEN balance>=ms THEN 'WEAKENING' "
      f"WHEN balance>=mu THEN 'CORRECTION' ELSE 'DOWNTREND' END AS st FROM (SELECT *, CASE WHEN i>=9 THEN avg(balance) OVER {win(10)} END AS mf, CASE WHEN i>=19 THEN avg(balance) OVER {win(20)} END AS ms, CASE WHEN i>=49 THEN avg(balance) OVER {win(50)} END AS mu, (lag(balance,19) OVER ({W})-lag(balance,24) OVER ({W}))/(lag(balance,24) OVER ({W})+1e-6)*100 AS sl FROM pk))", PK))(
    lambda t: k.equity_ma_state(t.equity()))
VO = f"vo AS (SELECT *, balance/lag(balance) OVER ({W})-1 AS r FROM pk), vv AS (SELECT *, CASE WHEN i>=20 THEN stddev_samp(r) OVER {win(20)}*sqrt(252) END AS vol_ann FROM vo)"
query("vol_target_scalar", sql("equity", f"SELECT account, ts, trade_id, {r6('vol_ann;vol_scalar=CASE WHEN vol_ann>0 THEN greatest(0.25,least(2,0.12/vol_ann)) ELSE 1 END')}, CASE WHEN vol_ann IS NULL THEN 'UNKNOWN' WHEN vol_ann<=0 THEN 'LOW' WHEN vol_ann<0.12*0.7 THEN 'LOW_VOL' WHEN vol_ann<0.12*1.3 THEN 'NORMAL' WHEN vol_ann<0.24 THEN 'HIGH_VOL' ELSE 'EXTREME_VOL' END AS vol_label FROM vv", PK + ",\n" + VO))(
    lambda t: k.vol_target_scalar(t.equity()))
EF = "(PARTITION BY account ORDER BY exit_ts, trade_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
EDGE = f"""xa AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY exit_ts, trade_id) AS i FROM trades),
xb AS (SELECT account, exit_ts, trade_id, count(*) OVER w AS c, avg((net_pnl_pct>0)::INT) OVER w AS wr, avg(net_pnl_pct/100) OVER w AS m, stddev_samp(net_pnl_pct/100) OVER w AS sd, coalesce(sum(net_pnl_pct) FILTER (net_pnl_pct>0) OVER w,0) AS gw, coalesce(-sum(net_pnl_pct) FILTER (net_pnl_pct<0) OVER w,0) AS gl,
 i-coalesce(max(CASE WHEN net_pnl_pct>0 THEN i END) OVER (PARTITION BY account ORDER BY i ROWS UNBOUNDED PRECEDING),0) AS ls FROM xa WINDOW w AS {EF}),
xc AS (SELECT *, CASE WHEN c>5 AND sd>1e-12 THEN (m-{RF_DAILY!r}::DOUBLE)/sd*sqrt(252) ELSE 0 END AS sr, {sdiv('gw', 'gl', '9.99')} AS pf FROM xb WHERE c>=5),
edge AS (SELECT *, (wr<0.45)::INT+(sr<0.5)::INT+(pf<1.05)::INT+(ls>=7)::INT AS nt FROM xc)"""
query("edge_monitor", sql("trades", f"SELECT account, exit_ts, trade_id, {r6('win_rate_pct=wr*100;rolling_sharpe=sr;profit_factor=pf')}, ls AS loss_streak, concat_ws(',', CASE WHEN wr<0.45 THEN 'WIN_RATE' END, CASE WHEN sr<0.5 THEN 'SHARPE' END, CASE WHEN pf<1.05 THEN 'PROFIT_FACTOR' END, CASE WHEN ls>=7 THEN 'LOSS_STREAK' END) AS triggers, "
      "CASE nt WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'ALERT' WHEN 2 THEN 'CAUTION' ELSE 'SUSPEND' END AS edge_status, CASE nt WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 ELSE 0 END::DOUBLE AS edge_scale FROM edge", EDGE))(lambda t: k.edge_monitor(t.trades()))
query("combined_risk_scale", sql("equity", f"SELECT account, ts, trade_id, {r6('final_scale=greatest(0,least(1.2,b*es))')}, CASE WHEN b=0 THEN 'HALTED' WHEN b<0.25 THEN 'DEFENSIVE' WHEN b<0.6 THEN 'REDUCED' WHEN b<0.9 THEN 'STANDARD' ELSE 'FULL' END AS mode, CASE WHEN balance<fl THEN 'FLOOR_BREACH' WHEN triggered THEN 'TRAILING_STOP' WHEN b=0 THEN 'VELOCITY_OR_BELOW_MA' WHEN coalesce(nt,0)>2 THEN 'EDGE_DEGRADED' ELSE '' END AS halt_reason "
      "FROM (SELECT *, greatest(0,least(1.2,vsc*fs*trailing_scale*velocity_scale*gate)) AS b FROM (SELECT mb.account, mb.ts, mb.trade_id, mb.balance, fl, triggered, trailing_scale, velocity_scale, nt, CASE WHEN vol_ann<1e-6 THEN 1.2 WHEN vol_ann IS NULL THEN 1 ELSE greatest(0.1,least(1.2,0.12/vol_ann)) END AS vsc, "
      "CASE WHEN mb.peak<=fl THEN 0.5 ELSE 1-1/(1+exp(-6*(greatest(0,least(1,1-(mb.balance-fl)/(mb.peak-fl)))-0.5))) END AS fs, CASE WHEN mb.i>=20 THEN (mb.balance>=m20)::INT ELSE 1 END AS gate, CASE coalesce(nt,0) WHEN 0 THEN 1 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 ELSE 0 END AS es "
      f"FROM mb JOIN tr USING (account, trade_id) JOIN vs USING (account, trade_id) JOIN vv USING (account, trade_id) JOIN (SELECT account, trade_id, avg(balance) OVER {win(20)} AS m20 FROM pk) USING (account, trade_id) LEFT JOIN edge USING (account, trade_id)))", MF + ",\n" + trail(0.031, 0.08) + ",\n" + VE.replace("HH", "5.0") + ",\n" + VO + ",\n" + EDGE))(
    lambda t: k.combined_risk_scale(t.equity(), t.results(), trail=0.031))
query("reserve_split", sql("trades", f"SELECT account, ts, trade_id, {r6('tradeable_capital=cap;locked_reserve=lr;total_balance=cap+lr;total_profit=tp')} FROM (SELECT *, s+greatest(0,max(9990-s) OVER ({W} ROWS UNBOUNDED PRECEDING)) AS cap FROM (SELECT account, ts, trade_id, 10000+sum(CASE WHEN p>0 THEN p*(1-0.1471) ELSE p END) OVER w AS s, sum(CASE WHEN p>0 THEN p*0.1471 ELSE 0 END) OVER w AS lr, "
      f"sum(greatest(p,0)) OVER w AS tp FROM (SELECT account, exit_ts AS ts, trade_id, net_pnl_usd*0.0517131::DOUBLE AS p FROM trades) WINDOW w AS ({W} ROWS UNBOUNDED PRECEDING)))"))(
    lambda t: k.reserve_split(t.results().select("account", F.col("exit_ts").alias("ts"), "trade_id", (F.col("net_pnl_usd") * 0.0517131).alias("pnl")), rate=0.1471, min_balance=9990.0))
