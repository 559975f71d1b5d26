"""Queries over ticks and order books."""

from pyspark.sql import functions as F

from ..operators import ticks as k
from . import query
from .views import r6, sql

W = "PARTITION BY symbol ORDER BY ts, seq"


def fr(n):
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


OFI = "CASE WHEN bid_size+ask_size>0 THEN bid_size/(bid_size+ask_size) ELSE 0.5 END"
SPB = "CASE WHEN bid>0 THEN (ask-bid)/bid*100 ELSE 999 END"
query("tick_basics", sql("ticks", f"SELECT symbol, ts, seq, {r6(f'mid=(bid+ask)/2;spread_pct=(ask-bid)/((bid+ask)/2)*100;ofi={OFI}')} FROM ticks"))(lambda t: k.tick_basics(t.ticks()))
query("microprice", sql("ticks", f"SELECT symbol, ts, seq, {r6('microprice=(ask_size*bid+bid_size*ask)/(bid_size+ask_size)')} FROM ticks"))(lambda t: k.microprice(t.ticks()))
query("book_imbalance", sql("book_levels", f"SELECT symbol, ts, seq, {r6('imbalance=(b-a)/(b+a)')} FROM (SELECT symbol, ts, seq, sum(sz/(level+1)) FILTER (side='B') AS b, sum(sz/(level+1)) FILTER (side='A') AS a FROM book_levels WHERE level<5 GROUP BY ALL)"))(lambda t: k.book_imbalance(t.book_levels()))
query("depth_ofi", sql("book_levels", f"SELECT symbol, ts, seq, {r6('depth_ofi=sum(sz) FILTER (' + 'side=' + chr(39) + 'B' + chr(39) + ')/sum(sz);')} FROM book_levels WHERE level<3 GROUP BY ALL"))(lambda t: k.depth_ofi(t.book_levels()))
query("book_state", sql("book_deltas", "SELECT symbol, side, rn-1 AS level, px, sz FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side='B' THEN -px ELSE px END) AS rn FROM (SELECT symbol, side, px, arg_max(sz, seq) AS sz FROM book_deltas WHERE ts<=TIMESTAMP '2024-01-20 00:00:00' GROUP BY ALL) WHERE sz>0) WHERE rn<=20"))(
    lambda t: k.book_state(t.book_deltas(), F.lit("2024-01-20 00:00:00").cast("timestamp")))
WALLS = "walls AS (SELECT symbol, ts, seq, side, max(sz)/avg(sz) AS spoof_ratio FROM book_levels WHERE level<10 AND sz>0 GROUP BY ALL HAVING count(*)>=3 AND max(sz)/avg(sz)>=1.9)"
query("spoof_walls", sql("book_levels", f"SELECT symbol, ts, seq, side, {r6('spoof_ratio')} FROM walls", WALLS))(lambda t: k.spoof_walls(t.book_levels(), 1.9))
query("spoof_environment", sql("book_levels", "SELECT s.symbol, s.ts, s.seq, s.side, count(w.ts) AS recent_walls, count(w.ts)>=2 AS spoof_environment FROM (SELECT symbol, ts, seq, CASE WHEN bid_size>ask_size THEN 'B' ELSE 'A' END AS side FROM ticks) s LEFT JOIN walls w ON w.symbol=s.symbol AND w.side=s.side AND w.ts BETWEEN s.ts-INTERVAL 3600 SECOND AND s.ts GROUP BY ALL", WALLS))(
    lambda t: k.spoof_environment(k.spoof_walls(t.book_levels(), 1.9), t.ticks().select("symbol", "ts", "seq", F.when(F.col("bid_size") > F.col("ask_size"), "LONG").otherwise("SHORT").alias("direction")), 3600))
query("fill_proxy_book", sql("ticks", f"SELECT symbol, ts, seq, {r6('price;bid_size=CASE WHEN abs(d)>1e-10 THEN CASE WHEN d>0 THEN mv ELSE 1 END ELSE bid_size END;ask_size=CASE WHEN abs(d)>1e-10 THEN CASE WHEN d>0 THEN 1 ELSE mv END ELSE ask_size END')} FROM (SELECT *, least(1+abs(d/p)*2000,3.5) AS mv FROM (SELECT *, m-lag(m) OVER ({W}) AS d, lag(m) OVER ({W}) AS p FROM (SELECT *, (bid+ask)/2 AS m FROM ticks)))"))(
    lambda t: k.fill_proxy_book(t.ticks()))
ST = f"""sa AS (SELECT *, (bid+ask)/2 AS m, (ask-bid)/((bid+ask)/2)*100 AS sp, row_number() OVER ({W})-1 AS i FROM ticks),
sb AS (SELECT *, abs(m-lag(m) OVER ({W})) AS mv FROM sa),
sc AS (SELECT *, CASE WHEN i>=9 THEN avg(m) OVER {fr(20)} END AS mean, CASE WHEN i>=9 THEN stddev_pop(m) OVER {fr(20)} END AS sd, CASE WHEN i>=9 THEN avg(sp) OVER {fr(30)} END AS avg_spread, CASE WHEN i>=13 THEN avg(mv) OVER {fr(14)} END AS atr, avg(sp) OVER {fr(3)} AS sp3,
 sum(bid_size) OVER {fr(20)}/(sum(bid_size) OVER {fr(20)}+sum(ask_size) OVER {fr(20)}) AS rofi, avg(m) OVER {fr(3)} AS r3, avg(m) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS p3 FROM sb),
st AS (SELECT *, CASE WHEN sd<1e-10 THEN 0 ELSE (m-mean)/sd END AS z FROM sc)"""
query("rolling_tick_stats", sql("ticks", f"SELECT symbol, ts, seq, {r6('mean;std=sd;atr;avg_spread;z')} FROM st WHERE i>=9", ST))(lambda t: k.rolling_tick_stats(t.ticks()))
query("rolling_ofi", sql("ticks", f"SELECT symbol, ts, seq, {r6('ofi=rofi')} FROM st", ST))(lambda t: k.rolling_ofi(t.ticks()))
query("spread_filter", sql("ticks", f"SELECT symbol, ts, seq, {r6('spread_3=sp3;avg_spread')}, CASE WHEN coalesce(avg_spread,0)<1e-8 THEN true ELSE sp3<=avg_spread*1.2 END AS spread_ok FROM st", ST))(lambda t: k.spread_filter(t.ticks(), 1.2))
query("mean_reversion_signal", sql("ticks", f"SELECT symbol, ts, seq, CASE WHEN lo>sh THEN 'LONG' ELSE 'SHORT' END AS direction, {r6('votes=greatest(lo,sh);z;ofi=rofi;stop_pct=sl;target_pct=sl*1.8;ev_pct=sl*1.8*0.55-sl*0.45-0.1')} FROM (SELECT *, (z<=-1.5)::INT+(rofi>=0.55)::INT+(z<-1.05 AND r3>p3 AND i>=7)::INT AS lo, (z>=1.5)::INT+(rofi<=0.44999999999999996::DOUBLE)::INT+(z>1.05 AND r3<p3 AND i>=7)::INT AS sh, atr*1.5/m*100 AS sl FROM st) "
      "WHERE atr>=1e-10 AND greatest(lo,sh)>=2 AND lo<>sh AND sp3<=avg_spread*1.5 AND sl*1.8*0.55-sl*0.45-0.1>0", ST))(lambda t: k.mean_reversion_signal(t.ticks()))
SK = f"""ka AS (SELECT *, row_number() OVER ({W}) AS i, lag(price) OVER ({W}) AS p FROM ticks),
kb AS (SELECT *, i-max(CASE WHEN NOT coalesce(price>p,false) THEN i END) OVER ({W}) AS up_streak, i-max(CASE WHEN NOT coalesce(price<p,false) THEN i END) OVER ({W}) AS down_streak FROM ka),
kc AS (SELECT kb.*, s.price AS sp FROM kb JOIN ka s ON s.symbol=kb.symbol AND s.i=kb.i-greatest(up_streak,down_streak))"""
query("tick_streak", sql("ticks", "SELECT symbol, ts, seq, up_streak, down_streak FROM kb", SK))(lambda t: k.tick_streak(t.ticks()))
query("burst_signal", sql("ticks", f"SELECT symbol, ts, seq, direction, streak, {r6('move_pct ofi spread_pct')} FROM (SELECT symbol, ts, seq, CASE WHEN up_streak>=down_streak THEN 'LONG' ELSE 'SHORT' END AS direction, greatest(up_streak,down_streak) AS streak, abs(price-sp)/sp*100 AS move_pct, {OFI} AS ofi, {SPB} AS spread_pct FROM kc) "
      "WHERE streak>=3 AND move_pct>=0.005 AND spread_pct<=0.25 AND CASE WHEN direction='LONG' THEN ofi>=0.2 ELSE ofi<=0.8 END", SK))(lambda t: k.burst_signal(t.ticks()))
query("pullback_signal", sql("ticks", f"SELECT symbol, ts, seq, direction, {r6('prior_move_pct=pm;pullback_pct=pb;ofi')} FROM (SELECT *, CASE WHEN up THEN 'LONG' ELSE 'SHORT' END AS direction, abs(p1-p4)/p4*100 AS pm, CASE WHEN up THEN p1-price ELSE price-p1 END/p1*100 AS pb FROM (SELECT *, p1>p2 AND p2>p3 AND p3>p4 AS up, p1<p2 AND p2<p3 AND p3<p4 AS dn FROM "
      f"(SELECT symbol, ts, seq, price, {OFI} AS ofi, {SPB} AS spr, lag(price,1) OVER ({W}) AS p1, lag(price,2) OVER ({W}) AS p2, lag(price,3) OVER ({W}) AS p3, lag(price,4) OVER ({W}) AS p4 FROM ticks)) WHERE up OR dn) WHERE pm>=0.01 AND pb>0 AND pb<=60 AND spr<=0.25 AND CASE WHEN up THEN ofi>=0.2 ELSE ofi<=0.8 END"))(
    lambda t: k.pullback_signal(t.ticks(), max_pullback=60.0))
query("acceleration_signal", sql("ticks", f"SELECT symbol, ts, seq, CASE WHEN mv>0 THEN 'LONG' ELSE 'SHORT' END AS direction, {r6('move_pct=mv;accel_ratio=g2/g0;ofi')} FROM (SELECT *, (price-p4)/p4*100 AS mv FROM (SELECT symbol, ts, seq, price, {OFI} AS ofi, {SPB} AS spr, greatest((epoch_us(ts)-epoch_us(lag(ts) OVER ({W})))/1e6,0.001) AS g0, "
      f"greatest((epoch_us(lag(ts) OVER ({W}))-epoch_us(lag(ts,2) OVER ({W})))/1e6,0.001) AS g1, greatest((epoch_us(lag(ts,2) OVER ({W}))-epoch_us(lag(ts,3) OVER ({W})))/1e6,0.001) AS g2, lag(price,4) OVER ({W}) AS p4 FROM ticks)) WHERE g2>g1 AND g1>g0 AND g2/g0>=1.4 AND abs(mv)>=0.003 AND spr<=0.25 AND CASE WHEN mv>0 THEN ofi>=0.15 ELSE ofi<=0.85 END"))(
    lambda t: k.acceleration_signal(t.ticks()))
query("momentum_flip", sql("ticks", f"SELECT symbol, ts, seq, direction, {r6('move_pct=mv')}, CASE WHEN direction='LONG' THEN mv<-0.06 ELSE mv>0.06 END AS flip FROM (SELECT symbol, ts, seq, CASE WHEN length(symbol)%2=0 THEN 'LONG' ELSE 'SHORT' END AS direction, (price/lag(price,2) OVER ({W})-1)*100 AS mv FROM ticks) WHERE mv IS NOT NULL"))(
    lambda t: k.momentum_flip(t.ticks(), t.ticks().select("symbol").distinct().withColumn("direction", F.when(F.length("symbol") % 2 == 0, "LONG").otherwise("SHORT"))))
query("trend_continues", sql("ticks", f"SELECT symbol, ts, seq, u>=2 AS long_continues, d>=2 AS short_continues FROM (SELECT *, sum((mv>0)::INT) OVER {fr(3)} AS u, sum((mv<0)::INT) OVER {fr(3)} AS d FROM (SELECT symbol, ts, seq, price-lag(price) OVER ({W}) AS mv, row_number() OVER ({W}) AS i FROM ticks)) WHERE i>=4"))(lambda t: k.trend_continues(t.ticks()))
query("tick_regime", sql("ticks", "SELECT symbol, ts, seq, rg AS regime, CASE WHEN rg LIKE 'TRENDING%' THEN 1.4 WHEN rg='VOLATILE' THEN 1.2 WHEN rg='DEAD' THEN 1.0 ELSE 0.85 END::DOUBLE AS tp_mult, CASE WHEN rg LIKE 'TRENDING%' THEN 0.85 WHEN rg='VOLATILE' THEN 1.4 ELSE 1.0 END::DOUBLE AS sl_mult, CASE WHEN rg LIKE 'TRENDING%' THEN 1.0 WHEN rg='VOLATILE' THEN 0.5 WHEN rg='DEAD' THEN 0 ELSE 0.9 END::DOUBLE AS size_mult FROM "
      "(SELECT symbol, ts, seq, CASE WHEN i<20 THEN 'RANGING' WHEN v<300 THEN 'DEAD' WHEN v>3000 THEN 'VOLATILE' WHEN greatest(u,d)/c>=0.6 AND abs(price-f)/f*100>0.02 THEN CASE WHEN u>=d THEN 'TRENDING_UP' ELSE 'TRENDING_DOWN' END ELSE 'RANGING' END AS rg FROM "
      f"(SELECT *, stddev_samp(r) OVER {fr(21)} AS v, sum((r>0)::INT) OVER {fr(21)} AS u, sum((r<0)::INT) OVER {fr(21)} AS d, count(r) OVER {fr(21)} AS c, first_value(price) OVER {fr(22)} AS f FROM (SELECT symbol, ts, seq, price, (price-lag(price) OVER ({W}))/lag(price) OVER ({W})*100 AS r, row_number() OVER ({W}) AS i FROM ticks)))"))(
    lambda t: k.tick_regime(t.ticks(), vol_low=300.0, vol_high=3000.0))
COOLDOWN = """cn AS (SELECT symbol, ts, seq, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i FROM ticks),
nx AS MATERIALIZED (SELECT c.symbol, c.i, min(n.i) AS nxt FROM cn c JOIN cn n ON n.symbol=c.symbol AND n.ts>=c.ts+INTERVAL 1800 SECOND GROUP BY ALL),
kept AS (SELECT symbol, ts, seq, i FROM cn WHERE i=1 UNION ALL SELECT n.symbol, n.ts, n.seq, n.i FROM kept k JOIN nx ON nx.symbol=k.symbol AND nx.i=k.i JOIN cn n ON n.symbol=nx.symbol AND n.i=nx.nxt)"""
query("cooldown_filter", sql("ticks", "SELECT symbol, ts, seq FROM kept", COOLDOWN).replace("WITH ", "WITH RECURSIVE ", 1))(
    lambda t: k.cooldown_filter(t.ticks(), 1800))
