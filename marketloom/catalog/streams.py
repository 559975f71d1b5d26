"""Queries that run a stream to its end and return the written table."""

from pyspark.sql import functions as F

from .. import streaming as st
from ..plans import tick_blocks
from ..session import work_dir
from . import query
from .equity import EDGE, RT
from .flow import kyle
from .ticks import COOLDOWN, ST, W, fr
from .views import r6, sql


def tick_stream(t):
    k = F.get_json_object("props", "$.k").cast("int")
    e = st.file_stream(t.spark, t.folder, "events.parquet")
    return e.where("value > 0").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), (1.0 + k).alias("volume"))


END = "(SELECT max(ts) FROM ticks)-INTERVAL 10 MINUTE"
query("tick_to_bar_stream", sql("ticks", f"SELECT symbol, ts, ts+INTERVAL 4 HOUR AS end_ts, {r6('open high low close volume')} FROM (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts, arg_min(price,(t.ts,seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price,(t.ts,seq)) AS close, sum(volume) AS volume FROM ticks t GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, t.ts)) WHERE ts+INTERVAL 4 HOUR<={END}"))(
    lambda t: st.drain(st.tick_to_bar_stream(tick_stream(t), "4 hours"), "bars-stream"))
query("activity_sessions", sql("ticks", f"SELECT symbol, min(ts) AS start_ts, max(ts)+INTERVAL 30 MINUTE AS end_ts, count(*) AS ticks, {r6('volume=sum(volume)')} FROM (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY ts, seq) AS g FROM (SELECT *, (coalesce(ts-lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq)>INTERVAL 30 MINUTE,true))::INT AS nw FROM ticks)) GROUP BY symbol, g HAVING max(ts)+INTERVAL 30 MINUTE<={END}"))(
    lambda t: st.drain(st.activity_sessions(tick_stream(t), "30 minutes"), "sessions-stream"))


PARTS = 4


def replay(t, df, ts):
    """A table written to the shared folder in PARTS stretches of time, one after another, and read back as a stream of several batches; with the delay
    that keeps a row waiting for one stretch, in whatever order its files come."""
    lo, hi = df.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    lo, hi = lo or 0, hi or 0
    path = work_dir(t.spark, "replay")
    at = F.floor((F.unix_micros(ts) - lo) * PARTS / (hi - lo + 1))
    for k in range(PARTS):
        df.where(at == k).write.mode("append").parquet(path)
    files = len(t.spark.read.schema(df.schema).parquet(path).inputFiles())  # a batch for each stretch, however many tasks wrote it
    return st.file_stream(t.spark, path, files_per_batch=max(16, -(-files // PARTS))), f"{(hi - lo) // (1000 * PARTS) + 1} milliseconds"


def passed(view, ts):
    """Rows that the watermark has passed when the stream ends."""
    return f"epoch_us({ts})<=(SELECT (epoch_us(max({ts}))//1000-((epoch_us(max({ts}))-epoch_us(min({ts})))//{1000 * PARTS}+1))*1000 FROM {view})"


def streamed(f, view, ts, cols, name, complete=False):
    def run(t):
        rows, delay = replay(t, getattr(t, view)().select(*cols), ts)
        return st.drain(f(rows, delay), name, complete=complete)
    return run


query("equity_guard_stream", sql("equity", f"SELECT account, ts, trade_id, {r6('balance;peak;floor=fl')}, balance<=fl AND fl>10000 AS halt FROM rf", RT))(
    streamed(lambda r, d: st.equity_guard_stream(r, delay=d), "equity", "ts", ["account", "ts", "trade_id", "balance"], "guard-stream", complete=True))
# one step of the recursion is one change of status: the first failing trade, then the first with six wins among ten trades since
LATCH = EDGE.replace("account", "strategy") + """,
la AS (SELECT strategy, exit_ts, trade_id, row_number() OVER (PARTITION BY strategy ORDER BY exit_ts, trade_id) AS i, avg((net_pnl_pct>0)::INT) OVER (PARTITION BY strategy ORDER BY exit_ts, trade_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)>=0.52 AS back FROM trades),
lb AS MATERIALIZED (SELECT la.*, coalesce(nt>=3,false) AS bad FROM la LEFT JOIN edge USING (strategy, trade_id)),
lc AS MATERIALIZED (SELECT strategy, i, min(CASE WHEN bad THEN i END) OVER (PARTITION BY strategy ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_bad, min(CASE WHEN back THEN i END) OVER (PARTITION BY strategy ORDER BY i ROWS BETWEEN 10 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_back FROM lb),
ld AS (SELECT strategy, min(i) AS i, true AS off FROM lb WHERE bad GROUP BY strategy UNION ALL SELECT ld.strategy, CASE WHEN ld.off THEN next_back ELSE next_bad END, NOT ld.off FROM ld JOIN lc ON lc.strategy=ld.strategy AND lc.i=ld.i WHERE CASE WHEN ld.off THEN next_back ELSE next_bad END IS NOT NULL),
le AS (SELECT lb.*, ld.off AS chg, last_value(CASE WHEN ld.off THEN ld.i WHEN ld.i IS NOT NULL THEN -1 END IGNORE NULLS) OVER (PARTITION BY lb.strategy ORDER BY lb.i) AS since FROM lb LEFT JOIN ld ON ld.strategy=lb.strategy AND ld.i=lb.i)"""
query("edge_latch", sql("trades", f"SELECT strategy, exit_ts, trade_id, CASE WHEN coalesce(since,-1)>0 THEN 'SUSPEND' ELSE 'ACTIVE' END AS status, CASE WHEN coalesce(since,-1)>0 THEN least(i-since,10) ELSE 0 END AS buffered FROM le WHERE {passed('trades', 'exit_ts')}", LATCH).replace("WITH ", "WITH RECURSIVE ", 1))(
    streamed(lambda r, d: st.edge_latch(r, delay=d), "trades", "exit_ts", ["strategy", "exit_ts", "trade_id", "net_pnl_pct"], "latch-stream"))

TICKS = ["symbol", "ts", "seq", "price", "bid", "ask", "bid_size", "ask_size", "volume"]
LATE = passed("ticks", "ts")
query("rolling_tick_stats_stream", sql("ticks", f"SELECT symbol, ts, seq, {r6('mean;std=sd;atr;avg_spread;z')} FROM st WHERE i>=9 AND {LATE}", ST))(
    streamed(lambda r, d: st.rolling_tick_stats_stream(r, d), "ticks", "ts", TICKS, "stats-stream"))
query("rolling_ofi_stream", sql("ticks", f"SELECT symbol, ts, seq, {r6('ofi=rofi')} FROM st WHERE {LATE}", ST))(
    streamed(lambda r, d: st.rolling_ofi_stream(r, delay=d), "ticks", "ts", TICKS, "ofi-stream"))
query("kyle_lambda_stream", sql("ticks", f"SELECT symbol, ts, seq, {r6('lambda_raw=lam;lambda_smooth=sm')}, CASE WHEN abs(sm)<0.5 THEN 'LOW' WHEN abs(sm)<1.0 THEN 'CAUTION' ELSE 'HIGH' END AS toxicity_level FROM (SELECT *, list_reduce(h, lambda a, x: 0.2*x+0.8*a) AS sm FROM (SELECT *, list(lam) FILTER (lam IS NOT NULL) OVER {fr(50)} AS h FROM yc) WHERE lam IS NOT NULL) WHERE {LATE}", kyle(80, 10.0)))(
    streamed(lambda r, d: st.kyle_lambda_stream(r, cap=10.0, low=0.5, high=1.0, delay=d), "ticks", "ts", TICKS, "kyle-stream"))
query("cooldown_stream", sql("ticks", f"SELECT symbol, ts, seq FROM kept WHERE {LATE}", COOLDOWN).replace("WITH ", "WITH RECURSIVE ", 1))(
    streamed(lambda r, d: st.cooldown_filter_stream(r, 1800, d), "ticks", "ts", TICKS, "cooldown-stream"))

# a signal for every tick that moves more than five percent, valid for half an hour, against clean flow of the follower
MOVES = f"""ma AS (SELECT symbol, ts, seq, price/lag(price) OVER ({W})-1 AS r, bid_size FROM ticks),
mb AS (SELECT symbol AS leader, ts AS signal_ts, seq, abs(r)>=0.05 AS triggered, CASE WHEN r>0 THEN 'LONG' ELSE 'SHORT' END AS direction, least(abs(r),1) AS confidence, 1+seq%3 AS lag FROM ma WHERE r IS NOT NULL),
mp(leader, follower) AS (VALUES ('click','error'),('click','purchase'),('error','purchase'),('purchase','signup'),('signup','view'),('view','click')),
mc AS (SELECT mp.follower, mb.* FROM mb JOIN mp USING (leader) WHERE triggered),
md AS (SELECT f.symbol AS follower, f.ts, f.seq, mc.leader, direction, confidence, lag, epoch_us(f.ts)/1e6-epoch_us(signal_ts)/1e6 AS age_s, row_number() OVER (PARTITION BY f.symbol, f.ts, f.seq ORDER BY confidence DESC, mc.leader, signal_ts) AS rn
 FROM ticks f JOIN mc ON mc.follower=f.symbol AND mc.signal_ts BETWEEN f.ts-INTERVAL 1800 SECOND AND f.ts WHERE f.bid_size>30)"""


def lead_stream(t):
    ticks = t.ticks()
    b = tick_blocks(ticks.select("symbol", "ts", "seq", "price"), before=1)
    r = F.col("price") / F.lag("price").over(b.w) - 1
    m = b.add(r=r).done().where("r is not null")
    names = "VALUES ('click','error'),('click','purchase'),('error','purchase'),('purchase','signup'),('signup','view'),('view','click') AS p(leader, follower)"
    s = m.select(F.col("symbol").alias("leader"), F.col("ts").alias("signal_ts"), (F.abs("r") >= 0.05).alias("triggered"), F.when(F.col("r") > 0, "LONG").otherwise("SHORT").alias("direction"),
                 F.least(F.abs("r"), F.lit(1.0)).alias("confidence"), (1 + F.col("seq") % 3).alias("lag")).join(t.spark.sql(f"SELECT * FROM {names}"), "leader")
    path = work_dir(t.spark, "signals")  # read several times below
    s.write.parquet(path)
    s = t.spark.read.parquet(path)
    signals, d1 = replay(t, s, "signal_ts")
    clean = F.when(F.col("bid_size") > 30, "CLEAN").otherwise("MIXED").alias("flow_regime")
    flow, d2 = replay(t, ticks.select("symbol", "ts", "seq", clean), "ts")
    delay = max(d1, d2, key=lambda d: int(d.split()[0]))
    out = st.drain(st.lead_signal_stream(signals, flow, "1800 seconds", delay), "lead-stream")
    ends = [s.where("triggered").agg(F.max(F.unix_micros("signal_ts"))).first()[0], ticks.where("bid_size > 30").agg(F.max(F.unix_micros("ts"))).first()[0]]
    return out.where(F.unix_micros("ts") <= min(e or 0 for e in ends) - int(delay.split()[0]) * 1000 - 1_801_000_000)  # what the watermark of the join has passed for sure


query("active_lead_stream", sql("ticks", f"SELECT follower, ts, seq, leader, direction, {r6('confidence')}, lag, {r6('age_s')} FROM md WHERE rn=1 AND epoch_us(ts)<=(SELECT least((SELECT max(epoch_us(signal_ts)) FROM mb WHERE triggered),max(epoch_us(ts)) FILTER (bid_size>30))-((epoch_us(max(ts))-epoch_us(min(ts)))//{1000 * PARTS}+1)*1000-1801000000 FROM ticks)", MOVES))(lead_stream)
