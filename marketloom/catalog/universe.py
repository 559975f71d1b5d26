"""Queries over universes, set operations and alignment."""

from pyspark.sql import functions as F

from ..operators import features as ft, universe as k
from ..plans import row_index, value_chunk
from . import query
from .views import r6, sql

W = "PARTITION BY symbol ORDER BY ts"
RAW = "CASE o_custkey%4 WHEN 0 THEN 'c'||o_custkey||'-USD' WHEN 1 THEN 'C'||o_custkey||'USDT' WHEN 2 THEN ' c'||o_custkey||' ' ELSE 'C'||o_custkey||'.jk' END"
query("normalize_symbol", f"SELECT raw, trim(upper(replace(replace(raw,'-USD',''),'USDT',''))) AS symbol, upper(trim(raw)) LIKE '%-USD' OR upper(trim(raw)) LIKE '%USDT' AS is_crypto FROM (SELECT DISTINCT {RAW} AS raw FROM orders)")(
    lambda t: k.normalize_symbol(t.base("orders").select(F.expr("CASE o_custkey%4 WHEN 0 THEN concat('c',o_custkey,'-USD') WHEN 1 THEN concat('C',o_custkey,'USDT') WHEN 2 THEN concat(' c',o_custkey,' ') ELSE concat('C',o_custkey,'.jk') END").alias("raw")).distinct()))


def _ranked(t, by, desc=True, n=None):
    """Suppliers ranked by a column. First n: a top-n list, numbered once it is small. All: positions from the counts of value chunks."""
    s = t.base("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), "s_suppkey", (-F.col(by) if desc else F.col(by)).alias("o"))
    if n is not None:
        top = s.orderBy("o", "s_suppkey").limit(n).groupBy().agg(F.array_sort(F.collect_list(F.struct("o", "s_suppkey", "symbol"))).alias("a"))
        return top.select(F.posexplode("a").alias("pos", "x")).select("x.symbol", "pos")
    return row_index(s, [], ["o", "s_suppkey"], value_chunk("o")).select("symbol", F.col("_i").alias("pos"))


UL = "u1 AS (SELECT 'S'||s_suppkey AS symbol, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey)-1 AS pos FROM supplier), u2 AS (SELECT 'S'||s_suppkey AS symbol, row_number() OVER (ORDER BY s_acctbal, s_suppkey)-1 AS pos FROM supplier), u3 AS (SELECT 'S'||s_suppkey AS symbol, row_number() OVER (ORDER BY s_nationkey, s_suppkey)-1 AS pos FROM supplier)"
query("universe_union", f"WITH {UL}, u AS (SELECT symbol, 0 AS list, pos FROM u1 WHERE pos<10 UNION ALL SELECT symbol, 1, pos FROM u2 WHERE pos<15 UNION ALL SELECT symbol, 2, pos FROM u3 WHERE pos<10) SELECT symbol, list, pos FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY list, pos) AS rn FROM u) WHERE rn=1")(
    lambda t: k.universe_union([_ranked(t, "s_acctbal", n=10), _ranked(t, "s_acctbal", False, 15), _ranked(t, "s_nationkey", False, 10)], [10, 15, 10]))
sym = lambda t, cond=None: (t.base("supplier").where(cond) if cond else t.base("supplier")).select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), "s_acctbal")
query("universe_exclude", f"SELECT 'S'||s_suppkey AS symbol, {r6('s_acctbal')} FROM supplier WHERE NOT (s_nationkey IN (3,5,7))")(lambda t: k.universe_exclude(sym(t), sym(t, "s_nationkey IN (3,5,7)")))
query("universe_confirmed", f"SELECT 'S'||s_suppkey AS symbol, {r6('s_acctbal')} FROM supplier WHERE s_acctbal>3000")(lambda t: k.universe_confirmed(sym(t), sym(t, "s_acctbal > 3000")))
query("turnover_rank", sql("bars", f"SELECT symbol, {r6('avg_volume=avg(volume);last_close=arg_max(close,ts);turnover=avg(volume)*arg_max(close,ts)')} FROM bars GROUP BY symbol HAVING avg(volume)>=25 ORDER BY avg(volume)*arg_max(close,ts) DESC, symbol LIMIT 60"))(lambda t: k.turnover_rank(t.bars(), 60, 25.0))
query("activity_rank", f"SELECT symbol, frequency, {r6('volume;score=frequency*0.6+volume*0.4')} FROM (SELECT 'S'||l_suppkey AS symbol, count(*) AS frequency, sum(l_quantity) AS volume FROM lineitem GROUP BY 1) ORDER BY frequency*0.6+volume*0.4 DESC, symbol LIMIT 50")(
    lambda t: k.activity_rank(t.base("lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol")).agg(F.count(F.lit(1)).alias("frequency"), F.sum("l_quantity").alias("volume")), 50))
query("categorise_universe", f"WITH {UL}, c AS (SELECT symbol, pos AS rank, CASE WHEN s_nationkey<10 THEN 'N'||s_nationkey ELSE 'OTHER' END AS category FROM u1 JOIN supplier ON symbol='S'||s_suppkey) SELECT category, symbol, rank, k FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rank, symbol) AS k FROM c) WHERE (category='OTHER' AND k<=25) OR (category<>'OTHER' AND k<=3)")(
    lambda t: k.categorise_universe(_ranked(t, "s_acctbal").select("symbol", F.col("pos").alias("rank")), t.base("supplier").where("s_nationkey < 10").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("category")), 3))
query("align_inner", sql("bars_brand", 'SELECT a.ts, ' + r6('Brand11=a.close;Brand12=b.close;Brand13=c.close').replace("AS Brand11", 'AS "Brand#11"').replace("AS Brand12", 'AS "Brand#12"').replace("AS Brand13", 'AS "Brand#13"') + " FROM bars_brand a JOIN bars_brand b ON b.ts=a.ts AND b.symbol='Brand#12' JOIN bars_brand c ON c.ts=a.ts AND c.symbol='Brand#13' WHERE a.symbol='Brand#11'"))(
    lambda t: k.align_inner(t.bars_brand(), ["Brand#11", "Brand#12", "Brand#13"]))
query("align_tail", sql("rets", f"SELECT a.symbol AS key, a.rev, {r6('ra=a.r;rb=b.r')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rev FROM rets) a JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rev FROM rets WHERE volume_odd) b USING (symbol, rev)".replace("FROM rets WHERE volume_odd", "FROM rets WHERE day(ts)%2=1")))(
    lambda t: k.align_tail(ft.log_returns(t.bars()).withColumnRenamed("symbol", "key"), ft.log_returns(t.bars()).where(F.dayofmonth("ts") % 2 == 1).withColumnRenamed("symbol", "key")))
query("asof_slice", sql("bars", f"SELECT symbol, scan_date, ts, {r6('close')} FROM (SELECT b.symbol, q.scan_date, b.ts, b.close, row_number() OVER (PARTITION BY b.symbol, q.scan_date ORDER BY b.ts DESC) AS rn, count(*) OVER (PARTITION BY b.symbol, q.scan_date) AS n FROM bars b JOIN (SELECT unnest([TIMESTAMP '1996-01-01', TIMESTAMP '1997-03-15', TIMESTAMP '1999-12-31', TIMESTAMP '2001-06-30']) AS scan_date) q ON b.ts<=q.scan_date) WHERE rn<=90 AND n>=55"))(
    lambda t: k.asof_slice(t.bars(), t.bars().select("symbol").distinct().withColumn("scan_date", F.explode(F.array(*[F.lit(d).cast("timestamp") for d in ("1996-01-01", "1997-03-15", "1999-12-31", "2001-06-30")])))))
query("forward_window", sql("bars", f"SELECT symbol, signal_ts, x.k AS step, x.ts AS ts, {r6('open=x.open;high=x.high;low=x.low;close=x.close')} FROM (SELECT symbol, ts AS signal_ts, i, unnest(nx) AS x FROM fw WHERE close>open*1.01) WHERE x.ts<=signal_ts+INTERVAL 15 DAY",
      f"fi AS (SELECT *, row_number() OVER ({W}) AS i FROM bars), fv AS MATERIALIZED (SELECT *, list({{'ts': ts, 'open': open, 'high': high, 'low': low, 'close': close, 'j': i}}) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS nl FROM fi), fw AS (SELECT *, list_transform(nl, lambda y: {{'k': y.j-i, 'ts': y.ts, 'open': y.open, 'high': y.high, 'low': y.low, 'close': y.close}}) AS nx FROM fv)"))(
    lambda t: k.forward_window(t.bars(), F.col("close") > F.col("open") * 1.01))
query("cross_asset_snapshot", sql("bars_brand", f"SELECT name, {r6('current=c;prev=p;change_pct=(c/p-1)*100')}, CASE WHEN c>p THEN 'UP' ELSE 'DOWN' END AS trend FROM (SELECT CASE symbol WHEN 'Brand#11' THEN 'NASDAQ' WHEN 'Brand#12' THEN 'DXY' ELSE 'GOLD' END AS name, arg_max(close,ts) AS c, arg_max(p,ts) AS p FROM (SELECT *, lag(close) OVER ({W}) AS p FROM bars_brand WHERE symbol IN ('Brand#11','Brand#12','Brand#13')) GROUP BY 1)"))(
    lambda t: k.cross_asset_snapshot(t.bars_brand(), t.spark.sql("SELECT * FROM VALUES ('Brand#11','NASDAQ'),('Brand#12','DXY'),('Brand#13','GOLD') AS d(symbol, name)")))
query("bars_from_ticks", sql("ticks", f"SELECT symbol, ts, {r6('open high low close volume')} FROM (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts, arg_min(price,(t.ts,seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price,(t.ts,seq)) AS close, sum(volume) AS volume FROM ticks t GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, t.ts))"))(lambda t: k.bars_from_ticks(t.ticks(), "4 hours"))
query("latest_snapshot", sql("user_ticks", f"SELECT symbol, ts, {r6('price;bid;ask;age_s=epoch(TIMESTAMP ' + chr(39) + '2024-01-25 00:00:00' + chr(39) + ')-epoch(ts);')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS rn FROM user_ticks WHERE ts<=TIMESTAMP '2024-01-25 00:00:00') WHERE rn=1 AND epoch(TIMESTAMP '2024-01-25 00:00:00')-epoch(ts)<43200"))(
    lambda t: k.latest_snapshot(t.user_ticks(), F.lit("2024-01-25 00:00:00").cast("timestamp"), 43200.0))
