"""Queries over sources, feed parsing and sinks. Raw messages are derived from the tables, then parsed back."""

from pyspark.sql import functions as F

from ..functions import sanitize_non_finite
from ..session import work_dir
from ..sources import feeds as k, read_bars
from . import query
from .views import r6, sql

query("read_bars", sql("bars", f"SELECT symbol, ts, {r6('open high low close volume')} FROM bars"))(lambda t: _read_back(t))


def _read_back(t):
    """Bars written once to the shared folder and read back through the typed reader."""
    path = work_dir(t.spark, "bars")
    t.bars().write.parquet(path)
    return read_bars(t.spark, path)


def _bar_messages(t, item, fmt):
    """One JSON message per symbol and year holding its bars as an array."""
    b = t.bars().withColumn("ms", F.unix_millis("ts"))
    return b.groupBy("symbol", F.year("ts").alias("y")).agg(F.to_json(F.sort_array(F.collect_list(item))).alias("payload")).select("symbol", "payload")


s = lambda c: F.col(c).cast("string")
BAR6 = f"SELECT symbol, ts, {r6('open high low close volume')} FROM bars"
query("parse_klines", sql("bars", BAR6))(lambda t: k.parse_klines(_bar_messages(t, F.array(s("ms"), s("open"), s("high"), s("low"), s("close"), s("volume")), "a")))
query("parse_candles", sql("bars", BAR6))(lambda t: k.parse_candles(_bar_messages(t, F.struct(F.col("ms").alias("t"), s("open").alias("o"), F.col("high").alias("h"), s("low").alias("l"), s("close").alias("c"), F.col("volume").alias("v")), "o")))


def _mids(t):
    """Mid messages, one per user event, in the three shapes plus a control message."""
    e = t.base("events")
    v = F.col("value")
    return e.select("ts", F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct(F.lit("allMids").alias("channel"), F.struct(F.create_map("event_type", v.cast("string")).alias("mids")).alias("data"))))
                    .when(F.col("event_id") % 4 == 1, F.to_json(F.struct(F.lit("allMids").alias("channel"), F.struct(F.create_map(F.col("event_type"), v).alias("mids")).alias("data"))))
                    .when(F.col("event_id") % 4 == 2, F.to_json(F.struct(F.lit("allMids").alias("channel"), F.create_map("event_type", v.cast("string")).alias("data"))))
                    .otherwise(F.lit('{"channel":"pong"}')).alias("payload"))


query("parse_allmids", f"SELECT event_type AS symbol, ts, {r6('mid=value;bid=value*(1-h/100);ask=value*(1+h/100)')} FROM (SELECT *, CASE event_type WHEN 'click' THEN 0.00531 WHEN 'purchase' THEN 0.00817 ELSE 0.01573 END AS h FROM events WHERE event_id%4<3 AND value>0 AND event_type<>'error')")(
    lambda t: k.parse_allmids(_mids(t), t.spark.sql("SELECT * FROM VALUES ('click',0.00531D),('purchase',0.00817D),('view',CAST(NULL AS DOUBLE)),('signup',0.01573D) AS w(symbol, half_spread)"), default_half_spread=0.01573))


def _books(t):
    """Book messages per tick: objects for even ids, arrays for odd ones."""
    lv = F.sequence(F.lit(0), F.lit(4))
    px = lambda side, i: F.col("bid") - i * 0.01 if side == "B" else F.col("ask") + i * 0.01
    sz = lambda i: 1.0 + F.pmod(F.col("seq") * 31 + i * 17, F.lit(97))
    as_obj = lambda sd: F.transform(lv, lambda i: F.struct(px(sd, i).cast("string").alias("px"), sz(i).cast("string").alias("sz")))
    as_arr = lambda sd: F.transform(lv, lambda i: F.array(px(sd, i).cast("string"), sz(i).cast("string")))
    obj, arr = F.array(as_obj("B"), as_obj("A")), F.array(as_arr("B"), as_arr("A"))
    msg = lambda levels: F.to_json(F.struct(F.lit("l2Book").alias("channel"), F.struct(F.col("symbol").alias("coin"), levels.alias("levels")).alias("data")))
    return t.ticks().select("ts", F.when(F.col("seq") % 2 == 0, msg(obj)).otherwise(msg(arr)).alias("payload"))


query("parse_l2book", sql("ticks", f"SELECT symbol, ts, {r6('bid;ask;bid_size=s;ask_size=s;mid=(bid+ask)/2')} FROM (SELECT *, 3.0::DOUBLE+(seq*31)%97+(seq*31+17)%97+(seq*31+34)%97 AS s FROM ticks)"))(lambda t: k.parse_l2book(_books(t)))


def _contexts(t):
    """One message per hour: asset names and their contexts as parallel lists."""
    f = t.funding().join(t.oi().select("symbol", "ts", "oi_usd"), ["symbol", "ts"])
    rows = F.sort_array(F.collect_list(F.struct("symbol", "rate", "oi_usd", "mark_px", "index_px")))
    g = f.groupBy("ts").agg(rows.alias("r"))
    names = F.to_json(F.struct(F.transform("r", lambda x: F.struct(x["symbol"].alias("name"))).alias("universe")))
    ctx = F.to_json(F.transform("r", lambda x: F.struct(x["rate"].cast("string").alias("funding"), (x["oi_usd"] / x["mark_px"]).cast("string").alias("openInterest"), x["mark_px"].cast("string").alias("markPx"), x["index_px"].cast("string").alias("oraclePx"))))
    return g.select("ts", F.concat(F.lit("["), names, F.lit(","), ctx, F.lit("]")).alias("payload"))


query("parse_funding_oi", sql("funding oi", f"SELECT symbol, ts, {r6('rate;mark_px=f.mark_px;index_px;oi_usd;premium=(f.mark_px-index_px)/index_px')} FROM funding f JOIN oi o USING (symbol, ts)"))(lambda t: k.parse_funding_oi(_contexts(t)))


def _tickers(t):
    """24-hour ticker lists per nation: supplier pairs quoted in USDT or BTC."""
    x = t.base("supplier").select("s_nationkey", F.struct(F.concat(F.lit("S"), s("s_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, "BTC").otherwise("USDT")).alias("symbol"), s("s_acctbal").alias("quoteVolume")).alias("x"))
    return x.groupBy("s_nationkey").agg(F.to_json(F.collect_list("x")).alias("payload"))


query("parse_ticker_24h", f"SELECT 'S'||s_suppkey AS coin, {r6('volume=s_acctbal')} FROM supplier WHERE s_suppkey%3<>0 AND s_acctbal>=2000")(lambda t: k.parse_ticker_24h(_tickers(t), 2000.0))
query("html_ticker_extract", "SELECT ticker, min(page_id) AS first_page, count(*) AS hits FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*>([A-Za-z]{2,5})</a>', 1)) AS ticker FROM pages) GROUP BY ticker ORDER BY first_page, ticker LIMIT 500")(
    lambda t: k.html_ticker_extract(t.base("pages"), "a", "[A-Za-z]{2,5}", 500))
query("sanitize_non_finite", f"SELECT event_id, {r6('x=CASE WHEN event_id%5<>0 AND event_id%7<>0 THEN value END;y=CASE WHEN event_id%3<>0 THEN value END;', 6)}, CASE WHEN event_id%3<>0 THEN 1 ELSE 0 END AS n_ok FROM events")(
    lambda t: sanitize_non_finite(t.base("events").select(
        "event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("x"),
        F.array(F.when(F.col("event_id") % 3 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))).alias("a")))
    .select("event_id", "x", F.col("a")[0].alias("y"), F.size(F.filter("a", lambda v: v.isNotNull())).alias("n_ok")))


def _report(t):
    from ..operators import scores

    r = scores.screener_score(t.bars()).select("symbol", F.struct("score", "status").alias("screen"), F.struct("price", "change_3d").alias("market"))
    return k.write_report(r, work_dir(t.spark, "report")).select("symbol", "screen.score", "screen.status", "market.price")


query("write_report")(_report)
