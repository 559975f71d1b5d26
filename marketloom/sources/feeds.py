"""Feed messages (JSON and HTML text columns) to typed rows, and report sinks. One parse per message, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import safe_div


def _num(c):
    return c.try_cast("double")


def parse_klines(raw: DataFrame, col: str = "payload") -> DataFrame:
    """[[open_ms, open, high, low, close, volume, ...], ...] per message -> bars."""
    k = F.explode(F.from_json(F.col(col), "array<array<string>>")).alias("k")
    x = raw.select("symbol", k)
    return x.select("symbol", F.timestamp_millis(F.col("k")[0].cast("long")).alias("ts"),
                    *[_num(F.col("k")[i + 1]).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"))])


def parse_candles(raw: DataFrame, col: str = "payload") -> DataFrame:
    """[{t, o, h, l, c, v}, ...] per message, numbers as strings or numbers -> bars."""
    x = raw.select("symbol", F.inline(F.from_json(F.col(col), "array<struct<t:bigint,o:string,h:string,l:string,c:string,v:string>>")))
    return x.select("symbol", F.timestamp_millis("t").alias("ts"), *[_num(F.col(a)).alias(b) for a, b in zip("ohlcv", ("open", "high", "low", "close", "volume"))])


def parse_allmids(raw: DataFrame, watch: DataFrame, col: str = "payload", default_half_spread: float = 0.015) -> DataFrame:
    """Mid-price messages in three shapes ({data:{mids:{..}}} with text or number values, or {data:{..}}) -> one row per
    watched symbol with a positive mid, and bid / ask from the symbol's half-spread in percent.
    watch: (symbol, half_spread), a dimension the join broadcasts only when its measured size allows."""
    chan = F.get_json_object(col, "$.channel")
    body = F.coalesce(F.get_json_object(col, "$.data.mids"), F.get_json_object(col, "$.data"))
    x = raw.where(chan == "allMids").select("ts", F.explode(F.from_json(body, "map<string,string>")).alias("symbol", "v"))
    x = x.withColumn("mid", _num(F.col("v"))).where("mid > 0").join(watch, "symbol")
    h = F.coalesce("half_spread", F.lit(default_half_spread)) / 100
    return x.select("symbol", "ts", "mid", (F.col("mid") * (1 - h)).alias("bid"), (F.col("mid") * (1 + h)).alias("ask"))


def parse_l2book(raw: DataFrame, col: str = "payload") -> DataFrame:
    """Order-book messages with levels as objects {px, sz} or as [px, sz] -> best prices, top-3 sizes, mid."""
    obj = F.from_json(F.get_json_object(col, "$.data.levels"), "array<array<struct<px:string,sz:string>>>")
    arr = F.from_json(F.get_json_object(col, "$.data.levels"), "array<array<array<string>>>")
    as_obj = F.transform(arr, lambda side: F.transform(side, lambda l: F.struct(l[0].alias("px"), l[1].alias("sz"))))
    x = raw.where(F.get_json_object(col, "$.channel") == "l2Book").select(
        "ts", F.get_json_object(col, "$.data.coin").alias("symbol"), F.when(F.get(F.get(obj, 0), 0)["px"].isNotNull(), obj).otherwise(as_obj).alias("lv"))
    top = lambda i: F.aggregate(F.slice(F.col("lv")[i], 1, 3), F.lit(0.0), lambda a, l: a + F.coalesce(_num(l["sz"]), F.lit(0.0)))
    x = x.where((F.size("lv") >= 2) & (F.size(F.col("lv")[0]) > 0) & (F.size(F.col("lv")[1]) > 0))
    x = x.select("symbol", "ts", _num(F.col("lv")[0][0]["px"]).alias("bid"), _num(F.col("lv")[1][0]["px"]).alias("ask"), top(0).alias("bid_size"), top(1).alias("ask_size"))
    return x.where("bid > 0 and ask > 0").withColumn("mid", (F.col("bid") + F.col("ask")) / 2)


def parse_funding_oi(raw: DataFrame, col: str = "payload") -> DataFrame:
    """[{universe:[{name}..]}, [{funding, openInterest, markPx, oraclePx}..]] -> one row per asset, zipped by position."""
    names = F.from_json(F.get_json_object(col, "$[0].universe"), "array<struct<name:string>>")
    ctx = F.from_json(F.get_json_object(col, "$[1]"), "array<struct<funding:string,openInterest:string,markPx:string,oraclePx:string>>")
    x = raw.select("ts", F.explode(F.arrays_zip(names.alias("n"), ctx.alias("c"))).alias("z")).where("z.n is not null and z.c is not null")
    z = lambda k: F.coalesce(_num(F.col(f"z.c.{k}")), F.lit(0.0))
    x = x.select(F.col("z.n.name").alias("symbol"), "ts", z("funding").alias("rate"), z("openInterest").alias("oi"), z("markPx").alias("mark_px"),
                 F.coalesce(_num(F.col("z.c.oraclePx")), z("markPx")).alias("index_px"))
    return x.select("symbol", "ts", "rate", "mark_px", "index_px", F.when(F.col("mark_px") > 0, F.col("oi") * F.col("mark_px")).otherwise(0.0).alias("oi_usd"),
                    ((F.col("mark_px") - F.col("index_px")) / F.greatest("index_px", F.lit(1e-12))).alias("premium"))


def parse_ticker_24h(raw: DataFrame, min_vol: float = 5e6, suffix: str = "USDT", col: str = "payload") -> DataFrame:
    """[{symbol, quoteVolume}, ...] -> base symbols of pairs quoted in ``suffix`` with enough volume."""
    x = raw.select(F.inline(F.from_json(F.col(col), "array<struct<symbol:string,quoteVolume:string>>")))
    x = x.where(F.col("symbol").endswith(suffix)).withColumn("volume", F.coalesce(_num(F.col("quoteVolume")), F.lit(0.0))).where(F.col("volume") >= min_vol)
    return x.select(F.expr(f"substring(symbol, 1, length(symbol) - {len(suffix)})").alias("coin"), "volume")


def html_ticker_extract(pages: DataFrame, tag: str = "td", token: str = "[A-Z]{2,5}", n: int | None = None) -> DataFrame:
    """Distinct tokens in table cells with their first page; n: only the first n by that page."""
    hits = F.regexp_extract_all("html", F.lit(f"<{tag}[^>]*>({token})</{tag}>"), F.lit(1))
    x = pages.select("page_id", F.explode(hits).alias("ticker")).groupBy("ticker").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("hits"))
    return x.orderBy("first_page", "ticker").limit(n) if n is not None else x


def write_report(df: DataFrame, path: str, fmt: str = "parquet", partition: str = "symbol", mode: str = "errorifexists") -> DataFrame:
    """Report rows as one folder per symbol: nested columns kept in parquet, one JSON document per row as json."""
    out = df if fmt == "parquet" else df.select(partition, F.to_json(F.struct(*[c for c in df.columns if c != partition])).alias("value"))
    w = out.write.mode(mode).partitionBy(partition)
    w.parquet(path) if fmt == "parquet" else w.text(path)
    return df.sparkSession.read.format("parquet" if fmt == "parquet" else "text").load(path)
