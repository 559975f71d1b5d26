"""Universe selection, set operations, time alignment and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import case, is_true
from ..plans import BAR_CHUNK, bar_blocks, indexed, last_rows, narrow, row_index, running, time_chunk


def normalize_symbol(df: DataFrame, col: str = "raw") -> DataFrame:
    u = F.upper(F.trim(F.col(col)))
    return df.withColumns({"symbol": F.trim(F.upper(F.regexp_replace(F.regexp_replace(F.col(col), "-USD", ""), "USDT", ""))),
                           "is_crypto": u.endswith("-USD") | u.endswith("USDT")})


def universe_union(lists: list[DataFrame], n: list[int]) -> DataFrame:
    """Ordered distinct union: the first n[k] of every list (symbol, pos), first appearance wins."""
    parts = [d.where(F.col("pos") < k).select("symbol", F.lit(i).alias("list"), "pos") for i, (d, k) in enumerate(zip(lists, n))]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("symbol").agg(F.min(F.struct("list", "pos")).alias("at")).select("symbol", "at.list", "at.pos")


def universe_exclude(u: DataFrame, black: DataFrame) -> DataFrame:
    return u.join(black.select("symbol"), "symbol", "left_anti")


def universe_confirmed(u: DataFrame, venue: DataFrame) -> DataFrame:
    return u.join(venue.select("symbol"), "symbol", "left_semi")


def turnover_rank(bars: DataFrame, n: int = 60, min_vol: float = 1e6) -> DataFrame:
    """Mean volume x last close, symbols above a minimum mean volume, top n."""
    a = bars.groupBy("symbol").agg(F.avg("volume").alias("avg_volume"), F.max_by("close", "ts").alias("last_close")).where(F.col("avg_volume") >= min_vol)
    return a.withColumn("turnover", F.col("avg_volume") * F.col("last_close")).orderBy(F.col("turnover").desc(), "symbol").limit(n)


def activity_rank(df: DataFrame, n: int) -> DataFrame:
    """0.6 x frequency + 0.4 x volume, top n."""
    return df.withColumn("score", F.col("frequency") * 0.6 + F.col("volume") * 0.4).orderBy(F.col("score").desc(), "symbol").limit(n)


def categorise_universe(u: DataFrame, dim: DataFrame, n: int = 20, other: int = 25) -> DataFrame:
    """Category of each ranked symbol (symbol, rank), at most n per category; unknown symbols go to OTHER (at most ``other``)."""
    x = u.join(dim, "symbol", "left").withColumn("category", F.coalesce("category", F.lit("OTHER")))
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("rank", "symbol"))).where(F.col("k") <= max(n, other))  # a limit before the shuffle
    return x.where(((F.col("category") == "OTHER") & (F.col("k") <= other)) | ((F.col("category") != "OTHER") & (F.col("k") <= n))).select("category", "symbol", "rank", "k")


def align_inner(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Closes of the given symbols side by side, timestamps where all of them trade."""
    return bars.where(F.col("symbol").isin(symbols)).groupBy("ts").pivot("symbol", symbols).agg(F.max("close")).dropna()


def align_tail(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two series (key, ts, r) paired from their newest rows backwards, as far as the shorter one goes."""
    def k(d, c):
        d = row_index(d.select("key", "ts", "r"), ["key"], ["ts"], time_chunk("ts", BAR_CHUNK))
        return d.select("key", (F.col("_n") - F.col("_i")).alias("rev"), F.col("r").alias(c))

    return k(a, "ra").join(k(b, "rb"), ["key", "rev"])


def asof_slice(bars: DataFrame, dates: DataFrame, n: int = 90, min_n: int = 55) -> DataFrame:
    """For every scan date the last n bars at or before it, for symbols with at least min_n bars by then.

    The position of the last bar at or before a date is a running maximum over bars and dates together; a bar belongs to
    a slice when its position lies within n of that, which is an equi-join on blocks of n positions."""
    idx = indexed(narrow(bars, "symbol", "ts", "close"), ["symbol"], ["ts"], time_chunk("ts", BAR_CHUNK))
    marks = idx.select("symbol", "ts", F.col("_i").alias("pos"), F.lit(0).alias("is_scan"))
    scans = dates.select("symbol", F.col("scan_date").alias("ts"), F.lit(None).cast("long").alias("pos"), F.lit(1).alias("is_scan"))
    x = running(marks.unionByName(scans), ["symbol"], ["ts", "is_scan"], time_chunk("ts", BAR_CHUNK), maxs={"last": "pos"})
    x = x.where(F.col("is_scan") == 1).where(F.col("last") >= min_n - 1).select("symbol", F.col("ts").alias("scan_date"), "last")
    blk = lambda c: F.floor(c / n).cast("long")
    x = x.withColumn("blk", F.explode(F.array_distinct(F.array(blk(F.col("last")), blk(F.greatest(F.lit(0), F.col("last") - n + 1))))))
    y = idx.drop("_n").withColumn("blk", blk(F.col("_i")))
    return x.join(y, ["symbol", "blk"]).where((F.col("_i") <= F.col("last")) & (F.col("_i") > F.col("last") - n)).select("symbol", "scan_date", "ts", "close")


def forward_window(bars: DataFrame, is_signal: Column, k: int = 10, days: int = 15) -> DataFrame:
    """Next k bars within ``days`` days of each signal bar. Signals are bars of the same series, so the look-ahead is a frame
    over the following rows of the block, not a join. At most k rows per signal."""
    b = bar_blocks(narrow(bars, "symbol", "ts", "open", "high", "low", "close"), after=k)
    nxt = F.collect_list(F.struct("ts", "open", "high", "low", "close")).over(b.w.rowsBetween(1, k))
    d = b.add(_path=nxt, _sig=is_signal).done().where("_sig")
    lim = F.col("ts") + F.make_dt_interval(F.lit(days))
    d = d.select("symbol", F.col("ts").alias("signal_ts"), F.posexplode(F.filter("_path", lambda x: x["ts"] <= lim)).alias("step", "bar"))
    return d.select("symbol", "signal_ts", (F.col("step") + 1).alias("step"), "bar.ts", "bar.open", "bar.high", "bar.low", "bar.close")


def cross_asset_snapshot(bars: DataFrame, dim: DataFrame) -> DataFrame:
    """Last and previous close, change and trend per benchmark. dim: (symbol, name), a small dimension."""
    t = last_rows(bars.join(dim, "symbol").select("symbol", "name", "ts", "close"), ["symbol", "name"], ["ts"], 2)
    a = t.groupBy("name").agg(F.max(F.when(F.col("_rev") == 1, F.col("close"))).alias("current"), F.max(F.when(F.col("_rev") == 2, F.col("close"))).alias("p"))
    a = a.withColumn("prev", F.coalesce("p", "current"))
    return a.select("name", "current", "prev", F.when(F.col("prev") != 0, (F.col("current") / F.col("prev") - 1) * 100).otherwise(0.0).alias("change_pct"),
                    F.when(F.col("current") > F.col("prev"), "UP").otherwise("DOWN").alias("trend"))


def bars_from_ticks(t: DataFrame, interval: str = "1 hour") -> DataFrame:
    """OHLCV bars of any interval; ordering inside a bar by (ts, seq), all partial aggregates."""
    o = F.struct("ts", "seq")
    return t.groupBy("symbol", F.window("ts", interval).alias("w")).agg(
        F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", o).alias("close"), F.sum("volume").alias("volume")
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def latest_snapshot(t: DataFrame, as_of, max_age_s: float) -> DataFrame:
    """Newest tick per symbol at a time, older than max_age_s dropped."""
    a = t.where(F.col("ts") <= as_of).groupBy("symbol").agg(F.max_by(F.struct("ts", "price", "bid", "ask"), F.struct("ts", "seq")).alias("x")).select("symbol", "x.*")
    age = (F.unix_micros(as_of) - F.unix_micros("ts")) / 1e6
    return a.withColumn("age_s", age).where(F.col("age_s") < max_age_s)
