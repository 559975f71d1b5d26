"""Schemas and table views. ``Tables`` maps a folder of base parquet tables to the market data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..operators import features
from ..plans import BAR_CHUNK, TICK_CHUNK, indexed, positioned, running, time_chunk
from ..session import work_dir



BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
TICKS = ("symbol string, ts timestamp, seq long, price double, bid double, ask double, "
         "bid_size double, ask_size double, volume double")
TRADES = ("trade_id long, account string, strategy string, symbol string, direction string, "
          "entry_ts timestamp, exit_ts timestamp, entry_price double, exit_price double, size_usd double, "
          "gross_pnl_usd double, fee_usd double, slippage_usd double, net_pnl_usd double, net_pnl_pct double, "
          "exit_reason string, hold_seconds double")
EQUITY = "account string, ts timestamp, balance double"


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Typed OHLCV read from parquet, csv or json; rows without a close are dropped."""
    reader = spark.read.schema(BARS)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(path).where(F.col("close").isNotNull())


_STORED: dict = {}  # (application, folder, view) -> path of the written view


class Tables:
    """Market views over the base tables of one folder. Views that need a shuffle are written once per application to the
    shared folder and read back, as a pipeline would keep its bars and trades: later scans prune columns, several passes
    over a view cost scans only, and a lost executor re-reads files instead of recomputing the view."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def base(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        ntz = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
        return df.withColumns(ntz) if ntz else df

    def _stored(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            path = work_dir(self.spark, name)
            build().write.parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    def _path(self, name: str, build, key: str, symbol) -> DataFrame:
        """Turn per-day returns into a price path with the position of every bar."""
        p = positioned(self._stored(f"{name}_daily", build), [key], ["ts"], time_chunk("ts", BAR_CHUNK), {"s": "r"})
        return p.select(symbol.alias("symbol"), "ts", (100 * F.exp(F.col("s") - 0.9 * F.col("r"))).alias("open"),
                        (100 * F.exp("s")).alias("close"), "w", "volume", "_i", "_n")

    def _priced(self, name: str, build) -> DataFrame:
        """A stored price path as bars. High and low follow from open, close and w, which has few values, so they are not written."""
        return self._stored(name, build).select(
            "symbol", "ts", "open", (F.greatest("open", "close") * (1 + F.col("w"))).alias("high"),
            (F.least("open", "close") * (1 - F.col("w"))).alias("low"), "close", "volume", "_i", "_n")

    def bars(self) -> DataFrame:
        """Daily bars per supplier; _i and _n are a bar's position and the length of its series."""
        key = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
        return self._priced("bars", lambda: self._path("bars", self._bars_daily, "l_suppkey", key))

    def rets(self) -> DataFrame:
        """Log returns of the bars, with positions."""
        return self._stored("rets", lambda: features.return_rows(self.bars()))

    def rets_brand(self) -> DataFrame:
        return self._stored("rets_brand", lambda: features.return_rows(self.bars_brand()))

    def _bars_daily(self) -> DataFrame:
        li = self.base("lineitem")
        return li.groupBy("l_suppkey", F.col("l_shipdate").alias("ts")).agg(
            (0.2 * (F.sum("l_discount") - 0.05 * F.count(F.lit(1))) + 0.002 * F.sin(F.sum("l_extendedprice"))).alias("r"),
            (0.1 * F.avg("l_tax")).alias("w"), F.sum("l_quantity").alias("volume"))

    def bars_brand(self) -> DataFrame:
        """Daily bars per brand."""
        return self._priced("bars_brand", lambda: self._path("bars_brand", self._brand_daily, "p_brand", F.col("p_brand")))

    def _brand_daily(self) -> DataFrame:
        li = self.base("lineitem").join(self.base("part").select("p_partkey", "p_brand"),
                                        F.col("l_partkey") == F.col("p_partkey"))
        return li.groupBy("p_brand", F.col("l_shipdate").alias("ts")).agg(
            (0.2 * (F.sum("l_discount") - 0.05 * F.count(F.lit(1))) / F.sqrt(F.count(F.lit(1)).cast("double"))
             + 0.002 * F.sin(F.sum("l_extendedprice"))).alias("r"),
            (0.1 * F.avg("l_tax")).alias("w"), F.sum("l_quantity").alias("volume"))

    def _ticks(self, symbol) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return (self.base("events").where("value > 0")
                .select(symbol.alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"),
                        (F.col("value") * (1 - 0.0002 * (1 + F.col("event_id") % 7))).alias("bid"), (F.col("value") * (1 + 0.0002 * (1 + F.col("event_id") % 7))).alias("ask"),
                        (1.0 + k).alias("bid_size"), (100.0 - k).alias("ask_size"), (1.0 + k).alias("volume")))

    def ticks(self) -> DataFrame:
        """Five long series, one per event type; _i and _n are a tick's position and the length of its series."""
        return self._stored("ticks", lambda: indexed(self._ticks(F.col("event_type")), ["symbol"], ["ts", "seq"], time_chunk("ts", TICK_CHUNK)))

    def user_ticks(self) -> DataFrame:
        """Many short series, one per user."""
        return self._ticks(F.concat(F.lit("U"), F.col("user_id").cast("string")))

    def book_levels(self, depth: int = 10) -> DataFrame:
        t = self.ticks()
        lv = F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))
        side = F.explode(F.array(F.lit("B"), F.lit("A")))
        t = t.select("symbol", "ts", "seq", "bid", "ask", lv.alias("level")).select("*", side.alias("side"))
        return t.select("symbol", "ts", "seq", "side", "level",
                        F.when(F.col("side") == "B", F.col("bid") - F.col("level") * 0.01)
                        .otherwise(F.col("ask") + F.col("level") * 0.01).alias("px"),
                        (1.0 + F.pmod(F.col("seq") * 31 + F.col("level") * 17, F.lit(97))).alias("sz"))

    def book_deltas(self) -> DataFrame:
        return self.ticks().select(
            "symbol", "seq", "ts", F.when(F.col("seq") % 2 == 0, "B").otherwise("A").alias("side"),
            F.round("price", 0).alias("px"), (F.col("seq") % 7).cast("double").alias("sz"))

    def _hourly(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return (self.base("events").where("value > 0")
                .groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts"))
                .agg(F.avg(k).alias("ak"), F.sum(k - 49.5).alias("sk"), F.round(F.avg("value"), 6).alias("price")))

    def funding(self) -> DataFrame:
        return self._hourly().select("symbol", "ts", F.round((F.col("ak") - 49.5) / 100000, 10).alias("rate"),
                                     F.col("price").alias("mark_px"), (F.col("price") * 0.9991317).alias("index_px"))

    def oi(self) -> DataFrame:
        h = running(self._hourly(), ["symbol"], ["ts"], time_chunk("ts", TICK_CHUNK * 30), sums={"s": "sk"})
        return h.select("symbol", "ts", (1e7 + 100 * F.col("s")).alias("oi_usd"), "price")

    def trades(self) -> DataFrame:
        """Closed trades, one per order line."""
        return self._stored("trades", self._trades)

    def trades_once(self) -> DataFrame:
        """Closed trades for a reader that passes over them once: taken from the stored view if there is one, else computed on the way, so that only the
        columns it reads are shuffled and nothing is written."""
        key = (self.spark.sparkContext.applicationId, self.folder, "trades")
        return self.trades() if key in _STORED else self._trades()

    def _trades(self) -> DataFrame:
        li = self.base("lineitem")
        o = self.base("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        nth = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
        t = (li.join(o, li.l_orderkey == o.o_orderkey)
             .withColumn("trade_id", F.col("l_orderkey") * 1000 + F.row_number().over(nth)))
        px, pr = F.col("l_extendedprice"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 6)
        at = lambda day, sec: F.timestamp_seconds(F.unix_timestamp(day) + sec)
        entry = at(F.least("o_orderdate", "l_shipdate"), F.col("l_orderkey") * 7919 % 86400)
        exit_ = at(F.greatest("o_orderdate", "l_shipdate"), 86400 + F.col("l_partkey") * 7907 % 86400)
        gross = F.round(px * (F.col("l_discount") - 0.045), 6)
        fee = F.round(px * 0.0007, 6)
        return t.select(
            "trade_id", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("account"),
            F.col("o_orderpriority").alias("strategy"),
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
            F.when(F.col("l_linestatus") == "O", "LONG").otherwise("SHORT").alias("direction"),
            entry.alias("entry_ts"), exit_.alias("exit_ts"),
            pr.alias("entry_price"), F.round(pr * (1 + F.col("l_discount") - 0.045), 6).alias("exit_price"),
            px.alias("size_usd"), gross.alias("gross_pnl_usd"), fee.alias("fee_usd"),
            F.round(px * F.col("l_tax") * 0.01, 6).alias("slippage_usd"),
            F.round(gross - fee, 6).alias("net_pnl_usd"),
            F.round(100 * (gross - fee) / px, 6).alias("net_pnl_pct"),
            F.when(F.col("l_returnflag") == "A", "TAKE_PROFIT").when(F.col("l_returnflag") == "R", "STOP_LOSS")
            .otherwise("TIME_STOP").alias("exit_reason"),
            (F.unix_timestamp(exit_) - F.unix_timestamp(entry)).cast("double").alias("hold_seconds"),
            # signal metadata at entry
            F.round((F.col("l_quantity") - 25) / 10, 6).alias("entry_zscore"),
            F.round(F.col("l_tax") * 12, 6).alias("entry_ofi"),
            F.round(F.col("l_discount") * 10, 6).alias("entry_kyle_lambda"),
            (F.col("l_linenumber") % 2 == 0).alias("lead_lag_active"),
            F.when(F.col("l_tax") > 0.04, "SHORT_CARRY").when(F.col("l_tax") < 0.02, "LONG_CARRY").alias("funding_signal"),
            F.when(F.col("l_quantity") > 33, "TRENDING").when(F.col("l_quantity") > 16, "RANGING")
            .otherwise("VOLATILE").alias("regime"),
            F.round(F.col("l_quantity") * 2, 6).alias("quality_score"),
            (F.col("l_linenumber") % 3 == 0).alias("maker_order"))

    def equity(self) -> DataFrame:
        """Running balance per account after each trade."""
        return self._stored("equity", self._equity)

    def proposals(self) -> DataFrame:
        """Every trade's entry as a proposed order; the few columns are stored, as several passes read them, with those of the exits for ``equity``."""
        return self._stored("proposals", lambda: self.trades_once().select(
            "account", "entry_ts", "exit_ts", "trade_id", "entry_price", "size_usd", "net_pnl_usd")).select(
            "account", F.col("entry_ts").alias("ts"), F.col("trade_id").alias("order_id"), "entry_price", (F.col("entry_price") * 0.998).alias("stop_price"), "size_usd")

    def results(self) -> DataFrame:
        """Exit and result of every trade; the few columns are stored for readers that pass over them more than once."""
        return self._stored("results", lambda: self.trades_once().select("account", "exit_ts", "trade_id", "net_pnl_usd", "net_pnl_pct"))

    def _results(self) -> DataFrame:
        path = _STORED.get((self.spark.sparkContext.applicationId, self.folder, "proposals"))
        t = self.spark.read.parquet(path) if path else self.results()
        return t.select("account", F.col("exit_ts").alias("ts"), "trade_id", "net_pnl_usd")

    def _equity(self) -> DataFrame:
        t = self._results()
        e = positioned(t, ["account"], ["ts", "trade_id"], time_chunk("ts", BAR_CHUNK), {"s": "net_pnl_usd"})
        return e.select("account", "ts", "trade_id", (10000 + F.col("s") * 0.0517131).alias("balance"), "_i", "_n")

    def positions(self) -> DataFrame:
        o = self.base("orders").where("o_orderstatus = 'O'")
        px = F.col("o_totalprice")
        return o.select(F.col("o_orderkey").alias("position_id"), F.col("o_orderpriority").alias("strategy"),
                        F.concat(F.lit("C"), (F.col("o_custkey") % 40).cast("string")).alias("symbol"),
                        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("account"),
                        F.when(F.col("o_orderkey") % 3 == 0, "SHORT").otherwise("LONG").alias("direction"),
                        px.alias("entry_price"), F.round(px * 0.98, 6).alias("stop_price"), px.alias("size_usd"),
                        F.col("o_orderdate").alias("opened_at"))
