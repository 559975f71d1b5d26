"""Data-quality checks per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import case, is_true
from ..plans import BAR_CHUNK, bar_blocks, narrow, previous, quantiles, time_chunk
from . import features as ft

# Seconds per bar interval; daily bars tolerate 4 intervals, others 3.
INTERVALS = {"1D": 86400, "1H": 3600, "4H": 14400, "15m": 900, "5m": 300, "1m": 60}


def missing_ticks(bars: DataFrame, interval: str = "1D") -> DataFrame:
    step = INTERVALS.get(interval, 86400)
    limit = step * (4 if interval == "1D" else 3)
    b = bar_blocks(bars.select("symbol", "ts").distinct(), before=1)
    d = b.add(gap=F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(b.w))).done()
    a = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("total_rows"), F.count(F.when(F.col("gap") > limit, 1)).alias("gap_count"),
                                F.count(F.when((F.col("gap") > limit) & (F.col("gap") > 7 * step), 1)).alias("critical_gaps"))
    g = F.col("gap_count")
    return a.select("symbol", "total_rows", "gap_count", "critical_gaps",
                    F.greatest(F.lit(0.0), 100 - g / F.col("total_rows") * 100 * 10).alias("completeness_score"),
                    case((g == 0, "CLEAN"), (g < 5, "MINOR_GAPS"), default="SIGNIFICANT_GAPS").alias("assessment"))


def price_outliers(bars: DataFrame, z: float = 3.5) -> DataFrame:
    """Returns beyond z population deviations, beyond 2.5 interquartile ranges, and inconsistent OHLC rows."""
    r = ft.returns(bars).where("lr is not null").select("symbol", "lr")
    q = quantiles(r, ["symbol"], "lr", {"q1": 0.25, "q3": 0.75})
    st = r.groupBy("symbol").agg(F.avg("lr").alias("mu"), F.stddev_pop("lr").alias("sd")).join(q, "symbol")
    iqr = F.col("q3") - F.col("q1")
    x = r.join(st, "symbol").groupBy("symbol").agg(
        F.count(F.when((F.col("sd") > 0) & (F.abs(F.col("lr") - F.col("mu")) > z * F.col("sd")), 1)).alias("z_outliers"),
        F.count(F.when((F.col("lr") < F.col("q1") - 2.5 * iqr) | (F.col("lr") > F.col("q3") + 2.5 * iqr), 1)).alias("iqr_outliers"))
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.col("low"))
    o = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("ohlc_errors"))
    y = o.join(x, "symbol", "left").fillna({"z_outliers": 0, "iqr_outliers": 0}).withColumn("total", F.col("z_outliers") + F.col("ohlc_errors"))
    t = F.col("total")
    return y.select("symbol", "z_outliers", "iqr_outliers", "ohlc_errors",
                    F.greatest(F.lit(0.0), 100 - t / F.col("n") * 100 * 5).alias("cleanliness_score"),
                    case((t == 0, "CLEAN"), (t < 5, "MINOR_ANOMALIES"), (t < 20, "SIGNIFICANT_ANOMALIES"),
                         default="SEVERELY_CONTAMINATED").alias("assessment"))


def exchange_anomalies(bars: DataFrame, jump: float = 0.30) -> DataFrame:
    """Duplicate timestamps, jumps above 30 %, zero closes, negative volume -> integrity label."""
    d = previous(narrow(bars, "symbol", "ts", "close", "volume"), ["symbol"], "ts", time_chunk("ts", BAR_CHUNK), {"_close": "close", "_ts": "ts"})
    d = d.withColumns({"chg": F.when(F.col("_close") != 0, F.abs(F.col("close") / F.col("_close") - 1)), "dup": is_true(F.col("_ts") == F.col("ts"))})
    a = d.groupBy("symbol").agg(F.count(F.when(F.col("dup"), 1)).alias("duplicate_ts"), F.count(F.when(F.col("chg") > jump, 1)).alias("price_jumps"),
                                F.max("chg").alias("max_move"), F.count(F.when(F.col("close") == 0, 1)).alias("zero_close"),
                                F.count(F.when(F.col("volume") < 0, 1)).alias("negative_volume"))
    hit = lambda n: (F.col(n) > 0).cast("int")
    a = a.withColumn("critical_anomalies", hit("price_jumps") + hit("zero_close") + hit("negative_volume"))
    a = a.withColumn("total_anomalies", F.col("critical_anomalies") + hit("duplicate_ts"))
    return a.withColumn("integrity", case((F.col("total_anomalies") == 0, "RELIABLE"), (F.col("critical_anomalies") == 0, "QUESTIONABLE"),
                                          default="COMPROMISED"))


def data_quality_report(bars: DataFrame, interval: str = "1D") -> DataFrame:
    x = (missing_ticks(bars, interval).select("symbol", "completeness_score")
         .join(price_outliers(bars).select("symbol", "cleanliness_score"), "symbol")
         .join(exchange_anomalies(bars).select("symbol", "integrity"), "symbol"))
    ex = case((F.col("integrity") == "RELIABLE", 100.0), (F.col("integrity") == "QUESTIONABLE", 60.0), default=10.0)
    x = x.withColumn("integrity_score", ex)
    x = x.withColumn("quality", F.col("completeness_score") * 0.3 + F.col("cleanliness_score") * 0.4 + F.col("integrity_score") * 0.3)
    q = F.col("quality")
    return x.withColumn("quality_label", case((q >= 85, "INSTITUTIONAL_GRADE"), (q >= 65, "ACCEPTABLE"), (q >= 40, "MARGINAL"), default="UNRELIABLE"))
