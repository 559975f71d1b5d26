"""Keyed streaming operators that need events in order.

A stream is folded micro-batch by micro-batch as ordinary Spark jobs. Rows wait in a table until the watermark passes them and then leave in event
order, so files may arrive in any order within the delay. What an operator has to remember is small (a peak, a status, a ring of last rows) and is a
table too; a hot key is cut into blocks with the rows before them, so no task sees a whole key or a whole micro-batch of one. Tables of a batch
are named by its number and overwritten when it runs again, so a restart from the checkpoint neither loses nor repeats rows. Rows later than the
watermark are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import ANN, RF_DAILY
from ..operators.ticks import cooldown_filter
from ..plans import BAR_CHUNK, TICK_CHUNK, blocked, last_rows, row_index, running
from ..session import work_dir

#: step(ring rows, new rows in order, rows seen before) -> output rows
Step = Callable[[pd.DataFrame, pd.DataFrame, int], pd.DataFrame]
#: fold(rows that the watermark has passed, table kept by the last batch or None, watermark) -> (output, table to keep or None)
Fold = Callable[[DataFrame, DataFrame | None, int], tuple[DataFrame, DataFrame | None]]
EPS = 1e-12
NEVER, ALWAYS = -(1 << 62), 1 << 62


@dataclass
class Ordered:
    """A stream with the time of its rows in ``at_us`` (microseconds) and the number of its input in ``source``, and the fold that takes it in order.
    The watermark lies ``delay`` behind the slowest input."""

    rows: DataFrame
    fold: Fold
    delay: str
    sources: int = 1

    def drain(self, name: str, complete: bool = False) -> DataFrame:
        """Fold everything available and return the written table. complete: the input has ended, so rows that still wait leave as well."""
        spark = self.rows.sparkSession
        path, state = work_dir(spark, name), work_dir(spark, name + "-state")
        pause = spark.sql(f"SELECT unix_millis(timestamp_millis(0) + interval {self.delay}) AS ms").first()["ms"]
        adaptive, last = spark.conf.get("spark.sql.adaptive.enabled"), [-1]

        def batch(df: DataFrame, n: int) -> None:
            df.sparkSession.conf.set("spark.sql.adaptive.enabled", adaptive)  # a stream's own session switches it off
            self._batch(df, n, path, state, pause)
            last[0] = n

        q = self.rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        if complete and last[0] >= 0:
            none = spark.createDataFrame([], self.rows.schema)
            self._batch(none, last[0] + 1, path, state, pause, end=True)
        return spark.read.option("recursiveFileLookup", "true").parquet(path)

    def _batch(self, df: DataFrame, n: int, path: str, state: str, pause: int, end: bool = False) -> None:
        spark = df.sparkSession
        old = f"{state}/{n - 1}"
        tops = dict(spark.read.parquet(f"{old}/tops").collect()) if n else {}
        mark = lambda t: min((t[k] // 1000 - pause) * 1000 if k in t else NEVER for k in range(self.sources))
        passed = mark(tops)
        for k, top in df.groupBy("source").agg(F.max("at_us")).collect():
            tops[k] = max(top, tops.get(k, top)) if top is not None else tops.get(k, NEVER)
        now = ALWAYS if end else mark(tops)
        rows = df.where(F.col("at_us") > passed)
        if n:
            rows = rows.unionByName(spark.read.schema(df.schema).parquet(f"{old}/waiting"))
        spark.createDataFrame(sorted(tops.items()), "source int, top long").coalesce(1).write.mode("overwrite").parquet(f"{state}/{n}/tops")
        rows.where(F.col("at_us") > now).write.mode("overwrite").parquet(f"{state}/{n}/waiting")
        out, kept = self.fold(rows.where(F.col("at_us") <= now), spark.read.parquet(f"{old}/kept") if n else None, now)
        out.write.mode("overwrite").parquet(f"{path}/{n}")
        kept.write.mode("overwrite").parquet(f"{state}/{n}/kept")


def in_order(rows: DataFrame, keys: list[str], ts: str, columns: list[str], fold: Fold, out: list[str], delay: str) -> Ordered:
    """Fold a stream per key in event order. The key is one struct, _key, in which nulls are equal; columns: what a fold sees beside it and at_us. `at_us`
    comes out as the column named ts."""
    x = rows.select(F.struct(*keys).alias("_key"), F.unix_micros(ts).alias("at_us"), *columns, F.lit(0).alias("source"))

    def named(ready, kept, mark):
        res, keep = fold(ready, kept, mark)
        return res.select(*[F.timestamp_micros("at_us").alias(ts) if n == ts else F.col(f"_key.{n}") if n in keys else F.col(n) for n in out]), keep

    return Ordered(x, named, delay)


def _day(seconds: int):
    return F.floor(F.col("at_us") / F.lit(seconds * 1_000_000)).cast("long")


def by_ring(step: Step, order: list[str], columns: list[str], ring: int, added: str, end=None) -> Fold:
    """Fold of a step that looks back over the last `ring` rows only: new rows are cut into blocks with the rows before them, of this batch or kept from the
    last one. added: schema of the columns that a step adds; end(rows with _b and _i, kept) may finish them and return a table (_key, code) that is
    kept beside the ring."""
    def fold(ready, kept, mark):
        d = row_index(ready.select("_key", "at_us", *columns), ["_key"], ["at_us", *order], _day(TICK_CHUNK)).drop("_n")
        count = ready.groupBy("_key").agg(F.count(F.lit(1)).alias("_c"))
        tail = last_rows(ready.select("_key", "at_us", *columns), ["_key"], ["at_us", *order], ring)
        if kept is None:
            rows = d.withColumn("_new", F.lit(True))
            tail = tail.join(count, "_key").withColumn("_i", F.col("_c") - F.col("_rev"))
        else:
            seen = kept.groupBy("_key").agg((F.max("_i") + 1).alias("_seen"))
            before = F.coalesce("_seen", F.lit(0))
            rows = d.join(seen, "_key", "left").withColumn("_i", F.col("_i") + before).withColumn("_new", F.lit(True)).drop("_seen")
            rows = rows.unionByName(kept.select("_key", "at_us", *columns, "_i", F.lit(False).alias("_new")))
            tail = tail.join(count, "_key").join(seen, "_key", "left").withColumn("_i", F.col("_c") + before - F.col("_rev"))
            tail = last_rows(tail.select("_key", "at_us", *columns, "_i").unionByName(kept.select("_key", "at_us", *columns, "_i")).withColumn("_at", F.col("_i")).drop("_i"), ["_key"], ["_at"], ring).withColumn("_i", F.col("_at"))
        tail = tail.select("_key", "at_us", *columns, "_i")
        b = blocked(rows, ["_key"], [], None, before=ring).df
        keys = b.schema["_key"].dataType.names
        b = b.select("_key.*", "at_us", *columns, "_b", "_i", "_own", "_new")
        kinds = dict(b.dtypes)
        names = [*keys, "at_us", *columns, "_b", "_i", *[f.strip().split()[0] for f in added.split(",")]]

        def block(pdf):
            pdf = pdf.sort_values("_i", ignore_index=True)
            own = pdf["_own"] & pdf["_new"]
            new = pdf[own].reset_index(drop=True)
            if new.empty:
                return pd.DataFrame(columns=names, dtype=object)
            return step(pdf[~own].tail(ring).reset_index(drop=True), new, int(new["_i"].iloc[0]))[names]

        out = b.groupBy(*keys, "_b").applyInPandas(block, ", ".join(f"{n} {kinds[n]}" for n in names if n in kinds) + ", " + added)
        out = out.select(F.struct(*keys).alias("_key"), *[n for n in names if n not in keys])
        return end(out, kept, tail) if end else (out, tail)

    return fold


# ---- equity -------------------------------------------------------------------------------------------------------------------------------

def equity_guard_stream(equity: DataFrame, step: float = 0.30, lock: float = 0.60, initial: float = 10000.0, delay: str = "1 day") -> Ordered:
    """Peak, ratchet floor and halt per account; what is kept is the peak."""

    def guard(ready, kept, mark):
        d = running(ready, ["_key"], ["at_us", "trade_id"], _day(BAR_CHUNK), maxs={"peak": "balance"})
        top = ready.groupBy("_key").agg(F.max("balance").alias("top"))
        if kept is not None:
            d = d.join(kept, "_key", "left").withColumn("peak", F.greatest("peak", "top"))
            top = top.unionByName(kept).groupBy("_key").agg(F.max("top").alias("top"))
        d = d.withColumn("peak", F.greatest("peak", F.lit(initial)))
        d = d.withColumn("floor", initial * (1 + F.floor((F.col("peak") - initial) / initial * 100 / step) * step * lock / 100))
        return d.withColumn("halt", (F.col("balance") <= F.col("floor")) & (F.col("floor") > initial)), top

    return in_order(equity, ["account"], "ts", ["trade_id", "balance"], guard, ["account", "ts", "trade_id", "balance", "peak", "floor", "halt"], delay)


def windows(x: np.ndarray, n: int, last: int) -> np.ndarray:
    """The n values up to each of the last `last` positions, NaN before the start."""
    padded = np.concatenate([np.full(n - 1, np.nan), x])
    return np.lib.stride_tricks.sliding_window_view(padded, n)[len(x) - last:]


def edge_latch(trades: DataFrame, window: int = 30, min_wr: float = 0.45, min_sr: float = 0.5, min_pf: float = 1.05, max_losses: int = 7, back_n: int = 10, back_wr: float = 0.52, delay: str = "1 day") -> Ordered:
    """Status per trade: suspended once three of win rate, Sharpe, profit factor and loss streak fail (from five trades on), and back only after ``back_n`` trades
    with a win rate of ``back_wr``. Kept per strategy are the last ``window`` results and the trades since suspension."""

    states, ring = back_n + 2, max(window, back_n, max_losses)  # a state: 0 active, 1 + k suspended for k trades (at most back_n)

    def walk(bads, backs, state, m, known):
        """State after each of m trades, from one change of status to the next; once a trade leaves the state that it leaves on a known walk, the rest is that walk."""
        out, i = np.zeros(m, np.uint8), 0
        while i < m:
            if known is not None and i and out[i - 1] == known[i - 1]:
                out[i:] = known[i:]
                break
            if state:
                since = state - 1
                k = backs[np.searchsorted(backs, max(i, i + back_n - since - 1)):][:1]
                j = int(k[0]) if len(k) else m
                out[i:j] = 1 + np.minimum(since + 1 + np.arange(j - i), back_n)
                state, i = 0, j + 1
            else:
                k = bads[np.searchsorted(bads, i):][:1]
                i = int(k[0]) if len(k) else m
                if i < m:
                    out[i], state, i = 1, 1, i + 1
        return out

    def latch(recent, new, seen):
        p, m = np.concatenate([recent["net_pnl_pct"], new["net_pnl_pct"]]).astype(float), len(new)
        w = windows(p, window, m)
        n = (~np.isnan(w)).sum(1)
        wins, losses = np.where(w > 0, w, 0).sum(1), -np.where(w < 0, w, 0).sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.nansum(w, 1) / n
            sd = np.where(n > 5, np.sqrt(np.nansum((w - mean[:, None]) ** 2, 1) / np.maximum(n - 1, 1)), 0.0) / 100
            sr = np.where(sd > EPS, (mean / 100 - RF_DAILY) / np.where(sd > EPS, sd, 1.0) * math.sqrt(ANN), 0.0)
            wr = (w > 0).sum(1) / n
        pf = np.where(losses > EPS, wins / np.where(losses > EPS, losses, 1.0), 9.99)
        at = np.arange(len(p))
        lost = (at - np.maximum.accumulate(np.where(p > 0, at, -1)))[len(p) - m:]  # the ring is no shorter than the streak that counts
        bad = ((wr < min_wr).astype(int) + (sr < min_sr) + (pf < min_pf) + (lost >= max_losses) >= 3) & (n >= 5)
        back = np.nansum(windows(np.where(p > 0, 1.0, 0.0), back_n, m), 1) / back_n >= back_wr
        bads, backs = np.flatnonzero(bad), np.flatnonzero(back)
        known = walk(bads, backs, 0, m, None)
        after = np.stack([known, *[walk(bads, backs, s, m, known) for s in range(1, states)]], axis=1)
        return new.assign(after=[r.tobytes() for r in after])

    def compose(out, kept, tail):
        """Rows know the state after them for each state before their block; blocks are composed along their key, one byte string a block."""
        spark = out.sparkSession
        path = work_dir(spark, "latch-blocks")
        out.select("_key", "at_us", "trade_id", "_b", "_i", "after").write.parquet(path)
        rows = spark.read.parquet(path)
        ends = rows.groupBy("_key", "_b").agg(F.max_by("after", "_i").alias("after"))
        ends = ends.join(kept.groupBy("_key").agg(F.max("code").alias("code")), "_key", "left") if kept is not None else ends.withColumn("code", F.lit(0))
        item = lambda x, s: F.conv(F.hex(F.substring(x, s + 1, 1)), 16, 10).cast("int")
        chain = ends.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_b", "after"))).alias("x"), F.max(F.coalesce("code", F.lit(0))).alias("code"))
        chain = chain.select("_key", F.aggregate("x", F.struct(F.col("code").alias("s"), F.expr("cast(array() as array<struct<_b:bigint,start:int>>)").alias("at")),
                                                 lambda a, r: F.struct(item(r["after"], a["s"]).alias("s"), F.concat(a["at"], F.array(F.struct(r["_b"].alias("_b"), a["s"].alias("start")))).alias("at"))).alias("c"))
        starts = chain.select("_key", F.inline("c.at"))
        code = chain.select("_key", F.col("c.s").alias("code"))
        if kept is not None:  # keys without a new trade stay as they are
            code = code.unionByName(kept.select("_key", "code").distinct().join(chain.select("_key"), "_key", "left_anti"))
        res = rows.join(starts, ["_key", "_b"]).withColumn("_s", item(F.col("after"), F.col("start")))
        res = res.withColumns({"status": F.when(F.col("_s") > 0, "SUSPEND").otherwise("ACTIVE"), "buffered": F.greatest(F.col("_s") - 1, F.lit(0)).cast("long")})
        return res, tail.join(code, "_key")

    fold = by_ring(latch, ["trade_id"], ["trade_id", "net_pnl_pct"], ring, "after binary", compose)
    return in_order(trades, ["strategy"], "exit_ts", ["trade_id", "net_pnl_pct"], fold, ["strategy", "exit_ts", "trade_id", "status", "buffered"], delay)


# ---- ticks --------------------------------------------------------------------------------------------------------------------------------

TICK = ["symbol", "ts", "seq"]


def _joined(ring: pd.DataFrame, new: pd.DataFrame, name: str) -> np.ndarray:
    return np.concatenate([ring[name].to_numpy(float), new[name].to_numpy(float)])


def rolling_tick_stats_stream(ticks: DataFrame, delay: str = "10 minutes") -> Ordered:
    """Mean and deviation of 20 mids (from the 10th tick on), ATR of 14 moves, mean spread of 30 and z, over a ring of 31 ticks."""

    def step(ring, new, seen):
        m, i = len(new), seen + np.arange(len(new))
        bid, ask = _joined(ring, new, "bid"), _joined(ring, new, "ask")
        mid = (bid + ask) / 2
        spread = np.where(mid > 0, (ask - bid) / np.where(mid > 0, mid, 1) * 100, 0.0)
        w, moves = windows(mid, 20, m), windows(np.abs(np.diff(mid, prepend=np.nan)), 14, m)
        with np.errstate(invalid="ignore", divide="ignore"):
            n = (~np.isnan(w)).sum(1)
            mean = np.nansum(w, 1) / n
            std = np.sqrt(np.nansum((w - mean[:, None]) ** 2, 1) / n)
            k = (~np.isnan(moves)).sum(1)
            atr = np.where((i >= 13) & (k > 0), np.nansum(moves, 1) / np.maximum(k, 1), np.nan)
            s = windows(spread, 30, m)
            z = np.where(std < 1e-10, 0.0, (mid[len(mid) - m:] - mean) / np.where(std < 1e-10, 1, std))
        out = new.assign(mean=mean, std=std, atr=pd.Series(atr).astype(object).where(~np.isnan(atr), None), avg_spread=np.nansum(s, 1) / (~np.isnan(s)).sum(1), z=z)
        return out[i >= 9]

    fold = by_ring(step, ["seq"], ["seq", "bid", "ask"], 31, "mean double, std double, atr double, avg_spread double, z double")
    return in_order(ticks, ["symbol"], "ts", ["seq", "bid", "ask"], fold, [*TICK, "mean", "std", "atr", "avg_spread", "z"], delay)


def rolling_ofi_stream(ticks: DataFrame, n: int = 20, delay: str = "10 minutes") -> Ordered:
    """Share of bid sizes in the sizes of the last n ticks, over a ring of n ticks."""

    def step(ring, new, seen):
        b, a = (np.nansum(windows(np.maximum(_joined(ring, new, c), 0), n, len(new)), 1) for c in ("bid_size", "ask_size"))
        return new.assign(ofi=np.where(b + a < 1e-10, 0.5, b / np.where(b + a < 1e-10, 1, b + a)))

    fold = by_ring(step, ["seq"], ["seq", "bid_size", "ask_size"], n, "ofi double")
    return in_order(ticks, ["symbol"], "ts", ["seq", "bid_size", "ask_size"], fold, [*TICK, "ofi"], delay)


def kyle_lambda_stream(ticks: DataFrame, n: int = 80, cap: float = 0.1, low: float = 0.002, high: float = 0.008, smooth: int = 50, delay: str = "10 minutes") -> Ordered:
    """Price impact per unit of signed volume over n ticks and its smoothed value over `smooth` estimates, over a ring of n + smooth ticks."""

    def step(ring, new, seen):
        price, volume = _joined(ring, new, "price"), _joined(ring, new, "volume")
        m, total, first = len(new), len(price), seen - len(ring)
        dp = np.diff(price, prepend=np.nan)
        sv = np.sign(dp) * np.maximum(volume, EPS)
        want = min(total, m + smooth - 1)  # estimates that the smoothing of the new ticks reads
        x, y = windows(dp, n, want), windows(sv, n, want)
        k = (~np.isnan(y)).sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            mx, my = np.nansum(x, 1) / k, np.nansum(y, 1) / k
            var = np.nansum((y - my[:, None]) ** 2, 1) / k
            cov = np.nansum((x - mx[:, None]) * (y - my[:, None]), 1) / (k - 1)
            lam = np.where(var < EPS, 0.0, np.clip(cov / np.where(var < EPS, 1, var), -cap, cap))
        lam = np.where(first + np.arange(total - want, total) >= 10, lam, np.nan)
        e = np.full(m, np.nan)
        for c in windows(lam, smooth, m).T:
            e = np.where(np.isnan(c), e, np.where(np.isnan(e), c, 0.2 * c + 0.8 * e))
        raw, a = lam[-m:], np.abs(e)
        out = new.assign(lambda_raw=raw, lambda_smooth=e, toxicity_level=np.where(a < low, "LOW", np.where(a < high, "CAUTION", "HIGH")))
        return out[~np.isnan(raw)]

    fold = by_ring(step, ["seq"], ["seq", "price", "volume"], n + smooth, "lambda_raw double, lambda_smooth double, toxicity_level string")
    return in_order(ticks, ["symbol"], "ts", ["seq", "price", "volume"], fold, [*TICK, "lambda_raw", "lambda_smooth", "toxicity_level"], delay)


def cooldown_filter_stream(signals: DataFrame, seconds: float, delay: str = "10 minutes") -> Ordered:
    """Signals at least `seconds` after the last kept one; that one stands before the signals of the next batch."""

    def fold(ready, kept, mark):
        d = ready.select(F.col("_key").alias("symbol"), F.timestamp_micros("at_us").alias("ts"), "seq")
        out = cooldown_filter(d if kept is None else d.unionByName(kept.select("symbol", "ts", "seq")), seconds)
        out = out.withColumn("old", F.lit(False)) if kept is None else out.join(kept.select("symbol", "upto"), "symbol", "left").withColumn("old", F.coalesce(F.unix_micros("ts") <= F.col("upto"), F.lit(False)))
        last = last_rows(out.select("symbol", "ts", "seq"), ["symbol"], ["ts", "seq"], 1).select("symbol", "ts", "seq", F.lit(mark).cast("long").alias("upto"))
        return out.where("not old").select(F.col("symbol").alias("_key"), F.unix_micros("ts").alias("at_us"), "seq"), last

    return in_order(signals, ["symbol"], "ts", ["seq"], fold, TICK, delay)


# ---- lead signals -------------------------------------------------------------------------------------------------------------------------

def lead_signal_stream(signals: DataFrame, flow: DataFrame, ttl: str = "8 seconds", delay: str = "10 minutes") -> Ordered:
    """For every clean flow row the best triggered signal for its symbol that is no older than `ttl`.

    signals: leader, follower, direction, confidence, lag, triggered, signal_ts; flow: symbol, ts, seq, flow_regime. The best one (ties: first leader) is final
    when the watermark passes the flow row; signals are kept for their time to live. Time is cut into stretches of one `ttl`: the signals of a flow row are
    those of its own stretch up to it and those of the stretch before from `ttl` earlier on, so its best one is the better of two running minima, and
    no signal is paired with the rows that it serves."""
    us = signals.sparkSession.sql(f"SELECT unix_micros(timestamp_millis(0) + interval {ttl}) AS us").first()["us"]
    s = signals.where("triggered and follower is not null").select(F.col("follower").alias("symbol"), F.unix_micros("signal_ts").alias("at_us"), F.lit(0).alias("source"), F.lit(None).cast("long").alias("seq"),
                                                                  F.struct((-F.col("confidence")).alias("c"), "leader", F.unix_micros("signal_ts").alias("at"), "direction", "confidence", "lag").alias("best"))
    f = flow.where("flow_regime = 'CLEAN' and symbol is not null").select("symbol", F.unix_micros("ts").alias("at_us"), F.lit(1).alias("source"), F.col("seq").cast("long").alias("seq"),
                                                                        F.lit(None).cast(s.schema["best"].dataType).alias("best"))

    def fold(ready, kept, mark):
        sig = ready.where("source = 0").select("symbol", "at_us", "best")
        sig = sig if kept is None else sig.unionByName(kept)
        at = F.col("at_us")
        x = sig.select("symbol", "at_us", F.lit(None).cast("long").alias("seq"), "best", F.lit(0).alias("_o"), at.alias("_t")).unionByName(
            ready.where("source = 1").select("symbol", "at_us", "seq", "best", F.lit(1).alias("_o"), at.alias("_t")))
        # up: the row's own stretch, forwards; down: the stretch before a flow row, backwards
        down = x.withColumns({"_t": at - F.when(F.col("_o") == 1, us).otherwise(0)})
        cut = lambda d, way, t: d.withColumns({"_s": F.floor(F.col("_t") / F.lit(us)).cast("long"), "_w": F.lit(way)}).withColumn("_t", t)
        rows = cut(x, 0, F.col("_t")).unionByName(cut(down, 1, -F.col("_t")))
        run = running(rows, ["symbol", "_s", "_w"], ["_t", "_o"], F.lit(0).cast("long"), mins={"_m": "best"})
        out = run.where("_o = 1 and _m is not null").groupBy("symbol", "at_us", "seq").agg(F.min("_m").alias("b"))
        out = out.select(F.col("symbol").alias("follower"), F.timestamp_micros("at_us").alias("ts"), "seq", "b.leader", "b.direction", "b.confidence", "b.lag", ((F.col("at_us") - F.col("b.at")) / 1e6).alias("age_s"))
        return out, sig.where(F.col("at_us") > mark - us)

    return Ordered(s.unionByName(f), fold, delay, sources=2)
