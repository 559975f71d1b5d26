"""Ordered analytics that survive a hot key.

A plain ``Window.partitionBy(symbol).orderBy(ts)`` sends a whole symbol to one task. Here a series is cut
into blocks first, so that the largest task holds one block however many rows the symbol has:

* ``blocked``     - rows get their position in the series and are cut every ``rows`` rows; each block carries a
                    copy of its neighbours' edge rows (the halo), so any frame no longer than the halo is exact.
* ``running``     - unbounded running sums / maxima: scan inside a time chunk, plus the carry of earlier chunks; a chunk with
                    more than SPLIT_ROWS rows is cut finer first, so a crowded day of one key is not one task.
* ``last_rows``   - newest n rows per key; Spark turns the rank filter into a per-task limit before the shuffle.
* ``order_stats`` - exact order statistics by counting value chunks and sorting only the chunk that is hit.
* ``affine_scan`` - exponential averages as composed affine maps of blocks.
* ``whole_blocks`` - complete blocks in a task, for recursions that NumPy runs over several blocks side by side.
* ``positioned``  - positions, running sums and their minima in one pass, for views that are written.
* ``by_series``   - plain windows for series that one task holds, blocks only for longer ones.
* ``indexed``     - positions stored with a table, so that the operators above count nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import c

BLOCK_ROWS = 8192  # rows per block: a task's unit of work, independent of the size of a key
DAY = 86400
BAR_CHUNK = 366 * DAY  # coarse time cut for bars
TICK_CHUNK = DAY  # coarse time cut for ticks and trades
SPLIT_ROWS = 1_000_000  # a (key, chunk) with more rows is cut into finer stretches of its order column
BUCKETS = 1 << 16  # hash buckets of keys that are counted to find keys with many rows


def by_length(df: DataFrame, work) -> DataFrame:
    """work(rows, lone) over the series that one block holds and over the longer ones, for a stored frame with positions: the scan tells them apart."""
    if "_n" not in df.columns:
        return work(df, False)
    return work(df.where(F.col("_n") <= BLOCK_ROWS), True).unionByName(work(df.where(F.col("_n") > BLOCK_ROWS), False))


def time_chunk(ts, seconds: int) -> Column:
    """Coarse, order-preserving cut of a timestamp column."""
    return F.floor(F.unix_micros(c(ts)) / F.lit(seconds * 1_000_000)).cast("long")


def value_chunk(x) -> Column:
    """Coarse, order-preserving cut of a double column: relative steps of 1/4096, finer around zero."""
    return F.floor(F.signum(c(x)) * F.asinh(F.abs(c(x)) * 1e4) * 4096).cast("long")  # asinh itself loses digits below zero


def _order_value(df: DataFrame, order: list) -> Column:
    t = c(order[0])
    return F.unix_micros(t) if isinstance(df.select(t.alias("t")).schema["t"].dataType, T.TimestampType) else t.cast("double")


def _crowded(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Chunks that hold too many rows, and the width of the equal stretches to cut them in. There is at most one per SPLIT_ROWS rows, which bounds the broadcast."""
    x = _order_value(df, order)
    per = df.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_m"), F.min(x).alias("_lo"), F.max(x).alias("_hi")).where((F.col("_m") > SPLIT_ROWS) & (F.col("_hi") > F.col("_lo")))
    return F.broadcast(per.select(*keys, "_chunk", "_lo", ((F.col("_hi") - F.col("_lo")) / F.ceil(F.col("_m") / (SPLIT_ROWS / 4))).alias("_width")))


def _stretches(df: DataFrame, keys: list[str], order: list, hot: DataFrame) -> DataFrame:
    cut = F.coalesce(F.floor((_order_value(df, order) - F.col("_lo")) / F.col("_width")), F.lit(0)).cast("long")
    return df.join(hot, [*keys, "_chunk"], "left").withColumn("_chunk", F.struct(F.col("_chunk").alias("c"), cut.alias("s"))).drop("_lo", "_width")


def _chunked(df: DataFrame, keys: list[str], order: list, chunk: Column) -> DataFrame:
    """Add _chunk: the coarse chunk, and inside a chunk that holds too many rows an equal stretch of the first order column, so that
    one crowded day of a hot key is many tasks. Crowded chunks are counted first. Rows with one and the same value stay together. Chunks over row positions are
    bounded already."""
    df = df.withColumn("_chunk", chunk)
    return df if order[0] in ("_i", "slot") else _stretches(df, keys, order, _crowded(df, keys, order))


def _carry(df: DataFrame, keys: list[str], parts: dict[str, tuple[str, Column]]) -> DataFrame:
    """Per (key, _chunk): totals of all EARLIER chunks of the key. parts: name -> (sum|max|min, expression)."""
    agg = {"sum": F.sum, "max": F.max, "min": F.min}
    per = df.groupBy(*keys, "_chunk").agg(*[agg[kind](x).alias(n) for n, (kind, x) in parts.items()])
    w = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, "_chunk", *[agg[kind](n).over(w).alias(n) for n, (kind, _) in parts.items()])


def running(df: DataFrame, keys: list[str], order: list, chunk: Column, *,
            sums: dict | None = None, maxs: dict | None = None, mins: dict | None = None) -> DataFrame:
    """Add running sums / maxima / minima over all rows of the key up to the current one."""
    want = {**{n: ("sum", c(x)) for n, x in (sums or {}).items()},
            **{n: ("max", c(x)) for n, x in (maxs or {}).items()},
            **{n: ("min", c(x)) for n, x in (mins or {}).items()}}
    columns = df.columns
    df = _chunked(df, keys, order, chunk)
    carry = _carry(df, keys, {f"_c_{n}": v for n, v in want.items()})
    w = (Window.partitionBy(*keys, "_chunk").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = df.join(carry, [*keys, "_chunk"])
    exprs = []
    for n, (kind, x) in want.items():
        if kind == "sum":
            exprs.append((F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.coalesce(F.sum(x).over(w), F.lit(0))).alias(n))
        elif kind == "max":
            exprs.append(F.greatest(F.col(f"_c_{n}"), F.max(x).over(w)).alias(n))
        else:
            exprs.append(F.least(F.col(f"_c_{n}"), F.min(x).over(w)).alias(n))
    return out.select(*[F.col(k) for k in columns], *exprs)


def narrow(df: DataFrame, *cols) -> DataFrame:
    """Columns of a frame, with the positions that ``indexed`` has given its rows."""
    return df.select(*cols, *[x for x in ("_i", "_n") if x in df.columns])


def indexed(df: DataFrame, keys: list[str], order: list, chunk: Column) -> DataFrame:
    """A series with the position _i of each row and the length _n, for a table that is written once and read by many operators: they cut
    blocks by position then, and count nothing again. The positions hold as long as no row is filtered out."""
    return df if "_i" in df.columns else row_index(df, keys, order, chunk)


def by_position(df: DataFrame, order: list, chunk: Column) -> tuple[list, Column]:
    """Order and chunks of a running scan: positions where the frame has them."""
    return (["_i"], F.floor(F.col("_i") / BLOCK_ROWS).cast("long")) if "_i" in df.columns else (order, chunk)


def row_index(df: DataFrame, keys: list[str], order: list, chunk: Column) -> DataFrame:
    """Add _i, the 0-based position of each row in its key's series, and _n, the length of the series."""
    df = _chunked(df, keys, order, chunk)
    per = df.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_m"))
    wk = Window.partitionBy(*keys)
    carry = per.select(*keys, "_chunk", F.sum("_m").over(wk).alias("_n"),
                       (F.sum("_m").over(wk.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")).alias("_before"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (df.join(carry, [*keys, "_chunk"])
            .withColumn("_i", F.col("_before") + F.row_number().over(w) - 1)
            .drop("_before", "_chunk"))


def _long_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than SPLIT_ROWS rows, at most one per SPLIT_ROWS rows. Hash buckets of keys are counted first, which sends a few bytes a bucket and task however
    many keys there are; keys are counted only in buckets that hold so many rows."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    full = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > SPLIT_ROWS).select("_bucket")
    some = df.select(*keys, bucket).join(F.broadcast(full), "_bucket", "left_semi")
    return some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > SPLIT_ROWS).select(*keys)


def positioned(df: DataFrame, keys: list[str], order: list, chunk: Column, sums: dict, lows: dict | None = None) -> DataFrame:
    """``row_index``, the running ``sums`` and the running minima of some of them (``lows``: name -> name of a sum) in one pass, for rows whose keys are not null.
    A series of up to SPLIT_ROWS rows is one chunk, numbered and summed where its rows meet; a longer one is cut as in ``_chunked``, and the totals of earlier chunks
    are added. So rows are shuffled once, and only chunks of long series, which are few, have a carry."""
    columns, lows = df.columns, lows or {}
    df = df.dropna(subset=keys)
    long = F.broadcast(_long_keys(df, keys).withColumn("_long", F.lit(True)))
    some = df.join(long, keys).withColumn("_chunk", chunk)
    hot = _crowded(some, keys, order)
    by = [*keys, "_chunk"]
    past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = {f"_l_{n}": F.coalesce(F.sum(c(x)).over(past), F.lit(0)) for n, x in sums.items()}
    least = {f"_l_{n}": F.min(f"_l_{x}").over(past) for n, x in lows.items()}
    rows = _stretches(df.join(long, keys, "left").withColumn("_chunk", F.when(F.col("_long"), chunk)), keys, order, hot)
    rows = rows.select(*columns, "_chunk", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("_k"), F.count(F.lit(1)).over(past.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_m"),
                       *[x.alias(n) for n, x in so_far.items()]).withColumns(least)
    cut = _stretches(some, keys, order, hot)
    per = cut.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"), *[F.coalesce(F.sum(c(x)), F.lit(0)).alias(f"_t_{n}") for n, x in sums.items()])
    if lows:
        per = per.join(cut.select(*by, *[x.alias(n) for n, x in so_far.items()]).groupBy(*by).agg(*[F.min(f"_l_{x}").alias(f"_t_{n}") for n, x in lows.items()]), by)
    wk = Window.partitionBy(*keys)
    wp = wk.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("*", F.sum("_m").over(wk).alias("_n"), F.coalesce(F.sum("_m").over(wp), F.lit(0)).alias("_before"), *[F.coalesce(F.sum(f"_t_{n}").over(wp), F.lit(0)).alias(f"_c_{n}") for n in sums])
    carry = carry.select(*by, "_n", "_before", *[f"_c_{n}" for n in sums], *[F.min(F.col(f"_c_{x}") + F.col(f"_t_{n}")).over(wp).alias(f"_c_{n}") for n, x in lows.items()])
    plus = lambda a, b: F.col(b) + F.coalesce(F.col(a), F.lit(0))
    return rows.join(F.broadcast(carry), by, "left").select(
        *columns, (plus("_before", "_k") - 1).alias("_i"), F.coalesce("_n", "_m").alias("_n"), *[plus(f"_c_{n}", f"_l_{n}").alias(n) for n in sums],
        *[F.least(F.col(f"_c_{n}"), plus(f"_c_{x}", f"_l_{n}")).alias(n) for n, x in lows.items()])


@dataclass
class Blocks:
    """A series cut into blocks with halos, or not cut (``by_series``). ``w`` orders a block; ``done()`` drops the halo copies."""

    df: DataFrame
    keys: list[str]
    rows: int
    order: tuple = ("_i",)
    cut: bool = True

    @property
    def w(self):
        return Window.partitionBy(*self.keys, *(["_b"] if self.cut else [])).orderBy(*self.order)

    def frame(self, n: int):
        """The last n rows, current one included."""
        return self.w.rowsBetween(-(n - 1), 0)

    def full(self, n: int, expr: Column, lead: int = 0) -> Column:
        """expr where the last n rows exist, null during warm-up (lead: rows already lost to differencing)."""
        return F.when(F.col("_i") >= n - 1 + lead, expr)

    def add(self, **cols) -> "Blocks":
        return Blocks(self.df.withColumns(cols), self.keys, self.rows, self.order, self.cut)

    def past(self, **maxs) -> "Blocks":
        """Running maxima over all rows of the series up to the current one. Frames come before it: halo copies are dropped here."""
        if not self.cut:
            return self.add(**{n: F.max(c(x)).over(self.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for n, x in maxs.items()})
        own = self.df.where("_own")
        return Blocks(running(own, self.keys, ["_i"], F.col("_b"), maxs=maxs), self.keys, self.rows)

    def done(self, drop_index: bool = True) -> DataFrame:
        out = self.df.where("_own").drop("_b", "_own") if self.cut else self.df
        return out.drop("_i", "_n") if drop_index else out


def by_series(df: DataFrame, keys: list[str], order: list, chunk: Column, before: int, work) -> DataFrame:
    """work(Blocks), which gives a frame, over the series that one task holds, in plain windows with one shuffle of the rows, and over the longer ones in blocks with
    halos of ``before`` rows. Long are series beyond a block in a frame with positions, and beyond SPLIT_ROWS rows, without null keys, in one without."""
    if "_i" in df.columns:
        short, long, at = df.where(F.col("_n") <= BLOCK_ROWS), df.where(F.col("_n") > BLOCK_ROWS), ["_i"]
    else:
        df = df.dropna(subset=keys)
        many = F.broadcast(_long_keys(df, keys))
        w = Window.partitionBy(*keys).orderBy(*order)
        short, long, at = df.join(many, keys, "left_anti"), df.join(many, keys, "left_semi"), order
        short = short.withColumns({"_i": (F.row_number().over(w) - 1).cast("long"), "_n": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return work(Blocks(short, keys, SPLIT_ROWS, tuple(at), cut=False)).unionByName(work(blocked(long, keys, order, chunk, before=before)))


def blocked(df: DataFrame, keys: list[str], order: list, chunk: Column, *,
            before: int = 0, after: int = 0, rows: int | None = None) -> Blocks:
    """Cut each key's series into blocks of ``rows`` rows; edge rows are copied into the neighbour block."""
    rows = max(rows or BLOCK_ROWS, before, after)
    df = df if "_i" in df.columns else row_index(df, keys, order, chunk)
    b, off = F.floor(F.col("_i") / rows).cast("long"), F.col("_i") % rows
    homes = [F.struct(b.alias("b"), F.lit(True).alias("own"))]
    if before:
        homes.append(F.when(off >= rows - before, F.struct((b + 1).alias("b"), F.lit(False).alias("own"))))
    if after:
        homes.append(F.when((off < after) & (b > 0), F.struct((b - 1).alias("b"), F.lit(False).alias("own"))))
    if len(homes) == 1:
        out = df.withColumns({"_b": b, "_own": F.lit(True)})
    else:
        out = (df.withColumn("_h", F.explode(F.array_compact(F.array(*homes))))
               .withColumns({"_b": F.col("_h.b"), "_own": F.col("_h.own")}).drop("_h"))
    return Blocks(out, keys, rows)


def trailing_sum(events: DataFrame, probes: DataFrame, keys: list[str], t: str, value: str, span: int, chunk: int, name: str) -> DataFrame:
    """probes with the sum of `value` over the events of the key in [t - span, t] (t: a long). It is the difference of two prefix sums, each looked up as of
    a time in one running scan over both inputs, so neither a busy stretch of a key nor the span decides how much a task holds."""
    ids = [x for x in probes.columns if x not in (*keys, t)]
    none = [F.lit(None).cast(probes.schema[i].dataType).alias(i) for i in ids]
    e = events.select(*keys, t, F.col(value).alias("_v"), F.lit(0).alias("_k"), F.lit(None).cast("long").alias("_at"), *none)
    zero = F.lit(0).cast(events.schema[value].dataType).alias("_v")
    p = [probes.select(*keys, x.alias(t), zero, F.lit(k).alias("_k"), F.col(t).alias("_at"), *ids) for k, x in ((1, F.col(t)), (-1, F.col(t) - span - 1))]
    rows = e.unionByName(p[0]).unionByName(p[1]).withColumn("_o", F.abs("_k"))  # events of one time come first
    run = running(rows, keys, [t, "_o"], F.floor(F.col(t) / chunk).cast("long"), sums={"_p": "_v"}).where("_o = 1")
    return run.groupBy(*keys, F.col("_at").alias(t), *ids).agg(F.sum(F.col("_p") * F.col("_k")).alias(name))


def day_starts(df: DataFrame, keys: list[str], day, extra: Column | None = None) -> DataFrame:
    """Add _day, for a frame with positions: (position of the first row of the row's day, `extra` at that row). A scan over positions that restarts at
    each day, so a day with most rows of its key is many tasks."""
    b = blocked(df.withColumn("_today", c(day)), keys, ["_i"], F.floor(F.col("_i") / BLOCK_ROWS), before=1)
    first = F.coalesce(F.lag("_today").over(b.w) != F.col("_today"), F.lit(True))
    mark = F.struct(F.col("_i").alias("at"), *([extra.alias("x")] if extra is not None else []))
    d = b.add(_mark=F.when(first, mark)).done(drop_index=False)
    return running(d, keys, ["_i"], F.floor(F.col("_i") / BLOCK_ROWS).cast("long"), maxs={"_day": "_mark"}).drop("_mark", "_today")


def runs(df: DataFrame, keys: list[str], order: list, chunk: Column, state) -> DataFrame:
    """Gaps and islands: add _run (number of the maximal stretch of equal states) next to _i and _n."""
    b = blocked(df, keys, order, chunk, before=1)
    prev = F.lag(c(state)).over(b.w)
    d = b.add(_chg=F.when(prev.isNull() | (prev != c(state)), 1).otherwise(0)).done(drop_index=False)
    return running(d, keys, ["_i"], F.floor(F.col("_i") / b.rows).cast("long"), sums={"_run": "_chg"}).drop("_chg")


def bar_blocks(bars: DataFrame, *, before: int = 0, after: int = 0, keys=("symbol",), rows: int | None = None) -> Blocks:
    return blocked(bars, list(keys), ["ts"], time_chunk("ts", BAR_CHUNK), before=before, after=after, rows=rows)


def previous(df: DataFrame, keys: list[str], order: str, chunk: Column, cols: dict[str, str]) -> DataFrame:
    """Add columns (name -> column) of the row before, in time order. A frame without positions is shuffled once: a chunk's first row takes the last values of
    the chunk before it."""
    if "_i" in df.columns:
        b = blocked(df, keys, [order], chunk, before=1)
        return b.add(**{n: F.lag(x).over(b.w) for n, x in cols.items()}).done()
    columns = df.columns
    df = _chunked(df, keys, [order], chunk)
    at = F.coalesce(F.unix_micros(order), F.lit(1 - (1 << 63)))  # rows without a time come first
    per = df.groupBy(*keys, "_chunk").agg(*[F.max_by(x, at).alias(f"_c_{n}") for n, x in cols.items()])
    wk = Window.partitionBy(*keys).orderBy("_chunk")
    carry = per.select(*keys, "_chunk", *[F.lag(f"_c_{n}").over(wk).alias(f"_c_{n}") for n in cols])
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    local = df.select(*columns, "_chunk", F.row_number().over(w).alias("_k"), *[F.lag(x).over(w).alias(f"_l_{n}") for n, x in cols.items()])
    return local.join(carry, [*keys, "_chunk"]).select(*columns, *[F.when(F.col("_k") == 1, F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}")).alias(n) for n in cols])


def tick_blocks(ticks: DataFrame, *, before: int = 0, after: int = 0, keys=("symbol",), rows: int | None = None) -> Blocks:
    return blocked(ticks, list(keys), ["ts", "seq"], time_chunk("ts", TICK_CHUNK), before=before, after=after, rows=rows)


def last_rows(df: DataFrame, keys: list[str], order: list, n: int, name: str = "_rev") -> DataFrame:
    """Newest n rows of each key, numbered 1 (newest) to n. n up to 1000 keeps the limit before the shuffle."""
    if "_i" in df.columns:
        return df.withColumn(name, (F.col("_n") - F.col("_i")).cast("int")).where(F.col(name) <= n).drop("_i", "_n")
    w = Window.partitionBy(*keys).orderBy(*[c(o).desc() for o in order])
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def tail_rows(df: DataFrame, keys: list[str], order: list, chunk: Column, n: int, name: str = "_rev") -> DataFrame:
    """Newest n rows of each key like ``last_rows``; beyond 1000 rows positions come from chunk counts instead of a rank over the key."""
    if n <= 1000:
        return last_rows(df, keys, order, n, name)
    d = indexed(df, keys, order, chunk)
    return d.withColumn(name, F.col("_n") - F.col("_i")).where(F.col(name) <= n).drop("_i", "_n")


def memory(factor: float, most: int = 1_000_000) -> int:
    """Rows after which a recursion that keeps ``factor`` of its past per row has lost it to double precision."""
    if not 0 <= factor < 1 or (n := math.ceil(math.log(1e-17) / math.log(factor)) if factor > 0 else 1) > most:
        raise ValueError(f"these parameters leave a memory of more than {most} rows")
    return n


def order_stats(df: DataFrame, keys: list[str], value, ranks: dict, extra: dict | None = None, lone: bool = False) -> DataFrame:
    """Exact order statistics per key: ranks maps an output name to a function of the row count n giving the
    0-based rank. Equal values are counted first, then value chunks are counted, and only rows of a chunk that
    holds a wanted rank are sorted - no task sees a whole key. lone: each key has no more rows than a block, so its values are
    sorted where they meet, each sent once. extra: aggregates of the same rows by name."""
    more = [x.alias(n) for n, x in (extra or {}).items()]
    if lone:
        a = df.dropna(subset=keys).groupBy(*keys).agg(F.sort_array(F.collect_list(c(value))).alias("_a"), *more).where(F.size("_a") > 0)
        n = F.size("_a").cast("long")
        return a.select(*keys, *[F.get("_a", f(n).cast("int")).alias(name) for name, f in ranks.items()], n.alias("_n"), *(extra or {}))
    if extra:
        return order_stats(df, keys, value, ranks).join(df.groupBy(*keys).agg(*more), keys)
    v = (df.where(c(value).isNotNull()).groupBy(*keys, c(value).alias("_v"))
         .agg(F.count(F.lit(1)).alias("_m")).withColumn("_chunk", value_chunk("_v")))
    per = v.groupBy(*keys, "_chunk").agg(F.sum("_m").alias("_cm"))
    w = Window.partitionBy(*keys).orderBy("_chunk")
    cum = (per.withColumn("_before", F.coalesce(F.sum("_cm").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("_n", F.sum("_cm").over(Window.partitionBy(*keys))))
    wanted = [f(F.col("_n")).cast("long") for f in ranks.values()]
    hit = None
    for r in wanted:
        h = (r >= F.col("_before")) & (r < F.col("_before") + F.col("_cm"))
        hit = h if hit is None else hit | h
    hits = cum.where(hit).select(*keys, "_chunk", "_before", "_n")
    inner = Window.partitionBy(*keys, "_chunk").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = v.join(hits, [*keys, "_chunk"]).withColumn("_to", F.col("_before") + F.sum("_m").over(inner))
    picks = [F.max(F.when((r >= F.col("_to") - F.col("_m")) & (r < F.col("_to")), F.col("_v"))).alias(name)
             for name, r in zip(ranks, wanted)]
    return rows.groupBy(*keys).agg(*picks, F.max("_n").alias("_n"))


def quantile_ranks(probs: dict[str, float]) -> dict:
    """The order statistics that quantiles interpolate between, for ``order_stats``."""
    ranks = {}
    for name, p in probs.items():
        ranks[f"_lo_{name}"] = lambda n, p=p: F.floor((n - 1) * p)
        ranks[f"_hi_{name}"] = lambda n, p=p: F.ceil((n - 1) * p)
    return ranks


def quantile_col(name: str, p: float) -> Column:
    """The quantile from the order statistics of ``quantile_ranks`` and the row count _n."""
    lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
    return lo + (hi - lo) * ((F.col("_n") - 1) * p - F.floor((F.col("_n") - 1) * p))


def quantiles(df: DataFrame, keys: list[str], value, probs: dict[str, float], extra: dict | None = None, lone: bool = False) -> DataFrame:
    """Exact quantiles per key with linear interpolation between order statistics."""
    st = order_stats(df, keys, value, quantile_ranks(probs), extra, lone)
    return st.select(*keys, *[quantile_col(name, p).alias(name) for name, p in probs.items()], *(extra or {}))


def drawdown_rows(df: DataFrame, keys: list[str], order: list, chunk: Column, log_ret) -> DataFrame:
    """Add cum = exp(running sum of log returns) and peak = its running maximum, in one carry pass.
    Inside a chunk the peak of the local sum is known; earlier chunks add one offset and one earlier peak."""
    order, chunk = by_position(df, order, chunk)
    df = _chunked(df, keys, order, chunk).withColumn("_x", c(log_ret))
    w = (Window.partitionBy(*keys, "_chunk").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = df.withColumn("_s", F.sum("_x").over(w))
    local = local.withColumn("_m", F.max("_s").over(w))
    per = local.groupBy(*keys, "_chunk").agg(F.sum("_x").alias("_t"), F.max("_s").alias("_pm"))
    wk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_c", F.coalesce(F.sum("_t").over(wk), F.lit(0.0)))
    per = per.withColumn("_p", F.max(F.col("_c") + F.col("_pm")).over(wk))
    out = local.join(per.select(*keys, "_chunk", "_c", "_p"), [*keys, "_chunk"])
    return (out.withColumns({"cum": F.exp(F.col("_c") + F.col("_s")),
                             "peak": F.exp(F.greatest(F.col("_p"), F.col("_c") + F.col("_m")))})
            .drop("_chunk", "_x", "_s", "_m", "_c", "_p"))


def ordered_array(cols: list[str], order: str = "_i") -> Column:
    """Rows of a group as an array in series order (groups are bounded by a block or by last_rows)."""
    return F.array_sort(F.collect_list(F.struct(order, *cols)))


def spread(df: DataFrame, *keys) -> DataFrame:
    """Hash rows over all shuffle partitions: for work that is heavy per byte, which size-based coalescing would pile up."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def affine_scan(df: DataFrame, keys: list[str], order: list, chunk: Column, value, decays: dict[str, float]) -> DataFrame:
    """Add y(t) = (1 - a) y(t - 1) + a x(t) for each (name, a), seeded with the first value of the key.

    A block of rows is the affine map y = q^n y0 + b, and maps compose: inside a block y0 = 0 gives every row's own part as one running sum
    (of a x q^-k, times q^k; all terms shrink backwards, so no digits are lost), the blocks' b are one aggregate, and the state before a block is
    the sum of the blocks before it, each faded by the rows since. Blocks are short enough for q^-k to stay a double. No row is copied,
    no array is built, and a hot key is many blocks.
    """
    q = {n: 1 - a for n, a in decays.items()}
    if not all(0 < v < 1 for v in q.values()):
        raise ValueError("weights must lie between 0 and 1")
    rows = max(1, min([BLOCK_ROWS, *[int(460 / -math.log(v)) for v in q.values()]]))
    b = blocked(df, keys, order, chunk, rows=rows)
    off, x = (F.col("_i") % rows).cast("double"), c(value).cast("double")
    w = b.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = b.df.withColumns({f"_y_{n}": F.pow(F.lit(v), off) * F.sum((1 - v) * x * F.pow(F.lit(v), -off)).over(w) for n, v in q.items()})
    first = F.max(F.when(F.col("_i") == 0, x))
    ends = b.df.groupBy(*keys, "_b").agg(first.alias("_x0"), *[F.sum((1 - v) * x * F.pow(F.lit(v), rows - 1 - off)).alias(f"_e_{n}") for n, v in q.items()])
    wk = Window.partitionBy(*keys).orderBy("_b")
    carries = []
    for n, v in q.items():
        fade, end = v ** rows, F.coalesce(F.col("_x0") * F.lit(v ** rows), F.lit(0.0)) + F.col(f"_e_{n}")
        reach = 1 if fade <= 1e-18 else math.ceil(math.log(1e-18) / math.log(fade))  # blocks until a block has faded
        terms = [F.coalesce(F.lag(end, j + 1).over(wk), F.lit(0.0)) * fade ** j for j in range(reach)]
        carries.append(F.coalesce("_x0", sum(terms[1:], terms[0])).alias(f"_c_{n}"))
    out = local.join(ends.select(*keys, "_b", *carries), [*keys, "_b"])
    for n, v in q.items():
        out = out.withColumn(n, F.col(f"_y_{n}") + F.pow(F.lit(v), off + 1) * F.col(f"_c_{n}"))
    return out.drop("_b", "_own", *[f"_{k}_{n}" for n in q for k in "yc"])


def whole_blocks(frames, tag: list[str], rows: int = 1 << 16):
    """Lists of complete blocks, about ``rows`` rows together, from frames sorted by ``tag`` and position: a block never ends at a batch."""
    import pandas as pd

    ready, size, tail, tail_tag = [], 0, [], None
    for pdf in frames:
        for t, part in pdf.groupby(tag, sort=False, dropna=False):
            if tail and t != tail_tag:
                ready.append(pd.concat(tail, ignore_index=True))
                tail = []
                if size >= rows:
                    yield ready
                    ready, size = [], 0
            tail_tag = t
            tail.append(part)
            size += len(part)
    if tail:
        ready.append(pd.concat(tail, ignore_index=True))
    if ready:
        yield ready
