"""Risk and performance aggregates over return rows (symbol, ts, r)."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ANN, RF_DAILY, case, clamp, flag, lit, phi, safe_div, t_cdf, z_quantile
from ..plans import BAR_CHUNK, TICK_CHUNK, bar_blocks, by_length, drawdown_rows, order_stats, indexed, narrow, quantile_col, quantile_ranks, quantiles, row_index, spread, time_chunk

S = math.sqrt(ANN)
TAILS = ("var_hist", "cvar_hist", "var_cf", "cvar_cf")


def sharpe_col(mean, sd, rf: float = RF_DAILY) -> Column:
    return safe_div(mean - rf, sd) * S


def drawdowns(rets: DataFrame) -> DataFrame:
    return (drawdown_rows(narrow(rets, "symbol", "ts", "r"), ["symbol"], ["ts"], time_chunk("ts", BAR_CHUNK), "r")
            .withColumn("dd", F.col("cum") / F.col("peak") - 1))


def max_drawdown(rets: DataFrame) -> DataFrame:
    return drawdowns(rets).groupBy("symbol").agg(F.min("dd").alias("max_drawdown"))


def sharpe(rets: DataFrame) -> DataFrame:
    a = rets.groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"))
    return a.select("symbol", F.when(F.col("n") < 2, 0.0).otherwise(sharpe_col(F.col("m"), F.col("sd"))).alias("sharpe"))


def moments(rets: DataFrame) -> DataFrame:
    return rets.groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("mu"), F.stddev_pop("r").alias("sg"),
                                      F.skewness("r").alias("sk"), F.kurtosis("r").alias("ku"))


def cf_quantile(z: float) -> Column:
    """Cornish-Fisher quantile from columns sk and ku."""
    sk, ku = F.col("sk"), F.col("ku")
    return F.lit(z) + (z**2 - 1) / 6 * sk + (z**3 - 3 * z) / 24 * ku - (2 * z**3 - 5 * z) / 36 * sk * sk


def _tails(rets: DataFrame, confs: list[float], probs: dict[str, float] | None = None, method: str = "order", lone: bool = False) -> DataFrame:
    """``var_cvar`` at each level (columns end in its place) and quantiles: one selection of all order statistics, one pass over the tails."""
    ranks, refs, sums, out = {}, [], [], []
    for j, conf in enumerate(confs):
        alpha, z = 1 - conf, z_quantile(1 - conf)
        if method == "percentile":
            ranks |= quantile_ranks({f"vh{j}": alpha})
            refs += [quantile_col(f"vh{j}", alpha).alias(f"vh{j}"), F.lit(None).cast("long").alias(f"k{j}")]
        else:
            ranks[f"vh{j}"] = lambda n, alpha=alpha: F.greatest(F.lit(0), F.floor(n * alpha) - 1)
            refs += [f"vh{j}", F.greatest(F.lit(1), F.floor(F.col("_n") * alpha)).alias(f"k{j}")]
        refs.append(F.when(F.col("sg") < 1e-12, F.lit(None)).otherwise(F.col("mu") + cf_quantile(z) * F.col("sg")).alias(f"cf{j}"))
        r, v, cf = F.col("r"), F.col(f"vh{j}"), F.col(f"cf{j}")
        sums += [F.first(f"vh{j}").alias(f"vh{j}"), F.first(f"cf{j}").alias(f"cf{j}"), F.first(f"k{j}").alias(f"k{j}"),
                 F.coalesce(F.sum(F.when(r < v, r)), F.lit(0.0)).alias(f"sl{j}"), F.count(F.when(r < v, 1)).alias(f"nl{j}"),
                 F.avg(F.when(r <= v, r)).alias(f"ml{j}"), F.avg(F.when(r <= cf, r)).alias(f"mc{j}")]
        cv = F.when(F.col(f"k{j}").isNull(), F.col(f"ml{j}")).otherwise((F.col(f"sl{j}") + (F.col(f"k{j}") - F.col(f"nl{j}")) * F.col(f"vh{j}")) / F.col(f"k{j}"))
        out += [F.col(f"vh{j}").alias(f"var_hist_{j}"), cv.alias(f"cvar_hist_{j}"), F.coalesce(f"cf{j}", f"vh{j}").alias(f"var_cf_{j}"),
                F.when(F.col(f"cf{j}").isNull(), cv).otherwise(F.coalesce(f"mc{j}", f"cf{j}")).alias(f"cvar_cf_{j}")]
    probs = probs or {}
    ranks |= quantile_ranks(probs)
    st = order_stats(rets, ["symbol"], "r", ranks, lone=lone)
    ref = st.join(moments(rets).where("n >= 10"), "symbol").select("symbol", *refs, *[quantile_col(name, p).alias(name) for name, p in probs.items()])
    a = rets.select("symbol", "r").join(ref, "symbol").groupBy("symbol").agg(*sums, *[F.first(name).alias(name) for name in probs])
    return a.select("symbol", *out, *probs)


def var_cvar(rets: DataFrame, conf: float = 0.95, method: str = "order") -> DataFrame:
    """Historical VaR (order statistic floor(alpha n) - 1, or percentile), its CVaR, and the Cornish-Fisher pair."""
    return by_length(rets, lambda r, lone: _tails(r, [conf], method=method, lone=lone)).toDF("symbol", *TAILS)


def quant_metrics(rets: DataFrame, ddof: int = 0) -> DataFrame:
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    r = F.col("r")
    a = rets.groupBy("symbol").agg(
        F.count("r").alias("n"), (sd("r") * S).alias("vol"), (F.avg("r") * ANN).alias("mu"), F.count(F.when(r < 0, 1)).alias("dn"),
        (sd(F.when(r < 0, r)) * S).alias("dv"), F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("up"),
        F.abs(F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0))).alias("down"), F.skewness("r").alias("skewness"), F.kurtosis("r").alias("excess_kurtosis"))
    a = a.where("n >= 10").join(max_drawdown(rets), "symbol").join(var_cvar(rets), "symbol")
    a = a.withColumn("sortino", safe_div("mu", F.when(F.col("dn") > 1, F.col("dv")).otherwise(F.col("vol"))))
    so = F.col("sortino")
    return a.select("symbol", (F.col("vol") * 100).alias("volatility_pct"), "sortino", (F.col("max_drawdown") * 100).alias("max_drawdown_pct"),
                    (F.col("mu") * 100).alias("ann_return_pct"), safe_div("mu", F.abs("max_drawdown")).alias("calmar"),
                    *[(F.col(k) * 100).alias(k + "_pct") for k in ("var_hist", "cvar_hist", "var_cf", "cvar_cf")], "skewness", "excess_kurtosis",
                    (F.col("excess_kurtosis") > 3).alias("fat_tail"), safe_div("up", "down", 9999.0).alias("omega"),
                    case((so > 0.5, "BULLISH"), (so < -0.2, "BEARISH"), default="NEUTRAL").alias("action"))


def advanced_risk(rets: DataFrame) -> DataFrame:
    """Tail measures at 95 and 99 %, drawdown-at-risk, ulcer index, Sharpe in high- and low-volatility halves
    (split at the median of the 20-row deviation, over rows where it exists)."""
    return by_length(rets, _advanced_risk)


def _advanced_risk(rets: DataFrame, lone: bool) -> DataFrame:
    tails = _tails(rets, [0.95, 0.99], {"p95": 0.95, "p05": 0.05}, lone=lone).toDF("symbol", *[f"{k}_{c}" for c in (95, 99) for k in TAILS], "p95", "p05")
    dd = drawdowns(rets)
    cdar = quantiles(dd, ["symbol"], "dd", {"cdar_95": 0.05}, {"max_dd": F.min("dd"), "ulcer": F.sqrt(F.avg(F.col("dd") * F.col("dd")))}, lone)
    b = bar_blocks(narrow(rets, "symbol", "ts", "r"), before=19)
    rv = b.add(v=b.full(20, F.stddev_samp("r").over(b.frame(20)))).done().where("v is not null")
    half = rv.join(quantiles(rv, ["symbol"], "v", {"mv": 0.5}, lone=lone), "symbol").withColumn("hi", F.col("v") >= F.col("mv"))
    hs = half.groupBy("symbol").agg(*[f(F.when(F.col("hi") == h, F.col("r"))).alias(f"{n}{int(h)}") for h in (True, False)
                                      for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))])
    side = lambda k: F.when(F.col(f"n{k}") > 5, sharpe_col(F.col(f"m{k}"), F.col(f"s{k}"))).otherwise(0.0)
    hs = hs.select("symbol", side(1).alias("hi_vol_sharpe"), side(0).alias("lo_vol_sharpe"))
    x = tails.join(cdar, "symbol").join(hs, "symbol").join(moments(rets), "symbol")
    ku = F.col("ku")
    return x.select("symbol", *[f"{k}_{c}" for c in (95, 99) for k in TAILS], "cdar_95", "max_dd", "ulcer",
                    safe_div("p95", F.abs("p05")).alias("tail_ratio"), "hi_vol_sharpe", "lo_vol_sharpe",
                    case((ku > 5, "HIGH"), (ku > 3, "ELEVATED"), default="NORMAL").alias("tail_rating"), (F.col("sk") < -0.5).alias("negative_skew"))


LAGS = 12


def lo_adjusted_sharpe(rets: DataFrame) -> DataFrame:
    """Sharpe corrected for autocorrelation: eta = 1 + 2 sum rho_k (1 - k/(q+1)), q = min(4 (n/100)^(2/9), 12)."""
    b = bar_blocks(narrow(rets, "symbol", "ts", "r"), before=LAGS)
    d = b.add(**{f"l{k}": F.lag("r", k).over(b.w) for k in range(1, LAGS + 1)}).done()
    a = d.groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"),
                                *[F.corr("r", f"l{k}").alias(f"rho{k}") for k in range(1, LAGS + 1)])
    a = a.where("n >= 10").withColumn("q", F.least(F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))), F.lit(LAGS)))
    eta = 1 + 2 * sum((F.when((F.lit(k) <= F.col("q")) & F.col(f"rho{k}").isNotNull() & ~F.isnan(f"rho{k}"), F.col(f"rho{k}") * (1 - k / (F.col("q") + 1))).otherwise(0.0)
                       for k in range(1, LAGS + 1)), F.lit(0.0))
    a = a.withColumn("eta", F.greatest(eta, F.lit(0.05)))
    return a.select("symbol", safe_div("m", "sd").alias("_d"), "eta", F.col("q").alias("lags")).select(
        "symbol", (F.col("_d") * S).alias("raw_sharpe"), (F.col("_d") * F.sqrt(ANN / F.col("eta"))).alias("adjusted_sharpe"), "eta", "lags")


EULER = 0.5772156649


def deflated_sharpe(rets: DataFrame, n_trials: int = 25) -> DataFrame:
    """Probability that the Sharpe ratio beats the best of n_trials unskilled trials."""
    a = rets.groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"),
                                   F.skewness("r").alias("sk"), F.kurtosis("r").alias("ku")).where("n >= 10")
    a = a.withColumn("observed_sharpe", sharpe_col(F.col("m"), F.col("sd")))
    sr, n = F.col("observed_sharpe"), F.col("n")
    v = F.greatest((1 - F.col("sk") * sr + (F.col("ku") - 1) / 4 * sr * sr) / n, 1 / n)
    best = (1 - EULER) * z_quantile(1 - 1 / n_trials) + EULER * z_quantile(1 - 1 / (n_trials * math.e))
    a = a.withColumn("threshold", best * F.sqrt(v))
    a = a.withColumn("probability", t_cdf((sr - F.col("threshold")) * F.sqrt(n - 1), n - 1))
    return a.select("symbol", "observed_sharpe", "threshold", "probability", (F.col("probability") > 0.95).alias("significant"))


#: Cumulative probabilities of the Poisson(1) law, as far as a draw of 31 bits can tell.
POISSON = [sum(1 / math.factorial(j) for j in range(k + 1)) / math.e for k in range(13)]


def mix(*parts) -> Column:
    """Portable pseudo-random integer in [0, 2^31 - 1) from integer columns: two multiplicative rounds and a shift."""
    m = F.lit(2147483647)
    x = lit(0).cast("long")
    for p, k in zip(parts, (1000003, 8191, 131071)):
        x = x + lit(p).cast("long") * k
    x = F.pmod((F.pmod(x, m) + 12345) * 48271, m)
    x = x.bitwiseXOR(F.shiftright(x, 13))
    return F.pmod(x * 69621, m)


def poisson_weight(x: Column) -> Column:
    u = x / 2147483647.0
    return case(*[(u < p, float(k)) for k, p in enumerate(POISSON)], default=float(len(POISSON)))


def _mod(x):
    """x modulo the Mersenne prime 2^31 - 1, for 0 <= x < 2^61, in place."""
    import numpy as np

    m = 2147483647
    x = (x & m) + (x >> 31)
    return np.where(x >= m, x - m, x)


@functools.cache
def _poisson_table():
    """Poisson draw of a number below 2^31 by its upper 20 bits; 255 where a bound lies inside the step."""
    import numpy as np

    at = lambda x: np.searchsorted(POISSON, x / 2147483647.0, side="right")
    low = np.arange(1 << 20, dtype=np.int64) << 11
    a, b = at(low), at(low + 2047)
    return np.where(a == b, a, 255).astype(np.uint8)


def replicate_weights(keys, reps: int, seed: int):
    """Poisson(1) draws, one row per replicate and one column per key."""
    import numpy as np

    m, table = 2147483647, _poisson_table()
    rep = (np.arange(reps, dtype=np.int64) * 1000003 + seed * 131071 + 12345) % m
    key, out = np.asarray(keys, np.int64) * 8191 % m, np.empty((reps, len(keys)))
    width = max(1, 65536 // reps)
    for k in range(0, len(key), width):  # strips that stay in a cache
        base = rep[:, None] + key[None, k:k + width]
        x = _mod(base)
        x = _mod(x * 48271)
        x ^= x >> 13
        x = _mod(x * 69621)
        w = table[x >> 11]
        rare = w == 255
        if rare.any():
            w[rare] = np.searchsorted(POISSON, x[rare] / 2147483647.0, side="right")
        out[:, k:k + width] = w
    return out


def replicate_stats(df: DataFrame, group: str, key: str, values: list[str], reps: int, seed: int, finish, out: str, gather: bool = True, span: int = 512) -> DataFrame:
    """One row per group: finish(Poisson-weighted sums of `values` over its rows, an array of replicates by values) -> the columns of `out` or None. Rows draw by their
    integer `key`; all replicates of `span` rows are one matrix product.

    gather: rows of one group and one run of `span` keys meet in a task, and a group of a single run is finished there, so its replicates go nowhere; without
    it rows stay where they are. A group that several tasks hold leaves one array of sums in each, and those are added up in one place."""
    kind = df.schema[group].dataType.simpleString()
    x = df.select(F.col(group).alias("_g"), F.col(key).cast("long").alias("_k"), *[F.col(v).cast("double").alias(v) for v in values])
    if gather:
        x = x.withColumn("_run", F.floor(F.col("_k") / span).cast("long"))
        lone = x.groupBy(F.col("_g").alias("_h")).agg((F.min("_run") == F.max("_run")).alias("_lone"))
        x = x.join(lone, F.col("_g").eqNullSafe(F.col("_h"))).drop("_h")
        x = spread(x, "_g", "_run").sortWithinPartitions("_g", "_k")
    else:
        x = x.withColumn("_lone", F.lit(False))
    names = [f.strip().split()[0] for f in out.split(",")]

    def sums(batches):
        import numpy as np
        import pandas as pd

        held, total, whole = {}, {}, {}  # drawn weights, sums of the groups at hand, whether this task has all their rows

        def add(tag, rows):
            keys = rows["_k"].to_numpy()
            first, n = int(keys[0]), len(keys)
            if gather and keys[-1] - first == n - 1 and len(np.unique(keys)) == n:  # consecutive keys: groups share their draws
                if held.get("first") != first or held["n"] < n:
                    held.update(first=first, n=n, w=replicate_weights(keys, reps, seed))
                w = held["w"][:, :n]
            else:
                w = replicate_weights(keys, reps, seed)
            total[tag] = total.get(tag, 0) + w @ rows[values].to_numpy()

        def leave(tags):
            rows = []
            for tag in tags:
                t, done = total.pop(tag), None
                if whole.pop(tag):
                    done = finish(t)
                    if done is None:
                        continue
                rows.append((None if tag is MISSING else tag, None if done else t.tobytes(), *(done or [None] * len(names))))
            return pd.DataFrame(rows, columns=["_g", "_sums", *names], dtype=object)

        MISSING, pending, at = object(), [], None
        for pdf in batches:
            for tag, part in pdf.groupby("_g", sort=False, dropna=False):
                tag = MISSING if tag is None or tag != tag else tag
                if gather and pending and tag is not at and tag != at:  # sorted: the last group is complete
                    whole[at] = bool(pending[0]["_lone"].iloc[0])
                    rows = pd.concat(pending)
                    for k in range(0, len(rows), span):
                        add(at, rows.iloc[k:k + span])
                    pending.clear()
                    if len(total) >= 64:
                        yield leave(list(total))
                if gather:
                    at = tag
                    pending.append(part)
                    if sum(map(len, pending)) >= 1 << 16 and not part["_lone"].iloc[0]:
                        rows = pd.concat(pending)
                        for k in range(0, len(rows), span):
                            add(at, rows.iloc[k:k + span])
                        pending.clear()
                        whole[at] = False
                else:
                    whole[tag] = False
                    for k in range(0, len(part), span):
                        add(tag, part.iloc[k:k + span])
            if not gather and len(total) >= 64:
                yield leave(list(total))
        if pending:
            whole[at] = bool(pending[0]["_lone"].iloc[0])
            rows = pd.concat(pending)
            for k in range(0, len(rows), span):
                add(at, rows.iloc[k:k + span])
        if total:
            yield leave(list(total))

    def merge(batches):
        import numpy as np
        import pandas as pd

        at, total = None, None

        def closed():
            done = finish(total)
            return pd.DataFrame([(at, *done)] if done else [], columns=["_g", *names], dtype=object)

        for pdf in batches:
            ready = pdf[pdf["_sums"].isna()]
            if len(ready):
                yield ready[["_g", *names]]
            for tag, blob in pdf.loc[pdf["_sums"].notna(), ["_g", "_sums"]].itertuples(index=False):
                if total is not None and tag != at:
                    yield closed()
                    total = None
                t = np.frombuffer(blob, np.float64).reshape(reps, len(values))
                at, total = tag, t if total is None else total + t
        if total is not None:
            yield closed()

    part = x.mapInPandas(sums, f"_g {kind}, _sums binary, {out}")
    part = spread(part, "_g").sortWithinPartitions("_g")
    return part.mapInPandas(merge, f"_g {kind}, {out}").withColumnRenamed("_g", group)


def block_bootstrap_sharpe(rets: DataFrame, reps: int = 10_000, block: int = 10, seed: int = 42) -> DataFrame:
    """Block bootstrap of the Sharpe ratio. Blocks of consecutive rows are reduced to (n, sum, sum of squares);
    each replicate weighs every block by an independent Poisson(1) draw."""
    d = indexed(narrow(rets, "symbol", "ts", "r"), ["symbol"], ["ts"], time_chunk("ts", BAR_CHUNK))
    b = d.groupBy("symbol", F.floor(F.col("_i") / block).cast("long").alias("blk")).agg(
        F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss"))

    def finish(t):
        import numpy as np

        n, s, ss = t[t[:, 0] > 1].T
        if not len(n):
            return None
        m = s / n
        sd = np.sqrt(np.maximum((ss - n * m * m) / (n - 1), 0.0))
        sr = np.where(np.abs(sd) > 1e-12, (m - RF_DAILY) / np.where(np.abs(sd) > 1e-12, sd, 1.0), 0.0) * S
        lo, hi = np.quantile(sr, [0.025, 0.975])
        return [float(v) for v in (sr.mean(), lo, hi, (sr > 0).mean() * 100, (sr > 1).mean() * 100)]

    return replicate_stats(b, "symbol", "blk", ["n", "s", "ss"], reps, seed, finish, "bootstrap_mean double, ci_lower double, ci_upper double, prob_positive_pct double, prob_above_1_pct double")


STRETCHES, LANES, WIDTH, PACK = 8, 16, 1_024, 64  # tasks a strategy, rows and columns of draws composed together, blocks shipped in one row
MERSENNE = 2147483647


def _segments(blocks: int, reps: int, seed: int):
    """Where each replicate's draws lie in the one cycle that they all follow, and the stretches of it that no replicate starts or ends in.

    Slot j of replicate r hashes r * 1000003 + j * 8191 + seed * 131071 modulo a prime, so a replicate walks the cycle of all residues in steps of 8191 and
    its path is a window of that cycle. Windows overlap as they grow: the cycle has 2^31 - 1 draws, however many the replicates make together.
    Returns starts and lengths of the segments, and per replicate its first segment and their number (they follow each other cyclically)."""
    import numpy as np

    m = MERSENNE
    if blocks > m:
        raise ValueError("a strategy of more than 2^31 - 1 blocks")
    back = pow(8191, -1, m)
    start = np.array([(r * 1000003 + seed * 131071) % m * back % m for r in range(reps)], np.int64)
    end = (start + blocks) % m
    at = np.unique(np.concatenate([start, end]))
    length = np.diff(at, append=at[0] + m)
    first = np.searchsorted(at, start)
    number = (np.searchsorted(at, end) - first) % len(at)
    number[number == 0] = len(at)  # the whole cycle
    cover = np.zeros(2 * len(at) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + number, -1)
    cover = np.cumsum(cover)[:-1]
    used = (cover[:len(at)] + cover[len(at):]) > 0
    return at, length, used, first, number


def _joined(a, b):
    """The path a followed by the path b, each as sum of log returns, highest and lowest point, deepest fall."""
    import numpy as np

    s, h, l, f = a
    return s + b[0], np.maximum(h, s + b[1]), np.minimum(l, s + b[2]), np.minimum(np.minimum(f, b[3]), s + b[2] - h)


EMPTY = (0.0, -math.inf, math.inf, 0.0)


def _fold(s, h, l, f):
    """Paths along the last axis of four arrays, joined."""
    import numpy as np

    level = np.cumsum(s, axis=-1)
    before = level - s
    high = np.maximum.accumulate(before + h, axis=-1)
    before += l
    fall = (before[..., 1:] - high[..., :-1]).min(axis=-1, initial=math.inf)
    return level[..., -1], high[..., -1], before.min(axis=-1), np.minimum(f.min(axis=-1), fall)


def _drawn(table, start, length):
    """Each segment's path: the blocks that its draws take, in order. Draws are made and joined in tiles of WIDTH, LANES tiles at once; the table's last row is
    the empty path, which fills a segment's last tile."""
    import numpy as np

    m, n = MERSENNE, len(table) - 1
    tiles = -(-length // WIDTH)
    last = np.cumsum(tiles)
    steps = (np.arange(WIDTH, dtype=np.int64) * (8191 * 48271 % m) % m).astype(np.uint32)
    out = [np.full(len(start), v) for v in EMPTY]
    for lo in range(0, int(last[-1]) if len(last) else 0, LANES):
        tile = np.arange(lo, min(lo + LANES, int(last[-1])))
        seg = np.searchsorted(last, tile, side="right")
        skip = (tile - (last[seg] - tiles[seg])) * WIDTH
        first = ((start[seg] + skip) % m * 8191 % m + 12345) * 48271 % m
        x = first.astype(np.uint32)[:, None] + steps
        x = np.minimum(x, x - np.uint32(m))  # one subtraction at most; below zero it wraps
        z = (x ^ (x >> np.uint32(13))).astype(np.uint64) * np.uint64(69621)
        x = ((z & np.uint64(m)) + (z >> np.uint64(31))).astype(np.uint32)
        x = np.minimum(x, x - np.uint32(m))
        pick = (x - x // np.uint32(n) * np.uint32(n)).astype(np.int64)
        short = np.flatnonzero(length[seg] - skip < WIDTH)
        for k in short.tolist():
            pick[k, length[seg[k]] - skip[k]:] = n
        x = table.take(pick, axis=0, mode="clip")
        row = _fold(*(np.ascontiguousarray(x[..., k]) for k in range(4)))
        cut = np.flatnonzero(np.diff(seg, prepend=-1))
        for k, e in zip(cut.tolist(), [*cut[1:].tolist(), len(seg)]):
            g = seg[k]
            for v, w in zip(out, _joined(tuple(v[g] for v in out), _fold(*(v[k:e] for v in row)))):
                v[g] = w
    return out


def block_bootstrap_trades(trades: DataFrame, reps: int = 10_000, block: int = 5, ruin: float = -0.25, seed: int = 42,
                           stake: float = 1.0) -> DataFrame:
    """Resampled equity per strategy (``stake``: share of equity in each trade): quantiles of terminal return and maximum drawdown, ruin share.
    Slot j of a replicate takes the block drawn for it. A block is reduced once to its sum of log returns, highest point, lowest point and
    deepest fall, which compose along the slots. Draws that replicates share are composed once (``_segments``): a task composes the segments of a stretch of
    the draws and holds the reduced blocks of one strategy, then each replicate joins its segments."""
    import pandas as pd

    t = trades.select("strategy", "trade_id", "exit_ts", F.log1p(F.col("net_pnl_pct") / 100 * stake).alias("lr"))
    d = row_index(t, ["strategy"], ["exit_ts", "trade_id"], time_chunk("exit_ts", TICK_CHUNK))
    d = d.groupBy("strategy", F.floor(F.col("_i") / block).cast("long").alias("blk")).agg(F.sort_array(F.collect_list(F.struct("_i", "lr"))).alias("x"))
    inf = F.lit(float("inf"))
    start = F.struct(F.lit(0.0).alias("s"), (-inf).alias("h"), inf.alias("l"), F.lit(0.0).alias("f"))

    def step(a, r):
        c = a["s"] + r["lr"]
        return F.struct(c.alias("s"), F.greatest(a["h"], c).alias("h"), F.least(a["l"], c).alias("l"), F.least(a["f"], c - F.greatest(a["h"], c)).alias("f"))

    d = d.select("strategy", "blk", F.aggregate(F.filter("x", lambda r: r["lr"].isNotNull()), start, step).alias("x")).select("strategy", "blk", "x.*")
    d = d.groupBy("strategy", F.floor(F.col("blk") / PACK).alias("pack")).agg(F.sort_array(F.collect_list(F.struct("blk", "s", "h", "l", "f"))).alias("x"))
    d = d.select("strategy", "pack", *[F.col("x")[k].alias(k) for k in "shlf"])
    d = spread(d.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.lit(STRETCHES - 1)))), "strategy", "stretch").sortWithinPartitions("strategy", "stretch", "pack")

    def compose(batches):
        import numpy as np
        import pyarrow as pa

        tag, packs = None, []

        def closed():
            table = np.concatenate([*packs, [EMPTY]])
            packs.clear()
            at, length, used, *_ = _segments(len(table) - 1, reps, seed)
            mine = np.flatnonzero(used)
            past = np.cumsum(length[mine])
            mine = mine[(past - 1) * STRETCHES // past[-1] == tag[1]]  # equal shares of the draws
            own = [pa.array([tag[0]] * len(mine), batch.schema.field("strategy").type), pa.array(np.full(len(mine), len(table) - 1)), pa.array(mine)]
            return pa.RecordBatch.from_arrays([*own, *map(pa.array, _drawn(table, at[mine], length[mine]))], names=["strategy", "n", "segment", *"shlf"])

        for batch in batches:
            own = list(zip(batch.column("strategy").to_pylist(), batch.column("stretch").to_pylist()))
            cut = [k for k in range(len(own)) if k == 0 or own[k] != own[k - 1]]
            for k, e in zip(cut, [*cut[1:], len(own)]):
                if packs and own[k] != tag:
                    yield closed()
                tag = own[k]
                packs.append(np.stack([batch.column(c).slice(k, e - k).flatten().to_numpy(zero_copy_only=False) for c in "shlf"], axis=-1))
        if packs:
            yield closed()

    kind = trades.schema["strategy"].dataType.simpleString()

    def replicate(key, pdf):
        import numpy as np

        at, _, _, first, number = _segments(int(pdf["n"].iloc[0]), reps, seed)
        part = np.tile(EMPTY, (len(at) + 1, 1))
        part[pdf["segment"].to_numpy()] = pdf[list("shlf")].to_numpy()
        x = tuple(np.full(reps, v) for v in EMPTY)
        for j in range(int(number.max())):
            y = part[np.where(j < number, (first + j) % len(at), len(at))]
            x = _joined(x, tuple(y[:, k] for k in range(4)))
        none = np.isinf(x[1])
        return pd.DataFrame({"strategy": key[0], "rep": np.arange(reps), "total": np.where(none, np.nan, x[0]), "fall": np.where(none, np.nan, x[3])})

    r = d.mapInArrow(compose, f"strategy {kind}, n long, segment long, s double, h double, l double, f double").groupBy("strategy").applyInPandas(replicate, f"strategy {kind}, rep long, total double, fall double")
    r = r.select("strategy", ((F.exp("total") - 1) * 100).alias("ret"), ((F.exp("fall") - 1) * 100).alias("mdd"))
    pct = lambda k, p: F.percentile(k, F.lit(p))
    return r.groupBy("strategy").agg(pct("ret", 0.05).alias("return_p5_pct"), pct("ret", 0.5).alias("return_median_pct"), pct("ret", 0.95).alias("return_p95_pct"),
                                     pct("mdd", 0.05).alias("mdd_p5_pct"), pct("mdd", 0.5).alias("mdd_median_pct"),
                                     (F.avg(flag(F.col("mdd") <= ruin * 100)) * 100).alias("ruin_pct"), (F.avg(flag(F.col("ret") > 0)) * 100).alias("prob_positive_pct"))


def bootstrap_win_rate(trades: DataFrame, reps: int = 1_000, seed: int = 42) -> DataFrame:
    """Poisson bootstrap of the win rate: every trade draws by its id in every replicate."""
    x = trades.select("strategy", "trade_id", F.coalesce((F.col("net_pnl_usd") > 0).cast("double"), F.lit(0.0)).alias("win"), F.lit(1.0).alias("n"))

    def finish(t):
        import numpy as np

        win, n = t[t[:, 1] > 0].T
        if not len(n):
            return None
        wr = win / n * 100
        return [float(wr.mean()), *map(float, np.quantile(wr, [0.025, 0.975]))]

    return replicate_stats(x, "strategy", "trade_id", ["win", "n"], reps, seed, finish, "mean_pct double, ci_lower_pct double, ci_upper_pct double", gather=False)


POWER = (z_quantile(0.95) + z_quantile(0.80)) ** 2 * 0.25
TESTS = 15 * 3 * 5
MIN_T = math.sqrt(2 * math.log(TESTS) - math.log(math.log(TESTS)))


def win_rate_significance(trades: DataFrame) -> DataFrame:
    """z and one-sided p of the win rate against one half, sample size for 80 % power, multiple-testing bound."""
    a = trades.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.avg(flag(F.col("net_pnl_usd") > 0)).alias("wr"))
    e = F.abs(F.col("wr") - 0.5)
    a = a.withColumns({"z_stat": (F.col("wr") - 0.5) / F.greatest(F.sqrt(0.25 / F.col("n")), F.lit(1e-12)),
                       "required_n": F.when(e > 0.001, F.floor(POWER / (e * e)) + 1).otherwise(99999)})
    p = 1 - phi("z_stat")
    return a.select("strategy", "n", (F.col("wr") * 100).alias("win_rate_pct"), "z_stat", p.alias("p_value"), (p < 0.05).alias("significant"), "required_n",
                    F.greatest(F.lit(0), F.col("required_n") - F.col("n")).alias("shortfall"), F.lit(MIN_T).alias("min_tstat"),
                    F.least(p * TESTS, F.lit(1.0)).alias("adjusted_p"), (F.abs("z_stat") >= MIN_T).alias("passes_correction"))


def performance_gates(rets: DataFrame, trades: DataFrame, target_sr: float = 1.5, target_mdd: float = 0.25) -> DataFrame:
    """Deployment gates per symbol and the list of the ones that fail."""
    a = rets.groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.count(F.when(F.col("r") > 0, 1)).alias("pos"))
    a = a.withColumn("sharpe", sharpe_col(F.col("m"), F.col("sd")))
    a = a.join(max_drawdown(rets), "symbol").join(lo_adjusted_sharpe(rets).select("symbol", "adjusted_sharpe"), "symbol")
    a = a.join(trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_trades")), "symbol", "left").fillna({"n_trades": 0})
    wins = F.round(F.col("pos") / F.col("n") * F.col("n_trades"))
    nt = F.greatest(F.col("n_trades"), F.lit(1))
    a = a.withColumn("p_value", 1 - phi((wins / nt - 0.5) / F.sqrt(0.25 / nt)))
    checks = [("sharpe_adj", F.col("adjusted_sharpe") >= target_sr), ("mdd_limit", -F.col("max_drawdown") <= target_mdd),
              ("significance", F.col("p_value") < 0.05), ("n_trades_200", F.col("n_trades") >= 200)]
    a = a.withColumn("blockers", F.concat_ws(",", *[F.when(~c, F.lit(n)) for n, c in checks]))
    return a.select("symbol", "sharpe", "adjusted_sharpe", (-F.col("max_drawdown") * 100).alias("max_drawdown_pct"), "p_value", "n_trades",
                    (F.col("blockers") == "").alias("all_met"), "blockers")


def strategy_report(rets: DataFrame, trades: DataFrame, n_trials: int = 25, reps: int = 10_000) -> DataFrame:
    """One row per symbol: performance, validity, risk, trade statistics, gates and verdict."""
    m = rets.groupBy("symbol").agg(F.count("r").alias("n_obs"), (F.avg("r") * ANN).alias("mu"), (F.stddev_pop("r") * S).alias("vol"),
                                   (F.avg("r") / (F.stddev_samp("r") / F.sqrt(F.count("r").cast("double")))).alias("t_stat"))
    p = F.col("net_pnl_pct")
    ts = trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_trades"), (F.avg(flag(p > 0)) * 100).alias("win_rate_pct"),
                                      safe_div(F.sum(F.when(p > 0, p)), F.abs(F.sum(F.when(p < 0, p))), 9999.0).alias("profit_factor"))
    x = (m.join(max_drawdown(rets), "symbol").join(lo_adjusted_sharpe(rets).select("symbol", "adjusted_sharpe"), "symbol")
         .join(deflated_sharpe(rets, n_trials).select("symbol", F.col("observed_sharpe").alias("sharpe"), F.col("probability").alias("dsr")), "symbol")
         .join(block_bootstrap_sharpe(rets, reps).select("symbol", "ci_lower", "ci_upper"), "symbol").join(var_cvar(rets), "symbol").join(ts, "symbol", "left"))
    mdd = -F.col("max_drawdown")
    checks = [("sharpe_adj", F.col("adjusted_sharpe") >= 1.5), ("mdd_limit", mdd <= 0.25), ("n_trades_200", F.coalesce("n_trades", F.lit(0)) >= 200), ("dsr_95", F.col("dsr") > 0.95)]
    passed = sum((F.col("_" + n).cast("int") for n, _ in checks), F.lit(0))
    x = x.withColumns({"_" + n: c for n, c in checks}).withColumn("checks_passed", passed)
    k = F.col("checks_passed")
    return x.select("symbol", "n_obs", (F.col("mu") * 100).alias("cagr_pct"), (F.col("vol") * 100).alias("volatility_pct"), "sharpe", "adjusted_sharpe",
                    safe_div("mu", mdd).alias("calmar"), (mdd * 100).alias("max_drawdown_pct"), "dsr", "ci_lower", "ci_upper", "t_stat",
                    (F.col("var_hist") * 100).alias("var_95_pct"), (F.col("cvar_hist") * 100).alias("cvar_95_pct"), "n_trades", "win_rate_pct", "profit_factor", "checks_passed",
                    F.concat_ws(",", *[F.when(~F.col("_" + n), F.lit(n)) for n, _ in checks]).alias("blockers"),
                    case((k == 4, "DEPLOY"), (k >= 2, "RESEARCH"), default="DISCARD").alias("verdict"))


def _walk_windows(rets: DataFrame, train_m: int, test_m: int) -> DataFrame:
    """Assign every return row to the windows that contain it: window k trains on [s + k test, + train] and tests on the
    next test_m months (both ends included, s = first date). Rows carry their candidate windows, so no range join is needed."""
    span = rets.groupBy("symbol").agg(F.min("ts").alias("s"), F.max("ts").alias("e"), F.count(F.lit(1)).alias("m")).where("m >= 60")
    d = narrow(rets, "symbol", "ts", "r").join(span, "symbol")
    mb = F.months_between("ts", "s")
    lo = F.greatest(F.lit(0), F.floor((mb - train_m - test_m) / test_m) - 1).cast("int")
    # limits are midnights, so days are compared: a row lies after a midnight with its own day, before one with the day that ends at or after it
    day = F.to_date("ts")
    d = d.withColumns({"_day": day, "_till": F.when(F.col("ts") == day.cast("timestamp"), day).otherwise(F.date_add(day, 1)), "_e": F.to_date("e"),
                       "k": F.explode(F.sequence(lo, F.greatest(lo, (F.floor(mb / test_m) + 1).cast("int"))))})
    k = F.col("k") * test_m
    d = d.withColumns({"t0": F.add_months("s", k.cast("int")), "t1": F.add_months("s", (k + train_m).cast("int")), "t2": F.add_months("s", (k + train_m + test_m).cast("int"))}).where("t2 <= _e")
    part = F.array_compact(F.array(F.when(F.expr("_day >= t0 and _till <= t1"), "train"), F.when(F.expr("_day >= t1 and _till <= t2"), "test")))
    return narrow(d.withColumn("part", F.explode(part)), "symbol", "k", "part", "ts", "r")


def _plain_sharpe(r: Column) -> Column:
    return F.when((F.count(r) >= 2) & (F.stddev_samp(r) > 0), F.avg(r) / F.stddev_samp(r) * S).otherwise(0.0)


def rolling_walk_forward(rets: DataFrame, train_m: int = 12, test_m: int = 3, metric=_plain_sharpe, min_degradation: float = -0.30) -> DataFrame:
    """Train / test metric per rolling window, summarised per symbol. metric: aggregate over a return column."""
    w = _walk_windows(rets, train_m, test_m)
    a = w.groupBy("symbol", "k").agg(*[x for p in ("train", "test") for x in (
        F.count(F.when(F.col("part") == p, 1)).alias(f"n_{p}"), metric(F.when(F.col("part") == p, F.col("r"))).alias(p))])
    a = a.where("n_train >= 20 and n_test >= 5")
    a = a.withColumn("deg", F.when(F.col("train") != 0, (F.col("test") - F.col("train")) / F.abs("train")).otherwise(0.0))
    s = a.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_windows"), F.count(F.when(F.col("deg") >= min_degradation, 1)).alias("n_robust"),
                                F.avg("train").alias("avg_train_sharpe"), F.avg("test").alias("avg_test_sharpe"))
    return s.withColumns({"wfe": safe_div("avg_test_sharpe", "avg_train_sharpe"),
                          "verdict": F.when(F.col("n_robust") >= F.col("n_windows") * 0.7, "ROBUST").otherwise("NOT_ROBUST")})


def vol_scaled_walk_forward(rets: DataFrame, target_vol: float = 0.12, train_m: int = 12, test_m: int = 3) -> DataFrame:
    """Walk-forward where test returns are scaled by target / training volatility (0.1 to 1.5); raw against scaled."""
    w = _walk_windows(rets, train_m, test_m)
    col = lambda p: F.when(F.col("part") == p, F.col("r"))
    a = w.groupBy("symbol", "k").agg(*[x for p in ("train", "test") for x in (F.count(col(p)).alias(f"n_{p}"), F.avg(col(p)).alias(f"m_{p}"),
                                       F.stddev_samp(col(p)).alias(f"s_{p}"), F.stddev_pop(col(p)).alias(f"p_{p}"))])
    a = a.where("n_train >= 20 and n_test >= 5").withColumn("scale", clamp(target_vol / F.greatest(F.col("p_train") * S, F.lit(1e-6)), 0.1, 1.5))
    sr = lambda m, s: F.when(s > 1e-12, (m - RF_DAILY) / s * S).otherwise(0.0)
    a = a.withColumns({"is_sharpe": sr(F.col("m_train"), F.col("s_train")), "oos_raw": sr(F.col("m_test"), F.col("s_test")),
                       "oos_scaled": sr(F.col("m_test") * F.col("scale"), F.col("s_test") * F.col("scale"))})
    t = narrow(w.where("part = 'test'"), "symbol", "k", "ts", "r")
    dd = drawdown_rows(t, ["symbol", "k"], ["ts"], time_chunk("ts", BAR_CHUNK), "r").groupBy("symbol", "k").agg(F.min(F.col("cum") / F.col("peak")).alias("_low"))
    dd = dd.select("symbol", "k", (F.col("_low") - 1).alias("mdd_raw"), "_low")  # one positive scale a window: every log fall is multiplied by it, and so is the deepest
    a = a.join(dd, ["symbol", "k"]).withColumn("mdd_scaled", F.pow("_low", "scale") - 1).withColumn("deg", safe_div(F.col("oos_raw") - F.col("is_sharpe"), F.abs("is_sharpe")) * 100)
    s = a.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_windows"), F.count(F.when(F.col("deg") >= -30, 1)).alias("n_robust"), F.avg("is_sharpe").alias("avg_is_sharpe"),
                                F.avg("oos_raw").alias("avg_oos_raw"), F.avg("oos_scaled").alias("avg_oos_scaled"),
                                F.count(F.when(F.col("oos_scaled") > F.col("oos_raw"), 1)).alias("sharpe_improved"),
                                F.count(F.when(F.abs("mdd_scaled") < F.abs("mdd_raw") - 1e-12, 1)).alias("mdd_reduced"))
    return s.withColumn("wfe", safe_div("avg_oos_raw", "avg_is_sharpe"))


def in_out_sample_split(trades: DataFrame, frac: float = 0.70, initial: float = 10000.0) -> DataFrame:
    """First part of each strategy's trades against the rest: win rate, profit factor, return, robustness."""
    t = row_index(trades.select("strategy", "entry_ts", "trade_id", "net_pnl_usd"), ["strategy"], ["entry_ts", "trade_id"], time_chunk("entry_ts", TICK_CHUNK))
    t = t.where("_n >= 10").withColumn("p", F.when(F.col("_i") < F.floor(F.col("_n") * frac), "in").otherwise("out"))
    x = F.col("net_pnl_usd")
    aggs = []
    for p in ("in", "out"):
        v = F.when(F.col("p") == p, x)
        aggs += [F.count(v).alias(f"{p}_trades"), (F.avg(F.when(F.col("p") == p, flag(x > 0))) * 100).alias(f"{p}_win_rate"),
                 safe_div(F.sum(F.when(v > 0, v)), F.abs(F.sum(F.when(v < 0, v)))).alias(f"{p}_pf"), (F.sum(v) / initial * 100).alias(f"{p}_return_pct")]
    a = t.groupBy("strategy").agg(*aggs)
    return a.withColumns({"degradation_pct": safe_div(F.col("out_win_rate") - F.col("in_win_rate"), F.col("in_win_rate")) * 100,
                          "is_robust": (F.col("out_win_rate") >= F.col("in_win_rate") * 0.7) & (F.col("out_pf") >= 1.0)})


def optimal_f(trades: DataFrame, grid: int = 100, base: float = 0.25) -> DataFrame:
    """Fraction that maximises mean ln(1 + f r / |worst|) on a grid from 0.01 to 0.99; partial sums before the shuffle."""
    r = trades.select("strategy", (F.col("net_pnl_pct") / 100).alias("r"))
    st = r.groupBy("strategy").agg(F.abs(F.min("r")).alias("worst"), F.count(F.lit(1)).alias("n")).where("n >= 10 and worst > 1e-8")
    x = r.join(st, "strategy").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    f = 0.01 + F.col("g") * (0.98 / (grid - 1))
    a = x.groupBy("strategy", "g").agg(F.avg(F.log(1 + f * F.col("r") / F.col("worst"))).alias("growth"), F.first("worst").alias("worst"))
    b = a.groupBy("strategy").agg(F.max_by("g", F.struct(F.round("growth", 12), -F.col("g"))).alias("g"), F.max("growth").alias("growth"), F.first("worst").alias("worst"))
    fb = 0.01 + F.col("g") * (0.98 / (grid - 1))
    return b.select("strategy", fb.alias("optimal_f"), (fb * base).alias("recommended"), F.col("growth").alias("log_growth"), "worst")


def lognormal_forecast(bars_rets: DataFrame, days: int = 30, conf: float = 0.95) -> DataFrame:
    """Closed-form price distribution at a horizon (bars_rets: symbol, ts, close, r)."""
    a = bars_rets.groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.max_by("close", "ts").alias("s0")).where("n >= 20")
    drift, sv, al = (F.col("mu") - F.col("sd") * F.col("sd") / 2) * days, F.col("sd") * math.sqrt(days), 1 - conf
    q = lambda p: F.exp(drift + sv * z_quantile(p))
    return a.select("symbol", F.col("s0").alias("price"), *[(F.col("s0") * q(p / 100)).alias(f"price_p{p}") for p in (5, 25, 50, 75, 95)],
                    ((F.exp(F.col("mu") * days) - 1) * 100).alias("expected_return_pct"), (phi(drift / sv) * 100).alias("prob_profit_pct"),
                    ((q(al) - 1) * 100).alias("var_pct"), ((F.exp(F.col("mu") * days) * phi(z_quantile(al) - sv) / al - 1) * 100).alias("cvar_pct"))
