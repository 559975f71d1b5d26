"""Sequential and pair models as grouped Spark jobs.

Filters whose memory fades read as many bars as they remember (a bounded array per symbol) or blocks with a halo that long;
data-dependent filters and the hidden Markov model compose their maps block by block."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ANN, case, clamp, flag, is_true, safe_div
from ..plans import BAR_CHUNK, BLOCK_ROWS, Blocks, bar_blocks, blocked, indexed, last_rows, memory, narrow, ordered_array, row_index, spread, tail_rows, time_chunk, whole_blocks
from .hidden_markov import LABELS, hmm_fit, stored
from . import features as ft, portfolio as pf, structure as st

def trend_memory(r: float, q: float) -> int:
    """Bars the constant-velocity filter remembers: the error's factor per bar under the settled gain, and the settling itself."""
    a, b, c, steps = 1.0, 0.0, 1.0, 0
    while steps < 1_000_000:
        a, b, c = a + 2 * b + c + q * 0.25, b + c + q * 0.5, c + q
        k0, k1 = a / (a + r), b / (a + r)
        new = (1 - k0) * (1 - k0) * a + k0 * k0 * r, (1 - k0) * (b - k1 * a) + k0 * k1 * r, k1 * k1 * a - 2 * k1 * b + c + k1 * k1 * r
        steps += 1
        if steps > 1 and all(abs(x - y) <= 1e-15 * abs(y) for x, y in zip(new, old)):
            break
        a, b, c = old = new
    trace, det = (1 - k0) + (1 - k1), (1 - k0) * (1 - k1) - (1 - k0) * -k1  # of (I - K H) F
    disc = trace * trace / 4 - det
    return memory(math.sqrt(det) if disc < 0 else abs(trace) / 2 + math.sqrt(disc))


def kalman_trend(bars: DataFrame, r: float = 1e-3, q: float = 1e-5) -> DataFrame:
    """Constant-velocity filter at the last bar: level, trend, gain, one-sigma band, label.
    The filter reads as many bars as it remembers in double precision at its noise ratio (``trend_memory``): the unbroken answer."""
    t = tail_rows(narrow(bars, "symbol", "ts", "close"), ["symbol"], ["ts"], time_chunk("ts", BAR_CHUNK), trend_memory(r, q))
    arr = t.groupBy("symbol").agg(ordered_array(["close", "_rev"], "ts").alias("_a"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    d = lambda v: F.lit(float(v))
    z0 = F.col("_a")[0]["close"]
    start = F.struct(z0.alias("l"), d(0).alias("v"), d(1).alias("a"), d(0).alias("b"), d(1).alias("c"), d(0).alias("g"), d(0).alias("gs"))

    def step(s, x):
        a, b, c = s["a"] + 2 * s["b"] + s["c"] + q * 0.25, s["b"] + s["c"] + q * 0.5, s["c"] + q
        k0, k1 = a / (a + r), b / (a + r)
        y = x["close"] - s["l"] - s["v"]
        return F.struct((s["l"] + s["v"] + k0 * y).alias("l"), (s["v"] + k1 * y).alias("v"), ((1 - k0) * (1 - k0) * a + k0 * k0 * r).alias("a"),
                        ((1 - k0) * (b - k1 * a) + k0 * k1 * r).alias("b"), (k1 * k1 * a - 2 * k1 * b + c + k1 * k1 * r).alias("c"), k0.alias("g"),
                        (s["gs"] + F.when(x["_rev"] <= 20, k0).otherwise(0.0)).alias("gs"))

    x = arr.select("symbol", "n", F.element_at("_a", -1)["close"].alias("price"), F.aggregate("_a", start, step).alias("s")).select("symbol", "n", "price", "s.*")
    sig, lv = F.sqrt(F.greatest("a", F.lit(0.0))), F.greatest(F.abs("l"), F.lit(1e-9))
    x = x.withColumns({"sigma": sig, "trend_bps": F.col("v") / lv * 10000})
    b = F.col("trend_bps")
    return x.select("symbol", "price", F.col("l").alias("level"), F.col("v").alias("trend"), "trend_bps", (F.col("l") + F.col("sigma")).alias("upper_band"), (F.col("l") - F.col("sigma")).alias("lower_band"),
                    "sigma", F.col("g").alias("gain"), (F.col("gs") / F.least("n", F.lit(20))).alias("avg_gain_20"), case((b > 1, "BULLISH"), (b < -1, "BEARISH"), default="SIDEWAYS").alias("signal"))


def kalman_zscore(bars: DataFrame, trend: DataFrame | None = None) -> DataFrame:
    """trend: rows of ``kalman_trend`` over the same bars, where they are known."""
    k = kalman_trend(bars) if trend is None else trend
    z = (F.col("price") - F.col("level")) / F.greatest("sigma", F.lit(1e-9))
    k = k.withColumn("kalman_zscore", z)
    z = F.col("kalman_zscore")
    return k.select("symbol", "kalman_zscore", F.col("level").alias("kalman_level"), "price", ((F.col("price") - F.col("level")) / F.greatest("level", F.lit(1e-9)) * 100).alias("deviation_pct"),
                    case((z > 2.5, "OVERBOUGHT_SHORT"), (z > 1.5, "ELEVATED_CAUTION"), (z < -2.5, "OVERSOLD_LONG"), (z < -1.5, "DEPRESSED_WATCH"), default="NEUTRAL").alias("signal"))


def _ou_columns(a: DataFrame, last: str) -> DataFrame:
    """Ornstein-Uhlenbeck columns from regression moments (m pairs, slope, intercept icept, sxx, sxy, syy, sx: sample deviation of the lagged values)."""
    b = F.col("slope")
    ok = (b > 0) & (b < 1)
    sse = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    a = a.withColumns({"mean_reverting_b": ok, "se": F.sqrt(sse / (F.col("m") - 2)), "kappa": F.when(ok, -F.log(F.when(ok, b)))})
    a = a.withColumns({"mu": F.when(ok, F.col("icept") / (1 - F.when(ok, b))), "sigma_ou": F.col("se") / F.sqrt(F.greatest(1 - b * b, F.lit(1e-9))),
                       "half_life": F.when(ok, math.log(2) / F.greatest("kappa", F.lit(1e-9))),
                       "adf_stat": (b - 1) / F.greatest(F.col("se") / (F.col("sx") * F.sqrt(F.col("m").cast("double"))), F.lit(1e-9))})
    return a.withColumns({"ou_z": (F.col(last) - F.col("mu")) / F.greatest("sigma_ou", F.lit(1e-9)), "entry_z": F.greatest(F.lit(1.5), F.least(F.lit(2.5), 2.0 / F.greatest(F.sqrt(2 * F.col("kappa")), F.lit(1e-3))))})


def _regr(x: str, y: str) -> list[Column]:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return [F.regr_count(y, x).alias("m"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("icept"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"),
            F.regr_syy(y, x).alias("syy"), F.stddev_samp(F.when(both, F.col(x))).alias("sx")]


def ou_fit(bars: DataFrame, n: int = 60) -> DataFrame:
    """Mean-reversion fit of the last n closes by AR(1) regression; null parameters where the slope leaves (0, 1)."""
    t = last_rows(narrow(bars, "symbol", "ts", "close"), ["symbol"], ["ts"], n)
    t = t.withColumn("x", F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")))  # at most n rows
    a = t.groupBy("symbol").agg(*_regr("x", "close"), F.max_by("close", "ts").alias("price"), F.count(F.lit(1)).alias("k")).where("k >= 30")
    a = _ou_columns(a, "price")
    z, e = F.col("ou_z"), F.col("entry_z")
    sig = case((z.isNull(), "HOLD"), (z < -e, "LONG_ENTRY"), (z > e, "SHORT_ENTRY"), ((z > -0.5) & (z < 0), "LONG_COVER"), ((z < 0.5) & (z > 0), "SHORT_COVER"), default="HOLD")
    return a.select("symbol", "price", "kappa", "mu", F.when(F.col("mean_reverting_b"), F.col("sigma_ou")).alias("sigma_ou"), "half_life", "ou_z", "adf_stat",
                    is_true(F.col("mean_reverting_b") & (F.col("adf_stat") < -2.89)).alias("is_mean_reverting"), is_true(F.col("half_life").between(2, 200)).alias("profitable"), "entry_z", sig.alias("ou_signal"))


def cointegration_pairs(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hedge ratio by least squares, ADF(1) test on the residual, half-life and z-score of the spread, per requested pair.
    The two-regressor ADF regression is solved from centred sums, so everything is partial aggregation."""
    r = pf.pair_rows(bars, pairs, "close")
    ols = r.groupBy("cluster", "a", "b").agg(F.regr_slope("y", "x").alias("hedge_ratio"), F.regr_intercept("y", "x").alias("intercept"), F.count(F.lit(1)).alias("n")).where("n >= 30")
    s = r.join(ols.select("a", "b", "hedge_ratio", "intercept"), ["a", "b"]).select("cluster", "a", "b", "ts", (F.col("y") - F.col("intercept") - F.col("hedge_ratio") * F.col("x")).alias("s"))
    k = blocked(s, ["a", "b"], ["ts"], time_chunk("ts", BAR_CHUNK), before=2)
    k = k.add(l=F.lag("s").over(k.w), l2=F.lag("s", 2).over(k.w))
    d = k.add(dy=F.col("s") - F.col("l"), d1=F.col("l") - F.col("l2")).done()
    ok = F.col("d1").isNotNull()
    v = lambda c: F.when(ok, F.col(c))
    cov = lambda p, q: F.covar_pop(v(p), v(q))
    a = d.groupBy("a", "b").agg(F.count(v("d1")).alias("q"), cov("l", "l").alias("s11"), cov("d1", "d1").alias("s22"), cov("l", "d1").alias("s12"), cov("l", "dy").alias("s1y"), cov("d1", "dy").alias("s2y"), cov("dy", "dy").alias("s00"),
                                *_regr("l", "s"), F.max_by("s", "ts").alias("spread"), F.avg("s").alias("ms"), F.stddev_samp("s").alias("spread_std"))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    a = a.withColumns({"psi": (F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")) / det, "phi": (F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12")) / det, "inv": F.col("s22") / (det * F.col("q"))})
    sse = F.greatest((F.col("s00") - F.col("psi") * F.col("s1y") - F.col("phi") * F.col("s2y")) * F.col("q"), F.lit(0.0))
    a = a.withColumn("adf", F.col("psi") / F.greatest(F.sqrt(F.greatest(sse / (F.col("q") - 3) * F.col("inv"), F.lit(1e-12))), F.lit(1e-12)))
    a = _ou_columns(a, "spread").withColumn("spread_mean", F.coalesce("mu", "ms"))
    a = a.withColumn("zscore", (F.col("spread") - F.col("spread_mean")) / F.greatest("spread_std", F.lit(1e-9)))
    z = F.col("zscore")
    return a.join(ols, ["a", "b"]).select("a", "b", "n", "hedge_ratio", F.round("intercept", 5).alias("intercept"), F.col("adf").alias("adf_statistic"), (F.col("adf") < -3.34).alias("is_cointegrated"), "spread", "spread_mean", "spread_std", "zscore",
                                          F.coalesce("half_life", F.lit(9999.0)).alias("half_life"),
                                          case((z < -2, "LONG_SPREAD"), (z > 2, "SHORT_SPREAD"), ((z > -0.5) & (z < 0), "EXIT_LONG"), ((z > 0) & (z < 0.5), "EXIT_SHORT"), default="HOLD").alias("signal"))


def _hedge_maps(q: float, r: float):
    """Block -> one filtering element (A, b, C, eta, J): what the block does to any start mean and covariance. Elements of steps combine
    associatively without losing either direction of the state, which products of transition matrices would."""

    def compose(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("_i")
        eye = np.eye(2)
        A, b, C, e, J = eye, np.zeros(2), np.zeros((2, 2)), np.zeros(2), np.zeros((2, 2))
        for x, y in zip(pdf["x"].tolist(), pdf["y"].tolist()):
            h = np.array([x, 1.0])
            s = max(q * (x * x + 1) + r, 1e-9)
            k = q * h / s
            A2 = eye - np.outer(k, h)
            J2 = np.outer(h, h) / s
            D = A2 @ np.linalg.inv(eye + C @ J2)
            B = A.T @ np.linalg.inv(eye + J2 @ C)
            e, J = B @ (h * y / s - J2 @ b) + e, B @ J2 @ A + J
            A, b, C = D @ A, D @ (b + C @ (h * y / s)) + k * y, D @ C @ A2.T + q * A2
        return pd.DataFrame({"a": pdf["a"].iloc[:1], "b": pdf["b"].iloc[:1], "_b": pdf["_b"].iloc[:1], "m": [np.concatenate([A.ravel(), b, C.ravel(), e, J.ravel()]).tolist()]})

    return compose


def _hedge_start(pdf):
    """Mean and covariance after all blocks of a pair but the last."""
    import numpy as np
    import pandas as pd

    m, P, eye = np.array([1.0, 0.0]), np.eye(2), np.eye(2)
    for v in pdf.sort_values("_b")["m"]:
        v = np.asarray(v)
        A, b, C, e, J = v[:4].reshape(2, 2), v[4:6], v[6:10].reshape(2, 2), v[10:12], v[12:].reshape(2, 2)
        D = A @ np.linalg.inv(eye + P @ J)
        m, P = D @ (m + P @ e) + b, D @ P @ A.T + C
        P = (P + P.T) / 2
    return pd.DataFrame({"a": pdf["a"].iloc[:1], "b": pdf["b"].iloc[:1], "start": [[m[0], m[1], P[0, 0], P[0, 1], P[1, 1]]]})


def _hedge_end(q: float, r: float, last: int):
    """The filter itself over a pair's last block."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("_i")
        be, al, p, o, w = (float(v) for v in pdf["start"].iloc[0])
        spreads = []
        for x, y in zip(pdf["x"].tolist(), pdf["y"].tolist()):
            p, w = p + q, w + q
            hp, ho = x * p + o, x * o + w
            sv = max(x * hp + ho + r, 1e-9)
            k0, k1 = hp / sv, ho / sv
            e = y - x * be - al
            be, al = be + k0 * e, al + k1 * e
            a0, a1, c0, c1 = 1 - k0 * x, -k0, -k1 * x, 1 - k1
            u0, u1, v0, v1 = a0 * p + a1 * o, a0 * o + a1 * w, c0 * p + c1 * o, c0 * o + c1 * w
            p, o, w = u0 * a0 + u1 * a1 + r * k0 * k0, u0 * c0 + u1 * c1 + r * k0 * k1, v0 * c0 + v1 * c1 + r * k1 * k1
            spreads.append(y - be * x - al)
        spreads = spreads[-last:]
        sd = float(np.std(spreads, ddof=1))
        return pd.DataFrame({"a": pdf["a"].iloc[:1], "b": pdf["b"].iloc[:1], "be": [be], "al": [al], "spread": [spreads[-1]], "sd": [sd], "z": [(spreads[-1] - float(np.mean(spreads))) / max(sd, 1e-9)]})

    return run


def kalman_hedge(bars: DataFrame, pairs: DataFrame, r: float = 1e-3, q: float = 1e-4, rows: int = 8192, last: int = 20) -> DataFrame:
    """Time-varying hedge ratio y = beta x + alpha over all common bars of each pair, and the z-score of the spread over its ``last`` bars.

    Every block of ``rows`` bars becomes one small filtering element, a pair folds its elements, and only its last block is filtered bar by bar."""
    b = blocked(pf.pair_rows(bars, pairs, "close").select("a", "b", "ts", "x", "y"), ["a", "b"], ["ts"], time_chunk("ts", BAR_CHUNK), rows=rows)
    d = b.df.where("_n >= 20").select("a", "b", "_b", "_i", "x", "y", F.floor((F.col("_n") - last) / b.rows).cast("long").alias("_end"))
    maps = spread(d.where("_b < _end"), "a", "b", "_b").groupBy("a", "b", "_b").applyInPandas(_hedge_maps(q, r), "a string, b string, _b long, m array<double>")
    starts = maps.groupBy("a", "b").applyInPandas(_hedge_start, "a string, b string, start array<double>")
    tail = d.where("_b >= _end").join(starts, ["a", "b"], "left").withColumn("start", F.coalesce("start", F.array(*[F.lit(v) for v in (1.0, 0.0, 1.0, 0.0, 1.0)])))
    x = tail.groupBy("a", "b").applyInPandas(_hedge_end(q, r, last), "a string, b string, be double, al double, spread double, sd double, z double")
    return x.select("a", "b", F.col("be").alias("beta"), F.col("al").alias("alpha"), "spread", F.col("sd").alias("spread_std"), F.col("z").alias("spread_zscore"),
                    case((F.col("z") < -2, "LONG_SPREAD"), (F.col("z") > 2, "SHORT_SPREAD"), default="HOLD").alias("signal"))


# Regime names, daily mean and deviation in percent, and the transition matrix (rows: from).
REGIMES = ["BULL_TREND", "SIDEWAYS_CHOP", "BEAR_TREND", "CRISIS_VOL"]
REGIME_MU = [0.15, 0.00, -0.15, -0.50]
REGIME_SD = [0.80, 0.60, 0.90, 2.50]
REGIME_A = [[0.88, 0.08, 0.03, 0.01], [0.10, 0.78, 0.10, 0.02], [0.04, 0.12, 0.80, 0.04], [0.05, 0.10, 0.25, 0.60]]


def _bayes_step(p, r):
    """Hamilton filter update of four probabilities with a return in percent."""
    prior = [F.greatest(x, F.lit(1e-9)) for x in p]
    post = []
    for k in range(4):
        pred = sum((REGIME_A[j][k] * prior[j] for j in range(1, 4)), REGIME_A[0][k] * prior[0])
        z = (r - REGIME_MU[k]) / REGIME_SD[k]
        post.append(F.greatest(pred * F.exp(-z * z / 2) / (REGIME_SD[k] / 100 * math.sqrt(2 * math.pi)), F.lit(1e-9)))
    tot = post[0] + post[1] + post[2] + post[3]
    return [x / tot for x in post]


def _regime_of(p) -> Column:
    top = F.greatest(*p)
    return case(*[(p[k] == top, REGIMES[k]) for k in range(4)])


def _whole_returns(bars: DataFrame) -> DataFrame:
    """The close before (prev) of series that one block holds, from the second bar on; rows stay with their series, hashed over all shuffle partitions."""
    b = Blocks(spread(bars, "symbol"), ["symbol"], BLOCK_ROWS, cut=False)
    return b.add(prev=F.lag("close").over(b.w)).df.where("_i > 0")


def bayes_history(bars: DataFrame, rows: int = 2048) -> DataFrame:
    """Posterior of the four regimes at every bar. The transition matrix contracts by at most 0.94 per bar in the projective
    metric, so a halo of 700 bars leaves less than 1e-18 of the start. A task updates several blocks side by side."""
    bars = indexed(bars, ["symbol"], ["ts"], time_chunk("ts", BAR_CHUNK))
    whole = _whole_returns(bars.where(F.col("_n") <= rows + 1).select("symbol", "_i", "ts", "close"))  # one block each: closes are sent once
    whole = whole.select("symbol", F.lit(0).cast("long").alias("_b"), "_i", F.lit(True).alias("_own"), F.unix_micros("ts").alias("at"), ((F.col("close") / F.col("prev") - 1) * 100).alias("r"))
    r = ft.return_rows(bars.where(F.col("_n") > rows + 1), "sr")
    b = bar_blocks(r.select("symbol", "ts", (F.col("r") * 100).alias("r"), "_i", "_n"), before=700, rows=rows)
    flat = [whole.sortWithinPartitions("symbol", "_i"), spread(b.df.select("symbol", "_b", "_i", "_own", F.unix_micros("ts").alias("at"), "r"), "symbol", "_b").sortWithinPartitions("symbol", "_b", "_i")]

    def posterior(frames):
        import numpy as np
        import pandas as pd

        mu, sd, a = np.array(REGIME_MU), np.array(REGIME_SD), np.array(REGIME_A)
        for blocks in whole_blocks(frames, ["symbol", "_b"]):
            size = np.array([len(x) for x in blocks])
            p, out = np.full((len(blocks), 4), 0.25), np.empty((size.max(), len(blocks), 4))
            x = np.zeros((size.max(), len(blocks)))
            for i, f in enumerate(blocks):
                x[:len(f), i] = f["r"]
            for t in range(len(x)):
                z = (x[t][:, None] - mu) / sd
                p = np.maximum(np.maximum(p, 1e-9) @ a * np.exp(-z * z / 2) / (sd / 100 * math.sqrt(2 * math.pi)), 1e-9)
                p /= p.sum(1, keepdims=True)
                out[t] = p
            for i, f in enumerate(blocks):
                own = f["_own"].to_numpy()
                yield pd.DataFrame({"symbol": f["symbol"][own], "at": f["at"][own], **{f"p{k}": out[:len(f), i, k][own] for k in range(4)}})

    h, more = (f.mapInPandas(posterior, "symbol string, at long, " + ", ".join(f"p{k} double" for k in range(4))) for f in flat)
    h = h.unionByName(more)
    return h.select("symbol", F.timestamp_micros("at").alias("ts"), *[f"p{k}" for k in range(4)])


def bayes_regime(bars: DataFrame) -> DataFrame:
    """Regime after a neutral update of the last posterior, its entropy, how many earlier bars carried it, and the size multiplier."""
    h = bayes_history(bars)
    p = [F.col(f"p{k}") for k in range(4)]
    h = h.withColumn("label", _regime_of(p))
    cnt = h.groupBy("symbol").agg(F.max_by(F.struct("p0", "p1", "p2", "p3", "label"), "ts").alias("l"), *[F.count(F.when(F.col("label") == g, 1)).alias(f"n{k}") for k, g in enumerate(REGIMES)])
    x = cnt.select("symbol", *[F.col(f"n{k}") for k in range(4)], F.col("l.label").alias("last_label"), *[v.alias(f"q{k}") for k, v in enumerate(_bayes_step([F.col(f"l.p{k}") for k in range(4)], F.lit(0.0)))])
    q = [F.col(f"q{k}") for k in range(4)]
    x = x.withColumn("current_regime", _regime_of(q))
    c = F.col("current_regime")
    ent = -sum((v * F.log(v + 1e-12) for v in q[1:]), q[0] * F.log(q[0] + 1e-12))
    same = case(*[(c == g, F.col(f"n{k}")) for k, g in enumerate(REGIMES)])
    return x.select("symbol", "current_regime", *[v.alias(f"prob_{g.lower()}") for v, g in zip(q, REGIMES)], (F.greatest(*q) * 100).alias("confidence_pct"), (ent / math.log(4) * 100).alias("uncertainty_pct"),
                    (same - F.when(F.col("last_label") == c, 1).otherwise(0) + 1).alias("persistence"),
                    case((c == "BULL_TREND", 1.2), (c == "BEAR_TREND", 0.5), (c == "CRISIS_VOL", 0.0), default=0.8).alias("sizing_multiplier"))


GARCH_ALPHA = [0.03, 0.05, 0.08, 0.12, 0.20]
GARCH_BETA = [0.70, 0.78, 0.85, 0.90, 0.94]


def _garch_blocks(frames, grid, each):
    """Variance recursions of all grid points over several blocks side by side. each(frames of the blocks, variances, squared residuals, own) makes the output;
    variances: (time, block, grid point)."""
    import numpy as np

    for blocks in whole_blocks(frames, ["symbol", "_b"], 1 << 15):
        top = max(map(len, blocks))
        e, own = np.zeros((top, len(blocks))), np.zeros((top, len(blocks)), bool)
        v = np.array([f["v"].iloc[0] for f in blocks])[:, None]
        for i, f in enumerate(blocks):
            e[:len(f), i], own[:len(f), i] = (f["lr"] - f["mu"]) ** 2, f["_own"]
        al, be = (np.array([f[k].iloc[0] for f in blocks])[:, None] if grid is None else np.array([g[j] for g in grid])[None, :] for j, k in enumerate(("al", "be")))
        s = np.empty((top, len(blocks), 1 if grid is None else len(grid)))
        s[0] = v
        for t in range(1, top):
            s[t] = v * (1 - al - be) + al * e[t - 1][:, None] + be * s[t - 1]
        yield each(blocks, s, e, own)


def garch_regime(bars: DataFrame, rows: int = 4096) -> DataFrame:
    """GARCH(1,1) by grid likelihood over all returns with the long-run variance as target; percentile of the current volatility ->
    regime and size multiplier. A series of up to ``rows`` returns is worked whole in one task. Of a longer one the variance keeps at most the largest beta of its
    past per bar, so blocks with a halo that long give the unbroken recursion; all grid points go side by side, and likelihoods and ranks of blocks add up."""
    bars = indexed(bars, ["symbol"], ["ts"], time_chunk("ts", BAR_CHUNK))
    grid = [(i, j) for i in GARCH_ALPHA for j in GARCH_BETA if i + j < 0.9999]
    return _garch_whole(bars.where(F.col("_n") <= rows + 1), rows, grid).unionByName(_garch_cut(bars.where(F.col("_n") > rows + 1), rows, grid))


def _garch_moments(r: DataFrame) -> DataFrame:
    return r.groupBy("symbol").agg(F.avg("lr").alias("mu"), F.var_pop("lr").alias("v"), F.count("lr").alias("n"), F.skewness("lr").alias("sk"), F.kurtosis("lr").alias("ku")).where("n >= 20")


def _garch_report(x: DataFrame) -> DataFrame:
    """x: symbol, n, sk, ku, g (al, be), cur, nll, below."""
    x = x.withColumns({"rank": F.col("below") / F.col("n") * 100.0, "jb": F.col("n") / 6 * (F.col("sk") * F.col("sk") + F.col("ku") * F.col("ku") / 4)})
    k = F.col("rank")
    return x.select("symbol", (F.sqrt("cur") * math.sqrt(ANN) * 100).alias("vol_annual_pct"), k.alias("vol_percentile"), F.col("g.al").alias("alpha"), F.col("g.be").alias("beta"), "nll",
                    case((k < 10, "ULTRA_LOW"), (k < 30, "LOW"), (k < 70, "NORMAL"), (k < 90, "HIGH"), default="CRISIS").alias("vol_regime"),
                    case((k < 10, 1.2), (k < 70, 1.0), (k < 90, 0.6), default=0.0).alias("sizing_multiplier"), (F.exp(-F.col("jb") / 2) < 0.05).alias("has_fat_tails"))


def _garch_whole(bars: DataFrame, rows: int, grid: list) -> DataFrame:
    """Series that one block holds: closes are sent once to the task of their series, which finds the likelihoods of the grid, the best point and the rank in one pass."""
    r = _whole_returns(bars.select("symbol", "_i", "close")).select("symbol", "_i", F.log(F.col("close") / F.col("prev")).alias("lr"))
    m = _garch_moments(r.select("symbol", "lr"))
    known = m.select("symbol", "mu", "v")
    flat = r.select("symbol", "_i", "lr").join(known, "symbol").select("symbol", F.lit(0).alias("_b"), F.lit(True).alias("_own"), "_i", "lr", "mu", "v").sortWithinPartitions("symbol", "_i")

    def best(frames):
        import numpy as np
        import pandas as pd

        def each(blocks, s, e, own):
            x = np.maximum(s, 1e-12)
            nll = ((np.log(x) + e[:, :, None] / x) * own[:, :, None]).sum(0) / 2
            at = np.round(nll, 6).argmin(1)  # the first of equals is the one of the least parameters
            cur = np.array([s[len(f) - 1, i, k] for i, (f, k) in enumerate(zip(blocks, at))])
            low = [int((s[:len(f), i, k] < v * (1 - 1e-12)).sum()) for i, (f, k, v) in enumerate(zip(blocks, at, cur))]
            return pd.DataFrame({"symbol": [f["symbol"].iloc[0] for f in blocks], "al": [grid[k][0] for k in at], "be": [grid[k][1] for k in at], "cur": cur, "nll": nll.min(1), "below": low})

        yield from _garch_blocks(frames, grid, each)

    x = flat.mapInPandas(best, "symbol string, al double, be double, cur double, nll double, below long")
    return _garch_report(m.join(x.select("symbol", F.struct("al", "be").alias("g"), "cur", "nll", "below"), "symbol"))


def _garch_cut(bars: DataFrame, rows: int, grid: list) -> DataFrame:
    """Longer series by blocks with halos: one pass for the likelihoods of the grid, one for the ranks of the current variance."""
    r = ft.return_rows(bars).select("symbol", "ts", F.col("r").alias("lr"), "_i", "_n")
    m = _garch_moments(r)
    b = bar_blocks(r, before=memory(max(GARCH_BETA)), rows=rows).df.select("symbol", "_b", "_i", "_own", "lr")

    def laid(known):
        return spread(b.join(known, "symbol"), "symbol", "_b").sortWithinPartitions("symbol", "_b", "_i")

    def likelihood(frames):
        import numpy as np
        import pandas as pd

        def each(blocks, s, e, own):
            x = np.maximum(s, 1e-12)
            l = ((np.log(x) + e[:, :, None] / x) * own[:, :, None]).sum(0)
            cur = np.stack([s[len(f) - 1, i] for i, f in enumerate(blocks)])
            return pd.DataFrame({"symbol": [f["symbol"].iloc[0] for f in blocks], "_b": [f["_b"].iloc[0] for f in blocks], "l": list(l), "cur": list(cur)})

        yield from _garch_blocks(frames, grid, each)

    def ranks(frames):
        import pandas as pd

        def each(blocks, s, e, own):  # rows are below by more than rounding: moments summed in another order move the last digit
            low = [(own[:len(f), i] & (s[:len(f), i, 0] < f["cur"].iloc[0] * (1 - 1e-12))).sum() for i, f in enumerate(blocks)]
            return pd.DataFrame({"symbol": [f["symbol"].iloc[0] for f in blocks], "below": low})

        yield from _garch_blocks(frames, None, each)

    g = laid(m.select("symbol", "mu", "v")).mapInPandas(likelihood, "symbol string, _b long, l array<double>, cur array<double>")
    g = g.groupBy("symbol").agg(*[F.sum(F.col("l")[k]).alias(f"l{k}") for k in range(len(grid))], F.max_by("cur", "_b").alias("cur"))
    point = F.explode(F.array(*[F.struct((F.col(f"l{k}") / 2).alias("nll"), F.col("cur")[k].alias("cur"), F.struct(F.lit(i).alias("al"), F.lit(j).alias("be")).alias("g")) for k, (i, j) in enumerate(grid)]))
    g = g.select("symbol", point.alias("p")).select("symbol", "p.*")
    best = g.groupBy("symbol").agg(F.min_by(F.struct("g", "cur", "nll"), F.struct(F.round("nll", 6), "g.al", "g.be")).alias("x"), F.min("nll").alias("nll")).select("symbol", "x.g", "x.cur", "nll")
    known = m.select("symbol", "mu", "v").join(best.select("symbol", "g.al", "g.be", "cur"), "symbol")
    low = laid(known).mapInPandas(ranks, "symbol string, below long").groupBy("symbol").agg(F.sum("below").alias("below"))
    return _garch_report(m.join(best, "symbol").join(low, "symbol"))


HAWKES_ETA = [0.05, 0.1, 0.3, 0.5, 0.7, 0.9]


def hawkes_clustering(ticks: DataFrame, window_s: float = 60.0, betas=(0.1, 0.5, 1.0, 2.0, 5.0), min_events: int = 10, rows: int = 4096) -> DataFrame:
    """Self-exciting arrival model over the last ``window_s`` seconds of each symbol: grid over branching ratio and decay with
    the base rate fixed by the event count.

    What past arrivals add to the intensity fades exponentially, so a block of arrivals is one decayed sum per decay rate; the sums of a symbol's
    blocks compose to the state in front of each block, and likelihoods and counts of blocks add up. A busy symbol is many blocks."""
    import numpy as np
    import pandas as pd

    betas, etas = [float(x) for x in betas], HAWKES_ETA
    end = ticks.groupBy("symbol").agg(F.max(F.unix_micros("ts")).alias("te"))
    t = ticks.select("symbol", F.unix_micros("ts").alias("u")).join(end, "symbol").where(F.col("u") >= F.col("te") - int(window_s * 1e6)).drop("te")
    t = row_index(t, ["symbol"], ["u"], F.floor(F.col("u") / 3_600_000_000).cast("long")).where(F.col("_n") >= min_events).withColumn("_b", F.floor(F.col("_i") / rows))
    span = t.groupBy("symbol").agg(F.min("u").alias("u0"), F.max("u").alias("te"), F.max("_n").alias("n")).withColumn("span", (F.col("te") - F.col("u0")) / 1e6).where("span > 0")
    edge = t.groupBy("symbol", "_b").agg(F.max("u").alias("last"))
    fade = [F.sum(F.exp(-x * (F.col("last") - F.col("u")) / 1e6)) for x in betas]
    sums = t.join(edge, ["symbol", "_b"]).groupBy("symbol", "_b", "last").agg(F.array(*fade).alias("c"))

    def compose(pdf):  # one short row a block
        pdf = pdf.sort_values("_b")
        last, c, be = pdf["last"].to_numpy(), np.stack(pdf["c"].to_list()), np.array(betas)
        before = np.zeros_like(c)
        for k in range(1, len(c)):
            before[k] = before[k - 1] * np.exp(-be * (last[k - 1] - (last[k - 2] if k > 1 else last[0])) / 1e6) + c[k - 1]
        return pd.DataFrame({"symbol": pdf["symbol"], "_b": pdf["_b"], "before": list(before), "prior": np.concatenate([last[:1], last[:-1]])})

    state = sums.groupBy("symbol").applyInPandas(compose, "symbol string, _b long, before array<double>, prior long")
    per = state.join(span.select("symbol", "u0", "n", "span"), "symbol")
    flat = spread(t.select("symbol", "_b", "_i", "u"), "symbol", "_b").join(per, ["symbol", "_b"])
    flat = flat.repartition("symbol", "_b").sortWithinPartitions("symbol", "_b", "_i")

    def parts(frames):
        be, et = np.array(betas), np.array(etas)
        for blocks in whole_blocks(frames, ["symbol", "_b"], 1 << 15):
            k, top = len(blocks), max(map(len, blocks))
            u, on = np.zeros((top, k)), np.zeros((top, k), bool)
            for i, f in enumerate(blocks):
                u[:len(f), i], on[:len(f), i] = (f["u"] - f["u0"]) / 1e6, True
            first = lambda c: np.array([f[c].iloc[0] for f in blocks], float)
            n, sp = first("n"), first("span")
            before = np.stack([np.asarray(f["before"].iloc[0]) for f in blocks])
            r = before * np.exp(-be * (u[0] - (first("prior") - first("u0")) / 1e6)[:, None])
            mu = (1 - et) * (n / sp)[:, None]
            l, c, final = np.zeros((k, len(et), len(be))), np.zeros((k, len(be))), np.zeros((k, len(be)))
            for j in range(top):
                if j:
                    r = (r + 1) * np.exp(-be * np.maximum(u[j] - u[j - 1], 0)[:, None])
                live = on[j]
                l[live] += np.log(np.maximum(mu[live][:, :, None] + et[None, :, None] * be * r[live][:, None, :], 1e-9))
                c[live] += 1 - np.exp(-be * (sp[live] - u[j, live])[:, None])
                final[live] = r[live]
            yield pd.DataFrame({"symbol": [f["symbol"].iloc[0] for f in blocks], "_b": [f["_b"].iloc[0] for f in blocks], "l": list(l.reshape(k, -1)), "c": list(c), "r": list(final)})

    p = flat.mapInPandas(parts, "symbol string, _b long, l array<double>, c array<double>, r array<double>")
    total = lambda c, m: F.array(*[F.sum(F.col(c)[i]) for i in range(m)])
    p = p.groupBy("symbol").agg(total("l", len(etas) * len(betas)).alias("l"), total("c", len(betas)).alias("c"), F.max_by("r", "_b").alias("r")).join(span.select("symbol", "n", "span"), "symbol")
    g = p.select("symbol", "n", "span", "l", "c", "r", F.explode(F.array(*[F.struct(F.lit(e).alias("eta"), F.lit(x).alias("beta"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i, e in enumerate(etas) for j, x in enumerate(betas)])).alias("g"))
    g = g.select("*", "g.eta", "g.beta", ((1 - F.col("g.eta")) * F.col("n") / F.col("span")).alias("mu"))
    g = g.select("symbol", "n", "span", "eta", "beta", "mu", (F.col("l")[F.col("g.i") * len(betas) + F.col("g.j")] - F.col("mu") * F.col("span") - F.col("eta") * F.col("c")[F.col("g.j")]).alias("ll"),
                 (F.col("mu") + F.col("eta") * F.col("beta") * (F.col("r")[F.col("g.j")] + 1)).alias("intensity"))
    b = g.groupBy("symbol").agg(F.max_by(F.struct("n", "span", "eta", "beta", "mu", "ll", "intensity"), F.struct(F.round("ll", 6), -F.col("eta"), -F.col("beta"))).alias("x")).select("symbol", "x.*")
    e = F.col("eta")
    return b.select("symbol", F.col("n").alias("n_events"), "mu", (e * F.col("beta")).alias("alpha"), "beta", e.alias("branching_ratio"), (1 / (1 - e)).alias("cluster_size"), "intensity", F.col("ll").alias("log_likelihood"),
                    case(((e > 0.7) & (F.col("intensity") > F.col("mu") * 3), "STRONG_MOMENTUM_FLOW"), (e > 0.5, "CLUSTERING_DETECTED"), (e < 0.2, "CALM_BACKGROUND_FLOW"), default="MODERATE_ACTIVITY").alias("signal"))


def hmm_regime(bars: DataFrame, iters: int = 80) -> DataFrame:
    """Three-state Gaussian hidden Markov model per symbol by expectation-maximisation over all its returns."""
    bars = indexed(bars, ["symbol"], ["ts"], time_chunk("ts", BAR_CHUNK))
    whole = _whole_returns(bars.where(F.col("_n").between(31, BLOCK_ROWS)).select("symbol", "_i", "close"))
    return hmm_fit(ft.return_rows(bars.where(F.col("_n") > BLOCK_ROWS)), iters, least=30, whole=whole.select("symbol", "_i", F.log(F.col("close") / F.col("prev")).alias("lr")))


def hmm_step(bars: DataFrame, stay: float = 0.9, block: int = 512) -> DataFrame:
    """One step of the model from a fixed start with sticky states, over short blocks: mean, deviation, probability now and transitions of each
    state, by rising mean."""
    d = hmm_fit(ft.return_rows(bars), 1, block, stay=stay)
    prob = F.array("prob_bearish", "prob_sideways", "prob_bullish")
    k = F.col("state")
    return d.select("symbol", "means", "vols", "transition", prob.alias("p"), F.posexplode(F.array(*[F.lit(x) for x in LABELS])).alias("state", "label")).select(
        "symbol", k.cast("long").alias("state"), "label", F.col("means")[k].alias("mean_ann_pct"), F.col("vols")[k].alias("vol_ann_pct"), F.col("p")[k].alias("probability_pct"),
        *[F.element_at("transition", 3 * k + j + 1).alias(f"to_{j}") for j in range(3)])


def regime_transitions(labels: DataFrame, history: int = 200, warn: float = 0.30, block: float = 0.55, entropy: float = 0.85, least: int = 30) -> DataFrame:
    """Transition probabilities from the current state with 0.5 smoothing over the last ``history`` labels (symbol, ts, state 0..2,
    0 = dangerous), entropy, stability, size scalar and status; symbols with fewer than ``least`` labels are left out."""
    t = last_rows(labels, ["symbol"], ["ts"], history)
    t = t.withColumn("nxt", F.lead("state").over(Window.partitionBy("symbol").orderBy("ts")))  # at most `history` rows
    cur = t.groupBy("symbol").agg(F.max_by("state", "ts").alias("cur"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= least).drop("_k")
    c = t.where("nxt is not null").groupBy("symbol", "state").agg(*[F.count(F.when(F.col("nxt") == k, 1)).alias(f"c{k}") for k in range(3)])
    x = cur.join(c.withColumnRenamed("state", "cur"), ["symbol", "cur"], "left").fillna({f"c{k}": 0 for k in range(3)})
    tot = F.col("c0") + F.col("c1") + F.col("c2") + 1.5
    x = x.withColumns({f"p{k}": (F.col(f"c{k}") + 0.5) / tot for k in range(3)})
    ent = -sum((F.col(f"p{k}") * F.log(f"p{k}") for k in (1, 2)), F.col("p0") * F.log("p0")) / math.log(3)
    x = x.withColumn("entropy_norm", ent)
    p = F.col("p0")
    return x.select("symbol", F.col("cur").alias("state"), "p0", "p1", "p2", "entropy_norm", clamp(1 - F.col("entropy_norm"), 0.0, 1.0).alias("stability"), clamp(1 - F.pow(p / 0.5, F.lit(1.5)), 0.1, 1.0).alias("size_scalar"),
                    case((p >= block, "BLOCK"), ((p >= warn) | (F.col("entropy_norm") >= entropy), "REDUCE"), default="CLEAR").alias("status"))


def regime_composite(bars: DataFrame) -> DataFrame:
    """Hidden-Markov x volatility x liquidity size multiplier."""
    x = (hmm_regime(bars).select("symbol", "current_regime").join(garch_regime(bars).select("symbol", "vol_regime", F.col("sizing_multiplier").alias("gm")), "symbol")
         .join(ft.liquidity_regime(bars).select("symbol", "liquidity_regime"), "symbol"))
    lm = case((F.col("liquidity_regime") == "STRESSED", 0.0), (F.col("liquidity_regime") == "THIN", 0.7), default=1.0)
    hm = case((F.col("current_regime") == "HIGH_VOL_BEARISH", 0.0), (F.col("current_regime") == "SIDEWAYS_CHOP", 0.6), default=1.0)
    return x.select("symbol", "current_regime", "vol_regime", "liquidity_regime", (F.least("gm", F.when(lm < 1, lm).otherwise(F.col("gm"))) * hm).alias("size_multiplier"))


def model_vote_signal(bars: DataFrame, balance: float = 30000.0, risk_pct: float = 1.0) -> DataFrame:
    """Weighted vote of eight models -> bull probability; volatility and liquidity penalties -> confidence, label, risk and levels."""
    b = bars
    trend = stored(kalman_trend(b), "kalman-trend")  # read twice, one row a symbol
    x = (hmm_regime(b).select("symbol", F.col("current_regime").alias("hmm"), (F.col("confidence_pct") / 100).alias("hc"))
         .join(bayes_regime(b).select("symbol", F.col("current_regime").alias("bay"), (F.col("confidence_pct") / 100).alias("bc"), F.col("sizing_multiplier").alias("bm")), "symbol")
         .join(garch_regime(b).select("symbol", F.col("vol_regime").alias("vr"), F.col("sizing_multiplier").alias("gm")), "symbol")
         .join(kalman_zscore(b, trend).select("symbol", "price", "kalman_zscore"), "symbol").join(trend.select("symbol", F.col("signal").alias("ks")), "symbol")
         .join(ou_fit(b).select("symbol", "ou_z", "profitable"), "symbol").join(ft.realized_vol_suite(b).select("symbol", F.col("consensus_vol_pct").alias("cv")), "symbol")
         .join(ft.momentum_factor(b).select("symbol", "momentum_signal", (F.col("momentum_quality") / 100).alias("mq")), "symbol")
         .join(ft.liquidity_regime(b).select("symbol", "liquidity_regime"), "symbol").join(st.structure_bias(b).select("symbol", "composite_bias", "bias_strength"), "symbol")
         .join(last_rows(ft.zscore_signal(b).select("symbol", "ts", "z"), ["symbol"], ["ts"], 1).select("symbol", "z"), "symbol"))
    mixed = lambda v, c: v * c + 0.5 * (1 - c)
    is_ = lambda col, **m: case(*[(F.col(col) == k, v) for k, v in m.items() if k != "other"], default=m["other"])
    prof = F.col("profitable")
    votes = [(mixed(is_("hmm", LOW_VOL_BULLISH=1.0, SIDEWAYS_CHOP=0.5, other=0.1), F.col("hc")), F.lit(0.15)), (mixed(is_("bay", BULL_TREND=1.0, SIDEWAYS_CHOP=0.5, other=0.1), F.col("bc")), F.lit(0.15)),
             (is_("vr", ULTRA_LOW=0.8, LOW=0.7, NORMAL=0.6, HIGH=0.4, CRISIS=0.1, other=0.5), F.lit(0.10)),
             (clamp(is_("ks", BULLISH=1.0, SIDEWAYS=0.5, other=0.2) - clamp(F.col("kalman_zscore") / 5, -0.3, 0.3), 0.0, 1.0), F.lit(0.12)),
             (F.when(prof, clamp(0.5 - F.col("ou_z") / 4, 0.1, 0.9)).otherwise(0.5), F.when(prof, 0.10).otherwise(0.03)),
             (mixed(is_("momentum_signal", STRONG_MOMENTUM=0.75, MODERATE_MOMENTUM=0.5, other=0.25), F.col("mq")), F.lit(0.12)),
             (is_("composite_bias", BULLISH=0.8, BEARISH=0.2, other=0.5), is_("bias_strength", VERY_STRONG=0.13, STRONG=0.10, MODERATE=0.07, WEAK=0.04, other=0.07)),
             (clamp(0.5 - F.col("z") / 5, 0.1, 0.9), F.lit(0.07))]
    x = x.withColumns({f"v{i}": v for i, (v, _) in enumerate(votes)}).withColumns({f"w{i}": w for i, (_, w) in enumerate(votes)})
    x = x.withColumn("bull", clamp(sum((F.col(f"v{i}") * F.col(f"w{i}") for i in range(8)), F.lit(0.0)) / sum((F.col(f"w{i}") for i in range(8)), F.lit(0.0)), 0.0, 1.0))
    liq_ok = F.col("liquidity_regime").isin("NORMAL", "ABUNDANT")
    size = is_("hmm", LOW_VOL_BULLISH=1.0, SIDEWAYS_CHOP=0.6, other=0.2) * F.col("bm") * F.least("gm", F.lit(1.2)) * is_("liquidity_regime", ABUNDANT=1.0, NORMAL=0.9, THIN=0.5, STRESSED=0.0, other=0.7)
    conf = clamp(F.abs(F.col("bull") - 0.5) * 200 - F.greatest(F.lit(0.0), (F.col("cv") - 40) / 100 * 20) - F.when(liq_ok, 0.0).otherwise(20.0), 0.0, 100.0)
    x = x.withColumns({"size": size, "confidence": conf, "liq_ok": liq_ok, "dv": F.col("cv") / 100 / math.sqrt(ANN)})
    p, u = F.col("bull"), F.col("price")
    dist = clamp(F.col("dv") * 2 * u, u * 0.003, u * 0.05)
    risk_on = F.col("liq_ok") & (F.col("gm") > 0) & (F.col("size") > 0.3) & (F.col("confidence") > 40)
    adj = clamp(risk_pct * F.col("size") * F.col("confidence") / 80, 0.1, risk_pct * 2)
    return x.select("symbol", case((p > 0.70, "STRONG_LONG"), (p > 0.58, "LONG"), (p < 0.30, "STRONG_SHORT"), (p < 0.42, "SHORT"), default="NEUTRAL").alias("signal"), "confidence", (p * 100).alias("bull_probability_pct"),
                    risk_on.alias("risk_on"), adj.alias("risk_pct"), (balance * adj / 100).alias("position_usd"), F.col("size").alias("size_multiplier"), u.alias("price"),
                    (u - dist).alias("stop_long"), (u + 2 * dist).alias("target_long"), (u + dist).alias("stop_short"), (u - 2 * dist).alias("target_short"))
