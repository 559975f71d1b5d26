"""Three-state Gaussian hidden Markov model by expectation-maximisation, for series of any length.

The forward-backward pass is an associative scan: a block of returns is one 3 x 3 matrix, matrices of a series compose to the state before and
after each block, and inside a block the recursions run in NumPy, vectorised over the blocks of an Arrow batch. A series of one block does all its steps in
one task; a longer one takes a Spark pass a step, in which no task holds more than a few blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import ANN
from ..plans import BAR_CHUNK, indexed, narrow, ordered_array, quantiles, spread, time_chunk, whole_blocks
from ..session import work_dir

LABELS = ["HIGH_VOL_BEARISH", "SIDEWAYS_CHOP", "LOW_VOL_BULLISH"]  # states by rising mean
# Means and variances of a third of the returns that is empty, the least variance, the percentiles that cut the thirds.
EMPTY_MEAN, EMPTY_VAR, LEAST_VAR, CUTS = (-0.001, 0.0, 0.001), (1e-4, 5e-5, 1e-4), 1e-8, (0.33, 0.66)
HISTORY = 60  # states of the newest returns that are reported
TINY = 1e-300
BLOCK = 32_768  # returns of one series in a block
TOGETHER = 1 << 19  # returns that a task works on at a time
RESULT = ("symbol string, current_regime string, confidence_pct double, prob_bearish double, prob_sideways double, prob_bullish double, persistence int, "
          "history array<string>, means array<double>, vols array<double>, transition array<double>")
MODEL = "mu array<double>, var array<double>, trans array<double>, init array<double>"


def _total(v: np.ndarray) -> np.ndarray:
    """Sum over the states, which come before the series: whole rows are added, where a sum over a last axis of three would walk it number by number."""
    s = np.add.reduce(v, axis=-2)
    return np.maximum(s, TINY, out=s)


def _norm(v: np.ndarray) -> np.ndarray:
    return v / np.clip(v.sum(-1, keepdims=True), TINY, None)


def _last(*arrays: np.ndarray) -> list[np.ndarray]:
    """Series last."""
    return [np.ascontiguousarray(np.moveaxis(a, 0, -1)) for a in arrays]


def densities(x: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    """(time, state, series); mu and var: (state, series)"""
    d = x[:, None, :] - mu
    np.square(d, out=d)
    d *= -0.5
    d /= var
    np.exp(d, out=d)
    d /= np.sqrt(2 * np.pi * var)
    return np.maximum(d, TINY, out=d)


def padded(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Series side by side, time first, with a mask of what is real."""
    size = np.array([len(r) for r in rows])
    x = np.zeros((size.max(), len(rows)))
    for i, r in enumerate(rows):
        x[:len(r), i] = r
    return x, np.arange(len(x))[:, None] < size


def block_matrix(dens: np.ndarray, on: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Per block the product D0 (A D1) (A D2) ..., scaled: it carries a state row vector from the block's first return past its last. trans: (series, state, state)."""
    m = np.eye(3) * dens[0].T[:, None, :]
    for t in range(1, len(dens)):
        new = np.einsum("sij,sjk->sik", m, trans) * dens[t].T[:, None, :]
        m = np.where(on[t][:, None, None], new / np.clip(new.max((1, 2), keepdims=True), TINY, None), m)
    return m / np.clip(m.max((1, 2), keepdims=True), TINY, None)


def expectations(dens: np.ndarray, on: np.ndarray, trans: np.ndarray, enter: np.ndarray, leave: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities of every return (time, state, series) and the expected transitions summed over the block (state, state, series).

    trans: (state, state, series); the others (state, series). enter: state distribution before the first return is seen; leave: backward vector after the last;
    before: forward vector of the return in front of the block (zeros where there is none), so that the step into the block counts.
    A step's transitions i -> j are fwd_i trans_ij q_j over their total, q being density times backward vector. The total is q times the predicted state, so
    they are summed as nine products along time and no array of all pairs is built."""
    top, full = len(dens), on.all(1)
    fwd, pred, q = np.empty_like(dens), np.empty_like(dens), np.empty_like(dens)
    pairs = np.empty_like(trans)
    f = np.multiply(enter, dens[0], out=fwd[0])
    f /= _total(f)
    for t in range(1, top):
        np.multiply(f[:, None], trans, out=pairs)
        p = np.add.reduce(pairs, axis=0, out=pred[t])
        f = np.multiply(p, dens[t], out=fwd[t])
        f /= _total(f)
    post, back = np.empty_like(dens), np.ascontiguousarray(trans.swapaxes(0, 1))
    b = leave
    for t in range(top - 1, -1, -1):
        y = np.multiply(dens[t], b, out=q[t])
        np.multiply(fwd[t], b, out=post[t])
        if t:
            np.multiply(y[:, None], back, out=pairs)
            b = np.add.reduce(pairs, axis=0)
            b /= _total(b)
            if not full[t]:
                b = np.where(on[t], b, leave)
    post /= _total(post)[:, None, :]
    post *= on[:, None, :]
    first = q[0].copy()
    g, pred = q[1:], pred[1:]
    pred *= g
    g *= (on[1:] / _total(pred))[:, None, :]
    flow = np.stack([np.stack([(fwd[:-1, i] * g[:, j]).sum(0) for j in range(3)]) for i in range(3)]) * trans
    if before is not None:
        into = before[:, None, :] * first[None, :, :] * trans
        flow = flow + into / np.clip(into.sum((0, 1)), TINY, None)
    return post, flow


def _report(symbol: str, mu, var, trans, tail: np.ndarray) -> list:
    """tail: probabilities of the newest returns."""
    order = np.argsort(mu, kind="stable")
    own = tail[:, order]
    path, last = own.argmax(1), own[-1]
    cur = int(path[-1])
    back = np.flatnonzero(path[::-1] != cur)
    return [symbol, LABELS[cur], min(float(last[cur]), 0.95) * 100, *(last * 100).tolist(), int(back[0]) if len(back) else len(path), [LABELS[k] for k in path],
            (mu[order] * ANN * 100).tolist(), (np.sqrt(var[order] * ANN) * 100).tolist(), trans[order][:, order].ravel().tolist()]


def _groups(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of arrays, as many together as TOGETHER allows."""
    size = pdf["r"].map(len).to_numpy()
    order, at = np.argsort(size, kind="stable"), 0  # series of like length pad little
    while at < len(order):
        to = at + 1
        while to < len(order) and size[order[to]] * (to + 1 - at) <= TOGETHER:
            to += 1
        yield pdf.iloc[order[at:to]]
        at = to


def _stack(pdf: pd.DataFrame) -> tuple:
    a = lambda c, *shape: np.stack(pdf[c].map(np.asarray).to_list()).astype(float).reshape(len(pdf), *shape)
    return a("mu", 3), a("var", 3), a("trans", 3, 3), a("init", 3)


def _start(r: np.ndarray) -> tuple[list, list]:
    """Means and variances of ``_starts`` for a series that is in one task."""
    x, n = np.sort(r), len(r)
    at = [(n - 1) * p for p in CUTS]
    lo, hi = (x[int(k)] + (x[int(np.ceil(k))] - x[int(k)]) * (k - int(k)) for k in at)
    parts = [r[r <= lo], r[(r > lo) & (r < hi)], r[r >= hi]]
    return [v.mean() if len(v) else EMPTY_MEAN[k] for k, v in enumerate(parts)], [max(v.var(), LEAST_VAR) if len(v) else EMPTY_VAR[k] for k, v in enumerate(parts)]


def _fit_whole(iters: int, stay: float):
    """Start and all steps of series that are one block each."""

    def fit(frames):
        names = [f.split()[0] for f in RESULT.split(", ")]
        for pdf in (g for whole in frames if len(whole) for g in _groups(whole)):
            x, on = padded(pdf["r"].to_list())
            mu, var = _last(*(np.array(v) for v in zip(*(_start(np.asarray(r, float)) for r in pdf["r"]))))
            trans, init = np.empty((3, 3, len(pdf))), np.full((3, len(pdf)), 1 / 3)
            trans[:] = np.where(np.eye(3) > 0, stay, (1 - stay) / 2)[:, :, None]
            for _ in range(iters):
                post, flow = expectations(densities(x, mu, var), on, trans, init, np.ones((3, len(pdf))))
                init, trans = post[0].copy(), flow / _total(flow)[:, None, :]
                mass = np.maximum(post.sum(0), TINY)
                mu = (post * x[:, None, :]).sum(0) / mass
                d = x[:, None, :] - mu
                np.square(d, out=d)
                d *= post
                var = np.maximum(d.sum(0) / mass, LEAST_VAR)
            size = on.sum(0)
            yield pd.DataFrame([_report(s, mu[:, i], var[:, i], trans[:, :, i], post[max(0, size[i] - HISTORY):size[i], :, i]) for i, s in enumerate(pdf["symbol"])], columns=names)

    return fit


def _fit_rows(fit):
    """``_fit_whole`` over rows sorted by series and position."""

    def run(frames):
        for blocks in whole_blocks(frames, ["symbol"], TOGETHER):
            yield from fit([pd.DataFrame({"symbol": [f["symbol"].iloc[0] for f in blocks], "r": [f["lr"].to_numpy() for f in blocks]})])

    return run


def _matrices(frames):
    for pdf in (g for whole in frames if len(whole) for g in _groups(whole)):
        x, on = padded(pdf["r"].to_list())
        mu, var, trans, _ = _stack(pdf)
        yield pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "b": pdf["b"].to_numpy(), "m": list(block_matrix(densities(x, *_last(mu, var)), on, trans).reshape(-1, 9))})


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """State before and after each block of one series, from its blocks' matrices (nine numbers a block)."""
    pdf = pdf.sort_values("b")
    n = len(pdf)
    m, trans = np.stack(pdf["m"].to_list()).reshape(n, 3, 3), np.asarray(pdf["trans"].iloc[0]).reshape(3, 3)
    enter, before, leave = np.empty((n, 3)), np.zeros((n, 3)), np.ones((n, 3))
    enter[0] = pdf["init"].iloc[0]
    for k in range(1, n):
        before[k] = _norm(enter[k - 1] @ m[k - 1])
        enter[k] = before[k] @ trans
    for k in range(n - 2, -1, -1):
        leave[k] = _norm(trans @ (m[k + 1] @ leave[k + 1]))
    return pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "b": pdf["b"].to_numpy(), "enter": list(enter), "leave": list(leave), "before": list(before)})


def _sums(frames):
    """Expected counts of each block, and what its end says about the newest states."""
    for pdf in (g for whole in frames if len(whole) for g in _groups(whole)):
        x, on = padded(pdf["r"].to_list())
        mu, var, trans, _ = _last(*_stack(pdf))
        vec = lambda c: _last(np.stack(pdf[c].map(np.asarray).to_list()))[0]
        post, flow = expectations(densities(x, mu, var), on, trans, vec("enter"), vec("leave"), vec("before"))
        d = x[:, None, :] - mu  # deviations from the old mean, so that no digits are lost
        size = on.sum(0)
        yield pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "b": pdf["b"].to_numpy(), "w": list(post.sum(0).T), "wd": list((post * d).sum(0).T), "wdd": list((post * d * d).sum(0).T),
                            "flow": list(flow.reshape(9, -1).T), "first": list(post[0].T), "tail": [post[max(0, k - HISTORY):k, :, i].ravel() for i, k in enumerate(size)]})


def _starts(r: DataFrame, stay: float) -> DataFrame:
    """Start model per symbol: moments of the returns below, between and above the 33rd and 66th percentile, transitions with one chance to stay."""
    cut = quantiles(r, ["symbol"], "lr", {"lo": CUTS[0], "hi": CUTS[1]})
    x = F.col("lr")
    parts = [x <= F.col("lo"), (x > F.col("lo")) & (x < F.col("hi")), x >= F.col("hi")]
    a = r.join(cut, "symbol").groupBy("symbol").agg(*[F.avg(F.when(p, x)).alias(f"m{k}") for k, p in enumerate(parts)], *[F.var_pop(F.when(p, x)).alias(f"v{k}") for k, p in enumerate(parts)])
    mu = F.array(*[F.coalesce(f"m{k}", F.lit(EMPTY_MEAN[k])) for k in range(3)])
    var = F.array(*[F.coalesce(F.greatest(f"v{k}", F.lit(LEAST_VAR)), F.lit(EMPTY_VAR[k])) for k in range(3)])
    trans = [stay if k % 4 == 0 else (1 - stay) / 2 for k in range(9)]
    return a.select("symbol", mu.alias("mu"), var.alias("var"), F.array(*map(F.lit, trans)).alias("trans"), F.array(*[F.lit(1 / 3)] * 3).alias("init"))


def stored(df: DataFrame, name: str) -> DataFrame:
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fit_blocks(blocks: DataFrame, model: DataFrame, iters: int) -> DataFrame:
    """The steps of long series: one pass over the blocks for their matrices, one for the expected counts; the models are a row a series."""
    total = lambda c, n: F.array(*[F.sum(F.col(c)[k]) for k in range(n)])
    for _ in range(iters):
        known = blocks.join(model, "symbol")
        made = known.select("symbol", "b", "r", "mu", "var", "trans", "init").mapInPandas(_matrices, "symbol string, b long, m array<double>")
        state = made.join(model.select("symbol", "trans", "init"), "symbol").groupBy("symbol").applyInPandas(_composed, "symbol string, b long, enter array<double>, leave array<double>, before array<double>")
        sums = known.join(state, ["symbol", "b"]).mapInPandas(_sums, "symbol string, b long, w array<double>, wd array<double>, wdd array<double>, flow array<double>, first array<double>, tail array<double>")
        s = sums.groupBy("symbol").agg(total("w", 3).alias("w"), total("wd", 3).alias("wd"), total("wdd", 3).alias("wdd"), total("flow", 9).alias("flow"), F.min_by("first", "b").alias("init"), F.max_by("tail", "b").alias("tail"))
        x = s.join(model.select("symbol", F.col("mu").alias("old")), "symbol")
        mass = lambda k: F.greatest(F.col("w")[k], F.lit(TINY))
        shift = [F.col("wd")[k] / mass(k) for k in range(3)]
        row = lambda k: F.greatest(sum((F.col("flow")[3 * (k // 3) + j] for j in (1, 2)), F.col("flow")[3 * (k // 3)]), F.lit(TINY))
        model = x.select("symbol", F.array(*[F.col("old")[k] + shift[k] for k in range(3)]).alias("mu"), F.array(*[F.greatest(F.col("wdd")[k] / mass(k) - shift[k] * shift[k], F.lit(LEAST_VAR)) for k in range(3)]).alias("var"),
                         F.array(*[F.col("flow")[k] / row(k) for k in range(9)]).alias("trans"), "init", "tail")
        model = stored(model, "hmm-step")
    names = [f.split()[0] for f in RESULT.split(", ")]

    def report(frames):
        for pdf in frames:
            mu, var, trans, _ = _stack(pdf)
            yield pd.DataFrame([_report(s, mu[i], var[i], trans[i], np.asarray(t).reshape(-1, 3)) for i, (s, t) in enumerate(zip(pdf["symbol"], pdf["tail"]))], columns=names)

    return model.mapInPandas(report, RESULT)


def hmm_fit(r: DataFrame, iters: int = 80, block: int = BLOCK, least: int = 30, stay: float = 1 / 3, whole: DataFrame | None = None) -> DataFrame:
    """One row per symbol with `least` returns or more (r: symbol, ts, r, no nulls): state now, its probabilities, how long it has held, the newest states, annualised
    means and deviations and the transition matrix in order of the means. A series longer than `block` is never in one task as a whole.
    whole: returns (symbol, _i, lr) of further series, each of `least` to `block` rows, whose rows are together already, so that they are not sent again."""
    r = indexed(narrow(r, "symbol", "ts", F.col("r").alias("lr")), ["symbol"], ["ts"], time_chunk("ts", BAR_CHUNK)).where(F.col("_n") >= least)
    last = F.greatest(F.lit(0), F.floor((F.col("_n") - HISTORY) / block))  # the last block holds the whole history
    b = F.when(F.col("_n") <= block, 0).otherwise(F.least(F.floor(F.col("_i") / block), last)).cast("long")
    r = stored(r.select("symbol", "_i", "lr", b.alias("b"), (F.col("_n") > block).alias("long")), "hmm-returns")
    laid = lambda rows: rows.groupBy("symbol", "b").agg(F.transform(ordered_array(["lr"]), lambda x: x["lr"]).alias("r"))
    out = laid(spread(r.where("not long"), "symbol")).mapInPandas(_fit_whole(iters, stay), RESULT)  # rows are sent once, to the task of their series
    if whole is not None:
        out = out.union(whole.sortWithinPartitions("symbol", "_i").mapInPandas(_fit_rows(_fit_whole(iters, stay)), RESULT))
    if r.where("long").isEmpty():
        return out
    model = stored(_starts(r.where("long"), stay), "hmm-start")
    long = stored(laid(spread(r.where("long"), "symbol", "b")), "hmm-blocks")
    return out.union(_fit_blocks(long, model, iters))
