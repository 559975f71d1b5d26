"""Models on long series: blocks give the unbroken recursion, for settings far from the defaults too."""

import math

import numpy as np
import pandas as pd
import pytest

from marketloom.operators import features, hidden_markov, models
from marketloom.operators.hidden_markov import hmm_fit


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x = 100 + np.cumsum(rng.normal(0, 0.5, n))
    y = 2.5 * x + 4 + np.cumsum(rng.normal(0, 0.2, n))
    ts = pd.date_range("2000-01-01", periods=n, freq="D")
    pdf = pd.concat([pd.DataFrame({"symbol": s, "ts": ts, "open": v, "high": v, "low": v, "close": v, "volume": 1.0}) for s, v in (("A", x), ("B", y))])
    return x, y, spark.createDataFrame(pdf).repartition(4).cache()


def hedge(x, y, r, q):
    m, p, out = np.array([1.0, 0.0]), np.eye(2), []
    for a, b in zip(x, y):
        h = np.array([a, 1.0])
        p = p + q * np.eye(2)
        s = h @ p @ h + r
        k = p @ h / s
        m = m + k * (b - h @ m)
        g = np.eye(2) - np.outer(k, h)
        p = g @ p @ g.T + r * np.outer(k, k)
        out.append(b - h @ m)
    return m, out


@pytest.mark.parametrize("r, q", [(1e-3, 1e-4), (0.5, 1e-9)])
def test_kalman_hedge_over_blocks(spark, walks, r, q):
    x, y, bars = walks
    pairs = spark.createDataFrame([("g", "A", "B")], "cluster string, a string, b string")
    got = models.kalman_hedge(bars, pairs, r, q, rows=700).first()
    m, spreads = hedge(x, y, r, q)
    assert got.beta == pytest.approx(m[0], rel=1e-6) and got.alpha == pytest.approx(m[1], rel=1e-5, abs=1e-6)
    assert got.spread == pytest.approx(spreads[-1], abs=1e-6) and got.spread_std == pytest.approx(np.std(spreads[-20:], ddof=1), rel=1e-5)


@pytest.mark.parametrize("r, q", [(1e-3, 1e-5), (1e-3, 1e-9)])
def test_kalman_trend_is_the_unbroken_filter(walks, r, q):
    x, _, bars = walks
    got = models.kalman_trend(bars, r, q).where("symbol = 'A'").first()
    l, v, a, b, c = x[0], 0.0, 1.0, 0.0, 1.0
    for i, z in enumerate(x):
        a, b, c = a + 2 * b + c + q * 0.25, b + c + q * 0.5, c + q
        k0, k1 = a / (a + r), b / (a + r)
        e = z - l - v
        l, v = l + v + k0 * e, v + k1 * e
        a, b, c = (1 - k0) * (1 - k0) * a + k0 * k0 * r, (1 - k0) * (b - k1 * a) + k0 * k1 * r, k1 * k1 * a - 2 * k1 * b + c + k1 * k1 * r
    assert got.level == pytest.approx(l, rel=1e-10) and got.trend == pytest.approx(v, rel=1e-7, abs=1e-10) and got.gain == pytest.approx(k0, rel=1e-9)


def test_last_emas_for_a_long_span(walks):
    x, _, bars = walks
    got = features.last_emas(bars, (20, 400)).where("symbol = 'A'").first()
    for span in (20, 400):
        e = x[0]
        for v in x[1:]:
            e += 2 / (span + 1) * (v - e)
        assert got[f"ema{span}"] == pytest.approx(e, rel=1e-12)


def test_garch_blocks_agree(walks):
    _, _, bars = walks
    small, whole = (models.garch_regime(bars, rows=n).orderBy("symbol").toPandas() for n in (800, 10_000))
    for c in small.columns:
        assert all(a == b or math.isclose(a, b, rel_tol=1e-9) for a, b in zip(small[c], whole[c])), c


def test_hidden_markov_blocks_agree_with_whole_series(walks):
    _, _, bars = walks
    r = features.return_rows(bars)
    small, whole = (hmm_fit(r, 4, block=n, stay=0.8).orderBy("symbol").toPandas() for n in (700, 100_000))
    assert len(small) == len(whole) > 0
    for c in small.columns:
        for a, b in zip(small[c], whole[c]):
            np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9) if c in ("means", "vols", "transition") or c.startswith(("prob", "conf")) else np.testing.assert_array_equal(a, b)


def test_hidden_markov_model_of_a_long_series(spark):
    rng = np.random.default_rng(4)
    state = np.repeat(rng.integers(0, 3, 2_000), 100)
    r = rng.normal(np.array([-0.02, 0.0, 0.02])[state], np.array([0.02, 0.01, 0.01])[state])
    at = pd.Timestamp("2000-01-01") + pd.to_timedelta(np.arange(len(r)), unit="h")
    df = spark.createDataFrame(pd.DataFrame({"symbol": "LONG", "ts": at, "r": r}))
    got = hmm_fit(df, 3, block=32_768, stay=0.9).first()
    assert got["means"][0] < -200 < got["means"][1] < 200 < got["means"][2] and min(got["transition"][k] for k in (0, 4, 8)) > 0.9
    assert len(got["history"]) == 60 and got["current_regime"] == hidden_markov.LABELS[state[-1]]


def test_arrival_model_over_blocks(spark):
    """Many arrivals of one symbol, with equal times: blocks of any size give one answer, that of the plain recursion."""
    rng = np.random.default_rng(9)
    u = np.sort(rng.integers(0, 50_000_000, 6_000))
    u[100:105] = u[100]
    ticks = spark.createDataFrame(pd.DataFrame({"symbol": "BUSY", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(u), unit="us"), "seq": range(6_000)}))
    small, whole = (models.hawkes_clustering(ticks, rows=n).first().asDict() for n in (37, 100_000))
    assert all(a == b or math.isclose(a, b, rel_tol=1e-9) for a, b in zip(small.values(), whole.values()))
    t = (np.sort(u) - u.min()) / 1e6
    e, be, n = whole["branching_ratio"], whole["beta"], len(t)
    mu, r, ll = (1 - e) * n / t[-1], 0.0, 0.0
    for i, x in enumerate(t):
        r = (r + 1) * math.exp(-be * (x - t[i - 1])) if i else 0.0
        ll += math.log(mu + e * be * r) - e * (1 - math.exp(-be * (t[-1] - x)))
    assert whole["log_likelihood"] == pytest.approx(ll - mu * t[-1], rel=1e-9) and whole["n_events"] == n


def test_memory_refuses_endless_filters():
    with pytest.raises(ValueError):
        models.trend_memory(1.0, 1e-30)


def test_short_series_are_sent_once(spark, walks, monkeypatch):
    """Models over bars with positions: series that a block holds and longer ones give the same rows; the vote works the trend filter out once."""
    from marketloom import plans

    _, _, bars = walks
    stored = plans.indexed(bars, ["symbol"], ["ts"], plans.time_chunk("ts", plans.BAR_CHUNK)).cache()
    seen, trend = [], models.kalman_trend
    monkeypatch.setattr(models, "kalman_trend", lambda b, *a: seen.append(b) or trend(b, *a))
    monkeypatch.setattr(models, "hmm_regime", lambda b, f=models.hmm_regime: f(b, 1))
    models.model_vote_signal(stored)
    monkeypatch.undo()
    assert len(seen) == 1
    whole = [f(stored).orderBy("symbol").toPandas() for f in (lambda b: models.hmm_regime(b, 5), models.bayes_regime, features.liquidity_regime)]
    monkeypatch.setattr(plans, "BLOCK_ROWS", 1000)
    monkeypatch.setattr(models, "BLOCK_ROWS", 1000)
    cut = [f(stored).orderBy("symbol").toPandas() for f in (lambda b: models.hmm_regime(b, 5), models.bayes_regime, features.liquidity_regime)]
    for a, b in zip(whole, cut):
        assert len(a) == len(b) == 2
        for c in a.columns:
            for x, y in zip(a[c], b[c]):
                np.testing.assert_allclose(x, y, rtol=1e-7, atol=1e-9) if isinstance(x, float) or c in ("means", "vols", "transition") else np.testing.assert_array_equal(x, y)


def test_expected_transitions_by_all_pairs():
    """Sums over time of the nine products equal the sums of the whole array of pairs, with series of unequal length."""
    rng = np.random.default_rng(2)
    size, k = np.array([9, 5, 1]), 3
    on = np.arange(9)[:, None] < size
    dens, trans = rng.uniform(0.1, 2, (9, 3, k)), rng.uniform(0.1, 1, (3, 3, k))
    trans /= trans.sum(1, keepdims=True)
    post, flow = hidden_markov.expectations(dens.copy(), on, trans, np.full((3, k), 1 / 3), np.ones((3, k)))
    for s, n in enumerate(size):
        a, b, t = np.zeros((n, 3)), np.ones((n, 3)), trans[:, :, s]
        a[0] = dens[0, :, s] / 3
        for i in range(1, n):
            a[i] = a[i - 1] @ t * dens[i, :, s]
        for i in range(n - 2, -1, -1):
            b[i] = t @ (dens[i + 1, :, s] * b[i + 1])
        like = a[-1].sum()
        np.testing.assert_allclose(post[:n, :, s], a * b / like, rtol=1e-12)
        pairs = sum((a[i][:, None] * t * (dens[i + 1, :, s] * b[i + 1]) / like for i in range(n - 1)), np.zeros((3, 3)))
        np.testing.assert_allclose(flow[:, :, s], pairs, rtol=1e-12)
        assert not post[n:, :, s].any()
