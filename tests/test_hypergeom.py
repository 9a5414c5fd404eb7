import math
import random
from fractions import Fraction

import numpy as np

from corpusflow.functions.hypergeom import _log10_tail
import pandas as pd


def exact_log10(T, n, K, x):
    n = min(n, T)
    lo, hi = max(0, n + K - T), min(n, K)
    x = max(lo, min(hi, x))
    values = range(x, hi + 1) if x * T >= K * n else range(lo, x + 1)
    p = Fraction(sum(math.comb(K, k) * math.comb(T - K, n - k) for k in values), math.comb(T, n))
    return (math.log(p.numerator) - math.log(p.denominator)) / math.log(10)


def test_tail_equals_exact_fractions():
    rng = random.Random(7)
    cases = [(5000, 300, 60, 9), (5000, 300, 60, 3), (100, 100, 10, 10), (50, 30, 40, 20), (20, 7, 5, 7),
             (1000, 10, 1, 1), (1000, 10, 1, 0), (10, 3, 10, 3), (1, 1, 1, 1)]
    for _ in range(300):
        T = rng.randint(2, 3000)
        cases.append((T, rng.randint(1, T), rng.randint(1, T), rng.randint(0, 60)))
    got = _log10_tail(*(pd.Series(c) for c in zip(*cases)), enough=0.0)
    for case, value in zip(cases, got):
        assert abs(value - exact_log10(*case)) < 1e-9 * max(1, abs(value)), case


def test_large_corpus_keeps_its_digits():
    # binomial limit: T is so large that drawing is with replacement
    T, n, K, x = 10**13, 10**4, 10**10, 25
    got = _log10_tail(*(pd.Series([v]) for v in (T, n, K, x)), enough=0.0)[0]
    p = sum(
        math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                 + k * math.log(1e-3) + (n - k) * math.log1p(-1e-3))
        for k in range(x, 200)
    )
    assert abs(got - math.log10(p)) < 1e-6


def test_stop_above_threshold_never_hides_a_significant_row():
    rng = np.random.default_rng(3)
    T = pd.Series(np.full(500, 2000))
    n, K = pd.Series(rng.integers(1, 2000, 500)), pd.Series(rng.integers(1, 2000, 500))
    x = pd.Series(rng.integers(0, 100, 500))
    full = _log10_tail(T, n, K, x, enough=0.0)
    early = _log10_tail(T, n, K, x, enough=math.log(0.05))
    hit = full <= math.log10(0.05)
    assert np.allclose(full[hit], early[hit])
    assert (early[~hit] > math.log10(0.05)).all()
