"""Property tests of the pure-Python pieces (no Spark)."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from softgrove.functions.columns import digamma_scalar, norm_ppf_scalar
from softgrove.operators.split import split_quotas


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(0, 20), st.integers(2, 5000), min_size=1, max_size=12),
       st.sampled_from([0.1, 0.2, 0.25, 0.3]), st.sampled_from([0.1, 0.2, 0.25]))
def test_split_quotas(counts, valid, test):
    n = sum(counts.values())
    q = split_quotas(counts, valid, test)
    n_test, n_valid = int(n * test), int(n * valid)
    assert sum(t for t, _ in q.values()) == n_test
    assert sum(v for _, v in q.values()) == n_valid
    rest = n - n_test
    for c, (t, v) in q.items():
        assert 0 <= t <= counts[c] and 0 <= v <= counts[c] - t
        assert abs(t - n_test * counts[c] / n) < 1
        assert abs(v - n_valid * (counts[c] - t) / rest) < 1


@settings(max_examples=200, deadline=None)
@given(st.floats(1e-12, 1 - 1e-12))
def test_norm_ppf_inverts_cdf(p):
    z = norm_ppf_scalar(p)
    cdf = 0.5 * math.erfc(-z / math.sqrt(2))
    assert abs(cdf - p) <= 1e-12 + 1e-9 * p


@settings(max_examples=200, deadline=None)
@given(st.floats(0.5, 1e6))
def test_digamma_recurrence(x):
    assert abs(digamma_scalar(x + 1) - digamma_scalar(x) - 1 / x) < 1e-9
