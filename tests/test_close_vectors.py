"""Dot products of blocks against sums in order."""

from functools import reduce

import numpy as np

from spanveil.operators import regions


def test_products_equal_sums_in_order():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-4, 5, (60, 16)) / 10.0 for _ in range(2))  # many products of just 0.4
    order = lambda x, y: reduce(lambda t, pq: t + pq[0] * pq[1], zip(x.tolist(), y.tolist()), 0.0)  # noqa: E731  sum() compensates
    want = {(i, j) for i in range(60) for j in range(60) if order(a[i], b[j]) >= 0.4}
    assert want and set(zip(*(x.tolist() for x in regions._close(a, b, 0.4)))) == want
