import datetime as dt
import itertools
import random

import numpy as np
import pytest

from kronolit.operators.segments import factor_at, optimal_partition, scale_segments


@pytest.mark.parametrize("seed", range(20))
def test_partition_is_optimal(seed):
    r = random.Random(seed)
    n = r.randint(1, 8)
    y = np.array([r.choice([0.0, 1.0, 3.0]) + r.gauss(0, 0.2) for _ in range(n)])
    w = np.array([r.uniform(0.5, 2) for _ in range(n)])

    def cost(starts):
        c = -1.3
        for i, j in zip(starts, [*starts[1:], n], strict=True):
            m = np.average(y[i:j], weights=w[i:j])
            c += float((w[i:j] * (y[i:j] - m) ** 2).sum()) + 1.3
        return c

    best = min(cost([0, *c]) for k in range(n) for c in itertools.combinations(range(1, n), k))
    assert cost(optimal_partition(y, w, 1.3)) == pytest.approx(best)


def test_segments_and_factors(spark):
    d = lambda m: dt.date(2020 + (m - 1) // 12, (m - 1) % 12 + 1, 5)
    rows = [("a", d(m), (1.2 if m < 9 else 1.0) * x) for m in range(1, 20) for x in (0.99, 1.0, 1.01)] + [("b", d(1), 2.0), ("b", None, 3.0), (None, d(1), 3.0), ("b", d(2), -1.0), ("b", d(2), None), ("b", d(2), float("nan"))]
    seg = scale_segments(spark.createDataFrame(rows, "k string, day date, r double"), "k", "day", "r")
    got = sorted((x["k"], x["start"], x["end"], round(x["factor"], 3), x["n"]) for x in seg.collect())
    assert got == [("a", d(1), d(8), 1.2, 24), ("a", d(9), d(19), 1.0, 33), ("b", d(1), d(1), 2.0, 1)]
    points = spark.createDataFrame([(1, "a", d(3)), (2, "a", dt.date(2019, 1, 1)), (3, "a", dt.date(2030, 1, 1)), (4, "z", d(1)), (5, "a", None), (6, None, d(1)), (7, "a", dt.date(2020, 8, 20))], "i int, k string, day date")
    assert {x["i"]: round(x["factor"], 3) for x in factor_at(points, seg, "k", "day").collect()} == {1: 1.2, 2: 1.2, 3: 1.0, 4: 1.0, 5: 1.0, 6: 1.0, 7: 1.2}
    assert scale_segments(spark.createDataFrame([], "k string, day date, r double"), "k", "day", "r").count() == 0
