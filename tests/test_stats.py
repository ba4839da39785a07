import math
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import stats


def exact(ab, a, b, n):
    if 0 in (a, b, n - a, n - b):
        return 1.0
    total = math.comb(n, b)
    return float(Fraction(sum(math.comb(a, k) * math.comb(n - a, b - k) for k in range(ab, min(a, b) + 1)), total))


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_fisher(data):
    n = data.draw(st.integers(1, 300))
    a, b = data.draw(st.integers(0, n)), data.draw(st.integers(0, n))
    ab = data.draw(st.integers(max(0, a + b - n), min(a, b)))
    assert stats.hypergeometric_tail(ab, a, b, n) == pytest.approx(exact(ab, a, b, n), rel=1e-9, abs=1e-12)


def test_fisher_deep_tail():
    assert stats.hypergeometric_tail(250, 253, 615, 1000) == pytest.approx(exact(250, 253, 615, 1000), rel=1e-9)


def test_chi_square():
    # 2x2 table 10 20 / 30 40: X2 with continuity correction, one degree of freedom
    x2 = sum((abs(o - e) - 0.5) ** 2 / e for o, e in [(10, 12), (20, 18), (30, 28), (40, 42)])
    assert stats.yates_p(10, 30, 40, 100) == pytest.approx(math.erfc(math.sqrt(x2 / 2)))
    assert stats.yates_p(0, 0, 5, 10) == 1.0
    assert stats.yates_p(5, 10, 5, 10) == 1.0


def test_scores(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0), (1e-10, 0.5), (1e-300, 0.99)], "p double, r double")
    got = [r[0] for r in df.select(stats.prediction_score(F.col("p"), F.col("r"))).collect()]
    want = [2.0, 0.0, (10 - 2500 * math.log10(0.5)) / 323 if -2500 * math.log10(0.5) < 323 else (10 + 323) / 323, (300 + 323) / 323]
    assert got == pytest.approx(want) and math.copysign(1, got[1]) == 1
    r = spark.createDataFrame([(0, 0), (1, 4)], "k long, b long").select(stats.sort_ratio(F.col("k"), F.col("b"))).collect()
    assert [x[0] for x in r] == [0.0, 0.25]


def test_unknown_test():
    with pytest.raises(ValueError):
        stats.p_value(None, None, None, None, "t-test")


def test_batches_agree_with_exact_sums():
    import random
    from fractions import Fraction
    from math import comb

    import numpy as np

    from corpusloom.functions import stats as S

    r = random.Random(3)
    tables = []
    for _ in range(300):
        n = r.choice([5, 40, 300, 900])
        a, b = r.randint(0, n), r.randint(0, n)
        tables.append((r.randint(max(0, a + b - n), min(a, b)), a, b, n))
    got = S.hypergeometric_tails(*np.array(tables).T)
    for (k, a, b, n), p in zip(tables, got):
        margin = k <= 0 or a >= n or b >= n or a <= 0 or b <= 0
        want = 1.0 if margin else float(Fraction(sum(comb(a, i) * comb(n - a, b - i) for i in range(k, min(a, b) + 1)), comb(n, b)))
        assert abs(p - want) <= 1e-9 * max(want, 1e-3)
    assert S.hypergeometric_tails(*np.zeros((4, 0), int)).tolist() == [] and S.yates_ps(*np.zeros((4, 0), int)).tolist() == []
    assert 0 < S.hypergeometric_tail(5000, 20_000, 30_000, 40_000_000) < 1e-300 or S.hypergeometric_tail(5000, 20_000, 30_000, 40_000_000) == 0.0
