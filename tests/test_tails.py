import math
import random

import pytest

from strandex.functions.tails import chi2_sf, f_sf, normal_isf

# Published (F, df1, df2, p) of result lists.
PUBLISHED = [
    (3.130797599653553, 50, 4199, 1.304793485253112e-12),
    (11.024082580225109, 5, 2170, 1.678167081508087e-10),
    (4.170485857109979, 50, 2022, 5.812452442863711e-20),
    (20.75585676527893, 50, 8744, 1.984974510227533e-173),
    (8.510279874663242, 5, 4649, 4.9538906118934484e-08),
    (2.252522796024456, 50, 3700, 1.3178425150890654e-06),
    (9.118006405841726, 5, 8603, 1.1601259496539853e-08),
    (4.100234877224867, 50, 5266, 3.611076948879528e-20),
    (8.428565054663736, 5, 2593, 6.381324890619898e-08),
]


@pytest.mark.parametrize("f,df1,df2,p", PUBLISHED)
def test_published_tails(f, df1, df2, p):
    assert f_sf(f, df1, df2) == pytest.approx(p, rel=1e-10)


def test_f_tail_identities():
    assert f_sf(0, 3, 4) == 1 and f_sf(math.inf, 3, 4) == 0 and math.isnan(f_sf(math.nan, 1, 1))
    for df2 in (1, 7, 300):  # F(2, m) has a closed tail
        for f in (0.01, 0.7, 3.0, 50.0):
            assert f_sf(f, 2, df2) == pytest.approx((1 + 2 * f / df2) ** (-df2 / 2), rel=1e-12)
    rng = random.Random(5)
    for _ in range(200):  # P(F > f) = 1 - P(1/F > 1/f)
        a, b, f = rng.randint(1, 60), rng.randint(1, 900), rng.uniform(0.05, 4)
        assert f_sf(f, a, b) + f_sf(1 / f, b, a) == pytest.approx(1, abs=1e-12)


def test_chi2_tail():
    for x in (0.01, 1.0, 20.0, 700.0):
        assert chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert chi2_sf(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-11)
    assert chi2_sf(-1, 3) == 1 and chi2_sf(math.inf, 3) == 0


def test_normal_quantile():
    assert normal_isf(0.0) == math.inf and normal_isf(1.0) == -math.inf and math.isnan(normal_isf(math.nan))
    assert normal_isf(0.5 * math.erfc(3 / math.sqrt(2))) == pytest.approx(3, rel=1e-12)
    assert normal_isf(1e-170) > 27
