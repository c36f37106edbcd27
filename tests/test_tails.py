"""Tail probabilities against an integral of the density."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sparkloom.functions.distributions import t_two_sided_p


@pytest.mark.parametrize(("t", "dof"), [(1.8745556754655015, 3066.7985942841483), (-2.03, 3000.0), (0.4, 2500.0), (2.5, 7.3)])
def test_p_of_t_at_many_degrees_of_freedom(t, dof):
    x = np.linspace(0, abs(t), 20001)
    y = (1 + x * x / dof) ** (-(dof + 1) / 2)
    within = (y.sum() - (y[0] + y[-1]) / 2) * (x[1] - x[0])
    p = 1 - 2 * within * math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    assert t_two_sided_p(t, dof) == pytest.approx(p, abs=1e-8)
