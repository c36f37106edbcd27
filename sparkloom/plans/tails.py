"""DuckDB expressions for tail probabilities, by series whose terms are all positive."""

from __future__ import annotations


def erf(x: str) -> str:
    """The error function of x, for x of at least 0; 1 beyond 6."""
    term = f"exp((2 * k + 1) * ln({x}) + k * 1.3862943611198906 + lgamma(k + 1) - lgamma(2 * k + 2))"
    return f"CASE WHEN {x} <= 1e-300 THEN 0::DOUBLE WHEN {x} >= 6 THEN 1::DOUBLE ELSE 1.1283791670955126 * exp(-{x} * {x}) * list_sum(list_transform(range(0, 160), lambda k: {term})) END"


def two_sided_normal(z: str) -> str:
    """p of |z|, 1 for a negative z (a continuity correction that is larger than the difference)."""
    return f"(CASE WHEN {z} <= 0 THEN 1::DOUBLE ELSE 1 - {erf(f'({z} / 1.4142135623730951)')} END)"


def incomplete_beta(a: str, b: str, x: str) -> str:
    """The regularised incomplete beta function for an x well below 1."""
    front = f"exp(lgamma({a} + {b}) - lgamma({a} + 1) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x}))"
    term = f"exp(lgamma({a} + {b} + k) - lgamma({a} + {b}) - lgamma({a} + 1 + k) + lgamma({a} + 1) + k * ln({x}))"
    return f"({front} * list_sum(list_transform(range(0, 3000), lambda k: {term})))"


def two_sided_t(t: str, dof: str) -> str:
    """p of |t|; the series runs over the smaller of dof / (dof + t ** 2) and its complement."""
    far, near = f"({dof} / ({dof} + {t} * {t}))", f"({t} * {t} / ({dof} + {t} * {t}))"
    return f"(CASE WHEN {t} IS NULL OR {t} = 0 THEN 1::DOUBLE WHEN {far} > ({dof} / 2 + 1) / ({dof} / 2 + 2.5) THEN 1 - {incomplete_beta('0.5::DOUBLE', f'({dof} / 2)', near)} ELSE {incomplete_beta(f'({dof} / 2)', '0.5::DOUBLE', far)} END)"
