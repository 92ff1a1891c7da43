"""Log-ratio arithmetic as plain Column expressions.

A composition is a row's list of positive part columns. ``signs`` describes a sequential
binary partition: {coordinate: {part: +1 | -1}}; absent parts are 0.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six parts and the balance design of the air-quality composition.
AIR_PARTS = ["no2", "pm10", "pm25", "o3", "co", "so2"]
AIR_SIGNS = {
    "B1": {"so2": 1, "no2": -1, "pm10": -1, "pm25": -1, "o3": -1, "co": -1},
    "B2": {"no2": 1, "o3": 1, "co": 1, "pm10": -1, "pm25": -1},
    "B3": {"no2": 1, "o3": 1, "co": -1},
    "B4": {"no2": 1, "o3": -1},
    "B5": {"pm25": 1, "pm10": -1},
}

Signs = Mapping[str, Mapping[str, int]]
Basis = dict[str, dict[str, float]]


def add_all(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def log_part(part: str, zero: str = "null") -> Column:
    """ln of a part. A part that is not positive is treated as missing, or with
    ``zero="error"`` stops the job."""
    c = F.col(part)
    if zero == "error":
        bad = F.raise_error(F.lit(f"part {part} must be positive"))
        return F.when(c > 0, F.ln(c)).when(c.isNotNull(), bad.cast("double"))
    return F.when(c > 0, F.ln(c))


def closure(parts: Sequence[str], total: float = 1.0) -> dict[str, Column]:
    whole = add_all([F.col(p) for p in parts])
    return {p: F.col(p) * F.lit(total) / whole if total != 1.0 else F.try_divide(F.col(p), whole) for p in parts}


def clr(parts: Sequence[str], zero: str = "null") -> dict[str, Column]:
    logs = {p: log_part(p, zero) for p in parts}
    centre = add_all(list(logs.values())) / len(parts)
    return {p: logs[p] - centre for p in parts}


def sbp_basis(signs: Signs) -> Basis:
    """Orthonormal contrasts of a sign table: with r pluses and s minuses a plus weighs
    sqrt(s/(r(r+s))) and a minus -sqrt(r/(s(r+s))) (Egozcue & Pawlowsky-Glahn 2005)."""
    basis: Basis = {}
    for name, row in signs.items():
        plus = [p for p, s in row.items() if s > 0]
        minus = [p for p, s in row.items() if s < 0]
        r, s = len(plus), len(minus)
        if not r or not s:
            raise ValueError(f"balance {name} needs parts on both sides")
        up, down = math.sqrt(s / (r * (r + s))), -math.sqrt(r / (s * (r + s)))
        basis[name] = {**{p: up for p in plus}, **{p: down for p in minus}}
    parts = sorted({p for row in basis.values() for p in row})
    gram = basis_matrix(basis, parts).T @ basis_matrix(basis, parts)
    if not np.allclose(gram, np.eye(len(basis)), atol=1e-12):
        raise ValueError("sign table is not a sequential binary partition: contrasts are not orthonormal")
    return basis


def basis_matrix(basis: Basis, parts: Sequence[str]) -> np.ndarray:
    """Contrast matrix, one row per part and one column per coordinate."""
    return np.array([[row.get(p, 0.0) for row in basis.values()] for p in parts])


def pivot_signs(parts: Sequence[str]) -> dict[str, dict[str, int]]:
    """Pivot coordinates: part i against all the later ones."""
    return {f"z{i + 1}": {p: 1, **{q: -1 for q in parts[i + 1:]}} for i, p in enumerate(parts[:-1])}


def contrast(weights: Mapping[str, float], logs: Mapping[str, Column]) -> Column:
    return add_all([F.lit(w) * logs[p] for p, w in weights.items()])


def balances(parts: Sequence[str], signs: Signs, zero: str = "null") -> dict[str, Column]:
    """Coordinates in the basis of ``signs``. Closure cancels, so raw parts are used."""
    logs = {p: log_part(p, zero) for p in parts}
    return {name: contrast(row, logs) for name, row in sbp_basis(signs).items()}


def total(parts: Sequence[str], zero: str = "null") -> Column:
    """(1/sqrt(D)) * sum of logs of the raw, unclosed parts."""
    return add_all([log_part(p, zero) for p in parts]) * F.lit(1.0 / math.sqrt(len(parts)))


def from_balances(parts: Sequence[str], signs: Signs) -> dict[str, Column]:
    """Inverse of :func:`balances`, closed to 1; coordinate columns carry the sign names."""
    basis = sbp_basis(signs)
    raw = {p: F.exp(add_all([F.lit(row[p]) * F.col(z) for z, row in basis.items() if p in row])) for p in parts}
    whole = add_all(list(raw.values()))
    return {p: raw[p] / whole for p in parts}


def aitchison(a: Mapping[str, Column], b: Mapping[str, Column]) -> Column:
    """Distance between two compositions on the parts both observe; null when they share
    fewer than two. With l_i = ln a_i - ln b_i it is sqrt(sum l^2 - (sum l)^2 / m)."""
    diffs = [F.when((a[p] > 0) & (b[p] > 0), F.ln(a[p]) - F.ln(b[p])) for p in a]
    m = add_all([d.isNotNull().cast("int") for d in diffs])
    zero = F.lit(0.0)
    mean = F.try_divide(add_all([F.coalesce(d, zero) for d in diffs]), m)
    ss = add_all([F.coalesce((d - mean) * (d - mean), zero) for d in diffs])
    return F.when(m >= 2, F.sqrt(ss))


def to_tspace(df: DataFrame, parts: Sequence[str], signs: Signs, total_name: str | None = "Total",
              zero: str = "null") -> DataFrame:
    """Replace the parts of each row by its coordinates and total, in one projection."""
    keep = [F.col(c) for c in df.columns if c not in set(parts)]
    coords = [c.alias(n) for n, c in balances(parts, signs, zero).items()]
    extra = [total(parts, zero).alias(total_name)] if total_name else []
    return df.select(*keep, *coords, *extra)
