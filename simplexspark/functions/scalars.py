"""Scalar column helpers: dates, text repair, codes, numeric tests. All stay JVM-side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as they appear in the climate tables, season names and
# urbanisation codes.
MONTHS_ES = {
    "Enero": 1, "Febrero": 2, "Marzo": 3, "Abril": 4, "Mayo": 5, "Junio": 6, "Julio": 7,
    "Agosto": 8, "Septiembre": 9, "Octubre": 10, "Noviembre": 11, "Diciembre": 12,
}
MONTHS_CA = {
    "Gener": 1, "Febrer": 2, "Març": 3, "Abril": 4, "Maig": 5, "Juny": 6, "Juliol": 7,
    "Agost": 8, "Setembre": 9, "Octubre": 10, "Novembre": 11, "Desembre": 12,
}
SEASONS = {"Hivern": (12, 1, 2), "Primavera": (3, 4, 5), "Estiu": (6, 7, 8), "Tardor": (9, 10, 11)}
URBAN_CODES = {1: "urban", 2: "suburban", 3: "rural"}


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dmy_date(c: Column | str) -> Column:
    """Day/month/year text to a date; text that does not parse gives null."""
    return F.try_to_date(as_col(c), "d/M/yyyy")


def comma_number(c: Column | str) -> Column:
    """Number written with a decimal comma; anything else unreadable gives null."""
    return F.replace(as_col(c), F.lit(","), F.lit(".")).try_cast("double")


def restore_point(c: Column | str) -> Column:
    """Put back a decimal point lost after two digits (``4138`` -> 41.38); a value that
    still has its point is left alone."""
    return F.regexp_replace(as_col(c).cast("string"), r"^([0-9]{2})([0-9]+)$", "$1.$2").try_cast("double")


def add_months(c: Column | str, n: Column | int) -> Column:
    return F.add_months(as_col(c), n)


def strip_prefix(c: Column | str, prefix: str) -> Column:
    c = as_col(c)
    return F.trim(F.when(c.startswith(prefix), c.substr(F.lit(len(prefix) + 1), F.length(c))).otherwise(c))


def lookup(c: Column | str, mapping: Mapping, default: Column | None = None) -> Column:
    """Value map as one CASE expression; unmatched values give ``default`` (null)."""
    c = as_col(c)
    out = None
    for key, value in mapping.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out if default is None else out.otherwise(default)


def recode(c: Column | str, mapping: Mapping) -> Column:
    """Replace listed values, keep the others."""
    return lookup(c, mapping, as_col(c))


def month_number(c: Column | str, names: Mapping[str, int]) -> Column:
    return lookup(F.trim(as_col(c)), names)


def season(month: Column | str, names: Mapping[str, Sequence[int]] = SEASONS) -> Column:
    return lookup(as_col(month), {m: label for label, months in names.items() for m in months})


def category_rank(c: Column | str, levels: Sequence[str]) -> Column:
    """1-based sort rank of a value in an ordered list of levels; null outside it."""
    return lookup(c, {level: i for i, level in enumerate(levels, 1)})


def interaction(a: Column | str, b: Column | str, sep: str = "-") -> Column:
    """Combined category of two columns, labelled by value; null when either is null."""
    a, b = as_col(a), as_col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(sep, F.initcap(a), F.initcap(b)))


def decode_bits(code: Column | str, parts: Sequence[str], ok: str = "ok", unknown: str = "?") -> Column:
    """Bit string to the names of its set parts joined by ``_``."""
    code = as_col(code)
    names = [F.when(code.substr(i, 1) == "1", F.lit(p)) for i, p in enumerate(parts, 1)]
    return (F.when(code == ok, F.lit(ok)).when(code == "0" * len(parts), F.lit(unknown))
            .when(code.isNotNull(), F.concat_ws("_", *names)))


def floor_at_zero(c: Column | str) -> Column:
    """Negative to zero; null stays null (``greatest`` would turn it into zero)."""
    c = as_col(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def fixed_text(c: Column | str, digits: int) -> Column:
    """Fixed-decimals text without thousands separators; null stays null."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c))


def clamp(c: Column | str, lo: Column | float, hi: Column | float) -> Column:
    c = as_col(c)
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def scale_position(c: Column | str, lo: Column | float, hi: Column | float) -> Column:
    """Position of a clamped value on a lo..hi scale, 0 to 1; null when the scale is empty."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.try_divide(clamp(c, lo, hi) - lo, hi - lo)


def spaced(i: Column | str, lo: float, hi: float, n: int) -> Column:
    """i-th (0-based) of n evenly spaced values, both ends included."""
    return F.lit(float(lo)) + as_col(i) * F.lit((hi - lo) / (n - 1) if n > 1 else 0.0)


def month_index(year: Column | str, month: Column | str) -> Column:
    return as_col(year) * 12 + as_col(month)


def is_missing(c: Column | str) -> Column:
    c = as_col(c)
    return c.isNull() | F.isnan(c)


def nan_to_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def observed(c: Column | str) -> Column:
    """Whether a part was measured: positive and not NaN. Null, zero and negative ones count as missing everywhere."""
    return F.coalesce((as_col(c) > 0) & ~F.isnan(as_col(c)), F.lit(False))


def count_observed(cols: Sequence[str]) -> Column:
    """Number of observed parts among the columns of a row."""
    return reduce(lambda a, b: a + b, [observed(c).cast("int") for c in cols])


def row_mean(cols: Sequence[str]) -> Column:
    """Mean over the columns of a row, skipping null and NaN; null when none is left."""
    vals = [nan_to_null(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in vals])
    n = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in vals])
    return F.when(n > 0, total / n)
