"""Column expressions: keys, periods, ratios, flags, scores and display text.

Every function takes and returns Columns, so it stays inside the code Spark generates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The characters Python's str.strip and \s treat as blank, as a regex class.
BLANKS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

_NUMERIC = T.DecimalType(28, 8)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- keys, periods, coercion ---------------------------------------------------------------


def trim_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Trim blanks (spaces only, as SQL ``trim``) from the named key columns."""
    return df.withColumns({c: F.trim(c) for c in cols})


def strip(c: Column | str) -> Column:
    """Remove every kind of blank from both ends, line breaks and wide spaces included."""
    return F.regexp_replace(_col(c), f"^{BLANKS}+|{BLANKS}+$", "")


def parse_year(c: Column | str, lo: int, hi: int) -> Column:
    """Four-digit label -> year inside ``[lo, hi]``; anything else is NULL, to be filtered out."""
    digits = F.regexp_extract(_col(c), f"^{BLANKS}*([0-9]{{4}}){BLANKS}*$", 1)
    year = F.nullif(digits, F.lit("")).cast("int")
    return F.when(year.between(lo, hi), year)


def coerce(df: DataFrame, schema: T.StructType, on_error: str = "raise") -> DataFrame:
    """Cast to ``schema``. ``raise`` stops on a bad value; ``quarantine`` turns it to NULL and
    flags the row in ``_bad``. The two modes read the same rows.
    """
    if on_error == "raise":
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    if on_error != "quarantine":
        raise ValueError(f"on_error must be 'raise' or 'quarantine', not {on_error!r}")
    cast = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema}
    bad = F.lit(False)
    for name, value in cast.items():
        bad = bad | (F.col(name).isNotNull() & value.isNull())
    return df.select(*[value.alias(name) for name, value in cast.items()], bad.alias("_bad"))


def stamp(df: DataFrame, label: str, at: datetime, label_col="source_label", at_col="fetched_at"):
    """One source label and one fetch time for the whole batch."""
    return df.withColumns({label_col: F.lit(label), at_col: F.lit(at)})


def project(df: DataFrame, mapping: Mapping[str, Column | str]) -> DataFrame:
    """Keep exactly ``mapping``'s columns: output name -> input name or expression."""
    return df.select(*[_col(source).alias(name) for name, source in mapping.items()])


# --- arithmetic ----------------------------------------------------------------------------


def numeric_round(c: Column | str, places: int) -> Column:
    """Round half away from zero on the decimal value, so binary noise does not decide ties."""
    return F.round(_col(c).cast(_NUMERIC), places).cast("double")


def implied_counts(value: Column | str, upper: Column | str, fraction: Column | str):
    """(eligible base, headcount the reported percentage implies), both to one decimal."""
    base = _col(upper) * _col(fraction)
    return numeric_round(base, 1), numeric_round(_col(value) / 100.0 * base, 1)


def bound_flags(value: Column | str, upper: Column | str, fraction: Column | str):
    """(above 100 %, implied headcount above the whole upper-bound population)."""
    value, upper, fraction = _col(value), _col(upper), _col(fraction)
    return value > 100.0, value / 100.0 * (upper * fraction) > upper


def population_proxy(count: Column | str, density: Column | str, scale: float = 10000) -> Column:
    """count / density x scale; NULL for density 0, so filter order cannot raise."""
    return F.try_divide(_col(count).cast("double"), _col(density)) * F.lit(float(scale))


def ratio(num: Column | str, den: Column | str) -> Column:
    return _col(num).cast("double") / _col(den)


def safe_fraction(n: Column | str, size: Column | str, places: int = 4) -> Column:
    """n / size with a missing n as 0 and a zero size as NULL."""
    n = F.coalesce(_col(n), F.lit(0)).cast("double")
    return F.round(n / F.nullif(_col(size).cast("double"), F.lit(0.0)), places)


def relative_drop(prev: Column | str, cur: Column | str, places: int = 4) -> Column:
    """(prev - cur) / prev where prev > 0, else NULL, rounded half away from zero.

    Divided in double; the quotient is first rounded to twelve digits, so that quotients of short
    decimal inputs that lie half-way round as decimals do."""
    p, c = _col(prev).cast("double"), _col(cur).cast("double")
    return F.when(p > 0, F.round(F.round((p - c) / p, 12), places))


def pct_diff(a: Column | str, b: Column | str) -> Column:
    return F.abs(_col(a) - _col(b)) / _col(b)


def floor_cap(n: Column | str, keep: int = 1) -> Column:
    """What may leave while ``keep`` stay behind; never negative."""
    return F.greatest(_col(n) - F.lit(keep), F.lit(0))


def deviation(value: Column | str, target: Column | str):
    """(signed, absolute) distance from the target."""
    gap = _col(value) - _col(target)
    return gap, F.abs(gap)


def to_integral(c: Column | str, tol: float = 1e-6) -> Column:
    """Nearest whole number; raises when the value is not whole within ``tol``."""
    c = _col(c)
    nearest = F.rint(c)
    broken = F.raise_error(F.concat(F.lit("not integral: "), c.cast("string"))).cast("bigint")
    return F.when(F.abs(c - nearest) <= tol, nearest.cast("bigint")).when(c.isNotNull(), broken)


# --- flags, score, reasons -----------------------------------------------------------------


def attrition_flags(fraction: Column | str, drop: Column | str, floor: float, limit: float):
    """(below floor, sharp drop, either). NULL means "cannot tell" and is left alone."""
    below, sharp = _col(fraction) < F.lit(floor), _col(drop) >= F.lit(limit)
    return below, sharp, below | sharp


def weighted_score(weights: Sequence[tuple[Column, int]]) -> Column:
    """Sum of weight x expression. A boolean counts 0 or 1; NULL counts 0."""
    total = F.lit(0).cast("bigint")
    for expr, weight in weights:
        total = total + F.coalesce(expr.cast("bigint"), F.lit(0).cast("bigint")) * weight
    return total


def reasons(clauses: Sequence[tuple[Column, str, Sequence[Column]]]) -> Column:
    """Join the clauses whose condition holds with ``; ``; no clause gives an empty string."""
    return F.concat_ws(
        "; ", *[F.when(cond, F.format_string(template, *args)) for cond, template, args in clauses]
    )


def plain_number(c: Column | str) -> Column:
    """A double as plain digits, without exponent and without trailing zeros."""
    text = _col(c).cast(T.DecimalType(38, 10)).cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def one_decimal(c: Column | str) -> Column:
    """A number as text with exactly one decimal."""
    return F.round(_col(c).cast(_NUMERIC), 1).cast(T.DecimalType(22, 1)).cast("string")


def check_domain(c: Column | str, allowed: Sequence) -> Column:
    """True where the value belongs to the closed list; NULL does not belong."""
    return F.coalesce(_col(c).isin(*allowed), F.lit(False))


def map_codes(c: Column | str, mapping: Mapping[int, str], default: str = "unknown_status_") -> Column:
    """Code -> label; a code outside ``mapping`` becomes ``default`` followed by the code."""
    c = _col(c)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c.cast("int")), F.concat(F.lit(default), c.cast("string")))


# --- display -------------------------------------------------------------------------------


def pct_of_max(c: Column | str, top: Column) -> Column:
    """Share of the largest value in percent to one decimal; 0 if the largest is not positive."""
    return F.when(top > 0, numeric_round(_col(c).cast("double") / top * 100, 1)).otherwise(0.0)


def fmt_yes_no(flag: Column | str) -> Column:
    return F.when(_col(flag), "yes").otherwise("no")


def fmt_percent(fraction: Column | str) -> Column:
    return F.coalesce(F.concat(one_decimal(_col(fraction) * 100), F.lit("%")), F.lit(""))


def fmt_thousands(c: Column | str) -> Column:
    return F.coalesce(F.format_number(_col(c).cast("double"), 0), F.lit(""))


def fmt_six_decimals(c: Column | str) -> Column:
    text = F.round(_col(c).cast(T.DecimalType(28, 10)), 6).cast(T.DecimalType(24, 6))
    return F.coalesce(text.cast("string"), F.lit(""))


def utc_stamp(ts: Column | str) -> Column:
    """Compact stamp, e.g. 20250131T235959Z (session time zone UTC)."""
    return F.date_format(_col(ts), "yyyyMMdd'T'HHmmss'Z'")


def utc_display(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm 'UTC'")


def unpivot_measures(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name="cadre", value="n"):
    """One row per (id, measure column)."""
    return df.unpivot(list(ids), list(cols), name, value)
