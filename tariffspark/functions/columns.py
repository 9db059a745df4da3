"""Column expressions shared by the operators; all of them stay inside codegen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
HASH_RANGE = 4294967296


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """``num / den`` where the denominator is positive, else ``default``."""
    return F.when(den > 0, num / den).otherwise(F.lit(float(default)))


def safe_divide(num: Column, den: Column, fallback: float = 1.0) -> Column:
    """Divide, replacing a denominator within 1e-9 of zero by ``fallback``."""
    filled = F.coalesce(den.cast("double"), F.lit(0.0))
    return F.coalesce(num.cast("double"), F.lit(0.0)) / F.when(F.abs(filled) <= 1e-9, F.lit(float(fallback))).otherwise(filled)


def nonneg(c: Column) -> Column:
    """Null to zero, negatives to zero."""
    return F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None)).otherwise(d)


def to_number(c: Column) -> Column:
    """Lenient text to double: anything that is not a plain decimal number is null."""
    # No match is an empty text, which is no number; ``c`` stands here once, so it is computed once.
    return F.regexp_extract(F.trim(c.cast("string")), NUMBER_PATTERN, 0).try_cast("double")


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def key_text(*cols: Column) -> Column:
    """Text of a key; null keys share one group."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("__missing_group__")) for c in cols])


def key_hash(c: Column, salt: str = "") -> Column:
    """First 32 bits of md5(salt + key) as bigint: reproducible in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), c)), 1, 8), 16, 10).cast("bigint")


def key_uniform(c: Column, salt: str = "") -> Column:
    """Uniform [0, 1) number that depends only on the key."""
    return key_hash(c, salt) / F.lit(float(HASH_RANGE))


def half_open_bin(x: Column, edges: Sequence[float]) -> Column:
    """Number of edges <= x, as one sum of comparisons (null stays null)."""
    if not edges:
        return F.when(x.isNotNull(), F.lit(0))
    return reduce(lambda a, b: a + b, [(x >= F.lit(float(e))).cast("int") for e in edges])


def right_closed_bin(x: Column, edges: Sequence[float]) -> Column:
    """Number of edges < x, so that a bin includes its right edge."""
    if not edges:
        return F.when(x.isNotNull(), F.lit(0))
    return reduce(lambda a, b: a + b, [(x > F.lit(float(e))).cast("int") for e in edges])


def fixed_label(x: Column, edges: Sequence[float], labels: Sequence[str], missing: str = "unknown") -> Column:
    """Right-closed labelled bins; the last label takes what is above every edge."""
    out = F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(missing))
    for edge, label in zip(edges, labels):
        out = out.when(x <= F.lit(float(edge)), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def clean_numeric_like(c: Column, column: str) -> Column:
    """Numeric text with stray spaces to a double.

    A car year that lost its century digit to a separator ("1 98", "2 00")
    becomes 1998 or 2000; tokens for "no value" and other text become null.
    """
    text = c.cast("string")
    has_separator = F.coalesce(text.rlike("[\\u00a0\\s]"), F.lit(False))
    compact = F.trim(F.translate(text, "\u00a0 ", ""))
    if column == "car_year":
        century = F.when(F.substring(compact, 1, 1) == "1", F.lit("9")).otherwise(F.lit("0"))
        expanded = F.concat(F.substring(compact, 1, 1), century, F.substring(compact, 2, 2))
        compact = F.when(has_separator & compact.rlike("^[12][0-9]{2}$"), expanded).otherwise(compact)
    return to_number(compact)


def number_as_text(x: Column) -> Column:
    """Whole numbers without a fraction part, others in general format."""
    whole = F.abs(x - F.rint(x)) <= 1e-9
    general = F.regexp_replace(F.format_string("%.6g", x), r"(\.[0-9]*?)0+$", "$1")
    text = F.when(whole, F.rint(x).cast("bigint").cast("string")).otherwise(F.regexp_replace(general, r"\.$", ""))
    return F.when(x.isNotNull(), text)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 by calendar arithmetic, whatever the session time zone."""
    whole = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint") * F.lit(86_400_000_000)
    minutes = (F.hour(ts) * 60 + F.minute(ts)).cast("bigint") * F.lit(60_000_000)
    return whole + minutes + (F.extract(F.lit("SECOND"), ts) * F.lit(1_000_000)).cast("bigint")


def date_part(ts: Column, part: str) -> Column:
    """One calendar feature of a timestamp; a missing date gives 0 (month 0 for the cycle)."""
    month = F.coalesce(F.month(ts), F.lit(0)).cast("double")
    angle = F.lit(2.0 * 3.141592653589793) * month / F.lit(12.0)
    parts = {
        "month": month,
        "quarter": F.coalesce(F.quarter(ts), F.lit(0)).cast("double"),
        "dayofweek": F.coalesce(F.weekday(ts), F.lit(0)).cast("double"),
        "is_month_end": F.coalesce((F.last_day(ts) == F.to_date(ts)).cast("int"), F.lit(0)),
        "sin_month": F.sin(angle),
        "cos_month": F.cos(angle),
    }
    return parts[part]
