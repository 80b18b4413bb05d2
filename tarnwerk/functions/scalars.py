"""Column functions shared by the operators. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def skip_nan(c: Column) -> Column:
    """NaN as null, so that aggregates leave it out."""
    return F.nanvl(c, F.lit(None).cast("double"))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded by low and high; null stays null."""
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def clipped(c: Column, low: float, high: float) -> Column:
    """Would ``clip`` change it."""
    return (c < low) | (c > high)


def close(a: Column, b: Column, atol: float = 0.0, rtol: float = 0.0) -> Column:
    """|a - b| <= atol + rtol |b|; null or NaN is never close."""
    return F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))


def close_either(a: Column, b: Column, rel: float = 1e-9, atol: float = 0.0) -> Column:
    """|a - b| <= max(rel max(|a|, |b|), atol)."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(atol)), F.lit(False))


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def small_to_zero(c: Column, digits: int = 12) -> Column:
    """Rounded to ``digits``; what would print as minus zero or less than half a digit is 0."""
    return F.when(F.abs(c) < 0.5 * 10.0**-digits, F.lit(0.0)).otherwise(F.round(c, digits))


def number(c: Column) -> Column:
    """Text as a double, null if it isn't one."""
    return c.try_cast("double")


def number_or_zero(c: Column) -> Column:
    return F.coalesce(number(c), F.lit(0.0))


def decimal_comma(c: Column) -> Column:
    """Text with a decimal comma as a double."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def flag(c: Column) -> Column:
    """true/false in any case as a boolean, else null."""
    low = F.lower(F.trim(c))
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


def clean_code(c: Column, width: int = 5) -> Column:
    """Trimmed code text without a trailing ``.0``, filled with zeros on the left, never cut."""
    bare = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(F.length(bare) < width, F.lpad(bare, width, "0")).otherwise(bare)


def percent_text(c: Column) -> Column:
    """A share as text such as ``22.9%``: a hundred times the double, rounded to one decimal by its binary
    value, half to even. Decimal ties are rarely binary ones: 22.85 is a little above its text."""
    x = c.cast("double") * 100
    twenty = x * 16 + x * 4
    lost = x * 4 - (twenty - x * 16)  # what that sum's rounding lost, exactly
    odd = F.rint(twenty)
    beside = (twenty - odd) + lost
    tie = (F.pmod(odd, F.lit(2.0)) == 1.0) & (F.abs(twenty - odd) < 1e-6)
    up, down = F.floor((odd + 1) / 2) / 10, F.floor((odd - 1) / 2) / 10
    rounded = F.when(tie & (beside > 0), up).when(tie & (beside < 0), down).otherwise(F.bround(x, 1))
    return F.format_string("%.1f%%", rounded)


def section(text: Column, start: str, end: str) -> Column:
    """What stands between the first ``start`` and the next ``end`` (or the end of the text), trimmed; null
    without ``start``."""
    after = F.substr(text, F.instr(text, start) + len(start))
    return F.when(F.instr(text, start) > 0, F.trim(F.substring_index(after, end, 1)))


def after_first(c: Column, sign: str = ":") -> Column:
    """What follows the first ``sign``, trimmed; null without one."""
    return F.when(F.instr(c, sign) > 0, F.trim(F.substr(c, F.instr(c, sign) + len(sign))))


def first_number(c: Column) -> Column:
    """The first signed decimal in a text; null without one."""
    found = F.regexp_extract(c, r"[-+]?\d+(?:\.\d+)?", 0)
    return F.when(found != "", found.cast("double"))


def month_name(month: Column) -> Column:
    return F.date_format(F.make_date(F.lit(2000), month.cast("int"), F.lit(1)), "MMM")


def hours_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year.cast("int"), F.lit(12), F.lit(31))) * 24


def is_leap(year: Column) -> Column:
    return hours_in_year(year) == 8784


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def stamp(c: Column, pattern: str = "yyyyMMdd:HHmm") -> Column:
    return F.try_to_timestamp(c, F.lit(pattern))


def lookup(c: Column, table: Mapping[str, object]) -> Column:
    """The literal that a key maps to; null for other keys."""
    if not table:
        return F.lit(None)
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def order_of(c: Column, order: Sequence[object]) -> Column:
    """1-based place in a fixed order, 0 outside it: a sort key for categories."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), c)


def joined_ids(*cs: Column, sign: str = "+") -> Column:
    """Non-null ids in order, joined."""
    return F.concat_ws(sign, *cs)


def reasons(pairs: Sequence[tuple[Column, str]], sign: str = "+") -> Column:
    """The names whose condition holds, joined in order."""
    return F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]), lambda x: x.isNotNull()), sign)


def row_sum(*cs: Column) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out + c
    return out


def csv_cell(c: Column) -> Column:
    """A text as a CSV cell, quoted where it has to be."""
    return F.when(c.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
