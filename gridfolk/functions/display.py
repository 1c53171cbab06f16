"""Column functions that make values readable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "—"
#: Suffixes of short numbers.
SUFFIXES = ((1e9, "B"), (1e6, "M"), (1e3, "k"))


def humanize(token: Column) -> Column:
    """Underscores to spaces, one space at most, each word's first letter upper case; ``(none)`` and empty as a dash."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(token, "_+", " "), "\\s+", " "))
    words = F.transform(F.split(spaced, "(?<=[^0-9A-Za-z_])|(?=[^0-9A-Za-z_])"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))
    return F.when(token.isin("(none)", ""), EMPTY).otherwise(F.array_join(words, ""))


def whole_number(n: Column) -> Column:
    """The text of the nearest whole number, ties away from zero."""
    return F.format_string("%.0f", F.round(n))


def one_place(n: Column) -> Column:
    """To one place, ties away from zero. What counts is the double's exact value, not its digits: 1.15 is less and becomes 1.1."""
    size, sign = F.abs(n), F.when(n < 0, -1.0).otherwise(1.0)
    part = size % 1
    # 57 binary places hold all of a part from 1/32 on; smaller ones become 0 anyway.
    tenths = F.shiftright((part * 2.0**57).cast("long") * 10 + 2**56, 57)
    exact = sign * (size - part + tenths / 10)
    return F.format_string("%.1f", F.when(size < 2.0**52, exact).otherwise(n))  # no parts beyond


def compact(n: Column) -> Column:
    """1234 as 1.2k, 12345 as 12k, and so on, ties away from zero; null, NaN and infinite as a dash."""
    out = F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), EMPTY)
    for unit, suffix in SUFFIXES:
        short = F.when(F.abs(n) >= 10 * unit, whole_number(n / unit)).otherwise(one_place(n / unit))
        out = out.when(F.abs(n) >= unit, F.concat(short, F.lit(suffix)))
    return out.otherwise(F.regexp_replace(F.format_number(n, 3), "\\.?0+$", ""))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, one decimal below 10 %, ties away from zero; 0% of nothing."""
    share = 100 * part / whole
    short = F.when(part / whole >= 0.1, whole_number(share)).otherwise(one_place(share))
    return F.when(F.coalesce(whole, F.lit(0)) == 0, "0%").otherwise(F.concat(short, F.lit("%")))


def number(text: Column) -> Column:
    """The number in a text; 0 for what is none, or isn't finite."""
    n = text.try_cast("double")
    return F.when(F.abs(n) < float("inf"), n).otherwise(0.0)


def identifier(text: Column) -> Column:
    """The id in a text; -1 for null, 0 for what is no number."""
    return F.when(text.isNull(), -1).otherwise(number(text)).cast("long")


def cell_number(n: Column) -> Column:
    """Whole numbers with thousands apart, others to two places; null as a dash."""
    short = F.regexp_replace(F.format_string("%.2f", n), "\\.?0+$", "")
    return F.when(n.isNull(), EMPTY).when(n == F.floor(n), F.format_number(n, 0)).otherwise(short)


def cell_text(text: Column) -> Column:
    """The text; null and empty as a dash."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(EMPTY))


def cell_list(values: Column) -> Column:
    """The values with commas between (null: nothing there); null and empty lists as a dash."""
    texts = F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit("")))
    return F.when(F.size(values) > 0, F.array_join(texts, ", ")).otherwise(EMPTY)


def human_number(text: Column) -> Column:
    """``10k``, ``60M``, ``1b`` to a whole number."""
    low = F.lower(F.trim(text))
    times = F.when(low.endswith("k"), 10**3).when(low.endswith("m"), 10**6).when(low.endswith("b"), 10**9).otherwise(1)
    return (F.regexp_replace(low, "[kmb]$", "").try_cast("double") * times).cast("long")


def match_flag(rate: Column) -> Column:
    return F.when(rate >= 0.98, "✓").when(rate >= 0.5, "~").otherwise("✗")


def relabel(value: Column, labels: Column) -> Column:
    """The display label of a raw code from a map, else the code itself; empty labels don't count."""
    return F.coalesce(F.nullif(F.try_element_at(labels, value), F.lit("")), value)


def relabel_each(values: Column, labels: Column) -> Column:
    return F.transform(values, lambda v: relabel(v, labels))


def color_stops(largest: Column, n: int) -> Column:
    """``n`` values from 1 to the largest count, evenly spaced in logarithms, each at least 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.greatest(F.lit(1), F.floor(F.pow(largest.cast("double"), i / (n - 1)) + 0.5)).cast("long"))
