"""Column functions for codes, labels and keys."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of the age bands (left-inclusive) and their labels.
AGE_BANDS = ((18, "0-17"), (30, "18-29"), (45, "30-44"), (65, "45-64"), (1000, "65+"))


def registry_map(text: Column) -> Column:
    """``key:code,key:code`` to a map from code to key; pairs without a code are dropped."""
    pairs = F.transform(F.split(text, ","), lambda p: F.split(p, ":"))
    good = F.filter(pairs, lambda p: (F.size(p) == 2) & (F.trim(F.get(p, 1)) != ""))
    return F.map_from_entries(F.transform(good, lambda p: F.struct(F.trim(F.get(p, 1)).cast("int"), F.trim(F.get(p, 0)))))


def age_band(age: Column) -> Column:
    """Band label; negative ages are in the first band, NaN, null and 1000 or more in the last."""
    out = F
    for top, label in AGE_BANDS[:-1]:
        out = out.when(age < top, label)
    return out.otherwise(AGE_BANDS[-1][1])


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Unicode's full case folding: letters that become one letter, and those that become several."""
    one, several = {}, {}
    for letter in map(chr, range(0x110000)):
        if (to := letter.casefold()) != letter:
            (one if len(to) == 1 else several)[letter] = to
    return one, several


def folded(text: Column) -> Column:
    """Full case folding, by which texts are equal whatever their case is: ß, ẞ and SS, ſ and s, σ and final ς, ﬁ and fi."""
    one, several = _folds()
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in several.items()))
    parted = F.when(text.rlike("[" + "".join(several) + "]"), F.aggregate(pairs, text, lambda t, p: F.replace(t, p["a"], p["b"]))).otherwise(text)
    whole = F.translate(parted, "".join(one), "".join(one.values()))
    return F.when(text.rlike("[^\\x00-\\x7f]"), whole).otherwise(F.lower(text))


#: White space of any script.
WHITE = "(?U)[\\s\\x1c-\\x1f]+"


def norm_code(text: Column) -> Column:
    """Trimmed, white space collapsed, case folded."""
    return folded(F.btrim(F.regexp_replace(text, WHITE, " "), F.lit(" ")))


def norm_name(text: Column) -> Column:
    """Case folded, then only 0-9 and a-z are left; accented letters go."""
    return F.regexp_replace(folded(text), "[^0-9a-z]+", "")


#: How keys of units and of boundary features are made alike.
STRATEGIES = {"code": norm_code, "name": norm_name}


def json_array(text: Column, element: str) -> Column:
    """A JSON array in a text; blank, broken or non-array text gives an empty array. ``element``: bigint or string."""
    return F.coalesce(F.from_json(F.when(text.rlike("^\\s*\\["), text), f"array<{element}>"), F.array().cast(f"array<{element}>"))


def valid_point(lat: Column, lon: Column) -> Column:
    """Both coordinates are there, no NaN, and in range."""
    there = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(there & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def cleaned(value: Column) -> Column:
    """NaN as null, for JSON."""
    return F.when(~F.isnan(value), value)
