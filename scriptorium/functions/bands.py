"""Grade bands, positions in them, confidence and order."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bands with their least and highest percentage, from the top.
ANALYTICAL = (("First", 70.0, 100.0), ("2:1", 60.0, 69.99), ("2:2", 50.0, 59.99), ("Third/Pass", 40.0, 49.99), ("Fail", 20.01, 39.99), ("Missing/unfinished", 0.0, 20.0))
DETERMINISTIC = (("Excellent", 85.0, 100.0), ("Strong", 70.0, 84.99), ("Secure", 55.0, 69.99), ("Adequate", 40.0, 54.99), ("Developing", 25.0, 39.99), ("Weak", 0.01, 24.99))
#: What else an analytical band may be called, in lower case.
SYNONYMS = {"first": "First", "1st": "First", "2:1": "2:1", "upper second": "2:1", "2:2": "2:2", "lower second": "2:2", "third": "Third/Pass", "pass": "Third/Pass", "third/pass": "Third/Pass", "fail": "Fail", "missing": "Missing/unfinished", "missing/unfinished": "Missing/unfinished", "unfinished": "Missing/unfinished"}
#: Guidance that holds one of these is on the analytical scale.
SCALE_WORDS = ("first", "2:1", "2:2", "third/pass", "missing/unfinished", "fail")
#: The order of all bands.
ORDER = {"Missing/unfinished": 0, "Missing": 0, "Fail": 1, "Weak": 1, "Third/Pass": 2, "Developing": 2, "2:2": 3, "Adequate": 3, "2:1": 4, "Secure": 4, "First": 5, "Strong": 5, "Excellent": 6}


def score_percent(score: Column, most: Column) -> Column:
    """Null where there is no positive maximum."""
    return F.when(most > 0, F.round(score * 100 / most, 2))


def on_analytical_scale(guidance: Column) -> Column:
    low = F.lower(F.coalesce(guidance, F.lit("")))
    return functools.reduce(operator.or_, (F.contains(low, F.lit(w)) for w in SCALE_WORDS))


def analytical(percent: Column) -> Column:
    out = F.when(percent <= 20, "Missing/unfinished").otherwise("Fail")
    for name, least, _ in reversed(ANALYTICAL[:4]):
        out = F.when(percent >= least, name).otherwise(out)
    return F.when(percent.isNotNull(), out)


def deterministic(percent: Column) -> Column:
    out = F.when(percent > 0, "Weak").otherwise("Missing")
    for name, least, _ in reversed(DETERMINISTIC[:5]):
        out = F.when(percent >= least, name).otherwise(out)
    return F.when(percent.isNotNull(), out)


def band(said: Column, percent: Column, guidance: Column) -> Column:
    """The band as it was named, if the scale of the guidance knows that name, else by the percentage."""
    low = F.lower(F.trim(F.coalesce(said, F.lit(""))))
    known = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    own = F.create_map(*(F.lit(x) for n in (*(b[0] for b in DETERMINISTIC), "Missing") for x in (n.lower(), n)))
    return F.when(on_analytical_scale(guidance), F.coalesce(F.try_element_at(known, low), analytical(percent))).otherwise(F.coalesce(F.try_element_at(own, low), deterministic(percent)))


def position(percent: Column, of: Column, guidance: Column, said: Column | None = None) -> Column:
    """Low, mid or high as named, else by thirds of the band's bounds; 'low' for what has none."""

    def within(bounds: tuple, other: Column) -> Column:
        out = other
        for name, lower, upper in reversed(bounds):
            third = (upper - lower) / 3
            out = F.when(of == name, F.when(percent < lower + third, "low").when(percent > upper - third, "high").otherwise("mid")).otherwise(out)
        return out

    last = ANALYTICAL[-1]
    rest = within((("", *last[1:]),), F.when(percent < last[2] / 3, "low").when(percent > last[2] - last[2] / 3, "high").otherwise("mid"))
    found = F.when(on_analytical_scale(guidance), within(ANALYTICAL[:-1], rest)).otherwise(within(DETERMINISTIC, F.lit("low")))
    if said is not None:
        low = F.lower(F.trim(F.coalesce(said, F.lit(""))))
        found = F.when(low.isin("low", "mid", "high"), low).otherwise(found)
    return F.when(percent.isNotNull() & of.isNotNull(), found)


def default_confidence(of: Column, guidance: Column) -> Column:
    """N9. Fixed values."""
    return F.when(on_analytical_scale(guidance), F.when(of.isin("Fail", "Missing/unfinished"), 78.0).otherwise(72.0)).otherwise(75.0)


def ordinal(of: Column) -> Column:
    """Null for an unknown band."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair)), of)
