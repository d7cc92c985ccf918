"""Band arithmetic and sensor conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scene classes that mask an observation; a missing class masks too.
MASKED_CLASSES = (0, 1, 2, 3, 8, 9)


def is_clear(scl: Column) -> Column:
    return ~F.coalesce(scl, F.lit(0)).isin(*MASKED_CLASSES)


def _ratio(num: Column, den: Column) -> Column:
    return F.when(F.abs(den) > 1e-6, num / F.when(F.abs(den) > 1e-6, den))


def vegetation_indices(b2: Column, b3: Column, b4: Column, b8: Column, b12: Column) -> dict[str, Column]:
    return {
        "ndvi": _ratio(b8 - b4, b8 + b4),
        "evi": _ratio(2.5 * (b8 - b4), b8 + 6.0 * b4 - 7.5 * b2 + 1.0),
        "ndwi": _ratio(b3 - b8, b3 + b8),
        "nbr": _ratio(b8 - b12, b8 + b12),
    }


def harmonize(dn: Column, day: Column) -> Column:
    """Takes the offset of 1000 off numbers recorded after 2022-01-25; smaller numbers stay."""
    return F.when((day > F.to_date(F.lit("2022-01-25"))) & (dn >= 1000), dn - 1000).otherwise(dn)


def amplitude_to_db(a: Column) -> Column:
    """Scaled decibels in 0 to 32767; 0 where there is no positive finite amplitude."""
    sound = a.isNotNull() & ~F.isnan(a) & (a > 0) & (a < float("inf"))
    db = (20 * F.log10(F.when(sound, a)) + 50) * 200
    return F.coalesce(F.least(F.lit(32767.0), F.greatest(F.lit(0.0), db)).cast("int"), F.lit(0))
