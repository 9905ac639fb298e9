"""Time, number and label expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_to_timestamp(c: Column) -> Column:
    return F.timestamp_seconds(c)


def parse_mixed_timestamp(c: Column) -> Column:
    """Epoch seconds, epoch milliseconds (above 1e12) or an ISO string; anything else is null."""
    raw = F.trim(c.cast("string"))
    num = raw.try_cast("double")
    seconds = F.when(num > 1e12, num / 1000).otherwise(num)
    # Beyond the nanosecond calendar (year 2262) an epoch counts as unparseable.
    usable = ~F.isnan(num) & (F.abs(seconds) < F.lit(9.2e9))
    epoch = F.timestamp_micros(F.when(usable, seconds * 1000000).cast("long"))
    return F.when(num.isNotNull(), epoch).otherwise(raw.try_cast("timestamp"))


def calendar_features(ts: Column) -> dict[str, Column]:
    """Hour of day 0-23 and weekday with Monday as 0."""
    return {"hour_of_day": F.hour(ts), "day_of_week": F.weekday(ts)}


def coerce_numeric(c: Column) -> Column:
    num = c.cast("string").try_cast("double")
    return F.when(num.isNull() | F.isnan(num), 0.0).otherwise(num)


def hours_between(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(3.6e9)


def phase_bin(x: Column, y: Column, bins: int = 12) -> Column:
    """Angle of (x, y) cut into equal bins over the full circle."""
    turn = (F.atan2(y, x) + math.pi) / (2 * math.pi)
    return F.greatest(F.lit(0), F.least(F.floor(turn * bins), F.lit(bins - 1))).cast("int")


def phase_label(bin_col: Column) -> Column:
    return F.format_string("PHASE_%02d", bin_col)


def probability_band(p: Column) -> Column:
    """Probability times 100 in the bands 0-35, 35-65, 65-100."""
    pct = p * 100
    return F.when(pct < 35, "0-35").when(pct < 65, "35-65").when(pct.isNotNull(), "65-100")


def map_values(c: Column, mapping: dict, default: Column | None = None) -> Column:
    """Replace listed values; others stay, or become ``default``."""
    out = None
    for old, new in mapping.items():
        out = F.when(c == old, new) if out is None else out.when(c == old, new)
    return out.otherwise(c if default is None else default)


def hash_order(id_col: Column, seed: int, fast: bool = False) -> Column:
    """A reproducible random order: hex md5 of seed and id, or the cheaper xxhash64."""
    if fast:
        return F.xxhash64(id_col, F.lit(seed))
    return F.md5(F.concat(F.lit(f"{seed}-"), id_col.cast("string")))
