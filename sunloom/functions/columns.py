"""Column expressions of the irradiance model. All are null-preserving: a null input gives null, never a bound.

Inputs are expected without NaN (nan_to_null at ingest), as NaN compares above every number in Spark.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain: kilometres per degree, and caps of the index by clear-sky irradiance.
KM_PER_LAT, KM_PER_LON = 111.0, 75.8
CAPS = ((100.0, 0.85), (200.0, 0.90), (350.0, 0.95))
TOP_CAP = 1.3


def num(x: float) -> Column:
    return F.lit(float(x))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounds that keep null (greatest and least alone would give the bound)."""
    out = c if lo is None else F.greatest(c, num(lo))
    out = out if hi is None else F.least(out, num(hi))
    return F.when(c.isNotNull(), out)


def csi(ghi: Column, clear: Column, floor: float = 20.0, cap: float = 2.0) -> Column:
    """Clear-sky index: ghi / clear within [0, cap] where clear reaches floor, else 0."""
    return F.when(clear >= num(floor), clip(F.try_divide(ghi, clear), 0.0, cap)).when(clear.isNotNull(), num(0.0))


def low_sun_blend(raw: Column, background: Column, clear: Column, limit: float = 200.0) -> Column:
    """Below limit, raw gives way to the background's [0, 1] part in proportion to clear / limit."""
    w = clear / num(limit)
    return F.when(clear < num(limit), w * raw + (num(1) - w) * clip(background, 0.0, 1.0)).otherwise(raw)


def tier_cap(index: Column, clear: Column) -> Column:
    """index within [0, cap], the cap rising with clear."""
    cap = num(TOP_CAP)
    for below, value in reversed(CAPS):
        cap = F.when(clear < num(below), num(value)).otherwise(cap)
    return F.when(index.isNotNull() & clear.isNotNull(), F.greatest(F.least(index, cap), num(0)))


def ghi_of(index: Column, clear: Column, floor: float = 10.0) -> Column:
    """Irradiance of an index by day; null by night."""
    return F.when(clear >= num(floor), index * clear)


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = num(2 * math.pi) * value / num(period)
    return F.sin(angle), F.cos(angle)


def snap_index(value: Column, resolution: float) -> Column:
    """Index of the nearest grid line, half to even."""
    return F.rint(value / num(resolution)).cast("long")


def km_apart(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat-earth distance."""
    dy, dx = (lat1 - lat2) * num(KM_PER_LAT), (lon1 - lon2) * num(KM_PER_LON)
    return F.sqrt(dy * dy + dx * dx)


def wendland(distance: Column, support: float | Column) -> Column:
    """Compactly supported basis: 1 at 0, 0 from support on."""
    d = distance / (support if isinstance(support, Column) else num(support))
    e = num(1) - d
    return F.when(d < num(1), e * e * e * e * e * e * (num(35) * d * d + num(18) * d + num(3)) / num(3)).when(d.isNotNull(), num(0))


def normalise(c: Column, reference: float, scale: float) -> Column:
    return (c - num(reference)) / num(scale)


def local_time(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    """Wall-clock time, without zone, of a UTC instant without zone. Keys stay UTC; this is for calendar features."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def fixed_to_utc(ts: Column, zone: str = "Etc/GMT+8") -> Column:
    """UTC of a clock at a fixed offset (POSIX sign: Etc/GMT+8 is UTC-8)."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def parse_mixed(text: Column, *formats: str) -> Column:
    """The first format that parses, null where none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def from_parts(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """Instant without zone of calendar parts; null where a part is null or they name no instant."""
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    text = F.concat(F.lpad(year.cast("int").cast("string"), 4, "0"), F.lit("-"), two(month), F.lit("-"), two(day), F.lit(" "), two(hour), F.lit(":"), two(minute))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")


def any_value(columns: list[str]) -> Column:
    """True for rows that have a value in one of the columns at least."""
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()


def haurwitz(cos_zenith: Column) -> Column:
    """Closed-form clear-sky irradiance; a labelled stand-in where a turbidity-based one is not given."""
    return F.when(cos_zenith > num(0), num(1098) * cos_zenith * F.exp(num(-0.057) / cos_zenith)).when(cos_zenith.isNotNull(), num(0))
