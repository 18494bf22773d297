"""Column functions: dates, texts, colours, easing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import HUE_NAMES, LABELS


def stars(rank: Column) -> Column:
    return F.concat(F.repeat(F.lit("★"), rank), F.repeat(F.lit("☆"), 5 - rank))


def label(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, LABELS)), number.cast("int"))


def marks_text(rank: Column, color: Column, in_trash: Column) -> Column:
    """``★★★☆☆ Green rejected``."""
    return F.concat_ws(" ", stars(rank), F.when(color != 0, label(color)), F.when(in_trash, F.lit("rejected")))


def one_decimal(value: Column) -> Column:
    """One decimal, ``.0`` left out; exact ties round up."""
    return F.regexp_replace(F.format_string("%.1f", value.cast("double")), r"\.0$", "")


def exposure_text(num: Column, den: Column) -> Column:
    """``1/500 s``, ``2 s``, ``2.5 s``; null where a part is zero."""
    seconds = num / den
    below = F.concat(F.lit("1/"), F.round(den / F.greatest(num, F.lit(1))).cast("long").cast("string"), F.lit(" s"))
    return F.when((num > 0) & (den > 0), F.when(num < den, below).otherwise(F.concat(one_decimal(seconds), F.lit(" s"))))


def camera(make: Column, model: Column) -> Column:
    """Make and model without the make twice; null where both are blank."""
    make, model = F.nullif(F.trim(make), F.lit("")), F.nullif(F.trim(model), F.lit(""))
    return F.when(make.isNull() | model.startswith(make), model).when(model.isNull(), make).otherwise(F.concat_ws(" ", make, model))


def exif_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def exif_date(text: Column) -> Column:
    """``2020:08:03 08:03:35`` as ``2020-08-03 08:03:35``; null where blank, short or year 0."""
    d = exif_digits(text)
    part = lambda a, n: F.substring(d, a, n)
    iso = F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit(" "), part(9, 2), F.lit(":"), part(11, 2), F.lit(":"), part(13, 2))
    return F.when((F.length(d) >= 14) & (part(1, 4) != "0000"), iso)


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, by counting from 1 March."""
    y = F.when(month <= 2, year - 1).otherwise(year)
    since_march = F.pmod(month + 9, F.lit(12))
    within = F.floor((153 * since_march + 2) / 5) + day - 1
    return (365 * y + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400) + within - 719468).cast("long")


def taken_ms(text: Column, sub_second: Column) -> Column:
    """Milliseconds of a camera's local date; sub-second digits are a decimal fraction cut to three places."""
    d = exif_digits(text)
    part = lambda a, n: F.try_to_number(F.substring(d, a, n), F.lit("9" * n)).cast("long")
    sub = F.rpad(F.substring(F.coalesce(exif_digits(sub_second), F.lit("")), 1, 3), 3, "0")
    ms = days_from_civil(part(1, 4), part(5, 2), part(7, 2)) * 86_400_000 + part(9, 2) * 3_600_000 + part(11, 2) * 60_000 + part(13, 2) * 1000
    return F.when(exif_date(text).isNotNull(), ms + F.try_to_number(sub, F.lit("999")).cast("long"))


def upright(x: Column, y: Column, orientation: Column) -> Column:
    """A point given in the stored frame, in the upright one."""
    turned = F.when(orientation == 3, F.struct((1 - x).alias("x"), (1 - y).alias("y")))
    turned = turned.when(orientation == 6, F.struct((1 - y).alias("x"), x.alias("y")))
    return turned.when(orientation == 8, F.struct(y.alias("x"), (1 - x).alias("y"))).otherwise(F.struct(x.alias("x"), y.alias("y")))


def brightness(r: Column, g: Column, b: Column) -> Column:
    """Integer luma."""
    return F.floor((299 * r + 587 * g + 114 * b) / 1000).cast("int")


def byte(value: Column) -> Column:
    """Rounded, half up, and kept within 0 to 255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(value + 0.5))).cast("int")


def hue_of(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees; 0 for a grey."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = (top - low).cast("double")
    sector = F.when(top == r, F.pmod((g - b) / spread, F.lit(6.0))).when(top == g, (b - r) / spread + 2).otherwise((r - g) / spread + 4)
    return F.when(spread > 0, sector * 60).otherwise(F.lit(0.0))


def saturation_of(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return F.when(top > 0, (top - F.least(r, g, b)).cast("double") / top).otherwise(F.lit(0.0))


def from_hsv(hue: Column, saturation: Column, value: Column) -> tuple[Column, Column, Column]:
    """Channels in the range of ``value``."""
    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + hue / 60, F.lit(6.0))
        return value - value * saturation * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return channel(5), channel(3), channel(1)


def hue_distance(a: Column, b: Column) -> Column:
    gap = F.pmod(a - b, F.lit(360.0))
    return F.least(gap, 360 - gap)


def hue_turn(a: Column, b: Column) -> Column:
    """Signed shortest turn from ``a`` to ``b``, in (-180, 180]."""
    gap = F.pmod(b - a, F.lit(360.0))
    return F.when(gap > 180, gap - 360).otherwise(gap)


def smoothstep(lo: float | Column, hi: float | Column, x: Column) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))
    return t * t * (3 - 2 * t)


def zone_weight(r: Column, g: Column, b: Column, centre: float, width: float, soft: float) -> Column:
    """How much of a hue zone a colour is: near its hue, and no grey."""
    hue = F.pmod(F.round(hue_of(r, g, b), 1), F.lit(360.0))
    near = 1 - smoothstep(width, width + max(soft, 1.0), hue_distance(hue, F.lit(float(centre))))
    return near * smoothstep(0.02, 0.06, saturation_of(r, g, b))


def colour_name(r: Column, g: Column, b: Column, neutral: float = 0.08) -> Column:
    hue = hue_of(r, g, b)
    named = reduce(lambda c, step: c.when(hue < step[0], step[1]), HUE_NAMES[1:], F.when(hue < HUE_NAMES[0][0], HUE_NAMES[0][1]))
    top = F.greatest(r, g, b)
    return F.when((top <= 0) | (saturation_of(r, g, b) < neutral), "neutre").otherwise(named)


def shift_ev(reference: Column, target: Column, most: float = 2.0) -> Column:
    """Stops from target to reference, at most ``most``; 0 where a luminance is not positive."""
    stops = F.log2(reference / target)
    return F.when((reference > 0) & (target > 0), F.greatest(F.lit(-most), F.least(F.lit(most), stops))).otherwise(F.lit(0.0))


def eased(t: Column, how: str) -> Column:
    return {"linear": t, "smooth": t * t * (3 - 2 * t), "in": t * t, "out": 1 - (1 - t) * (1 - t)}[how]


def triangle(elapsed: Column, period: Column) -> Column:
    """A wave that runs from 0 to 1 in one period and back in the next."""
    return 1 - F.abs(F.pmod(elapsed / period, F.lit(2.0)) - 1)


def range_at(text: Column, t: Column) -> Column:
    """``a..b`` at moment ``t``: whole numbers stay whole, other texts stay as they are."""
    lo, hi = (F.regexp_extract(text, r"^(-?[0-9.]+?)\.\.(-?[0-9.]+)$", k) for k in (1, 2))
    whole = ~lo.contains(".") & ~hi.contains(".")
    a, b = lo.try_cast("double"), hi.try_cast("double")
    value = a + (b - a) * t
    return F.when(lo == "", text).when(whole, F.round(value).cast("long").cast("string")).otherwise(value.cast("string"))
