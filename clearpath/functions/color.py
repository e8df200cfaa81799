"""Colours and contrast as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named colours that are understood.
NAMED = {
    "black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "yellow": "#ffff00", "cyan": "#00ffff", "magenta": "#ff00ff", "gray": "#808080",
    "grey": "#808080", "silver": "#c0c0c0", "maroon": "#800000", "olive": "#808000", "lime": "#00ff00", "aqua": "#00ffff", "teal": "#008080", "navy": "#000080", "fuchsia": "#ff00ff", "purple": "#800080",
}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it: without
    this, the expression grows with the product of its parts and is too long to compile."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


_HSL = r"^hsla?\(\s*(-?[\d.]+)(?:deg)?\s*[, ]\s*([\d.]+)%\s*[, ]\s*([\d.]+)%\s*(?:[,/]\s*[\d.%]+\s*)?\)$"
_RGB = r"^rgba?\(\s*(\d{1,3})\s*[, ]\s*(\d{1,3})\s*[, ]\s*(\d{1,3})\s*(?:[,/]\s*[\d.%]+\s*)?\)$"


def _hue(value: Column) -> Column:
    """The rgb array of hsl() or hsla()."""
    part = lambda i: F.regexp_extract(value, _HSL, i).try_cast("double")

    def channels(p: Column) -> Column:
        h, s, l = F.pmod(p[0], F.lit(360.0)) / 30, F.least(p[1] / 100, F.lit(1.0)), F.least(p[2] / 100, F.lit(1.0))  # noqa: E741
        k = lambda n: F.pmod(h + n, F.lit(12.0))
        return F.array(*(F.round((l - s * F.least(l, 1 - l) * F.greatest(F.least(k(n) - 3, 9 - k(n), F.lit(1.0)), F.lit(-1.0))) * 255).cast("int") for n in (0, 8, 4)))

    return let(F.array(part(1), part(2), part(3)), channels)


def rgb(value: Column) -> Column:
    """array<int> of red, green and blue; null for what is not a plain colour. Alpha is
    left out; see ``transparent``."""
    named = F.create_map(*(F.lit(x) for kv in NAMED.items() for x in kv))

    def plain(h: Column) -> Column:
        digits = F.when(h.rlike("^#[0-9a-f]{3,4}$"), F.concat(*(F.repeat(F.substring(h, i, 1), 2) for i in (2, 3, 4)))).when(h.rlike("^#([0-9a-f]{6}|[0-9a-f]{8})$"), F.substring(h, 2, 6))
        by_hex = let(digits, lambda d: F.when(d.isNotNull(), F.array(*(F.conv(F.substring(d, i, 2), 16, 10).cast("int") for i in (1, 3, 5)))))
        by_call = F.when(h.rlike(_RGB), F.array(*(F.least(F.lit(255), F.regexp_extract(h, _RGB, i).try_cast("int")) for i in (1, 2, 3))))
        return F.coalesce(by_hex, by_call, F.when(h.rlike(_HSL), _hue(h)))

    return let(F.lower(F.trim(value)), lambda v: let(F.coalesce(F.try_element_at(named, v), v), plain))


def transparent(value: Column) -> Column:
    """Whether a colour lets everything through."""
    v = F.lower(F.trim(value))
    return (v == "transparent") | v.rlike(r"^#([0-9a-f]{3}0|[0-9a-f]{6}00)$") | v.rlike(r"^(rgb|hsl)a?\([^)]*[,/]\s*0*(\.0+)?%?\s*\)$") & v.rlike(r"^\w+\(([^,]*,){3}|/")


def luminance(c: Column) -> Column:
    """Relative luminance of an rgb array."""
    part = lambda i: F.when(c[i] / 255.0 <= 0.03928, c[i] / 255.0 / 12.92).otherwise(F.pow((c[i] / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * part(0) + 0.7152 * part(1) + 0.0722 * part(2)


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two colour values, 1 to 21; null if either is not plain."""
    shade = lambda c: let(rgb(c), luminance)
    return let(F.array(shade(a), shade(b)), lambda s: F.when(s[0].isNotNull() & s[1].isNotNull(), (F.array_max(s) + 0.05) / (F.array_min(s) + 0.05)))


def points(size: Column) -> Column:
    """Font size in points: px, pt, rem and em (16 px); else null."""
    n = F.regexp_extract(F.lower(F.trim(size)), r"^([\d.]+)(px|pt|rem|em)$", 1).try_cast("double")
    unit = F.regexp_extract(F.lower(F.trim(size)), r"^([\d.]+)(px|pt|rem|em)$", 2)
    return F.when(unit == "px", n * 0.75).when(unit == "pt", n).when(unit.isin("rem", "em"), n * 12)
