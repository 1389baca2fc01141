"""Column expressions over 8-bit pixel values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ("r", "g", "b")


def clip(v: Column) -> Column:
    """To 0..255, fractions cut off."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), v.cast("double")))).cast("int")


def saturating(v: Column) -> Column:
    return F.least(F.lit(255), v)


def luma(r="r", g="g", b="b") -> Column:
    """ITU-R 601 in 16-bit fixed point, rounded."""
    return F.shiftright(F.col(r) * 19595 + F.col(g) * 38470 + F.col(b) * 7471 + 32768, 16).cast("int")


def blend(a: Column, b: Column, f: float) -> Column:
    """``a`` at 0, ``b`` at 1, beyond that extrapolated and clipped."""
    return clip(a + F.lit(float(f)) * (b - a))


def each(expr) -> dict[str, Column]:
    """The same expression on every band."""
    return {c: expr(F.col(c)) for c in BANDS}


def lookup(table: list[int], v: Column) -> Column:
    """Value of a 256-entry table, as an array literal."""
    return F.element_at(F.array(*(F.lit(int(x)) for x in table)), v + 1)


def hsv(r="r", g="g", b="b") -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value in 0..1, of 8-bit bands."""
    return unit_hsv(*(F.col(c) / F.lit(255.0) for c in (r, g, b)))


def unit_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """The same of bands in 0..1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = F.when(d == 0, F.lit(0.0)).when(top == r, (g - b) / d).when(top == g, F.lit(2.0) + (b - r) / d).otherwise(F.lit(4.0) + (r - g) / d)
    hue = F.when(hue < 0, hue + 6.0).otherwise(hue) * 60.0
    return hue, F.when(top == 0, F.lit(0.0)).otherwise(d / top), top


def color_name(r="r", g="g", b="b") -> Column:
    """A coarse name: nearly gray by brightness, else by hue."""
    return hsv_name(*hsv(r, g, b))


def hsv_name(hue: Column, s: Column, v: Column) -> Column:
    out = F.when(s < 0.15, F.when(v > 0.6, "white").otherwise("dark"))
    for end, name in HUES:
        out = out.when(hue < end, name)
    return out.otherwise("colorful")


#: Where each name ends on the hue circle.
HUES = ((15, "red"), (45, "orange"), (70, "yellow"), (160, "green"), (200, "cyan"), (260, "blue"), (300, "purple"), (345, "pink"), (360, "red"))

#: Colour stops of the false-colour palettes.
PALETTES = {
    "thermal": [(0, (0, 0, 128)), (0.4, (255, 0, 0)), (0.7, (255, 255, 0)), (1, (255, 255, 255))],
    "rainbow": [(0, (75, 0, 130)), (0.33, (0, 0, 255)), (0.66, (0, 255, 0)), (1, (255, 0, 0))],
    "ocean": [(0, (0, 0, 0)), (0.5, (0, 64, 128)), (1, (0, 255, 255))],
    "fire": [(0, (0, 0, 0)), (0.5, (255, 0, 0)), (1, (255, 255, 0))],
}

#: Colours of segment overlays.
REGION_COLORS = [
    (244, 67, 54), (33, 150, 243), (255, 193, 7), (76, 175, 80), (156, 39, 176), (0, 188, 212),
    (255, 87, 34), (63, 81, 181), (255, 235, 59), (0, 150, 136), (233, 30, 99), (121, 85, 72),
]


def palette_table(name: str) -> list[tuple[int, int, int]]:
    """256 colours, linear between the stops, fractions cut off; unknown names are thermal."""
    stops = PALETTES.get(name, PALETTES["thermal"])
    out = []
    for v in range(256):
        x = v / 255
        i = max(k for k, (p, _) in enumerate(stops) if p <= x)
        if i == len(stops) - 1:
            out.append(stops[i][1])
            continue
        (p, c), (q, d) = stops[i], stops[i + 1]
        out.append(tuple(int(a + (e - a) * ((x - p) / (q - p))) for a, e in zip(c, d)))
    return out


def human_bytes(n: Column) -> Column:
    n = n.cast("double")
    return (
        F.when(n.isNull(), "-")
        .when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
        .when(n < 1024**3, F.concat(F.format_string("%.1f", n / 1024**2), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1024**3), F.lit(" GB")))
    )
