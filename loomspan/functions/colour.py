"""Colour spaces as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB to XYZ by rows, the white point, and the way back.
TO_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
WHITE = (0.95047, 1.0, 1.08883)
FROM_XYZ = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
#: Luma in 14-bit fixed point.
LUMA = (4899, 9617, 1868)


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(LUMA[0] * r + LUMA[1] * g + LUMA[2] * b + 8192, 14)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* of 8-bit sRGB."""
    linear = [F.when(c / 255.0 > 0.04045, F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255.0 / 12.92) for c in (r, g, b)]
    xyz = [sum((w * c for w, c in zip(row, linear, strict=True)), F.lit(0.0)) / white for row, white in zip(TO_XYZ, WHITE, strict=True)]
    x, y, z = (F.when(v > 0.008856, F.pow(v, F.lit(1 / 3))).otherwise(7.787 * v + 16 / 116) for v in xyz)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def rgb(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit sRGB of CIE L*a*b*, cut to its range, not rounded."""
    y = (lightness + 16) / 116
    cubes = [F.when(F.pow(v, F.lit(3)) > 0.008856, F.pow(v, F.lit(3))).otherwise((v - 16 / 116) / 7.787) * white for v, white in zip((a / 500 + y, y, y - b / 200), WHITE, strict=True)]
    linear = [sum((w * c for w, c in zip(row, cubes, strict=True)), F.lit(0.0)) for row in FROM_XYZ]
    coded = [F.when(v > 0.0031308, 1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * v) for v in linear]
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 for v in coded)


def difference(one: tuple[Column, Column, Column], other: tuple[Column, Column, Column]) -> Column:
    """CIE94 colour difference."""
    dl, da, db = (p - q for p, q in zip(one, other, strict=True))
    c1, c2 = (F.sqrt(a * a + b * b) for _, a, b in (one, other))
    dh = F.greatest(F.lit(0.0), da * da + db * db - (c1 - c2) * (c1 - c2))
    return F.sqrt(dl * dl + F.pow((c1 - c2) / (1 + 0.045 * c1), F.lit(2)) + dh / F.pow(1 + 0.015 * c1, F.lit(2)))
