"""Column expressions: robust statistics, geometry, colour and text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Round half towards positive infinity."""
    return F.floor(x + F.lit(0.5))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length of the intersection of two intervals, 0 if they are apart."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def outside(x: Column, low: Column, high: Column) -> Column:
    """Distance from x to the interval [low, high]."""
    return F.greatest(low - x, F.lit(0), x - high)


def point_box_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt(F.pow(outside(x, x0, x1), 2) + F.pow(outside(y, y0, y1), 2))


def luma(r: Column, g: Column, b: Column) -> Column:
    """8-bit grey value in fixed point."""
    return F.shiftright(r * 4899 + g * 9617 + b * 1868 + 8192, 14)


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), "- +", "")


def pig_word(word: Column) -> Column:
    """Words of three letters or more: leading consonants move to the end before "ay"; after a leading vowel "way" is added."""
    head = F.regexp_extract(word, "^([^aeiouAEIOU]*)", 1)
    moved = F.concat(F.substr(word, F.length(head) + 1), head)
    cased = F.when(F.substr(word, F.lit(1), F.lit(1)).rlike("[A-Z]"), F.concat(F.upper(F.substr(moved, F.lit(1), F.lit(1))), F.lower(F.substr(moved, F.lit(2))))).otherwise(moved)
    return F.when(~word.rlike("^[A-Za-z]{3,}$"), word).when(head == "", F.concat(word, F.lit("way"))).otherwise(F.concat(cased, F.lit("ay")))


def looks_garbled(text: Column) -> Column:
    """Has a word of over two characters that is neither all capitals nor like a plain word."""
    plain = r"^[A-Za-z][a-z]*[a-z.'\",!?-]$"
    return F.exists(F.split(text, r"\s+"), lambda w: (F.length(w) > 2) & (w != F.upper(w)) & ~w.rlike(plain))
