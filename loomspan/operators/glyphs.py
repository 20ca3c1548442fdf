"""Recognised glyphs: parsing of two formats, the way back from rotated coordinates, and lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the two formats.
GUESSED = r"^\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*;\s*(\d+)(,?.+)?$"
GUESS = r", '(.+?)'(\d+)"
TABBED = r"^\s*(\d+) (\d+) (\d+) (\d+) ([0-9.]+)( SW)?\s*$"


def lines_of(responses: DataFrame, text: str) -> DataFrame:
    """responses with `k` and `line` of every line of a text."""
    return responses.select("*", F.posexplode(F.split(text, "\n")).alias("k", "line")).drop(text)


def tabbed_glyphs(lines: DataFrame) -> DataFrame:
    """Glyphs from `x y w h conf[ SW]<TAB>text`; SW opens a word. Other lines are dropped."""
    first, part = F.substring_index("line", "\t", 1), lambda k: F.regexp_extract(F.substring_index("line", "\t", 1), TABBED, k)
    found = lines.where(F.regexp_like(first, F.lit(TABBED)))
    box = [part(k).cast("double").alias(n) for k, n in enumerate(("x", "y", "w", "h"), 1)]
    glyph = F.substring(F.col("line"), F.length(first) + 2, F.length("line"))
    return found.select(*[c for c in lines.columns if c != "line"], *box, (part(6) != "").alias("sw"), glyph.alias("best"), part(5).cast("double").alias("conf"), F.lit(1).alias("guesses"))


def guessed_glyphs(lines: DataFrame) -> DataFrame:
    """Glyphs from `x y w h; g, 'a'conf, 'b'conf`; without guesses `best` is null, and lines that don't fit are dropped."""
    part = lambda k: F.regexp_extract("line", GUESSED, k)
    found = lines.where(F.regexp_like("line", F.lit(GUESSED)))
    box = [part(k).cast("double").alias(n) for k, n in enumerate(("x", "y", "w", "h"), 1)]
    marks, confs = (F.regexp_extract_all(part(6), F.lit(GUESS), F.lit(k)) for k in (1, 2))
    return found.select(*[c for c in lines.columns if c != "line"], *box, F.lit(False).alias("sw"), F.try_element_at(marks, F.lit(1)).alias("best"), F.try_element_at(confs, F.lit(1)).cast("double").alias("conf"), F.size(marks).alias("guesses"))


def unrotated(glyphs: DataFrame, width: Column, height: Column, angle: Column, scale: Column, reduced: Column) -> DataFrame:
    """Glyph boxes back in the image: turned by `angle` about the middle of a width x height picture, then scaled."""
    cx, cy = F.col("x") + F.col("w") / 2 - width / 2, F.col("y") + F.col("h") / 2 - height / 2
    rx = (cx * F.cos(angle) - cy * F.sin(angle) + width / 2) / reduced
    ry = (cx * F.sin(angle) + cy * F.cos(angle) + height / 2) / reduced
    w, h = F.col("w") / reduced / scale, F.col("h") / reduced / scale
    return glyphs.withColumns({"x": rx / scale - w / 2, "y": ry / scale - h / 2, "w": w, "h": h})


def text_lines(glyphs: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, text) of the lines (keys, line, cx, cy, angle, low, high, x0, x1): the glyphs in the line's tilted band and its range.

    low and high are the band's edges beside the line's axis. Glyphs come by their right edges; a line holds some dozens of them.
    A line without glyphs has an empty text.
    """
    rcx, rcy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    axis = (rcx - F.col("cx")) * F.tan("angle") + F.col("cy")
    inside = (rcy > axis + F.col("low")) & (rcy < axis + F.col("high")) & (rcx > F.col("x0")) & (rcx < F.col("x1")) & F.col("best").isNotNull()
    hits = lines.join(glyphs.where("guesses > 0"), keys).where(inside)
    marks = F.sort_array(F.collect_list(F.struct((F.col("x") + F.col("w")).alias("edge"), "k", F.when(F.col("sw"), F.concat(F.lit(" "), "best")).otherwise(F.col("best")).alias("mark"))))
    texts = hits.groupBy(*keys, "line").agg(F.trim(F.array_join(F.transform(marks, lambda m: m["mark"]), "")).alias("text"))
    return lines.select(*keys, "line").join(texts, [*keys, "line"], "left").withColumn("text", F.coalesce("text", F.lit("")))
