"""Letters, lines, regions and pixels derived from the driver's tables by one rule, read by queries and their SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.session import table

Layers = list[dict[str, str]]

#: 50 letters on each page, in five rows of ten, with jitter.
LETTERS: Layers = [
    {
        "id": "p_partkey",
        "page": "p_partkey // 50",
        "row": "p_partkey % 50 // 10",
        "s": "p_size",
        "x0": "CAST(p_partkey % 10 * 14 + p_size % 5 AS DOUBLE)",
        "y0": "CAST(p_partkey % 50 // 10 * 24 + p_size * 7 % 4 AS DOUBLE)",
        "x1": "CAST(p_partkey % 10 * 14 + p_size % 5 + 5 + p_size % 7 AS DOUBLE)",
        "y1": "CAST(p_partkey % 50 // 10 * 24 + p_size * 7 % 4 + 9 + p_size * 3 % 9 AS DOUBLE)",
        "thickness": "CAST(1 + p_size % 4 AS DOUBLE)",
        "size": "CAST(8 + p_size * 11 % 60 AS DOUBLE)",
        "std": "CAST(p_size * 5 % 13 AS DOUBLE) / CAST(4 AS DOUBLE)",
    },
    {"*": "", "width": "x1 - x0 + 1", "height": "y1 - y0 + 1", "cx": "x0 + (x1 - x0) / 2", "cy": "y0 + (y1 - y0) / 2"},
]

#: 60 lines on each image, in three columns of four paragraphs of five lines.
LINES: Layers = [
    {"id": "o_orderkey", "u": "o_custkey % 97"},
    {
        "id": "id",
        "img": "id // 60",
        "col": "id % 3",
        "u": "u",
        "x0": "CAST(id % 3 * 220 + u % 6 AS DOUBLE)",
        "y0": "CAST(id % 60 // 3 * 22 + u % 3 + id % 60 // 15 * 18 AS DOUBLE)",
        "x1": "CAST(id % 3 * 220 + u % 6 + 170 + u % 40 AS DOUBLE)",
        "y1": "CAST(id % 60 // 3 * 22 + u % 3 + id % 60 // 15 * 18 + 11 + u % 5 AS DOUBLE)",
        "angle": "CAST(u % 7 - 3 AS DOUBLE) / CAST(50 AS DOUBLE)",
        "lettercount": "1 + u % 20",
        "lettersize": "CAST(10 + u % 5 AS DOUBLE) / CAST(5 AS DOUBLE)",
        "xheight": "CAST(7 + u % 4 AS DOUBLE)",
        "avgheight": "CAST(9 + u % 5 AS DOUBLE)",
        "lineheight": "CAST(14 + u % 5 AS DOUBLE)",
        "thickness": "CAST(1 + u % 3 AS DOUBLE)",
        "direction": "CASE WHEN u % 11 = 0 THEN -1 ELSE 1 END",
        "chunk": "(id % 60 // 3 * 22 + u % 3 + id % 60 // 15 * 18) // 160",
    },
    {"*": "", "width": "x1 - x0 + 1", "height": "y1 - y0 + 1", "cx": "x0 + (x1 - x0) / 2", "cy": "y0 + (y1 - y0) / 2", "area": "(x1 - x0) * (y1 - y0)"},
]

#: Images of 40 x 40 pixels with three colour channels.
PIXELS: Layers = [
    {"img": "o_orderkey // 1600", "y": "o_orderkey % 1600 // 40", "x": "o_orderkey % 40", "t": "CAST(floor(o_totalprice) AS BIGINT)"},
    {"*": "", "r": "t % 256", "g": "t // 7 % 256", "b": "t // 61 % 256"},
]

SOURCES = {"letters": ("part", LETTERS), "lines": ("orders", LINES), "pixels": ("orders", PIXELS)}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, layers = SOURCES[name]
    out = table(spark, sf_dir, source)
    for layer in layers:
        out = out.selectExpr(*["*" if n == "*" else f"{e.replace('//', 'DIV')} AS {n}" for n, e in layer.items()])
    return out


def sql(name: str) -> str:
    """`name AS (...)` for a WITH list."""
    source, layers = SOURCES[name]
    inner = source
    for layer in layers:
        inner = f"(SELECT {', '.join('*' if n == '*' else f'{e} AS {n}' for n, e in layer.items())} FROM {inner})"
    return f"{name} AS {inner}"
