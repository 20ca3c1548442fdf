"""Reader of layout documents (JSON with regions, lines, words and letters) and their flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BOX = "x0 double, y0 double, x1 double, y1 double, cx double, cy double, width double, height double, area double"
_NUM = lambda names: ", ".join(f"{n} double" for n in names.split())
LETTER = f"{_BOX}, {_NUM('size ratio ratio2 std mean medy markweight thickness')}, `group` int"


def _struct(fields: str) -> str:
    parts = [p.strip() for p in fields.split(", ")]
    return "struct<" + ", ".join(f"{name}:{kind}" for name, kind in (p.rsplit(" ", 1) for p in parts)) + ">"


WORD = f"struct<letters:array<{_struct(LETTER)}>, {_struct(_BOX)[7:]}"
LINE = (
    f"struct<words:array<{WORD}>, lettercount:int, direction:int, chunk:int, id:string, "
    f"{_struct(_NUM('lettersize size lineheight xheight avgheight angle thickness') + ', ' + _BOX)[7:]}"
)
REGION = (
    f"struct<lines:array<{LINE}>, direction:int, lettercount:int, id:string, finished:boolean, shimmer:bigint, "
    f"{_struct(_NUM('angle lineheight xheight lettersize thickness scale') + ', ' + _BOX)[7:]}"
)
SCHEMA = (
    f"chunks array<int>, src string, regions array<{REGION}>, "
    "_plaster map<string, struct<colors:array<array<string>>, x:int, y:int, width:int, height:int, finished:bigint>>"
)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Layout documents with an explicit schema: ids that are keys become a map, and mixed pairs stay text until `colors`."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def letters(documents: DataFrame) -> DataFrame:
    """One row for each letter, with region, line and word numbers."""
    regions = documents.select("src", F.posexplode("regions").alias("region", "r"))
    lines = regions.select("src", "region", F.col("r.id").alias("region_id"), F.posexplode("r.lines").alias("line", "l"))
    words = lines.select("src", "region", "region_id", "line", F.posexplode("l.words").alias("word", "w"))
    return words.select("src", "region", "region_id", "line", "word", F.posexplode("w.letters").alias("letter", "g")).select("src", "region", "region_id", "line", "word", "letter", "g.*")


def colors(documents: DataFrame) -> DataFrame:
    """(src, region_id, weight, rgb) of every colour row."""
    rows = documents.select("src", F.explode("_plaster").alias("region_id", "p")).select("src", "region_id", F.explode("p.colors").alias("c"))
    return rows.select("src", "region_id", F.col("c")[0].cast("int").alias("weight"), F.from_json(F.col("c")[1], "array<double>").alias("rgb"))


def write_regions(regions: DataFrame, path: str, key: str = "id") -> None:
    """One folder of JSON files for each document. Rows of a document are gathered by its key; a large one may take several files."""
    regions.repartition(key).write.mode("overwrite").partitionBy(key).json(path)
