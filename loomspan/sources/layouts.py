"""Lines of images as a data source `layouts`: a folder for each image, a file of JSON lines for each strip of it.

    spark.dataSource.register(Layouts)
    spark.read.format("layouts").load(folder).where("image = 'rose' AND strip < 3")
    lines.write.format("layouts").mode("append").save(folder)

A partition is one image's strip. Filters on image and strip are pushed: strips that they rule out are neither listed as partitions nor opened. Files are reached through
Arrow's file systems (local or shared paths, hdfs, s3). A writer's files count only when the whole job commits.
"""

from __future__ import annotations

import json
import math
import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

SIZE, HALO = 250, 90
LINE = "image string, strip int, region string, line string, x0 double, y0 double, x1 double, y1 double, lettercount int, direction int, text string"
_NAME = re.compile(r"strip-(\d+)-[^/]*\.json$")


def with_strips(lines: DataFrame, size: int = SIZE, halo: int = HALO) -> DataFrame:
    """lines (y0, y1, ...) once for each strip that they touch; strip k begins at k * (size - halo) and is `size` high, so neighbours overlap by `halo`."""
    step = size - halo
    first: Column = F.greatest(F.lit(0), F.floor((F.col("y0") - size) / step).cast("int") + 1)
    last: Column = F.greatest(first, F.floor(F.col("y1") / step).cast("int"))
    return lines.withColumn("strip", F.explode(F.sequence(first, last)))


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)


@dataclass
class Strip(InputPartition):
    image: str
    strip: int
    files: tuple[str, ...]


_TESTS = {
    EqualTo: lambda x, f: x == f.value,
    EqualNullSafe: lambda x, f: x == f.value,
    In: lambda x, f: x in f.value,
    GreaterThan: lambda x, f: x > f.value,
    GreaterThanOrEqual: lambda x, f: x >= f.value,
    LessThan: lambda x, f: x < f.value,
    LessThanOrEqual: lambda x, f: x <= f.value,
}


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.names, self.path, self.tests = schema.names, path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Tests of image and strip against values are decided by the listing; all others stay with Spark."""
        for f in filters:
            if type(f) in _TESTS and getattr(f, "attribute", None) in (("image",), ("strip",)):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, **place: Any) -> bool:
        return all(_TESTS[type(f)](place[f.attribute[0]], f) for f in self.tests if f.attribute[0] in place)

    def partitions(self) -> list[Strip]:
        store, root = _place(self.path)
        strips: dict[tuple[str, int], list[str]] = {}
        for folder in store.get_file_info(fs.FileSelector(root)):
            image = unquote(folder.base_name)
            if folder.type != fs.FileType.Directory or folder.base_name.startswith("_") or not self._wanted(image=image):
                continue
            for file in store.get_file_info(fs.FileSelector(folder.path)):
                if (m := _NAME.match(file.base_name)) and self._wanted(strip=int(m[1])):
                    strips.setdefault((image, int(m[1])), []).append(file.path)
        return [Strip(image, strip, tuple(sorted(files))) for (image, strip), files in sorted(strips.items())]

    def read(self, partition: Strip) -> Iterator[tuple]:
        if not isinstance(partition, Strip):
            return
        store, _ = _place(self.path)
        for path in partition.files:
            with store.open_input_stream(path) as stream:
                for line in stream.read().decode().splitlines():
                    row = json.loads(line) | {"image": partition.image, "strip": partition.strip}
                    yield tuple(row.get(c) for c in self.names)


@dataclass
class _Written(WriterCommitMessage):
    files: tuple[str, ...]


class _Writer(DataSourceWriter):
    def __init__(self, schema: StructType, path: str, overwrite: bool):
        if not {"image", "strip"} <= set(schema.names):
            raise ValueError("rows need an image and a strip")
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator) -> _Written:
        """One file for each run of rows of a strip; rows sorted by image and strip give one file each, and a task holds one strip's rows."""
        store, root = _place(self.path)
        files, held, key = [], [], None

        def flush() -> None:
            if held:
                folder = posixpath.join(root, quote(str(key[0]), safe=""))
                store.create_dir(folder, recursive=True)
                files.append(posixpath.join(folder, f"_strip-{key[1]}-{uuid.uuid4().hex}.json"))
                with store.open_output_stream(files[-1]) as out:
                    out.write(("\n".join(held) + "\n").encode())
                held.clear()

        for row in iterator:
            values = row.asDict(recursive=True)
            mine = (values.pop("image"), values.pop("strip"))
            if mine[0] is None or mine[1] is None:
                raise ValueError("a row has no image or no strip")
            if mine != key:
                flush()
                key = mine
            held.append(json.dumps({c: None if isinstance(v, float) and not math.isfinite(v) else v for c, v in values.items()}))
        flush()
        return _Written(tuple(files))

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = _place(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for file in store.get_file_info(fs.FileSelector(root, recursive=True)):
                if _NAME.match(file.base_name):
                    store.delete_file(file.path)
        for file in (f for m in messages if m for f in m.files):
            folder, _, name = file.rpartition("/")
            store.move(file, f"{folder}/{name[1:]}")

    def abort(self, messages: list[_Written | None]) -> None:
        store, _ = _place(self.path)
        for file in (f for m in messages if m for f in m.files):
            store.delete_file(file)


class Layouts(DataSource):
    """Options: path. Without a schema of one's own the columns are those of LINE; columns that a file lacks are null."""

    @classmethod
    def name(cls) -> str:
        return "layouts"

    def schema(self) -> str:
        return LINE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, self.options["path"], overwrite)


def register(spark) -> None:
    spark.dataSource.register(Layouts)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_layouts(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Write lines (image, strip, ...) so that a strip is one file, unless it is so large that adaptive execution splits it."""
    lines.repartition("image", "strip").sortWithinPartitions("image", "strip").write.format("layouts").mode(mode).save(path)
