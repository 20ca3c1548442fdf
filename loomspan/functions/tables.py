"""Clusters and thresholds as SQL table functions, and predicates given as SQL text.

    register(spark)
    predicate(spark, "beside", "STRUCT<x0 DOUBLE, x1 DOUBLE>", "a.x0 - b.x1 BETWEEN 0 AND 3")
    SELECT * FROM equivalence_classes(TABLE(SELECT a.id AS a, b.id AS b, img FROM ...))
    SELECT * FROM otsu_cluster(TABLE(SELECT gap, line FROM gaps))

The functions ask for their table to be partitioned by its further columns, the keys (without any, for one partition), and read a partition row by row. otsu_cluster keeps a count for each whole value, equivalence_classes an entry for each node of its partition; for groups without a bound
use loomspan.operators.graph.connected_components, which spreads one group over tasks.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn, udtf
from pyspark.sql.types import LongType, StructType


def _with_keys(table: AnalyzeArgument, own: int, results: list[str]) -> AnalyzeResult:
    """The columns of a table behind its first `own` ones, by which it is partitioned, then results."""
    if not table.isTable or len(table.dataType.fields) < own:
        raise ValueError(f"a table with at least {own} columns is asked for")
    schema = StructType(table.dataType.fields[own:])
    for name in results:
        schema = schema.add(name, LongType())
    keys = [PartitioningColumn(f"`{f.name}`") for f in table.dataType.fields[own:]]
    return AnalyzeResult(schema=schema, withSinglePartition=not keys, partitionBy=keys)


@udtf
class EquivalenceClasses:
    """(keys..., node, component) of a table (a, b, keys...): the least node that a node is joined with over pairs of equal keys. A pair with a null end is ignored; one of equal ends gives its node."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _with_keys(table, 2, ["node", "component"])

    def __init__(self) -> None:
        self.parents: dict[tuple, dict[int, int]] = defaultdict(dict)

    def eval(self, row: Row) -> None:
        a, b, *keys = row
        if a is None or b is None:
            return
        parent = self.parents[tuple(keys)]

        def root(node: int) -> int:
            while parent.setdefault(node, node) != node:
                parent[node] = parent[parent[node]]
                node = parent[node]
            return node

        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    def terminate(self) -> Iterator[tuple]:
        for keys, parent in self.parents.items():
            for node in sorted(parent):  # a parent is no larger than its child, so it is settled before it
                parent[node] = parent[parent[node]]
                yield (*keys, node, parent[node])


@udtf
class OtsuCluster:
    """(keys..., threshold, n) of a table (value, keys...): the whole value that parts the values of equal keys best, the first of ties; 0 where they are all of one whole value. Null values don't count."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _with_keys(table, 1, ["threshold", "n"])

    def __init__(self) -> None:
        self.bins: dict[tuple, dict[int, int]] = defaultdict(lambda: defaultdict(int))

    def eval(self, row: Row) -> None:
        value, *keys = row
        if value is not None:
            self.bins[tuple(keys)][math.floor(value)] += 1

    def terminate(self) -> Iterator[tuple]:
        for keys, bins in self.bins.items():
            total, whole = sum(bins.values()), sum(b * n for b, n in bins.items())
            best, threshold, count, upto = 0.0, 0, 0, 0
            for b in sorted(bins)[:-1]:
                count, upto = count + bins[b], upto + b * bins[b]
                apart = upto / count - (whole - upto) / (total - count)
                if (between := round(count * (total - count) * apart * apart, 3)) > best:
                    best, threshold = between, b
            yield (*keys, threshold, total)


def predicate(spark: SparkSession, name: str, kind: str, condition: str) -> None:
    """A temporary SQL function name(a, b) of two structs of type `kind`, true where the SQL text `condition` on a and b is."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a {kind}, b {kind}) RETURNS BOOLEAN RETURN coalesce({condition}, false)")


def register(spark: SparkSession) -> None:
    spark.udtf.register("equivalence_classes", EquivalenceClasses)
    spark.udtf.register("otsu_cluster", OtsuCluster)
