"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborist.storage import materialise

__all__ = ["WORD", "bucket_of", "components", "hash_bits", "materialise", "table"]

#: Words of the contracts, for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def hash_bits(text: Column, hex_digits: int) -> Column:
    """The first bits of the text's MD5 digest as a long, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, hex_digits), 16, 10).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the smallest node.

    Alternates large-star and small-star rounds, so the number of rounds follows the logarithm of
    the longest path. Both steps are one grouping for the smallest neighbour and one join with
    it. Groupings sum up before they shuffle; in the joins a node with very many neighbours is one key, which
    Spark's adaptive skew join splits. A round writes one table, with no more rows than it read, and needs no shuffle for
    distinct ones. Edges are read several times, so a stored table should be given. Nulls and self-loops are ignored.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    while True:
        both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
        ends = both.groupBy("x").agg(F.min("y").alias("low"), F.max("y").alias("high"))
        # done when every node that has a smaller neighbour has no other: all are stars
        if ends.where("low < x AND low < high").isEmpty():
            return ends.select(F.col("x").alias("node"), F.least("x", "low").alias("component"))
        # large star: every neighbour larger than x is linked to x's smallest neighbour or x itself
        least = ends.select("x", F.least("x", "low").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        # small star: the smaller neighbours of x, and x, are linked to the smallest of them
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        pairs = materialise(large.join(least, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y")))
