"""Iterative operators over links: components by large-star and small-star rounds, greedy one-to-one matching.

Each round is joins and aggregations over the links alone, written to the shared folder, so that lineage stays short and a
lost executor costs one round at most. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import folder, remove, state, written


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def roots(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(u, v): every linked id that isn't its component's smallest, with that smallest id. Nulls link nothing."""
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = written(pairs, "links", **state("u", "v"))
    while edges.measured["n"]:
        large = written(_large(edges), "large")
        after = written(_small(large), "links", **state("u", "v"))
        same = after.measured == edges.measured
        remove(edges, large)
        edges = after
        if same:
            break
    return edges


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each of `vertices` (id) reaches over `links` (a, b)."""
    e = roots(links)
    return vertices.join(e, vertices["id"] == e["u"], "left").select("id", F.coalesce("v", "id").alias("component"))


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs (i, j, d) as a scan by (d, i, j) would take them: pairs that are the least for both sides, round by
    round; taken pairs are written once and not read again."""
    spark, key, base, rounds = pairs.sparkSession, F.struct("d", "i", "j"), folder(pairs.sparkSession, "matched"), 0
    pairs = pairs.select("i", "j", "d")
    left = written(pairs, "pairs", n=F.count(F.lit(1)))
    while left.measured["n"]:
        best = left.join(left.groupBy("i").agg(F.min(key).alias("bi")), "i").join(left.groupBy("j").agg(F.min(key).alias("bj")), "j")
        path = f"{base}/round={rounds}"
        best.where((F.col("bi.j") == F.col("j")) & (F.col("bj.i") == F.col("i"))).select("i", "j", "d").write.parquet(path)
        best = spark.read.schema(pairs.schema).parquet(path)
        after = left.join(best.select("i"), "i", "left_anti").join(best.select("j"), "j", "left_anti").select("i", "j", "d")
        after, rounds = written(after, "pairs", n=F.count(F.lit(1))), rounds + 1
        remove(left)
        left = after
    return spark.read.schema(pairs.schema).parquet(*[f"{base}/round={r}" for r in range(rounds)]) if rounds else left
