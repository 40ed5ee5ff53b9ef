"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairn.llm.scratch import Scratch


def _star(pairs: DataFrame, wanted) -> DataFrame:
    """Links of the nodes beside u that are ``wanted`` to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u").where(wanted).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def settled(links: DataFrame) -> bool:
    """Whether every node has one link to a node that has none: then each component is a star around its least node."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down")).union(links.select(F.col("v").alias("node"), F.lit(0).alias("down")))
    of = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return of.where("down > 1 OR (down = 1 AND least = 0)").isEmpty()


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of ``links`` (u, v): the least node of its component.

    Every step is a grouped minimum, which combines before the shuffle, and an equi
    join, which adaptive execution splits where a node has very many links; a
    round never makes more links than there are.  Rounds go on until every component
    is a star, as many as a chain of any length takes.  The links are written once a
    round, so a lost executor costs one round at most.
    """
    links = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = scratch.save(links, "star-0")
    k = 0
    while not settled(links):
        k += 1
        both = _both_ways(links)
        large = _star(both, F.col("v") > F.col("u")).where("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        links = scratch.save(small.where("u != v").distinct(), f"star-{k}")
        scratch.release()
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
