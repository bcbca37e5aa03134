"""Connected components of an edge list, distributed and restartable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.scratch import discard, materialize, shuffled


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a BIGINT, b BIGINT)`` links -> ``(node, root)``, root being the smallest node of the component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each keeps at most as many
    links as before and ends, after a number of rounds that is logarithmic in practice, in one star per
    component. Minima are pre-aggregated before they are shuffled, and the joins that spread them are plain
    equi-joins that adaptive execution splits when one node has very many links. Every round is written to the
    shared folder. Self-links, repeated links, both orientations and an empty input are fine; links with a
    null end are dropped.
    """
    links = materialize(_oriented(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), "links")
    before = None
    while True:
        old, links = links, materialize(_small_star(_large_star(links)), "links")
        discard(old)
        after = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _oriented(links: DataFrame) -> DataFrame:
    """Distinct links with a > b."""
    return (
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).withColumn("m", F.least("n", "m"))
    return _oriented(both.where("b > a").join(shuffled(low), F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    moved = links.join(shuffled(low), F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.union(low.select(F.col("n").alias("a"), F.col("m").alias("b"))))
