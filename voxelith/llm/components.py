"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import scratch


def _lowest(edges: DataFrame) -> DataFrame:
    """The lowest neighbour of each ``a``. Spread anew, so that the join that follows deals both sides itself and can split a hub's rows."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).repartition(scratch.parts(edges.sparkSession))


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the node's lowest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    m = _lowest(both).select("a", F.least("a", "m").alias("m"))
    return both.join(m, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the lowest of them. In: a > b."""
    m = _lowest(edges)
    moved = edges.join(m, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(m.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Label the nodes of ``edges`` (two columns of bigint, any direction, repeats and self-links allowed).

    Returns (node, root): root is the lowest node reachable; a node that is its own root is left out. Rows with a null
    end are ignored; an empty table gives an empty table. Every star is one aggregation and one join, written to the
    shared folder, so neither nodes nor links ever meet in one task. Converges in O(log^2 n) rounds; beyond
    ``rounds`` it raises rather than return a partial labelling.
    """
    pair = edges.toDF("p", "q").where("p <> q")  # null ends drop out too
    e = scratch.table(pair.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct())
    state = _state(e)
    for _ in range(rounds):
        if not state[0]:
            break
        large = scratch.table(_large(e))
        small = scratch.table(_small(large))
        before, state = state, _state(small)
        scratch.drop(e.sparkSession, e)
        scratch.drop(e.sparkSession, large)
        e = small
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
