"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, materialize


def _large(edges: DataFrame, rows: int) -> tuple[DataFrame, str]:
    """Hang each vertex's larger neighbours on the smallest vertex it knows.

    The smallest ones are a table of their own (whose path is returned), so that
    both sides of the join are plain exchanges, and a hub is split.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least, path = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), F.least("u", "m").alias("m")), "least", rows)
    return both.where("v > u").join(least, F.col("u") == F.col("lu")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), path


def _small(edges: DataFrame) -> DataFrame:
    """Hang each vertex and its smaller neighbours on the smallest of these; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), "m")
    met = edges.join(least, F.col("u") == F.col("lu")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.union(least.select(F.col("lu").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """``(id, component)`` for every end of an edge; component = its smallest member.

    ``src`` and ``dst`` may be of any ordered type. Edges with a null end and
    loops name no component (a vertex that only loops has no row); repeated
    edges count once; no edges give no rows. Each round is written to shared
    storage, so a lost executor costs at most one round, and nothing but two
    counts comes to the driver. A hub is only ever aggregated (with partial
    minima) or joined (which adaptive execution can split). ``rows`` is about
    how many edges there are, if known.
    """
    start = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    spark = edges.sparkSession
    now, path = materialize(start.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", rows)
    state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        if not state[0]:
            break
        hung, least_path = _large(now, 2 * state[0])
        new, new_path = materialize(_small(hung), "edges", 2 * state[0])
        after = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(spark, path)
        drop(spark, least_path)
        now, path = new, new_path
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
