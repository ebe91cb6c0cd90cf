"""Change coupling: files that change in the same commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coupling(commits: DataFrame, max_files: int = 50, min_cochanges: int = 3, min_strength: float = 0.3) -> DataFrame:
    """``(a, b, co_changes, strength)``, a < b, of ``commits`` (commit_id, file_path).

    Commits of more than ``max_files`` distinct files make no pairs but count
    in the files' totals; strength is co-changes over the larger total. Pairs
    come from one array a commit, bounded by ``max_files``.
    """
    files = commits.select("commit_id", "file_path").distinct()
    totals = files.groupBy("file_path").agg(F.count("*").alias("total"))
    lists = files.groupBy("commit_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("file_path")).alias("f")).where((F.col("n") > 1) & (F.col("n") <= max_files))
    pairs = lists.select(F.posexplode("f").alias("i", "a"), "f").select("a", F.explode(F.slice(F.col("f"), F.col("i") + 2, F.lit(max_files))).alias("b"))
    co = pairs.groupBy("a", "b").agg(F.count("*").alias("co_changes")).where(F.col("co_changes") >= min_cochanges)
    total = lambda c: totals.select(F.col("file_path").alias(c), F.col("total").alias(f"t{c}"))
    most = F.greatest("ta", "tb")
    return co.join(total("a"), "a").join(total("b"), "b").select("a", "b", "co_changes", F.when(most > 0, F.col("co_changes") / most).otherwise(0.0).alias("strength")).where(F.col("strength") >= min_strength)


def coupled_with(pairs: DataFrame, of: DataFrame, imports: DataFrame, min_strength: float = 0.3) -> DataFrame:
    """``(id, other, strength, co_changes, hidden)``: partners in either direction; hidden without an import from id to other."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "strength", "co_changes").union(pairs.select("b", "a", "strength", "co_changes"))
    known = imports.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(True).alias("known")).distinct()
    return both.join(of.select("id"), "id", "left_semi").where(F.col("strength") >= min_strength).join(known, ["id", "other"], "left").select("id", "other", "strength", "co_changes", F.col("known").isNull().alias("hidden"))
