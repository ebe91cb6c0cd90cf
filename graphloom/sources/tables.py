"""Graphs derived from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_calls(spark: SparkSession, sf_dir: str, top: int = 2) -> DataFrame:
    """``calls`` edges (src, dst, n, rk, confidence, kind): the ``top`` suppliers that follow each most often within an order.

    Confidence is the count over the supplier's largest; kind names the most
    frequent return flag of the lines that lead to the next.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_returnflag").alias("flag"))
    # a line's least flag comes first; both windows need the one sort behind the one shuffle, where an aggregate would sort what each task scans
    within = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", F.asc_nulls_last("flag"))
    last = F.lag(F.struct("l_linenumber", "l_suppkey")).over(within)
    lines = lines.withColumn("again", F.coalesce(last.eqNullSafe(F.struct("l_linenumber", "l_suppkey")), F.lit(False))).where("not again")
    follows = lines.select(F.col("l_suppkey").alias("src"), "flag", F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")).alias("dst"))
    counted = follows.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("flag").alias("kind"))
    w = Window.partitionBy("src")
    return counted.select("src", "dst", "n", "kind", F.row_number().over(w.orderBy(F.desc("n"), "dst")).alias("rk"), (F.col("n") / F.max("n").over(w)).alias("confidence")).where(F.col("rk") <= top)


def hierarchy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, label, name)`` of regions, nations, customers and orders."""
    rows = [("region", "r_regionkey", F.col("r_name")), ("nation", "n_nationkey", F.col("n_name")), ("customer", "c_custkey", F.col("c_name")), ("orders", "o_orderkey", F.col("o_orderkey").cast("string"))]
    parts = [table(spark, sf_dir, t).select(F.concat_ws(":", F.lit(t), F.col(k)).alias("id"), F.lit(t).alias("label"), n.alias("name")) for t, k, n in rows]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contains`` edges (src, dst, rel_type) by foreign key."""
    rows = [("nation", "region", "n_regionkey", "n_nationkey"), ("customer", "nation", "c_nationkey", "c_custkey"), ("orders", "customer", "o_custkey", "o_orderkey")]
    parts = [table(spark, sf_dir, t).select(F.concat_ws(":", F.lit(p), F.col(fk)).alias("src"), F.concat_ws(":", F.lit(t), F.col(k)).alias("dst"), F.lit("contains").alias("rel_type")) for t, p, fk, k in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(commit_id, file_path)``: the event types of each user and day, as the files of a commit."""
    return table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("commit_id"), F.col("event_type").alias("file_path"))


def supplier_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(commit_id, file_path)``: the suppliers of each order."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("commit_id"), F.col("l_suppkey").cast("string").alias("file_path"))
