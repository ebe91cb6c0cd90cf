"""Line intervals: the symbol around a line, hunks over symbols, unified diffs, snapshots compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def containing_symbol(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """``points`` (pid, file_path, line) with ``symbol``: the narrowest around the line, first start_line, then ord; null if none.

    Symbols (id, file_path, start_line, end_line, ord) with start_line 0 are
    left out. The file is the hash key of a range join; only the least of the
    meeting symbols is kept by a map-side minimum.
    """
    spans = symbols.where("start_line > 0").select(F.col("file_path").alias("f"), "start_line", "end_line", "id", "ord")
    met = points.join(spans, (F.col("file_path") == F.col("f")) & (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line")))
    best = met.groupBy("pid").agg(F.min_by("id", F.struct(F.col("end_line") - F.col("start_line"), "start_line", "ord", "id")).alias("symbol"))
    return points.join(best, "pid", "left")


def diff_hunks(lines: DataFrame) -> DataFrame:
    """``(file_path, start, end)``: new-side ranges of a unified diff given as ``(line_no, line)``.

    A diff is one bounded text (the query caps it), so one ordered window finds
    each hunk's file.
    """
    path = F.regexp_extract("line", r"^diff --git a/.+ b/(.+)$", 1)
    marked = lines.withColumn("file_path", F.last(F.when(path != "", path), ignorenulls=True).over(Window.orderBy("line_no")))
    head = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start, n = F.regexp_extract("line", head, 1), F.regexp_extract("line", head, 2)
    hunks = marked.where(start != "").select("file_path", start.cast("long").alias("start"), F.greatest(F.lit(1), F.coalesce(F.nullif(n, F.lit("")).cast("long"), F.lit(1))).alias("n"))
    return hunks.where("file_path is not null").select("file_path", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def diff_text(spark, text: str, most: int = 100_000) -> DataFrame:
    """``(line_no, line)`` of a diff of at most ``most`` characters."""
    if len(text) > most:
        raise ValueError(f"diff longer than {most} characters")
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line_no long, line string")


def overlapping(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols that some hunk (file_path, start, end) overlaps, each once."""
    h = hunks.select(F.col("file_path").alias("hf"), F.col("start").alias("hs"), F.col("end").alias("he"))
    return symbols.where("start_line > 0").join(h, (F.col("file_path") == F.col("hf")) & (F.col("start_line") <= F.col("he")) & (F.col("end_line") >= F.col("hs")), "left_semi")


def structural_diff(base: DataFrame, current: DataFrame, base_edges: DataFrame | None = None, current_edges: DataFrame | None = None, fields: tuple[str, ...] = ("content", "signature", "start_line", "end_line")) -> DataFrame:
    """``(entity, kind, id)``: nodes added, removed or modified in ``fields``, and edges added or removed, by id."""
    mark = lambda df: df.select("id", F.xxhash64(*fields).alias("h"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    a, b = mark(base).alias("a"), mark(current).alias("b")
    differs = F.lit(False)
    for i in range(len(fields)):
        differs = differs | ~F.col(f"a.f{i}").eqNullSafe(F.col(f"b.f{i}"))
    both = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    kind = F.when(F.col("a.id").isNull(), "added").when(F.col("b.id").isNull(), "removed").when(differs, "modified")
    out = both.select(F.lit("node").alias("entity"), kind.alias("kind"), F.coalesce("a.id", "b.id").alias("id")).where("kind is not null")
    if base_edges is not None:
        x, y = base_edges.select("rel_id").distinct(), current_edges.select("rel_id").distinct()
        edge = lambda df, k: df.select(F.lit("edge").alias("entity"), F.lit(k).alias("kind"), F.col("rel_id").alias("id"))
        out = out.unionByName(edge(y.join(x, "rel_id", "left_anti"), "added")).unionByName(edge(x.join(y, "rel_id", "left_anti"), "removed"))
    return out
