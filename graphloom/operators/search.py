"""Retrieval: BM25, fuzzy and exact names, vectors, rank fusion, grouping by process."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def inverted_index(docs: DataFrame, id_col: str, text: Column, partition: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``postings(part, id, term, tf, length)`` and ``stats(part, n, mean_length)``; one explode and one partial sum."""
    part = F.lit("") if partition is None else partition
    split = docs.select(part.alias("part"), F.col(id_col).alias("id"), tokens(text).alias("t")).withColumn("length", F.size("t"))
    postings = split.select("part", "id", "length", F.explode("t").alias("term")).groupBy("part", "id", "term", "length").agg(F.count("*").alias("tf"))
    return postings, split.groupBy("part").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))


def query_words(query: str | Sequence[str]) -> list[str]:
    return re.findall(r"[^\W_]+", query.lower()) if isinstance(query, str) else [w.lower() for w in query]


def ranked(hits: DataFrame, stats: DataFrame, limit: int | None, partitioned: bool) -> DataFrame:
    """``(id, score)`` by BM25 from all postings of the query's terms: the ``limit`` best, of each partition if ``partitioned``; all for None."""
    df = hits.groupBy("part", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = hits.join(df, ["part", "term"]).join(stats, "part").groupBy("part", "id").agg(F.sum(weight).alias("score"))
    if limit is None:
        return scored.select("id", "score")
    if not partitioned:
        return scored.select("id", "score").orderBy(F.desc(F.round("score", 9)), "id").limit(limit)
    w = Window.partitionBy("part").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).select("id", "score")


def bm25(docs: DataFrame, id_col: str, text: Column, query: str | Sequence[str], limit: int | None, partition: Column | None = None) -> DataFrame:
    """``(id, score)``: the ``limit`` best of each partition; document frequencies and lengths hold within it.

    Reads the texts; the index is restricted to the query's terms before anything
    is shuffled. ``bm25_stored`` answers from postings instead.
    """
    words = query_words(query)
    part = F.lit("") if partition is None else partition
    split = docs.select(part.alias("part"), F.col(id_col).alias("id"), tokens(text).alias("t")).withColumn("length", F.size("t"))
    stats = split.groupBy("part").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    hits = split.select("part", "id", "length", F.explode(F.filter("t", lambda w: w.isin(words))).alias("term")).groupBy("part", "id", "length", "term").agg(F.count("*").alias("tf"))
    return ranked(hits, stats, limit, partition is not None)


def bm25_stored(postings: DataFrame, stats: DataFrame, query: str | Sequence[str], limit: int | None, partitioned: bool = True) -> DataFrame:
    """``bm25`` from ``inverted_index``; the terms are pushed into the scan of postings."""
    return ranked(postings.where(F.col("term").isin(query_words(query))), stats, limit, partitioned)


def searchable(nodes: DataFrame) -> tuple[DataFrame, Column]:
    """The nodes that full-text search covers, and their text: a name stands for itself four times, so that it outranks a mention in a longer text."""
    return nodes.where(~F.col("label").isin("folder", "community", "process")), F.concat_ws(" ", *(["name"] * 4), "content", "signature")


def node_index(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``postings`` and ``stats`` of all searchable nodes, a part a label."""
    kept, text = searchable(nodes)
    return inverted_index(kept, "id", text, F.col("label"))


def search_nodes(nodes: DataFrame, query: str, limit: int, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Full-text search of name, content and signature, an index a label; tests count half, functions and classes outside tests 1.2 times.

    ``index`` is the stored ``node_index`` of the same nodes.
    """
    kept, text = searchable(nodes)
    scored = bm25(kept, "id", text, query, limit, F.col("label")) if index is None else bm25_stored(*index, query, limit)
    found = scored.join(kept.select("id", "name", "file_path", "label", snippet().alias("snippet")), "id")
    in_tests, testish = F.col("file_path").contains("/tests/"), F.col("file_path").contains("/test_")
    factor = F.when(in_tests | testish, 0.5).otherwise(1.0) * F.when(F.col("label").isin("function", "class") & ~in_tests, 1.2).otherwise(1.0)
    return found.withColumn("score", F.col("score") * factor).orderBy(F.desc("score"), "id").limit(limit)


def snippet() -> Column:
    return F.substring(F.coalesce(F.nullif("content", F.lit("")), "signature"), 1, 200)


def fuzzy(rows: DataFrame, id_col: str, name_col: str, query: str, limit: int, distance: int = 2) -> DataFrame:
    """``(id, name, score)`` of names within ``distance`` edits; score max(0.3, 1 - 0.3 d)."""
    d = F.levenshtein(F.lower(name_col), F.lit(query.lower()), distance)
    return rows.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), d.alias("d")).where("d >= 0").select("id", "name", F.greatest(F.lit(0.3), 1 - F.col("d") * 0.3).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def exact_name(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """``(id, score)``: a plain name, or Class.member (of several dots the last two parts count); tests score 1, others 2."""
    head, _, tail = query.rpartition(".")
    owner = head.rpartition(".")[2]
    match = F.col("name") == query
    if owner and tail and query.count(".") == 1:
        match = (F.col("name") == tail) & (F.col("class_name") == owner)
    elif owner and tail:
        match = F.col("name") == tail
    score = F.when(F.col("file_path").contains("/tests/"), 1.0).otherwise(2.0)
    return nodes.where(match).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_topk(vectors: DataFrame, id_col: str, vec_col: str, query: Sequence[float], limit: int) -> DataFrame:
    """``(id, score)`` by exact cosine, as a top-k of one scan; vectors of another dimension raise."""
    q = F.lit([float(x) for x in query]).cast("array<double>")
    ok = F.assert_true(F.size(vec_col) == len(query), f"vectors must have {len(query)} numbers")
    return vectors.where(ok.isNull()).select(F.col(id_col).alias("id"), cosine(F.col(vec_col), q).alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(limit)


def reciprocal_ranks(lists: Sequence[tuple[DataFrame, float]], limit: int, k: int = 60) -> DataFrame:
    """``(id, score)``: the sum over lists (id, score; best first) of weight / (k + rank); ties keep list, then rank order.

    The lists are top-k results, so ranking them in one window is bounded.
    """
    if limit <= 0:
        return lists[0][0].select("id", "score").limit(0)
    parts = [df.select("id", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")).alias("rank"), F.lit(w).alias("w"), F.lit(i).alias("src")) for i, (df, w) in enumerate(lists)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy("id").agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"), F.min(F.struct("src", "rank")).alias("first"))
    return fused.orderBy(F.desc(F.round("score", 12)), "first").limit(limit).select("id", "score")


def hybrid(fts: DataFrame, fuzzy_hits: DataFrame, vector: DataFrame, limit: int, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Full-text and vector hits fused; fuzzy ones stand in if full text finds nothing."""
    chosen = fts.select("id", "score").unionByName(fuzzy_hits.select("id", "score").where(F.lit(fts.isEmpty())))
    return reciprocal_ranks([(chosen, weights[0]), (vector, weights[1])], limit)


def group_by_process(hits: DataFrame, membership: DataFrame) -> DataFrame:
    """``(process, first_rank, ids)``: hits (id, rank) under their first process (id, process, ord), groups in hit order."""
    first = membership.groupBy("id").agg(F.min_by("process", F.struct("ord", "process")).alias("process"))
    placed = hits.join(first, "id", "left").select("id", "rank", F.coalesce("process", F.lit("Other results")).alias("process"))
    lists = placed.groupBy("process").agg(F.min("rank").alias("first_rank"), F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("l"))
    return lists.select("process", "first_rank", F.transform("l", lambda x: x["id"]).alias("ids"))


def embed(texts: DataFrame, model, dimension: int, batch: int = 8) -> DataFrame:
    """``(id, vec)`` of ``texts`` (id, text) by ``model``, a function from a list of texts to as many vectors, called on ``batch`` at a time.

    A batch that the model fails on yields nothing, so search falls back to
    words; vectors of another dimension raise.
    """
    import pandas as pd

    def run(batches):
        for pdf in batches:
            ids, vectors = [], []
            for low in range(0, len(pdf), batch):
                part = pdf.iloc[low : low + batch]
                try:
                    made = [[float(x) for x in v] for v in model(part.text.tolist())]
                except Exception:  # the model is the caller's
                    continue
                if any(len(v) != dimension for v in made):
                    raise ValueError(f"vectors must have {dimension} numbers")
                ids += part.id.tolist()
                vectors += made
            yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "vec": pd.Series(vectors, dtype=object)})

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInPandas(run, f"id {kind}, vec array<float>")
