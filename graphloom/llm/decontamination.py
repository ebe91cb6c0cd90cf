"""Benchmark decontamination over a stored positional inverted index, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of the test side (terms, item positions) that may be broadcast: under 100 bytes each, so 30 MB at most.
BROADCAST_ROWS = 300_000


def cased_words(text: Column) -> Column:
    """The words of a text, in order, as written; null has none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN), "")


def lowered(word: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    return F.translate(word, UPPER, LOWER)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if its counted rows are few; else the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def build_index(docs: DataFrame, terms: DataFrame | None = None, n_terms: int = 1 << 62) -> DataFrame:
    """The stored index ``(term, doc_id, pos)``: every position (from 0) of every term, or of those in ``terms`` (a column term).

    Terms are folded as in the exact comparison: A-Z only, as lower() folds a
    letter by those around it. The table is written to shared storage, each document's
    postings in one file (the index is partitioned by document: phrases are
    within documents, so lists meet without moving a document's postings).
    """
    found = docs.select("doc_id", F.posexplode(cased_words(lowered(F.col("text")))).alias("pos", "term"))
    if terms is not None:
        found = found.join(bounded(terms.select("term").distinct(), n_terms), "term")
    return materialize(found.select("term", "doc_id", "pos"), "postings")[0]


def _items(benchmark: DataFrame, width: int) -> DataFrame:
    """``(item, item_id, words, length, span)``: numbered items that have words; span: words of a window."""
    base = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.transform(cased_words(F.col("text")), lowered).alias("words")).where(F.size("words") > 0)
    return base.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.size("words").alias("length"), F.least(F.size("words"), F.lit(width)).alias("span")).dropDuplicates(["item"])


def candidates(index: DataFrame, items: DataFrame, n_positions: int, lists: int = 2) -> DataFrame:
    """``(doc_id, item, shift)``: where, in each window's ``lists`` rarest terms, the offset-adjusted postings agree.

    ``shift`` is the document position of the item's word 0. Postings of a
    window's rarest terms only are read, each moved by its term's place in the
    item; a window is met where all of its lists hold the same shift.
    """
    placed = items.select("item", "span", "length", F.posexplode("words").alias("at", "term"))
    often = index.groupBy("term").agg(F.count("*").alias("df"))
    counted, _ = materialize(placed.join(often, "term").select("item", "span", "length", "at", "term", "df"), "terms")
    lost = placed.join(counted.select("item", "at"), ["item", "at"], "left_anti").select("item", "span", "at")  # words that no document has
    window = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("span") + 1), F.least(F.col("at"), F.col("length") - F.col("span")))).alias("window")
    dead = placed.select("item", "length", "span", "at").join(lost.select("item", "at"), ["item", "at"], "left_semi").select("item", window).distinct()
    rarest = counted.select("item", "at", "term", "df", window).join(dead, ["item", "window"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("item", "window").orderBy("df", "at"))).where(F.col("rank") <= lists)
    needs = rarest.groupBy("item", "window").agg(F.sort_array(F.collect_list("at")).alias("needs")).select("item", "needs").distinct().groupBy("item").agg(F.collect_list("needs").alias("needs"))
    anchors, _ = materialize(rarest.select("item", "at", "term").distinct(), "anchors")
    shifted = index.join(bounded(anchors, n_positions), "term").select("doc_id", "item", (F.col("pos") - F.col("at")).alias("shift"), "at")
    agreed = shifted.groupBy("doc_id", "item", "shift").agg(F.collect_set("at").alias("seen"))
    met = agreed.join(bounded(needs, n_positions), "item").where(F.exists("needs", lambda n: F.size(F.array_except(n, F.col("seen"))) == 0))
    return met.select("doc_id", "item", "shift")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 8, least_items: int = 2, carry: list[str] | None = None) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items, contaminated, wide_items)`` of every row of ``docs``.

    ``carry`` names columns of ``docs`` that are returned in a struct ``row``.

    A window is ``width`` consecutive words of a benchmark item; an item of
    fewer words, but not none, is one window. ``n_hit`` counts the document's
    words inside any occurrence of a window, ``items`` the ids (as strings,
    sorted, distinct) of items with an occurrence, ``wide_items`` how many of
    these have ``width`` words or more; contaminated from ``least_items`` on.
    Null texts and items have no words; repeated rows each give the same row;
    a null id is a document like others; items that repeat an id count once;
    an empty benchmark hits nothing; other columns are ignored.
    """
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.col("text"))
    row = row if not carry or "text" in carry else F.struct(*[F.col(c) for c in carry], F.col("text"))
    base = docs.select(F.col("doc_id"), row.alias("row"))
    items, _ = materialize(_items(benchmark, width), "items")
    n_positions = items.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    terms = items.select(F.explode("words").alias("term")).distinct()
    index = build_index(docs.select("doc_id", "text"), terms, n_positions)
    found = candidates(index, items, n_positions).groupBy("doc_id", "item").agg(F.collect_list("shift").alias("shifts"))
    n_items = items.count()
    # an item's words go once to a document, however often it repeats the item
    listed = found.join(bounded(items.select("item", "item_id", "words", "span"), n_items if n_positions <= 20 * BROADCAST_ROWS else n_positions), "item").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "words", "span", "shifts")).alias("found"))
    listed = listed.withColumnRenamed("doc_id", "found_id")
    joined = base.join(listed, base.doc_id.eqNullSafe(F.col("found_id")), "left").select("doc_id", "row", F.array(cased_words(F.col("row.text"))).alias("bound"), "found")

    def occurrences(words: Column, c: Column) -> Column:
        same = lambda shift: F.transform(c["words"], lambda w, j: F.coalesce(lowered(F.get(words, shift + j)) == w, F.lit(False)))
        starts = lambda m: F.filter(F.sequence(F.lit(0), F.size(m) - c["span"]), lambda s: ~F.exists(F.slice(m, s + 1, c["span"]), lambda x: ~x))
        places = lambda shift: F.flatten(F.transform(F.transform(F.array(same(shift)), starts)[0], lambda s: F.sequence(shift + s, shift + s + c["span"] - 1)))
        return F.struct(c["item_id"].alias("item_id"), (F.size(c["words"]) >= width).alias("wide"), F.array_distinct(F.flatten(F.transform(c["shifts"], places))).alias("at"))

    # the words are bound to a lambda variable, so that they are split once
    checked = F.transform("bound", lambda words: F.struct(F.size(words).cast("long").alias("n_words"), F.when(F.col("found").isNotNull(), F.filter(F.transform("found", lambda c: occurrences(words, c)), lambda o: F.size(o["at"]) > 0)).alias("hits")))[0]
    out = joined.select("doc_id", "row", checked.alias("c")).select("doc_id", "row", "c.n_words", F.coalesce("c.hits", F.expr("cast(array() as array<struct<item_id:string,wide:boolean,at:array<int>>>)")).alias("hits"))
    out = out.withColumn("items", F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.coalesce(h["item_id"], F.lit(""))))))
    wide = F.size(F.array_distinct(F.transform(F.filter("hits", lambda h: h["wide"]), lambda h: h["item_id"])))
    return out.select("doc_id", "n_words", F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["at"])))).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.size("items") >= least_items).alias("contaminated"), wide.cast("long").alias("wide_items"), *([F.struct(*[F.col(f"row.{c}") for c in carry]).alias("row")] if carry else []))


def proximity(index: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """``(phrase_id, doc_id, first, last)``: where all terms of a phrase stand, in order, within its length + ``slop`` positions.

    ``phrases`` has phrase_id and terms (an array, folded as in the index).
    The rarest term's postings are met with those of the others near it.
    """
    placed = phrases.select("phrase_id", F.size("terms").alias("length"), F.posexplode("terms").alias("at", "term"))
    counted = placed.join(index.groupBy("term").agg(F.count("*").alias("df")), "term")
    full = counted.groupBy("phrase_id", "length").agg(F.count("*").alias("n"), F.min_by("at", F.struct("df", "at")).alias("anchor")).where("n = length")
    wanted = counted.join(full.select("phrase_id", "anchor"), "phrase_id")
    posted = index.join(wanted, "term").select("phrase_id", "doc_id", "pos", "at", "length", "anchor")
    heads = posted.where("at = anchor").select("phrase_id", "doc_id", F.col("pos").alias("head"))
    near = posted.join(heads, ["phrase_id", "doc_id"]).where(F.abs(F.col("pos") - F.col("head")) < F.col("length") + slop)
    lists = near.groupBy("phrase_id", "doc_id", "head", "length", "anchor").agg(F.sort_array(F.collect_set(F.struct("at", "pos"))).alias("seen"))
    # left of the anchor the latest position before the next term, right of it the earliest after the one before
    step = lambda ok, pick: lambda acc, at: F.when(acc.isNotNull(), pick(F.transform(F.filter("seen", lambda x: (x["at"] == at) & ok(x["pos"], acc)), lambda x: x["pos"])))
    none = F.expr("cast(null as int)")
    left = F.aggregate(F.when(F.col("anchor") > 0, F.reverse(F.sequence(F.lit(0), F.col("anchor") - 1))).otherwise(F.expr("cast(array() as array<int>)")), F.col("head"), lambda acc, at: F.coalesce(step(lambda p, a: p < a, F.array_max)(acc, at), none))
    right = F.aggregate(F.when(F.col("anchor") < F.col("length") - 1, F.sequence(F.col("anchor") + 1, F.col("length") - 1)).otherwise(F.expr("cast(array() as array<int>)")), F.col("head"), lambda acc, at: F.coalesce(step(lambda p, a: p > a, F.array_min)(acc, at), none))
    return lists.select("phrase_id", "doc_id", left.alias("first"), right.alias("last"), "length").where(F.col("last") - F.col("first") < F.col("length") + slop).select("phrase_id", "doc_id", "first", "last").distinct()
