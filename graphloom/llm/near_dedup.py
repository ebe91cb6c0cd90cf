"""Near-duplicate classes by min-max hashing, each link confirmed on the whole shingle sets.

Every distinct shingle set gives, under each of a few dozen random
permutations, its smallest and its largest value: two signature entries for
one hash evaluation, each equal in two sets with a chance of their Jaccard
similarity. Bands of entries are the buckets of a locality-sensitive index.
Buckets only gather sets into coarse clusters (each member is tied to the
bucket's smallest one, so no pairs are listed). Within a cluster the sets meet
in random blocks of bounded size, where a matrix product gives the exact
intersection sizes of all pairs; then one set a class found so far, until few
classes are left; and last those members of different classes that share a
bucket. So a cluster of many near copies costs in proportion to its size, and
no link between two classes is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged
from .components import connected_components
from .ragged import U64
from .storage import materialize, small_batches, unused

#: Signature entries at most, and the chance to miss a pair at the threshold, for which bands are chosen.
ENTRIES, MISS = 192, 1e-6
#: Of one block: sets and shingles at most.
BLOCK_DOCS, BLOCK_WORDS = 1000, 400_000
#: Shingles that are compared at once.
SLICE = 1 << 20


def bands_for(percent: int) -> tuple[int, int]:
    """``(rows, bands)``: the most entries a band, of at most ENTRIES in all, that miss a pair at ``percent`` with a chance below MISS."""
    similar, best = min(max(percent, 1), 99) / 100, None
    for rows in range(1, 13):
        bands = int(np.ceil(np.log(MISS) / np.log1p(-(similar**rows))))
        bands += rows * bands % 2
        if best is None or rows * bands <= ENTRIES:
            best = rows, bands
    return best


def sets_of(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows with the distinct shingle hashes of each row and their counts."""
    data, offsets = ragged.flat_bytes(column)
    for low, high in ragged.slices(offsets):
        part, edges = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, counts = ragged.words(part, edges, ragged.SPACED)
        made = ragged.shingles(ragged.word_hashes(part, starts, ends), counts, width)
        yield low, high, *ragged.distinct_by_row(*made)


def set_keys(values: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """24 bytes that name each set: two sums of mixed hashes and the size; None for an empty set."""
    full = counts > 0
    keys = np.full(len(counts), None, object)
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        a = np.add.reduceat(ragged.mix(values), starts)
        b = np.add.reduceat(ragged.mix(values ^ U64(0xD1B54A32D192ED03)), starts)
        for i, key in zip(np.flatnonzero(full).tolist(), np.stack([a, b, counts[full].astype(np.uint64)], 1)):
            keys[i] = key.tobytes()
    return keys.tolist()


def min_max_bands(values: np.ndarray, counts: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """Band keys (documents x bands) of the non-empty sets, from rows * bands / 2 permutations."""
    permutations = rows * bands // 2
    draw = np.random.default_rng(86028157)
    scale = draw.integers(0, 1 << 63, permutations, dtype=np.uint64) * U64(2) + U64(1)
    shift = draw.integers(0, 1 << 63, permutations, dtype=np.uint64)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    signature = np.empty((len(starts), 2 * permutations), np.uint64)
    for k in range(permutations):
        seen = values * scale[k] + shift[k]
        signature[:, 2 * k] = np.minimum.reduceat(seen, starts)
        signature[:, 2 * k + 1] = np.maximum.reduceat(seen, starts)
    keys = np.zeros((len(starts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band + 1, np.uint64)
        for entry in range(rows):  # entries of one permutation fall into different bands
            key = ragged.mix(key * U64(0x9E3779B97F4A7C15) + signature[:, entry * bands + band])
        keys[:, band] = key
    return keys


def signatures(docs: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """``(doc_id, n_shingles, set_key, bands)`` of ``(doc_id, text)``; set_key is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, values, counts in sets_of(batch.column(1), width):
                lists = [None] * len(counts)
                if len(values):
                    for i, keys in zip(np.flatnonzero(counts).tolist(), min_max_bands(values, counts, rows, bands).view(np.int64)):
                        lists[i] = keys
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(counts, pa.int64()), pa.array(set_keys(values, counts), pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def with_keys(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, text, set_key)`` of ``(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, values, counts in sets_of(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns), pa.array(set_keys(values, counts), pa.binary())], names=["doc_id", "text", "set_key"])

    return docs.mapInArrow(run, "doc_id long, text string, set_key binary")


def shingled(texts: DataFrame, width: int) -> DataFrame:
    """``(cluster, vertex, shingles)`` of ``(cluster, vertex, text)``: the distinct hashes as unsigned 64-bit numbers in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, values, counts in sets_of(batch.column(2), width):
                ends = np.concatenate([[0], np.cumsum(counts)]) * 8
                held = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), held.cast(pa.binary())], names=["cluster", "vertex", "shingles"])

    return texts.select("cluster", "vertex", "text").mapInArrow(run, "cluster long, vertex long, shingles binary")


def linked_rows(values: np.ndarray, counts: np.ndarray, percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as row pairs, of the links among these sets (only of those between labels, where given)."""
    n = len(counts)
    rows = np.repeat(np.arange(n, dtype=np.int32), counts)
    common = np.zeros((n, n), np.float32)
    parts = -(-len(values) // SLICE)
    for part in range(parts):  # a range of hashes at a time, so that long texts need no more memory
        if parts == 1:
            seen, of = values, rows
        else:
            inside = (values // U64((1 << 64) // parts + 1)) == U64(part)
            seen, of = values[inside], rows[inside]
        order = np.argsort(seen, kind="stable")
        seen, of = seen[order], of[order]
        fresh = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]])) if len(seen) else np.zeros(0, np.int64)
        often = np.diff(fresh, append=len(seen))
        shared = np.repeat(often > 1, often)
        if not shared.any():
            continue
        code, of = np.repeat(np.cumsum(often > 1) - 1, often)[shared], of[shared]
        heads = of[np.flatnonzero(np.diff(code, prepend=-1))]
        place = np.empty(len(heads), np.int64)
        place[np.argsort(heads, kind="stable")] = np.arange(len(heads))  # columns of the same sets stand together
        code = place[code]
        order = np.argsort(code, kind="stable")
        code, of = code[order], of[order]
        for low in range(0, len(heads), 2048):
            a, b = np.searchsorted(code, [low, low + 2048])
            present, at = np.unique(of[a:b], return_inverse=True)
            block = np.zeros((len(present), min(2048, len(heads) - low)), np.float32)
            block[at, code[a:b] - low] = 1
            common[np.ix_(present, present)] += block @ block.T
    sizes = counts.astype(np.float32)
    linked = (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)) & (common > 0)
    if label is not None:
        linked &= label[:, None] != label[None, :]
    forest, unseen = [], np.ones(n, bool)
    for root in range(n):
        if unseen[root]:
            unseen[root] = False
            reach = [root]
            while reach:
                at = reach.pop()
                new = np.flatnonzero(linked[at] & unseen)
                unseen[new] = False
                forest += [(at, x) for x in new.tolist()]
                reach += new.tolist()
    return forest


def block_links(column: pa.Array, width: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest, as row pairs, of the links among these texts."""
    parts = [(v, c) for _, _, v, c in sets_of(column, width)]
    return linked_rows(np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts]), percent)


def held_sets(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all rows and their counts."""
    held = column.combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    return np.frombuffer(held.buffers()[2], np.uint64, (offsets[-1] - offsets[0]) // 8, offsets[0]), np.diff(offsets) // 8


def joined(ids: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """The least id of each row's class; ``pairs`` is a forest."""
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            a, b = (a, b) if ids[a] < ids[b] else (b, a)
            parent[b] = a
    return ids[[root(x) for x in range(len(ids))]]


def blocks_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, blocks)`` of the groups of ``(*keys, shingles)`` that don't fit into one block."""
    docs, words = F.count("*"), F.sum(F.expr("octet_length(shingles) div 8"))
    wanted = F.greatest(F.ceil(docs * 2 / F.lit(BLOCK_DOCS)), F.ceil(words * 2 / F.lit(BLOCK_WORDS))).cast("long")
    return rows.groupBy(*keys).agg(docs.alias("docs"), words.alias("words"), wanted.alias("blocks")).where((F.col("docs") > BLOCK_DOCS) | (F.col("words") > BLOCK_WORDS)).select(*keys, "blocks")


def met_in_blocks(rows: DataFrame, large: DataFrame | None, percent: int, salt: int) -> DataFrame:
    """``(cluster, vertex, class)`` of ``(cluster, vertex, shingles)``: exact classes within each (random) block of a cluster."""

    def meet(table: pa.Table) -> pa.Table:
        ids = table.column("vertex").to_numpy()
        found = linked_rows(*held_sets(table.column("shingles")), percent) if len(ids) > 1 else []
        return pa.table({"cluster": table.column("cluster"), "vertex": ids, "class": joined(ids, found)})

    block = F.lit(0).cast("long")
    if large is not None:
        rows = rows.join(large, "cluster", "left")
        block = F.when(F.col("blocks").isNull(), block).otherwise(F.pmod(F.xxhash64("vertex", F.lit(salt)), F.col("blocks")))
    return rows.select("cluster", "vertex", "shingles", block.alias("block")).groupBy("cluster", "block").applyInArrow(meet, "cluster long, vertex long, class long")


def classes_within(sets: DataFrame, keyed: DataFrame, percent: int) -> DataFrame:
    """``(vertex, class)``: the exact classes of the sets ``(cluster, vertex, shingles)``; ``keyed`` holds their ``(vertex, key)``.

    Clusters of one block are settled by it. Of the others, one set a class
    meets those of the other classes until they fit into a block or get hardly
    fewer; what is left are classes whose links no block held. Their members
    that share a bucket with another class meet: all but those of the main class
    with each other, and with those of the main class.
    """
    n = sets.count()
    large, _ = materialize(blocks_of(sets, ["cluster"]), "blocks", n // BLOCK_DOCS)
    if large.isEmpty():
        return met_in_blocks(sets, None, percent, 7).select("vertex", "class")
    state, _ = materialize(met_in_blocks(sets, large, percent, 7), "classes", 200 * n)
    small = state.join(large, "cluster", "left_anti").select("vertex", "class")
    state = state.join(large, "cluster", "left_semi")
    for salt in range(8, 40):
        heads, _ = materialize(state.where("vertex = class").select("vertex").join(sets, "vertex"), "heads", n // 10)
        crowded, _ = materialize(blocks_of(heads, ["cluster"]), "blocks", n // BLOCK_DOCS)
        merged, _ = materialize(met_in_blocks(heads, crowded, percent, salt), "merged")
        before, after = heads.count(), merged.select("class").distinct().count()
        if after < before:
            new = merged.where("vertex <> class").select(F.col("vertex").alias("class"), F.col("class").alias("root"))
            state, _ = materialize(state.join(new, "class", "left").select("cluster", "vertex", F.coalesce("root", "class").alias("class")), "classes", n)
        if crowded.isEmpty() or after > 0.8 * before:
            break
    known = keyed.join(state, "vertex")
    mixed = known.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
    active, _ = materialize(known.join(mixed, "key", "left_semi").select("cluster", "vertex", "class").distinct(), "active", n)
    if active.isEmpty():
        return small.union(state.select("vertex", "class"))
    edges, _ = materialize(links_between(active.join(sets.select("vertex", "shingles"), "vertex"), percent), "links")
    roots = connected_components(edges, rows=n).withColumnsRenamed({"id": "class", "component": "root"})
    return small.union(state.join(roots, "class", "left").select("vertex", F.coalesce("root", "class").alias("class")))


def links_between(active: DataFrame, percent: int) -> DataFrame:
    """``(src, dst)``: classes with a link between members, of ``(cluster, vertex, class, shingles)``."""
    sized = active.groupBy("cluster", "class").agg(F.count("*").alias("n"))
    main = sized.groupBy("cluster").agg(F.max_by("class", F.struct("n", "class")).alias("main"))
    sided = active.join(main, "cluster").withColumn("side", (F.col("class") == F.col("main")).cast("int"))
    words = F.sum(F.expr("octet_length(shingles) div 8"))
    shares = sided.groupBy("cluster").agg(*[F.greatest(F.ceil(F.count(one) * 2 / F.lit(BLOCK_DOCS)), F.ceil(F.sum(F.when(F.col("side") == i, F.expr("octet_length(shingles) div 8"))) * 2 / F.lit(BLOCK_WORDS)), F.lit(1)).cast("long").alias(name) for i, name in ((0, "few"), (1, "many")) for one in (F.when(F.col("side") == i, 1),)])
    shares, _ = materialize(shares, "shares")
    placed = sided.join(shares, "cluster").withColumn("own", F.pmod(F.xxhash64("vertex", F.lit(5)), F.when(F.col("side") == 1, F.col("many")).otherwise(F.col("few"))))
    pair = lambda a, b, kind: F.struct(a.alias("a"), b.alias("b"), F.lit(kind).alias("kind"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    own = F.col("own")
    others = F.concat(F.transform(upto("few"), lambda k: pair(F.least(k, own), F.greatest(k, own), 0)), F.transform(upto("many"), lambda k: pair(own, k, 1)))
    meets = F.when(F.col("side") == 1, F.transform(upto("few"), lambda k: pair(k, own, 1))).otherwise(others)
    dealt = placed.select("cluster", "vertex", "class", "shingles", F.explode(meets).alias("p")).select("cluster", "vertex", "class", "shingles", "p.*")

    def meet(table: pa.Table) -> pa.Table:
        label = table.column("class").to_numpy()
        found = linked_rows(*held_sets(table.column("shingles")), percent, label) if len(label) > 1 else []
        pairs = np.unique(np.sort(label[np.asarray(found, np.int64).reshape(-1, 2)], axis=1), axis=0)
        return pa.table({"src": pairs[:, 0], "dst": pairs[:, 1]})

    return dealt.groupBy("cluster", "kind", "a", "b").applyInArrow(meet, "src long, dst long")


@dataclass(frozen=True)
class Classified:
    #: (doc_id, n_shingles, set_key) a row of the documents; set_key is null for an empty set.
    marks: DataFrame
    #: (set_key, vertex, least, root): a distinct set, its number, its least id, and the number that names its class.
    sets: DataFrame
    #: Whether some id is null or repeated.
    odd: bool


def classified(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, rows: int | None, bands: int | None) -> Classified:
    small_batches(docs.sparkSession)
    if rows is None or bands is None:
        rows, bands = bands_for(percent)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks, _ = materialize(signatures(base, width, rows, bands), "signatures")
    repeated, _ = materialize(marks.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "repeated")
    odd = not repeated.isEmpty()
    own = marks.withColumn("own", F.col("doc_id"))
    if odd:
        again = repeated.select(F.col("doc_id").alias("again"), F.lit(True).alias("many"))
        own = marks.join(again, F.col("doc_id").eqNullSafe(F.col("again")), "left").withColumn("own", F.when(F.col("many").isNull(), F.col("doc_id")))
    # a set is numbered by the least id that is one row's alone; without one, by a hash
    sets = own.where("set_key is not null").groupBy("set_key").agg(F.min("own").alias("rep"), F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    sets, _ = materialize(sets.withColumn("vertex", F.coalesce("rep", F.xxhash64("set_key"))), "sets", 16 * marks.count())
    n_sets = sets.count()
    keyed = sets.select("vertex", F.explode("bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("vertex").alias("head"), F.max("vertex").alias("tail")).where("head < tail").select("key", "head")
    stars = keyed.join(heads, "key").where("vertex <> head").select(F.col("vertex").alias("src"), F.col("head").alias("dst"))
    clusters, _ = materialize(connected_components(stars, rows=n_sets).withColumnsRenamed({"id": "vertex", "component": "cluster"}), "clusters", n_sets)
    marks, plain = marks.drop("bands"), sets.select("set_key", "vertex", "least")
    if clusters.isEmpty():
        return Classified(marks, plain.withColumn("root", F.col("vertex")), odd)
    members = clusters.join(sets.select("vertex", "set_key", "rep"), "vertex")
    if odd:
        members, _ = materialize(members, "members")
    texts = base.join(members.where("rep is not null").select(F.col("rep").alias("doc_id"), "cluster", "vertex"), "doc_id").select("cluster", "vertex", "text")
    if odd:
        keys = with_keys(base, width).join(members.where("rep is null").select("set_key", "cluster", "vertex"), "set_key")
        texts = texts.union(keys.groupBy("cluster", "vertex").agg(F.min("text").alias("text")))
    held, _ = materialize(shingled(texts, width), "shingles", 60 * n_sets)
    classes, _ = materialize(classes_within(held, keyed, percent), "classes", n_sets)
    return Classified(marks, plain.join(classes, "vertex", "left").select("set_key", "vertex", "least", F.coalesce("class", "vertex").alias("root")), odd)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, rows: int | None = None, bands: int | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer
    than ``width`` words has its whole sequence as its one shingle; a null or
    empty text has no shingles and is alone in its class. Two rows are linked
    when 100 * |A and B| >= percent * |A or B|; ``component_id`` is the least
    id reachable over links (null if all are), ``kept`` tells whether it is the
    row's own. Equal sets are one vertex, so any number of copies costs one row.
    Rows that repeat an id, or have none, are compared each by its own text. Other
    columns are ignored; no rows give no rows. Shingles are compared by 64-bit
    hashes. ``rows`` and ``bands`` follow from ``percent``.
    """
    found = classified(docs, id_col, text_col, width, percent, rows, bands)
    if found.odd:
        sets, _ = materialize(found.sets, "classes")
        component = sets.join(sets.groupBy("root").agg(F.min("least").alias("component")), "root").select("set_key", "component")
    else:
        component = found.sets.select("set_key", F.col("root").alias("component"))
    own = found.marks.join(component.withColumn("in_class", F.lit(True)), "set_key", "left")
    component = F.when(F.col("in_class"), F.col("component")).otherwise(F.col("doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate class: of least id (null ids last), then of least set key, then the least row.

    Rows without words are linked with nothing and all stay. Links are those of
    ``near_duplicates``: rows that repeat an id, or have none, are compared each
    by its own text, so none goes but for a row of its class that stays. All
    columns must be orderable where ids repeat. No rows give no rows.
    """
    found = classified(docs, id_col, text_col, width, percent, None, None)
    if not found.odd:
        name = unused(docs, "kept")
        chosen = found.marks.join(found.sets.select("set_key", "root"), "set_key", "left").where("root is null or root = doc_id").select(F.col("doc_id").alias(name))
        return docs.join(chosen, F.col(id_col).cast("long") == F.col(name), "left_semi")
    last = (1 << 63) - 1
    order = F.struct(F.coalesce("least", F.lit(last)).alias("place"), "set_key")
    chosen, _ = materialize(found.sets.groupBy("root").agg(F.min(order).alias("o")).select("o.place", "o.set_key"), "chosen")
    wordless = F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    held = docs.where(~wordless).select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("place"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, values, counts in sets_of(batch.column(2), width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(set_keys(values, counts), pa.binary())], names=["row", "place", "set_key"])

    keyed = held.mapInArrow(run, T.StructType([held.schema["row"], T.StructField("place", T.LongType()), T.StructField("set_key", T.BinaryType())]))
    return keyed.join(chosen, ["place", "set_key"], "left_semi").groupBy("place", "set_key").agg(F.min("row").alias("row")).select("row.*").union(docs.where(wordless))

