"""I-Match document fingerprints over randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a chosen
band. Each of several random subsets of the lexicon gives one 16-bit hash of
the sorted distinct terms that a document shares with it; subsets come in
halving densities, so that documents of any length have some in which they
hold only a few terms. The likeness of two documents is the share of their
lexicon terms that are common, estimated from which subsets are empty, equal
and different: a subset that meets l terms of both on average is equal with
chance exp(-l (1 - share)) - exp(-l), and empty with exp(-l).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .ragged import U64
from .sharding import id_bounds
from .storage import small_batches

#: Subsets a density, and densities: a subset of density d holds a lexicon term with chance 2**-d.
DRAWS, DENSITIES = 10, 11
#: Document frequencies of lexicon terms, as shares of all documents.
MIN_SHARE, MAX_SHARE = 0.0005, 0.3
#: Lexicon terms that may go to every executor (8 bytes each).
MAX_LEXICON = 8_000_000


def term_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows with the distinct term hashes of each row and their counts."""
    data, offsets = ragged.flat_bytes(column)
    for low, high in ragged.slices(offsets):
        part, edges = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, counts = ragged.words(part, edges, ragged.ALNUM)
        yield low, high, *ragged.distinct_by_row(ragged.word_hashes(part, starts, ends), counts)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``(term, df)``: of every term hash, the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df, fresh, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merged():
            both = np.concatenate([terms, *fresh])
            weights = np.concatenate([df, np.ones(len(both) - len(terms), np.int64)])
            out, where = np.unique(both, return_inverse=True)
            return out, np.bincount(where, weights, len(out)).astype(np.int64)

        def batch_of(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b)], names=["term", "df"])

        for batch in batches:
            for _, _, values, _ in term_hashes(batch.column(0)):
                fresh.append(values)
                held += len(values)
                if held > 2_000_000:
                    terms, df = merged()
                    fresh, held = [], 0
                    if len(terms) > 2_000_000:  # bounds the worker's memory; the sums are made after the shuffle
                        yield batch_of(terms, df)
                        terms, df = terms[:0], df[:0]
        terms, df = merged()
        yield batch_of(terms, df)

    return docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> np.ndarray:
    """Sorted hashes of the terms with ``min_share <= df / documents <= max_share`` (and df >= 2).

    Its size has a proven bound: the terms with df >= s * N number at most the
    mean count of distinct terms a document over s, whatever the corpus' size.
    """
    small_batches(docs.sparkSession)
    n = docs.count()
    low, high = max(2, int(np.ceil(min_share * n))), max(2, int(max_share * n))
    chosen = document_frequencies(docs).where(F.col("df").between(low, high)).select("term")
    found = np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in chosen.toArrow().to_batches())])
    if len(found) > MAX_LEXICON:
        raise ValueError(f"{len(found)} lexicon terms: raise min_share")
    return np.sort(found.view(np.uint64))


def imatch(values: np.ndarray, counts: np.ndarray, terms: np.ndarray, draws: int, densities: int) -> np.ndarray:
    """Fingerprints (rows x draws * densities, uint16); 0 where a subset holds no term of the row."""
    rows = np.repeat(np.arange(len(counts)), counts)
    if len(terms):
        at = np.minimum(np.searchsorted(terms, values), len(terms) - 1)
        held = terms[at] == values
    else:
        held = np.zeros(len(values), bool)
    bare = (counts > 0) & (np.bincount(rows[held], minlength=len(counts)) == 0)
    held |= bare[rows]  # a text without lexicon terms: all its terms
    values, rows = values[held], rows[held]
    out = np.zeros((len(counts), draws * densities), np.uint16)
    if not len(values):
        return out
    for draw in range(draws):
        seeded = ragged.mix(values + U64(0xA24BAED4963EE407 * (draw + 1) % (1 << 64)))
        content, of = ragged.mix(seeded), rows
        for density in range(densities):
            if density:  # halves what is left
                inside = seeded & U64(1 << (density - 1)) == 0
                seeded, content, of = seeded[inside], content[inside], of[inside]
            if not len(of):
                break
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            total = ragged.mix(np.add.reduceat(content, starts))  # an order-free hash of the sorted distinct terms
            out[of[starts], draw * densities + density] = np.maximum(total >> U64(48), U64(1)).astype(np.uint16)
    return out


def _chances(densities: int) -> tuple[np.ndarray, np.ndarray]:
    """Log chances of empty, equal and different subsets (3 * densities x hypotheses), and each hypothesis' share."""
    terms, share = 2 ** np.arange(0, densities + 3, 0.5), np.arange(0, 51) / 50
    met = terms[:, None, None] / 2.0 ** np.arange(densities)
    apart = np.exp(-met * (1 - share[None, :, None]))
    empty = np.broadcast_to(-met, apart.shape)
    logs = [empty, np.log(np.maximum(apart - np.exp(-met), 1e-12)), np.log(np.maximum(1 - apart, 1e-12))]
    return np.concatenate(logs, 2).reshape(-1, 3 * densities).T.astype(np.float32), np.tile(share, len(terms))


def likeness(a: np.ndarray, b: np.ndarray, densities: int = DENSITIES) -> np.ndarray:
    """The most likely share of common terms, by row (of equally likely ones the least); 1 for equal fingerprints."""
    a, b = (x.reshape(len(x), -1, densities) for x in (a, b))
    used, same = (a != 0) | (b != 0), a == b
    seen = np.concatenate([(~used).sum(1), (same & used).sum(1), (~same).sum(1)], 1).astype(np.float32)
    logs, share = _chances(densities)
    out = np.empty(len(a))
    for low in range(0, len(a), 4096):
        fits = (seen[low : low + 4096] @ logs).reshape(-1, len(share) // 51, 51).max(1)
        out[low : low + 4096] = fits.argmax(1) / 50
    return np.where(same.all((1, 2)), 1.0, np.minimum(out, 0.98))


def hexed(prints: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in prints.astype(">u2")]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: np.ndarray | None = None, draws: int = DRAWS, densities: int = DENSITIES) -> DataFrame:
    """``(doc_id, fingerprint)`` of every row.

    Terms are runs of digits, letters and non-ASCII bytes, A-Z lower-cased.
    Null counts as empty; an empty text (or one without terms) has the
    fingerprint of zeros; a text without lexicon terms uses all its terms.
    ``terms`` defaults to the lexicon of ``docs``. Repeated rows each give a
    row, ids may be null, other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    terms = lexicon(base) if terms is None else terms
    shared = base.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        for batch in batches:
            for low, high, values, counts in term_hashes(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(hexed(imatch(values, counts, shared.value, draws, densities)), pa.string())], names=["doc_id", "fingerprint"])

    return base.mapInArrow(run, "doc_id long, fingerprint string")


def edited_likeness(docs: DataFrame, terms: np.ndarray | None = None, draws: int = DRAWS, densities: int = DENSITIES, part: int = 3) -> DataFrame:
    """Each text's fingerprint, that of its edited text and the likenesses to it and to the next text.

    Next: in descending (doc_id, text), after the last comes the first. Edited:
    the last floor(n_chars / part) code points give way to the next text's
    first as many, or all. Rows with a null id come last and follow their
    order by text; a lone row is its own next.

    Texts are shuffled once: id ranges are streamed in order, and the first
    text of a range goes, once more, to the end of the range before it.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    terms = lexicon(base) if terms is None else terms
    spark, nothing = base.sparkSession, -(1 << 63)
    bounds, shared = id_bounds(base), spark.sparkContext.broadcast(terms)

    def span_of(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        keys = ids.cast(pa.int64()).fill_null(nothing).to_numpy()
        return keys, len(bounds) - np.searchsorted(bounds, keys, "right")  # range 0 has the greatest ids

    def spans(batches):
        for batch in batches:
            keys, of = span_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(keys)], names=["span", "top"])

    tops = {r[0]: r[1] for r in base.select("doc_id").mapInArrow(spans, "span int, top long").groupBy("span").agg(F.max("top")).collect()}  # a row a range
    order = sorted(tops)
    before = {span: order[i - 1] for i, span in enumerate(order)}  # of the first: the last

    def deal(batches):
        for batch in batches:
            keys, of = span_of(batch.column(0))
            columns = [batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(of, pa.int32()), pa.array(np.zeros(len(of), np.int32)), pa.array(keys)], names=["doc_id", "text", "span", "tail", "key"])
            first = np.flatnonzero(keys == np.asarray([tops[x] for x in of.tolist()], np.int64))
            if len(first):
                at = pa.array(first)
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in columns), pa.array([before[x] for x in of[first].tolist()], pa.int32()), pa.array(np.ones(len(first), np.int32)), pa.array(keys[first])], names=["doc_id", "text", "span", "tail", "key"])

    def prints(texts: list[str]) -> np.ndarray:
        return np.concatenate([imatch(values, counts, shared.value, draws, densities) for _, _, values, counts in term_hashes(pa.array(texts, pa.large_string()))])

    def run(batches):
        waiting: list[tuple] = []
        for batch in batches:
            rows = waiting + list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            waiting = rows[-1:]
            low = 0
            while low < len(rows) - 1:
                high, size = low, 0
                while high < len(rows) - 1 and (high == low or size < 4_000_000):
                    size += len(rows[high][1])
                    high += 1
                some = rows[low : high + 1]
                low = high
                own = [i for i in range(len(some) - 1) if not some[i][3]]
                if not own:
                    continue
                texts = [r[1] for r in some]
                edits = [t[: len(t) - len(t) // part] + texts[i + 1][: len(t) // part] for i in own for t in (texts[i],)]
                plain, edited = prints(texts), prints(edits)
                mine, after = plain[own], plain[np.asarray(own) + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([some[i][0] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()), pa.array(hexed(mine), pa.string()), pa.array(hexed(edited), pa.string()), pa.array(likeness(mine, edited, densities)), pa.array(likeness(mine, after, densities))],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    ranges = max(1, len(order))  # dealt by range with room to spare, each span has a task of its own
    streamed = base.mapInArrow(deal, "doc_id long, text string, span int, tail int, key long").repartitionByRange(3 * ranges, "span").sortWithinPartitions("span", "tail", F.desc("key"), F.desc("text")).select("doc_id", "text", "span", "tail")
    return streamed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
