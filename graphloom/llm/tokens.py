"""Token-id files: Re-Pair compressed blocks of whole documents in ascending id order, with random access.

Format, one Parquet row a block: ``shard`` (id range), ``block`` (its
number there), ``earlier`` (ids in the shard's blocks before), the ids, token counts and offsets in the compressed sequence
of its documents, ``rules`` as little-endian unsigned 32-bit numbers, and
``body``: the low 16 bits of all ``symbols`` symbols, then a plane of bits (8 to a byte) for each
higher bit that the greatest symbol of the block needs. Symbols below ``base`` are token ids; symbol base + k stands for
rule k, the pair (left, right) of earlier symbols; ``widths`` holds the
expansion length of each rule. A document's symbols begin at its offset, as
no rule spans two documents: it can be decoded alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .sharding import ranges_of
from .storage import small_batches

END_ID = 2
#: Ids of a block, and the size of its table of pairs (which only sieves; any size gives the same rules).
BLOCK_IDS, SLOT_BITS = 2_000_000, 18
SCHEMA = "shard int, block int, earlier long, base long, doc_ids array<long>, sizes array<long>, offsets array<long>, rules binary, widths binary, symbols long, body binary"


def with_end(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of several texts with END_ID after each."""
    out = np.empty(len(ids) + len(counts), np.uint32)
    last = np.cumsum(counts + 1) - 1
    own = np.ones(len(out), bool)
    own[last] = False
    out[last] = END_ID
    out[own] = ids
    return out


def leftmost(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Whether each ascending position is the first, third, ... of its run; ``following`` are the next positions."""
    place = np.arange(len(at))
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != following[:-1]
    return (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0


def repair(ids: np.ndarray, ends: np.ndarray, base: int, rounds: int | None = None, least: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rules, widths, symbols)`` for ids; ``ends`` are the documents' end positions, which no pair spans.

    Each round counts neighbouring pairs, overlaps of a pair with itself once,
    and gives every pair of ``least`` occurrences a rule. Where two such pairs
    overlap, the more frequent one is replaced; a pair that is left with fewer
    than ``least`` places waits for a later round. Only pairs with a new symbol,
    or with places that were left over, can have become frequent, so a round
    counts these; when it finds none, one more counts all. It ends when no pair
    occurs ``least`` times, or after ``rounds`` if given.
    """
    body = ids.astype(np.uint32)
    closing = np.zeros(len(body), bool)
    closing[ends - 1] = True
    rules, widths = [np.zeros((0, 2), np.uint32)], np.ones(base, np.uint32)
    near = after = None  # where pairs are counted (None: everywhere), and the symbol after each (None: that at the next place)
    while rounds is None or len(rules) <= rounds:
        if len(body) < 2:
            break
        found = _frequent(body, closing, near, after, least)
        if found is None:
            if near is None:
                break
            if after is not None:
                body, closing, after = body[alive], closing[alive], None
            near = None
            continue
        keys, counts, at, of = found
        rank = np.empty(len(keys), np.int32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(keys))
        second = at + 1 if after is None else after[at]
        r, beside = rank[of], at[1:] == second[:-1]
        wins = np.ones(len(at), bool)
        wins[1:] &= ~(beside & (r[:-1] < r[1:]))
        wins[:-1] &= ~(beside & (r[1:] < r[:-1]))
        used = np.bincount(of[wins], minlength=len(keys)) >= least
        wins &= used[of]
        rest, with_rest = at[~wins], second[~wins]
        at, second, of = at[wins], second[wins], (np.cumsum(used) - 1)[of[wins]]
        keys = keys[used]
        new = np.stack([keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        body[at] = (len(widths) + of).astype(np.uint32)
        widths = np.concatenate([widths, widths[new[:, 0]] + widths[new[:, 1]]])
        rules.append(new)
        closing[at] = closing[second]
        # next are counted: places of and before a new symbol, and those that were left over whole
        if after is None:
            kept = np.ones(len(body), bool)
            kept[second] = False
            marked = np.zeros(len(body) + 1, bool)
            marked[at] = True
            whole = rest[kept[rest] & kept[with_rest] & ~marked[rest] & ~marked[with_rest]]
            marked[:-1] |= kept & marked[1:]
            marked[whole] = True
            near = np.flatnonzero(marked[:-1][kept])
            body, closing = body[kept], closing[kept]
            near = near[near < len(body) - 1]
            if len(near) < len(body) // 8:  # from here on symbols are unlinked, not moved up
                after, before = np.arange(1, len(body) + 1), np.arange(-1, len(body))
                alive, touched = np.ones(len(body), bool), np.zeros(len(body) + 1, bool)
        else:
            alive[second] = False
            after[at] = after[second]
            before[after[at]] = at
            touched[at] = True
            whole = rest[alive[rest] & alive[with_rest] & ~touched[rest] & ~touched[with_rest]]
            touched[at] = False
            near = np.unique(np.concatenate([at, before[at], whole]))
            near = near[(near >= 0) & (after[near] < len(body))]
    if after is not None:
        body = body[alive]
    return np.concatenate(rules), widths[base:], body


def _frequent(body: np.ndarray, closing: np.ndarray, near: np.ndarray | None, after: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Pairs of ``least`` occurrences, ascending, with their counts, and the places with the number of their pair."""
    if near is None:
        left, right, free = body[:-1], body[1:], ~closing[:-1]
    else:
        left, right, free = body[near], body[near + 1 if after is None else after[near]], ~closing[near]
    same = np.flatnonzero(free & (left == right))
    if len(same):
        places = same if near is None else near[same]
        free[same] = leftmost(places, places + 1 if after is None else after[places])
    some = np.flatnonzero(free)
    pair = left[some].astype(np.uint64) << np.uint64(32) | right[some]
    slot = (pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
    # a slot counts all of its pairs, so that one below ``least`` has no frequent pair
    often = np.bincount(slot, minlength=1 << SLOT_BITS) >= least
    held = often[slot]
    some, pair, slot = some[held], pair[held], slot[held]
    if not len(some):
        return None
    order = np.sort(pair)
    first = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
    counts = np.diff(first, append=len(order))
    keys, counts = order[first[counts >= least]], counts[counts >= least]
    if not len(keys):
        return None
    # a slot names one of its keys; pairs of another key are looked up
    number = np.full(1 << SLOT_BITS, -1, np.int32)
    number[(keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)] = np.arange(len(keys))
    of = number[slot]
    odd = np.flatnonzero((of >= 0) & (keys[of] != pair))
    found = np.minimum(np.searchsorted(keys, pair[odd]), len(keys) - 1)
    of[odd] = np.where(keys[found] == pair[odd], found, -1)
    some, of = some[of >= 0], of[of >= 0]
    return keys, counts, some if near is None else near[some], of


def planes(base: int, rules: int) -> int:
    """Bits beyond 16 that the symbols of a block with so many rules need."""
    return max(0, (base + rules - 1).bit_length() - 16)


def packed(body: np.ndarray, high: int) -> bytes:
    """The symbols in the file format, with ``high`` bits beyond 16."""
    return b"".join([body.astype("<u2").tobytes(), *(np.packbits((body >> np.uint32(16 + k)).astype(np.uint8) & 1).tobytes() for k in range(high))])


def unpacked(raw: bytes, n: int, high: int) -> np.ndarray:
    """``n`` symbols of the file format."""
    body, plane = np.frombuffer(raw, "<u2", n).astype(np.uint32), -(-n // 8)
    for k in range(high):
        body |= np.unpackbits(np.frombuffer(raw, np.uint8, plane, 2 * n + k * plane), count=n).astype(np.uint32) << np.uint32(16 + k)
    return body


def held_in(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules, their widths and the symbols of a row of the files."""
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    return rules, np.frombuffer(row["widths"], "<u4"), unpacked(row["body"], row["symbols"], planes(row["base"], len(rules)))


def expand(body: np.ndarray, rules: np.ndarray, widths: np.ndarray, base: int) -> np.ndarray:
    """The ids that ``body``, or any slice of it, stands for: the rules it uses are taken apart a level at a time, then put in place."""
    used = np.unique(body[body >= base])
    spread = widths[used - base].astype(np.int64)
    flat, symbols, places = np.zeros(int(spread.sum()), np.uint32), used, np.cumsum(spread) - spread
    sizes = np.ones(base + len(rules), np.int32)
    sizes[base:] = widths
    begins = np.zeros(base + len(rules), np.int32)
    begins[used] = places
    while len(symbols):
        plain = symbols < base
        flat[places[plain]] = symbols[plain]
        halves, places = rules[symbols[~plain] - base], places[~plain]
        symbols, places = np.concatenate([halves[:, 0], halves[:, 1]]), np.concatenate([places, places + sizes[halves[:, 0]]])
    long = np.flatnonzero(body >= base)
    spread = sizes[body]
    ends = np.cumsum(spread, dtype=np.int64)
    out = np.repeat(body, spread)  # right where a symbol is an id
    sizes, starts = spread[long], ends[long] - spread[long]
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(starts, sizes) + inside] = flat[np.repeat(begins[body[long]], sizes) + inside]
    return out


def write_token_files(docs: DataFrame, path: str, vocabulary: str, rounds: int | None = None) -> None:
    """Encode every text, append END_ID, and write the blocks below ``path``.

    Null text counts as empty (its ids are END_ID alone). Rows go in order of
    (doc_id, text), a null id first; repeated rows are each written. No rows
    give a file without blocks. Texts are shuffled once, by id range.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        first_rule = len(encode.widths)
        held: list[tuple] = []
        shard, block, size, earlier = TaskContext.get().partitionId(), 0, 0, 0  # the ranges are numbered in id order

        def sealed():
            ids = np.concatenate([x for _, x, _ in held])
            sizes = np.concatenate([x for _, _, x in held])
            names = [i for x, _, _ in held for i in x]
            ends = np.cumsum(sizes)
            rules, widths, body = repair(ids, ends, first_rule, rounds)
            spread = np.ones(len(body), np.int64)
            inside = body >= first_rule
            spread[inside] = widths[body[inside] - first_rule]
            offsets = np.searchsorted(np.cumsum(spread) - spread, ends - sizes)
            row = {"shard": [shard], "block": [block], "earlier": [earlier], "base": [first_rule], "doc_ids": [names], "sizes": [sizes], "offsets": [offsets], "rules": [rules.astype("<u4").tobytes()], "widths": [widths.astype("<u4").tobytes()], "symbols": [len(body)], "body": [packed(body, planes(first_rule, len(rules)))]}
            kinds = {"shard": pa.int32(), "block": pa.int32(), "earlier": pa.int64(), "base": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "offsets": pa.list_(pa.int64()), "rules": pa.binary(), "widths": pa.binary(), "symbols": pa.int64(), "body": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(row[k], kinds[k]) for k in kinds], names=list(kinds))

        for batch in batches:
            names, low = batch.column(0).to_pylist(), 0
            lengths = pc.binary_length(batch.column(1)).to_pylist()
            while low < len(names):
                high, sized = low, 0
                while high < len(names) and (high == low or sized < 1_000_000):
                    sized += lengths[high]
                    high += 1
                ids, counts = encode.encode(batch.column(1).slice(low, high - low).to_pylist())
                ids = with_end(ids, counts)
                held.append((names[low:high], ids, counts + 1))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield sealed()
                    held, size, block, earlier = [], 0, block + 1, earlier + size
                low = high
        if held:
            yield sealed()
        pa.default_memory_pool().release_unused()

    placed = base.repartitionByRange(ranges_of(base.count()), "doc_id").sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(pack, SCHEMA).write.mode("overwrite").option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` and, if asked for, ``ids``, decoded from the files.

    ``start`` counts the ids of all documents before. Only the number of ids of
    each shard (an id range) comes to the driver.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    sums = blocks.select("shard", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    upto, begins = 0, {}
    for shard, n in sorted((r[0], r[1]) for r in sums.groupBy("shard").agg(F.sum("n")).collect()):
        begins[shard], upto = upto, upto + n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rules, widths, body = held_in(r)
                ids = expand(body, rules, widths, r["base"]).astype("<u4")
                ends = np.cumsum(r["sizes"])
                starts = ends - r["sizes"]
                parts = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + begins[r["shard"]] + r["earlier"], pa.int64()), pa.array(r["sizes"], pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return blocks.mapInArrow(decode, schema)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents of that id, decoded from their own symbols only."""
    out = []
    for r in spark.read.schema(SCHEMA).parquet(path).where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).toLocalIterator():
        rules, widths, body = held_in(r)
        edges = [*r["offsets"], len(body)]
        out += [expand(body[edges[i] : edges[i + 1]], rules, widths, r["base"]).tolist() for i, d in enumerate(r["doc_ids"]) if d == doc_id]
    return out
