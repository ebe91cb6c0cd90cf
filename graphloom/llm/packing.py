"""Best-fit packing of token sequences, planned on counts by length.

Lengths are whole numbers of at most the sequence length, so the whole corpus
is described by one count a length. The plan is made on those counts: the
large lengths are rounded up within groups of equal cardinality (linear
grouping), a linear program over configurations of these few sizes is solved
by column generation, the actual lengths take the places of the rounded
ones, and the small lengths go, longest first, where they fit best. Pieces
then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .storage import materialize, small_batches
from .tokens import with_end

#: Lengths above such a share of the sequence length are large (each is tried); groups of them.
LARGE, GROUPS = (1 / 4, 1 / 3, 2 / 5, 1 / 2), 64


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """A linear program's optimum of cutting-stock: configurations and how often each is used."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        # the best worth of at most j items in each capacity; sizes are large, so j stays small
        best, chosen = np.zeros((capacity + 1,)), []
        for _ in range(capacity // int(sizes.min())):
            with_one = np.full((k, capacity + 1), -1.0)
            for i, s in enumerate(sizes):
                with_one[i, s:] = best[: capacity + 1 - s] + price[i]
            pick = with_one.argmax(0)
            value = with_one[pick, np.arange(capacity + 1)]
            better = value > best + 1e-12
            chosen.append(np.where(better, pick, -1))
            best = np.where(better, value, best)
        if best[capacity] <= 1 + 1e-7:
            break
        at, column = capacity, np.zeros(k)
        for pick in reversed(chosen):
            if pick[at] >= 0:
                column[pick[at]] += 1
                at -= int(sizes[pick[at]])
        if column @ price <= 1 + 1e-7:
            break
        use, step = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-12, use / np.where(step > 1e-12, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    use = np.linalg.solve(basis, demand)
    return [(basis[:, i].round().astype(int), float(u)) for i, u in enumerate(use) if u > 1e-9]


def plan(counts: np.ndarray, capacity: int, large: tuple[float, ...] = LARGE, groups: int = GROUPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(sequences, [(length, pieces of it in each)])`` for ``counts[length]`` pieces: the best of a few borders of large."""
    return min((plan_for(counts, capacity, border, groups) for border in large), key=lambda p: sum(n for n, _ in p))


def plan_for(counts: np.ndarray, capacity: int, large: float, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(sequences, [(length, pieces of it in each)])`` for ``counts[length]`` pieces; the sums meet the counts exactly.

    ``len(counts) == capacity + 1``. The number of entries depends on the
    capacity, not on the number of pieces. The lengths that the rounding
    leaves over are placed with the small ones, by best fit.
    """
    left = counts.astype(np.int64).copy()
    bins: list[list] = []  # [sequences, room, [(length, pieces)]]
    if left[capacity]:
        bins.append([int(left[capacity]), 0, [(capacity, 1)]])
        left[capacity] = 0
    floor = int(capacity * large)
    lengths = np.flatnonzero(left[floor + 1 :])[::-1] + floor + 1
    if len(lengths):
        upto = np.cumsum(left[lengths])
        group = np.minimum((upto - left[lengths]) * groups // int(upto[-1]), groups - 1)  # a length stays whole
        names = np.unique(group)
        sizes = np.asarray([lengths[group == g].max() for g in names])
        demand = np.asarray([left[lengths[group == g]].sum() for g in names])
        stock = [[[int(x), int(left[x])] for x in lengths[group == g]] for g in names]  # longest first
        for pattern, use in sorted(configurations(sizes, demand.astype(float), capacity), key=lambda x: -x[1]):
            often = int(use + 1e-9)
            while often > 0:
                # as many sequences as have the same actual lengths
                inside, run = [], often
                draws = {g: int(c) for g, c in enumerate(pattern) if c}
                for g, c in draws.items():
                    need, i = c, 0
                    while need and i < len(stock[g]):
                        take = min(need, stock[g][i][1])
                        if take:
                            inside.append([g, i, take])
                            need -= take
                        i += 1
                if not inside:
                    break
                for g, i, take in inside:
                    run = min(run, stock[g][i][1] // take)
                content: dict[int, int] = {}
                for g, i, take in inside:
                    stock[g][i][1] -= run * take
                    content[stock[g][i][0]] = content.get(stock[g][i][0], 0) + take
                bins.append([run, capacity - sum(x * c for x, c in content.items()), list(content.items())])
                often -= run
        left[lengths] = 0
        for pairs in stock:
            for length, n in pairs:
                left[length] += n
    by_room: dict[int, list[list]] = {}
    for b in bins:
        by_room.setdefault(b[1], []).append(b)

    def put(length: int, n: int) -> None:
        """The tightest room first, and again in the same sequence while it fits."""
        while n:
            room = next((r for r in range(length, capacity + 1) if by_room.get(r)), None)
            if room is None:
                each = min(capacity // length, n)
                full = n // each
                by_room.setdefault(capacity - each * length, []).append([full, capacity - each * length, [(length, each)]])
                n -= full * each
                continue
            b = by_room[room].pop()
            each = min(room // length, n)
            full = min(b[0], n // each)
            if full < b[0]:
                by_room[room].append([b[0] - full, room, b[2]])
            by_room.setdefault(room - each * length, []).append([full, room - each * length, [*b[2], (length, each)]])
            n -= full * each

    for length in range(capacity, 0, -1):
        if left[length]:
            put(length, int(left[length]))
    return [(b[0], b[2]) for some in by_room.values() for b in some if b[0]]


def places(packed: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, from_rank, to_rank, sequence, each, offset)``: ranks from, below to, go ``each`` to a sequence."""
    out, used, sequence = [], {}, 0
    for often, content in packed:
        offset = 0
        for length, each in content:
            rank = used.get(length, 0)
            out.append((length, rank, rank + often * each, sequence, each, offset))
            used[length] = rank + often * each
            offset += length * each
        sequence += often
    return out


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = 1024) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: every document's ids and END_ID, cut only if longer than ``capacity``."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            names, texts, low = batch.column(0).to_pylist(), batch.column(1).fill_null(""), 0
            lengths = pc.binary_length(texts).to_pylist()
            while low < len(names):
                high, sized = low, 0
                while high < len(names) and (high == low or sized < 2_000_000):
                    sized += lengths[high]
                    high += 1
                ids, counts = encode.encode(texts.slice(low, high - low).to_pylist())
                ids = with_end(ids, counts).astype("<u4", copy=False)
                sizes = counts + 1
                n = -(-sizes // capacity)
                first = np.repeat(np.cumsum(n) - n, n)
                piece = np.arange(int(n.sum())) - first
                head = np.repeat(sizes - (n - 1) * capacity, n)  # the first piece is the shorter one
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                at = np.repeat(np.cumsum(sizes) - sizes, n) + start
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names[low:high], pa.int64()).take(pa.array(np.repeat(np.arange(high - low), n))), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
                low = high
        pa.default_memory_pool().release_unused()

    return base.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 1024, large: tuple[float, ...] = LARGE, groups: int = GROUPS, rows_a_task: int = 500_000) -> DataFrame:
    """``pieces`` (with whole ``length`` from 1 to ``capacity``) and their ``sequence_id`` and ``offset``.

    Only one count a length comes to the driver, and only the plan's runs
    (some per length, however many pieces there are) are broadcast. A piece's
    rank among those of its length comes from its place in one of many hash
    buckets and the counts of the buckets before, so a length that most pieces
    share is dealt to many tasks. Repeated rows are packed each; no rows give
    no rows.
    """
    spark = pieces.sparkSession
    held, _ = materialize(pieces, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in held.groupBy("length").count().collect():
        counts[length] = n
    runs = places(plan(counts, capacity, large, groups))
    table = F.broadcast(spark.createDataFrame(runs, "run_length long, low long, high long, base long, each long, begin long"))
    buckets = int(max(16, counts.max() // rows_a_task))
    held = held.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    w = Window.partitionBy("length").orderBy("bucket")
    before = held.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(F.col("length").alias("l"), F.col("bucket").alias("b"), (F.sum("n").over(w) - F.col("n")).alias("before"))
    ranked = held.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")).cast("long") - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b"))).withColumn("rank", F.col("r") + F.col("before"))
    at = ranked.join(table, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    step = F.col("rank") - F.col("low")
    return at.withColumn("sequence_id", F.col("base") + F.expr("(rank - low) div each")).withColumn("offset", F.col("begin") + step % F.col("each") * F.col("length")).drop("bucket", "r", "l", "b", "before", "rank", "run_length", "low", "high", "base", "each", "begin")
