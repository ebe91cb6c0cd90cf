"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing, on two attributes:
quality and abuse. For each, expectation-maximisation estimates every
labeller's accuracy from the counts of vote patterns over all documents; the
posterior labels then train a linear scorer on hashed words, which scores every
document. Labellers run once: their votes are stored beside the texts.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ragged
from .ragged import U64
from .storage import materialize, small_batches

FEATURES = 1 << 14
#: Rows that train the scorer, at most.
SAMPLE = 4000
#: Rows with a vote for abuse that train its scorer besides, at most.
ABUSE_SAMPLE = 1000
#: Words for a person, words of contempt and phrases of hostility that mark a text as abusive.
NAMES = "idiot idiots moron morons clown clowns loser losers scum imbecile imbeciles jerk jerks fool fools bastard bastards scumbag scumbags".split()
CONTEMPT = "stupid worthless dumb pathetic trash disgusting useless vile filthy brainless garbage".split()
HOSTILITY = ["shut up", "hate you", "kill yourself", "go to hell", "get lost", "nobody likes you", "drop dead"]


def labellers(text: Column) -> dict[str, Column]:
    """Votes of each heuristic: 1 good, -1 bad, 0 nothing."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: 1 - F.length(F.regexp_replace(text, pattern, "")) / n
    rule = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    symbols, upper, digits = share(r"[#$%&*|<>{}\[\]\\^~=]+"), share(r"[A-Z]+"), share("[0-9]+")
    lines = F.split(text, "\n")
    parts = F.split(text, "[ \n]+")
    tokens = F.size(parts)
    varied = F.size(F.array_distinct(parts)) / tokens
    bangs = share("[!?]+")
    return {
        "symbols": rule(symbols > 0.03, symbols < 0.005),
        "capitals": rule(upper > 0.3, (upper > 0.002) & (upper < 0.08)),
        "digits": rule(digits > 0.15, digits < 0.02),
        "exclamations": rule(bangs > 0.02, bangs < 0.002),
        "length": rule(tokens < 4, tokens > 60),
        "word_length": rule((n / tokens > 12) | (n / tokens < 2.5), (n / tokens).between(3.5, 8)),
        "repeated_lines": rule((F.size(lines) >= 4) & (F.size(F.array_distinct(lines)) < 0.7 * F.size(lines)), (F.size(lines) >= 3) & (F.size(F.array_distinct(lines)) > 0.95 * F.size(lines))),
        "repeated_words": rule((tokens >= 20) & (varied < 0.15), (tokens >= 20) & (tokens < 500) & (varied > 0.4)),
        "bars": rule(share("[|]") > 0.015, F.lit(False)),
        "sentences": rule(share(r"[.,;:]") < 0.002, share(r"[.,;:]").between(0.008, 0.06)),
    }


def abuse_labellers(text: Column) -> dict[str, Column]:
    """Votes of each heuristic on abuse: -1 if found, else 0."""
    found = lambda words: F.when(text.rlike(r"(?i)\b(?:" + "|".join(words) + r")\b"), -1).otherwise(0)
    return {"names": found(NAMES), "contempt": found(CONTEMPT), "hostility": found(HOSTILITY)}


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """``(posterior of good by pattern, vote tables, prior of good)`` by expectation-maximisation.

    Labellers are independent given the label. ``tables[label, labeller, vote]``
    are their chances to vote bad, nothing or good on bad (0) and good (1)
    documents. It starts from the votes for bad, which fixes which label is bad.
    """
    weight = counts / max(1, counts.sum())
    bad_votes = (patterns == -1).sum(1)
    good = np.where(bad_votes == 0, 0.95, 0.2**bad_votes)
    votes = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    tables, prior = np.zeros((2, patterns.shape[1], 3)), 0.5
    for _ in range(rounds):
        mass = np.stack([weight * (1 - good), weight * good])
        prior = float(np.clip(mass[1].sum(), 0.02, 0.98))
        tables = np.einsum("lp,pjv->ljv", mass, votes) + 1e-4
        tables /= tables.sum(2, keepdims=True)
        # a vote against must not speak for a document
        tables[0, :, 0] = np.maximum(tables[0, :, 0], tables[1, :, 0])
        fits = np.einsum("pjv,ljv->lp", votes, np.log(tables)) + np.log([[1 - prior], [prior]])
        good = 1 / (1 + np.exp(np.clip(fits[0] - fits[1], -50, 50)))
    return good, tables, prior


def hashed_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows with their words' slots and weights (1 / square root of the count of words) and word counts.

    A word gives its hash and the shape of its characters.
    """
    shape = np.full(256, 1, np.uint8)
    shape[[*range(0x41, 0x5B)]], shape[[*range(0x61, 0x7B)]], shape[[*range(0x30, 0x3A)]], shape[[*range(0x80, 0x100)]] = 2, 3, 4, 3
    data, offsets = ragged.flat_bytes(column)
    for low, high in ragged.slices(offsets):
        part, edges = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, counts = ragged.words(part, edges, ragged.SPACED)
        kinds = shape[part]
        first, last = kinds[starts], kinds[ends - 1]
        middle = kinds[(starts + ends) // 2]
        size = np.minimum(ends - starts, 20)
        form = first * U64(1) + last * U64(5) + middle * U64(25) + size.astype(np.uint64) * U64(125)
        slots = np.concatenate([(ragged.word_hashes(part, starts, ends) % U64(FEATURES // 2)).astype(np.int64), FEATURES // 2 + (ragged.mix(form) % U64(FEATURES // 2)).astype(np.int64)])
        yield low, high, slots, np.concatenate([np.repeat(np.arange(high - low), counts)] * 2), counts


def train(texts: pa.Array, good: np.ndarray, steps: int = 60, rate: float = 0.5, seed: int = 1) -> np.ndarray:
    """Weights and a bias of logistic regression towards posterior labels, both labels with equal weight."""
    parts = [(slots, rows + low, counts) for low, _, slots, rows, counts in hashed_words(texts)]
    if not parts:
        return np.zeros(FEATURES + 1)
    slots, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    counts = np.concatenate([p[2] for p in parts])
    scale = 1 / np.maximum(counts, 1)
    balance = np.where(good > 0.5, 0.5 / max(1, (good > 0.5).sum()), 0.5 / max(1, (good <= 0.5).sum())) * len(good)
    w, pace = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-6)
    for _ in range(steps):  # AdaGrad on whole batches
        margin = np.bincount(rows, w[slots], len(good)) * scale + w[-1]
        error = (1 / (1 + np.exp(-margin)) - good) * balance / len(good)
        grad = np.append(np.bincount(slots, (error * scale)[rows], FEATURES), error.sum()) + 1e-7 * w
        pace += grad**2
        w -= rate * grad / np.sqrt(pace)
    return w


def posteriors(counts: dict[str, int]) -> dict[str, float]:
    """Of each vote pattern (a string of +, - and 0) the posterior of good."""
    seen = sorted(counts)
    good, _, _ = label_model(np.asarray([[{"+": 1, "-": -1, "0": 0}[c] for c in p] for p in seen]), np.asarray([counts[p] for p in seen], float))
    return dict(zip(seen, good.tolist()))


def voted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``(doc_id, text, votes)`` in shared storage, and how many of the votes are on quality (the first)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    on_quality, on_abuse = labellers(F.col("text")), abuse_labellers(F.col("text"))
    code = F.concat(*[F.when(v == 1, "+").when(v == -1, "-").otherwise("0") for v in [*on_quality.values(), *on_abuse.values()]])
    return materialize(base.withColumn("votes", code), "votes")[0], len(on_quality)


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, abuse_sample: int = ABUSE_SAMPLE, least: float = 0.5) -> DataFrame:
    """``(doc_id, quality, weak_quality, toxicity, abusive, keep)`` of every row.

    ``quality`` (0 to 1) is the scorer's, ``weak_quality`` the label model's
    posterior for the row's votes; ``toxicity`` is the mean of scorer and label
    model of abuse, ``abusive`` from one half on; keep: the mean of ``quality``
    and ``weak_quality`` reaches ``least`` and the text isn't abusive.

    All rows give vote counts (of 3**10 patterns on quality and 2**3 on abuse
    at most, which come to the driver; their posteriors go to the executors).
    The scorers are fitted on the first ``sample`` rows by hash of id and text,
    ties by these, that of abuse also on the first ``abuse_sample`` with a vote
    for it: so a run repeats its result, and copies count as often as they are.
    A null text counts as empty; repeated rows each give the same row; no rows
    give no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows, split = voted(docs, id_col, text_col)
    counts = {r[0]: r[1] for r in rows.groupBy("votes").count().collect()}
    on_quality, on_abuse = Counter(), Counter()
    for votes, n in counts.items():
        on_quality[votes[:split]] += n
        on_abuse[votes[split:]] += n
    good, fair = (posteriors(c) if c else {} for c in (on_quality, on_abuse))
    place = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(17))

    def drawn(some: DataFrame, n: int, most: int) -> pa.Table:
        """The first ``most`` of ``n`` rows by hash: a bound on the hash leaves half as many again."""
        bound = min((1 << 63) - 1, -(1 << 63) + int(min(1.0, (1.5 * most + 100) / max(1, n)) * (1 << 64)))
        return some.withColumn("place", place).where(F.col("place") <= F.lit(bound)).orderBy("place", "doc_id", "text").limit(most).select("text", "votes").toArrow()

    plain = drawn(rows, sum(counts.values()), sample)
    marked = drawn(rows.where(F.substring("votes", split + 1, 9).contains("-")), sum(n for v, n in counts.items() if "-" in v[split:]), abuse_sample)
    both = pa.concat_tables([plain, marked])
    fitted = lambda table, target: train(table.column("text").combine_chunks(), np.asarray([target(v) for v in table.column("votes").to_pylist()])) if table.num_rows else np.zeros(FEATURES + 1)
    weights = np.stack([fitted(plain, lambda v: good[v[:split]]), fitted(both, lambda v: 1 - fair[v[split:]])])

    @F.pandas_udf("struct<quality:double,weak:double,toxic:double,weak_toxic:double>")
    def judge(texts: pd.Series, code: pd.Series) -> pd.DataFrame:
        scores = np.zeros((2, len(texts)))
        for low, high, slots, at, sizes in hashed_words(pa.array(texts, pa.large_string(), from_pandas=True)) if len(texts) else ():
            for k in range(2):
                margin = np.bincount(at, weights[k][slots], high - low) / np.maximum(sizes, 1) + weights[k][-1]
                scores[k, low:high] = 1 / (1 + np.exp(-margin))
        return pd.DataFrame({"quality": scores[0], "weak": code.str[:split].map(good).to_numpy(float), "toxic": scores[1], "weak_toxic": 1 - code.str[split:].map(fair).to_numpy(float)})

    out = rows.select("doc_id", judge("text", "votes").alias("j")).select("doc_id", "j.*").withColumn("toxicity", (F.col("toxic") + F.col("weak_toxic")) / 2)
    keep = ((F.col("quality") + F.col("weak")) / 2 >= least) & (F.col("toxicity") < 0.5)
    return out.select("doc_id", "quality", F.col("weak").alias("weak_quality"), "toxicity", (F.col("toxicity") >= 0.5).alias("abusive"), keep.alias("keep"))
