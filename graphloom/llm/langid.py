"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language has a codeword; one linear classifier a bit learns from hashed
1- to 3-grams of bytes. A text's language is the codeword with the least
logistic loss against the classifiers' margins; a narrow lead over the next
codeword is flagged as ambiguous.
"""

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ragged
from .storage import small_batches, unused

FEATURES = 4096
#: Rows of a feature matrix at most: 8 MB of counts.
ROWS = 256
#: Training rows at most, a language; all their text is used.
SAMPLE = 800
#: Training rows at most, of all languages: a matrix of 260 MB on the driver.
MOST_ROWS = 16_000
UNDETERMINED = "und"


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Slices of rows with their feature matrix: square roots of n-gram counts, scaled to length 1."""
    data, offsets = ragged.flat_bytes(texts)
    fold = np.arange(256, dtype=np.uint32)
    fold[0x41:0x5B] += 32
    fold[[*range(0x30, 0x3A)]] = 0x30  # digits are one symbol
    some = (part for low, high in ragged.slices(offsets, 1 << 19) for part in zip(range(low, high, ROWS), [*range(low + ROWS, high, ROWS), high]))
    for low, high in some:
        part, edges = fold[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
        n = high - low
        row = np.repeat(np.arange(n, dtype=np.int64) * FEATURES, np.diff(edges))
        counts = np.zeros(n * FEATURES)
        code = np.zeros(len(part), np.uint32)
        for width in (1, 2, 3):
            m = len(part) - width + 1
            if m <= 0:
                break
            code = code[:m] * np.uint32(257) + part[width - 1 :][:m] + np.uint32(1)
            inside = row[:m] == row[width - 1 :][:m]
            slot = (code * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64) + row[:m]
            counts += np.bincount(slot[inside], minlength=n * FEATURES)
        x = np.sqrt(counts).astype(np.float32).reshape(n, FEATURES)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        yield low, high, x


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """+1/-1 codewords: all distinct splits of up to 4 languages, else the most separated of some random codes."""
    if languages <= 4:
        splits = [s for s in itertools.product((1, -1), repeat=languages) if s[0] == 1 and (languages == 1 or -1 in s)]
        return np.asarray(splits, np.float32).T
    bits, draw, best, code = 10 + 4 * int(np.ceil(np.log2(languages))), np.random.default_rng(seed), -1, None
    for _ in range(200):
        trial = draw.choice([-1, 1], (languages, bits)).astype(np.float32)
        if (np.abs(trial.sum(0)) == languages).any():
            continue
        apart = min(int((trial[a] != trial[b]).sum()) for a, b in itertools.combinations(range(languages), 2))
        if apart > best:
            best, code = apart, trial
    return code


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    lead: float = 0.1

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of belief from 0 to 1, and whether the lead is narrow."""
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        belief = np.exp(loss.min(1, keepdims=True) - loss)
        belief /= belief.sum(1, keepdims=True)
        top = loss.argmin(1)
        if len(self.languages) == 1:
            return top, belief.max(1), np.zeros(len(top), bool)
        two = np.partition(belief, -2, axis=1)
        return top, belief.max(1), two[:, -1] - two[:, -2] < self.lead


def fit(labelled: DataFrame, sample: int = SAMPLE, most_rows: int = MOST_ROWS, steps: int = 150, seed: int = 3) -> LanguageModel:
    """A model from ``(text, lang)``: up to ``sample`` different texts of each language, the first by hash.

    With many languages each gets as many fewer as keep the rows below
    ``most_rows``. Rows with a null text, one without a letter or a null lang
    teach nothing; copies of a text count once (of one that several languages
    claim, the least does); ties of the hash fall to the lesser text. Without
    rows to learn from, the model knows no language. Languages are counted on
    the driver; only the sample comes to it.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").cast("string").rlike(r"\p{L}")).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    hashed = known.withColumn("place", F.xxhash64("text", F.lit(seed)))
    sizes = {r[0]: r[1] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("place", 0.02)).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((0, 0), np.float32), np.zeros((FEATURES, 0), np.float32), np.zeros(0, np.float32))
    languages = sorted(sizes)
    sample = max(1, min(sample, most_rows // len(languages)))
    # half as many again as needed, as hashes below a bound; then the first of these
    bounds = {v: min((1 << 63) - 1, -(1 << 63) + int(min(1.0, (1.5 * sample + 40) / n) * (1 << 64))) for v, n in sizes.items()}
    table = F.create_map(*[F.lit(x) for pair in sorted(bounds.items()) for x in pair])
    drawn = hashed.where(F.col("place") <= F.element_at(table, F.col("lang"))).groupBy("place", "text").agg(F.min("lang").alias("lang"))
    first = Window.partitionBy("lang").orderBy("place", "text")
    rows = drawn.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample).select("place", "text", "lang").toArrow().sort_by([("place", "ascending"), ("text", "ascending")])
    lang = rows.column("lang").to_numpy(zero_copy_only=False)
    languages = sorted(set(lang.tolist()))
    x = np.concatenate([f for _, _, f in features(rows.column("text").combine_chunks())])
    code = codewords(len(languages))
    y = code[[languages.index(v) for v in lang]]
    weight = np.zeros(len(lang), np.float32)
    for v in languages:
        weight[lang == v] = 1 / (lang == v).sum()
    weight = (weight / weight.sum())[:, None]
    w, b, dw, db = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), 0, 0
    for _ in range(steps):  # gradient descent with momentum on the logistic loss
        g = -y * weight / (1 + np.exp(y * (x @ w + b)))
        dw, db = 0.9 * dw + x.T @ g + 1e-5 * w, 0.9 * db + g.sum(0)
        w, b = w - 8 * dw, b - 8 * db
    return LanguageModel(languages, code, w, b)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    A null text, or one without a letter, is ``und`` with score 0 and not
    ambiguous, and so is all when the model knows no language. Of codewords at
    the same distance the first language by name is chosen, and the text is
    ambiguous. Whole texts are read; only they go to Python. Repeated rows each
    give the same; no rows give no rows; columns of the three names are replaced,
    all others kept whatever their names.
    """
    small_batches(docs.sparkSession)
    own = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score", "ambiguous")])
    text = F.col(text_col).cast("string")
    out = "struct<lang_pred:string,score:double,ambiguous:boolean>"

    @F.arrow_udf(out)
    def judge(texts: pa.Array, known: pa.Array) -> pa.Array:
        names = np.asarray([*model.languages, UNDETERMINED], object)
        n, known = len(texts), known.to_numpy(zero_copy_only=False) & bool(model.languages)
        which, score, narrow = np.full(n, len(model.languages)), np.zeros(n), np.zeros(n, bool)
        for low, high, x in features(texts) if known.any() else ():
            top, belief, close = model.decide(x)
            here = known[low:high]
            which[low:high][here], score[low:high][here], narrow[low:high][here] = top[here], belief[here], close[here]
        return pa.StructArray.from_arrays([pa.array(names[which], pa.string()), pa.array(score), pa.array(narrow)], names=["lang_pred", "score", "ambiguous"])

    name = unused(own, "judged")
    found = own.select("*", judge(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False))).alias(name))
    return found.select("*", f"{name}.*").drop(name)
