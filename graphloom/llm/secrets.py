"""Secret scan: patterns, and character Markov models compared by likelihood, in DataFrame functions only."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base patterns. A match of assign counts if group 2 has 6 characters; the others carry their least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]
#: What the Markov models judge: runs of 16 characters and more. They and no other rule decide.
LEAST_RUN = 16
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Parts of ordinary identifiers.
PARTS = (
    "account action active address alias alpha amount answer archive array assert async attribute author backend balance batch begin binary block board body boolean bridge buffer build button cache call cancel channel child "
    "class client cluster code column command comment commit common component config connect constant container content context control copy count create current cursor custom data database date debug default delete depth "
    "detail device digest direct display document domain download driver editor element email empty enable encode engine entry error event exception execute export factory feature field file filter final find first flag float "
    "folder font form format frame function gateway general group handler hash header height history host image import index info init input insert integer internal invoice item iterator job json key label language last layer "
    "layout length level library limit line link list loader local lock logger login long loop main manager map mask match matrix member memory menu merge message method metric mode model module monitor month mount name native "
    "network node notice number object offset option order output package page panel parent parse part password path pattern payment pending pixel plugin point policy port position prefix preview print private process profile "
    "project property protocol provider proxy public query queue random range read record region register release remote render report request reset resource response result return role root route row rule sample scale schedule "
    "schema scope screen script search second section select sender sequence server service session setting shape signal single size slice socket source split stack start state static status step storage stream string style "
    "submit subject suffix summary switch symbol sync system table target task template test text thread time title token total trace track transform tree trigger type update upload user value vector version view visible "
    "volume wait warning watch web weight width window worker write year zone"
).split()


def labelled_samples(n: int = 4000, seed: int = 11) -> list[tuple[str, bool]]:
    """Training strings with labels: random ones (hex, letters and digits, base 64), and ordinary identifiers."""
    draw, out = random.Random(seed), []
    for k in range(n):
        letters = [ALPHABET[26:36] + "abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62]][k % 4]
        out.append(("".join(draw.choice(letters) for _ in range(draw.randint(20, 64))), True))
        words = [draw.choice(PARTS) for _ in range(draw.randint(3, 7))]
        number = [str(draw.choice([draw.randint(0, 20), draw.randint(1990, 2030), draw.randint(0, 9999)]))]
        words.insert(draw.randint(1, len(words)), number[0])
        joined = [lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "/".join(w), lambda w: "".join(x.capitalize() for x in w), lambda w: "_".join(w).upper(), lambda w: "".join(w)]
        out.append((joined[k % 6](words), False))
    return out


def log_ratios(samples: list[tuple[str, bool]]) -> list[float]:
    """For each pair of symbols, log P(next | symbol, random) - log P(next | symbol, ordinary); add-one smoothed."""
    n = len(ALPHABET)
    index = {c: i for i, c in enumerate(ALPHABET)}
    counts = {label: [1.0] * (n * n) for label in (True, False)}
    for text, label in samples:
        known = [index[c] for c in text if c in index]
        for a, b in zip(known, known[1:]):
            counts[label][a * n + b] += 1
    share = {label: [c / sum(row) for i in range(0, n * n, n) for row in (counts[label][i : i + n],) for c in row] for label in counts}
    return [math.log(p / q) for p, q in zip(share[True], share[False])]


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """All leftmost matches as (start, end, rank, kind), in code points: the gaps between matches give the places."""
    pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    bound = F.transform(F.array(pieces), lambda p: p)  # a lambda variable, so that each is made once
    start = lambda acc: F.element_at(acc, -1)

    def placed(p: Column) -> Column:
        ends = F.aggregate(
            F.arrays_zip(F.transform(F.slice(p["gaps"], 1, F.size(p["found"])), F.length).alias("g"), F.transform(p["found"], F.length).alias("m")),
            F.expr("array(0)"),
            lambda acc, x: F.concat(acc, F.array(start(acc) + x["g"] + x["m"])),
        )
        return F.transform(F.array(ends), lambda e: F.transform(p["found"], lambda m, i: F.struct((F.get(e, i + 1) - F.length(m)).alias("start"), F.get(e, i + 1).alias("end"), F.lit(KINDS.index(kind)).alias("rank"), m.alias("found"))))[0]

    spans = F.filter(F.transform(bound, placed)[0], lambda s: keep(s["found"]))
    none = F.expr("cast(array() as array<struct<start:int,end:int,rank:int,found:string>>)")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: list[tuple[str, bool]] | None = None, least_mean: float = 0.75) -> DataFrame:
    """``docs`` with ``base`` and ``markov``: arrays of (start, end, rank, found), by start, in code points, end exclusive.

    base: the patterns' spans. markov: of runs of letters, digits and ``+/_=-``,
    the parts outside base spans that have LEAST_RUN characters or more and whose
    mean log-likelihood ratio a character, of the model of random strings over
    that of ordinary identifiers, is at least ``least_mean``. Null counts as
    empty, no rows give no rows; no text is cut; repeated rows each give the same; columns named
    base and markov are replaced.
    """
    n = len(ALPHABET)
    # a constant array; rounded so that its text stays short
    table = F.split(F.lit(" ".join(f"{x:.4f}" for x in log_ratios(samples or labelled_samples()))), " ").cast("array<double>")
    own = docs.drop(*[c for c in docs.columns if c in ("base", "markov")])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    everything = lambda found: F.lit(True)
    value = lambda found: F.length(F.regexp_extract(found, ASSIGN, 2)) >= 6
    place = lambda m, i: F.call_function("locate", F.substring(m, i, F.lit(1)), F.lit(ALPHABET))
    ratio = lambda m: F.aggregate(F.sequence(F.lit(2), F.length(m)), F.lit(0.0), lambda acc, i: acc + F.element_at(table, (place(m, i - 1) - 1) * n + place(m, i))) / (F.length(m) - 1)
    base = F.array_sort(F.concat(_spans(text, ASSIGN, "assign", value), _spans(text, ACCESS, "access", everything), _spans(text, HEX, "hex", everything)))
    marked = own.withColumn("base", base)

    def outside(s: Column) -> Column:
        """The parts of a candidate between base spans."""
        part = lambda low, high: F.struct(low.alias("start"), high.alias("end"), s["rank"].alias("rank"), F.substring(s["found"], low - s["start"] + 1, high - low).alias("found"))
        more = lambda acc, upto: F.when(upto > acc["at"], F.concat(acc["parts"], F.array(part(acc["at"], upto)))).otherwise(acc["parts"])
        met = F.filter("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        nothing = F.struct(s["start"].alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,rank:int,found:string>>)").alias("parts"))
        return F.aggregate(met, nothing, lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), more(acc, b["start"]).alias("parts")), lambda acc: more(acc, s["end"]))

    parts = F.flatten(F.transform(_spans(text, CANDIDATE, "markov", everything), outside))
    return marked.withColumn("markov", F.filter(parts, lambda p: F.when(F.length(p["found"]) >= LEAST_RUN, ratio(p["found"]) >= least_mean).otherwise(False)))


def spelled(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with each span of its text (overlapping ones as one) replaced by ``mask``; n_chars follows where it is a column."""
    found = scan(docs, **options)
    spans = F.array_sort(F.concat("base", "markov"))
    empty = F.expr("named_struct('upto', 0, 'parts', cast(array() as array<string>))")

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["parts"], F.array(F.substring(F.col("text"), acc["upto"] + 1, s["start"] - acc["upto"]), F.lit(mask)))
        return F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), F.when(s["start"] >= acc["upto"], new).otherwise(acc["parts"]).alias("parts"))

    rebuilt = F.aggregate(spans, empty, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), acc["upto"] + 1, F.length("text"))))
    text = F.when((F.size("base") > 0) | (F.size("markov") > 0), rebuilt).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
