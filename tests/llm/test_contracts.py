"""Queries against their contracts, written out from these and not from the code."""

import re
import random

import pandas as pd
from pyspark.sql import functions as F

from graphloom.llm import decontamination, queries, urls

#: The rules as the contract lists them: verdict, host and path.
URL_CONTRACT = "allow org/, block example.org/es/, block example.org/en/1, allow com/fr/, block com/de/"


def judged(url):
    rules = [(v, *r.split("/", 1)) for v, r in (x.split(" ") for x in URL_CONTRACT.split(", "))]
    if url is None or "://" not in url:
        return "", "", None, None
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + "/" + p), h + "/" + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_of_the_contract(spark, sf, tmp_path):
    odd = ["http://a.example.org/en/1", "http://example.org/en/12?x", "HTTP://Example.ORG/en/2#/en/1", "x://y.com/fr/", "y.com/de/", None, "a://com/de/x://org/", "http://notcom/de/", "", "http://example.org", "z://example.org/es/1?q://"]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").union(spark.createDataFrame([(10**6 + i, u, None) for i, u in enumerate(odd)], "page_id long, url string, html string"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    want = {r.page_id: judged(r.url) for r in pages.collect()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op5_url_filter(spark, str(tmp_path)).collect()}
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    assert all(got[k][3] == (v[3] or "allow") for k, v in want.items())
    assert {got[10**6][3], got[10**6 + 1][3]} == {"block"} and got[10**6 + 2][3] == "allow"


def test_url_classes_of_many_pages(spark):
    """Chains and stars of redirects and canonical links, with a hot target, against union-find."""
    draw = random.Random(12)
    url = lambda i: f"http://h{i % 50}.{['net', 'com', 'org'][i % 3]}/{draw.choice(['fr', 'de', 'x'])}/p{i}"
    names = [url(i) for i in range(900)]
    edges = [(names[i], names[i - 1]) for i in range(1, 120)] + [(names[i], names[150]) for i in range(151, 450)] + [(names[draw.randrange(450, 900)], names[draw.randrange(450, 900)]) for _ in range(180)]
    html = {}
    for a, b in edges[::2]:
        html.setdefault(a, f'<html><head><link rel="canonical" href="{b}"></head></html>')
    used = [(a, b) for a, b in edges[::2] if html[a].find(f'"{b}"') > 0] + edges[1::2]
    pages = spark.createDataFrame([(i, n, html.get(n, "<p>none</p>")) for i, n in enumerate(names)], "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.propagated) for r in urls.filter_urls(pages, queries.URL_RULES, spark.createDataFrame(edges[1::2], "src string, dst string")).collect()}
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in used:
        parent[find(a)] = find(b)
    verdicts = {n: judged(n)[3] for n in names}
    classes = {}
    for n in names:
        classes.setdefault(find(n), set()).add(verdicts[n])
    want = {}
    for i, n in enumerate(names):
        spread = verdicts[n] is None and "block" in classes[find(n)] and "allow" not in classes[find(n)]
        want[i] = (verdicts[n] or ("block" if spread else "allow"), spread)
    assert got == want and any(s for _, s in want.values())


WORD = "[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+"


def contaminated(text, items, width=8):
    fold = lambda t: re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, met = fold(text), set(), set()
    for item_id, body in items:
        own = fold(body)
        span = min(len(own), width)
        windows = {tuple(own[i : i + span]) for i in range(len(own) - span + 1)} if own else set()
        for i in range(len(words) - span + 1 if windows else 0):
            if tuple(words[i : i + span]) in windows:
                hit |= set(range(i, i + span))
                met.add(item_id or "")
    return len(words), len(hit), sorted(met)


def test_decontamination_equals_brute_force_on_any_letters(spark):
    draw = random.Random(5)
    pieces = ["Σ", "σ", "ς", "ΑΣ", "İ", "i\u0307", "\u212a", "k", "K", "ß", "ẞ", "Ab", "aB", "'", "’", ".", " ", " ", " ", "-", "\u00a0", "\u2003", "1", "Ǆ", "\x85", "\n", "日本"]
    make = lambda n: "".join(draw.choice(pieces) for _ in range(n))
    items = [(f"i{i}", make(draw.randint(1, 60))) for i in range(30)] + [("judge", "ΑΣ'x one two three four five six"), ("none", " .'"), (None, "ΑΣ x"), ("void", None)]
    docs = [(i, make(draw.randint(0, 40)) + draw.choice([" ", ""]).join([""] + [draw.choice(items)[1] or "" for _ in range(draw.randint(0, 4))]) + make(draw.randint(0, 40))) for i in range(150)]
    docs += [(900, "before ΑΣ'x one two three four five six after"), (901, None), (902, " ".join(["ΑΣ'x one two three four five six"] * 300))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "found", "item", "shift", "bound")})
    out = decontamination.decontaminate(frame, spark.createDataFrame(items, "item_id string, text string"), carry=["doc_id", "row"])
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in out.collect()}
    assert got == {d: contaminated(t, items) for d, t in docs}
    assert got[900][1] == 8 and out.schema["row"].dataType.names == ["doc_id", "row"]
    assert isinstance(out.toPandas(), pd.DataFrame)
