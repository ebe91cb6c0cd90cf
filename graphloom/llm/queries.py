"""The queries of the ten operators, over the whole tables of a folder, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, langid, licenses, near_dedup, packing, quality, secrets, tokens, urls
from .storage import new_path

VOCABULARY = "byte_bpe_50k.json"
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside benchmark passages, and the items met."""
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document from weak labels."""
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of each text and of its edited text."""
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into sequences of 1024 tokens."""
    pieces = packing.pieces_of(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's url."""
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids, written as Re-Pair files and read back from them."""
    path = new_path(spark, "tokens")
    tokens.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return tokens.read_token_files(spark, path, with_ids=False)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each text."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long").alias(f"n_{secrets.KINDS[k]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(secrets.spelled(F.col("base")), 256).alias("base_sha256"), secrets.spelled(F.array_sort(F.concat("base", "markov"))).alias("spans"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of each document."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "dice", F.size("matches").cast("long").alias("n_matches"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of the documents: three-word shingles, similarity 0.85."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.fit(docs.where(~held_out).select("text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_quality, op3_fingerprints, op4_packing, op5_url_filter, op6_token_files, op7_secrets, op8_licenses, op9_near_dedup, op10_language)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_decontamination": rf"""
WITH b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 8) AS span, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS k
        FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, span, i, array_to_string(w[i:i + span - 1], ' ') AS k
      FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, (SELECT DISTINCT span FROM win) WHERE len(w) >= span)),
hit AS (SELECT g.doc_id, g.span, g.i, win.item FROM g JOIN win ON g.span = win.span AND g.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + span)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(it.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""",
    # the pages' html has no canonical links and no refreshes, so no class has two members and an url without a rule is allowed
    "op5_url_filter": r"""
WITH p AS (SELECT page_id,
  coalesce(CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '') AS host,
  coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) END, '') AS path FROM pages),
r(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT p.page_id, h || q AS rule, v, row_number() OVER (PARTITION BY p.page_id ORDER BY length(h || q) DESC) AS k
      FROM p JOIN r ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict FROM p LEFT JOIN f ON f.page_id = p.page_id AND f.k = 1""",
    "op9_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach(v, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.v),
least AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.component_id, d.doc_id = least.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON least.v = d.doc_id""",
}
