"""Queries that retrieve and compare: names, text, vectors, fusion, hashes, diffs, division."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import intervals, search
from graphloom.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query("""SELECT p_partkey AS id, p_name AS name, greatest(0.3, 1 - 0.3 * levenshtein(lower(p_name), 'red widgit')) AS score FROM part WHERE levenshtein(lower(p_name), 'red widgit') <= 2 ORDER BY 3 DESC, 1 LIMIT 20""")
def fuzzy_parts(spark, sf_dir):
    """R2: part names within two edits."""
    return search.fuzzy(tables.table(spark, sf_dir, "part"), "p_partkey", "p_name", "red widgit", 20)


@query("""SELECT p_partkey AS id, CASE WHEN p_type LIKE '%/tests/%' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS score FROM part WHERE p_brand = 'Brand#13' AND p_name = (SELECT min(p_name) FROM part) ORDER BY 2 DESC, 1 LIMIT 20""")
def exact_name_dotted(spark, sf_dir):
    """a dotted name: brand, then part name."""
    parts = tables.table(spark, sf_dir, "part")
    name = parts.agg(F.min("p_name")).first()[0]
    nodes = parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("class_name"), F.col("p_type").alias("file_path"))
    return search.exact_name(nodes, f"Brand#13.{name}", 20)


_WORDS = "['license', 'version', 'token', 'general']"
_BM25 = f"""t AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS m FROM t),
h AS (SELECT id, len AS length, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM t) WHERE list_contains({_WORDS}, term) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
fts AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))) AS score FROM h JOIN df USING (term), st GROUP BY id)"""


@query(f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM fts ORDER BY round(fts.score, 9) DESC, id LIMIT 20")
def bm25_documents(spark, sf_dir):
    """Full-text search of the documents."""
    return search.bm25(tables.table(spark, sf_dir, "documents"), "doc_id", F.col("text"), ["license", "version", "token", "general"], 20).withColumn("score", F.round("score", 6))


_VEC = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
vec AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v) AS score FROM embeddings, q)"""


def _vector(spark, sf_dir, limit):
    vectors = tables.table(spark, sf_dir, "embeddings")
    return search.vector_topk(vectors, "vec_id", "embedding", vectors.where("vec_id = 0").select("embedding").first()[0], limit)


@query(f"WITH {_VEC} SELECT id, round(score, 6) AS score FROM vec ORDER BY round(vec.score, 9) DESC, id LIMIT 10")
def vector_topk(spark, sf_dir):
    """The ten vectors nearest to vector 0."""
    return _vector(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {_BM25}, {_VEC},
a AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM fts ORDER BY r LIMIT 30), b AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM vec ORDER BY r LIMIT 30),
u AS (SELECT id, r, 0 AS s FROM a UNION ALL SELECT id, r, 1 FROM b), f AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS score, min(s * 1000 + r) AS first FROM u GROUP BY id)
SELECT id, round(score, 6) AS score FROM f ORDER BY round(f.score, 12) DESC, first LIMIT 10""")
def hybrid_rrf(spark, sf_dir):
    """Full-text and vector ranks fused; 3 * limit candidates of each."""
    docs = tables.table(spark, sf_dir, "documents")
    fts = search.bm25(docs, "doc_id", F.col("text"), ["license", "version", "token", "general"], 30)
    return search.hybrid(fts, fts.limit(0), _vector(spark, sf_dir, 30), 10).withColumn("score", F.round("score", 6))


@query("""WITH h AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY 2 LIMIT 50),
m AS (SELECT conv_id AS id, arg_min(role, (turn, role)) AS process FROM conversations GROUP BY 1)
SELECT coalesce(process, 'Other results') AS process, min(rank) AS first_rank, array_to_string(list(h.id ORDER BY rank), ',') AS ids FROM h LEFT JOIN m ON m.id = h.id GROUP BY 1""")
def group_by_process(spark, sf_dir):
    """The 50 longest documents grouped by the first role of the conversation of their id."""
    top = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars").orderBy(F.desc("n_chars"), "id").limit(50)
    hits = top.select("id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "id")).cast("long").alias("rank"))
    membership = tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("process"), F.col("turn").alias("ord"))
    return search.group_by_process(hits, membership).withColumn("ids", F.array_join("ids", ","))


@query("""WITH s AS (SELECT o_orderkey AS pid, o_custkey AS f, epoch(o_orderdate)::BIGINT // 86400 AS line FROM orders),
z AS (SELECT o_orderkey AS id, o_custkey AS f, epoch(o_orderdate)::BIGINT // 86400 AS a, epoch(o_orderdate)::BIGINT // 86400 + 30 + o_orderkey % 60 AS b FROM orders),
r AS (SELECT s.pid, z.id, row_number() OVER (PARTITION BY s.pid ORDER BY z.b - z.a, z.a, z.id) AS k FROM s JOIN z ON z.f = s.f AND s.line BETWEEN z.a AND z.b AND z.a > 0)
SELECT s.pid, s.line, CAST(r.id AS VARCHAR) AS symbol FROM s LEFT JOIN r ON r.pid = s.pid AND r.k = 1""")
def interval_containment(spark, sf_dir):
    """The narrowest of a customer's order spans around each order date."""
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("file_path"), F.expr("unix_timestamp(cast(o_orderdate as timestamp)) div 86400").alias("day"))
    points = orders.select(F.col("o_orderkey").alias("pid"), "file_path", F.col("day").alias("line"))
    spans = orders.select(F.col("o_orderkey").cast("string").alias("id"), "file_path", F.col("day").alias("start_line"), (F.col("day") + 30 + F.col("o_orderkey") % 60).alias("end_line"), F.col("o_orderkey").alias("ord"))
    return intervals.containing_symbol(points, spans).select("pid", "line", "symbol")


@query("""WITH a AS (SELECT doc_id AS id, text, lang, source FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 3 THEN text || '!' ELSE text END AS text, lang, source FROM documents WHERE doc_id % 11 <> 0)
SELECT 'node' AS entity, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS kind, coalesce(a.id, b.id) AS id FROM a FULL OUTER JOIN b ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.text IS DISTINCT FROM b.text OR a.lang IS DISTINCT FROM b.lang OR a.source IS DISTINCT FROM b.source""")
def structural_diff(spark, sf_dir):
    """Two snapshots of the documents: added, removed and changed ids."""
    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    base, current = docs.where("id % 10 <> 0"), docs.where("id % 11 <> 0").withColumn("text", F.when(F.expr("id % 7 = 3"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return intervals.structural_diff(base, current, fields=("text", "lang", "source"))


@query("""WITH d AS (SELECT DISTINCT o_custkey AS c, p_brand AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size <= 25), q AS (SELECT b FROM (SELECT DISTINCT p_brand AS b FROM part) ORDER BY b LIMIT 5)
SELECT c AS custkey FROM d JOIN q USING (b) GROUP BY c HAVING count(*) = (SELECT count(*) FROM q)""")
def relational_division(spark, sf_dir):
    """Customers who bought parts of all of the first five brands, by matched counts."""
    parts = tables.table(spark, sf_dir, "part")
    brands = parts.select("p_brand").distinct().orderBy("p_brand").limit(5)
    bought = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = bought.join(parts.where("p_size <= 25").join(brands, "p_brand", "left_semi").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey")).groupBy("o_custkey").agg(F.count_distinct("p_brand").alias("n"))
    return pairs.join(F.broadcast(brands.agg(F.count("*").alias("needed"))), F.col("n") == F.col("needed")).select(F.col("o_custkey").alias("custkey"))


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, substr(sha256(source), 1, 8) AS slug FROM documents""")
def content_hash_index(spark, sf_dir):
    """Content hashes and short slugs."""
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.substring(F.sha2("source", 256), 1, 8).alias("slug"))
