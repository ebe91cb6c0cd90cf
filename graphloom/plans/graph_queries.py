"""Queries on graphs derived from the tables: traversals, coupling, aggregates, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import analysis, communities, coupling, flows, traversal
from graphloom.sources import tables
from graphloom.sources.storage import materialize
from graphloom.streaming import changes

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Each supplier's two most frequent successors within an order.
_EDGES = """
ln AS (SELECT l_orderkey o, l_linenumber n, l_suppkey k, min(l_returnflag) flag FROM lineitem GROUP BY 1, 2, 3),
nx AS (SELECT k AS src, flag, lead(k) OVER (PARTITION BY o ORDER BY n, k) AS dst FROM ln),
ct AS (SELECT src, dst, count(*) AS n, min(flag) AS kind FROM nx WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2),
rk AS (SELECT src, dst, n, kind, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rk, CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY src) AS confidence FROM ct),
e AS (SELECT src, dst, n, kind, rk, confidence FROM rk WHERE rk <= 2)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _one(spark: SparkSession, value: int) -> DataFrame:
    return spark.createDataFrame([(value,)], "id long")


def _supplier_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges, aggregated once for all steps of an iterative query."""
    return materialize(tables.supplier_calls(spark, sf_dir), "supplier-calls")


@query(f"""WITH RECURSIVE {_EDGES},
w(id, d) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.src, w.d + 1 FROM w JOIN e ON e.dst = w.id WHERE w.d < 3)
SELECT id, CAST(min(d) AS INTEGER) AS depth FROM w WHERE id <> 1 GROUP BY id""")
def impact_depth(spark, sf_dir):
    """G1: callers of supplier 1 within three hops, by least depth."""
    return traversal.bfs(_supplier_graph(spark, sf_dir), _one(spark, 1), 3, "callers")


@query(f"""WITH RECURSIVE {_EDGES},
w(id, d) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, w.d + 1 FROM w JOIN e ON e.src = w.id WHERE w.d < 6 AND e.kind IN ('A', 'N')),
m AS (SELECT id, min(d) AS d FROM w GROUP BY id)
SELECT m.id, CAST(m.d AS INTEGER) AS depth, min(e.kind) AS kind FROM m JOIN e ON e.dst = m.id AND e.kind IN ('A', 'N') JOIN m p ON p.id = e.src AND p.d = m.d - 1 WHERE m.id <> 1 GROUP BY m.id, m.d""")
def impact_filtered(spark, sf_dir):
    """Callees of supplier 1 over edges of two kinds, with the least kind that reaches each first."""
    return traversal.bfs(_supplier_graph(spark, sf_dir), _one(spark, 1), 6, "callees", ["A", "N"])


@query(f"""WITH {_EDGES} SELECT e.src AS caller, s.s_name AS caller_name, round(e.confidence, 6) AS confidence FROM e JOIN supplier s ON s.s_suppkey = e.src WHERE e.dst BETWEEN 1 AND 5""")
def callers_confidence(spark, sf_dir):
    """Callers of suppliers 1 to 5 with the edge's confidence."""
    nodes = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    found = traversal.neighbours(tables.supplier_calls(spark, sf_dir), nodes, spark.range(1, 6), "callers")
    return found.select(F.col("id").alias("caller"), F.col("name").alias("caller_name"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH RECURSIVE {_EDGES},
w(id, d) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, w.d + 1 FROM w JOIN e ON e.src = w.id WHERE w.d < 10),
m AS (SELECT id, min(d) AS d FROM w GROUP BY id),
goal AS (SELECT id, d FROM m WHERE id <> 1 ORDER BY d DESC, id LIMIT 1),
p AS (SELECT m.id, m.d, min(e.src) AS prev FROM m JOIN e ON e.dst = m.id JOIN m q ON q.id = e.src AND q.d = m.d - 1 GROUP BY m.id, m.d),
b(hop, id) AS (SELECT d, id FROM goal UNION ALL SELECT b.hop - 1, p.prev FROM b JOIN p ON p.id = b.id WHERE b.hop > 0)
SELECT CAST(hop AS INTEGER) AS hop, id FROM b""")
def call_path(spark, sf_dir):
    """The shortest path from supplier 1 to the one farthest from it (the least of these)."""
    edges = _supplier_graph(spark, sf_dir)
    far = traversal.bfs(edges, _one(spark, 1), 10).orderBy(F.desc("depth"), "id").select("id").first()
    return traversal.shortest_path(edges, 1, far[0] if far else 1)


@query(f"""WITH RECURSIVE {_EDGES}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
c AS (SELECT v.id, least(v.id, coalesce(min(x.b), v.id)) AS component FROM v LEFT JOIN (SELECT r.a, r.b FROM r JOIN r s ON s.a = r.b AND s.b = r.a) x ON x.a = v.id GROUP BY v.id)
SELECT id, component FROM c""")
def cycles_scc(spark, sf_dir):
    """The strongly connected component of each supplier."""
    return traversal.strong_components(tables.supplier_calls(spark, sf_dir))


@query("""SELECT 'region' AS label, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders""")
def overview_labels(spark, sf_dir):
    """A1: nodes a label."""
    return analysis.counts(tables.hierarchy_nodes(spark, sf_dir), "label")


@query("""SELECT 'contains' AS rel_type, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS n""")
def overview_rels(spark, sf_dir):
    """A1: edges a relationship type."""
    return analysis.counts(tables.hierarchy_edges(spark, sf_dir), "rel_type")


@query("""SELECT r_name AS region, n_name AS nation, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def contains_tree(spark, sf_dir):
    """The forest of regions and nations with counts below; orders are counted a customer before they meet nations."""
    t = lambda n: tables.table(spark, sf_dir, n)
    orders = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    below = t("customer").join(orders, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_distinct("c_custkey").alias("customers"), F.coalesce(F.sum("k"), F.lit(0)).alias("orders"))
    joined = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(below, "n_nationkey", "left")
    return joined.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("orders", F.lit(0)).alias("orders"))


def _coupling_sql(commits: str, files: int, cochanges: int, strength: float) -> str:
    return f"""c AS (SELECT DISTINCT * FROM ({commits})), z AS (SELECT cid FROM c GROUP BY cid HAVING count(*) <= {files}), t AS (SELECT f, count(*) AS n FROM c GROUP BY f),
p AS (SELECT x.f AS a, y.f AS b, count(*) AS co_changes FROM c x JOIN c y ON x.cid = y.cid AND x.f < y.f WHERE x.cid IN (SELECT cid FROM z) GROUP BY 1, 2 HAVING count(*) >= {cochanges}),
s AS (SELECT a, b, co_changes, CAST(co_changes AS DOUBLE) / greatest(ta.n, tb.n) AS strength FROM p JOIN t ta ON ta.f = a JOIN t tb ON tb.f = b WHERE CAST(co_changes AS DOUBLE) / greatest(ta.n, tb.n) >= {strength})"""


_EVENTS = _coupling_sql("SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS cid, event_type AS f FROM events", 50, 3, 0.3)
_ORDERS = _coupling_sql("SELECT CAST(l_orderkey AS VARCHAR) AS cid, CAST(l_suppkey AS VARCHAR) AS f FROM lineitem", 50, 3, 0.04)


@query(f"WITH {_EVENTS} SELECT a, b, co_changes, round(strength, 6) AS strength FROM s")
def coupling_events(spark, sf_dir):
    """Coupling of event types by user and day, with the default thresholds."""
    return coupling.coupling(tables.event_commits(spark, sf_dir)).withColumn("strength", F.round("strength", 6))


@query(f"WITH {_ORDERS} SELECT a, b, co_changes, round(strength, 6) AS strength FROM s")
def coupling_suppliers(spark, sf_dir):
    """Coupling of suppliers by order, at a lower strength."""
    return coupling.coupling(tables.supplier_commits(spark, sf_dir), min_strength=0.04).withColumn("strength", F.round("strength", 6))


@query(f"""WITH {_ORDERS}, {_EDGES}, u AS (SELECT a AS id, b AS other, strength, co_changes FROM s UNION ALL SELECT b, a, strength, co_changes FROM s)
SELECT id, other, round(strength, 6) AS strength, co_changes, NOT EXISTS (SELECT 1 FROM e WHERE CAST(e.src AS VARCHAR) = id AND CAST(e.dst AS VARCHAR) = other) AS hidden FROM u WHERE id IN ('1', '2', '3', '4', '5', '6', '7', '8')""")
def hidden_coupling(spark, sf_dir):
    """Partners of eight suppliers in either direction; hidden ones have no edge to them."""
    pairs = coupling.coupling(tables.supplier_commits(spark, sf_dir), min_strength=0.04)
    imports = tables.supplier_calls(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return coupling.coupled_with(pairs, spark.range(1, 9).select(F.col("id").cast("string").alias("id")), imports, 0.04).withColumn("strength", F.round("strength", 6))


@query(f"WITH {_EDGES} SELECT s.s_name AS name, count(*) AS callers FROM e JOIN supplier s ON s.s_suppkey = e.dst GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def most_called(spark, sf_dir):
    """A3: the ten suppliers with most edges into them."""
    nodes = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return analysis.most_called(tables.supplier_calls(spark, sf_dir), nodes, 10)


@query(f"""WITH {_EDGES}, g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id)
SELECT s_suppkey AS id, coalesce(degree, 0) AS degree, round(50 + least(60, ln(coalesce(degree, 0) + 1) * 20), 6) AS size FROM supplier LEFT JOIN g ON g.id = s_suppkey""")
def degree_sizes(spark, sf_dir):
    """Degrees, and sizes to draw nodes."""
    nodes = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("function").alias("label"))
    return traversal.degree_sizes(tables.supplier_calls(spark, sf_dir), nodes).withColumn("size", F.round("size", 6))


@query(f"""WITH {_EDGES}, d AS (SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = 7),
x AS (SELECT id FROM d UNION SELECT dst FROM e JOIN d ON d.id = e.src UNION SELECT src FROM e JOIN d ON d.id = e.dst) SELECT id FROM x""")
def dirty_closure(spark, sf_dir):
    """Suppliers of a changed nation and their neighbours."""
    nodes = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("file_path"))
    return analysis.dirty_closure(nodes, tables.supplier_calls(spark, sf_dir), spark.createDataFrame([(7,)], "file_path int"))


@query(f"""WITH {_EDGES}, m AS (SELECT s_suppkey AS id, s_nationkey AS community FROM supplier), i AS (SELECT a.community, count(*) AS n FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst WHERE a.community = b.community GROUP BY 1),
z AS (SELECT community, count(*) AS size FROM m GROUP BY 1)
SELECT z.community, z.size, coalesce(i.n, 0) AS "inner", round(CASE WHEN z.size > 1 THEN coalesce(i.n, 0) / CAST(z.size * (z.size - 1) AS DOUBLE) ELSE 0 END, 6) AS cohesion FROM z LEFT JOIN i ON i.community = z.community""")
def cohesion_by_nation(spark, sf_dir):
    """Cohesion of the suppliers of each nation."""
    members = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("community"))
    return communities.cohesion(tables.supplier_calls(spark, sf_dir), members).withColumn("cohesion", F.round("cohesion", 6))


def _weighted(spark, sf_dir):
    return _supplier_graph(spark, sf_dir).select("src", "dst", F.col("confidence").alias("weight"))


@query()
def communities_suppliers(spark, sf_dir):
    """Communities of the supplier graph."""
    return communities.communities(_weighted(spark, sf_dir))


@query()
def communities_propagated(spark, sf_dir):
    """The same by the distributed method for graphs beyond one task."""
    return communities.communities(_weighted(spark, sf_dir), "propagation")


# flows by a queue: each step takes the next node of a flow and adds its targets
_FLOWS = f"""{_EDGES}, tg AS (SELECT src, list(dst ORDER BY confidence DESC, dst) AS targets FROM e GROUP BY src),
w(entry, steps, depths, pos) AS (SELECT s_suppkey, [s_suppkey], [0], 1 FROM supplier UNION ALL
  SELECT entry, list_concat(steps, fresh), list_concat(depths, list_transform(fresh, lambda x: depths[pos] + 1)), pos + 1
  FROM (SELECT w.*, list_slice(list_filter(coalesce(tg.targets, []), lambda x: NOT list_contains(w.steps, x)), 1, greatest(0, least(3, 25 - len(w.steps)))) AS fresh FROM w LEFT JOIN tg ON tg.src = w.steps[w.pos] WHERE w.pos <= len(w.steps) AND w.depths[w.pos] < 6)),
fl AS MATERIALIZED (SELECT entry, arg_max(steps, pos) AS steps FROM w GROUP BY entry)"""


def _flows(spark, sf_dir):
    return flows.trace_flows(_supplier_graph(spark, sf_dir), tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


@query(f"""WITH RECURSIVE {_FLOWS} SELECT entry, array_to_string(steps, ' ') AS steps FROM fl""")
def flow_trace(spark, sf_dir):
    """The bounded flow from each supplier."""
    return _flows(spark, sf_dir).select("entry", F.array_join(F.col("steps").cast("array<string>"), " ").alias("steps"))


@query(f"""WITH RECURSIVE {_FLOWS}, so AS MATERIALIZED (SELECT steps, row_number() OVER (ORDER BY len(steps) DESC, entry) AS k FROM fl),
d(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[][]) UNION ALL SELECT so.k, CASE WHEN len(list_filter(d.kept, lambda f: len(list_intersect(f, so.steps)) > 0.5 * least(len(f), len(so.steps)))) = 0 THEN list_append(d.kept, so.steps) ELSE d.kept END FROM d JOIN so ON so.k = d.k + 1),
u AS (SELECT unnest(arg_max(kept, k)) AS steps FROM d) SELECT steps[1] AS entry, array_to_string(steps, ' ') AS steps FROM u WHERE len(steps) > 1""")
def flow_dedup(spark, sf_dir):
    """The flows of all suppliers that greedy selection keeps."""
    return flows.dedup_flows(_flows(spark, sf_dir)).select("entry", F.array_join(F.col("steps").cast("array<string>"), " ").alias("steps"))


@query(f"""WITH RECURSIVE {_FLOWS}, x AS (SELECT entry, unnest(steps) AS id, unnest(range(1, len(steps) + 1)) AS n FROM fl)
SELECT entry, count(*) AS step_count, array_to_string((list(s_name ORDER BY n))[1:4], ' → ') AS label, CASE WHEN count(DISTINCT s_nationkey) = 1 THEN 'intra_community' ELSE 'cross_community' END AS kind FROM x JOIN supplier ON s_suppkey = id GROUP BY entry""")
def flow_kind(spark, sf_dir):
    """Kinds and labels of the flows of all suppliers, nations as communities."""
    suppliers = tables.table(spark, sf_dir, "supplier")
    return flows.flow_kinds(_flows(spark, sf_dir), suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("community")))


@query(f"""WITH RECURSIVE {_FLOWS} SELECT unnest(steps) AS src, 'process:' || entry AS dst, unnest(range(0, len(steps))) AS step_number FROM fl""")
def flow_steps(spark, sf_dir):
    """The edges from each step to its flow, numbered from 0."""
    return flows.process_rows(_flows(spark, sf_dir))


@query("""SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1""")
def json_overflow(spark, sf_dir):
    """§1.2: numbers inside a JSON overflow column; malformed text gives null, never an error."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return tables.table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"), F.count("*").alias("n"))


@query("""SELECT CAST(user_id AS VARCHAR) AS path, arg_max(event_type, (ts, event_type)) AS change, count(*) AS n FROM events GROUP BY 1""")
def stream_coalesce(spark, sf_dir):
    """The last change of each path, from a stream read to its end; each micro-batch is merged into the table so far."""
    import uuid

    from graphloom.sources.storage import shared_dir

    base = f"{shared_dir(spark)}/graphloom/stream-{uuid.uuid4().hex}"
    source = tables.table(spark, sf_dir, "events")
    # one file is one stream: a glob keeps the reader on it
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    events = stream.select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("change"), F.col("ts").cast("timestamp").alias("arrival_ts"))

    def merge(batch: DataFrame, number: int) -> None:
        batch.groupBy("path").agg(F.max(F.struct("arrival_ts", "change")).alias("last"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{base}/batches/batch={number}")

    events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.parquet(f"{base}/batches")
    return parts.groupBy("path").agg(F.max("last").alias("l"), F.sum("n").alias("n")).select("path", F.col("l.change").alias("change"), "n")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM y GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    """Bursts of a user's events separated by an hour of quiet."""
    events = tables.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return changes.quiet_sessions(events, "user_id", "ts", "1 hour").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s(event_id, user_id, k, kept, allowed) AS (SELECT event_id, user_id, k, [t], true FROM e WHERE k = 1 UNION ALL
SELECT event_id, user_id, k, CASE WHEN len(recent) < 3 THEN list_append(recent, t) ELSE recent END, len(recent) < 3 FROM (SELECT e.*, list_filter(s.kept, lambda x: e.t - x < 86400000000) AS recent FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
SELECT event_id, allowed FROM s""")
def rate_limit(spark, sf_dir):
    """At most three allowed events a user and sliding day; refused ones don't count."""
    events = tables.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"), "ts")
    return changes.rate_limited(events, 3, 86400, tie="event_id").select("event_id", "allowed")
