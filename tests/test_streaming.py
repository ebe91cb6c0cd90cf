from pyspark.sql import functions as F

from graphloom.streaming import changes


def test_coalesce_and_requeue(spark):
    events = spark.createDataFrame([("a", "modified", 1.0), ("a", "deleted", 2.0), ("b", "added", 1.5)], "path string, change string, arrival_ts double")
    assert {(r.path, r.change) for r in changes.coalesced(events).collect()} == {("a", "deleted"), ("b", "added")}
    failed = spark.createDataFrame([("a", "modified", 1.0), ("c", "added", 0.5)], "path string, change string, arrival_ts double")
    assert {(r.path, r.change) for r in changes.requeue(failed, events).collect()} == {("a", "deleted"), ("b", "added"), ("c", "added")}


def test_flush_rules(spark):
    one = spark.createDataFrame([("a", 10.0, 10.0)], "path string, arrival_s double, first_s double")
    due = lambda df, now: df.transform(lambda d: changes.flush_due(d, now)).first().due
    assert not due(one, 10.5) and due(one, 11.0)
    assert due(spark.range(200).select(F.lit(10.0).alias("arrival_s"), F.lit(10.0).alias("first_s")), 10.1)
    assert due(spark.createDataFrame([("a", 14.9, 10.0)], "path string, arrival_s double, first_s double"), 15.0)
    assert not due(one.limit(0), 99.0)


def test_stateful_stream(spark, tmp_path):
    schema = "path string, change string, arrival_ms long"
    for i, rows in enumerate([[("a", "modified", 1), ("a", "deleted", 2)], [("b", "added", 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = changes.coalesce_stream(stream).writeStream.format("memory").queryName("coalesced").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.path, r.change) for r in spark.table("coalesced").collect()} == {("a", "deleted"), ("b", "added")}


def test_watch_applies_a_stream(spark, tmp_path):
    from graphloom.plans import code_queries, indexing
    from graphloom.sources.storage import GraphStore
    from graphloom.streaming.watch import commit_changed, watch

    sources = code_queries.sample_sources(spark)
    graph = indexing.build(sources)
    store = GraphStore(spark, str(tmp_path / "graph"))
    store.write(graph.nodes, graph.edges)
    schema = "path string, change string, arrival_ts double"
    spark.createDataFrame([("port/lantern.py", "modified", 1.0), ("port/lantern.py", "deleted", 2.0)], schema).write.parquet(str(tmp_path / "in"))
    query = watch(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, lambda paths: sources.where(F.col("path").isin(paths)), str(tmp_path / "ck"))
    query.awaitTermination(300)
    assert store.nodes().where("file_path = 'port/lantern.py'").count() == 0 and store.nodes().where("file_path = 'port/roster.py'").count() > 0
    commits = spark.createDataFrame([(f"c{i}", f) for i in range(4) for f in ("port/bulletin.py", "port/roster.py")], "commit_id string, file_path string")
    files = sources.select("path")
    assert commit_changed(store, "h1", commits, files) and not commit_changed(store, "h1", commits, files)
    assert store.edges().where("rel_type = 'coupled_with'").count() == 1


def test_rate_limit_counts_allowed_requests_only(spark):
    rows = [("a", t) for t in (0, 1, 30, 59, 61, 62, 90)] + [("b", 5), (None, 0), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "session string, at long").withColumn("ts", F.timestamp_seconds("at"))
    got = {(r.session, r["at"]): r.allowed for r in changes.rate_limited(df, 2, 60).collect()}
    assert [got["a", t] for t in (0, 1, 30, 59, 61, 62, 90)] == [True, True, False, False, True, True, False]
    assert got["b", 5] and [got[None, t] for t in (0, 1, 2)] == [True, True, False]
    assert changes.rate_limited(df.where("false")).count() == 0
