"""Tables in shared storage: intermediate results that survive lost executors, and the graph store."""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.schema import EDGES, NODES, SCHEMA_VERSION
from graphloom.operators import search

#: Versions of a table that stay on disk for readers that began before the last writes.
KEPT_VERSIONS = 4
POSTINGS = "part string, id string, term string, length int, tf long"
TEXT_STATS = "part string, n long, mean_length double"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share.

    Where the cluster names none, one below /tmp/checkpoints if all runs on this
    machine; else that is an error, as executors don't see each other's folders.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        place = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: cuts lineage, and iterative steps read it instead of computing it again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/graphloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class ConcurrentWrite(RuntimeError):
    """Another writer changed a table since this one read it."""


def clean_meta(raw: Any) -> dict[str, Any]:
    """Meta values of the right shape: odd counts are 0, malformed entries of lists go, what isn't an object is empty."""
    if not isinstance(raw, dict):
        return {}
    out = dict(raw)
    if "stats" in out:
        stats = out["stats"] if isinstance(out["stats"], dict) else {}
        out["stats"] = {k: v if isinstance(v, int) else 0 for k, v in stats.items() if not isinstance(v, bool)}
    for key, kinds in (("sentinel_files", {"path": str, "mtime": float}), ("indexed_dirs", {"path": str, "mtime": float, "indexed_count": int})):
        if key in out:
            rows = []
            for entry in out[key] if isinstance(out[key], list) else []:
                try:
                    rows.append({k: kind(entry[k]) for k, kind in kinds.items()})
                except (KeyError, TypeError, ValueError):
                    continue
            out[key] = rows
    return out


class GraphStore:
    """A graph on disk: ``nodes`` by label, ``edges`` by rel_type, ``embeddings`` and a text index, for one repo.

    A write makes a new version of its tables beside the old ones; a small file
    a revision names the versions that hold, and the other meta values. It is
    created last and only if no other has its number: a crash leaves the graph as
    it was. A handle remembers which version of a table it read first since its
    last write; where another writer replaced that, its own write fails with
    ConcurrentWrite and can be begun anew. Writes to different tables both hold.
    """

    def __init__(self, spark: SparkSession, path: str, repo: str = "local"):
        self.spark, self.path, self.repo = spark, path.rstrip("/"), repo
        self._seen: dict[str, str | None] = {}

    def begin(self) -> GraphStore:
        """A handle that has read nothing yet."""
        return GraphStore(self.spark, self.path, self.repo)

    # --- revisions

    def _fs(self, path: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, path: str) -> list[str]:
        fs, place = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def _revision(self, patience: float = 2.0) -> tuple[int, dict[str, Any]]:
        """The number of the last revision, and the last whole one.

        A torn file counts as a number only, once it stayed torn for ``patience``
        seconds: until then its writer may be at it.
        """
        numbers = sorted((int(n.split(".")[0]) for n in self._names(self._folder("meta")) if n.endswith(".json")), reverse=True)
        for number in numbers:
            fs, place = self._fs(f"{self._folder('meta')}/{number:012d}.json")
            stream = fs.open(place)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                found = json.loads(text)
            except json.JSONDecodeError:
                found = None
            if number == numbers[0] and not isinstance(found, dict) and patience > 0:
                time.sleep(0.1)
                return self._revision(patience - 0.1)
            if isinstance(found, dict):
                return numbers[0], found
        return (numbers[0] if numbers else 0), {}

    def _folder(self, table: str) -> str:
        return f"{self.path}/{table}/repo={self.repo}"

    def _create(self, number: int, content: dict[str, Any]) -> bool:
        """Whether the revision could be made; false if there is one of that number."""
        fs, place = self._fs(f"{self._folder('meta')}/{number:012d}.json")
        if fs.exists(place):
            return False
        try:
            stream = fs.create(place, False)
        except Exception as error:  # py4j wraps it
            if "FileAlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        stream.write(bytearray(json.dumps(content, sort_keys=True), "utf-8"))
        stream.close()
        return True

    def _commit(self, tables: dict[str, DataFrame], values: dict[str, Any], attempts: int = 10) -> None:
        number, base = self._revision()
        seen, self._seen = {name: base.get("tables", {}).get(name) for name in tables} | self._seen, {}
        made = {}
        for name, df in tables.items():
            made[name] = f"{number + 1:012d}-{uuid.uuid4().hex[:8]}"
            writer = df.drop("repo").write
            part = {"nodes": "label", "edges": "rel_type"}.get(name)
            (writer.partitionBy(part) if part else writer).parquet(f"{self._folder(name)}/{made[name]}")
        for _ in range(attempts):
            number, now = self._revision()
            if any(now.get("tables", {}).get(name) != seen[name] for name in made):
                raise ConcurrentWrite(f"{sorted(made)} of {self.repo} were written by another")
            meta = clean_meta(now.get("meta"))
            merged = meta | values
            if isinstance(values.get("stats"), dict):
                merged["stats"] = meta.get("stats", {}) | values["stats"]
            if self._create(number + 1, {"tables": now.get("tables", {}) | made, "meta": merged}):
                self._prune(made)
                return
        raise ConcurrentWrite(f"no free revision of {self.repo} in {attempts} attempts")

    def _prune(self, made: dict[str, str]) -> None:
        """Drop all but the last versions of the tables just written."""
        for name in made:
            for version in [v for v in self._names(self._folder(name)) if v <= made[name]][:-KEPT_VERSIONS]:
                fs, place = self._fs(f"{self._folder(name)}/{version}")
                fs.delete(place, True)

    def _read(self, table: str, schema) -> DataFrame:
        version = self._revision()[1].get("tables", {}).get(table)
        self._seen.setdefault(table, version)
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self._folder(table)}/{version}")

    # --- meta

    def write_meta(self, values: dict[str, Any]) -> None:
        """Merge by key, last write wins; ``stats`` merges by its own keys."""
        self._commit({}, values)

    def meta(self) -> dict[str, Any]:
        return clean_meta(self._revision()[1].get("meta"))

    def check_version(self) -> None:
        """Refuse a graph of another schema version."""
        found = self.meta().get("schema_version")
        if found != str(SCHEMA_VERSION):
            raise ValueError(f"graph has schema version {found}, this engine {SCHEMA_VERSION}: rebuild it")

    # --- tables

    def nodes(self) -> DataFrame:
        return self._read("nodes", NODES)

    def edges(self) -> DataFrame:
        return self._read("edges", EDGES)

    def write(self, nodes: DataFrame, edges: DataFrame, values: dict[str, Any] | None = None) -> None:
        """Replace the repo's graph, with meta ``values``; both may read the stored one."""
        self._commit({"nodes": nodes.select(*NODES.fieldNames()), "edges": edges.select(*EDGES.fieldNames())}, {"schema_version": str(SCHEMA_VERSION)} | (values or {}))

    def node(self, node_id: str) -> DataFrame:
        """Point lookup; the label before the first colon prunes partitions."""
        return self.nodes().where((F.col("label") == node_id.split(":", 1)[0]) & (F.col("id") == node_id))

    def without_files(self, paths: list[str]) -> tuple[DataFrame, DataFrame]:
        """Nodes but those of these files, and edges that touch none of them."""
        gone = self.nodes().where(F.col("file_path").isin(paths)).select("id")
        nodes, edges = self.nodes().join(gone, "id", "left_anti"), self.edges()
        for end in ("src", "dst"):
            edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
        return nodes.select(*NODES.fieldNames()), edges.select(*EDGES.fieldNames())

    def delete_files(self, paths: list[str]) -> None:
        """Drop the nodes of these files and every edge that touches them."""
        now = self.begin()
        now.write(*now.without_files(paths))

    def delete_edges(self, rel_type: str) -> None:
        now = self.begin()
        now._commit({"edges": now.edges().where(F.col("rel_type") != rel_type)}, {})

    def upsert(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Last write wins by id; rows not named stay."""
        now = self.begin()
        now.write(replaced(now.nodes(), nodes, "id"), replaced(now.edges(), edges, "rel_id"))

    def embeddings(self) -> DataFrame:
        return self._read("embeddings", "id string, vec array<float>")

    def store_embeddings(self, rows: DataFrame, model: str) -> None:
        """Upsert ``rows`` (id, vec); vectors of another model than the stored ones replace them all."""
        now = self.begin()
        rows = rows.select("id", F.col("vec").cast("array<float>").alias("vec"))
        old = now.embeddings()
        if now.meta().get("embedding_model") == model:
            rows = replaced(old, rows, "id")
        now._commit({"embeddings": rows}, {"embedding_model": model})

    def update_dead(self, flags: DataFrame) -> None:
        """Set ``is_dead`` from (id, is_dead); nodes without a row keep theirs."""
        now = self.begin()
        nodes = now.nodes().join(flags.withColumnRenamed("is_dead", "new"), "id", "left").withColumn("is_dead", F.coalesce("new", "is_dead"))
        now._commit({"nodes": nodes.select(*NODES.fieldNames())}, {})

    def delete_synthetic(self) -> None:
        """Drop communities and processes with their edges."""
        now = self.begin()
        now.write(now.nodes().where("label not in ('community', 'process')"), now.edges().where("rel_type not in ('member_of', 'step_in_process')"))

    def inbound_from_elsewhere(self, path: str, excluded: list[str] | None = None) -> DataFrame:
        """Edges into nodes of ``path`` from other files, but those in ``excluded``; saved before a file is reloaded."""
        place = self.nodes().select(F.col("id").alias("nid"), F.col("file_path").alias("at"))
        dst = place.where(F.col("at") == path).select(F.col("nid").alias("dst"))
        src = place.where((F.col("at") != path) & ~F.col("at").isin(excluded or [])).select(F.col("nid").alias("src"))
        return self.edges().join(dst, "dst", "left_semi").join(src, "src", "left_semi")

    # --- text index

    def build_text_index(self) -> None:
        """Store the postings of all searchable nodes, in ranges of terms: a query reads the row groups of its terms only.

        Ranges are cut by term and id, so a frequent term has several tasks.
        """
        now = self.begin()
        postings, stats = search.node_index(now.nodes())
        ranged = postings.repartitionByRange("term", "part", "id").sortWithinPartitions("term", "part", "id")
        now._commit({"postings": ranged, "text_stats": stats.coalesce(1)}, {"text_index_of": now._seen["nodes"]})

    def text_index(self) -> tuple[DataFrame, DataFrame] | None:
        """``(postings, stats)``, or None where there is none, or nodes were written since."""
        found = self._revision()[1]
        tables = found.get("tables", {})
        if "postings" not in tables or clean_meta(found.get("meta")).get("text_index_of") != tables.get("nodes"):
            return None
        return self._read("postings", POSTINGS), self._read("text_stats", TEXT_STATS)


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
