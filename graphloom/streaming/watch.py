"""Watching a source tree: a stream of changes keeps a stored graph up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans import indexing
from graphloom.sources.storage import GraphStore

from .changes import apply_batches


def watch(events: DataFrame, store: GraphStore, read: Callable[[list[str]], DataFrame], checkpoint: str, **trigger):
    """Start a query that applies ``events`` (path, change, arrival_ts) to ``store``.

    ``read`` gives sources (path, content, language, ord) of paths that exist.
    Batches of fewer than three files recompute unreachable symbols only. A
    batch that was applied before it failed is applied again to the same end.
    The paths of a batch are few (a flush holds some hundreds).
    """

    def handle(changes: DataFrame, small: bool) -> None:
        rows = changes.select("path", "change").collect()
        gone = [r.path for r in rows if r.change == "deleted"]
        there = read([r.path for r in rows if r.change != "deleted"])
        indexing.reindex(store, there, gone, small)

    return apply_batches(events, handle, checkpoint, **trigger)


def refresh_all(store: GraphStore) -> None:
    """The periodic refresh: communities, flows and unreachable symbols over the whole graph."""
    store = store.begin()
    done = indexing.refresh(indexing.Graph(store.nodes(), store.edges()))
    store.write(done.nodes, done.edges)


def commit_changed(store: GraphStore, head: str, commits: DataFrame, files: DataFrame) -> bool:
    """Recompute coupling when the head commit moved since the last time; tells whether it did."""
    store = store.begin()
    if store.meta().get("head") == head:
        return False
    edges = store.edges().where(F.col("rel_type") != "coupled_with")
    store.write(store.nodes(), edges.unionByName(indexing.coupling_edges(commits, files).select(*edges.columns)), {"head": head})
    return True
