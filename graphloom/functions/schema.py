"""The graph's schemas, labels and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1
#: Node labels and relationship types.
LABELS = ["file", "folder", "function", "class", "method", "interface", "type_alias", "enum", "enum_member", "class_attribute", "module_constant", "community", "process"]
REL_TYPES = ["contains", "defines", "calls", "imports", "extends", "implements", "member_of", "step_in_process", "uses_type", "exports", "coupled_with", "accesses"]


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


NODES = _struct("id:s label:s name:s file_path:s start_line:l end_line:l content:s signature:s language:s class_name:s is_dead:b is_entry_point:b is_exported:b cohesion:d properties:s ord:l")
EDGES = _struct("rel_id:s rel_type:s src:s dst:s confidence:d role:s step_number:l strength:d co_changes:l symbols:s access_mode:s metadata:s ord:l")

_NODE_DEFAULTS = {"s": "''", "l": "0", "d": "cast(null as double)", "b": "false"}
_EDGE_DEFAULTS = {"confidence": "1.0", "strength": "0.0", "step_number": "0", "co_changes": "0", "ord": "0"}


def node_id(label: Column, path: Column, symbol: Column) -> Column:
    return F.concat_ws(":", label, F.replace(path, F.lit("\\"), F.lit("/")), symbol)


def as_nodes(df):
    """``df`` with all node columns: missing ones get their defaults ('' and 0 rather than null)."""
    kinds = {"string": "s", "bigint": "l", "double": "d", "boolean": "b"}
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.expr(_NODE_DEFAULTS[kinds[f.dataType.simpleString()]])).cast(f.dataType).alias(f.name) for f in NODES])


def as_edges(df):
    """``df`` with all edge columns; ``rel_id`` defaults to type:src->dst."""
    made = {"rel_id": F.concat(F.col("rel_type"), F.lit(":"), F.col("src"), F.lit("->"), F.col("dst"))}
    return df.select(*[(F.col(f.name) if f.name in df.columns else made.get(f.name, F.expr(_EDGE_DEFAULTS.get(f.name, "''")))).cast(f.dataType).alias(f.name) for f in EDGES])
