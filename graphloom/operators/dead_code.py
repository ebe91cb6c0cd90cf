"""Unreachable symbols: candidates without callers, exemptions, overrides and protocols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
ENUM_BASES = ["Enum", "IntEnum", "StrEnum", "Flag", "IntFlag"]
CONSTRUCTORS = ["__init__", "__new__"]
FRAMEWORK_DECORATORS = [
    "task", "shared_task", "periodic_task", "job", "receiver", "on_event", "handler", "validator", "field_validator", "root_validator", "model_validator", "contextmanager", "asynccontextmanager", "fixture", "route", "endpoint",
    "command", "hybrid_property",
]
PLAIN_DOTTED = ["functools.wraps", "functools.lru_cache", "functools.cached_property", "functools.cache"]
STUB_DECORATORS = ["overload", "typing.overload", "abstractmethod", "abc.abstractmethod"]


def is_test_file(path: Column) -> Column:
    """A segment tests, test or test_*, or a conftest.py."""
    return F.exists(F.split(path, "/"), lambda s: s.isin("tests", "test") | s.startswith("test_")) | path.endswith("conftest.py")


def _dunder(name: Column) -> Column:
    return name.startswith("__") & name.endswith("__") & (F.length(name) > 4)


def exempt() -> Column:
    name, path, decs = F.col("name"), F.col("file_path"), F.col("decorators")
    framework = F.exists(decs, lambda d: d.isin(FRAMEWORK_DECORATORS) | (d.contains(".") & ~d.isin(PLAIN_DOTTED)))
    return (
        F.col("is_entry_point") | F.col("is_exported") | name.isin(CONSTRUCTORS) | name.startswith("test_") | name.rlike(r"^Test\p{Lu}") | is_test_file(path) | _dunder(name)
        | (path.endswith("__init__.py") & ~name.startswith("_")) | framework | F.array_contains(decs, "property") | F.arrays_overlap(decs, F.lit(STUB_DECORATORS))
        | ((F.col("label") == "class") & F.arrays_overlap("bases", F.lit(ENUM_BASES)))
    )


def dead_symbols(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, is_dead)`` of functions, methods and classes.

    ``nodes``: id, label, name, file_path, class_name, is_entry_point,
    is_exported, decorators, bases (arrays), is_protocol. ``edges``: src, dst,
    rel_type. Flags are recomputed from nothing: stored ones are ignored.
    """
    symbols = nodes.where(F.col("label").isin("function", "method", "class")).withColumns({c: F.coalesce(c, F.expr("cast(array() as array<string>)")) for c in ("decorators", "bases")})
    used = edges.where("rel_type in ('calls', 'uses_type')").groupBy(F.col("dst").alias("id")).agg(F.max(F.col("rel_type") == "calls").alias("called"), F.max(F.col("rel_type") == "uses_type").alias("typed"))
    flagged = symbols.join(used, "id", "left").withColumn("dead", ~F.coalesce("called", F.lit(False)) & ~((F.col("label") == "class") & F.coalesce("typed", F.lit(False))) & ~exempt())
    methods = flagged.where("label = 'method'")
    classes = flagged.where("label = 'class'")
    alive = methods.where("not dead").select(F.col("class_name").alias("base"), "name").distinct()
    # a method that overrides a living one of a direct parent, by name; living before this pass
    named = nodes.select("id", "name")
    extends = edges.where("rel_type = 'extends'").select("src", "dst")
    parents = extends.join(named.select(F.col("id").alias("src"), F.col("name").alias("class_name")), "src").join(named.select(F.col("id").alias("dst"), F.col("name").alias("base")), "dst").select("class_name", "base").distinct()
    overriding = methods.where("dead").join(parents, "class_name").join(alive, ["base", "name"]).select("id").distinct()
    # classes that have all methods of a protocol but dunders; each class meets the protocols it shares a method with
    protocols = classes.where("is_protocol").select(F.col("name").alias("protocol")).distinct()
    wanted = methods.join(protocols, F.col("class_name") == F.col("protocol")).where(~_dunder(F.col("name"))).select("protocol", "name").distinct()
    needs = wanted.groupBy("protocol").agg(F.count("*").alias("needed"))
    having = methods.select("class_name", "name").distinct().join(wanted, "name").groupBy("class_name", "protocol").agg(F.count("*").alias("n"))
    conforming = having.join(needs, "protocol").where("n = needed and class_name <> protocol").select("class_name", "protocol").distinct()
    kept = methods.join(conforming, "class_name").join(wanted, ["protocol", "name"], "left_semi").select("id").distinct()
    stubs = methods.join(protocols, F.col("class_name") == F.col("protocol"), "left_semi").select("id")
    revived = overriding.union(kept).union(stubs).distinct().withColumn("back", F.lit(True))
    return flagged.join(revived, "id", "left").select("id", (F.col("dead") & F.col("back").isNull()).alias("is_dead"))
