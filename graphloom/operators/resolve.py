"""Resolution: imports, calls, heritage, type uses and member accesses, as joins and one window each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that never make a call edge.
BLOCKLIST = (
    # Python builtins
    "print len range map filter sorted list dict set str int float bool type super isinstance issubclass hasattr getattr setattr open iter next zip enumerate any all min max sum abs round repr id hash dir vars input format tuple "
    "frozenset bytes bytearray memoryview object property classmethod staticmethod delattr callable compile eval exec globals locals breakpoint exit quit "
    # common methods
    "append extend update pop get items keys values split join strip replace startswith endswith lower upper encode decode read write close "
    # JavaScript globals and methods
    "console setTimeout setInterval clearTimeout clearInterval JSON Array Object Promise Math Date Error Symbol parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent fetch require exports module document window process "
    "Buffer URL log error warn info debug parse stringify assign freeze isArray from of resolve reject race floor ceil random "
    # React hooks
    "useState useEffect useRef useCallback useMemo useContext useReducer useLayoutEffect useImperativeHandle useDebugValue useId useTransition useDeferredValue"
).split()
PROTOCOL_MARKERS = ["Protocol", "ABC", "ABCMeta"]
LABEL_ORDER = ["function", "method", "class", "interface", "type_alias"]
FUZZY_LIMIT, CALLBACK_SCALE, REFERENCE_CONFIDENCE = 5, 0.8, 0.5
JS_SUFFIXES = [".ts", ".js", ".tsx", ".jsx"]


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _up(folder: Column, steps: Column) -> Column:
    """The folder ``steps`` levels above; null above the root."""
    parts = F.when(folder == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(folder, "/"))
    return F.when(steps <= F.size(parts), F.array_join(F.slice(parts, 1, F.size(parts) - steps), "/"))


def _join(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).when(rest == "", folder).otherwise(F.concat_ws("/", folder, rest))


def normal_path(path: Column) -> Column:
    """``.`` and ``..`` segments resolved."""
    step = lambda acc, s: F.when(s.isin("", "."), acc).when((s == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step), "/")


def source_roots(files: DataFrame) -> DataFrame:
    """``(root)``: parents of package folders that aren't packages themselves, but the top level."""
    packages = files.where(F.col("path").rlike(r"(^|/)__init__\.py$")).select(_parent(F.col("path")).alias("folder")).where("folder <> ''").distinct()
    parents = packages.select(_parent(F.col("folder")).alias("root")).where("root <> ''").distinct()
    return parents.join(packages.withColumnRenamed("folder", "root"), "root", "left_anti")


def resolve_imports(imports: DataFrame, files: DataFrame, strict_compat: bool = False) -> DataFrame:
    """``(import_id, file_path, target, names)``: the first existing candidate of each import.

    ``imports``: import_id, file_path, module, names, is_relative; ``files``:
    path, language. Python: leading dots climb folders; absolute modules are
    tried at the top, then at each source root in order; ``p.py`` before
    ``p/__init__.py``. JavaScript and TypeScript: relative specifiers only, as
    written, with each suffix, then as folders with an index. Candidates are an
    array a row; the first that exists is a minimum, so no file is scanned per
    import.
    """
    roots = files.sparkSession.createDataFrame([("",)], "root string").unionByName(source_roots(files)).agg(F.array_sort(F.collect_set("root")).alias("roots"))
    language = files.select(F.col("path").alias("file_path"), F.col("language").alias("lang")).distinct()
    known = imports.join(language, "file_path")
    module, folder = F.col("module"), _parent(F.col("file_path"))
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    climbed = _up(folder, dots - 1)
    inner = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    as_python = lambda base: F.array(F.concat(base, F.lit(".py")), _join(base, F.lit("__init__.py")))
    relative = F.when(inner == "", F.array(_join(climbed, F.lit("__init__.py")))).otherwise(as_python(_join(climbed, inner)))
    absolute = F.flatten(F.transform("roots", lambda r: as_python(_join(r, F.replace(module, F.lit("."), F.lit("/"))))))
    python = F.when(F.col("is_relative") | module.startswith("."), relative).otherwise(absolute)
    plain = _join(folder, F.regexp_replace(module, r"^\./", ""))
    spec = plain if strict_compat else normal_path(_join(folder, module))
    script = F.when(module.startswith("."), F.concat(F.array(spec), *[F.array(F.concat(spec, F.lit(s))) for s in JS_SUFFIXES], *[F.array(F.concat(spec, F.lit("/index" + s))) for s in JS_SUFFIXES]))
    tried = known.join(F.broadcast(roots)).withColumn("c", F.when(F.col("lang") == "python", python).otherwise(script))
    exploded = tried.select("import_id", "file_path", "names", F.posexplode("c").alias("k", "target")).where("target is not null")
    met = exploded.join(files.select(F.col("path").alias("target")).distinct(), "target")
    return met.groupBy("import_id").agg(F.min(F.struct("k", "target", "file_path", "names")).alias("m")).select("import_id", "m.file_path", "m.target", "m.names")


def import_edges(resolved: DataFrame) -> DataFrame:
    """``(src, dst, symbols)``: one a file pair, names united, sorted and comma-joined."""
    return resolved.groupBy(F.col("file_path").alias("src"), F.col("target").alias("dst")).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), ",").alias("symbols"))


def _rank(label: Column) -> Column:
    return F.coalesce(F.array_position(F.lit(LABEL_ORDER), label), F.lit(len(LABEL_ORDER) + 1))


def resolve_calls(calls: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """``(call_id, target, confidence, tier)`` of calls that resolve.

    ``calls``: call_id, name, file_path, receiver ('' if none), caller_class.
    ``symbols``: id, name, label, file_path, class_name, ord. ``imported``:
    file_path, name, target_file; name '*' imports all. Tiers: 1 a self or this
    call to a method of the same file (same class first); 2 a symbol of the same
    file; 3 of an imported file; 4 up to five candidates anywhere, the longest
    common folder prefix, then the shortest path; the first in (label, ord)
    order otherwise. Names of the blocklist count only after self or this. The
    cascade is one join on the name and one minimum; a name with more than five
    symbols leaves the join through its file or its imports only, so a common
    name doesn't multiply rows.
    """
    on_self = F.col("receiver").isin("self", "this")
    live = calls.where(on_self | ~F.col("name").isin(BLOCKLIST))
    s = symbols.select("id", "name", _rank(F.col("label")).alias("lr"), F.col("file_path").alias("sf"), "class_name", "label", "ord")
    order = F.struct("lr", "ord", "id")
    same = live.join(s.withColumnRenamed("sf", "file_path"), ["name", "file_path"])
    t1 = same.where(on_self & (F.col("label") == "method")).select("call_id", "id", F.lit(1).alias("tier"), F.struct(F.when(F.col("class_name") == F.col("caller_class"), 0.0).otherwise(1.0).alias("a"), F.lit(0.0).alias("b"), order.alias("o")).alias("k"))
    flat = lambda df, tier, a=F.lit(0.0), b=F.lit(0.0): df.select("call_id", "id", F.lit(tier).alias("tier"), F.struct(a.alias("a"), b.alias("b"), order.alias("o")).alias("k"))
    named = live.join(imported.select("file_path", "name", F.col("target_file").alias("sf")).distinct(), ["file_path", "name"])
    starred = live.join(imported.where("name = '*'").select("file_path", F.col("target_file").alias("sf")).distinct(), "file_path")
    brought = named.select("call_id", "name", "sf").union(starred.select("call_id", "name", "sf")).distinct().join(s, ["name", "sf"])
    few = s.join(s.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") <= FUZZY_LIMIT).select("name"), "name", "left_semi")
    anywhere = live.join(few, "name")
    a, b = F.split(_parent(F.col("file_path")), "/"), F.split(_parent(F.col("sf")), "/")
    common = F.aggregate(F.sequence(F.lit(0), F.least(F.size(a), F.size(b)) - 1), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, i: F.struct((acc["n"] + F.when(acc["go"] & (F.get(a, i) == F.get(b, i)), 1).otherwise(0)).alias("n"), (acc["go"] & (F.get(a, i) == F.get(b, i))).alias("go")), lambda acc: acc["n"])
    tiers = t1.union(flat(same, 2)).union(flat(brought, 3)).union(flat(anywhere, 4, -common.cast("double"), F.length("sf").cast("double")))
    best = tiers.groupBy("call_id").agg(F.min(F.struct("tier", "k", "id")).alias("m"))
    return best.select("call_id", F.col("m.id").alias("target"), F.when(F.col("m.tier") == 4, 0.5).otherwise(1.0).alias("confidence"), F.col("m.tier").alias("tier"))


def call_edges(calls: DataFrame, symbols: DataFrame, imported: DataFrame, decorators: DataFrame | None = None) -> DataFrame:
    """``(src, dst, confidence, via, metadata)``: the edges of all calls, the first of a pair kept.

    ``calls`` also has src (the containing symbol, or the file), arguments,
    is_reference, receiver_type, call_ord, file_ord, metadata. In order: the
    target (references at 0.5, only if resolved for sure), bare arguments as
    callbacks (times 0.8), the receiver as a symbol, the receiver's method
    (0.8). ``decorators``: src, name, file_path, ord; last segment first, then
    the whole dotted name; these come last.
    """
    base = calls.withColumn("at", F.struct("file_ord", "call_ord"))
    none = F.lit("")
    parts = [base.select("src", "at", F.lit(0).alias("branch"), F.lit(0).alias("n"), "name", "file_path", "receiver", "caller_class", "is_reference", F.lit(1.0).alias("scale"), "metadata")]
    parts.append(base.select("src", "at", F.lit(1).alias("branch"), F.posexplode("arguments").alias("n", "name"), "file_path", none.alias("receiver"), "caller_class", F.lit(False).alias("is_reference"), F.lit(CALLBACK_SCALE).alias("scale"), "metadata"))
    parts.append(base.where("receiver not in ('', 'self', 'this')").select("src", "at", F.lit(2).alias("branch"), F.lit(0).alias("n"), F.col("receiver").alias("name"), "file_path", none.alias("receiver"), "caller_class", F.lit(False).alias("is_reference"), F.lit(1.0).alias("scale"), "metadata"))
    if decorators is not None:
        far = F.struct(F.lit(1 << 60).alias("file_ord"), F.col("ord").alias("call_ord"))
        parts.append(decorators.select("src", far.alias("at"), F.lit(4).alias("branch"), F.posexplode(F.array_distinct(F.array(F.element_at(F.split("name", r"\."), -1), F.col("name")))).alias("n", "name"), "file_path", none.alias("receiver"), none.alias("caller_class"), F.lit(False).alias("is_reference"), F.lit(1.0).alias("scale"), none.alias("metadata")))
    asked = parts[0]
    for p in parts[1:]:
        asked = asked.unionByName(p)
    asked = asked.withColumn("call_id", F.to_json(F.struct("src", "at", "branch", "n", "name")))
    met = asked.join(resolve_calls(asked, symbols, imported), "call_id").where("not is_reference or confidence >= 1.0")
    made = met.select("src", F.col("target").alias("dst"), F.when(F.col("is_reference"), F.lit(REFERENCE_CONFIDENCE)).otherwise(F.col("confidence") * F.col("scale")).alias("confidence"), F.when(F.col("is_reference"), "reference").otherwise("").alias("via"), "metadata", F.struct("at", "branch", "n").alias("o"))
    methods = symbols.where("label = 'method'").select(F.col("name").alias("mn"), F.col("class_name").alias("mc"), F.col("file_path").alias("mf"), F.col("id").alias("mid"), F.col("ord").alias("mord"))
    owner = F.coalesce(F.nullif("receiver_type", F.lit("")), "receiver")
    through = base.where("receiver not in ('', 'self', 'this')").withColumn("owner", owner).join(methods, (F.col("name") == F.col("mn")) & (F.col("owner") == F.col("mc")))
    key = F.struct((F.col("mf") != F.col("file_path")).alias("far"), "mord", "mid")
    picked = through.groupBy("src", "at", "metadata").agg(F.min(key).alias("k")).select("src", F.col("k.mid").alias("dst"), F.lit(CALLBACK_SCALE).alias("confidence"), F.lit("").alias("via"), "metadata", F.struct("at", F.lit(3).alias("branch"), F.lit(0).alias("n")).alias("o"))
    first = made.unionByName(picked).groupBy("src", "dst").agg(F.min_by(F.struct("confidence", "via", "metadata"), "o").alias("e"))
    return first.select("src", "dst", "e.*")


def heritage_edges(heritage: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(edges(child, kind, parent), protocols(id))`` of ``heritage`` (child_name, kind, parent_name, file_path).

    Both ends: a class or interface of that name, same file first, then the
    first. A child whose parent isn't found but is Protocol, ABC or ABCMeta is
    a protocol; other unknown parents are dropped.
    """
    kinds = symbols.where("label in ('class', 'interface')").select("id", "name", F.col("file_path").alias("sf"), _rank(F.col("label")).alias("lr"), "ord")
    rows = heritage.withColumn("hid", F.to_json(F.struct("file_path", "child_name", "kind", "parent_name")))

    def end(col: str) -> DataFrame:
        met = rows.select("hid", "file_path", F.col(col).alias("name")).join(kinds, "name")
        return met.groupBy("hid").agg(F.min(F.struct((F.col("sf") != F.col("file_path")).alias("far"), "lr", "ord", "id")).alias("m")).select("hid", F.col("m.id").alias(col[:-5]))

    met = rows.join(end("child_name"), "hid").join(end("parent_name"), "hid", "left")
    edges = met.where("parent is not null and parent <> child").select("child", "kind", "parent").distinct()
    return edges, met.where(F.col("parent").isNull() & F.col("parent_name").isin(PROTOCOL_MARKERS)).select(F.col("child").alias("id")).distinct()


def type_edges(refs: DataFrame, symbols: DataFrame, compat: bool = False) -> DataFrame:
    """``(src, dst, role)`` of ``refs`` (src, name, role, file_path): the type of that name, same file first.

    Only classes, interfaces and type aliases can be types, unless ``compat``
    lets callables in as well.
    """
    allowed = LABEL_ORDER if compat else LABEL_ORDER[2:]
    kinds = symbols.where(F.col("label").isin(allowed)).select("id", "name", F.col("file_path").alias("sf"), _rank(F.col("label")).alias("lr"), "ord")
    met = refs.withColumn("rid", F.to_json(F.struct("src", "name", "role", "file_path"))).join(kinds, "name")
    best = met.groupBy("rid", "src", "role").agg(F.min(F.struct((F.col("sf") != F.col("file_path")).alias("far"), "lr", "ord", "id")).alias("m"))
    return best.select("src", F.col("m.id").alias("dst"), "role").distinct()


def member_edges(accesses: DataFrame, members: DataFrame, imported: DataFrame) -> DataFrame:
    """``(src, dst, line, mode, confidence)`` of ``accesses`` (src, owner, name, line, mode, file_path).

    With an owner: all members (class_name, name); a bare name: a module
    constant of the same file, else of an imported one. Without a containing
    symbol (src null) nothing. 1.0 in the same file, else 0.8.
    """
    live = accesses.where("src is not null")
    m = members.select("id", F.col("name").alias("mn"), F.col("class_name").alias("mc"), F.col("file_path").alias("mf"), "label")
    owned = live.where("owner <> ''").join(m, (F.col("owner") == F.col("mc")) & (F.col("name") == F.col("mn")))
    constants = m.where("label = 'module_constant'")
    bare = live.where("owner = ''")
    same = bare.join(constants, (F.col("name") == F.col("mn")) & (F.col("file_path") == F.col("mf")))
    rest = bare.join(constants.select(F.col("mn").alias("name"), F.col("mf").alias("file_path")), ["name", "file_path"], "left_anti")
    brought = imported.select("file_path", F.col("name").alias("iname"), F.col("target_file").alias("mf")).distinct()
    far = rest.join(brought, "file_path").where("iname = name or iname = '*'").join(constants.withColumnRenamed("mf", "cf"), (F.col("name") == F.col("mn")) & (F.col("mf") == F.col("cf")))
    row = lambda df, f: df.select("src", F.col("id").alias("dst"), "line", "mode", F.when(F.col(f) == F.col("file_path"), 1.0).otherwise(0.8).alias("confidence"))
    return row(owned, "mf").unionByName(row(same, "mf")).unionByName(row(far, "cf")).distinct()
