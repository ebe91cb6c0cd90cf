"""Source files, ignore rules, git history and repositories as DataFrames."""

from __future__ import annotations

import configparser
import re
import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values.
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript"}
IGNORED = [
    "node_modules", "__pycache__", ".git", ".venv", "venv", ".env", "dist", "build", ".idea", ".vscode", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "egg-info", ".eggs", "coverage", "htmlcov",
    ".DS_Store", ".coverage", "package-lock.json", "yarn.lock", "uv.lock", "poetry.lock",
]
IGNORED_GLOBS = ["*.egg-info", "*.pyc", "*.pyo", "*.so", "*.dylib", "*.min.js", "*.bundle.js", "*.map"]
MAX_BYTES = 5 << 20
SAFE_REF = r"[a-zA-Z0-9._/\-~^@{}]+"
SAFE_PATH = r"[a-zA-Z0-9._/\-\s]+"


def glob_regex(pattern: str) -> str:
    """A glob of one path part as a regular expression."""
    return "^" + "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in pattern) + "$"


def gitignore_patterns(text: str) -> list[tuple[str, bool]]:
    """``(regex over a relative path, negated)`` of each line; later ones win."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        p = line[negated:]
        folder, p = p.endswith("/"), p.rstrip("/")
        anchored, p = "/" in p, p.lstrip("/")
        body = re.escape(p).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        out.append(((r"^" if anchored else r"(?:^|.*/)") + body + (r"/.*$" if folder else r"(?:/.*)?$"), negated))
    return out


def ignored(path: Column, gitignore: str = "") -> Column:
    """Whether a path has an ignored part or fits the ignore file."""
    parts = F.split(path, "/")
    hit = F.exists(parts, lambda p: p.isin(IGNORED) | p.rlike("|".join(map(glob_regex, IGNORED_GLOBS))))
    for regex, negated in gitignore_patterns(gitignore):
        hit = F.when(path.rlike(regex), F.lit(not negated)).otherwise(hit)
    return hit


def language(path: Column) -> Column:
    """By extension, as it is written; null if unknown."""
    ext = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def read_sources(spark: SparkSession, root: str, gitignore: str = "", tracked: DataFrame | None = None) -> DataFrame:
    """``sources(path, content, language, ord)``: known languages, at most 5 MiB, valid UTF-8, not empty, by path.

    ``tracked`` (path) restricts to files of version control.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= MAX_BYTES).where("length > 0")
    relative = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    rows = raw.select(relative.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    kept = rows.withColumn("language", language(F.col("path"))).where("language is not null and content is not null").where(~ignored(F.col("path"), gitignore))
    if tracked is not None:
        kept = kept.join(tracked.select("path"), "path", "left_semi")
    return with_order(kept)


def with_order(sources: DataFrame) -> DataFrame:
    """``ord`` by path: ranks within ranges of paths, behind the counts of the ranges before (a row a range)."""
    parts = max(1, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = sources.repartitionByRange(parts, "path").withColumn("_p", F.spark_partition_id()).cache()
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_b"))
    ranked = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("path")))
    return ranked.join(F.broadcast(before), "_p").withColumn("ord", F.col("_b") + F.col("_r") - 1).drop("_p", "_b", "_r")


def git_tracked(spark: SparkSession, root: str, timeout: int = 10) -> DataFrame | None:
    """``(path)`` of tracked and untracked, not ignored files; None without git."""
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard"], capture_output=True, text=True, timeout=timeout, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return None
    return spark.createDataFrame([(x,) for x in out.splitlines()], "path string")


def safe_ref(ref: str) -> str:
    """``ref`` if it may name a revision: no other signs, and no leading hyphen, which git would take for an option."""
    if not re.fullmatch(SAFE_REF, ref) or ref.startswith("-"):
        raise ValueError(f"not a git ref: {ref!r}")
    return ref


def safe_path(path: str) -> str:
    if not re.fullmatch(SAFE_PATH, path):
        raise ValueError(f"not a plain path: {path!r}")
    return path


def ref_range(text: str) -> tuple[str, str | None]:
    """``base..current``; of a single ref the working tree is the current side (None)."""
    base, dots, current = text.partition("..")
    return safe_ref(base), safe_ref(current) if dots else None


def checked_out(root: str, ref: str, place: str, timeout: int = 60) -> str:
    """A revision's files below ``place``, a new folder that all executors see; paths are relative to it, so ids of two revisions compare."""
    subprocess.run(["git", "-C", root, "worktree", "add", "--detach", place, safe_ref(ref)], capture_output=True, timeout=timeout, check=True)
    return place


def drop_checkout(root: str, place: str, timeout: int = 60) -> None:
    subprocess.run(["git", "-C", root, "worktree", "remove", "--force", place], capture_output=True, timeout=timeout, check=True)


def git_log(spark: SparkSession, root: str, since: str = "6 months", timeout: int = 30) -> DataFrame:
    """``commits(commit_id, file_path)``; empty if git fails or is slow."""
    try:
        out = subprocess.run(["git", "-C", root, "log", "--name-only", "--pretty=format:COMMIT:%H", f"--since={since}"], capture_output=True, text=True, timeout=timeout, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        out = ""
    return parse_log(spark.createDataFrame(list(enumerate(out.splitlines())), "n long, line string"))


def parse_log(lines: DataFrame) -> DataFrame:
    """``commits`` of log lines (n, line); a history is one bounded text, so one ordered window finds each file's commit."""
    head = F.when(F.col("line").startswith("COMMIT:"), F.expr("substring(line, 8)"))
    marked = lines.withColumn("commit_id", F.last(head, ignorenulls=True).over(Window.orderBy("n")))
    return marked.where("line <> '' and not startswith(line, 'COMMIT:') and commit_id is not null").select("commit_id", F.col("line").alias("file_path"))


def test_config(root: str) -> dict[str, list[str]] | None:
    """The test runner's settings, of the first of four files that exists, even where it has no section (then None)."""
    places = [("pyproject.toml", None), ("pytest.ini", "pytest"), ("setup.cfg", "tool:pytest"), ("tox.ini", "pytest")]
    for name, section in places:
        path = Path(root, name)
        if not path.exists():
            continue
        try:
            if section is None:
                found = tomllib.loads(path.read_text()).get("tool", {}).get("pytest", {}).get("ini_options")
            else:
                parser = configparser.ConfigParser()
                parser.read_string(path.read_text())
                found = dict(parser[section]) if parser.has_section(section) else None
        except (OSError, ValueError, configparser.Error):
            return None
        if found is None:
            return None
        as_list = lambda v: v if isinstance(v, list) else str(v or "").split()
        return {k: as_list(found.get(k)) for k in ("testpaths", "norecursedirs", "collect_ignore")}
    return None


def qualified(slug: Column, raw: Column) -> Column:
    return F.concat_ws("::", slug, raw)


def slugs(repos: DataFrame) -> DataFrame:
    """``repos`` (path) with ``slug``: the folder's name, with eight digits of the path's hash where an earlier path has it."""
    name = F.element_at(F.split("path", "/"), -1)
    first = F.min("path").over(Window.partitionBy(name))
    return repos.withColumn("slug", F.when(F.col("path") == first, name).otherwise(F.concat(name, F.lit("-"), F.substring(F.sha2("path", 256), 1, 8))))


def owner_of(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """``paths`` (path) with ``slug`` of the repository whose root is its longest prefix; null if none. Ancestors are the join key."""
    parts = F.split("path", "/")
    ups = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("root"))
    best = ups.join(repos.select(F.col("path").alias("root"), "slug"), "root").groupBy("path").agg(F.max_by("slug", F.length("root")).alias("slug"))
    return paths.join(best, "path", "left")
