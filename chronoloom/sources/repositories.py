"""Git repositories as tables, read through git itself on the driver's machine (a Python data source)."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COMMITS = "sha string, parents array<string>, at string, author string, subject string, body string, place int"
CHANGES = "sha string, status string, path string, old_path string"
FILES = "path string, size long, content string"
#: Ours: beginnings of subjects that say nothing about the code.
DULL = r"^(chore|style|ci|build|docs|bump|release|version)\b"


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, timeout=120).stdout.decode("utf-8", "replace")


class GitSource(DataSource):
    """Options: path, table (commits, changes, files), ref, base, since, max_count."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return {"commits": COMMITS, "changes": CHANGES, "files": FILES}[self.options.get("table", "commits")]

    def reader(self, schema) -> DataSourceReader:
        return GitReader(dict(self.options))


class GitReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.o = {"ref": "HEAD", "max_count": "200", "table": "commits", **{k.lower(): v for k, v in options.items()}}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def _shas(self) -> list[str]:
        o = self.o
        span = f"{o['base']}..{o['ref']}" if o.get("base") else o["ref"]
        since = [f"--since={o['since']}"] if o.get("since") else []
        return git(o["path"], "rev-list", f"--max-count={o['max_count']}", *since, span).split()[::-1]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.o
        if o["table"] == "files":
            for line in git(o["path"], "ls-tree", "-r", "-l", "-z", o["ref"]).split("\0"):
                if line:
                    meta, path = line.split("\t", 1)
                    yield path, int(meta.split()[3]) if meta.split()[3] != "-" else 0, git(o["path"], "show", f"{o['ref']}:{path}")
            return
        for place, sha in enumerate(self._shas()):
            if o["table"] == "commits":
                f = git(o["path"], "show", "-s", "--format=%H%x1f%P%x1f%cI%x1f%an%x1f%s%x1f%b", sha).rstrip("\n").split("\x1f")
                yield f[0], f[1].split(), f[2], f[3], f[4], f[5].strip(), place
            else:
                parts = [p for p in git(o["path"], "show", "--format=", "--name-status", "-z", sha).split("\0") if p]
                i = 0
                while i < len(parts):
                    s, moved = parts[i].strip(), parts[i].strip()[:1] in "RC"
                    yield sha, s[:1], parts[i + 2] if moved else parts[i + 1], parts[i + 1] if moved else None
                    i += 3 if moved else 2


def load(spark: SparkSession, path: str, table: str, **options: str) -> DataFrame:
    spark.dataSource.register(GitSource)
    reader = spark.read.format("git").option("path", path).option("table", table)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def diff(repo: str, sha: str, paths: list[str], cap: int) -> str:
    """A commit's changes that aren't blanks only, the first ``cap`` characters."""
    return git(repo, "show", "--format=", "-w", sha, "--", *paths)[:cap]


def is_ancestor(repo: str, base: str, ref: str) -> bool:
    return subprocess.run(["git", "-C", repo, "merge-base", "--is-ancestor", base, ref], capture_output=True, timeout=120).returncode == 0


def salient(commits: DataFrame, changes: DataFrame, source: Column) -> DataFrame:
    """Commits with one parent at most, a subject that says something and a change to a source file."""
    code = changes.where(source).select("sha").distinct()
    return commits.where((F.size("parents") <= 1) & ~F.lower("subject").rlike(DULL)).join(code, "sha", "left_semi")


def changed_paths(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths changed and paths deleted; a renamed file is both, under its new and old name."""
    gone = changes.where("status = 'D'").select("path").unionByName(changes.where("status = 'R'").select(F.col("old_path").alias("path")))
    return changes.where("status <> 'D'").select("path").distinct(), gone.distinct()


def tree_sketch(files: DataFrame, names: int = 6, most: int = 60) -> DataFrame:
    """Folders with how many files they hold and their first names."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    rows = files.groupBy(folder.alias("folder")).agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list(F.element_at(F.split("path", "/"), -1))), 1, names), ", ").alias("first"))
    return rows.orderBy("folder").limit(most)


def libraries(manifests: dict[str, str], most: int = 40) -> list[str]:
    """Dependencies named in manifests (path to text), each once whatever its case, in order."""
    import json

    found: list[str] = []
    for path, text in sorted(manifests.items()):
        name = path.rsplit("/", 1)[-1]
        if name in ("package.json", "composer.json"):
            try:
                data = json.loads(text)
            except ValueError:
                continue
            found += [k for part in ("dependencies", "devDependencies", "require") for k in data.get(part) or {}]
        elif name.startswith("requirements"):
            found += [m.group(1) for x in text.splitlines() if (m := re.match(r"([A-Za-z0-9][A-Za-z0-9._-]*)", x.strip()))]
        elif name == "go.mod":
            found += re.findall(r"^\s*(?:require\s+)?([\w.-]+(?:/[\w.-]+)+)\s+v", text, re.M)
        elif name == "Gemfile":
            found += re.findall(r"^\s*gem\s+[\"']([^\"']+)", text, re.M)
        elif name == "Cargo.toml":
            block = re.search(r"^\[dependencies\]\n(.*?)(?=^\[|\Z)", text, re.M | re.S)
            found += re.findall(r"^([\w-]+)\s*=", block.group(1), re.M) if block else []
        elif name == "pyproject.toml":
            block = re.search(r"^dependencies\s*=\s*\[(.*?)\]", text, re.M | re.S)
            found += re.findall(r"[\"']([A-Za-z0-9][A-Za-z0-9._-]*)", block.group(1)) if block else []
    once: dict[str, str] = {}
    for f in found:
        once.setdefault(f.lower(), f)
    return list(once.values())[:most]


def superseded(live: DataFrame, new: DataFrame) -> DataFrame:
    """Live file episodes (ref, path, id) of a new file state (ref, path, id) with whether they stay valid, and what replaces them."""
    paths = new.groupBy("ref", "path").agg(F.min("id").alias("by"))
    kept = live.join(new.select("id").withColumn("_same", F.lit(True)), "id", "left").join(paths, ["ref", "path"], "left")
    stays = F.col("_same").isNotNull() | F.col("by").isNull()
    return kept.select("id", stays.alias("valid"), F.when(~stays, F.col("by")).alias("superseded_by"))


def vanished(live: DataFrame, tree: DataFrame, prefix: str) -> DataFrame:
    """Live file episodes under a prefix whose path the tree no longer has."""
    return live.where(F.col("path").startswith(prefix)).join(tree.select("path"), "path", "left_anti").select("id")
