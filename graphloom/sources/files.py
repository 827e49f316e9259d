"""Source files of a tree, and what its configuration says."""

from __future__ import annotations

import glob
import json
import os
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.rules import COMPOSE, GENERATED, LANGUAGES, SKIP_DIRS
from ..extract.scan import yaml_map
from ..functions.text import gitignore_regex

#: Dependency names that tell a front-end framework, in order.
FRAMEWORKS = [("next", "next"), ("nuxt", "nuxt"), ("@sveltejs/kit", "sveltekit"), ("svelte", "svelte"), ("@angular/core", "angular"), ("gatsby", "gatsby"), ("remix", "remix"), ("astro", "astro"), ("react", "react"), ("vue", "vue")]
#: Folders of workspace tools that name none.
USUAL = {"nx.json": ["apps/*", "libs/*", "packages/*"], "turbo.json": ["apps/*", "packages/*"]}
DETECTED = {"python": "py", "javascript": "js|jsx|ts|tsx|mjs|cjs|vue", "css": "css|scss|sass|less", "go": "go", "ruby": "rb", "rust": "rs", "java": "java|kt|kts", "php": "php", "terraform": "tf"}


def read_tree(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, content) of files under root that the extractors know: relative paths, no skipped or ignored ones.

    Path globs prune the listing before contents are read; line ends are normalised."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-zA-Z0-9+.-]+:(//[^/]*)?(?=/)", ""), "^" + _quoted(base) + "/", "")
    files = raw.select(rel.alias("path"), "content")
    parts = F.split(F.col("path"), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    ci = F.col("path").rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$|(^|/)\.gitlab-ci\.ya?ml$")
    hidden = F.exists(folders, lambda p: p.startswith(".") | p.isin(*SKIP_DIRS))
    made = F.col("path").rlike(r"\.(java|kt|kts)$") & F.exists(folders, lambda p: p.isin(*GENERATED))
    base_name = F.element_at(parts, -1)
    known = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*LANGUAGES) | base_name.isin(*COMPOSE) | F.lower(base_name).rlike(r"^dockerfile(\..*)?$|\.dockerfile$")
    keep = ci | (known & ~hidden & ~made)
    for pattern in ignore or []:
        line = pattern.strip()
        if line and not line.startswith("#"):
            keep = keep & (ci | ~F.col("path").rlike(gitignore_regex(line)))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    return files.where(keep).select("path", text.alias("content"))


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in text)


def config_files(spark: SparkSession, root: str, names: list[str]) -> dict[str, str]:
    """Contents of a few named configuration files; their number is that of packages, not of files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(names) + "}").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    found = {}
    for r in raw.select("path", F.decode("content", "UTF-8").alias("text")).collect():
        p = r["path"].split(base, 1)[-1]
        if "node_modules/" not in p:
            found[p] = r["text"]
    return found


def _json(text: str) -> dict:
    try:
        data = json.loads(text)
    except ValueError:
        return {}
    return data if isinstance(data, dict) else {}


def aliases(found: dict[str, str]) -> list[tuple[str, str]]:
    """(alias, target) of path aliases in script configurations."""
    out = []
    for p, text in sorted(found.items()):
        if posixpath.basename(p) in ("tsconfig.json", "jsconfig.json"):
            for alias, targets in (_json(text).get("compilerOptions", {}).get("paths") or {}).items():
                out += [(alias, t) for t in targets if isinstance(t, str)]
    return out


def psr4(found: dict[str, str]) -> list[tuple[str, str]]:
    """(namespace with / at its inner joints, folder) of the root composer.json, in order; the empty namespace is last."""
    out = []
    data = _json(found.get("composer.json", ""))
    for section in ("autoload", "autoload-dev"):
        part = data.get(section)
        spaces = part.get("psr-4") if isinstance(part, dict) else None
        for space, folders in (spaces if isinstance(spaces, dict) else {}).items():
            for f in folders if isinstance(folders, list) else [folders]:
                if isinstance(f, str):
                    f = posixpath.normpath(f or ".")
                    out.append((space.strip("\\").replace("\\", "/"), "" if f == "." else f))
    return sorted(out, key=lambda x: x[0] == "")


def framework(found: dict[str, str]) -> str | None:
    """The front-end framework that the root package.json depends on."""
    deps: set[str] = set()
    data = _json(found.get("package.json", ""))
    for section in ("dependencies", "devDependencies", "peerDependencies"):
        deps |= set(data.get(section) or {})
    return next((name for dep, name in FRAMEWORKS if dep in deps), None)


def workspace_patterns(found: dict[str, str]) -> list[str]:
    """Folders and `folder/*` patterns that the root's configuration names, of every tool that is there."""
    pnpm = yaml_map(found.get("pnpm-workspace.yaml", "")).get("packages")
    npm = _json(found.get("package.json", "")).get("workspaces")
    lerna = _json(found["lerna.json"]).get("packages", ["packages/*"]) if "lerna.json" in found else None
    lists = [pnpm, npm.get("packages") if isinstance(npm, dict) else npm, lerna]
    return [p for own in lists if isinstance(own, list) for p in own if isinstance(p, str) and p]


def workspaces(root: str, found: dict[str, str]) -> list[tuple[str, str]]:
    """(dir, name) of the packages of a monorepo under a local root; the name is that of its package.json, else of the
    folder. Tools that name no folders, and are the only ones, take their usual ones. Only a last part `*` is a pattern."""

    def folders(patterns: list[str]) -> set[str]:
        escaped = [glob.escape(p[:-2]) + "/*" if p.endswith("/*") else glob.escape(p) for p in patterns]
        got = {posixpath.normpath(d) for p in escaped for d in glob.glob(p, root_dir=root, include_hidden=True) if os.path.isdir(f"{root}/{d}")}
        return {d for d in got if d != "." and not d.startswith(("..", "/"))}

    dirs = folders(workspace_patterns(found))
    for tool, usual in USUAL.items():
        dirs = dirs or (folders(usual) if tool in found else dirs)
    return [(d, _json(found.get(f"{d}/package.json", "")).get("name") or posixpath.basename(d)) for d in sorted(dirs)]


def go_module(found: dict[str, str]) -> str | None:
    for p, text in sorted(found.items(), key=lambda x: x[0].count("/")):
        if posixpath.basename(p) == "go.mod":
            words = [line.split() for line in text.splitlines() if line.startswith("module ")]
            if words and len(words[0]) > 1:
                return words[0][1]
    return None


def detect_languages(sources: DataFrame) -> DataFrame:
    """One row of a flag for each language family."""
    flags = [F.coalesce(F.bool_or(F.lower("path").rlike(rf"\.({e})$")), F.lit(False)).alias(k) for k, e in DETECTED.items()]
    docker = F.coalesce(F.bool_or(F.lower("path").rlike(r"(^|/)(dockerfile|(docker-)?compose[^/]*\.ya?ml)$")), F.lit(False)).alias("docker")
    ci = F.coalesce(F.bool_or(F.col("path").rlike(r"\.github/workflows/|\.gitlab-ci\.ya?ml$")), F.lit(False)).alias("ci")
    schema = F.coalesce(F.bool_or(F.lower("path").rlike(r"\.(sql|prisma)$")), F.lit(False)).alias("schema")
    return sources.agg(*flags, docker, ci, schema)
