"""The engine's surface: an Index over a repository and a store, with a command line and JSON-RPC on top.

The shells only format; every answer is a DataFrame operation, and what reaches the driver is the answer itself."""

from __future__ import annotations

import argparse
import datetime
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .extract import build
from .functions.porter import query_stems_of, stemmed
from .operators import graph, reach, resolve, search, temporal
from .schema import COMMITS, NON_FILE_TYPES, SOURCE_TYPES
from .sources import embed, files, git, hook
from .sources.store import Store
from .sources.text_index import TextIndex

CONFIGS = ["package.json", "tsconfig.json", "jsconfig.json", "go.mod", "lerna.json", "nx.json", "turbo.json", "composer.json", "pnpm-workspace.yaml"]


class Index:
    def __init__(self, spark: SparkSession, repo: str = ".", store: str | None = None):
        self.spark, self.repo = spark, os.path.abspath(repo)
        self.store = Store(spark, store or f"file://{self.repo}/.graphloom")
        self.words = TextIndex(spark, f"{self.store.folder}/words", split=stemmed)

    # Building

    def graph(self, known: DataFrame | None = None) -> dict[str, DataFrame]:
        ignore = []
        if os.path.exists(path := f"{self.repo}/.gitignore"):
            with open(path, errors="replace") as f:
                ignore = f.read().splitlines()
        found = files.config_files(self.spark, f"file://{self.repo}", CONFIGS)
        spaces = files.workspaces(self.repo, found)
        packages = self.spark.createDataFrame(spaces, "dir string, name string") if spaces else None
        return build.analyze(files.read_tree(self.spark, f"file://{self.repo}", ignore), packages, files.go_module(found), files.aliases(found), files.psr4(found), known)

    def analyze(self, commit: str | None = None) -> dict:
        """Scans, scores and stores the repository as of its head commit. Only files whose content is new are parsed
        (scanned says how many); the graph is linked and scored anew."""
        g = {k: build.stored(v) for k, v in self.graph(self.store.read("facts")).items()}
        edges = g["links"].select(F.col("source").alias("src"), F.col("target").alias("dst"), "kind", "weight")
        scored = reach.blast_counts(build.stored(graph.valid_edges(edges, g["nodes"]))).withColumnRenamed("origin", "id")
        lists = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").cast("int").alias("n"))
        nodes = build.groups(g["nodes"]).join(scored, "id", "left").join(lists, "id", "left")
        package = F.col("package") if "package" in nodes.columns else F.lit(None).cast("string")
        rows = nodes.select(
            F.col("id").alias("path"), F.col("type").alias("node_type"), "language", "layer", "size", "loc", F.col("group").alias("node_group"), F.coalesce("n", F.lit(0)).alias("imports_count"), package.alias("package"), "content_hash",
            F.coalesce("blast_score", F.lit(0.0)).alias("blast_score"), F.coalesce("direct", F.lit(0)).alias("direct_dependents"), F.coalesce("transitive", F.lit(0)).alias("transitive_dependents"),
        )
        stored_edges = edges.select(F.xxhash64("src").alias("source_file_id"), F.xxhash64("dst").alias("target_file_id"), "kind", F.col("weight").cast("double").alias("weight"))
        syms = g["symbols"].join(g["nodes"].select(F.col("id").alias("path")), "path", "left_semi").groupBy("path", "name").agg(F.max_by(F.struct("kind", "line", "exported", "doc", "methods"), "line").alias("s"))
        syms = syms.select(F.xxhash64("path").alias("file_id"), "name", "s.kind", "s.line", "s.exported", F.lit(None).cast("string").alias("signature"), "s.doc", "s.methods")
        self.store.sync({"files": rows, "edges": stored_edges, "symbols": syms}, commit or git.resolve(self.repo) or "working-tree")
        self.index_words()
        self.embed()
        self.store.write({"facts": g["facts"]})
        self.store.vacuum(keep=2)
        return self.status() | {"scanned": g["facts"].count()}

    def index_words(self) -> None:
        """Brings the stored keyword index to the active symbols; only new and changed ones are tokenised."""
        self.words.sync(self.symbols().select("id", F.concat_ws(" ", "name", "doc", "signature").alias("text")))
        self.words.vacuum()

    def embed(self) -> None:
        """Vectors for active symbols that have none; the provider is the endpoint named in the environment, else hashing."""
        text = F.concat_ws(" ", F.when(F.col("name") != "", F.col("name")), F.when(F.col("signature") != "", F.col("signature")), F.when(F.col("doc") != "", F.col("doc")))
        have = self.store.read("vectors")
        missing = self.store.read("symbols").where("active").join(have, F.col("id") == F.col("symbol_id"), "left_anti").select(F.col("id").alias("symbol_id"), text.alias("text"))
        self.store.write({"vectors": embed.embedded(missing, provider())})

    # Reading

    def edges(self, active: bool = True) -> DataFrame:
        f = self.store.read("files").select("id", "path")
        e = self.store.read("edges")
        e = e.where("active") if active else e
        a, b = f.select(F.col("id").alias("source_file_id"), F.col("path").alias("src")), f.select(F.col("id").alias("target_file_id"), F.col("path").alias("dst"))
        return e.join(a, "source_file_id").join(b, "target_file_id")

    def find(self, arg: str) -> str | None:
        row = resolve.fuzzy_path(self.store.read("files").select("path"), arg).first()
        return row["path"] if row else None

    def impact(self, file: str, as_of: str | None = None) -> dict | None:
        """Dependents of a file with their distance and path, now or as of a commit."""
        path = self.find(file)
        if path is None:
            return None
        rows = self.store.read("files")
        if as_of:
            known = git.reachable(self.spark, self.repo, as_of)
            alive = temporal.visible(rows, known).select("path")
            links = graph.valid_edges(temporal.visible(self.edges(False), known), alive, "path")
            if alive.where(F.col("path") == path).isEmpty():
                return None
            total = rows.count()
        else:
            links, total = graph.valid_edges(self.edges(), rows.where("active"), "path"), rows.where("active and node_type <> 'import'").count()
        start = self.spark.createDataFrame([(path,)], "origin string")
        near = build.stored(graph.reach(links.select("src", "dst"), start, None).select("node", "hop"))
        paths = {path: [path]}
        found = near.where("hop > 0").join(graph.next_steps(links, near), "node").orderBy("hop", "node").collect()
        for r in found:
            paths[r["node"]] = [r["node"], *paths[r["next"]]]
        return {"file": path, "total": total, "dependents": [{"node": r["node"], "hop": r["hop"], "path": paths[r["node"]]} for r in found]}

    def dependencies(self, file: str) -> dict | None:
        path = self.find(file)
        if path is None:
            return None
        edges = self.edges()
        imports, imported_by = ([r["x"] for r in edges.where(F.col(a) == path).select(F.col(b).alias("x")).orderBy("x").collect()] for a, b in (("src", "dst"), ("dst", "src")))
        score = self.store.read("files").where(F.col("path") == path).select("blast_score").first()
        return {"file": path, "imports": imports, "imported_by": imported_by, "blast_score": score["blast_score"]}

    def high_blast(self, threshold: float = 5.0) -> list[dict]:
        rows = graph.high_blast(self.store.read("files").where("active"), threshold, NON_FILE_TYPES)
        return [r.asDict() for r in rows.orderBy(F.desc("blast_score"), "path").select("path", "node_type", "blast_score", "direct_dependents", "transitive_dependents").collect()]

    def symbols(self) -> DataFrame:
        f = self.store.read("files").select(F.col("id").alias("file_id"), "path", "blast_score")
        return self.store.read("symbols").where("active").join(f, "file_id")

    def lookup(self, name: str) -> list[dict]:
        """Active symbols of a name, or the one of a numeric id, with the first lines of their definitions."""
        wanted = (F.col("name") == name) | (F.col("id").cast("string") == name)
        rows = self.symbols().where(wanted).select("id", "name", "kind", "line", "exported", "doc", "methods", "path", "blast_score").orderBy("path", "line")
        return [r.asDict() | {"snippet": self._lines(r["path"], r["line"] or 1)} for r in rows.collect()]

    def _lines(self, path: str, line: int) -> list[str]:
        if not os.path.isfile(at := f"{self.repo}/{path}"):
            return []
        with open(at, errors="replace") as f:
            return report.snippet(f.read(), line)

    def symbol_blast(self, file: str) -> list[dict]:
        """Exported symbols of a file with the importers whose text holds them as a word."""
        names = self.symbols().where((F.col("path") == file) & F.coalesce("exported", F.lit(True))).select("name", "kind", "line")
        users = graph.importers(self.store.read("edges").where("active").select(F.col("source_file_id").alias("src"), F.col("target_file_id").alias("dst")), self.store.read("files").select("id", "path")).where(F.col("path") == file)
        texts = files.read_tree(self.spark, f"file://{self.repo}").join(users.select(F.col("importer").alias("path")).distinct(), "path").select(F.col("path").alias("id"), F.col("content").alias("text"))
        used = resolve.word_usage(names, texts).groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("used_by"))
        rows = names.join(used, "name", "left").orderBy("line").collect()
        return [r.asDict() | {"used_by": r["used_by"] or [], "count": len(r["used_by"] or [])} for r in rows]

    def status(self) -> dict:
        meta = {r["key"]: r["value"] for r in self.store.read("meta").collect()}
        return self.store.status().first().asDict() | meta

    def history(self, since: str | None = None, most: int = 1000) -> dict:
        """Back-dates files and edges from the commits; each distinct blob is parsed once."""
        commits = git.log(self.spark, self.repo, since, most)
        trees = build.stored(git.snapshots(commits, self.repo))
        names = commits.select("seq", "hash")
        first_files = trees.groupBy("path").agg(F.min("seq").alias("seq")).join(names, "seq").select("path", F.col("hash").alias("first"))
        skeleton = {"active": F.lit(False), "node_type": F.lit("module"), "id": F.xxhash64("path")}
        f = temporal.backfilled(self.store.read("files"), first_files, ["path"], skeleton)
        source = trees.where(F.col("path").rlike(r"\.(py|js|jsx|ts|tsx|mjs|cjs|vue)$"))
        text = git.blobs(source, self.repo)
        refs = build.stored(build.references(source.select("path", "blob").distinct().join(text, "blob")))
        born = temporal.first_links(trees, refs).join(names.withColumnRenamed("seq", "first"), "first")
        first_edges = born.select(F.xxhash64("source").alias("source_file_id"), F.xxhash64("target").alias("target_file_id"), F.col("hash").alias("first"))
        e = temporal.backfilled(self.store.read("edges"), first_edges, ["source_file_id", "target_file_id"], {"active": F.lit(False), "kind": F.lit("imports"), "weight": F.lit(1.0), "id": F.xxhash64("source_file_id", "target_file_id", F.lit("imports"))})
        self.store.write({"files": f, "edges": e, "commits": commits.select(*COMMITS.names).dropDuplicates(["hash"])})
        return {"commits": commits.count(), "files": first_files.count()}

    def changed_since(self, ref: str) -> dict:
        known = git.reachable(self.spark, self.repo, ref)
        rows = self.store.read("files")
        own = rows.where(F.coalesce("node_type", F.lit("module")).isin(*SOURCE_TYPES))
        fs = temporal.changed_since(own, known).select("path", "change").orderBy("path").collect()
        es = build.stored(temporal.changed_since(self.edges(False), known).select("src", "dst", "kind", "change"))
        by = {c: [r["path"] for r in fs if r["change"] == c] for c in ("added", "removed")}
        changed = [p for p in git.changed(self.repo, ref) if p not in by["added"] and p not in by["removed"]]
        paths = self.spark.createDataFrame([(p,) for p in {*by["added"], *by["removed"], *changed}], "path string")
        marked = temporal.touched(es, paths)
        shown = marked.where("touched").orderBy("src", "dst").collect()
        return {
            "added_files": by["added"], "removed_files": by["removed"], "modified_files": changed,
            **{f"{c}_edges": [(r["src"], r["dst"], r["kind"]) for r in shown if r["change"] == c] for c in ("added", "removed")},
            "suppressed_edges": marked.where("not touched").count(), "warning": temporal.backfill_suspect(rows).first()["warning"],
        }

    def search(self, query: str, k: int = 10, as_of: str | None = None) -> list[dict]:
        syms = self.symbols()
        vectors = self.store.read("vectors").select(F.col("symbol_id").alias("id"), F.col("embedding").alias("v"))
        q = self.spark.createDataFrame([(provider()([query])[0],)], "q array<float>")
        owners = syms.select("id", F.col("path").alias("owner"))
        links = self.edges().select("src", "dst")
        seen = temporal.symbol_visible(self.store.read("symbols"), git.reachable(self.spark, self.repo, as_of)).select("id") if as_of else None
        if not self.words.manifest()["segments"]:  # a store that was written without an index
            self.index_words()
        found = lambda text, n: self.words.fts(text, n, query_stems_of(syms, search.query_words(text)))
        hits = search.hybrid(None, vectors, q, syms.select("id", "path", "exported", "name", "kind", "line", "doc", "blast_score"), query, k, lambda seeds, n: graph.expand(links, owners, seeds, n), seen, keyword=found)
        return [r.asDict() for r in hits.orderBy(F.desc("score"), "id").collect()]

    def neighborhood(self, file: str, direction: str = "both", depth: int = 2) -> dict:
        path = self.find(file)
        if path is None:
            return {"error": f"no file matches {file}"}
        rows = graph.reach(self.edges().select("src", "dst"), self.spark.createDataFrame([(path,)], "origin string"), depth, direction)
        return {"center": path, "direction": direction, "depth": depth, "nodes": [{"file": r["node"], "hop": r["hop"]} for r in rows.where("hop > 0").orderBy("hop", "node").collect()]}

    def export(self) -> dict:
        """The whole graph as one document, for viewers."""
        f = self.store.read("files").where("active").orderBy("path").collect()
        links = self.edges().select("src", "dst", "weight", "kind").orderBy("src", "dst", "kind").collect()
        keep = ["path", "node_type", "language", "layer", "size", "loc", "node_group", "package", "blast_score", "direct_dependents", "transitive_dependents"]
        return {"nodes": [{("id" if k == "path" else k): r[k] for k in keep} for r in f], "links": [{"source": r["src"], "target": r["dst"], "weight": r["weight"], "kind": r["kind"]} for r in links]}

    def gate(self, staged: list[str], threshold: int = 10) -> list[dict]:
        """Staged files whose floored score reaches the threshold."""
        named = self.spark.createDataFrame([(p,) for p in staged], "path string").distinct()
        rows = graph.high_blast(self.store.read("files").where("active"), 0.0, NON_FILE_TYPES).join(named, "path", "left_semi")
        rows = rows.where(F.floor("blast_score") >= threshold).orderBy(F.desc("blast_score"), "path")
        return [r.asDict() for r in rows.select("path", "node_type", "blast_score", "direct_dependents", "transitive_dependents").collect()]


def located(start: str) -> str:
    """The nearest folder at or above start that holds a store; start itself if none does."""
    at = os.path.abspath(start)
    while not os.path.isdir(f"{at}/.graphloom"):
        if (above := os.path.dirname(at)) == at:
            return start
        at = above
    return at


def saved(path: str, body: str) -> str:
    with open(path, "w") as f:
        f.write(body)
    return path


def provider() -> Callable[[list[str]], list[list[float]]]:
    endpoint = os.environ.get("GRAPHLOOM_EMBEDDING_ENDPOINT")
    return embed.http(endpoint, os.environ.get("GRAPHLOOM_EMBEDDING_MODEL", "default")) if endpoint else embed.hashed


def _analyze(ix: Index, a: argparse.Namespace) -> object:
    out = ix.analyze()
    if a.output:
        saved(a.output, json.dumps(ix.export(), indent=2, default=str))
    return out


def _report(ix: Index, a: argparse.Namespace) -> object:
    got = ix.impact(a.file, a.as_of)
    if got is not None and a.out:
        saved(a.out, report.impact(got["file"], got["dependents"], got["total"], markdown=True) + "\n")
    return None if got is None else got if a.json else report.impact(got["file"], got["dependents"], got["total"])


def _symbols(ix: Index, a: argparse.Namespace) -> object:
    """The section of all symbols; it is spliced into CLAUDE.md, and the symbols into files, where asked for."""
    rows = [r.asDict() for r in ix.symbols().collect()]
    section = report.section(rows, a.all_symbols)
    document = report.symbol_document(rows, os.path.basename(ix.repo), str(datetime.date.today()))
    if a.output:
        saved(a.output, json.dumps(document, indent=2, default=str))
    if a.inline:
        with open(a.inline) as f:
            graph_document = json.load(f)
        saved(a.inline, json.dumps(report.with_symbols(graph_document, document["file_symbols"]), indent=2, default=str))
    if a.claude_md:
        at, old = f"{ix.repo}/CLAUDE.md", ""
        if os.path.exists(at):
            with open(at) as f:
                old = f.read()
        saved(at, report.spliced(old, section))
    return section


def _hook(ix: Index, a: argparse.Namespace) -> object:
    return hook.remove(ix.repo) if a.remove else hook.install(ix.repo, a.threshold, a.strict)


COMMANDS: dict[str, tuple[list[tuple[str, dict]], Callable[[Index, argparse.Namespace], object]]] = {
    "analyze": ([("--output", {})], _analyze),
    "impact": ([("file", {}), ("--as-of", {}), ("--out", {})], _report),
    "symbols": ([("--all-symbols", {"action": "store_true"}), ("--output", {}), ("--inline", {}), ("--claude-md", {"action": "store_true"})], _symbols),
    "lookup": ([("name", {})], lambda ix, a: ix.lookup(a.name) or None),
    "dependencies": ([("file", {})], lambda ix, a: ix.dependencies(a.file)),
    "high-blast": ([("--threshold", {"type": float, "default": 5.0})], lambda ix, a: ix.high_blast(a.threshold)),
    "symbol-blast": ([("file", {})], lambda ix, a: ix.symbol_blast(a.file)),
    "status": ([], lambda ix, a: ix.status()),
    "history": ([("--since", {}), ("--max-commits", {"type": int, "default": 1000})], lambda ix, a: ix.history(a.since, a.max_commits)),
    "changed-since": ([("ref", {})], lambda ix, a: ix.changed_since(a.ref)),
    "search": ([("query", {}), ("--k", {"type": int, "default": 10}), ("--as-of", {})], lambda ix, a: ix.search(a.query, a.k, a.as_of)),
    "graph": ([("file", {}), ("--direction", {"default": "both"}), ("--depth", {"type": int, "default": 2})], lambda ix, a: ix.neighborhood(a.file, a.direction, a.depth)),
    "export": ([], lambda ix, a: ix.export()),
    "gate": ([("staged", {"nargs": "*"}), ("--threshold", {"type": int, "default": 10}), ("--strict", {"action": "store_true"})], lambda ix, a: ix.gate(a.staged or git.staged(ix.repo), a.threshold)),
    "install-hook": ([("--threshold", {"type": int, "default": 10}), ("--strict", {"action": "store_true"}), ("--remove", {"action": "store_true"})], _hook),
}
TOOLS = {"analyze_repo": "analyze", "get_impact": "impact", "get_dependencies": "dependencies", "get_high_blast_files": "high-blast", "lookup_symbol": "lookup", "build_symbol_index": "symbols", "semantic_search": "search", "temporal_impact": "impact", "graph_query": "graph", "changed_since": "changed-since"}


#: Arguments that name files to write: for the command line only, not for callers over JSON-RPC.
WRITES = {"output", "out", "inline", "claude_md"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    subs = p.add_subparsers(dest="command", required=True)
    for name, (args, _) in COMMANDS.items():
        s = subs.add_parser(name)
        for flag, spec in args:
            s.add_argument(flag, **spec)
        s.add_argument("--repo", default=".")
        s.add_argument("--store")
        s.add_argument("--json", action="store_true")
    subs.add_parser("serve").add_argument("--repo", default=".")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    if a.command == "serve":
        return serve(Index(spark, a.repo))
    repo = a.repo if a.store or a.command in ("analyze", "install-hook") else located(a.repo)
    out = COMMANDS[a.command][1](Index(spark, repo, a.store), a)
    if out is None:
        print("nothing found", file=sys.stderr)
        return 1
    print(out if isinstance(out, str) else json.dumps(out, indent=2, default=str))
    return hook.BLOCKED if a.command == "gate" and a.strict and out else 0


def handle(ix: Index, message: dict) -> dict | None:
    """One JSON-RPC message; None for notifications."""
    method, params, key = message.get("method"), message.get("params") or {}, message.get("id")
    reply = {"jsonrpc": "2.0", "id": key}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "0.1.0"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        known = {t: [f.lstrip("-").replace("-", "_") for f, _ in COMMANDS[c][0]] for t, c in TOOLS.items()}
        return reply | {"result": {"tools": [{"name": t, "inputSchema": {"type": "object", "properties": {f: {} for f in own if f not in WRITES}}} for t, own in known.items()]}}
    if method == "tools/call" and params.get("name") in TOOLS:
        args, run = COMMANDS[TOOLS[params["name"]]]
        given = {f.lstrip("-").replace("-", "_"): s.get("default", False if s.get("action") else None) for f, s in args} | {"json": True} | {k: v for k, v in (params.get("arguments") or {}).items() if k not in WRITES}
        try:
            body = run(ix, argparse.Namespace(**given))
        except (AttributeError, RuntimeError, ValueError) as e:
            return reply | {"result": {"content": [{"type": "text", "text": str(e)}], "isError": True}}
        return reply | {"result": {"content": [{"type": "text", "text": body if isinstance(body, str) else json.dumps(body, default=str)}], "isError": body is None}}
    if key is None:
        return None
    return reply | {"error": {"code": -32601, "message": f"unknown method {method}"}}


def serve(ix: Index, lines=None, out=None) -> int:
    """A JSON-RPC loop over lines of text."""
    out = out or sys.stdout
    for line in lines if lines is not None else sys.stdin:
        if not line.strip():
            continue
        try:
            answer = handle(ix, json.loads(line))
        except json.JSONDecodeError:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
        if answer is not None:
            print(json.dumps(answer), file=out, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
