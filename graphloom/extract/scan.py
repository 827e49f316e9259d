"""One source file to rows: its nodes, references, symbols, routes and calls. Pure Python; Spark maps it over files.

A row is (path, what, name, line, kind, exported, doc, methods, candidates, external, wanted):
  node    name: its id; kind: type; external: language; line: lines of code; doc: key (a JVM name)
  ref     name: source node; candidates: paths to try in order; wanted: path suffix or JVM name to try next;
          external: name of an outside package if nothing fits; kind: of link
  symbol  name, line, kind, exported, doc, methods
  define / refer  names that are matched within a scope (wanted): Terraform, compose, CI, SQL
  route / call    name: URL; wanted: of a route, its router's prefix
  error   name: what kept the file from being read; doc: its message
"""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Iterator

from . import rules as R

FIELDS = ["path", "what", "name", "line", "kind", "exported", "doc", "methods", "candidates", "external", "wanted"]


def row(path: str, what: str, name: str, **more) -> dict:
    return dict.fromkeys(FIELDS) | {"path": path, "what": what, "name": name} | more


def language(path: str) -> str | None:
    base = posixpath.basename(path)
    low = base.lower()
    if base in R.COMPOSE:
        return "compose"
    if low == "dockerfile" or low.startswith("dockerfile.") or low.endswith(".dockerfile"):
        return "docker"
    if re.search(r"(^|/)\.github/workflows/[^/]+\.ya?ml$", path):
        return "github-actions"
    if base in (".gitlab-ci.yml", ".gitlab-ci.yaml"):
        return "gitlab-ci"
    return R.LANGUAGES.get(posixpath.splitext(low)[1])


def node_type(path: str, text: str, lang: str) -> str:
    family = R.SAME.get(lang, lang)
    stem, suffix = posixpath.splitext(posixpath.basename(path))
    low, parts = stem.lower(), path.lower().split("/")
    if family == "terraform":
        parts = parts[:-1]
    if family == "javascript" and stem.startswith("use") and stem[3:4].isupper() and not any(_fits(h, n, low, suffix, parts, text) for t, h, n in R.TYPES[family] if t in ("config", "route", "store")):
        return "hook"
    for kind, how, names in R.TYPES.get(family, []):
        if _fits(how, names, low, suffix.lower(), parts, text):
            return kind
    return "module"


def _fits(how: str, names: list[str], stem: str, suffix: str, parts: list[str], text: str) -> bool:
    tests = {
        "stem": lambda: stem in names, "part": lambda: any(p in names for p in parts), "stem_has": lambda: any(n in stem for n in names), "stem_end": lambda: stem.endswith(tuple(names)),
        "stem_tail": lambda: any(stem.endswith("." + n) for n in names), "suffix": lambda: suffix in names, "text": lambda: any(re.search(p, text) for p in names), "any": lambda: True, "app": lambda: "app" in parts and suffix in (".jsx", ".tsx") and stem in names,
    }
    return tests[how]()


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _all(pattern: str, text: str) -> list[str]:
    return [m[1] for m in re.finditer(pattern, text)]


def _beside(path: str, spec: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(path), spec))


# References


def _python_refs(path: str, text: str) -> Iterator[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    here = posixpath.dirname(path)
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            wanted = [(0, a.name) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            wanted = [(n.level, n.module)] if n.module else [(n.level, a.name) for a in n.names]  # from . import a, b
        else:
            continue
        for level, name in wanted:
            rel = name.replace(".", "/")
            if level:
                base = here
                for _ in range(level - 1):
                    base = posixpath.dirname(base)
                tries = [posixpath.join(base, rel + ".py"), posixpath.join(base, rel, "__init__.py")]
                yield row(path, "ref", path, candidates=tries)
            else:
                tries = [rel + ".py", rel + "/__init__.py"]
                yield row(path, "ref", path, candidates=tries + [f"{here}/{t}" for t in tries] * bool(here), external=name.split(".")[0])


def _js_refs(path: str, text: str) -> Iterator[dict]:
    if path.endswith(".vue"):
        script = re.search(R.VUE_SCRIPT, text)
        text = script[1] if script else ""
    for spec in dict.fromkeys(s for p in R.JS_REFS for s in _all(p, text)):
        if spec.startswith((".", "/")):
            base = spec.lstrip("/") if spec.startswith("/") else _beside(path, spec)
            plain = [] if posixpath.splitext(base)[1] else [base + e for e in R.JS_ORDER]
            yield row(path, "ref", path, candidates=[*plain, base, *(f"{base}/{i}" for i in R.JS_INDEX)])
        else:
            parts = spec.split("/")
            yield row(path, "ref", path, candidates=[], external="/".join(parts[:2]) if spec.startswith("@") else parts[0], wanted=spec)


def _css_refs(path: str, text: str) -> Iterator[dict]:
    for spec in (s for p in R.CSS_REFS for s in _all(p, text)):
        if spec.startswith(("http", "//", "data:")):
            continue
        base = _beside(path, spec)
        folder, name = posixpath.split(base)
        partial = posixpath.join(folder, "_" + name)
        yield row(path, "ref", path, candidates=[base, *(base + e for e in R.CSS_ORDER), *(partial + e for e in R.CSS_ORDER), partial], kind="styles")


def _go_refs(path: str, text: str) -> Iterator[dict]:
    specs = _all(R.GO_SINGLE, text) + [s for b in _all(R.GO_BLOCK, text) for s in _all(R.GO_LINE, b)]
    for spec in specs:
        p = spec.split("/")
        keep = 3 if p[0] in ("github.com", "gitlab.com", "bitbucket.org", "gopkg.in", "golang.org", "google.golang.org", "k8s.io") else 1
        yield row(path, "ref", posixpath.dirname(path) or ".", candidates=[], external="/".join(p[:keep]), wanted=spec)


def _ruby_refs(path: str, text: str) -> Iterator[dict]:
    for spec in (s for p in R.RUBY_REFS for s in _all(p, text)):
        name = spec if spec.endswith(".rb") else spec + ".rb"
        if spec.startswith("."):
            yield row(path, "ref", path, candidates=[_beside(path, name)])
        else:
            yield row(path, "ref", path, candidates=[name, "lib/" + name, "app/" + name], wanted=name, external=spec.split("/")[0])


def _rust_refs(path: str, text: str) -> Iterator[dict]:
    seen = set()
    here = posixpath.dirname(path)
    for name in _all(R.RUST_MOD, text):
        seen.add(("mod", name))
        yield row(path, "ref", path, candidates=[posixpath.join(here, name + ".rs"), posixpath.join(here, name, "mod.rs")])
    for use in dict.fromkeys(_all(R.RUST_CRATE, text)):
        if use.startswith("crate::"):
            rel = use[7:].replace("::", "/")
            yield row(path, "ref", path, candidates=[rel + ".rs", rel + "/mod.rs"])
    for crate in dict.fromkeys(_all(R.RUST_EXTERNAL, text)):
        if crate not in R.RUST_STD:
            yield row(path, "ref", path, candidates=[], external=crate)


def _jvm_refs(path: str, text: str, lang: str) -> Iterator[dict]:
    for name in _all(R.JVM_REFS[lang], text):
        yield row(path, "ref", path, candidates=[], wanted=name, kind="fqn", external=".".join(name.split(".")[:2]))


def _php_refs(path: str, text: str) -> Iterator[dict]:
    for spec in _all(R.PHP_FILES, text):
        base = _beside(path, spec.lstrip("/") if spec.startswith("/") else spec)
        yield row(path, "ref", path, candidates=[base, base + ".php"])
    for use in _all(R.PHP_USE, text):
        parts = use.strip("\\").split("\\")
        yield row(path, "ref", path, candidates=["/".join(parts) + ".php"], wanted=parts[-1] + ".php", external="\\".join(parts[:2]))


def _terraform(path: str, text: str) -> Iterator[dict]:
    scope = posixpath.dirname(path)
    for kind, pattern in R.TF_DEFINES.items():
        for m in re.finditer(pattern, text):
            yield row(path, "define", ".".join(m.groups()), kind=kind, wanted=scope)
    for body in _all(R.TF_LOCALS, text):
        for key in _all(R.TF_LOCAL_KEY, re.sub(r"\{[^{}]*\}", "", body)):
            yield row(path, "define", key, kind="local", wanted=scope)
    for kind, pattern in R.TF_REFERS.items():
        for name in dict.fromkeys(".".join(m.groups()) for m in re.finditer(pattern, text)):
            yield row(path, "refer", name, kind=kind, wanted=scope)
    for _, source in re.findall(R.TF_SOURCE, text):
        if source.startswith("."):
            base = _beside(path, source)
            yield row(path, "ref", path, candidates=[f"{base}/{e}" for e in R.TF_ENTRIES])
        else:
            yield row(path, "ref", path, candidates=[], external=source)
    providers = _all(R.TF_PROVIDER, text) + [n for b in _all(R.TF_REQUIRED, text) for n in re.findall(r"(?m)^\s+(\w+)\s*=\s*\{", b)]
    for name in dict.fromkeys(providers):
        yield row(path, "ref", path, candidates=[], external=name)


def yaml_map(text: str) -> dict:
    try:
        import yaml
    except ImportError:
        return _plain_yaml(text)
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        return {}
    return data if isinstance(data, dict) else {}


def _plain_yaml(text: str) -> dict:
    """Enough of YAML for nested keys and lists of words, where no YAML library is installed."""
    root: dict = {}
    stack: list[tuple[int, object]] = [(-1, root)]
    for raw in text.splitlines():
        body = raw.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth = len(body) - len(body.lstrip())
        item = body.strip()
        while len(stack) > 1 and (stack[-1][0] > depth or stack[-1][0] == depth and not (item.startswith("- ") and isinstance(stack[-1][1], list))):
            stack.pop()
        at = stack[-1][1]
        if item.startswith("- "):
            if isinstance(at, list):
                at.append(item[2:].strip().strip("'\""))
            continue
        key, _, value = item.partition(":")
        value = value.strip()
        if isinstance(at, dict):
            if value.startswith("["):
                at[key] = [v.strip().strip("'\"") for v in value.strip("[]").split(",") if v.strip()]
            elif value:
                at[key] = value.strip("'\"")
            else:
                nxt = next((x for x in text[text.index(raw) + len(raw) :].splitlines() if x.strip()), "")
                at[key] = [] if nxt.strip().startswith("- ") else {}
                stack.append((depth if isinstance(at[key], list) else depth, at[key]))
    return root


def _names(x) -> list[str]:
    if isinstance(x, str):
        return [x]
    if isinstance(x, dict):
        return [str(n) for n in x]
    return [str(n.get("job", "")) if isinstance(n, dict) else str(n) for n in (x if isinstance(x, list) else [])]


def _compose(path: str, text: str) -> Iterator[dict]:
    services = yaml_map(text).get("services")
    for name, spec in (services if isinstance(services, dict) else {}).items():
        spec = spec if isinstance(spec, dict) else {}
        name = str(name)
        yield row(path, "node", name, kind="service", external="docker", line=text.count("\n") + 1)
        for dep in _names(spec.get("depends_on")):
            yield row(path, "ref", name, candidates=[dep], kind="depends")
        if isinstance(spec.get("image"), str):
            yield row(path, "ref", name, candidates=[], external=spec["image"].split(":")[0])


def _dockerfile(path: str, text: str) -> Iterator[dict]:
    stages = set()
    for image, alias in re.findall(R.DOCKER_FROM, text):
        if image != "scratch" and image not in stages:
            yield row(path, "ref", path, candidates=[], external=image.split(":")[0])
        if alias:
            stages.add(alias)


def _jobs(path: str, text: str, lang: str) -> Iterator[dict]:
    data = yaml_map(text)
    jobs = data.get("jobs") if lang == "github-actions" else {k: v for k, v in data.items() if isinstance(k, str) and k not in R.GITLAB_RESERVED and not k.startswith(".")}
    prefix = posixpath.splitext(posixpath.basename(path))[0] + "/" if lang == "github-actions" else ""
    for name, spec in (jobs if isinstance(jobs, dict) else {}).items():
        if not isinstance(spec, dict):
            continue
        name = str(name)
        yield row(path, "node", prefix + name, kind="pipeline", external=lang, line=0)
        for dep in _names(spec.get("needs")):  # the edge runs from the dependency to the job
            yield row(path, "ref", prefix + dep, candidates=[prefix + name], kind="depends")


def _sql(path: str, text: str) -> Iterator[dict]:
    marks = list(re.finditer(R.SQL_TABLE, text))
    for m, nxt in zip(marks, [*marks[1:], None], strict=True):
        own = f"{path}:{m[1].lower()}"
        yield row(path, "node", own, kind="database", external="sql", line=_line(text, m.start()))
        for other in dict.fromkeys(_all(R.SQL_REFERENCE, text[m.end() : nxt.start() if nxt else len(text)])):
            yield row(path, "ref", own, candidates=[f"{path}:{other.lower()}"], kind="depends")


def _prisma(path: str, text: str) -> Iterator[dict]:
    pairs = set()
    for m in re.finditer(R.PRISMA_MODEL, text):
        yield row(path, "node", f"{path}:{m[1]}", kind="database", external="prisma", line=_line(text, m.start()))
        for _, kind in re.findall(R.PRISMA_FIELD, m[2]):
            if kind[0].isupper() and kind not in R.PRISMA_SCALARS and (kind, m[1]) not in pairs and kind != m[1]:
                pairs.add((m[1], kind))
                yield row(path, "ref", f"{path}:{m[1]}", candidates=[f"{path}:{kind}"], kind="depends")


def references(path: str, text: str, lang: str) -> Iterator[dict]:
    family = R.SAME.get(lang, lang)
    if lang in ("java", "kotlin"):
        yield from _jvm_refs(path, text, lang)
    elif lang in ("github-actions", "gitlab-ci"):
        yield from _jobs(path, text, lang)
    else:
        by = {"python": _python_refs, "javascript": _js_refs, "css": _css_refs, "go": _go_refs, "ruby": _ruby_refs, "rust": _rust_refs, "php": _php_refs, "terraform": _terraform, "compose": _compose, "docker": _dockerfile, "sql": _sql, "prisma": _prisma}
        yield from by[family](path, text)


# Symbols


def _python_symbols(path: str, text: str) -> Iterator[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    for n in tree.body:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            is_class = isinstance(n, ast.ClassDef)
            methods = [c.name for c in n.body if isinstance(c, ast.FunctionDef | ast.AsyncFunctionDef) and not c.name.startswith("__")] if is_class else []
            doc = (ast.get_docstring(n) or "").split("\n")[0][:80]
            yield row(path, "symbol", n.name, line=n.lineno, kind="class" if is_class else "function", exported=not n.name.startswith("_"), doc=doc or None, methods=methods or None)


def _listed(names: str) -> list[str]:
    """Names of an export list; of "a as b" it is b; default and what is no plain name are left out."""
    items = (re.match(R.LISTED, item) for item in names.split(","))
    return [m[1] for m in items if m and m[1] != "default"]


def symbols(path: str, text: str, lang: str) -> Iterator[dict]:
    if lang == "python":
        yield from _python_symbols(path, text)
        return
    table = R.SYMBOLS.get(lang) or R.SYMBOLS.get(R.SAME.get(lang, ""), [])
    seen: set[str] = set(R.NOISE.get(R.SAME.get(lang, lang), []))
    for kind, pattern in table:
        for m in re.finditer(pattern, text):
            names = _listed(m[1]) if kind == "names" else [".".join(m.groups())]
            for name in names:
                if name not in seen:
                    seen.add(name)
                    shown = {"go": name[:1].isupper(), "rust": m[0].startswith("pub"), "terraform": kind != "provider"}.get(lang, True)
                    yield row(path, "symbol", name, line=_line(text, m.start()), kind="const" if kind == "names" else kind, exported=shown)


def urls(path: str, text: str, lang: str) -> Iterator[dict]:
    if lang == "python":
        prefix = (_all(R.ROUTER_PREFIX, text) or [None])[0]
        for p in dict.fromkeys(x for r in R.ROUTES for x in _all(r, text)):
            yield row(path, "route", p, wanted=prefix)  # the router's own prefix, unless it is mounted under another
        for module, p in re.findall(R.INCLUDED_PREFIX, text):
            yield row(path, "include", module, wanted=p)
    elif R.SAME.get(lang, lang) == "javascript":
        for p in dict.fromkeys(x for r in R.CALLS for x in _all(r, text)):
            if p.startswith(("/", "http")) and not p.endswith(R.NOT_API):
                yield row(path, "call", p)


OWN_NODES = ("compose", "github-actions", "gitlab-ci", "sql", "prisma")


def scan(path: str, text: str) -> list[dict]:
    """All rows of a file. One that an extractor cannot take (too deeply nested, say) gives its node and an error row."""
    try:
        return list(_scan(path, text))
    except (ArithmeticError, AttributeError, LookupError, MemoryError, RecursionError, TypeError, ValueError) as e:
        own = row(path, "node", path, kind="module", external=language(path), line=text.count("\n") + 1)
        return [own, row(path, "error", type(e).__name__, doc=str(e)[:200])]


def _scan(path: str, text: str) -> Iterator[dict]:
    lang = language(path)
    if lang is None:
        return
    if lang not in OWN_NODES:
        package = _all(R.JVM_PACKAGE[lang], text) if lang in ("java", "kotlin") else []
        stem = posixpath.splitext(posixpath.basename(path))[0]
        key = ".".join([*package[:1], stem]) if lang in ("java", "kotlin") else None
        own = posixpath.dirname(path) or "." if lang == "go" else path
        kind = "service" if lang == "docker" else node_type(own if lang == "go" else path, text, lang)
        yield row(path, "node", own, kind=kind, external=lang, line=text.count("\n") + 1, doc=key)
    yield from references(path, text, lang)
    yield from symbols(path, text, lang)
    yield from urls(path, text, lang)
