"""Text of impact reports and symbol sections."""

from __future__ import annotations

from .schema import KIND_ABBREVIATIONS


def label(score: float, total: int) -> str:
    if not total:
        return "UNKNOWN"
    pct = 100 * score / total
    for name, least, share in (("CRITICAL", 20, 30), ("HIGH", 10, 15), ("MEDIUM", 4, 5)):
        if score >= least or pct >= share:
            return name
    return "LOW"


def impact(file: str, rows: list[dict], total: int, markdown: bool = False) -> str:
    """rows: node, hop and path of each dependent."""
    near, far = sorted(r["node"] for r in rows if r["hop"] == 1), sorted((r for r in rows if r["hop"] > 1), key=lambda r: r["node"])
    score = round(len(near) + 0.5 * len(far), 2)
    risk = label(score, total)
    head, item = ("## ", "- ") if markdown else ("", "  ")
    out = [f"{head}Impact: {file}", f"Blast score: {score} ({len(near)} direct, {len(far)} transitive) [{risk}]", ""]
    for title, lines in ((f"Direct dependents ({len(near)})", near), (f"Transitive dependents ({len(far)})", [f"{r['node']} <- {' -> '.join(reversed(r['path'] or [r['node']]))}" for r in far])):
        if lines:
            out += [f"{head}{title}", *(item + x for x in lines), ""]
    if total:
        n = len(near) + len(far)
        out.append(f"Risk: {risk}: {n} of {total} files ({round(100 * n / total, 1)}%)")
    return "\n".join(out)


def symbol(s: dict) -> str:
    methods = s.get("methods") or []
    rest = len(methods) - 6
    listed = ",".join(methods[:6]) + (f",+{rest}" if rest > 0 else "")
    return f"{s['name']}:{KIND_ABBREVIATIONS.get(s['kind'], '?')}:{s['line']}" + (f"[{listed}]" if methods else "")


def section(symbols: list[dict], everything: bool = False, begin: str = "<!-- symbols:begin -->", end: str = "<!-- symbols:end -->") -> str:
    by: dict[str, list[str]] = {}
    for s in sorted(symbols, key=lambda s: (s["path"], s["line"] or 0)):
        if everything or s.get("exported") is not False:
            by.setdefault(s["path"], []).append(symbol(s))
    return "\n".join([begin, *(f"{p}: {' '.join(v)}" for p, v in by.items()), end])


def symbol_document(symbols: list[dict], repo: str, day: str) -> dict:
    """Symbols by name and by file, as one document."""
    names: dict[str, list[dict]] = {}
    owners: dict[str, list[dict]] = {}
    for s in sorted(symbols, key=lambda s: (s["path"], s["line"] or 0, s["name"])):
        own = {k: s.get(k) for k in ("kind", "line", "exported", "doc", "methods") if s.get(k) is not None}
        owners.setdefault(s["path"], []).append({"name": s["name"], **own})
        names.setdefault(s["name"], []).append({**own, "file": s["path"]})
    return {"meta": {"generated": day, "repo": repo + "/", "total_symbols": len(symbols)}, "symbols": names, "file_symbols": owners}


def with_symbols(document: dict, file_symbols: dict[str, list[dict]]) -> dict:
    """A graph document whose nodes carry their symbols; a node that is a folder carries those of the files below it."""
    below: dict[str, list[dict]] = {}
    for path, own in file_symbols.items():
        for k, c in enumerate(path):
            if c == "/":
                below.setdefault(path[:k], []).extend(own)
    nodes = []
    for node in document["nodes"]:
        own = file_symbols.get(node["id"]) or below.get(node["id"])
        nodes.append({**node, "symbols": own} if own else node)
    return {**document, "nodes": nodes}


def snippet(text: str, line: int, most: int = 5) -> list[str]:
    """The lines of a definition: its own and those after it."""
    return text.splitlines()[max(0, line - 1) : line - 1 + most]


def spliced(text: str, block: str) -> str:
    """text with the marked section replaced, or appended."""
    begin, end = block.split("\n", 1)[0], block.rsplit("\n", 1)[-1]
    if begin in text and end in text:
        return text[: text.index(begin)] + block + text[text.index(end) + len(end) :]
    return (text.rstrip("\n") + "\n\n" if text else "") + block + "\n"
