"""The pre-commit hook that gates staged files by their scores."""

from __future__ import annotations

import shlex
import sys
from pathlib import Path

MARK = "# graphloom-hook"
BLOCKED = 3  #: the gate's exit code for staged files at the threshold in strict mode; any other lets the commit pass


def script(threshold: int, strict: bool) -> str:
    """Without a store, or where the gate itself fails, the commit passes."""
    gate = [sys.executable, "-m", "graphloom.api", "gate", "--threshold", str(threshold), *["--strict"] * strict]
    home = shlex.quote(str(Path(__file__).resolve().parents[2]))
    return f"""#!/bin/sh
{MARK}: delete this file, or run install-hook --remove, to switch it off
root=$(git rev-parse --show-toplevel) || exit 0
[ -d "$root/.graphloom" ] || exit 0
PYTHONPATH={home}${{PYTHONPATH:+:$PYTHONPATH}} {shlex.join(gate)} --repo "$root"
[ $? -ne {BLOCKED} ]
"""


def install(repo: str, threshold: int = 10, strict: bool = False) -> str | None:
    """Writes the hook and gives its path; None where there is no repository or another tool's hook is in place."""
    at = Path(repo) / ".git" / "hooks" / "pre-commit"
    if not at.parent.parent.is_dir() or (at.exists() and MARK not in at.read_text(errors="replace")):
        return None
    at.parent.mkdir(exist_ok=True)
    at.write_text(script(threshold, strict))
    at.chmod(at.stat().st_mode | 0o111)
    return str(at)


def remove(repo: str) -> str | None:
    """Deletes the hook and gives its path; None if it is not there or is another tool's."""
    at = Path(repo) / ".git" / "hooks" / "pre-commit"
    if not at.exists() or MARK not in at.read_text(errors="replace"):
        return None
    at.unlink()
    return str(at)
