"""Git history as DataFrames: the log, tree snapshots, blobs, and what changed."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schema import COMMITS


def _git(root: str, *args: str, timeout: int = 60) -> str | None:
    try:
        run = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return run.stdout.decode(errors="replace") if run.returncode == 0 else None


def resolve(root: str, ref: str = "HEAD") -> str | None:
    out = _git(root, "rev-parse", "--verify", ref + "^{commit}", timeout=10)
    return out.strip() if out else None


def log(spark: SparkSession, root: str, since: str | None = None, most: int = 1000) -> DataFrame:
    """The newest `most` commits, oldest first by seq; parent_hash is the first parent."""
    args = ["log", "-n", str(most), "--topo-order", "--format=%H%x00%aI%x00%cI%x00%ae%x00%s%x00%P"] + ([f"--since={since}"] if since else [])
    rows = [line.split("\0") for line in (_git(root, *args, timeout=120) or "").splitlines()][::-1]
    data = [(i, h, a, c, who, text, (parents.split() or [None])[0]) for i, (h, a, c, who, text, parents) in enumerate(rows)]
    return spark.createDataFrame(data, "seq int, hash string, authored_at string, committed_at string, author string, message string, parent_hash string").select("seq", *COMMITS.names)


def parents(spark: SparkSession, root: str) -> DataFrame:
    """(hash, parent) of all parents, for reachability over merges."""
    rows = [line.split() for line in (_git(root, "log", "--all", "--format=%H %P", timeout=120) or "").splitlines()]
    return spark.createDataFrame([(r[0], p) for r in rows for p in (r[1:] or [None])], "hash string, parent string")


def reachable(spark: SparkSession, root: str, ref: str) -> DataFrame:
    return spark.createDataFrame([(h,) for h in (_git(root, "log", "--format=%H", ref) or "").split()], "hash string")


def changed(root: str, ref: str, kinds: str = "M") -> list[str]:
    """Paths whose status against ref is among kinds."""
    lines = (_git(root, "diff", "--name-status", ref, timeout=30) or "").splitlines()
    return [x.split("\t")[-1] for x in lines if x[:1] in kinds]


def staged(root: str) -> list[str]:
    """Added or modified paths in the index."""
    return (_git(root, "diff", "--cached", "--name-only", "--diff-filter=AM", timeout=30) or "").splitlines()


def snapshots(commits: DataFrame, root: str) -> DataFrame:
    """(seq, path, blob) of every commit's tree; commits are spread over partitions, each lists its own trees."""

    def trees(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for seq, h in zip(f["seq"], f["hash"], strict=True):
                lines = (_git(root, "ls-tree", "-r", "-z", h, timeout=60) or "").split("\0")
                rows = [(seq, x.split("\t", 1)[1], x.split("\t", 1)[0].split()[2]) for x in lines if " blob " in x.split("\t", 1)[0]]
                yield pd.DataFrame(rows, columns=["seq", "path", "blob"]).astype({"seq": "int32"})

    n = max(1, min(64, commits.count() // 16))
    return commits.select("seq", "hash").repartition(n, "seq").mapInPandas(trees, "seq int, path string, blob string")


def blobs(names: DataFrame, root: str) -> DataFrame:
    """(blob, content) of distinct blobs, through one batch process for each partition."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = f["blob"].tolist()
            run = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input="\n".join(ids).encode() + b"\n", capture_output=True, timeout=600)
            out, at, rows = run.stdout, 0, []
            while at < len(out):
                end = out.index(b"\n", at)
                head = out[at:end].split()
                at = end + 1
                if len(head) == 3:
                    size = int(head[2])
                    rows.append((head[0].decode(), out[at : at + size].decode(errors="replace")))
                    at += size + 1
            yield pd.DataFrame(rows, columns=["blob", "content"])

    return names.select("blob").distinct().mapInPandas(read, "blob string, content string")
