"""Embedding providers as vectorised functions; the built-in one hashes words and needs no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BATCH = 64


def hashed(texts: list[str], dims: int = 64) -> list[list[float]]:
    """Signed word hashing, normalised; equal texts have equal vectors."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            d = hashlib.md5(w.encode()).digest()
            out[i, int.from_bytes(d[:4], "little") % dims] += 1.0 if d[4] & 1 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).tolist()


def http(endpoint: str, model: str, key: str | None = None, timeout: int = 30) -> Callable[[list[str]], list[list[float]]]:
    """A provider that posts batches to an embeddings endpoint."""

    def embed(texts: list[str]) -> list[list[float]]:
        import json
        from urllib.request import Request, urlopen

        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        body = json.dumps({"input": texts, "model": model}).encode()
        try:
            with urlopen(Request(endpoint.rstrip("/") + "/v1/embeddings", body, head), timeout=timeout) as r:
                rows = json.load(r)["data"]
        except OSError as e:
            raise RuntimeError(f"the embedding endpoint can't be reached: {e}") from e
        return [x["embedding"] for x in sorted(rows, key=lambda x: x["index"])]

    return embed


def embedded(rows: DataFrame, provider: Callable[[list[str]], list[list[float]]] = hashed) -> DataFrame:
    """(symbol_id, embedding) of rows (symbol_id, text), BATCH texts a call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), BATCH):
                part = f.iloc[lo : lo + BATCH]
                yield pd.DataFrame({"symbol_id": part["symbol_id"], "embedding": provider(part["text"].fillna("").tolist())})

    return rows.select("symbol_id", "text").mapInPandas(run, "symbol_id long, embedding array<float>")
