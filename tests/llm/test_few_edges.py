"""Components of few edges are solved in the driver."""

import numpy as np

from graphloom.llm import components


def test_few_edges_are_solved_without_rounds(spark):
    path = np.random.default_rng(2).permutation(3000) - 1500
    edges = [*zip(path[:-1].tolist(), path[1:].tolist(), strict=True), (9000, 9001), (9001, 9000), (7, 7), (None, 3)]
    before = components.written()
    out = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**dict.fromkeys(path.tolist(), -1500), 9000: 9000, 9001: 9000}
    assert components.written() - before <= 2


def test_rounds_and_driver_agree(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    edges = spark.createDataFrame(list(zip(rnd.integers(0, 60, 40).tolist(), rnd.integers(0, 60, 40).tolist(), strict=True)), "a long, b long")
    few = {tuple(r) for r in components.components(edges).collect()}
    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in components.components(edges).collect()} == few
