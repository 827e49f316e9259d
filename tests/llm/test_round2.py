"""What the findings of round 2 changed."""

import numpy as np
import pyarrow as pa

from graphloom.llm import ngram_join


def signatures(rule, sets):
    hits = [[{"df": 2, "tok": t} for t in s[: rule.sample(len(s))]] for s in sets]
    batch = pa.record_batch({"cls": pa.array(range(len(sets)), pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "hits": pa.array(hits, pa.list_(pa.struct([("df", pa.int32()), ("tok", pa.int64())])))})
    (out,) = ngram_join._signatures(rule)(iter([batch]))
    found = {i: set() for i in range(len(sets))}
    for s, c in zip(out.column("sig").to_pylist(), out.column("cls").to_pylist(), strict=True):
        found[c].add(s)
    return found


def test_sets_of_other_sizes_share_no_signature():
    base = sorted(np.random.default_rng(1).choice(1 << 40, 400, replace=False).tolist())
    found = signatures(ngram_join.Rule(9, 10), [base[:200], base[:195], base[:400]])
    assert found[0] & found[1]
    assert not found[0] & found[2] and not found[1] & found[2]


def test_steps_of_similar_sizes_are_next_to_each_other():
    for num, den in ((9, 10), (8, 10)):
        rule = ngram_join.Rule(num, den)
        for n in [*range(1, 3000), 10**6, 10**7]:
            assert 0 <= rule.step(n * den // num) - rule.step(n) <= 1
