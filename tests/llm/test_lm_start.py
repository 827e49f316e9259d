"""The language model does not depend on how documents lie in partitions."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from graphloom.llm import hmm


def test_counts_of_all_words(monkeypatch):
    monkeypatch.setattr(hmm, "HELD_WORDS", 5)
    rnd = random.Random(2)
    texts = [" ".join(f"W{rnd.randrange(30)}" for _ in range(20)) for _ in range(12)] + ["", None]
    monkeypatch.setattr(hmm, "_slices", lambda texts, most: ([t] for t in texts))
    got = Counter()
    for b in hmm._word_counts(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])):
        got.update(dict(zip(b.column("word").to_pylist(), b.column("c").to_pylist(), strict=True)))
    assert got == Counter(w for t in texts if t for w in t.lower().encode().split())


def test_gatherings_follow_neighbours():
    """Words of two vocabularies that never meet start in different states."""
    near, seen = np.zeros((hmm.ALL, hmm.GROUPS)), np.zeros(hmm.ALL)
    seen[:40] = 10
    near[:20, :20], near[20:40, 20:40] = 3, 3
    label = hmm.gathered(near, seen)
    assert not set(label[:20]) & set(label[20:40])


def test_scores_do_not_depend_on_partitions(spark):
    rnd = random.Random(6)
    vocabularies = [[f"{c}{i}" for i in range(60)] for c in "ab"]
    rows = [(i, " ".join(rnd.choices(vocabularies[i % 2], k=rnd.randrange(1, 40)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r["doc_id"]: r for r in hmm.lm_scores(df.repartition(n)).collect()} for n in (1, 7))
    assert all(abs(one[i]["score"] - many[i]["score"]) < 1e-6 and one[i]["n_known"] == many[i]["n_known"] for i in one)
    held = [r for r in one.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the vocabularies are told apart
