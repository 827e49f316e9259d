"""op10_lm_scores: texts are split once for training and scoring, a slice's distinct words are looked up, and both read stored symbols."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from graphloom.llm import hmm

ODD = ["", " ", None, "\t\n\x0b\x0c\r ", " A b\x1cc\x00 É\x85é ", "x", "  Über  STRASSE\n", "a a a A b", "  　"]


def test_words_of_odd_texts():
    texts = [(t or "").encode() for t in ODD] + [b"\xff\xfeA \xc3", b"", b"z "]
    words, sizes = hmm._words(texts)
    assert words.to_pylist() == [w for t in texts for w in t.lower().split()]
    assert sizes.tolist() == [len(t.split()) for t in texts]
    assert [len(x) for x in hmm._words([b""])] == [0, 1] and hmm._words([b"", b" "])[1].tolist() == [0, 0]


def test_symbols_and_tail_words(monkeypatch):
    rnd = random.Random(4)
    rows = [(i, t or "", i % 3 == 0) for i, t in enumerate(ODD + [" ".join(f"w{rnd.randrange(40)}" for _ in range(30)) for _ in range(20)])]
    head = [b"a", b"w1", b"w2", b"w30"]
    monkeypatch.setattr(hmm, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Own", (), {"partitionId": staticmethod(lambda: 3)}))}))
    columns = [pa.array(c) for c in zip(*rows, strict=True)]
    out = [r for b in hmm._coded(head, 7)(iter([pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "held"])])) for r in b.to_pylist()]
    (docs,) = (r for r in out if r["bucket"] < 0)
    by_id = {i: (t.encode().lower().split(), h) for i, t, h in rows}
    assert docs["taught"] == sum(not h for _, _, h in rows) and [by_id[i][1] for i in docs["ids"]] == sorted(h for _, _, h in rows)
    want = [s for i in docs["ids"] for s in [*(head.index(w) if w in head else hmm.HEAD + (w[-1] * 7 + (w[-2] if len(w) > 1 else 0)) % hmm.TAIL for w in by_id[i][0]), hmm.END]]
    assert np.frombuffer(docs["flat"], "<u2").tolist() == want
    got = Counter()
    for r in out:
        if r["bucket"] >= 0:
            e = np.frombuffer(r["blob"], hmm.ENTRY)
            assert ((e["hash"] >> np.uint64(20)) % np.uint64(7) == r["bucket"]).all()
            got.update({(int(x["hash"]), docs["ids"][x["doc"]], int(x["train"])): int(x["times"]) for x in e})
    assert got == Counter((xxhash.xxh64_intdigest(w), i, 1 - h) for i, (ws, h) in by_id.items() for w in ws if w not in head)
    assert len([r for r in out if r["bucket"] >= 0]) == len({r["bucket"] for r in out if r["bucket"] >= 0})


def test_texts_are_read_twice_in_all(spark, monkeypatch, tmp_path):
    """Once to count words, once to store symbols: scoring does not read them again."""
    path, read, real = f"{tmp_path}/d.parquet", [], hmm.stored
    spark.createDataFrame([(i, f"a{i % 7} b c{i}") for i in range(60)], "doc_id long, text string").write.parquet(path)
    monkeypatch.setattr(hmm, "stored", lambda df: read.append(any(str(tmp_path) in f for f in df.inputFiles())) or real(df))
    assert hmm.lm_scores(spark.read.parquet(path)).count() == 60
    assert sum(read) == 2


def test_partitions_without_rows_send_no_sums():
    model = hmm.Model(np.full(hmm.STATES, 1 / hmm.STATES), np.full((hmm.STATES, hmm.STATES), 1 / hmm.STATES), np.full((hmm.STATES, hmm.ALL), 1 / hmm.ALL))
    for run in (hmm._expected(model), hmm._contexts, hmm._label_moves(np.zeros(hmm.ALL, np.int64))):
        assert not list(run(iter([])))


def test_small_rests_are_no_slices_of_their_own():
    texts = [b"x" * n for n in (3, 3, 1, 9, 2, 2)]
    assert [[len(t) for t in s] for s in hmm._slices(texts, 5)] == [[3, 3], [1, 9, 2, 2]]
    assert list(hmm._slices([], 5)) == [] and list(hmm._slices([b"", b""], 5)) == [[b"", b""]]


def test_neighbours_are_counted_across_runs(monkeypatch):
    rng = np.random.default_rng(8)
    sizes = [1, 2, 9, 30, 4]
    flat = rng.integers(0, hmm.ALL, sum(sizes))
    batch = pa.RecordBatch.from_arrays([pa.array([np.asarray(flat, "<u2").tobytes()]), pa.array([np.asarray(sizes, "<i8").tobytes()]), pa.array([4], pa.int32())], ["flat", "sizes", "taught"])
    group, want, at = hmm._groups(), np.zeros((hmm.ALL, hmm.GROUPS)), 0
    for n in sizes[:4]:
        for i in range(at, at + n):
            for j in range(max(at, i - hmm.NEAR), min(at + n, i + hmm.NEAR + 1)):
                want[flat[i], group[flat[j]]] += i != j
        at += n
    for run in (3, 7, 65_536):
        monkeypatch.setattr(hmm, "RUN", run)
        (out,) = hmm._contexts(iter([batch]))
        got = np.concatenate([np.frombuffer(v, "<f8") for v in out["v"].to_pylist()])
        assert (got[: hmm.ALL] == np.bincount(flat[:42], minlength=hmm.ALL)).all() and (got[hmm.ALL :].reshape(want.shape) == want).all()
