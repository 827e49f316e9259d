"""The quality field learns from every line of every labelled document that may teach."""

import itertools
import math
import zlib

import numpy as np

from graphloom.llm import common, line_crf


def test_every_labelled_line_teaches(spark, monkeypatch):
    texts = {i: "\n".join(["w" * (1 + i % 7)] * (1 + i % 40)) for i in range(12_000)}
    docs = spark.createDataFrame([*texts.items(), (0, texts[0]), (None, "a\nb")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 > 2)) for i in texts], "doc_id long, quality int")
    teach = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 3 != 1]
    lengths = np.concatenate([[len(x) for x in t.split("\n")] for t in teach])
    assert len(teach) > 6000 and len(lengths) > 100_000
    monkeypatch.setattr(line_crf, "ascended", lambda value, at: value(at)[1], raising=False)  # the gradient at zero
    few = line_crf.trained(docs, labels)
    assert abs(few.center[0] - np.mean(np.log1p(lengths) / 6)) < 1e-6
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)  # as for labels too many to broadcast
    many = line_crf.trained(docs.repartition(7), labels)
    assert np.allclose(few.center, many.center) and np.allclose(few.weights, many.weights) and np.allclose(few.move, many.move)


def test_ascent_ends_at_the_maximum():
    rnd = np.random.default_rng(5)
    a = rnd.normal(size=(40, 40)) @ np.diag(np.logspace(0, -1.3, 40))
    a, top = a @ a.T / 40 + 1e-3 * np.eye(40), rnd.normal(size=40)
    got = line_crf.ascended(lambda x: (-float((x - top) @ a @ (x - top)) / 2, -a @ (x - top)), np.zeros(40))
    assert np.abs(a @ (got - top)).max() < line_crf.FLAT


def test_a_score_does_not_depend_on_other_texts():
    a, b = b"one two three\nfour", b"four one\nfour five"
    together, alone = line_crf.shapes([a, b])[0], [line_crf.shapes([t])[0] for t in (a, b)]
    assert np.array_equal(together, np.concatenate(alone))


def test_likelihood_matches_enumeration_and_its_gradient():
    rnd = np.random.default_rng(3)
    x, per, label = rnd.normal(size=(6, line_crf.WIDTH)), np.array([4, 2]), np.array([1, 0])

    def of(at):
        return line_crf._likelihood(at[: line_crf.WIDTH], 0.1, at[line_crf.WIDTH :].reshape(2, 2))(x, per, label)

    at = rnd.normal(size=line_crf.WIDTH + 4) / 5
    logit, move = x @ at[: line_crf.WIDTH] + 0.1, at[line_crf.WIDTH :].reshape(2, 2)

    def weight(own, y):
        return sum(a * b for a, b in zip(own, y, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(y))

    want = sum((weight(own, [v] * len(own)) - math.log(sum(math.exp(weight(own, y)) for y in itertools.product((0, 1), repeat=len(own))))) / len(own) for own, v in ((logit[:4], 1), (logit[4:], 0)))
    got = of(at)
    assert np.isclose(got[0], want)
    seen = np.array([1 / 2, 0, 0, 3 / 4])
    slope = np.concatenate([got[1 : 1 + line_crf.WIDTH], seen - got[1 + line_crf.WIDTH :]])
    step = 1e-5 * np.eye(len(at))
    assert np.allclose(slope, [(of(at + d)[0] - of(at - d)[0]) / 2e-5 for d in step], atol=1e-6)
