"""Latent directions come from whole tables: every item, and document frequencies over every document."""

import numpy as np

from graphloom.llm import decontaminate


def test_directions_do_not_depend_on_which_documents_are_seen(spark):
    items = [(i, " ".join(f"w{j}" for j in range(3 * i, 3 * i + 9)).encode()) for i in range(80)]
    one = [(f"w{2 * i} w{2 * i + 1}",) for i in range(120)]
    other = [(f"w{i} w{i + 120}",) for i in range(120)]  # the same document frequencies, other neighbours
    fits = [decontaminate.fitted(spark.createDataFrame(d, "text string"), decontaminate.Index(items)) for d in (one, other)]
    a, b = ((f.rows @ f.rows.T).astype(float) for f in fits)
    assert np.allclose(a, b, atol=1e-3)
