"""The trees and thresholds for personal data learn from every candidate."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import pii


class Stop(Exception):
    pass


def test_every_candidate_teaches(spark, monkeypatch):
    seen = []

    def caught(df):
        seen.append(df.cache())
        raise Stop

    monkeypatch.setattr(pii, "stored", caught)
    rows = spark.range(40_001).select(F.concat(F.lit("key = "), F.substring(F.sha1(F.col("id").cast("string")), 1, 24), F.lit(" x")).alias("body"))
    want = rows.where(F.col("body").rlike("[0-9]")).count()
    with pytest.raises(Stop):
        pii.fitted(rows)
    loose = seen[0].where("k = 'secret'").agg(F.sum("weight")).first()[0]
    assert loose == want > 40_000
