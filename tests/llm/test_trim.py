"""The driver's JVM gives free memory back whenever a table has been written."""

from graphloom.llm import common


def test_storing_gives_free_memory_back(spark, monkeypatch):
    done, real = [], common.trim
    monkeypatch.setattr(common, "trim", lambda s: done.append(real(s)))
    assert common.stored(spark.range(3)).count() == 3
    assert done == [True]
